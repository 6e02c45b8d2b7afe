"""Token ids of whole texts with a public tokenizer, a word at a time.

Both tokenizers split a text at white space, and between a letter or digit and punctuation, before anything else. So the
ids of a text are those of its words. Words repeat, and their ids are kept in a bounded memory of Arrow arrays, which takes
tens of bytes a word. New words are encoded many at a time, with a mark between them that is one token by itself. Texts with unusual white space or with the string of a special token, which gets the id
of that token, are encoded in one go, odd words one by one.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from runledger.llm import arrays

#: Words whose ids are kept per Python worker. When as many are known they become the older half of the
#: memory, from which words in use are taken over, and what was the older half is forgotten.
KEPT_WORDS = 500_000
#: First words of texts whose ids are kept where a tokenizer tells them from others.
KEPT_FIRSTS = 50_000
#: Words encoded in one go, and characters of the texts handled together.
WORDS_AT_ONCE, CHARACTERS = 100, 4 << 20
_MARKS = "\u00a7\u00b6\u2020\u2022\u00a9"
#: White space other than blanks and line breaks.
_RARE = "\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_ODD_SPACE = re.compile(f"[{_RARE}]")
_ODD_FOR_BYTES = re.compile(f"[\t\r{_RARE}]")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids as little-endian unsigned 32-bit bytes. spaced: the tokenizer keeps a space as the beginning of a word."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.spaced = self.tokenizer.normalizer is None
        #: Strings that the tokenizer takes out of a text before it looks for words.
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        begin = os.path.commonprefix(self.special)
        self.cue = begin if self.spaced or begin.lower() == begin.upper() else ""
        single = [c for c in _MARKS if len(self._ids(" " + c)) == 1]
        self.mark = single[0] if single else ""
        self.mark_id = int(self._ids(" " + self.mark)[0]) if single else -1
        self.known = self.older = pa.array([], pa.large_string())
        self.known_ids = self.older_ids = pa.array([], pa.large_binary())
        self.firsts: dict[str, bytes] = {"": b""}

    def _ids(self, text: str) -> np.ndarray:
        # The fast form finds the same ids, but no places of tokens in the text.
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _holds_special(self, text: str) -> bool:
        """Whether the text, or a word of it once that is in lower case, holds the string of a special token."""
        if not self.special or self.cue not in text:
            return False
        seen = text if self.spaced else text.lower()
        return any(s in seen for s in self.special)

    def _encoded(self, words: list[str]) -> pa.Array:
        """The ids of words that are not known, many at a time with a mark between them. A mark and what follows it are apart
        if a space or a letter follows."""
        plain = [bool(w.strip()) and self.mark not in w if self.mark else False for w in words]
        asked = [w for w, is_plain in zip(words, plain, strict=True) if is_plain]
        between = f" {self.mark} "
        joined = [" " * self.spaced + between.join(asked[at : at + WORDS_AT_ONCE]) for at in range(0, len(asked), WORDS_AT_ONCE)]
        flat = [np.zeros(0, "<u4")]
        for at in range(0, len(joined), WORDS_AT_ONCE):
            for found in self.tokenizer.encode_batch_fast(joined[at : at + WORDS_AT_ONCE], add_special_tokens=False):
                flat += [np.array(found.ids, "<u4"), np.array([self.mark_id], "<u4")]
        ids = np.concatenate(flat)
        marks = np.flatnonzero(ids == self.mark_id)
        ends = np.concatenate([[0], marks - np.arange(len(marks))]) * 4
        ids = np.delete(ids, marks)
        found = pa.Array.from_buffers(pa.large_binary(), len(asked), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(ids)])
        if len(asked) == len(words):
            return found
        odd = [self._ids(" " * self.spaced + w).tobytes() for w, is_plain in zip(words, plain, strict=True) if not is_plain]
        place = np.where(plain, np.cumsum(plain) - 1, len(asked) + np.cumsum(~np.array(plain)) - 1)
        return pa.concat_arrays([found, pa.array(odd, pa.large_binary())]).take(pa.array(place))

    def _split(self, text: str) -> tuple[bytes, str]:
        """Ids of what comes before the words, and the text of the words."""
        if self._holds_special(text):
            return self._ids(text).tobytes(), ""
        if self.spaced:
            if text[-1:] == " " or "  " in text or _ODD_FOR_BYTES.search(text):
                return self._ids(text).tobytes(), ""
            first, _, words = text.partition(" ")
            return self._first(first), words
        if _ODD_SPACE.search(text):
            return self._ids(text).tobytes(), ""
        return b"", text

    def _first(self, word: str) -> bytes:
        """Ids of a word without the space before it."""
        found = self.firsts.get(word)
        if found is None:
            if len(self.firsts) >= KEPT_FIRSTS:
                self.firsts = {"": b""}
            found = self.firsts[word] = self._ids(word).tobytes()
        return found

    def _of_words(self, words: pa.Array) -> pa.Array:
        """Ids of distinct words; an empty one has none."""
        found, ids = [pa.array([""], pa.large_string())], [pa.array([b""], pa.large_binary())]
        left = words.filter(pc.not_equal(words, ""))
        for known, its in ((self.known, self.known_ids), (self.older, self.older_ids)):
            place = pc.index_in(left, value_set=known)
            hit = pc.is_valid(place)
            found.append(left.filter(hit))
            ids.append(its.take(place.filter(hit)))
            left = left.filter(pc.invert(hit))
        found.append(left)
        ids.append(self._encoded(left.to_pylist()))
        self._remember(pa.concat_arrays(found[2:]), pa.concat_arrays(ids[2:]))
        return pa.concat_arrays(ids).take(pc.index_in(words, value_set=pa.concat_arrays(found)))

    def _remember(self, words: pa.Array, ids: pa.Array) -> None:
        """Takes words that were not in the younger half of the memory into it."""
        if len(self.known) + len(words) > KEPT_WORDS:
            self.older, self.older_ids = self.known, self.known_ids
            self.known, self.known_ids, words, ids = words[:0], ids[:0], words[:KEPT_WORDS], ids[:KEPT_WORDS]
        self.known, self.known_ids = pa.concat_arrays([self.known, words]), pa.concat_arrays([self.known_ids, ids])

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text. Arrow splits the texts and lays the ids of their words end to end, so that Python sees
        each word once for the texts handled together."""
        first = 0
        while first < len(texts):
            last, size = first + 1, len(texts[first])
            while last < len(texts) and size + len(texts[last]) <= CHARACTERS:
                size += len(texts[last])
                last += 1
            parts = [self._split(t) for t in texts[first:last]]
            own = pa.array([words for _, words in parts], pa.large_string())
            split = pc.split_pattern(own, " ") if self.spaced else pc.ascii_split_whitespace(own)
            words = split.values.dictionary_encode()
            ids = self._of_words(words.dictionary).take(words.indices)
            bounds = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1)[split.offsets.to_numpy()].tolist()
            data = memoryview(ids.buffers()[2] or b"")
            for (head, _), begin, end in zip(parts, bounds[:-1], bounds[1:], strict=True):
                yield head + data[begin:end]
            del parts, own, split, words, ids, data
            arrays.release()
            first = last


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)
