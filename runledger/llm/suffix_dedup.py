"""Repeated byte strings, found with suffix arrays of shards.

A window is WINDOW bytes of one document. Each is represented by its anchor, the gram of ANCHOR bytes in it with the
smallest hash: equal windows have equal anchors, so windows whose anchor occurs once cannot repeat. Neighbouring windows
with one anchor travel together as one context (their joint bytes) to the shard of the anchor. There the suffixes of all
different contexts are sorted by Larsson-Sadakane refinement (groups of equal prefixes are split by the rank of what
follows, doubling the depth each time) to 32 bytes, and windows by the ranks of their first and last 32 bytes: equal ranks
are equal windows. Shards take at most SHARD_BYTES; where an anchor range needs several, their sorted
windows are merged by binary search. The smallest doc_id of each window decides which occurrences go.

Steps: documents are dealt to blocks, blocks send anchors to buckets, buckets tell each block which anchors other blocks
have, blocks send contexts, shards tell blocks which windows to remove. Everything a task holds is bounded by a block or
a bucket, whose numbers grow with the input. An anchor that HOT_BLOCKS blocks have would overfill its shard; its windows
travel one by one to the shards of their own hashes. Of documents with equal texts only the smallest doc_id takes part.

Null and empty texts have no bytes. A null doc_id counts as larger than any other. Rows with the same doc_id never remove
each other's bytes. Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.llm import arrays
from runledger.llm.storage import partitions, plain_documents

WINDOW, ANCHOR = 50, 16
BLOCK_BYTES = 2 << 20
SHARD_BYTES = 1 << 20
#: Anchors that meet in one bucket, about.
BUCKET_ANCHORS = 100_000
HOT_BLOCKS = 4096
#: Stands for a null doc_id inside the operator.
NO_ID = (1 << 63) - 1
#: Bytes by which suffixes are sorted at first.
FIRST_DEPTH = 8
_U = np.uint64
_KEY_BYTES = 6

_MESSAGE = "bucket int, block int, kind int, first binary, second binary, third binary, fourth binary"
_NAMES = ["bucket", "block", "kind", "first", "second", "third", "fourth"]
_ANCHORS, _COPIES, _HOT, _CONTEXTS, _REMOVED = range(5)


def _messages(rows: list[tuple]) -> pa.Table:
    types = [pa.int32()] * 3 + [pa.binary()] * 4
    filled = [(*r, *[b""] * (7 - len(r))) for r in rows]
    return pa.table([pa.array([r[i] for r in filled], t) for i, t in enumerate(types)], names=_NAMES)


# Suffix arrays


def suffix_order(data: np.ndarray, ends: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions sorted by the bytes that follow, up to ends[position] and to the depth at least; and the rank of each position,
    equal where the bytes are equal to that depth. Larsson and Sadakane: only groups that are not yet split are sorted again."""
    n = len(data)
    key = np.zeros(n, _U)
    padded = np.zeros(n + FIRST_DEPTH, np.uint8)
    padded[:n] = data
    for first in range(FIRST_DEPTH):  # eight bytes from every eighth position on
        words = padded[first : first + (n - first + 7) // 8 * 8].view(">u8") if first < n else key[:0]
        key[first::8] = words
    near = np.flatnonzero(ends < np.arange(FIRST_DEPTH, n + FIRST_DEPTH))  # what lies beyond the end does not count
    beyond = (FIRST_DEPTH - (ends[near] - near)).astype(_U) * _U(8)
    key[near] = key[near] >> beyond << beyond
    order = np.argsort(key)
    key = key[order]
    begins = arrays.group_starts(key)
    sizes = np.diff(begins, append=n)
    rank = np.empty(n, np.int32)
    rank[order] = np.repeat(begins.astype(np.int32), sizes)
    # Suffixes that are not yet told apart: their positions and places in the order.
    several = sizes > 1
    slots = arrays.ranges(begins[several], sizes[several])
    known = FIRST_DEPTH
    while known < depth and len(slots):
        members = order[slots]
        after = members + known
        inside = after < ends[members]
        pair = rank[members].astype(_U) << _U(32)
        pair[inside] |= (rank[after[inside]] + 1).astype(_U)
        within = np.argsort(pair)
        members, pair = members[within], pair[within]
        order[slots] = members
        new = arrays.group_starts(pair)
        sizes = np.diff(new, append=len(slots))
        rank[members] = np.repeat(slots[new].astype(np.int32), sizes)
        slots = slots[np.repeat(sizes > 1, sizes)]
        known *= 2
    return order, rank


def common_prefixes(data: np.ndarray, ends: np.ndarray, order: np.ndarray, rank: np.ndarray, cap: int, lane: int = 128) -> np.ndarray:
    """Kasai: bytes that each position shares with the one sorted before it, up to cap.

    One step to the right loses one shared byte at most. Positions are cut into lanes that step together. Positions of equal
    rank share more than cap bytes; their neighbours' bound still holds, so it is carried over them.
    """
    n = len(data)
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    tied = np.zeros(n, bool)
    tied[order[1:]] = rank[order[1:]] == rank[order[:-1]]
    shared = np.where(tied, np.minimum(ends - np.arange(n), cap), 0)
    height = np.zeros(-(-n // lane), np.int64)
    for step in range(lane):
        at = np.arange(step, n, lane)
        height = np.maximum(height[: len(at)] - 1, 0)
        height[(at > 0) & (ends[at] != ends[at - 1])] = 0  # another context begins
        live = np.flatnonzero(~tied[at] & (before[at] >= 0))
        here, there = at[live], before[at[live]]
        reach = np.minimum(np.minimum(ends[here] - here, ends[there] - there), cap)
        mine = np.minimum(height[live], reach)
        todo = np.arange(len(live))
        while len(todo):
            todo = todo[mine[todo] < reach[todo]]
            todo = todo[data[here[todo] + mine[todo]] == data[there[todo] + mine[todo]]]
            mine[todo] += 1
        shared[here] = mine
        height[live] = mine
    return shared


def shard_windows(data: np.ndarray, ends: np.ndarray, is_window: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows' positions in sorted order, and the number of the distinct window that each is.

    The suffixes are refined while the depth fits into a window. The first and the last run of that many bytes of a window
    cover it, so their ranks sort the windows and tell them apart. Shorter windows are sorted by their bytes.
    """
    if window < FIRST_DEPTH:
        positions = np.flatnonzero(is_window)
        number = np.unique(_window_bytes(data, positions, window), return_inverse=True)[1] if len(positions) else positions
        order = np.argsort(number, kind="stable")
        return positions[order], number[order]
    depth = FIRST_DEPTH
    while 2 * depth <= window:
        depth *= 2
    _, rank = suffix_order(data, ends, depth)
    positions = np.flatnonzero(is_window)
    pair = rank[positions].astype(_U) << _U(32) | rank[positions + (window - depth)].astype(_U)
    order = np.argsort(pair)
    pair = pair[order]
    fresh = np.zeros(len(pair), bool)
    fresh[1:] = pair[1:] != pair[:-1]
    return positions[order], np.cumsum(fresh)


def _window_bytes(data: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(data, window)[at].copy().view(f"S{window}").ravel()


def smallest_holders(data: np.ndarray, offsets: np.ndarray, counts: np.ndarray, holders: np.ndarray, window: int, shard_bytes: int) -> np.ndarray:
    """For every window of every context the smallest holder of that window, in order of contexts.

    Context i is data[offsets[i] : offsets[i + 1]]; its first counts[i] positions are windows. Contexts are cut into shards
    with a suffix array each; shards are merged by looking up their sorted windows in those before by binary search.
    """
    out = np.empty(int(counts.sum()), np.int64)
    result_at = np.cumsum(counts) - counts
    runs: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    first = 0
    while first < len(counts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + shard_bytes, side="right")) - 1)
        part = data[offsets[first] : offsets[last]]
        local = offsets[first : last + 1] - offsets[first]
        sizes = np.diff(local)
        ends = np.repeat(local[1:], sizes)
        of = np.repeat(np.arange(last - first), sizes)
        place = np.arange(len(part)) - local[of]
        positions, number = shard_windows(part, ends, place < counts[first:last][of], window)
        mine = holders[first:last][of[positions]]
        starts = arrays.group_starts(number)
        least = np.minimum.reduceat(mine, starts) if len(starts) else mine
        target = result_at[first:last][of[positions]] + place[positions]
        whole = first == 0 and last == len(counts)
        runs.append((least, number, target, np.zeros(0) if whole else _window_bytes(part, positions[starts], window)))
        first = last
    for i, (_, _, _, keys) in enumerate(runs):  # sorted lists of distinct windows, merged pair by pair
        for j in range(i):
            other = runs[j][3]
            if not len(other) or not len(keys):
                continue
            place = np.minimum(np.searchsorted(other, keys), len(other) - 1)
            same = np.flatnonzero(other[place] == keys)
            both = np.minimum(runs[i][0][same], runs[j][0][place[same]])
            runs[i][0][same] = both
            runs[j][0][place[same]] = both
    for i, (least, _, _, keys) in enumerate(runs):  # what later lists have told earlier ones goes to all of them
        for j in range(len(runs)):
            other = runs[j][3]
            if i != j and len(other) and len(keys):
                place = np.minimum(np.searchsorted(other, keys), len(other) - 1)
                same = np.flatnonzero(other[place] == keys)
                least[same] = np.minimum(least[same], runs[j][0][place[same]])
    for least, number, target, _ in runs:
        out[target] = least[number]
    return out


# Blocks of documents


class _Block:
    """The texts of a block in a fixed order, as one run of bytes."""

    def __init__(self, table: pa.Table) -> None:
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.doc_id = table.column("doc_id").to_numpy()
        texts = table.column("text").cast(pa.large_string()).combine_chunks()
        texts = texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts
        self.offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        self.data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[self.offsets[0] : self.offsets[-1]]
        self.offsets = self.offsets - self.offsets[0]
        self.raw = memoryview(self.data)

    def text(self, i: int) -> memoryview:
        return self.raw[self.offsets[i] : self.offsets[i + 1]]

    def digests(self) -> np.ndarray:
        return np.frombuffer(b"".join(hashlib.blake2b(self.text(i), digest_size=16).digest() for i in range(len(self.doc_id))), "S16")

    def grams(self, first: int, last: int, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Offsets of texts first … last - 1 from the first one, their bytes, gram hashes (the last bit is free), anchors."""
        offsets = self.offsets[first : last + 1] - self.offsets[first]
        data = self.data[self.offsets[first] : self.offsets[last]]
        hashes = arrays.gram_hashes(data, anchor) | _U(1)
        across = np.zeros(len(data) + 1, np.int32)  # grams that begin in the last bytes of a text
        sizes = np.diff(offsets)
        np.add.at(across, np.maximum(offsets[1:] - anchor + 1, offsets[:-1]), 1)
        np.add.at(across, offsets[1:], -1)
        crossing = np.cumsum(across)[: len(hashes)] > 0
        hashes[crossing] = np.iinfo(np.uint64).max
        at = arrays.anchors(hashes, window - anchor + 1)
        text_of = np.searchsorted(offsets, at, side="right") - 1
        at = at[(hashes[at] != np.iinfo(np.uint64).max) & (sizes[text_of] >= window)]
        return offsets, data, hashes, at

    def parts(self) -> Iterator[tuple[int, int]]:
        first = 0
        while first < len(self.doc_id):
            last = max(first + 1, int(np.searchsorted(self.offsets, self.offsets[first] + arrays.SLICE_BYTES, side="right")) - 1)
            yield first, last
            first = last


def _key(hashes: np.ndarray) -> np.ndarray:
    """What travels of an anchor's hash; with its bucket that tells many more anchors apart than there are."""
    return hashes >> _U(8 * (8 - _KEY_BYTES)) << _U(8 * (8 - _KEY_BYTES))


def _pack(keys: np.ndarray) -> bytes:
    return keys.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :_KEY_BYTES].tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // _KEY_BYTES, 8), np.uint8)
    wide[:, :_KEY_BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, _KEY_BYTES)
    return wide.view(">u8").ravel().astype(_U)


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """From the low bits of the hash, which do not travel."""
    return ((hashes >> _U(1)) & _U(0x7FFF)).astype(np.int64) * 32749 % buckets if buckets <= 0x8000 else (arrays.mix(hashes) % _U(buckets)).astype(np.int64)


def _by_bucket(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(bucket, kind="stable")
    begins = arrays.group_starts(bucket[order])
    return order, begins, np.append(begins[1:], len(order))


def _send_anchors(window: int, anchor: int, buckets: int) -> Callable:
    def run(key: tuple, table: pa.Table) -> pa.Table:
        number, block, rows = key[0].as_py(), _Block(table), []
        found = [np.zeros(0, _U)]
        for first, last in block.parts():
            _, _, hashes, at = block.grams(first, last, window, anchor)
            found.append(hashes[at])
        hashes = np.unique(np.concatenate(found))
        bucket = _bucket(hashes, buckets)
        order, begins, ends = _by_bucket(bucket)
        for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
            rows.append((int(bucket[order[a]]), number, _ANCHORS, _pack(hashes[order[a:b]])))
        digests = block.digests()
        bucket = (digests.view(np.uint8).reshape(-1, 16)[:, :4].copy().view("<u4").ravel() % buckets).astype(np.int64) if len(digests) else np.zeros(0, np.int64)
        order, begins, ends = _by_bucket(bucket)
        for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
            own = order[a:b]
            rows.append((int(bucket[own[0]]), number, _COPIES, digests[own].tobytes(), block.doc_id[own].astype("<i8").tobytes()))
        return _messages(rows)

    return run


def _answer_blocks(hot_blocks: int) -> Callable:
    """Per bucket: anchors that several blocks have, and the smallest doc_id of each text of which there are several."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        bucket, rows = key[0].as_py(), []
        messages = table.to_pylist()
        known = [(m["block"], _unpack(m["first"])) for m in messages if m["kind"] == _ANCHORS]
        if known:
            keys = np.concatenate([k for _, k in known])
            order = np.argsort(keys)
            begins = arrays.group_starts(keys[order])
            sizes = np.diff(begins, append=len(keys))
            counts = np.empty(len(keys), np.int32)
            counts[order] = np.repeat(sizes.astype(np.int32), sizes)
            at = 0
            for block, own in known:
                mine = counts[at : at + len(own)]
                at += len(own)
                warm = mine >= max(2, hot_blocks)
                if (mine > 1).any():
                    rows.append((bucket, block, _ANCHORS, _pack(own[(mine > 1) & ~warm])))
                    if warm.any():
                        rows.append((bucket, block, _HOT, _pack(own[warm])))
        texts = [(m["block"], np.frombuffer(m["first"], "V16"), np.frombuffer(m["second"], "<i8")) for m in messages if m["kind"] == _COPIES]
        if texts:
            digests = np.concatenate([t[1] for t in texts]).view("<u8").reshape(-1, 2)
            ids = np.concatenate([t[2] for t in texts])
            order = np.lexsort((ids, digests[:, 1], digests[:, 0]))
            ordered = digests[order]
            new = np.ones(len(order), bool)
            new[1:] = (ordered[1:] != ordered[:-1]).any(axis=1)
            least = np.empty(len(order), np.int64)
            least[order] = ids[order][np.flatnonzero(new)][np.cumsum(new) - 1]
            copy, at = ids > least, 0
            for block, own, doc_ids in texts:
                mine = copy[at : at + len(own)]
                if mine.any():
                    rows.append((bucket, block, _COPIES, own[mine].tobytes(), doc_ids[mine].tobytes()))
                at += len(own)
        return _messages(rows)

    return run


def _copies(block: _Block, answers: list[dict]) -> np.ndarray:
    """Which texts of the block a smaller doc_id has too."""
    told = {(m["first"][16 * i : 16 * i + 16], d) for m in answers if m["kind"] == _COPIES for i, d in enumerate(np.frombuffer(m["second"], "<i8").tolist())}
    if not told:
        return np.zeros(len(block.doc_id), bool)
    digests = block.digests().tobytes()
    return np.array([(digests[16 * i : 16 * i + 16], d) in told for i, d in enumerate(block.doc_id.tolist())], bool)


def _told(answers: list[dict], kind: int, distinct: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Which of the sorted anchors the answers of the kind name, each by its bucket and its key."""
    flags, sent = np.zeros(len(distinct), bool), [(m["bucket"], _unpack(m["first"])) for m in answers if m["kind"] == kind]
    if not sent:
        return flags
    known, keys = _key(distinct), np.concatenate([k for _, k in sent])
    of = np.repeat([b for b, _ in sent], [len(k) for _, k in sent])
    place = np.searchsorted(known, keys)
    while len(place):  # again only for keys that several buckets have
        there = place < len(known)
        there[there] = known[place[there]] == keys[there]
        place, keys, of = place[there], keys[there], of[there]
        same = bucket[place] == of
        flags[place[same]] = True
        place, keys, of = place[~same] + 1, keys[~same], of[~same]
    return flags


def _send_contexts(window: int, anchor: int, buckets: int) -> Callable:
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _messages([])
        number, block, answers = key[0].as_py(), _Block(left), right.to_pylist()
        copies = _copies(block, answers)
        rows: list[tuple] = []
        if copies.any():
            rows.append((-1 - number, number, _COPIES, np.flatnonzero(copies).astype("<u4").tobytes()))
        parts = [(first, last, *block.grams(first, last, window, anchor)) for first, last in block.parts()]
        # An anchor also matters if two documents of this block have it.
        own = np.concatenate([np.zeros(0, _U), *(hashes[at] for _, _, _, _, hashes, at in parts)])
        of = np.concatenate([np.zeros(0, np.int64), *(first + np.searchsorted(offsets, at, side="right") - 1 for first, _, offsets, _, _, at in parts)])
        order = np.argsort(own, kind="stable")
        begins = arrays.group_starts(own[order])
        several = np.minimum.reduceat(of[order], begins) != np.maximum.reduceat(of[order], begins) if len(begins) else np.zeros(0, bool)
        distinct = own[order][begins] if len(begins) else own
        bucket = _bucket(distinct, buckets)
        shared, hot = several | _told(answers, _ANCHORS, distinct, bucket), _told(answers, _HOT, distinct, bucket)
        shared |= hot
        sent: list[tuple[np.ndarray, ...]] = []
        for first, _, offsets, data, hashes, at in parts:
            place = np.searchsorted(distinct, hashes[at])
            marked = hashes & ~_U(1)  # the free bit now tells whether the anchor matters
            marked[at] |= shared[place].astype(_U)
            least = arrays.sliding(marked, window - anchor + 1, np.minimum)
            wanted = (least & _U(1)).astype(bool)
            text_of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(least)]
            wanted &= (np.arange(len(least)) + window <= offsets[1:][text_of]) & ~copies[first + text_of]
            if not wanted.any():
                continue
            edge = np.ones(len(least), bool)
            edge[1:] = (least[1:] != least[:-1]) | ~wanted[:-1]
            edge |= np.isin(np.arange(len(least)), offsets)
            burning = least | _U(1)
            if hot.any():
                burning_at = np.isin(burning, distinct[hot])
                edge |= burning_at
            begin = np.flatnonzero(edge & wanted)
            stop = np.flatnonzero(wanted & np.append(edge[1:] | ~wanted[1:], True)) + 1
            keys = burning[begin]
            if hot.any():
                alone = np.flatnonzero(burning_at[begin])
                keys[alone] = arrays.run_hashes(arrays._BYTE_CODES[data], window)[begin[alone]] | _U(1)
            texts = text_of[begin]
            base = block.offsets[first]
            sent.append((keys, begin + base, stop - begin, block.doc_id[first + texts]))
        if sent:
            keys, begin, count, doc_id = (np.concatenate([s[i] for s in sent]) for i in range(4))
            bucket = _bucket(keys, buckets)
            order, starts, ends = _by_bucket(bucket)
            for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                mine = order[a:b]
                body = block.data[arrays.ranges(begin[mine], count[mine] + window - 1)].tobytes()
                rows.append((int(bucket[mine[0]]), number, _CONTEXTS, begin[mine].astype("<u4").tobytes(), count[mine].astype("<u4").tobytes(), doc_id[mine].astype("<i8").tobytes(), body))
        return _messages(rows)

    return run


def _judge_contexts(window: int, shard_bytes: int) -> Callable:
    """Per bucket: which windows a smaller document has."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        messages = table.to_pylist()
        rows = [(m["bucket"], m["block"], _COPIES, m["first"]) for m in messages if m["kind"] == _COPIES]
        sent = [m for m in messages if m["kind"] == _CONTEXTS]
        if not sent:
            return _messages(rows)
        begin, count, doc_id = (np.concatenate([np.frombuffer(m[c], t) for m in sent]).astype(np.int64) for c, t in (("first", "<u4"), ("second", "<u4"), ("third", "<i8")))
        block = np.repeat([m["block"] for m in sent], [len(m["first"]) // 4 for m in sent])
        data = np.frombuffer(b"".join(m["fourth"] for m in sent), np.uint8)
        del messages, sent
        offsets = np.concatenate([[0], np.cumsum(count + window - 1)])
        # Equal contexts are looked at once, with the smallest doc_id that has them.
        low, high = _context_hashes(data, offsets)
        order = np.lexsort((doc_id, high, low))
        new = np.ones(len(order), bool)
        new[1:] = (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1])
        kind = np.empty(len(order), np.int64)
        kind[order] = np.cumsum(new) - 1
        chosen = order[new]
        sizes = count[chosen]
        own = data[arrays.ranges(offsets[chosen], sizes + window - 1)]
        least = smallest_holders(own, np.concatenate([[0], np.cumsum(sizes + window - 1)]), sizes, doc_id[chosen], window, shard_bytes)
        at = np.cumsum(sizes) - sizes
        smallest = least[arrays.ranges(at[kind], count)]
        gone = smallest < np.repeat(doc_id, count)
        position = arrays.ranges(begin, count)[gone]
        owner = np.repeat(block, count)[gone]
        if len(position):
            order = np.lexsort((position, owner))
            position, owner = position[order], owner[order]
            edge = np.ones(len(position), bool)
            edge[1:] = (position[1:] != position[:-1] + 1) | (owner[1:] != owner[:-1])
            first = np.flatnonzero(edge)
            length = np.diff(np.append(first, len(position)))
            start, owner = position[first], owner[first]
            cut = arrays.group_starts(owner)
            for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(owner)], strict=True):
                rows.append((key[0].as_py(), int(owner[a]), _REMOVED, start[a:b].astype("<u4").tobytes(), length[a:b].astype("<u4").tobytes()))
        return _messages(rows)

    return run


def _context_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each context, in slices so that work arrays stay small."""
    codes, found, first = arrays._BYTE_CODES, [], 0
    while first < len(offsets) - 1:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + arrays.SLICE_BYTES, side="right")) - 1)
        values, local = codes[data[offsets[first] : offsets[last]]], offsets[first : last + 1] - offsets[first]
        found.append([arrays.mix(arrays.span_hash(arrays.polynomial(values, base), base, local[:-1], local[1:]) + np.diff(local).astype(_U)) for base in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB)])
        first = last
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


_REPORT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cut(window: int) -> Callable:
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        if not left.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())], names=names)
        block, answers = _Block(left), right.to_pylist()
        sizes = np.diff(block.offsets)
        removed = [m for m in answers if m["kind"] == _REMOVED]
        start, length = (np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(m[c], "<u4").astype(np.int64) for m in removed)]) for c in ("first", "second"))
        gone = arrays.covered(len(block.data), start, length + window - 1)
        for m in answers:
            if m["kind"] == _COPIES:
                for i in np.frombuffer(m["first"], "<u4"):
                    if sizes[i] >= window:
                        gone[block.offsets[i] : block.offsets[i + 1]] = True
        sums = np.concatenate([[0], np.cumsum(gone)])
        n_removed = sums[block.offsets[1:]] - sums[block.offsets[:-1]]
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        inner = block.offsets[:-1][sizes > 0]
        begins[inner] = gone[inner]
        sums = np.concatenate([[0], np.cumsum(begins)])
        n_spans = sums[block.offsets[1:]] - sums[block.offsets[:-1]]
        shas = []
        for i in range(len(sizes)):
            a, b = block.offsets[i], block.offsets[i + 1]
            shas.append(hashlib.sha256(block.data[a:b][~gone[a:b]] if n_removed[i] else block.text(i)).hexdigest())
        ids = pa.array([None if d == NO_ID else d for d in block.doc_id.tolist()], pa.int64())
        return pa.table([ids, *(pa.array(x.astype(np.int64)) for x in (sizes, n_removed, n_spans)), pa.array(shas, pa.string())], names=names)

    return run


def remove_repeats(
    docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES, hot_blocks: int = HOT_BLOCKS
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256: bytes covered by a window of a smaller doc_id are removed."""
    spark = docs.sparkSession
    plain = plain_documents(docs).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = plain.select(F.sum(F.octet_length("text"))).first()[0] or 0
    n = partitions(spark)
    blocks = max(n, -(-total // block_bytes))
    buckets = max(n, total * 2 // (window - anchor + 2) // BUCKET_ANCHORS + 1)
    texts = plain.withColumn("block", F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(blocks)).cast("int")).repartition(n, "block")
    anchors = texts.groupBy("block").applyInArrow(_send_anchors(window, anchor, buckets), _MESSAGE)
    answers = anchors.groupBy("bucket").applyInArrow(_answer_blocks(hot_blocks), _MESSAGE)
    contexts = texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_send_contexts(window, anchor, buckets), _MESSAGE)
    judged = contexts.groupBy("bucket").applyInArrow(_judge_contexts(window, shard_bytes), _MESSAGE)
    return texts.groupBy("block").cogroup(judged.groupBy("block")).applyInArrow(_cut(window), _REPORT)
