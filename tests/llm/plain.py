"""Plain versions of the operators, for small tables: dictionaries of doc_id to text in, results out."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def covered(n, starts, width):
    hit = bytearray(n)
    for s in starts:
        hit[s : s + width] = b"\1" * width
    return hit


def shingles(text, k):
    words = WORD.findall(lower(text or ""))
    if len(words) < k:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def components(docs, k, top, bottom):
    """doc_id -> (size, smallest doc_id reachable) by comparing all pairs."""
    sets = {i: shingles(t, k) for i, t in docs.items()}
    label = {i: i for i in docs}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(docs)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and min(len(a), len(b)) * bottom >= top * max(len(a), len(b)):
                both = len(a & b)
                if bottom * both >= top * (len(a) + len(b) - both):
                    low, high = sorted((root(i), root(j)))
                    label[high] = low
    return {i: (len(sets[i]), root(i)) for i in ids}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def private_spans(text):
    """The base kinds, by whole-text patterns."""
    text, found = text or "", []

    def digits(s):
        return re.sub("[^0-9]", "", s)

    for rank, kind, pattern, good in (
        (0, "email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        (1, "ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        (2, "card", r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(digits(s)) <= 19 and luhn(digits(s))),
        (3, "phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(digits(s)) <= 15),
    ):
        found += [(m.start(), rank, kind, m.end()) for m in re.finditer(pattern, text) if good(m[0])]
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def quality_counts(text):
    text = text or ""
    words, seen, dup = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    many = collections.Counter(windows)
    repeated = covered(len(words), [i for i, w in enumerate(windows) if many[w] > 1], 8)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, sum(repeated)


def most_false_rejections(n, alpha, delta):
    """The most of n good documents that may be rejected so that the chance of so few, at a rate of alpha, is at most delta."""
    from fractions import Fraction

    rate, chance, k = Fraction(alpha).limit_denominator(10**6), Fraction(0), -1
    while True:
        term = math.comb(n, k + 1) * rate ** (k + 1) * (1 - rate) ** (n - k - 1)
        if chance + term > delta:
            return k
        chance, k = chance + term, k + 1


def cutoff(good, bad, alpha, delta, cutoffs):
    """Of cutoffs from the highest down to the first that fails, the one above which most bad values lie."""
    allowed, best = most_false_rejections(len(good), alpha, delta), (0, None)
    for c in sorted(cutoffs, reverse=True):
        if sum(v > c for v in good) > allowed:
            break
        best = max(best, (sum(v > c for v in bad), c), key=lambda x: x[0])
    return best[1]


def repeats(sequences, window):
    """id -> flags of the elements covered by a window that a smaller id has too."""
    first = {}
    for i in sorted(sequences):
        for at in range(len(sequences[i]) - window + 1):
            first.setdefault(tuple(sequences[i][at : at + window]), i)
    return {
        i: covered(len(s), [at for at in range(len(s) - window + 1) if first[tuple(s[at : at + window])] < i], window) for i, s in sequences.items()
    }


def without_repeated_words(docs, window=50):
    words = {i: WORD.findall(t or "") for i, t in docs.items()}
    return {i: (len(words[i]), sum(hit), sha(" ".join(w for w, h in zip(words[i], hit, strict=True) if not h))) for i, hit in repeats(words, window).items()}


def without_repeated_bytes(docs, window=50):
    raw, out = {i: (t or "").encode() for i, t in docs.items()}, {}
    for i, hit in repeats(raw, window).items():
        kept = bytes(b for b, h in zip(raw[i], hit, strict=True) if not h)
        spans = sum(1 for at, h in enumerate(hit) if h and (at == 0 or not hit[at - 1]))
        out[i] = (len(raw[i]), sum(hit), spans, hashlib.sha256(kept).hexdigest())
    return out


def contamination(docs, items, window=10):
    known = collections.defaultdict(set)
    for item, text in items:
        words = ITEM_WORD.findall(lower(text or ""))
        n = min(window, len(words))
        for at in range(len(words) - n + 1 if n else 0):
            known[tuple(words[at : at + n])].add(str(item))
    sizes, out = {len(w) for w in known}, {}
    for i, text in docs.items():
        words, hit, found = ITEM_WORD.findall(lower(text or "")), set(), set()
        for n in sizes:
            for at in range(len(words) - n + 1):
                if (key := tuple(words[at : at + n])) in known:
                    hit.update(range(at, at + n))
                    found |= known[key]
        out[i] = (len(words), len(hit), len(found), sha(",".join(sorted(found))), bool(hit))
    return out


def spellings(rows, least=5, factor=5):
    """word -> (form, root, n, n_near, form_n) by editing every word in every way; rows are (doc_id, text)."""
    counts = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            at = h % len(run)
            counts[run if h % 199 else run[:at] + run[at + 1 :]] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= least}
    holes = collections.defaultdict(set)
    for w in words:
        for at in range(len(w)):
            holes[w[:at] + w[at + 1 :]].add(w)
            holes[w[:at], w[at + 1 :]].add(w)
        holes[w].add(w)
    forms, out = {}, {}
    near_of = collections.defaultdict(set)
    for key, group in holes.items():
        for w in group if len(group) > 1 else ():
            for o in group:
                if o != w and (isinstance(key, tuple) or key in (w, o)):
                    near_of[w].add(o)
    for w, n in words.items():
        best = min(near_of[w], key=lambda o: (-words[o], o), default=None)
        forms[w] = best if best is not None and words[best] >= factor * n else None
    for w, n in words.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        out[w] = (forms[w], root, n, len(near_of[w]), words[forms[w]] if forms[w] else None)
    return out


def trie(rows):
    """(conv_id, depth) -> the other columns, by dictionaries of whole sequences; rows are (conv_id, turn, role, text)."""

    def name(role, text):
        return hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()

    told = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            told[conv].append((turn is not None, turn or 0, name(role or "", text or ""), role or "", text or ""))
    told = {c: [(r, t) for *_, r, t in sorted(x)] for c, x in told.items()}
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c in sorted(told):
        h = zlib.crc32(str(c).encode()) % 4
        path = tuple(told.get(c - c % 20, [])[:h] + told[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    children = collections.defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    leaves, saved, out = {}, {}, {}
    for path in sorted(members, key=len, reverse=True):
        own = (len(members[path]) - 1) * len(WORD.findall(path[-1][1])) if path else 0
        leaves[path] = sum(leaves[x] for x in children[path]) or 1
        saved[path] = own + sum(saved[x] for x in children[path])
    for path, all_ in members.items():
        above = members[path[:-1]][0] if path else None
        out[all_[0], len(path)] = (above, len(all_), len(children[path]), leaves[path], saved[path], sha(",".join(map(str, ends[path]))))
    return out
