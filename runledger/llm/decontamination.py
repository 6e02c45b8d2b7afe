"""Benchmark passages in documents, by a prefix-filtered set join.

A window of a benchmark item is WINDOW consecutive words (all words of a shorter item); its set is that of its shingles.
Shingles are ordered by how rare they are in the documents. A document holds a window only if it holds all of its
shingles, so the necessary prefix is the rarest one: only that is joined. Its place in the window fixes where the window
would have to begin; the length bound (the window must fit into the document) and the positional bound drop impossible
places; two independent hashes over the words of the place then decide. Windows up to BROADCAST_WINDOWS travel to the
tasks as sorted arrays; a larger benchmark is joined by shuffling shingles, with the same results.

Null and empty texts have no words, items without words no windows. A null item_id marks words but is not listed.
Repeated rows are judged one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runledger.llm import arrays
from runledger.llm.storage import plain_documents, stored

WINDOW, SHINGLE = 10, 3
#: At about 200 bytes a window this bounds what is sent to the tasks to 40 MB.
BROADCAST_WINDOWS = 200_000
_BASES = (0xA0761D6478BD642F, 0xE7037ED1A0B428DB)

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
_U = np.uint64


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of each word."""
    lowered = arrays.LOWER[data]
    start, end, text_of = arrays.word_bounds(lowered, offsets, _SEPARATOR)
    return arrays.word_hashes(lowered, start, end), text_of


def _run_keys(words: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the runs of words."""
    found = []
    for base in _BASES:
        sums = arrays.polynomial(words, base)
        found.append(arrays.mix(arrays.span_hash(sums, base, start, start + length) + length.astype(_U)))
    return found[0], found[1]


def _shingles(words: np.ndarray, text_of: np.ndarray, sizes: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Position and hash of each shingle, size by size."""
    for size in sizes:
        at = np.flatnonzero(arrays.same_text(text_of, size))
        yield at, arrays.run_hashes(words, size)[at]


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _benchmark_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, data, offsets in arrays.slices(batches):
        words, text_of = _words(data, offsets)
        counts = np.bincount(text_of, minlength=len(offsets) - 1)
        begins = np.cumsum(counts) - counts
        length = np.minimum(counts, WINDOW)
        per_item = np.where(counts > 0, counts - length + 1, 0)
        start, length = arrays.ranges(begins, per_item), np.repeat(length, per_item)
        key, check = _run_keys(words, start, length)
        item = part.column("item_id").take(pa.array(np.repeat(np.arange(len(counts)), per_item)))
        shingles = {size: arrays.run_hashes(words, size) for size in range(1, SHINGLE + 1)}
        size = np.minimum(length, SHINGLE)
        lists = [shingles[s][b : b + n - s + 1].view(np.int64).tolist() for s, b, n in zip(size.tolist(), start.tolist(), length.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [item, pa.array(length.astype(np.int32)), _signed(key), _signed(check), pa.array(lists, pa.list_(pa.int64()))],
            ["item_id", "n", "key", "check", "shingles"],
        )


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """One row per distinct window: its number of words, two hashes, shingles in order, and the items that have it."""
    plain = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    rows = plain.mapInArrow(_benchmark_windows, "item_id string, n int, key long, check long, shingles array<long>")
    return rows.groupBy("n", "key", "check").agg(F.first("shingles").alias("shingles"), F.collect_set("item_id").alias("items"))


@dataclass
class _Index:
    """Windows by their rarest shingle."""

    rarest: np.ndarray  # sorted
    first: np.ndarray  # first window of each rarest shingle; the next one's first ends it
    offset: np.ndarray  # words between a window's beginning and its rarest shingle
    length: np.ndarray
    key: np.ndarray
    check: np.ndarray
    items: list[list[str]]
    sizes: tuple[int, ...]


class _Lookup:
    """Where hashes stand in a sorted array; most are ruled out by a table of leading bits."""

    def __init__(self, known: np.ndarray) -> None:
        self.known, self.seen = known, np.zeros(1 << 20, bool)
        self.seen[(known >> _U(44)).astype(np.int64)] = True

    def __call__(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in hashes that are known, and their places among the known ones."""
        if not len(self.known):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.seen[(hashes >> _U(44)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.known, hashes[at]), len(self.known) - 1)
        good = self.known[place] == hashes[at]
        return at[good], place[good]


def _count_shingles(known: np.ndarray, sizes: tuple[int, ...]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, counts = _Lookup(known), np.zeros(len(known), np.int64)
        for _, data, offsets in arrays.slices(batches):
            words, text_of = _words(data, offsets)
            for _, hashes in _shingles(words, text_of, sizes):
                counts += np.bincount(lookup(hashes)[1], minlength=len(known))
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], ["place", "n"])

    return run


def _index(docs: DataFrame, windows: DataFrame) -> _Index:
    """Orders the shingles of the benchmark by their counts in all documents. Only for a benchmark of checked size."""
    rows = windows.collect()
    sizes = tuple(sorted({min(r.n, SHINGLE) for r in rows}))
    known = np.unique(np.array([s for r in rows for s in r.shingles], np.int64).view(_U))
    counts = np.zeros(len(known), np.int64)
    if rows:
        for r in docs.mapInArrow(_count_shingles(known, sizes), "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).collect():
            counts[r.place] = r.n
    chosen = []
    for r in rows:
        hashes = np.array(r.shingles, np.int64).view(_U)
        order = np.lexsort((hashes, counts[np.searchsorted(known, hashes)]))
        chosen.append((hashes[order[0]], int(order[0]), r))
    chosen.sort(key=lambda x: (x[0], x[2].key, x[2].check))
    rarest = np.array([h for h, _, _ in chosen], _U)
    first = arrays.group_starts(rarest)
    return _Index(
        rarest[first],
        np.append(first, len(chosen)),
        np.array([o for _, o, _ in chosen], np.int64),
        np.array([r.n for _, _, r in chosen], np.int64),
        np.array([r.key for _, _, r in chosen], np.int64).view(_U),
        np.array([r.check for _, _, r in chosen], np.int64).view(_U),
        [sorted(r["items"]) for _, _, r in chosen],
        sizes,
    )


def _hits(words: np.ndarray, text_of: np.ndarray, n_texts: int, start: np.ndarray, of: np.ndarray, text: np.ndarray, length: np.ndarray, key: np.ndarray, check: np.ndarray):
    """Of candidate places (first word, window, text) those that fit into their text and hold their window."""
    begins = np.searchsorted(text_of, np.arange(n_texts + 1))
    good = (start >= begins[text]) & (start + length[of] <= begins[text + 1])
    start, of, text = start[good], of[good], text[good]
    first, second = _run_keys(words, start, length[of])
    good = (first == key[of]) & (second == check[of])
    return start[good], of[good], text[good]


def _report(part: pa.RecordBatch, words: np.ndarray, text_of: np.ndarray, start: np.ndarray, of: np.ndarray, text: np.ndarray, length: np.ndarray, items: list[list[str]]) -> pa.RecordBatch:
    n = part.num_rows
    hit = arrays.covered(len(words), start, length[of])
    found: list[set[str]] = [set() for _ in range(n)]
    for t, w in set(zip(text.tolist(), of.tolist(), strict=True)):
        found[t].update(items[w])
    n_hit = np.bincount(text_of[hit], minlength=n)
    carried = [c for c in part.schema.names if c not in ("text", "found")]
    return pa.RecordBatch.from_arrays(
        [
            *(part.column(c) for c in carried),
            pa.array(np.bincount(text_of, minlength=n).astype(np.int64)),
            pa.array(n_hit.astype(np.int64)),
            pa.array([len(x) for x in found], pa.int64()),
            pa.array([hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in found], pa.string()),
            pa.array(n_hit > 0),
        ],
        [*carried, "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    )


_REPORT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _reported(docs: DataFrame) -> T.StructType:
    """The columns of docs but the text, and what is said of each row."""
    return T.StructType([*docs.drop("text").schema.fields, *T.StructType.fromDDL(_REPORT).fields])


def _scan(index: _Index) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = _Lookup(index.rarest)
        for part, data, offsets in arrays.slices(batches):
            words, text_of = _words(data, offsets)
            starts, windows, texts = [], [], []
            for at, hashes in _shingles(words, text_of, index.sizes):
                hit, place = lookup(hashes)
                many = index.first[place + 1] - index.first[place]
                of = arrays.ranges(index.first[place], many)
                starts.append(np.repeat(at[hit], many) - index.offset[of]), windows.append(of), texts.append(text_of[np.repeat(at[hit], many)])
            none = np.zeros(0, np.int64)
            start, of, text = (np.concatenate([none, *x]) for x in (starts, windows, texts))
            start, of, text = _hits(words, text_of, part.num_rows, start, of, text, index.length, index.key, index.check)
            yield _report(part, words, text_of, start, of, text, index.length, index.items)

    return run


def _shuffled(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """The same join for a benchmark of any size: shingles are counted, ordered and joined by key."""

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in arrays.slices(batches):
            words, text_of = _words(data, offsets)
            begins = np.searchsorted(text_of, np.arange(len(offsets)))
            for at, hashes in _shingles(words, text_of, tuple(range(1, SHINGLE + 1))):
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(text_of[at])), pa.array((at - begins[text_of[at]]).astype(np.int64)), _signed(hashes)], ["doc_id", "at", "shingle"]
                )

    places = docs.select("doc_id", "text").mapInArrow(shingles, "doc_id long, at long, shingle long")
    needed = windows.select("n", "key", "check", F.posexplode("shingles").alias("offset", "shingle"))
    counts = places.join(needed.select("shingle").distinct(), "shingle", "left_semi").groupBy("shingle").count()
    rarest = (
        needed.join(counts, "shingle", "left")
        .groupBy("n", "key", "check")
        .agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "shingle", "offset")).alias("x"))
        .select("n", "key", "check", "x.shingle", "x.offset")
        .join(windows.select("n", "key", "check", "items"), ["n", "key", "check"])
    )
    candidates = (
        places.join(rarest, "shingle")
        .where(F.col("at") >= F.col("offset"))
        .select("doc_id", F.struct((F.col("at") - F.col("offset")).alias("start"), F.col("n").cast("long").alias("n"), "key", "check", "items").alias("x"))
        .groupBy("doc_id")
        .agg(F.collect_set("x").alias("found"))
    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in arrays.slices(batches):
            words, text_of = _words(data, offsets)
            begins = np.searchsorted(text_of, np.arange(len(offsets)))
            rows = [(begins[t] + x["start"], t, x) for t, found in enumerate(part.column("found").to_pylist()) for x in found or []]
            start, text = (np.array([r[i] for r in rows], np.int64) for i in (0, 1))
            length = np.array([x["n"] for _, _, x in rows], np.int64)
            key, check = (np.array([x[k] for _, _, x in rows], np.int64).view(_U) for k in ("key", "check"))
            found = _hits(words, text_of, part.num_rows, start, np.arange(len(rows)), text, length, key, check)
            yield _report(part, words, text_of, *found, length, [x["items"] for _, _, x in rows])

    joined = docs.alias("d").join(candidates.alias("c"), F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")), "left").select("d.*", "c.found")
    return joined.mapInArrow(verify, _reported(docs))


def _judged(docs: DataFrame, benchmark: DataFrame, broadcast_windows: int) -> DataFrame:
    """What is said of each row of doc_id, text and other columns, beside these."""
    windows = stored(benchmark_windows(benchmark))
    if windows.count() > broadcast_windows:
        return _shuffled(docs, windows)
    return docs.mapInArrow(_scan(_index(docs.select("doc_id", "text"), windows)), _reported(docs))


def contamination(docs: DataFrame, benchmark: DataFrame, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """Per document: n_words, n_hit (words inside a benchmark window), n_items, items_sha256 and contaminated."""
    return _judged(plain_documents(docs), benchmark, broadcast_windows)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """The rows that hold no window of the benchmark, with their columns. Each row goes by its own text."""
    inputs = [F.col(f"`{c}`").alias(f"in_{i}") for i, c in enumerate(docs.columns)]
    carried = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *inputs)
    found = _judged(carried, benchmark, broadcast_windows).where(~F.col("contaminated"))
    return found.select(*(F.col(f"in_{i}").alias(c) for i, c in enumerate(docs.columns)))
