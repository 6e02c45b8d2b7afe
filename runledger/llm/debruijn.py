"""Repeated passages of words, by compaction of a De Bruijn graph.

Edges are runs of WINDOW words that occur in two documents or more. To find them without shuffling every run, each run
is represented by its anchor, the run of ANCHOR words in it with the smallest hash: equal runs have equal anchors, so a
run whose anchor occurs in one document only cannot repeat. The remaining runs are grouped by hash; an edge keeps its
source coordinates (the smallest doc_id that has it, and where) and its neighbours, of which 32 bits of the hash travel.
Where an edge has one follower, which has it as its only predecessor, and both are neighbours in the source, a Spark join
links them, and linked edges compact into one path. Each document's stretches along a path become spans, and the words of every span are compared with those
at its source coordinates before they are removed.

Documents with equal words are treated as one: the smallest doc_id stands for them, the others are removed whole if they
have WINDOW words. Null and empty texts have no words. A null doc_id counts as larger than any other. Rows with the same
doc_id never remove each other's words. Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from runledger.llm import arrays
from runledger.llm.storage import plain_documents, stored, with_least

WINDOW, ANCHOR = 50, 16
#: Stands for a null doc_id inside the operator.
NO_ID = (1 << 63) - 1
_NONE = hashlib.sha256(b"").hexdigest()


def _texts(docs: DataFrame) -> DataFrame:
    return plain_documents(docs).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("digest", F.xxhash64("text"))


def _lists(values: np.ndarray, of: np.ndarray, n: int) -> pa.Array:
    """One list per text; of is sorted."""
    at = np.searchsorted(of, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(values))


class _Runs:
    """Hashes of the anchors and windows of a slice of texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, window: int, anchor: int) -> None:
        start, end, self.text_of = arrays.word_bounds(data, offsets)
        self.n_words = np.bincount(self.text_of, minlength=len(offsets) - 1)
        self.words = arrays.word_hashes(data, start, end)
        self.width = window - anchor + 1
        self.grams = arrays.run_hashes(self.words, anchor)
        self.inside = arrays.same_text(self.text_of, anchor)
        self.grams[~self.inside] = np.iinfo(np.uint64).max
        self.whole = arrays.same_text(self.text_of, window)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Hash and text of the anchors of texts that have a window; each once per text."""
        at = arrays.anchors(self.grams, self.width)
        at = at[self.inside[at]]
        of, found = self.text_of[at], self.grams[at]
        order = np.lexsort((found, of))
        of, found = of[order], found[order]
        new = np.ones(len(of), bool)
        new[1:] = (of[1:] != of[:-1]) | (found[1:] != found[:-1])
        return found[new], of[new]

    def least(self) -> np.ndarray:
        """The anchor of each window."""
        return arrays.sliding(self.grams, self.width, np.minimum)


def _describe(window: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in arrays.slices(batches):
            runs, raw = _Runs(data, offsets, window, anchor), data.tobytes()
            found, of = runs.anchors()
            long_enough = runs.n_words[of] >= window
            shas = [hashlib.sha256(b" ".join(raw[a:b].split())).hexdigest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            columns = [part.column("doc_id"), part.column("digest"), pa.array(runs.n_words.astype(np.int64)), pa.array(shas, pa.string())]
            columns.append(_lists(found[long_enough].view(np.int64), of[long_enough], part.num_rows))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "digest", "n_words", "sha", "anchors"])

    return run


def _pack(window: int):
    """Compressed texts; those with too few bytes for a window have none and are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for part, data, offsets in arrays.slices(batches):
            raw, enough = data.tobytes(), np.diff(offsets) >= 2 * window - 1
            packed = [pack.compress(raw[a:b]) if e else None for a, b, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), enough.tolist(), strict=True)]
            rows = pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("digest"), pa.array(packed, pa.binary())], ["doc_id", "digest", "packed"])
            yield rows.filter(pa.array(enough))

    return run


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches with their texts, in parts of about a slice."""
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        texts, size, begin = [], 0, 0
        for i, packed in enumerate(batch.column("packed")):
            texts.append(unpack.decompress(packed.as_py()))
            size += len(texts[-1])
            if size >= arrays.SLICE_BYTES or i + 1 == batch.num_rows:
                column = pa.array(texts, pa.large_binary()).view(pa.large_string())
                yield batch.slice(begin, len(texts)).append_column("text", column)
                texts, size, begin = [], 0, i + 1


def _edges(window: int, anchor: int):
    """Runs whose anchor repeats, with the neighbours that do so too, and the words they come from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in arrays.slices(_unpacked(batches)):
            runs, n = _Runs(data, offsets, window, anchor), part.num_rows
            known = np.unique(part.column("repeated").flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            hashes, least = arrays.run_hashes(runs.words, window), runs.least()
            place = np.minimum(np.searchsorted(known, least), max(len(known) - 1, 0))
            at = np.flatnonzero(runs.whole & (known[place] == least)) if len(known) and len(least) else np.zeros(0, np.int64)
            of = runs.text_of[at]
            first_word = np.searchsorted(runs.text_of, np.arange(n))
            has = np.bincount(of, minlength=n) > 0
            rows = pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("digest"), part.column("packed"), _lists((at - first_word[of]).astype(np.int32), of, n), _lists(hashes[at].view(np.int64), of, n)],
                ["doc_id", "digest", "packed", "at", "edges"],
            )
            yield rows.filter(pa.array(has))

    return run


def _words_of(packed: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(packed).split()


def _span_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hash of the words of each wanted span."""
    for batch in batches:
        ids, digests, starts, lengths, shas = [], [], [], [], []
        for doc_id, digest, packed, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "digest", "packed", "spans")), strict=True):
            words = _words_of(packed)
            for s in spans:
                start, length = s["source_start"], s["length"]
                ids.append(doc_id), digests.append(digest), starts.append(start), lengths.append(length)
                shas.append(hashlib.sha256(b" ".join(words[start : start + length])).digest())
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(digests, pa.int64()), pa.array(starts, pa.int32()), pa.array(lengths, pa.int32()), pa.array(shas, pa.binary())],
            ["source_id", "source_digest", "source_start", "length", "source_sha"],
        )


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drops the words of the spans that equal their source."""
    for batch in batches:
        removed, shas = [], []
        for packed, spans in zip(batch.column("packed").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            words = _words_of(packed)
            gone = np.zeros(len(words), bool)
            for s in spans:
                end = s["start"] + s["length"]
                if hashlib.sha256(b" ".join(words[s["start"] : end])).digest() == s["source_sha"]:
                    gone[s["start"] : end] = True
            removed.append(int(gone.sum()))
            shas.append(hashlib.sha256(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), pa.array(removed, pa.int64()), pa.array(shas, pa.string())], ["doc_id", "digest", "n_removed", "kept_sha256"])


def _representatives(described: DataFrame, window: int) -> DataFrame:
    """One row for each sequence of words: that of the smallest doc_id."""
    long_enough = described.where(F.col("n_words") >= window)
    return with_least(long_enough, ["sha"], "doc_id", "first_id").withColumn("copy", F.col("doc_id") > F.col("first_id"))


def _short(edge: Column) -> Column:
    """32 bits of an edge's hash."""
    return edge.bitwiseAND(F.lit((1 << 32) - 1))


def _sides(before: Column, after: Column, none: int) -> Column:
    """Both neighbours in one number; none stands for one that does not repeat."""
    side = lambda c: F.coalesce(_short(c), F.lit(none).cast("long"))
    return F.shiftleft(side(before), 32).bitwiseOR(side(after))


def _graph(places: DataFrame) -> DataFrame:
    """Distinct edges of two documents or more with source coordinates and their only neighbours, if they are so."""
    # Places agree on a neighbour where the bits that all have are those that any has; a missing one changes neither.
    met = places.groupBy("edge").agg(
        F.min(F.struct("doc_id", "at", "digest")).alias("source"),
        F.max("doc_id").alias("last_id"),
        F.bit_and(_sides(F.col("before"), F.col("after"), (1 << 32) - 1)).alias("all"),
        F.bit_or(_sides(F.col("before"), F.col("after"), 0)).alias("any"),
    )
    before = lambda c: F.shiftrightunsigned(c, 32)
    return met.where(F.col("source.doc_id") < F.col("last_id")).select(
        "edge",
        F.col("source.doc_id").alias("source_id"),
        F.col("source.at").alias("source_at"),
        F.col("source.digest").alias("source_digest"),
        F.when(before("all") == before("any"), before("all")).alias("before"),
        F.when(_short(F.col("all")) == _short(F.col("any")), _short(F.col("all"))).alias("after"),
    )


def compact(edges: DataFrame) -> DataFrame:
    """Adds the path of each edge: the place in the source where its chain of only neighbours begins."""
    source = ["source_id", "source_digest", "source_at"]
    previous = edges.select("source_id", "source_digest", (F.col("source_at") + 1).alias("source_at"), F.col("edge").alias("p_edge"), F.col("after").alias("p_after"))
    linked = F.coalesce((F.col("p_after") == _short(F.col("edge"))) & (F.col("before") == _short(F.col("p_edge"))), F.lit(False))
    in_source = Window.partitionBy("source_id", "source_digest").orderBy("source_at")
    head = F.when(~linked, F.col("source_at"))
    met = edges.join(previous, source, "left").withColumn("path", F.last(head, ignorenulls=True).over(in_source))
    return met.select("edge", "source_id", "source_digest", "source_at", "path")


def _spans(places: DataFrame, edges: DataFrame, window: int) -> DataFrame:
    """Stretches along one path that a document shares with a smaller one."""
    met = places.select("edge", "doc_id", "digest", "at").join(edges, "edge").where(F.col("source_id") < F.col("doc_id"))
    met = met.withColumn("shift", F.col("at") - F.col("source_at"))
    along = ["doc_id", "digest", "source_id", "source_digest", "path", "shift"]
    # Places that follow each other differ from their rank by the same number.
    ranked = met.withColumn("stretch", F.col("at") - F.dense_rank().over(Window.partitionBy(*along).orderBy("at")))
    runs = ranked.groupBy(*along, "stretch").agg(F.min("at").alias("start"), (F.max("at") - F.min("at") + window).cast("int").alias("length"))
    return runs.select("doc_id", "digest", "source_id", "source_digest", "start", (F.col("start") - F.col("shift")).alias("source_start"), "length")


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and n_spans: words covered by a window of a smaller doc_id are removed."""
    texts = _texts(docs)
    described = stored(texts.mapInArrow(_describe(window, anchor), "doc_id long, digest long, n_words long, sha string, anchors array<long>"))
    known = _representatives(described, window)
    listed = known.where(~F.col("copy")).dropDuplicates(["doc_id", "digest"]).select("doc_id", "digest", F.explode("anchors").alias("anchor"))
    repeated = listed.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("anchor")
    wanted = listed.join(repeated, "anchor").groupBy("doc_id", "digest").agg(F.collect_list("anchor").alias("repeated"))
    packed = texts.mapInArrow(_pack(window), "doc_id long, digest long, packed binary")
    found = stored(
        packed.join(wanted, ["doc_id", "digest"]).select("doc_id", "digest", "packed", "repeated").mapInArrow(_edges(window, anchor), "doc_id long, digest long, packed binary, at array<int>, edges array<long>")
    )
    neighbour = lambda i, step: F.when(F.get("at", i + step) == F.get("at", i) + step, F.get("edges", i + step))
    places = (
        found.select("doc_id", "digest", "at", "edges", F.posexplode("edges").alias("i", "edge"))
        .select("doc_id", "digest", F.get("at", F.col("i")).alias("at"), "edge", neighbour(F.col("i"), -1).alias("before"), neighbour(F.col("i"), 1).alias("after"))
    )
    spans = stored(_spans(places, compact(stored(_graph(places))), window))
    source = ["source_id", "source_digest", "source_start", "length"]
    asked = spans.select(*source).distinct().groupBy(F.col("source_id").alias("doc_id"), F.col("source_digest").alias("digest"))
    asked = asked.agg(F.collect_list(F.struct("source_start", "length")).alias("spans"))
    checked = found.select("doc_id", "digest", "packed").join(asked, ["doc_id", "digest"])
    checked = checked.mapInArrow(_span_digests, "source_id long, source_digest long, source_start int, length int, source_sha binary").distinct()
    to_remove = spans.join(checked, source).groupBy("doc_id", "digest").agg(F.collect_list(F.struct("start", "length", "source_sha")).alias("spans"))
    kept = found.select("doc_id", "digest", "packed").join(to_remove, ["doc_id", "digest"]).mapInArrow(_remove, "doc_id long, digest long, n_removed long, kept_sha256 string")
    kept = kept.dropDuplicates(["doc_id", "digest"])
    copies = known.where("copy").select("doc_id", "digest", F.lit(True).alias("copy")).distinct()
    joined = described.select("doc_id", "digest", "n_words", "sha").join(kept, ["doc_id", "digest"], "left").join(copies, ["doc_id", "digest"], "left")
    copy = F.coalesce("copy", F.lit(False))
    return joined.select(
        F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"),
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(_NONE)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )
