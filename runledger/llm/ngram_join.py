"""Near-duplicate documents: an exact Jaccard join of shingle sets with a token-group matrix.

Documents with equal sets are one. Two sets of which a share `similarity` is common differ in few shingles, so if the
space of shingle hashes is cut into more parts than they may differ in, one part at least is equal in both: the sets of a
size band meet under the hashes of their parts. How many equal parts two sets must have follows from their sizes, and
sets that have fewer are not compared. What is kept and shuffled to compare them are their texts, compressed. Candidates are not paired. First each set is compared with the smallest
doc_id that it meets, which gives components. Then, for sets that also meet documents of other components, the token-group
matrix decides: documents that were compared with the same one are partitioned into groups of about GROUP
members, a group keeps the union of its members' shingles, a query's overlap with the union bounds its overlap with every
member, and only groups whose bound suffices are opened and compared member by member. Members of the query's own
component are passed over, as they are connected already, and of the sets that meet under a key those of the largest
component are no queries: they are members of the groups that the others ask.

Parts without shingles would make all small sets meet. There are as many spare parts as a set may leave empty, so that an
equal part with shingles exists; a set that leaves more of them empty also meets others under those.

A null or empty text has no set and links with nothing. A text with fewer words than a shingle is one shingle. Rows with
one doc_id count as one document, rows without doc_id link with nothing and have no component. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runledger.llm import arrays
from runledger.llm.storage import plain_documents, stored, with_least

#: Members of a group whose shingles are united, and queries that a task compares with it, about.
GROUP, QUERIES = 128, 500
#: Pairs of sets handed to Python at a time.
BATCH_ROWS = 256
#: The low bits of a key tell its size band.
BAND_BITS = 10
_U = np.uint64


class Bands:
    """Size bands: similar sets lie in one band or in two that follow each other."""

    def __init__(self, similarity: Fraction, largest: int) -> None:
        first, self.last, self.differ, self.spare = 1, [], [], []
        while first <= largest or not self.last:
            last = max(first, int(first / similarity))
            differ = int(last * (1 - similarity) / similarity)
            self.last.append(last)
            self.differ.append(differ)  # shingles that two sets of the band (or one of the next) differ in, at most
            self.spare.append(1 + int(np.ceil(2 * (differ + 1) * np.exp(-first / (differ + 1)))))
            first = last + 1
        self.last_size, self.n_differ, self.n_spare = (np.array(x, np.int64) for x in (self.last, self.differ, self.spare))
        self.parts = self.n_differ + 1 + self.n_spare


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes and the number of their text, sorted by text and hash."""
    lowered = arrays.LOWER[data]
    start, end, text_of = arrays.word_bounds(lowered, offsets)
    words = arrays.word_hashes(lowered, start, end)
    at = np.flatnonzero(arrays.same_text(text_of, k))
    hashes, of = [arrays.run_hashes(words, k)[at]], [text_of[at]]
    counts = np.bincount(text_of, minlength=len(offsets) - 1)
    begins = np.cumsum(counts) - counts
    for n in range(1, k):  # texts of fewer words
        short = np.flatnonzero(counts == n)
        if len(short):
            hashes.append(arrays.run_hashes(words, n)[begins[short]])
            of.append(short)
    found, text = np.concatenate(hashes), np.concatenate(of)
    order = np.lexsort((found, text))
    found, text = found[order], text[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (text[1:] != text[:-1])
    return found[new], text[new]


def part_keys(found: np.ndarray, text: np.ndarray, sizes: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """Keys under which the sets meet, and the text of each key."""
    keys, of = [np.zeros(0, _U)], [np.zeros(0, np.int64)]
    own = np.searchsorted(bands.last_size, sizes)
    weights = arrays.mix(found ^ _U(0x9E3779B97F4A7C15))
    high = found >> _U(32)
    for band_of in (own, own - 1):  # with sets of the own band, and as the larger one with those of the band before
        usable = (sizes > 0) & (band_of >= 0)
        usable &= bands.n_differ[np.maximum(band_of, 0)] > 0
        mine = usable[text]
        if not mine.any():
            continue
        h, t, w = high[mine], text[mine], weights[mine]
        parts = bands.parts[band_of[t]]
        part = (h * parts.astype(_U) >> _U(32)).astype(np.int64)
        edge = np.ones(len(t), bool)
        edge[1:] = (t[1:] != t[:-1]) | (part[1:] != part[:-1])
        begins = np.flatnonzero(edge)
        tag = lambda b, p: arrays.mix(b.astype(_U) * _U(0xA0761D6478BD642F) + p.astype(_U) * _U(0xE7037ED1A0B428DB))
        keys.append(_in_band(arrays.mix(np.add.reduceat(w, begins) + tag(band_of[t[begins]], part[begins])), band_of[t[begins]]))
        of.append(t[begins])
        filled = np.bincount(t[begins], minlength=len(sizes))
        for i in np.flatnonzero(usable & (bands.parts[np.maximum(band_of, 0)] - filled > bands.n_spare[np.maximum(band_of, 0)])):
            missing = np.setdiff1d(np.arange(bands.parts[band_of[i]]), part[begins][t[begins] == i])
            bands_of = np.full(len(missing), band_of[i])
            keys.append(_in_band(arrays.mix(tag(bands_of, missing)), bands_of))
            of.append(np.full(len(missing), i))
    keys, of = np.concatenate(keys), np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return keys[order], of[order]


def _in_band(hashes: np.ndarray, band: np.ndarray) -> np.ndarray:
    return hashes >> _U(BAND_BITS) << _U(BAND_BITS) | band.astype(_U)


def _lists(values: np.ndarray, of: np.ndarray, n: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(n + 1)).astype(np.int32)), pa.array(values))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed one by one, as they travel."""
    pack = zstandard.ZstdCompressor(level=1)
    for part, data, offsets in arrays.slices(batches):
        raw, at = data.tobytes(), offsets.tolist()
        packed = [pack.compress(raw[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("digest"), arrays.binary(packed)], ["doc_id", "digest", "packed"])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        texts = [unpack.decompress(packed) for packed in batch.column("packed").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.large_binary())], ["doc_id", "text"])


def _describe(k: int):
    """Size of each set, and two sums that tell sets apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in arrays.slices(batches):
            n = part.num_rows
            found, text = shingle_sets(data, offsets, k)
            sizes = np.bincount(text, minlength=n)
            sums = []
            for salt in (0x2545F4914F6CDD1D, 0xD1342543DE82EF95):
                total = np.zeros(n, _U)
                begins = arrays.group_starts(text)
                if len(begins):
                    total[text[begins]] = np.add.reduceat(arrays.mix(found + _U(salt)), begins)
                sums.append(pa.array(total.view(np.int64)))
            columns = [part.column("doc_id"), part.column("digest"), pa.array(sizes.astype(np.int64)), *sums]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "digest", "n_shingles", "sum_a", "sum_b"])

    return run


def _keys(k: int, similarity: Fraction):
    """The keys under which the set of each text meets others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(similarity, 1 << 16)
        for part, data, offsets in arrays.slices(_unpacked(batches)):
            found, text = shingle_sets(data, offsets, k)
            sizes = np.bincount(text, minlength=part.num_rows)
            if sizes.max(initial=0) > bands.last[-1]:
                bands = Bands(similarity, int(sizes.max()))
            keys, of = part_keys(found, text, sizes, bands)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), _lists(keys.view(np.int64), of, part.num_rows)], ["doc_id", "keys"])

    return run


def _sets(packed: list[bytes], k: int) -> Iterator[np.ndarray]:
    """The set of each compressed text. Sets are made where they are compared, as a text is smaller than its set."""
    batch = pa.RecordBatch.from_arrays([pa.nulls(len(packed), pa.int64()), arrays.binary(packed)], ["doc_id", "packed"])
    for part, data, offsets in arrays.slices(_unpacked(iter([batch]))):
        found, text = shingle_sets(data, offsets, k)
        yield from np.split(found, np.searchsorted(text, np.arange(1, part.num_rows)))


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Common values of two sorted arrays without repeats."""
    if len(a) > len(b):
        a, b = b, a
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum()) if len(a) else 0


def _similar(k: int, similarity: Fraction):
    top, bottom = similarity.numerator, similarity.denominator

    @F.pandas_udf("boolean")
    def similar(left: pd.Series, right: pd.Series) -> pd.Series:
        texts = list({*left, *right})
        sets = dict(zip(texts, _sets(texts, k), strict=True))

        def one(a: np.ndarray, b: np.ndarray) -> bool:
            common = _common(a, b)
            return bottom * common >= top * (len(a) + len(b) - common)

        return pd.Series([one(sets[x], sets[y]) for x, y in zip(left, right, strict=True)], dtype=bool)

    return similar


def _open_groups(k: int, similarity: Fraction):
    """Links between components that a group's members and the queries of a block have."""
    top, bottom = similarity.numerator, similarity.denominator

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        members = list(zip(left.column("component").to_pylist(), _sets(left.column("packed").to_pylist(), k), strict=True))
        links: set[tuple[int, int]] = set()
        if members and right.num_rows:
            union = np.unique(np.concatenate([x for _, x in members]))
            least = min(len(x) for _, x in members)
            for of, query in zip(right.column("of").to_pylist(), _sets(right.column("text").to_pylist(), k), strict=True):
                most = _common(query, union)  # what the query can have in common with any member
                if bottom * most < top * len(query) or (top + bottom) * most < top * (len(query) + least):
                    continue
                for component, tokens in members:
                    link = min(of, component), max(of, component)
                    if component != of and link not in links:
                        common = _common(query, tokens)
                        if bottom * common >= top * (len(query) + len(tokens) - common):
                            links.add(link)
        found = sorted(links)
        return pa.table([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return run


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Rows with whole sets go to Python a few at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def roots(parents: DataFrame) -> DataFrame:
    """doc_id and component of a forest given as doc_id and parent (smaller or itself): parents of parents are looked up
    until every document points to its root."""
    current = stored(parents)
    while True:
        above = current.select(F.col("doc_id").alias("parent"), F.col("parent").alias("grandparent"))
        current = stored(current.join(above, "parent").select("doc_id", F.col("grandparent").alias("parent"), (F.col("grandparent") != F.col("parent")).alias("moved")))
        if not current.where("moved").limit(1).count():
            return current.select("doc_id", F.col("parent").alias("component"))
        current = current.drop("moved")


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and root (the smallest node it is connected with) for undirected edges a, b between nodes."""
    labels = stored(nodes.select("node", F.col("node").alias("root")))
    both = stored(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct())
    while True:
        least = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("near"))
        hung = labels.join(least, F.col("node") == F.col("a"), "left").select("node", "root", F.least("root", F.coalesce("near", "root")).alias("low"))
        # The root itself takes over the smallest label that any of its nodes has met.
        best = hung.groupBy("root").agg(F.min("low").alias("best"))
        moved = stored(hung.join(best, "root").select("node", F.col("best").alias("root"), (F.col("best") != F.col("root")).alias("moved")))
        changed = moved.where("moved").limit(1).count()
        labels = moved.drop("moved")
        if not changed:
            return labels


def join(docs: DataFrame, k: int = 3, similarity: Fraction = Fraction(9, 10), group: int = GROUP) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    texts = plain_documents(docs).withColumn("digest", F.xxhash64("text"))
    described = stored(texts.mapInArrow(_describe(k), "doc_id long, digest long, n_shingles long, sum_a long, sum_b long"))
    with _small_batches(docs.sparkSession):
        linked = _links(texts, described, k, similarity, group)
    return described.select("doc_id", "n_shingles").join(linked, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _equal_parts(allowed: list[int], similarity: Fraction, largest: Column | None = None) -> Column:
    """Equal parts that a set and a similar one (of at most `largest` shingles) have at least: what the band allows to differ
    beyond what sets of their sizes may differ in."""
    top, bottom = similarity.numerator, similarity.denominator
    other = F.floor(F.col("size") * bottom / top)
    both = F.col("size") + (other if largest is None else F.least(largest, other))
    return F.get(F.array(*(F.lit(n) for n in allowed)), F.col("band")) + 1 - F.floor(both * (bottom - top) / (bottom + top))


def _links(texts: DataFrame, described: DataFrame, k: int, similarity: Fraction, group: int) -> DataFrame:
    """doc_id and component_id of the documents that have links."""
    full = described.where("n_shingles > 0 AND doc_id IS NOT NULL")
    member = stored(with_least(full, ["n_shingles", "sum_a", "sum_b"], "doc_id", "first_id"))
    chosen = member.where("doc_id = first_id").groupBy("doc_id", "n_shingles", "sum_a", "sum_b").agg(F.min("digest").alias("digest"))
    size = chosen.groupBy("doc_id").agg(F.min("n_shingles").alias("least"), F.max("n_shingles").alias("size"))
    bands = Bands(similarity, described.agg(F.max("n_shingles")).first()[0] or 1)
    allowed = bands.differ
    band = F.col("key").bitwiseAND((1 << BAND_BITS) - 1).cast("int").alias("band")

    # Sets that meet others, and the smallest document they meet. Texts travel compressed and keys are made where they
    # arrive, as a text is smaller than its keys; keys are the bulk of what is shuffled and travel once.
    # They are dealt in any case, so that no task has a Python worker for packing and another for keys at once.
    packed = texts.mapInArrow(_pack, "doc_id long, digest long, packed binary").repartition("doc_id", "digest")
    keyed = packed.join(chosen.select("doc_id", "digest"), ["doc_id", "digest"], "left_semi").select("doc_id", "packed").mapInArrow(_keys(k, similarity), "doc_id long, keys array<long>")
    of_key = Window.partitionBy("key")
    meets = keyed.select("doc_id", F.explode("keys").alias("key")).select("key", "doc_id", F.min("doc_id").over(of_key).alias("pivot"), F.max("doc_id").over(of_key).alias("other"))
    met = stored(meets.where("pivot < other").select("key", "doc_id", "pivot"))
    # A set that is equal to others in too few parts is similar to none. All parts in which it equals the smallest document
    # that it meets lie under that one's keys, so too few of them rule this pair out as well.
    parts = stored(met.groupBy("doc_id", "pivot", band).agg(F.count("*").alias("parts")).join(size, "doc_id"))
    enough = parts.groupBy("doc_id", "size", "band").agg(F.sum("parts").alias("parts")).where(F.col("parts") >= _equal_parts(allowed, similarity))
    active = stored(enough.select("doc_id").distinct())
    wanted = chosen.select("doc_id", "digest").join(active, "doc_id")
    held = stored(packed.join(wanted, ["doc_id", "digest"]).groupBy("doc_id", "digest").agg(F.first("packed").alias("packed")).select("doc_id", "packed"))

    asked = parts.groupBy("doc_id").agg(F.min("pivot").alias("pivot")).where("pivot < doc_id")
    sizes = size.select(F.col("doc_id").alias("pivot"), F.col("least").alias("pivot_least"), F.col("size").alias("pivot_size"))
    last = F.array(*(F.lit(n) for n in bands.last))
    of_smaller = (F.get(last, F.col("band")) >= F.least("least", "pivot_least")) & (F.coalesce(F.get(last, F.col("band") - 1), F.lit(0)) < F.least("size", "pivot_size"))
    near = parts.join(asked, ["doc_id", "pivot"]).join(sizes, "pivot").where(of_smaller & (F.col("parts") >= _equal_parts(allowed, similarity, F.col("pivot_size"))))
    similar = _similar(k, similarity)
    mine = near.select("doc_id", "pivot").distinct().join(held, "doc_id").withColumnRenamed("packed", "left")
    theirs = held.select(F.col("doc_id").alias("pivot"), F.col("packed").alias("right"))
    good = mine.join(theirs, "pivot").where(similar("left", "right")).select("doc_id", "pivot").distinct()
    grouped = roots(active.join(good, "doc_id", "left").select("doc_id", F.coalesce("pivot", "doc_id").alias("parent")))

    # Sets that meet documents of other components ask the token-group matrix: under each key all but those of its largest
    # component. A set's group lies around the document it was compared with, so few groups meet under a key.
    labelled = stored(met.select("key", "doc_id").join(grouped, "doc_id"))
    split = labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    open_keys = stored(labelled.join(split, "key"))
    around = stored(active.join(asked, "doc_id", "left").select("doc_id", F.coalesce("pivot", "doc_id").alias("cluster")))
    inside = open_keys.select("component", "doc_id").distinct().join(around, "doc_id").join(size.drop("least"), "doc_id")
    chunks = inside.groupBy("cluster").agg(F.ceil(F.count("*") / group).alias("chunks"))
    members = stored(inside.join(chunks, "cluster").withColumn("chunk", F.pmod(F.xxhash64("doc_id"), "chunks")).drop("chunks"))
    extent = grouped.groupBy("component").agg(F.count("*").alias("extent"))
    largest = open_keys.select("key", "component").distinct().join(extent, "component").groupBy("key").agg(F.max_by("component", F.struct("extent", "component")).alias("main"))
    query = open_keys.join(largest, "key").where("component != main").join(size, "doc_id").select("key", F.col("doc_id").alias("query"), F.col("component").alias("of"), "size")
    in_group = open_keys.join(around, "doc_id").groupBy("key", "cluster").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    equal = query.join(in_group, "key").where((F.col("low") != F.col("of")) | (F.col("high") != F.col("of")))
    equal = equal.groupBy("query", "of", "size", "cluster", band).agg(F.count("*").alias("parts"))
    equal = equal.where(F.col("parts") >= _equal_parts(allowed, similarity))
    widest = members.groupBy("cluster", "chunk").agg(F.max("size").alias("largest"))
    sized = equal.join(widest, "cluster")
    pairs = stored(sized.where(F.col("parts") >= _equal_parts(allowed, similarity, F.col("largest"))).select("query", "of", "cluster", "chunk").distinct())
    # A group that many queries ask for is handed out to several tasks.
    blocks = pairs.groupBy("cluster", "chunk").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("blocks"))
    asking = pairs.join(blocks, ["cluster", "chunk"]).withColumn("block", F.pmod(F.xxhash64("query"), "blocks").cast("int"))
    asking = asking.join(held.select(F.col("doc_id").alias("query"), F.col("packed").alias("text")), "query").select(
        F.col("cluster").alias("cluster"), F.col("chunk").alias("chunk"), "block", "of", "text"
    )
    answering = members.join(blocks, ["cluster", "chunk"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    answering = answering.join(held, "doc_id").select("cluster", "chunk", "block", "component", "packed")
    where = ["cluster", "chunk", "block"]
    edges = stored(answering.groupBy(*where).cogroup(asking.groupBy(*where)).applyInArrow(_open_groups(k, similarity), "a long, b long").distinct())
    merged = components(edges, edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct())
    final = grouped.join(merged, F.col("component") == F.col("node"), "left").select(F.col("doc_id").alias("first_id"), F.coalesce("root", "component").alias("component"))
    found = member.select("doc_id", "first_id").join(final, "first_id", "left").select("doc_id", F.coalesce("component", "first_id").alias("component"))
    # A doc_id with several sets is one document: its components are connected.
    several = found.groupBy("doc_id").agg(F.min("component").alias("a"), F.max("component").alias("b"))
    ties = stored(several.where("a < b").select("a", "b").distinct())
    if ties.limit(1).count():
        tied = components(ties, ties.select(F.col("a").alias("node")).union(ties.select("b")).distinct())
        several = several.join(tied, F.col("a") == F.col("node"), "left").select("doc_id", F.coalesce("root", "a").alias("a"))
    return several.select("doc_id", F.col("a").alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, similarity: Fraction = Fraction(4, 5)) -> DataFrame:
    """The row with the smallest doc_id of each component, with its columns as they were. Where a doc_id repeats each row is
    compared by its own text, and of rows with the smallest doc_id the one whose text sorts first stays. Rows without doc_id
    are compared with each other, not with rows that have one. Of equal rows without words one stays, if they have a doc_id."""
    names = docs.columns
    back = [F.col(f"in_{i}").alias(c) for i, c in enumerate(names)]
    plain = docs.select(*(F.col(f"`{c}`").alias(f"in_{i}") for i, c in enumerate(names)), F.col("doc_id").cast("long").alias("kept_id"), F.col("text").cast("string").alias("kept_text"))
    unclear = plain.groupBy("kept_id").count().where("kept_id IS NULL OR count > 1").limit(1).count()
    if not unclear:
        found = join(docs, k, similarity)
        kept = found.where("doc_id = component_id").select(F.col("doc_id").alias("kept_id")).distinct()
        return plain.join(kept, "kept_id", "left_semi").select(*back)
    keyed = stored(plain.withColumn("row_key", F.monotonically_increasing_id()))
    kept = [_kept_keys(keyed.where(part).select("row_key", "kept_id", "kept_text"), k, similarity) for part in ("kept_id IS NOT NULL", "kept_id IS NULL")]
    return keyed.join(kept[0].unionByName(kept[1]), "row_key", "left_semi").select(*back)


def _kept_keys(rows: DataFrame, k: int, similarity: Fraction) -> DataFrame:
    """row_key of the rows that stay: one of each component, and of rows without words one for each doc_id and text."""
    found = join(rows.select(F.col("row_key").alias("doc_id"), F.col("kept_text").alias("text")), k, similarity)
    sized = rows.join(found.withColumnRenamed("doc_id", "row_key"), "row_key")
    first = F.min(F.struct("kept_id", "kept_text", "row_key")).alias("x")
    of_group = sized.where("n_shingles > 0").groupBy("component_id").agg(first).select("x.row_key")
    wordless = sized.where("n_shingles = 0")
    of_equal = wordless.where("kept_id IS NOT NULL").groupBy("kept_id", "kept_text").agg(F.min("row_key").alias("row_key")).select("row_key")
    return of_group.unionByName(of_equal).unionByName(wordless.where("kept_id IS NULL").select("row_key"))
