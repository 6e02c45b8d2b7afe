"""Near-duplicate documents by MinHash with tensored banding.

Two small collections of `collection` half keys, each made of `width` minhashes, are computed for a set of shingles. The
tables of the index are all pairs of a half key of the first and one of the second collection: collection^2 tables from
2 * collection * width minhashes, about a square root of what independent tables need. Two sets are candidates if they
agree in a half key of each collection. With 20 and 4, sets of similarity 0.8 miss each other with a chance of 5e-5 and
sets of 0.85 with 9e-7; every link is confirmed on full sets.

Table keys are not written out: rows travel under their first half keys and carry the second ones, and sets that share a
first half key are cut into the classes that share a second one too. Where very many sets share a first half key, both
halves together are the key. So a set has at most `collection` classes, and only classes of two sets or more go on.

Candidates are not paired. Of each class the set that meets most others is the pivot, every set is compared with the pivot
most of its classes name, and links make components. Only sets that still share a class with another component are compared
further: those outside the largest component of a class with all sets around the pivots of that class, in blocks, by
an inverted index of the shingles of a block. Variants of one text that are all not quite similar remain quadratic in
their number, divided by the size of a block.

A null or empty text has no set and links with nothing. A text with fewer words than a shingle is one shingle. Rows with
one doc_id count as one document; rows without doc_id link with nothing, have no component and are kept. Equal sets are one
before anything is compared. Other columns are ignored. A set is held as 64-bit hashes of its shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.llm import arrays
from runledger.llm.groups import starts, whole_groups
from runledger.llm.ngram_join import components, shingle_sets
from runledger.llm.storage import plain_documents, stored, with_least

#: Half keys of a collection, and minhashes in each.
COLLECTION, WIDTH = 20, 4
#: Sets in a block, shingles in it, and sets compared with a block at a time.
BLOCK, BLOCK_SHINGLES, ASKING = 256, 1 << 19, 512
#: From so many sets under a first half key on the second one is part of the key.
HOT = 20_000
#: Rows of groups that are handled together.
PACK = 20_000
_U, _U4 = np.uint64, np.uint32


def half_keys(found: np.ndarray, text: np.ndarray, n: int, collection: int, width: int) -> np.ndarray:
    """2 * collection half keys of each of n sets, given as hashes sorted by set; 0 where a set is empty."""
    draw = np.random.default_rng(20_240_131)
    factors = draw.integers(0, 1 << 31, 2 * collection * width, dtype=np.int64).astype(_U4) * _U4(2) + _U4(1)
    shifts = draw.integers(0, 1 << 32, 2 * collection * width, dtype=np.int64).astype(_U4)
    keys = np.zeros((2 * collection, n), _U)
    begins = arrays.group_starts(text)
    if len(begins):
        low, of = (found >> _U(32)).astype(_U4), text[begins]
        for key in range(2 * collection):
            total = np.full(len(begins), key + 1, _U)
            for f in range(key * width, (key + 1) * width):
                total = arrays.mix(total + np.minimum.reduceat(low * factors[f] + shifts[f], begins).astype(_U))
            keys[key, of] = total
    return keys


def _describe(k: int, collection: int, width: int):
    """Size of each set, two sums that tell sets apart, first half keys, and second ones as 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in arrays.slices(batches):
            n = part.num_rows
            found, text = shingle_sets(data, offsets, k)
            sums = []
            for salt in (0x2545F4914F6CDD1D, 0xD1342543DE82EF95):
                total = np.zeros(n, _U)
                begins = arrays.group_starts(text)
                if len(begins):
                    total[text[begins]] = np.add.reduceat(arrays.mix(found + _U(salt)), begins)
                sums.append(pa.array(total.view(np.int64)))
            keys = half_keys(found, text, n, collection, width)
            first = np.ascontiguousarray(keys[:collection].T).view(np.int64).ravel()
            second = np.ascontiguousarray((keys[collection:] >> _U(32)).astype(_U4).T).ravel()
            bounds = np.arange(n + 1) * collection
            columns = [
                part.column("doc_id"), part.column("digest"), pa.array(np.bincount(text, minlength=n).astype(np.int64)), *sums,
                pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(first)), arrays.binary_runs(second, bounds),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "digest", "n_shingles", "sum_a", "sum_b", "first", "second"])

    return run


def _classes(collection: int):
    """Cuts the sets under each first half key into classes that share a second half key, also by way of others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["half"], PACK):
            half, doc = (table.column(c).to_numpy() for c in ("half", "doc_id"))
            second = np.frombuffer(b"".join(table.column("second").to_pylist()), _U4).reshape(-1, collection)
            group = np.zeros(len(half), np.int64)
            group[starts(table, ["half"])] = 1
            group = np.cumsum(group).astype(_U) << _U(32)
            label = np.arange(len(half))
            runs = []
            for j in range(collection):
                values = group | second[:, j].astype(_U)
                order = np.argsort(values, kind="stable")
                begins = arrays.group_starts(values[order])
                runs.append((order, begins, np.diff(np.append(begins, len(order)))))
            moved = True
            while moved:
                before = label.copy()
                for order, begins, lengths in runs:
                    label[order] = np.repeat(np.minimum.reduceat(label[order], begins), lengths)
                moved = bool((label != before).any())
            shared = np.bincount(label, minlength=len(label))[label] > 1
            keys = arrays.mix(half.view(_U) ^ arrays.mix(doc[label].view(_U)))
            yield pa.RecordBatch.from_arrays([pa.array(keys[shared].view(np.int64)), pa.array(doc[shared])], ["key", "doc_id"])

    return run


def _second_keys(collection: int):
    """Both halves as one key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            half, doc = (batch.column(c).to_numpy() for c in ("half", "doc_id"))
            second = np.frombuffer(b"".join(batch.column("second").to_pylist()), _U4).reshape(-1, collection).astype(_U)
            tagged = arrays.mix(second | np.arange(1, collection + 1, dtype=_U) << _U(32))
            keys = arrays.mix(half.view(_U)[:, None] ^ tagged).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.repeat(doc, collection))], ["key", "doc_id"])

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in arrays.slices(batches):
            found, text = shingle_sets(data, offsets, k)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), arrays.binary_runs(found, np.searchsorted(text, np.arange(part.num_rows + 1)))], ["doc_id", "shingles"])

    return run


def _compare(similarity: Fraction):
    """Links between the sets of a block and those that ask for it, as their nodes; sets of one node are not compared."""
    top, bottom = similarity.numerator, similarity.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["cluster", "chunk", "block"]):
            asks, node = table.column("asks").to_numpy(), table.column("node").to_numpy()
            sets = [np.frombuffer(x, _U) for x in table.column("shingles").to_pylist()]
            own = np.flatnonzero(asks == 0)
            links: set[tuple[int, int]] = set()
            if len(own) and len(own) < len(sets):
                sizes = np.array([len(sets[i]) for i in own])
                tokens, member = np.concatenate([sets[i] for i in own]), np.repeat(np.arange(len(own)), sizes)
                order = np.argsort(tokens, kind="stable")
                tokens, member = tokens[order], member[order]
                begins = arrays.group_starts(tokens)
                known, ends = tokens[begins], np.append(begins[1:], len(tokens))
                for i in np.flatnonzero(asks == 1):
                    at = np.minimum(np.searchsorted(known, sets[i]), len(known) - 1)
                    at = at[known[at] == sets[i]]
                    common = np.bincount(member[arrays.ranges(begins[at], ends[at] - begins[at])], minlength=len(own))
                    good = (bottom * common >= top * (sizes + len(sets[i]) - common)) & (node[own] != node[i])
                    links |= {(int(node[i]), x) for x in node[own[good]].tolist()}
            found = sorted(links)
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    return run


def _links_in_blocks(members: DataFrame, queries: DataFrame, sets: DataFrame, similarity: Fraction) -> DataFrame:
    """Links between members (cluster, doc_id, node) and the queries (cluster, doc_id, node) that ask for their cluster."""
    asked = queries.groupBy("cluster").agg(F.count("*").alias("asking"))
    sized = members.join(sets, "doc_id").withColumn("n", F.octet_length("shingles") / 8)
    shape = sized.groupBy("cluster").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("chunks"))
    shape = stored(shape.join(asked, "cluster").select("cluster", "chunks", F.ceil(F.col("asking") / ASKING).cast("int").alias("blocks")))

    def over(count: str) -> F.Column:
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    rows = ["cluster", "chunk", "block", "asks", "node", "shingles"]
    inside = sized.join(shape, "cluster").withColumn("chunk", F.pmod(F.xxhash64("doc_id"), "chunks").cast("int")).withColumn("block", over("blocks"))
    outside = queries.join(shape, "cluster").withColumn("block", F.pmod(F.xxhash64("doc_id"), "blocks").cast("int")).withColumn("chunk", over("chunks")).join(sets, "doc_id")
    both = inside.withColumn("asks", F.lit(0)).select(*rows).unionByName(outside.withColumn("asks", F.lit(1)).select(*rows))
    where = ["cluster", "chunk", "block"]
    return stored(both.repartition(*where).sortWithinPartitions(*where).mapInArrow(_compare(similarity), "a long, b long").distinct())


def _components(edges: DataFrame) -> DataFrame:
    return components(edges, edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct())


def deduplicate(docs: DataFrame, k: int = 2, similarity: Fraction = Fraction(4, 5), collection: int = COLLECTION, width: int = WIDTH, hot: int = HOT) -> DataFrame:
    """doc_id, n_shingles, component_id and whether the document stays (the first of each component)."""
    texts = plain_documents(docs).withColumn("digest", F.xxhash64("text"))
    schema = "doc_id long, digest long, n_shingles long, sum_a long, sum_b long, first array<long>, second binary"
    described = stored(texts.mapInArrow(_describe(k, collection, width), schema))
    linked = _links(texts, described, k, similarity, collection, hot)
    found = described.select("doc_id", "n_shingles").join(linked, "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def classes(described: DataFrame, chosen: DataFrame, collection: int, hot: int) -> DataFrame:
    """key and doc_id of the sets that share a table of the index with others."""
    rows = described.join(chosen.select("doc_id", "digest"), ["doc_id", "digest"], "left_semi")
    rows = rows.select("doc_id", "second", F.explode("first").alias("half"))
    shared = rows.groupBy("half").agg(F.count("*").alias("n")).where("n > 1")
    met = rows.join(shared, "half")
    near = met.where(F.col("n") <= hot).select("half", "doc_id", "second").repartition("half").sortWithinPartitions("half", "doc_id")
    near = near.mapInArrow(_classes(collection), "key long, doc_id long")
    both = met.where(F.col("n") > hot).select("half", "doc_id", "second").mapInArrow(_second_keys(collection), "key long, doc_id long")
    return near.unionByName(both)


def _links(texts: DataFrame, described: DataFrame, k: int, similarity: Fraction, collection: int, hot: int) -> DataFrame:
    """doc_id and component_id of the documents that have links."""
    full = described.select("doc_id", "digest", "n_shingles", "sum_a", "sum_b").where("n_shingles > 0 AND doc_id IS NOT NULL")
    member = stored(with_least(full, ["n_shingles", "sum_a", "sum_b"], "doc_id", "first_id").select("doc_id", "digest", "first_id"))
    chosen = stored(member.where("doc_id = first_id").select("doc_id", "digest").distinct())
    met = stored(classes(described, chosen, collection, hot).distinct())
    sizes = met.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = stored(met.join(sizes, "key"))

    # Each set is compared with the pivot that most of its classes name.
    weight = met.groupBy("doc_id").agg(F.sum("n").alias("weight"))
    pivots = met.join(weight, "doc_id").groupBy("key").agg(F.max_by("doc_id", F.struct("weight", "doc_id")).alias("pivot"))
    votes = met.join(pivots, "key").where("pivot != doc_id").groupBy("doc_id", "pivot").agg(F.count("*").alias("votes"))
    asked = stored(votes.groupBy("doc_id").agg(F.max_by("pivot", F.struct("votes", "pivot")).alias("pivot")))
    active = met.select("doc_id").distinct()
    wanted = stored(chosen.join(active, "doc_id").select("doc_id", "digest"))
    sets = stored(texts.join(wanted.hint("merge"), ["doc_id", "digest"]).dropDuplicates(["doc_id", "digest"]).mapInArrow(_sets(k), "doc_id long, shingles binary"))
    star = asked.select(F.col("pivot").alias("cluster"), "doc_id", F.col("doc_id").alias("node"))
    centre = star.select("cluster", F.col("cluster").alias("doc_id"), F.col("cluster").alias("node")).distinct()
    joined = _components(_links_in_blocks(star, centre, sets, similarity)).withColumnRenamed("node", "doc_id")

    # Sets that share a class with another component: all but those of its largest one ask all stars of the class.
    first = stored(active.join(joined, "doc_id", "left").join(asked, "doc_id", "left").select("doc_id", F.coalesce("root", "doc_id").alias("node"), F.coalesce("pivot", "doc_id").alias("cluster")))
    labelled = stored(met.select("key", "doc_id").join(first, "doc_id"))
    split = labelled.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("key")
    open_keys = stored(labelled.join(split, "key"))
    extent = first.groupBy("node").agg(F.count("*").alias("extent"))
    largest = open_keys.select("key", "node").distinct().join(extent, "node").groupBy("key").agg(F.max_by("node", F.struct("extent", "node")).alias("largest"))
    outside = open_keys.join(largest, "key").where("node != largest").select("key", "doc_id", "node")
    stars = open_keys.select("key", "cluster").distinct()
    queries = stored(outside.join(stars, "key").select("cluster", "doc_id", "node").distinct())
    members = first.join(queries.select("cluster").distinct(), "cluster", "left_semi").select("cluster", "doc_id", "node")
    merged = _components(_links_in_blocks(members, queries, sets, similarity))
    final = first.join(merged, "node", "left").select(F.col("doc_id").alias("first_id"), F.coalesce("root", "node").alias("component"))

    found = member.select("doc_id", "first_id").join(final, "first_id", "left").select("doc_id", F.coalesce("component", "first_id").alias("component"))
    # A doc_id with several sets is one document: its components are connected.
    several = stored(found.groupBy("doc_id").agg(F.min("component").alias("a"), F.max("component").alias("b")))
    tied = _components(several.where("a < b").select("a", "b").distinct())
    return several.join(tied, F.col("a") == F.col("node"), "left").select("doc_id", F.coalesce("root", "a").alias("component_id"))
