"""Near copies, repeated words and bytes, and benchmark passages against plain versions."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from runledger.llm import arrays, debruijn, decontamination, ngram_join, storage, suffix_dedup
from tests.llm import plain
from tests.llm.conftest import by_id, texts


@pytest.mark.parametrize(("k", "similarity", "group"), [(3, Fraction(9, 10), 32), (5, Fraction(4, 5), 2)])
def test_components(documents, odd, k, similarity, group):
    for table in (documents, odd):
        got = by_id(ngram_join.join(table, k, similarity, group), "n_shingles", "component_id")
        assert got == plain.components(texts(table), k, similarity.numerator, similarity.denominator)


def test_texts_travel_compressed_and_whole():
    given = [(1, "a b " * 500), (2, ""), (3, None), (4, "é\n\x00日 " * 3)]
    batch = pa.RecordBatch.from_arrays([pa.array([g[i] for g in given]) for i in (0, 1)] + [pa.array([0] * 4)], ["doc_id", "text", "digest"])
    packed = list(ngram_join._pack(iter([batch])))
    assert packed[0].column("packed").nbytes < 300
    assert [r for b in ngram_join._unpacked(packed) for r in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist())] == [(i, (t or "").encode()) for i, t in given]


def test_components_of_near_copies_that_need_the_matrix(spark):
    """Chains of copies: neighbours are similar, ends are not, and the smallest id is not in the middle."""
    base = [f"w{i}" for i in range(200)]
    rows, ids = [], [50, 3, 41, 7, 33, 12, 60, 1, 22, 18]
    for step, i in enumerate(ids):
        words = list(base)
        for x in range(step):
            words[x * 19] = f"other{x}"
        rows.append((i, " ".join(words)))
        rows.append((i + 100, " ".join(words[5:])))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = by_id(ngram_join.join(table, 3, Fraction(9, 10), 2), "n_shingles", "component_id")
    want = plain.components(dict(rows), 3, 9, 10)
    assert got == want
    assert len({c for _, c in want.values()}) < len(rows)


def test_sets_are_not_written(spark, monkeypatch):
    """Short words make sets larger than texts: what is kept to compare documents is smaller than the texts, and there once for
    each document."""
    kept = []

    def noted(frame):
        found = storage.stored(frame)
        kept.extend(found.select("doc_id", F.length(name)) for name, kind in found.dtypes if kind == "binary")
        return found

    monkeypatch.setattr(ngram_join, "stored", noted)
    draw = np.random.default_rng(4)
    words = lambda n: [f"{x:x}" for x in draw.integers(0, 4096, n)]
    base, rows = words(400), []
    for i in range(30):
        rows.append((i, " ".join([*base[: 13 * i], f"x{i}", *base[13 * i + 1 :]])))  # similar to each other
        rows.append((100 + i, " ".join(words(400))))
        rows.append(rows[-2])
    found = by_id(ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"), 5, Fraction(4, 5)), "n_shingles", "component_id")
    assert found == plain.components(dict(rows), 5, 4, 5)
    sizes = [tuple(r) for frame in kept for r in frame.collect()]
    assert sorted(i for i, _ in sizes) == list(range(30))
    assert sum(size for _, size in sizes) < sum(len(text) for i, text in dict(rows).items() if i < 30)


@pytest.mark.parametrize(("k", "similarity"), [(3, Fraction(9, 10)), (5, Fraction(4, 5))])
def test_similar_sets_share_the_parts_that_are_asked_for(spark, k, similarity):
    """In the band of the smaller one, whatever the sizes and however the differences lie."""
    draw, rows = np.random.default_rng(6), []
    bands = ngram_join.Bands(similarity, 3000)
    for n in (12, 30, 31, 60, 77, 150, 400, 900):
        for taken in (0, 0.25, 0.5, 1):
            most = int(n * (1 - similarity) / similarity)  # what the other may have beyond these, if it has them all
            gone, more = round(taken * n * float(1 - similarity) * 0.9), round((1 - taken) * most * 0.9)
            a = draw.integers(0, 1 << 63, n).astype(np.uint64)
            b = np.concatenate([a[gone:], draw.integers(0, 1 << 63, more).astype(np.uint64)])
            if similarity.denominator * (n - gone) < similarity.numerator * (n + more):
                continue
            found, text = np.concatenate([np.sort(a), np.sort(b)]), np.repeat([0, 1], [len(a), len(b)])
            keys, of = ngram_join.part_keys(found, text, np.array([len(a), len(b)]), bands)
            common = np.intersect1d(keys[of == 0], keys[of == 1]).astype(np.int64) & (1 << ngram_join.BAND_BITS) - 1
            band = int(np.searchsorted(bands.last_size, min(len(a), len(b))))
            rows += [(x, y, band, int((common == band).sum())) for x, y in ((len(a), len(b)), (len(b), len(a)))]
    table = spark.createDataFrame(rows, "size long, other long, band int, parts long")
    for largest in (None, F.col("other")):
        assert not table.where(F.col("parts") < ngram_join._equal_parts(bands.differ, similarity, largest)).collect()
    assert table.where("parts > 1").count() > 20


def test_bands_hold_all_similar_sizes():
    for similarity in (Fraction(9, 10), Fraction(4, 5)):
        bands = ngram_join.Bands(similarity, 3000)
        for size in range(1, 2000):
            band = int(np.searchsorted(bands.last_size, size))
            largest = int(size / similarity)
            assert int(np.searchsorted(bands.last_size, largest)) <= band + 1
            differ = int((1 - similarity) / (1 + similarity) * (size + largest))
            assert differ <= bands.differ[band] < bands.parts[band] - bands.spare[band]


def test_rows_without_id_link_with_nothing(odd):
    lost = ngram_join.join(odd).where("doc_id IS NULL").collect()
    assert len(lost) == 2
    assert {r.component_id for r in lost} == {None}


def test_keep_one(documents, odd):
    want = {c for _, c in plain.components(texts(documents), 5, 4, 5).values()}
    kept = ngram_join.keep_one(documents)
    assert kept.columns == documents.columns
    assert {r.doc_id for r in kept.collect()} == want
    kept = ngram_join.keep_one(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(None) == 2
    assert ids.count(21) == 1
    assert not {22, 23, 24} & set(ids)


def test_keep_one_goes_by_the_text_of_each_row(spark):
    words = [f"w{i}" for i in range(300)]
    first, second, third, fourth = (" ".join(words[at : at + 60]) for at in (0, 60, 120, 180))
    near = lambda text: text + " more"
    rows = [
        (5, first, 1), (5, second, 2), (6, near(first), 3), (7, near(second), 4),  # a doc_id with texts of two groups
        (8, third, 5), (8, third, 6), (9, None, 7), (9, "", 8), (9, "", 9),  # equal rows
        (None, fourth, 10), (None, fourth, 11), (None, near(fourth), 12), (None, "alone", 13), (None, None, 14), (None, None, 15),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int")
    kept = [tuple(r) for r in ngram_join.keep_one(docs).collect()]
    assert {r[2] for r in kept} >= {1, 2, 7, 13, 14, 15}
    assert sum(r[1] == third for r in kept) == sum(r[2] in (8, 9) for r in kept) == sum(r[2] in (10, 11, 12) for r in kept) == 1
    assert len(kept) == 9
    assert not {3, 4} & {r[2] for r in kept}


def test_repeated_words(documents, odd):
    for table in (documents, odd):
        got = by_id(debruijn.remove_repeats(table), "n_words", "n_removed", "kept_sha256")
        assert got == plain.without_repeated_words(texts(table))


def test_repeated_words_of_short_windows(odd):
    got = by_id(debruijn.remove_repeats(odd, window=8, anchor=3), "n_words", "n_removed", "kept_sha256")
    assert got == plain.without_repeated_words(texts(odd), 8)


def test_paths_follow_the_source(spark):
    edges = [(1, 7, 0, None, 2), (2, 7, 1, 1, 3), (3, 7, 2, 2, None), (4, 7, 9, 3, 5), (5, 8, 10, 4, None)]
    rows = [(e, doc, at, 0, before, after) for e, doc, at, before, after in edges]
    table = spark.createDataFrame(rows, "edge long, source_id long, source_at int, source_digest long, before long, after long")
    assert {(r.edge, r.path) for r in debruijn.compact(table).collect()} == {(1, 0), (2, 0), (3, 0), (4, 9), (5, 10)}


@pytest.mark.parametrize("sizes", [{}, {"shard_bytes": 3000, "block_bytes": 20000}, {"hot_blocks": 2, "block_bytes": 20000}])
def test_repeated_bytes(documents, odd, sizes):
    for table in (documents, odd):
        got = by_id(suffix_dedup.remove_repeats(table, **sizes), "n_bytes", "n_removed", "n_spans", "kept_sha256")
        assert got == plain.without_repeated_bytes(texts(table))


def test_suffix_order_and_common_prefixes():
    draw = np.random.default_rng(3)
    pieces = [bytes(draw.integers(97, 99, n).astype(np.uint8)) for n in (300, 5, 1, 120)] + [b"ab" * 90, b"a" * 200]
    data = np.frombuffer(b"".join(pieces), np.uint8)
    bounds = np.cumsum([0, *map(len, pieces)])
    ends = np.repeat(bounds[1:], np.diff(bounds))
    order, rank = suffix_dedup.suffix_order(data, ends, 50)
    suffix = [bytes(data[i : min(ends[i], i + 64)]) for i in range(len(data))]
    assert sorted(order.tolist()) == list(range(len(data)))
    assert all(suffix[a] <= suffix[b] for a, b in zip(order[:-1], order[1:], strict=True))
    shared = suffix_dedup.common_prefixes(data, ends, order, rank, 50, lane=16)
    for a, b in zip(order[:-1], order[1:], strict=True):
        n = next((i for i, (x, y) in enumerate(zip(suffix[a], suffix[b], strict=False)) if x != y), min(len(suffix[a]), len(suffix[b])))
        assert min(n, 50) == shared[b]


def test_benchmark_passages(spark, documents, odd, benchmark):
    items = [(r.item_id, r.text) for r in benchmark.collect()]
    long_text = texts(odd)[20].split(" ")
    more = [(900, " ".join(long_text[100:130]).upper()), (901, " ".join(long_text[120:160])), (902, "two words"), (903, None), (904, ""), (904, "!!"), (905, "ab"), (906, "ab " * 40)]
    table = benchmark.select("item_id", "text").union(spark.createDataFrame(more, "item_id long, text string"))
    columns = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    for docs, known, which in ((documents, benchmark, items), (odd, table, items + more)):
        want = plain.contamination(texts(docs), which)
        assert by_id(decontamination.contamination(docs, known), *columns) == want
        assert by_id(decontamination.contamination(docs, known, broadcast_windows=0), *columns) == want
    kept = decontamination.drop_contaminated(odd, table)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect() if r.doc_id is not None} == {i for i, x in want.items() if not x[4]}


@pytest.mark.parametrize("broadcast_windows", [decontamination.BROADCAST_WINDOWS, 0])
def test_rows_go_by_their_own_text(spark, benchmark, broadcast_windows):
    passage = benchmark.orderBy("item_id").first().text
    rows = [(None, passage, 1), (None, "a clean row without an id", 2), (7, "clean words of a repeated id", 3), (7, "see " + passage, 4), (None, None, 5), (8, "other words", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source int")
    kept = decontamination.drop_contaminated(docs, benchmark, broadcast_windows)
    assert kept.columns == docs.columns
    assert sorted(r.source for r in kept.collect()) == [2, 3, 5, 6]


def test_tables_without_rows(none, benchmark, documents):
    for found in (
        ngram_join.join(none), ngram_join.keep_one(none), debruijn.remove_repeats(none), suffix_dedup.remove_repeats(none),
        decontamination.contamination(none, benchmark), decontamination.drop_contaminated(none, benchmark),
    ):
        assert found.collect() == []
    clean = decontamination.contamination(documents, benchmark.limit(0))
    assert clean.where("contaminated").count() == 0
    assert clean.count() == documents.count()


def test_anchors_are_those_of_each_run():
    values = np.random.default_rng(1).integers(0, 50, 400).astype(np.uint64)
    for width in (1, 2, 7, 64):
        want = {s + i for s in range(len(values) - width + 1) for i in range(width) if values[s + i] == values[s : s + width].min()}
        assert set(arrays.anchors(values, width).tolist()) == want


def test_hot_keys_do_not_meet_in_one_task(spark):
    """A third of all rows are copies of one text; no plan collects them in a list."""
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("the same words " * 30)).otherwise(F.concat(F.lit("own "), F.col("id"), F.lit(" text " * 60))).alias("text"))
    found = ngram_join.join(rows)
    assert found.where("doc_id % 3 = 0").select("component_id").distinct().count() == 1
    assert debruijn.remove_repeats(rows).where("doc_id % 3 = 0 AND n_removed = 0").count() == 1
    assert suffix_dedup.remove_repeats(rows).where("doc_id % 3 = 0 AND n_removed = 0").count() == 1


@pytest.mark.parametrize("window", [5, 8, 50, 64])
def test_windows_are_sorted_by_ranks_of_the_runs_that_cover_them(window, monkeypatch):
    """Only windows are sorted to their full length, and none needs common prefixes."""
    monkeypatch.setattr(suffix_dedup, "common_prefixes", None)
    draw = np.random.default_rng(9)
    sizes = [window, 90, 300, 64, 200, 200, window + 1]
    pieces = [bytes(draw.choice([0, 97, 98], n, p=[0.1, 0.8, 0.1]).astype(np.uint8)) for n in sizes] + [b"ab" * 90, b"a" * 200, b"\0" * 80]
    pieces += pieces[1:4]
    data, bounds = np.frombuffer(b"".join(pieces), np.uint8), np.cumsum([0, *map(len, pieces)])
    ends = np.repeat(bounds[1:], np.diff(bounds))
    is_window = np.arange(len(data)) + window <= ends
    positions, number = suffix_dedup.shard_windows(data, ends, is_window, window)
    found = [bytes(data[p : p + window]) for p in positions]
    assert sorted(positions.tolist()) == np.flatnonzero(is_window).tolist()
    assert found == sorted(found)
    assert len({(w, n) for w, n in zip(found, number.tolist(), strict=True)}) == len(set(found)) == len(set(number.tolist()))


def test_answers_name_anchors_by_bucket_and_key():
    distinct = np.array([1 << 20 | 1, 1 << 20 | 3, 5 << 20 | 1, 9 << 20 | 7, 1 << 63 | 1], np.uint64)  # the first two share a key
    bucket = np.array([4, 2, 4, 7, 2])
    keys = suffix_dedup._key(distinct)
    rows = [{"bucket": b, "kind": suffix_dedup._ANCHORS, "first": suffix_dedup._pack(keys[[i]])} for b, i in ((2, 1), (4, 2), (2, 3), (3, 4))]
    assert suffix_dedup._told(rows, suffix_dedup._ANCHORS, distinct, bucket).tolist() == [False, True, True, False, False]
    assert not suffix_dedup._told(rows, suffix_dedup._HOT, distinct, bucket).any()
