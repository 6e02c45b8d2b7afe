"""Spelling variants, the conversation trie and MinHash against plain versions."""

from __future__ import annotations

import random
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from runledger.llm import minhash, prefix_trie, spelling
from runledger.llm.queries import oracle_sql
from tests.conftest import SMALL
from tests.llm import plain
from tests.llm.conftest import by_id, texts

TRIE = ("parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
TURN = "conv_id long, turn long, role string, text string, node string, level string, words string"


def spelt(frame):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.group_spellings(frame).collect()}


def rows_of(frame):
    return [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]


@pytest.mark.parametrize("block", [256, 3])
def test_spellings(documents, odd, monkeypatch, block):
    monkeypatch.setattr(spelling, "BLOCK", block)
    for table in (documents, odd, documents.union(documents.limit(40))):
        assert spelt(table) == plain.spellings(rows_of(table))


def test_spellings_at_edges(spark):
    """Chains of forms, ties, doubled letters where an edit has many places, accents, and a very long word."""
    words = {"letters": 130, "lettters": 26, "letterss": 5, "leters": 26, "aaaaaa": 40, "aaaaaaa": 7, "aaaaaaaa": 5, "élèves": 30, "elèves": 5, "Élèves": 6, "x" * 9000: 6, "x" * 9001: 30, "abcdef": 25, "abcdex": 25, "abcdeq": 5, "short": 90}
    table = spark.createDataFrame([(n, " ".join([w] * times)) for n, (w, times) in enumerate(words.items())] + [(None, "letters 1letters_")], "doc_id long, text string")
    got = spelt(table)
    assert got == plain.spellings(rows_of(table))
    assert got["abcdeq"][0] == "abcdef"


def test_hot_ends_are_cut_into_blocks(spark):
    """Words that share one end: each tile holds two blocks at most, and all pairs are found."""
    draw = random.Random(1)
    words = sorted({"".join(draw.choices("abcdefgh", k=2)) + "zzzzzz" for _ in range(60)} | {"".join(draw.choices("abcdefgh", k=3)) + "zzzzzz" for _ in range(300)})
    table = spark.createDataFrame([(1, " ".join(w for w in words for _ in range(5 + len(w)))), (3, " ".join(words))], "doc_id long, text string")
    assert spelt(table) == plain.spellings(rows_of(table))


def test_no_words(none):
    assert spelling.group_spellings(none).count() == 0


@pytest.fixture(scope="module")
def told(spark):
    """Absent and short heads, equal turn numbers, nulls in every column, a long conversation, and copies."""
    draw, rows = random.Random(3), []
    for c in [*range(0, 130), -3, 1000, 1040]:
        for t in range(0 if c in (20, 41) else max(1, draw.choice([0, 1, 1, 2, 3, 5, 9]))):
            number = None if draw.random() < 0.05 else draw.choice([t, t, t, 1])
            rows.append((c, number, draw.choice(["user", None, ""]), draw.choice(["a b", "a b", "c", None, "", "x y z"])))
    rows += [(77, i, "u", f"t{i % 3}") for i in range(700)] + [(78, 5, "u", "w " * 50_000)] + [(None, 1, "u", "lost")]
    return spark.createDataFrame([(*r, "x", "x", "x") for r in rows], TURN).repartition(3)


@pytest.mark.parametrize("heavy", [prefix_trie.HEAVY, 3])
def test_trie(spark, told, heavy):
    for table in (told, spark.read.parquet(f"{SMALL}/conversations.parquet")):
        want = plain.trie([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])
        got = prefix_trie.prefix_tree(table, heavy=heavy).collect()
        assert len(got) == len(want)
        assert {(r.conv_id, r.depth): tuple(r[c] for c in TRIE) for r in got} == want


def test_tree_of_conversations_equals_its_sql(told):
    """Equal and missing turn numbers, null roles and texts, and ids below zero, whose blocks start toward zero."""
    more = told.union(told.where("conv_id < 70").withColumn("conv_id", -F.col("conv_id")))
    conversations = more.where("conv_id IS NULL OR conv_id NOT IN (77, 78)").select("conv_id", "turn", "role", "text")
    want = duckdb.connect()
    want.register("conversations", conversations.toArrow())
    rows = [tuple(r) for r in prefix_trie.conversation_tree(conversations).collect()]
    assert sorted(rows, key=lambda r: r[:2]) == sorted(want.sql(oracle_sql()["op12_prefix_trie"]).fetchall(), key=lambda r: r[:2])


def test_trie_of_no_conversations(told):
    assert prefix_trie.prefix_tree(told.limit(0)).count() == 0


def test_parentheses_close_and_count():
    draw = np.random.default_rng(7)
    for n, block in ((1, 4), (2, 4), (3000, 8), (3000, 256)):
        parent = np.array([int(draw.integers(-1 if draw.random() < 0.01 else max(-1, i - 5), i)) if i else -1 for i in range(n)])
        opens, of = prefix_trie.parentheses(parent)
        at = np.flatnonzero(opens)
        close = prefix_trie.Excess(opens, block).findclose(at)
        last = {int(node): place for place, node in enumerate(of)}
        assert [last[int(of[i])] for i in at] == close.tolist()
        saved = draw.integers(0, 9, n)
        leaves, sums = prefix_trie.subtree_sums(parent, np.zeros(n, np.int64), saved, np.isin(np.arange(n), parent))
        want_leaves, want = np.where(np.isin(np.arange(n), parent), 0, 1), saved.copy()
        for i in range(n - 1, -1, -1):
            if parent[i] >= 0:
                want_leaves[parent[i]] += want_leaves[i]
                want[parent[i]] += want[i]
        assert (leaves == want_leaves).all()
        assert (sums == want).all()


@pytest.mark.parametrize("hot", [minhash.HOT, 2])
def test_near_copies(documents, odd, hot):
    for table in (documents, odd):
        got = by_id(minhash.deduplicate(table, hot=hot), "n_shingles", "component_id")
        assert got == plain.components(texts(table), 2, 4, 5)


def test_near_copies_of_one_text(spark, monkeypatch):
    """Variants of one text at all distances, in small blocks: most link to the original only, some to none."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    monkeypatch.setattr(minhash, "ASKING", 8)
    draw = random.Random(2)
    base = [f"w{i}" for i in range(150)]
    rows = [(500, " ".join(base))]
    for i in range(220):
        words = list(base)
        for at in draw.sample(range(150), draw.randint(1, 22)):
            words[at] = f"o{i}x{at}"
        rows.append((i, " ".join(words)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = by_id(minhash.deduplicate(table), "n_shingles", "component_id")
    assert got == plain.components(dict(rows), 2, 4, 5)
    assert 1 < len({c for _, c in got.values()}) < 150


def test_rows_without_id_are_kept(odd, none):
    found = minhash.deduplicate(odd)
    assert [r.kept for r in found.where("doc_id IS NULL").collect()] == [True, True]
    assert found.where(F.col("kept") != F.col("doc_id").eqNullSafe(F.col("component_id"))).count() == 0
    assert minhash.deduplicate(none).count() == 0


def test_pairs_of_half_keys_find_similar_sets():
    """Sets of similarity s agree in a half key of each collection with the chance that the tables promise."""
    draw, n, size = np.random.default_rng(3), 3000, 90
    for similarity, least, most in ((Fraction(4, 5), 0.999, 1.0), (Fraction(3, 10), 0.0, 0.06)):
        same = int(size * 2 * similarity / (1 + similarity))
        left = draw.integers(0, 1 << 63, (n, size), dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        right = left.copy()
        right[:, same:] = draw.integers(0, 1 << 63, (n, size - same), dtype=np.int64).astype(np.uint64) * np.uint64(2)
        of = np.repeat(np.arange(n), size)
        a, b = (minhash.half_keys(x.ravel(), of, n, minhash.COLLECTION, minhash.WIDTH) for x in (left, right))
        equal = a == b
        found = (equal[: minhash.COLLECTION].any(axis=0) & equal[minhash.COLLECTION :].any(axis=0)).mean()
        assert least <= found <= most
