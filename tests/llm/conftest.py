from __future__ import annotations

import random

import pytest
from pyspark.sql import types as T

from tests.conftest import SMALL

#: Names that operators use inside; a table may have them too.
CLASHING = ["digest", "block", "score", "kept", "n_words", "lang_pred", "sequence_id", "_hit", "keys", "spans"]
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in CLASHING]
)


def odd_rows() -> list[tuple]:
    """Nulls in every column, empty and blank texts, a very long text, copies, near copies and repeated rows."""
    draw = random.Random(5)
    words = ["".join(draw.choices("abcdefgh", k=draw.randint(1, 7))) for _ in range(400)]
    passage = " ".join(draw.choices(words, k=120))
    body = draw.choices(words, k=300)
    near = body[:150] + ["changed"] + body[151:]
    texts = [
        (10, None), (11, ""), (12, " \n\t "), (13, "one"), (14, "One"), (15, "two words"), (16, "| | | | 1234 !!"),
        (20, " ".join(draw.choices(words, k=30000))),
        (21, " ".join(body)), (22, " ".join(near)), (23, "  ".join(body)), (24, " ".join(body)), (24, " ".join(body)),
        (25, passage), (26, "start here " + passage + " and end"), (27, passage[:-40] + "\n" + passage), (28, "ab " * 300), (29, "ab " * 200),
        (30, "Mail a.b@c.de, 10.20.30.40, 300.1.1.1, 4111 1111 1111 1111, +49 (30) 123-4567 or x@y. https://example.org/a?b=c."),
        (31, "x@a.bc@d.ef 1.2.3.4.5.6.7.8 ++12 34 56 78 90 12 IBAN DE89 3704 0044 0532 0130 00 é@é.com ünïcödé"),
        (32, "日本語のテキスト " * 20), (33, "é" * 120), (34, "é   x\x0b\x0cy <|endoftext|>  z \r\n"),
        (None, "a row without an id that has a few words"), (None, " ".join(body)),
    ]
    langs = ["en", "de", None]
    return [(i, t, langs[n % 3], None if n % 4 else "src0", None, *["x"] * len(CLASHING)) for n, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SMALL}/labels.parquet")


@pytest.fixture(scope="session")
def benchmark(spark):
    return spark.read.parquet(f"{SMALL}/benchmark.parquet")


def texts(frame) -> dict:
    """doc_id -> text, of rows with an id."""
    return {r.doc_id: r.text for r in frame.select("doc_id", "text").collect() if r.doc_id is not None}


def by_id(frame, *columns: str) -> dict:
    return {r.doc_id: tuple(r[c] for c in columns) for r in frame.collect() if r.doc_id is not None}
