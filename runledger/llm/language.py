"""Language identification by error-correcting output codes.

Each language has a codeword; for each bit a binary classifier on hashed byte n-grams separates the languages whose bit
is 1 from the others. The classifiers come from one pass over all learnable documents that counts n-grams by language:
the weight of an n-gram is the log ratio of its shares on the two sides, every language counting alike. A text gives
one mean margin per bit. Decoding is loss-weighted: the distance to a codeword is the log loss of its bits, each weighted
by the margin expected of that classifier on that language. The nearest codeword wins; a text whose second codeword is
about as near is flagged as ambiguous.

Texts that are null or without any letter are `und` with score 0. Without any learnable document everything is `und`.
Documents with a null lang or doc_id are not learned from; a null doc_id is not held out. Ties go to the language that
sorts first. Repeated rows are judged alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.llm import arrays

ORDERS = (2, 3)
BITS = 16
SLOTS = 1 << BITS
#: Languages up to this many get all distinct codeword columns, more of them pseudo-random ones.
EXHAUSTIVE = 5
#: An n-gram counts as if seen this often in all; short texts are drawn to margin 0 by as many n-grams.
SMOOTHING, SHRINK = 0.5, 8.0
SHARPNESS, AMBIGUOUS = 4.0, 0.05
UNDETERMINED = "und"

_FOLD = arrays.LOWER.copy()
_FOLD[[b for b in range(0x80) if not chr(b).isalpha()]] = 0x20
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[b for b in range(0x80) if chr(b).isalpha()]] = True


def _codes(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Slot of each n-gram per order; SLOTS where it would cross into the next text."""
    folded = _FOLD[data].astype(np.uint32)
    found = []
    for order in ORDERS:
        code = np.full(len(data), order, np.uint32)
        for i in range(order):
            code[: len(data) - i] = code[: len(data) - i] * np.uint32(257) + folded[i:]
        slots = ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int32)
        for i in range(1, order):
            last = offsets[1:] - i
            slots[last[last >= offsets[:-1]]] = SLOTS
        found.append(slots)
    return found


def held_out() -> Column:
    """Documents kept for evaluation."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}

    def rows() -> pa.RecordBatch:
        kept = [(lang, np.flatnonzero(c)) for lang, c in totals.items()]
        langs = [x for lang, at in kept for x in [lang] * len(at)]
        slots = np.concatenate([at for _, at in kept]) if kept else np.zeros(0, np.int64)
        counts = np.concatenate([totals[lang][at] for lang, at in kept]) if kept else np.zeros(0, np.int64)
        totals.clear()
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(slots.astype(np.int32)), pa.array(counts.astype(np.int64))], ["lang", "slot", "n"])

    for part, data, offsets in arrays.slices(batches):
        langs = part.column("lang").to_numpy(zero_copy_only=False)
        slots = _codes(data, offsets)
        names, number = np.unique(langs.astype(str), return_inverse=True)
        of_byte = np.repeat(number, np.diff(offsets))
        for code, lang in enumerate(names):
            mine = of_byte == code
            sums = totals.setdefault(str(lang), np.zeros(SLOTS + 1, np.int64))
            for order in slots:
                sums += np.bincount(order[mine], minlength=SLOTS + 1)
            sums[SLOTS] = 0
        if len(totals) > 64:
            yield rows()
    yield rows()


def codewords(n: int) -> np.ndarray:
    """n rows of +1 and -1. Rows and columns differ, no column is constant, none is the complement of another."""
    if n < 2:
        return np.ones((n, 1))
    if n <= EXHAUSTIVE:
        return np.array([[1, *rest] for rest in product((1, -1), repeat=n - 1) if -1 in rest]).T.astype(float)
    width = 4 * int(np.ceil(np.log2(n))) + 7
    best = None
    for seed in range(64):
        draws = arrays.mix(np.arange(n * width, dtype=np.uint64) + np.uint64(1 + seed * n * width))
        code = np.where(draws.reshape(n, width) >> np.uint64(63), 1.0, -1.0)
        agreement = np.abs(code.T @ code) - n * np.eye(width)
        apart = (width - (code @ code.T - width * np.eye(n)).max()) / 2
        if (np.abs(code.sum(axis=0)) < n).all() and agreement.max() < n and (best is None or apart > best[0]):
            best = (apart, code)
    return best[1] if best else np.where(np.eye(n) > 0, 1.0, -1.0)


class Model:
    """Languages, codewords, weights of every bit and slot, and how much each bit says about each language."""

    def __init__(self, languages: list[str], counts: np.ndarray) -> None:
        self.languages = languages
        self.code = codewords(len(languages))
        share = (counts + SMOOTHING / SLOTS * counts.sum(axis=1, keepdims=True) * 0.01 + 1e-9) if len(languages) else counts
        share = share / share.sum(axis=1, keepdims=True) if len(languages) else share
        n_bits = self.code.shape[1] if len(languages) > 1 else 0
        self.weights = np.zeros((n_bits, SLOTS + 1), np.float32)
        for bit in range(n_bits):
            one = self.code[:, bit] > 0
            ratio = np.log(share[one].mean(axis=0)) - np.log(share[~one].mean(axis=0))
            self.weights[bit, :SLOTS] = np.clip(ratio, -4, 4)
        expected = share @ self.weights[:, :SLOTS].T.astype(float) if n_bits else np.zeros((len(languages), 0))
        self.scale = np.abs(expected).mean(axis=0) + 1e-12
        trust = np.clip(expected * self.code[:, :n_bits], 1e-6, None)
        self.trust = trust / trust.sum(axis=1, keepdims=True) if n_bits else trust

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean margin per text and bit, 1 being what is expected of a long text."""
        lengths = np.diff(offsets)
        filled = np.flatnonzero(lengths > 0)
        out = np.zeros((len(lengths), len(self.weights)))
        if not len(filled):
            return out
        slots = _codes(data, offsets)
        grams = np.zeros(len(lengths))
        for order in ORDERS:
            grams += np.clip(lengths - order + 1, 0, None)
        for bit, weights in enumerate(self.weights):
            for order in slots:
                out[filled, bit] += np.add.reduceat(weights[order], offsets[:-1][filled], dtype=np.float64)
        return out / (grams + SHRINK)[:, None] / self.scale

    def distances(self, margins: np.ndarray) -> np.ndarray:
        """Loss-weighted distance of each text to each codeword."""
        out = np.zeros((len(margins), len(self.languages)))
        for i in range(len(self.languages)):
            loss = np.logaddexp(0, -SHARPNESS * margins * self.code[i, : margins.shape[1]])
            out[:, i] = loss @ self.trust[i]
        return out


def learn(docs: DataFrame) -> Model:
    """Counts n-grams of all documents that are not held out. The driver gets one row of counts per language and slot."""
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select(F.col("lang").cast("string").alias("lang"), "text")
    rows = known.mapInArrow(_count, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(rows.column("lang").to_pylist()))
    counts = np.zeros((len(languages), SLOTS))
    if languages:
        number = {lang: i for i, lang in enumerate(languages)}
        codes = rows.column("lang").combine_chunks().dictionary_encode()
        codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
        of = np.array([number[x] for x in codes.dictionary.to_pylist()])[codes.indices.to_numpy()]
        counts[of, rows.column("slot").to_numpy()] = rows.column("n").to_numpy()
    return Model(languages, counts)


def _lettered(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts hold a letter of any script."""
    sums = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_ASCII_LETTER[data], out=sums[1:])
    found = sums[offsets[1:]] > sums[offsets[:-1]]
    for i in np.flatnonzero(~found & (np.diff(offsets) > 1)):
        found[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
    return found


def predict(docs: DataFrame, model: Model, column: str = "text") -> DataFrame:
    """Adds lang_pred, score (0 to 1) and ambiguous to the documents; only the column of the texts is looked at."""
    names = [*model.languages, UNDETERMINED]
    schema = docs.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("ambiguous")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in arrays.slices(batches, column):
            n = len(offsets) - 1
            best, score, unsure = np.full(n, len(names) - 1), np.zeros(n), np.ones(n, bool)
            if model.languages and n:
                distances = model.distances(model.margins(data, offsets))
                chances = np.exp(SHARPNESS * (distances.min(axis=1, keepdims=True) - distances))
                chances /= chances.sum(axis=1, keepdims=True)
                good = _lettered(data, offsets)
                best[good] = distances.argmin(axis=1)[good]
                score[good] = chances.max(axis=1)[good]
                ranked = np.sort(distances, axis=1)
                unsure = ~good | (ranked[:, 1] - ranked[:, 0] < AMBIGUOUS) if n and len(model.languages) > 1 else ~good
            columns = [part.column(i) for i in range(part.num_columns)]
            columns += [pa.array([names[i] for i in best], pa.string()), pa.array(score), pa.array(unsure)]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and ambiguous of every document."""
    found = predict(docs.select("doc_id", "text"), learn(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


def keep_known(docs: DataFrame) -> DataFrame:
    """The documents whose language could be told, with their columns as they were."""
    renamed = docs.withColumnsRenamed({c: f"in_{i}" for i, c in enumerate(docs.columns)})
    found = predict(renamed, learn(docs), f"in_{docs.columns.index('text')}").where((F.col("lang_pred") != UNDETERMINED) & ~F.col("ambiguous"))
    return found.select(*(F.col(f"in_{i}").alias(c) for i, c in enumerate(docs.columns)))
