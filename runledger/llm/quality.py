"""Quality rules whose cutoffs come from labelled documents with a guaranteed rate of false rejections.

Every rule rejects a document when one measure exceeds a cutoff. Measures are taken in one pass over all texts. The
labelled documents of each stratum (a band of text length) are the holdout: for each rule and cutoff the good ones that
it would reject are counted. A cutoff may be used if the exact (Clopper-Pearson) upper bound of its rate of false
rejections stays below alpha. The rate can only rise as the cutoff falls, so cutoffs are tested in a fixed sequence, the
safest first, until one fails: that needs no correction over cutoffs, and the bounds of all strata and rules hold
together with confidence 1 - delta (Bonferroni). Of the cutoffs that passed the one that rejects most bad documents is
taken, and a rule that rejects none is not used. The rules of a stratum share alpha, so that all of them together reject
at most that part of its good documents.

Copies are no independent draws: a text counts once in the holdout, however many documents have it, and as good if any
label says so. Null and empty texts have no words and fail the base rules. A stratum without labels has no further rules.
Labels other than 0 and 1 are not used. Repeated rows are each judged; a very long text is measured whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.llm import arrays
from runledger.llm.storage import plain_documents, stored

#: Base rules: fewest words, and the most words of a hundred that lie in repeated 8-word windows.
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
#: Strata are bands of the number of words, beginning here.
BAND_STARTS = (0, 100, 400, 1600)
#: Measures as shares of 0 to 1 (word_length is the mean length divided by 20); a rule rejects what lies above a cutoff.
MEASURES = ("symbol_share", "dup_line_share", "repeat_share", "word_length", "shout_share", "odd_share")
CUTOFFS = tuple(round(0.02 * i, 2) for i in range(1, 50))
#: Sequences of tests that share delta.
RULES = len(BAND_STARTS) * len(MEASURES)

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_LETTER = _UPPER.copy()
_LETTER[0x61:0x7B] = True
_LETTER[0x80:] = True
_STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters", "n_chars_all")


def _repeated(hashes: np.ndarray, text_of: np.ndarray) -> np.ndarray:
    """Which words lie in a window that occurs twice or more in its text."""
    windows = arrays.run_hashes(hashes, WINDOW)
    if not len(windows):
        return np.zeros(len(hashes), bool)
    at = np.flatnonzero(arrays.same_text(text_of, WINDOW))
    keys = arrays.mix(windows[at] + text_of[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(keys)
    begins = arrays.group_starts(keys[order])
    sizes = np.diff(np.append(begins, len(order)))
    return arrays.covered(len(hashes), at[order[np.repeat(sizes > 1, sizes)]], WINDOW)


def _measure(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    n = len(offsets) - 1

    def per_text(flags: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    start, end, text_of = arrays.word_bounds(data, offsets)
    hashes = arrays.word_hashes(data, start, end)
    points = (data & 0xC0) != 0x80
    breaks = np.zeros(256, bool)
    breaks[0x0A] = True
    line_start, line_end, line_text = arrays.word_bounds(data, offsets, breaks)
    words_before = np.searchsorted(start, line_start)
    worded = np.searchsorted(start, line_end) > words_before
    line_start, line_end, line_text = line_start[worded], line_end[worded], line_text[worded]
    keys = arrays.mix(arrays.word_hashes(data, line_start, line_end) + line_text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(keys, kind="stable")
    later = np.ones(len(order), bool)
    later[arrays.group_starts(keys[order])] = False
    repeated = _repeated(hashes, text_of)
    return [
        np.bincount(text_of, minlength=n),
        per_text(points & ~arrays.SPACE[data]),
        per_text(_SYMBOL[data]),
        np.bincount(line_text[order[later]], minlength=n),
        np.bincount(text_of[repeated], minlength=n),
        per_text(_UPPER[data]),
        per_text(_LETTER[data] & points | (data >= 0xC0)),
        per_text(points),
        np.bincount(line_text, minlength=n),
    ]


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, data, offsets in arrays.slices(batches):
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), part.column("digest"), *(pa.array(x.astype(np.int64)) for x in _measure(data, offsets))], ["doc_id", "digest", *_STATS, "n_lines"]
        )


def measure(docs: DataFrame) -> DataFrame:
    """Counts of every document and a hash of its text, in one pass without a shuffle."""
    texts = plain_documents(docs).withColumn("digest", F.xxhash64("text"))
    return texts.mapInArrow(_stats, ", ".join(f"{c} long" for c in ("doc_id", "digest", *_STATS, "n_lines")))


def _share(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))


def _measures() -> dict[str, Column]:
    return {
        "symbol_share": _share("n_symbols", "n_chars_all"),
        "dup_line_share": _share("n_dup_lines", "n_lines"),
        "repeat_share": _share("n_repeat_words", "n_words"),
        "word_length": F.least(_share("word_chars", "n_words") / 20, F.lit(1.0)),
        "shout_share": _share("n_upper", "n_letters"),
        "odd_share": 1 - F.least(_share("n_letters", "word_chars"), F.lit(1.0)),
    }


def _stratum() -> Column:
    band = F.lit(0)
    for i, least in enumerate(BAND_STARTS[1:], 1):
        band = F.when(F.col("n_words") >= least, i).otherwise(band)
    return band


def _base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _binomial_at_most(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p)."""
    terms = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(terms)
    return min(1.0, math.exp(top) * math.fsum(math.exp(t - top) for t in terms))


def upper_bound(k: int, n: int, delta: float) -> float:
    """Exact upper confidence bound of a rate of which k of n were seen (Clopper-Pearson), at confidence 1 - delta."""
    if k >= n:
        return 1.0
    low, high = k / n, 1.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if 0 < middle < 1 and _binomial_at_most(k, n, middle) > delta else (low, middle)
    return high


def _within(k: int, n: int, alpha: float, delta: float) -> bool:
    """Whether the upper bound is at most alpha, without computing it."""
    return k < n * alpha and _binomial_at_most(k, n, alpha) <= delta


def best_cutoff(good: list[int], bad: list[int], n_good: int, alpha: float, delta: float) -> int | None:
    """Which cutoff to use, if any, given how many good and bad documents each rejects; cutoffs ascend."""
    best = None
    for i in reversed(range(len(good))):
        if not _within(good[i], n_good, alpha, delta):
            break
        if bad[i] > (bad[best] if best is not None else 0):
            best = i
    return best


def select_cutoffs(stats: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """stratum, measure, cutoff, n_good, good_rejected, bad_rejected, false_rejection_bound of each rule in use.

    stats come from measure(). Only documents that pass the base rules count, as the others are rejected anyway. What
    reaches the driver is one count per stratum, measure and cutoff.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality IN (0, 1)")
    texts = stats.join(known, "doc_id").where(~_base_failed()).groupBy("digest", *_STATS, "n_lines").agg(F.max("quality").alias("quality"))
    held = texts.select(_stratum().alias("stratum"), "quality", *(v.alias(k) for k, v in _measures().items()))
    # The number of cutoffs that a measure exceeds tells which of them reject; its histogram is all that is needed.
    step = CUTOFFS[0]
    level = {m: F.least(F.greatest(F.ceil(F.round(F.col(m) / step, 6)) - 1, F.lit(0)), F.lit(len(CUTOFFS))).cast("int") for m in MEASURES}
    rows = (
        held.select("stratum", "quality", F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), level[m].alias("level")) for m in MEASURES))).alias("x"))
        .groupBy("stratum", "x.measure", "x.level")
        .agg(F.sum(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.sum(F.when(F.col("quality") == 0, 1).otherwise(0)).alias("bad"))
        .collect()
    )
    counts = np.zeros((len(BAND_STARTS), len(MEASURES), len(CUTOFFS) + 1, 2), np.int64)
    for r in rows:
        counts[r.stratum, MEASURES.index(r.measure), r.level] += (r.good, r.bad)
    chosen = []
    for s in range(len(BAND_STARTS)):
        for m, name in enumerate(MEASURES):
            above = counts[s, m, ::-1].cumsum(axis=0)[::-1]  # above[i]: documents of level i or more
            i = best_cutoff(above[1:, 0].tolist(), above[1:, 1].tolist(), int(above[0, 0]), alpha / len(MEASURES), delta / RULES)
            if i is not None:
                n_good, good, bad = int(above[0, 0]), int(above[i + 1, 0]), int(above[i + 1, 1])
                chosen.append((s, name, float(CUTOFFS[i]), n_good, good, bad, upper_bound(good, n_good, delta / RULES)))
    schema = "stratum int, measure string, cutoff double, n_good long, good_rejected long, bad_rejected long, false_rejection_bound double"
    return stats.sparkSession.createDataFrame(chosen, schema)


def apply_rules(stats: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Adds base_failed, rejected_by (measures above their cutoffs) and kept to the counts."""
    rules = [(r.stratum, r.measure, r.cutoff) for r in cutoffs.collect()]  # at most one per stratum and measure
    measures = _measures()
    hits = [F.when((_stratum() == s) & (F.round(measures[m], 6) > c), F.lit(m)) for s, m, c in rules]
    rejected = F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")
    judged = stats.withColumn("base_failed", _base_failed()).withColumn("rejected_by", rejected)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))


def judge(docs: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    stats = stored(measure(docs))
    judged = apply_rules(stats, select_cutoffs(stats, labels, alpha, delta))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.concat_ws(",", "rejected_by").alias("rejected_by"))
