"""Spelling variants: words that one inserted, deleted or replaced code point turns into a more frequent word.

Words and their counts come from all texts by built-in functions and one aggregation. Near words are found by dense
tiling. Two words are one edit apart if their common prefix and common suffix together reach the longer length minus one,
and their lengths differ by one at most. The longer length L is cut into PARTS segments; an edit lies in one of them, so
near words share what stands before and behind that segment. Each word goes under those ends, once for its own length and
once as the shorter one of a pair. Words under the same ends are tiles: padded matrices of code points, compared block by
block. A pair is found once, where the end of its common prefix lies. Ends that very many words share are cut into
blocks, and each pair of blocks is a tile of its own, so that no task holds more than two blocks of one key.

A tile returns one row per word: how many near words it saw, and the most frequent of them. So no pairs are written. Ties
go to the word first in code-point order. Roots are looked up by doubling: forms are at least `factor` times as frequent,
so chains are short.

Null texts have no words, a null doc_id counts as an empty string in the rule that misspells (see `words_of`), repeated rows count
as often as they occur, and other columns are ignored. A text may be of any length; a word too, blocks of long ones hold fewer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.llm.groups import starts, whole_groups
from runledger.llm.storage import stored

#: Segments that a word is cut into.
PARTS = 3
#: Words in a block, and code points in it unless a single word has more.
BLOCK, BLOCK_CELLS = 256, 1 << 15
#: Rows of tiles that are handled together, and cells that are compared at once.
PACK, CELLS = 4096, 1 << 22
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOUND = "word string, n_near long, best_n long, best string"


def words_of(docs: DataFrame, letters: str = r"A-Za-zÀ-ÿ", shortest: int = 6, misspelt: int = 199) -> DataFrame:
    """The words of all texts, one row for each occurrence. A run of letters whose checksum with the doc_id is divisible by
    ``misspelt`` loses the code point that the checksum names."""
    # Runs that stay too short whatever happens are not made rows.
    runs = F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"[{letters}]{{{shortest},}}"), F.lit(0)))
    run, number = F.col("run"), F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))
    lowered = F.when(F.octet_length(run) == F.length(run), F.lower(run)).otherwise(F.translate(run, UPPER, LOWER))
    rows = docs.select(number.alias("number"), runs.alias("run")).select("number", lowered.alias("run"))
    rows = rows.select("run", F.crc32(F.concat("number", F.lit(":"), run)).alias("h"))
    at = F.pmod("h", F.length(run)).cast("int")
    spelt = F.when(F.col("h") % misspelt == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)
    return rows.select(spelt.alias("word")).where(F.length("word") >= shortest)


def _ends(longer: Column, part: int) -> Column:
    """Hash of what a word shares with a near one if the longer length is this and the edit lies in this segment."""
    begin, end = F.floor(longer * part / PARTS).cast("int"), F.floor(longer * (part + 1) / PARTS).cast("int")
    word, back = F.col("word"), longer.cast("int") - end
    return F.xxhash64(longer, F.lit(part), F.substring(word, F.lit(1), begin), F.substring(word, F.length("word") - back + 1, back))


def _matrix(words: list[str], width: int) -> np.ndarray:
    return np.array(words, dtype=f"<U{width}").view(np.uint32).reshape(len(words), width)


def _agreement(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each row of the left and each of the right; padding differs from any code point."""
    same = left[:, None, :] == right[None, :, :]
    first = np.argmin(same, axis=2)
    first[same.all(axis=2)] = left.shape[1]
    return first


def near(words: list[str], tile: np.ndarray, longer: np.ndarray, part: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows a of left and b of right, of one tile, that are one edit apart in the segment of its key."""
    width = int(longer.max()) + 1
    forth, back = _matrix(words, width), _matrix([w[::-1] for w in words], width)
    sizes = np.array([len(w) for w in words])
    rows = max(1, min(len(left), CELLS // width // max(1, min(len(right), CELLS // width))))
    cols = max(1, min(len(right), CELLS // width // rows))
    found = [np.zeros((2, 0), np.int64)]
    for i in range(0, len(left), rows):
        for j in range(0, len(right), cols):
            a, b = left[i : i + rows], right[j : j + cols]
            prefix, suffix = _agreement(forth[a], forth[b]), _agreement(back[a], back[b])
            most = np.maximum(sizes[a][:, None], sizes[b][None, :])
            least = np.minimum(sizes[a][:, None], sizes[b][None, :])
            begin, end = longer[a] * part[a] // PARTS, longer[a] * (part[a] + 1) // PARTS
            good = (prefix + suffix >= most - 1) & (most - least <= 1) & (prefix < most) & (most == longer[a][:, None])
            good &= (tile[a][:, None] == tile[b][None, :]) & (begin[:, None] <= prefix) & (prefix < end[:, None])
            good &= (part[a][:, None] == part[b][None, :]) & (longer[a][:, None] == longer[b][None, :])
            x, y = np.nonzero(good)
            found.append(np.stack([a[x], b[y]]))
    return tuple(np.concatenate(found, axis=1))


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in whole_groups(batches, ["key", "row", "col"], PACK):
        words = table.column("word").to_pylist()
        row, col, block, n, longer, part = (table.column(c).to_numpy() for c in ("row", "col", "block", "n", "longer", "part"))
        begins = starts(table, ["key", "row", "col"])
        bounds = [*begins.tolist(), len(words)]
        tile = np.repeat(np.arange(len(begins)), np.diff(bounds))
        pairs = [np.zeros((2, 0), np.int64)]
        begin = 0
        for end, after in zip(bounds[1:], [*bounds[2:], None], strict=True):
            # Small tiles share a matrix as long as it stays small.
            if after is not None and after - begin <= BLOCK // 2 and row[begin] == col[begin] and row[end] == col[end] and int(longer[begin:after].max()) * (after - begin) <= BLOCK_CELLS:
                continue
            every = np.arange(end - begin)
            if row[begin] == col[begin]:
                a, b = near(words[begin:end], tile[begin:end], longer[begin:end], part[begin:end], every, every)
                a, b = a[a < b], b[a < b]
            else:
                first = block[begin:end] == row[begin]
                a, b = near(words[begin:end], tile[begin:end], longer[begin:end], part[begin:end], every[first], every[~first])
            pairs.append(np.stack([a, b]) + begin)
            begin = end
        a, b = np.concatenate(pairs, axis=1)
        yield _best(words, n, np.concatenate([a, b]), np.concatenate([b, a]))


def _best(words: list[str], n: np.ndarray, of: np.ndarray, other: np.ndarray) -> pa.RecordBatch:
    """For each word with near ones their number and the most frequent one."""
    best: dict[str, list] = {}
    for w, o, count in zip((words[i] for i in of), (words[i] for i in other), n[other].tolist(), strict=True):
        held = best.get(w)
        if held is None:
            best[w] = [1, count, o]
        else:
            held[0] += 1
            if (-count, o) < (-held[1], held[2]):
                held[1:] = count, o
    columns = [list(best), *([x[i] for x in best.values()] for i in range(3))]
    types = [pa.string(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["word", "n_near", "best_n", "best"])


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, best_n and best: how many near words each word with any has, and the most frequent one."""
    length = F.length("word")
    keyed = [
        words.select("word", "n", (length + more).alias("longer"), F.lit(part).alias("part"), _ends(length + more, part).alias("key"))
        for more in (0, 1)
        for part in range(PARTS)
    ]
    rows = keyed[0]
    for more in keyed[1:]:
        rows = rows.unionByName(more)
    # Under each key there are words of the longer length and words that are one shorter.
    sizes = rows.groupBy("key").agg(F.count("*").alias("words"), F.count_if(F.length("word") == F.col("longer")).alias("whole")).where("words > 1 AND whole > 0")
    per_block = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(BLOCK_CELLS / F.col("longer"))))
    dealt = rows.join(sizes, "key").withColumn("blocks", F.ceil(F.col("words") / per_block).cast("int"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("word"), "blocks").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    tiles = dealt.select("key", "word", "n", "longer", "part", "block", other.alias("other"))
    tiles = tiles.select("key", F.least("block", "other").alias("row"), F.greatest("block", "other").alias("col"), "block", "word", "n", "longer", "part")
    where = ["key", "row", "col"]
    found = tiles.repartition(*where).sortWithinPartitions(*where).mapInArrow(_tiles, _FOUND)
    best = F.min_by(F.struct("best_n", "best"), F.struct(-F.col("best_n"), F.col("best")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", "best.best_n", "best.best")


def _roots(forms: DataFrame) -> DataFrame:
    """word and root of the words that have a form: each step doubles how far a word looks."""
    current = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        above = current.select(F.col("word").alias("root"), F.col("root").alias("above"))
        current = stored(current.join(above, "root", "left").select("word", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")))
        if not current.where("moved").limit(1).count():
            return current.drop("moved")
        current = current.drop("moved")


def variants(words: DataFrame, least: int = 5, factor: int = 5) -> DataFrame:
    """word, form, root, n, n_near and form_n of the words that occur at least ``least`` times."""
    counted = stored(words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least))
    close = near_words(counted)
    has = F.col("best_n") >= F.col("n") * factor
    formed = stored(
        counted.join(close, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best")).alias("form"), F.when(has, F.col("best_n")).alias("form_n")
        )
    )
    rooted = _roots(formed.where("form IS NOT NULL"))
    return formed.join(rooted, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def group_spellings(docs: DataFrame) -> DataFrame:
    """Spelling variants among the words of all texts."""
    return variants(words_of(docs))
