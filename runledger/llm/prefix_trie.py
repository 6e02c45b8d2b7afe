"""A trie of conversations: what prefixes they share, and what storing each shared prefix once saves.

A node is a sequence of turns. Its name is a chain of MD5 sums over role and text, computed as a stream over the sorted
turns of a conversation. Nodes are counted by one aggregation, the rows of a hot node in parts first. Then the trie is cut
into shards. A node that has at most `heavy` members is on level 0, one with at most heavy^2 on level 1, and so on. Going down a
path levels never rise, so each level is a forest of small subtrees, and a tree of it has at most `heavy` times the longest
conversation nodes. Whole trees are dealt over tasks and packed into shards.

A shard is one string of balanced parentheses. The excess of open over closed ones is kept in blocks with their minima in
a tree above (range min-max). findclose gives the end of each subtree, the rank of "()" pairs up to there counts its
leaves, and differences of cumulative arrays add up its savings. Trees of a level hang on nodes of higher levels: their
sums are added to that shared spine when its level is next, so spines merge from the bottom up in as many rounds as there
are levels, that is by the logarithm of the number of conversations.

Null roles and texts are empty. Turns are ordered by number, null first, equal numbers by the MD5 sum of role and text, or by
role and text themselves where that is asked for; repeated rows are repeated turns. Rows without conv_id are not part of any conversation. Other columns are ignored. A
conversation of any length is one stream through one task, in bounded memory; its turns are 16 bytes each there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runledger.llm.groups import starts, whole_groups
from runledger.llm.storage import stored

#: Most members of a node on the lowest level.
HEAVY = 4096
#: Parts in which the members of a node are counted first.
PARTS = 64
#: Nodes of a shard, about, and parentheses in a block of its excess.
SHARD, EXCESS_BLOCK = 20_000, 256
#: Members whose numbers are put together as one text before they are hashed.
PIECE = 4096
ROOT = hashlib.md5(b"").digest()
_TURN = ["conv_id", "depth", "turn", "words"]
_CHAINED = "conv_id long, depth long, node binary, words long, last boolean"
_PLACED = "node binary, conv_id long, depth long, words long, n_convs long, parent binary, parent_conv_id long, level int, parent_level int, tree binary"
_SUMS = "node binary, parent binary, parent_level int, n_leaves long, saved_tokens long, top boolean"


def turns(conversations: DataFrame, by_text: bool = False) -> DataFrame:
    """conv_id, place from 1, MD5 sum and words of each turn. Turns of one number are ordered by their MD5 sum, which
    keeps texts out of the shuffle, or ``by_text``: by role and text, null last, as SQL orders them."""
    told = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("number"),
        *(F.col(c).cast("string").alias(c) for c in ("role", "text")),
    )
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turn = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))).alias("turn")
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words")
    ties = [F.col("role").asc_nulls_last(), F.col("text").asc_nulls_last()] if by_text else ["turn"]
    if not by_text:
        told = told.select("conv_id", "number", turn, words)
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("number").asc_nulls_first(), *ties))
    placed = told.withColumn("depth", place.cast("long"))
    return placed.select("conv_id", "depth", *((turn, words) if by_text else ("turn", "words")))


def rebuilt(rows: DataFrame, every: int = 20, most: int = 3, toward_zero: bool = False) -> DataFrame:
    """Each conversation with its first turns replaced by those of the one that starts its block of ``every`` ids. How many
    follows from a checksum of its id, ``most`` at the most. A conversation without turns has one row of depth 0. Blocks of
    negative ids start at their smallest id, or ``toward_zero`` at their largest one, as with the remainder of SQL."""
    first = F.col("conv_id") - (F.col("conv_id") % F.lit(every) if toward_zero else F.pmod("conv_id", F.lit(every)))
    ids = rows.select("conv_id").distinct().select("conv_id", first.alias("first_id"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).alias("h"))
    heads = rows.where((F.pmod("conv_id", F.lit(every)) == 0) & (F.col("depth") <= most))
    heads = heads.groupBy(F.col("conv_id").alias("first_id")).agg(F.array_sort(F.collect_list(F.struct("depth", "turn", "words"))).alias("head"))
    empty = F.array().cast("array<struct<depth:bigint,turn:binary,words:bigint>>")
    taken = F.slice(F.coalesce("head", empty), F.lit(1), F.col("h").cast("int"))
    headed = ids.join(heads, "first_id", "left").select("conv_id", "h", taken.alias("head"))
    shift = rows.join(headed.select("conv_id", "h", F.size("head").alias("taken")), "conv_id").where(F.col("depth") > F.col("h"))
    own = shift.select("conv_id", (F.col("depth") - F.col("h") + F.col("taken")).alias("depth"), "turn", "words")
    copied = headed.select("conv_id", F.explode("head").alias("x")).select("conv_id", "x.depth", "x.turn", "x.words")
    top = ids.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(ROOT).alias("turn"), F.lit(0).cast("long").alias("words"))
    return own.unionByName(copied).unionByName(top)


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Names the node of each row; the row before decides whether a conversation goes on. Depth 0 is the root."""
    held, node = None, ROOT
    for batch in batches:
        out: list[tuple] = []
        for row in zip(*(batch.column(c).to_pylist() for c in _TURN), strict=True):
            if held is not None:
                out.append((*held, held[0] != row[0]))
            node = hashlib.md5(node + row[2]).digest() if row[1] else ROOT
            held = row[0], row[1], node, row[3]
        yield _batch(out, _CHAINED)
    if held is not None:
        yield _batch([(*held, True)], _CHAINED)


_TYPES = {"long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "int": pa.int32(), "string": pa.string()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[t]) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def level_of(members: int, heavy: int) -> int:
    level, most = 0, heavy
    while members > most:
        level, most = level + 1, most * heavy
    return level


def _place(heavy: int):
    """Follows each conversation down and tells where its nodes hang: parent, level, and the top of their tree. A node is
    placed by its smallest member only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent, tree = None, b""
        for batch in batches:
            out: list[tuple] = []
            for conv, depth, node, words, n, least in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "depth", "node", "words", "n_convs", "least")), strict=True):
                level = level_of(n, heavy)
                above = parent if depth else (None, None, None)
                if not depth or level != above[2]:
                    tree = node
                if conv == least:
                    out.append((node, conv, depth, words, n, above[0], above[1], level, above[2], tree))
                parent = node, least, level
            yield _batch(out, _PLACED)

    return run


class Excess:
    """Balanced parentheses with a range min tree over blocks of their excess."""

    def __init__(self, opens: np.ndarray, block: int = EXCESS_BLOCK) -> None:
        self.opens, self.block = opens, block
        self.excess = np.cumsum(np.where(opens, 1, -1))
        n = max(1, -(-len(opens) // block))
        size = 1 << (n - 1).bit_length()
        padded = np.full(size * block, np.iinfo(np.int64).max)
        padded[: len(opens)] = self.excess
        self.padded = padded.reshape(size, block)
        least = self.padded.min(axis=1)
        self.tree = [least]
        while len(least) > 1:
            least = least.reshape(-1, 2).min(axis=1)
            self.tree.append(least)

    def _in_block(self, block: np.ndarray, after: np.ndarray, target: np.ndarray) -> np.ndarray:
        """First place in the block, from ``after`` on, where the excess is at most the target; -1 if there is none."""
        found = np.full(len(block), -1)
        for at in range(0, len(block), 4096):
            part = slice(at, at + 4096)
            hit = (self.padded[block[part]] <= target[part, None]) & (np.arange(self.block) >= after[part, None])
            any_hit = hit.any(axis=1)
            found[part][any_hit] = (block[part] * self.block + hit.argmax(axis=1))[any_hit]
        return found

    def findclose(self, at: np.ndarray) -> np.ndarray:
        """Where each open parenthesis is closed: the first later place whose excess is one below its own."""
        target = self.excess[at] - 1
        close = self._in_block(at // self.block, at % self.block + 1, target)
        rest = np.flatnonzero(close < 0)
        if len(rest):
            # Up until a right sibling has a minimum that is low enough, then down to the first block that has.
            block, level, aim = at[rest] // self.block, np.zeros(len(rest), np.int64), target[rest]
            searching = np.ones(len(rest), bool)
            for height, least in enumerate(self.tree):
                sibling = np.minimum(block + 1, len(least) - 1)
                hit = searching & (block % 2 == 0) & (block + 1 < len(least)) & (least[sibling] <= aim)
                level[hit], block[hit] = height, block[hit] + 1
                searching &= ~hit
                block[searching] //= 2
            for height in range(len(self.tree) - 1, 0, -1):
                down = level == height
                child = block * 2
                least = self.tree[height - 1]
                right = down & (least[np.minimum(child, len(least) - 1)] > aim)
                block[down] = child[down] + right[down]
                level[down] -= 1
            close[rest] = self._in_block(block, np.zeros(len(rest), np.int64), aim)
        return close


def parentheses(parent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each parenthesis opens, and the node it belongs to, of a forest given by parents (-1 for tops)."""
    children: list[list[int]] = [[] for _ in parent]
    stack = []
    for node, above in enumerate(parent.tolist()):
        (children[above] if above >= 0 else stack).append(node)
    opens, of = np.zeros(2 * len(parent), bool), np.zeros(2 * len(parent), np.int64)
    at, stack = 0, stack[::-1]
    while stack:
        node = stack.pop()
        if node >= 0:
            opens[at], of[at] = True, node
            stack.append(~node)
            stack.extend(reversed(children[node]))
        else:
            of[at] = ~node
        at += 1
    return opens, of


def subtree_sums(parent: np.ndarray, leaves: np.ndarray, saved: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leaves and savings of each node's subtree. leaves and saved are what hangs on a node besides its children here and
    what it saves itself; inner nodes are no leaves even where they have no children here."""
    opens, of = parentheses(parent)
    at = np.flatnonzero(opens)
    close = Excess(opens).findclose(at)
    pair = np.zeros(len(opens), np.int64)
    pair[:-1] = opens[:-1] & ~opens[1:]
    pair[inner[of]] = 0
    rank = np.concatenate([[0], np.cumsum(pair)])
    hung, gain = (np.concatenate([[0], np.cumsum(np.where(opens, x[of], 0))]) for x in (leaves, saved))
    n_leaves, n_saved = np.zeros(len(parent), np.int64), np.zeros(len(parent), np.int64)
    n_leaves[of[at]] = rank[close] - rank[at] + hung[close] - hung[at]
    n_saved[of[at]] = gain[close] - gain[at]
    return n_leaves, n_saved


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in whole_groups(batches, ["of_tree"], SHARD):
        node, above, depth = (table.column(c).to_pylist() for c in ("node", "parent", "depth"))
        tops = [t == n for t, n in zip(table.column("tree").to_pylist(), node, strict=True)]
        known = {n: i for i, n in enumerate(node)}
        parent = np.array([-1 if top else known[a] for a, top in zip(above, tops, strict=True)])
        words, n_convs, leaves, saved, children = (table.column(c).to_numpy() for c in ("words", "n_convs", "hung_leaves", "hung_saved", "n_children"))
        n_leaves, n_saved = subtree_sums(parent, leaves, saved + (n_convs - 1) * words, children > 0)
        columns = [table.column("node"), table.column("parent"), table.column("parent_level"), pa.array(n_leaves), pa.array(n_saved), pa.array(tops)]
        yield from pa.table(columns, ["node", "parent", "parent_level", "n_leaves", "saved_tokens", "top"]).combine_chunks().to_batches()


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The numbers of members in order, put together."""
    for batch in batches:
        out, node, held = [], None, []
        for n, conv in zip(batch.column("node").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if held and (n != node or len(held) >= PIECE):
                out.append((node, held[0], ",".join(map(str, held))))
                held = []
            node = n
            held.append(conv)
        if held:
            out.append((node, held[0], ",".join(map(str, held))))
        yield _batch(out, "node binary, first long, text string")


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    node, digest = None, None
    for batch in batches:
        out = []
        for n, text in zip(batch.column("node").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if n != node:
                if node is not None:
                    out.append((node, digest.hexdigest()))
                node, digest = n, hashlib.sha256(text.encode())
            else:
                digest.update(b"," + text.encode())
        yield _batch(out, "node binary, ends_sha256 string")
    if node is not None:
        yield _batch([(node, digest.hexdigest())], "node binary, ends_sha256 string")


def _counted(chained: DataFrame, parts: int) -> DataFrame:
    """The rows of the chain with the number of members of their node and the smallest one. Rows of a hot node stay dealt."""
    dealt = chained.withColumn("part", F.pmod(F.xxhash64("conv_id"), F.lit(parts)).cast("int"))
    per_part = dealt.groupBy("node", "part").agg(F.count("*").alias("n"), F.min("conv_id").alias("low"))
    whole = per_part.groupBy("node").agg(F.sum("n").alias("n_convs"), F.min("low").alias("least"))
    sums = per_part.select("node", "part").join(whole, "node")
    return dealt.join(sums, ["node", "part"]).select("conv_id", "depth", "node", "words", "n_convs", "least")


def nodes(rows: DataFrame, heavy: int = HEAVY, parts: int = PARTS) -> tuple[DataFrame, DataFrame]:
    """The nodes of the trie over conv_id, depth, turn and words, where each conversation has a row of depth 0; and the
    conversations that end at each node (node, conv_id)."""
    chained = stored(rows.repartition("conv_id").sortWithinPartitions("conv_id", "depth").mapInArrow(_chain, _CHAINED))
    counted = _counted(chained.drop("last"), parts)
    placed = stored(counted.repartition("conv_id").sortWithinPartitions("conv_id", "depth").mapInArrow(_place(heavy), _PLACED))
    children = placed.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    tree = stored(placed.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long")))
    levels = (placed.agg(F.max("level")).first()[0] or 0) + 1
    done: list[DataFrame] = []
    for level in range(levels):
        here = tree.where(F.col("level") == level)
        hung = _union([d.where(F.col("top") & (F.col("parent_level") == level)) for d in done])
        if hung is not None:
            hung = hung.groupBy(F.col("parent").alias("node")).agg(F.sum("n_leaves").alias("hung_leaves"), F.sum("saved_tokens").alias("hung_saved"))
            here = here.join(hung, "node", "left")
        else:
            here = here.withColumn("hung_leaves", F.lit(None).cast("long")).withColumn("hung_saved", F.lit(None).cast("long"))
        columns = ["node", "parent", "parent_level", "depth", "tree", "words", "n_convs", "n_children"]
        here = here.select(*columns, *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("hung_leaves", "hung_saved")), F.xxhash64("tree").alias("of_tree"))
        done.append(stored(here.repartition("of_tree").sortWithinPartitions("of_tree", "depth").mapInArrow(_shards, _SUMS)))
    sums = _union(done).select("node", "n_leaves", "saved_tokens")
    found = tree.join(sums, "node").select("node", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
    return found, chained.where("last").select("node", "conv_id")


def _union(frames: list[DataFrame]) -> DataFrame | None:
    out = None
    for frame in frames:
        out = frame if out is None else out.unionByName(frame)
    return out


def ends_of(ends: DataFrame) -> DataFrame:
    """SHA-256 of the numbers of the conversations that end at a node, in order. The numbers are put together in ranges first,
    so that the members of a hot node are sorted by many tasks and hashed as a stream of few rows."""
    pieces = ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(_pieces, "node binary, first long, text string")
    return pieces.repartition("node").sortWithinPartitions("node", "first").mapInArrow(_hashes, "node binary, ends_sha256 string")


def prefix_tree(
    conversations: DataFrame, heavy: int = HEAVY, parts: int = PARTS, by_text: bool = False, toward_zero: bool = False
) -> DataFrame:
    """The nodes of the trie of rebuilt conversations, with a digest of the conversations that end there."""
    found, ends = nodes(rebuilt(stored(turns(conversations, by_text)), toward_zero=toward_zero), heavy, parts)
    none: Column = F.lit(hashlib.sha256(b"").hexdigest())
    return found.join(ends_of(ends), "node", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256")
    )


def conversation_tree(conversations: DataFrame) -> DataFrame:
    """The trie with the order and the remainder of SQL."""
    return prefix_tree(conversations, by_text=True, toward_zero=True)
