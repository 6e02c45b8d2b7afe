"""Best-fit packing of token pieces into sequences, after Martello and Toth's dominance reduction.

How many pieces there are of each length describes the whole instance, and that histogram has as many entries as a
sequence has tokens. On it the driver first fixes dominating sets for good: a piece with one that fills its sequence
exactly, a piece that nothing fits beside, a piece with the longest other that fits if no two would fit or if that one
is as long as any two that fit. Every way to fill a sequence with that piece could be exchanged for the fixed one
without needing more sequences. What remains is packed best-fit, longest first. Both steps work on runs of equal pieces,
so the plan has few entries whatever the number of documents. Spark ranks the pieces of each length, in blocks so that a
frequent length is spread over tasks, and looks up their places.

Null and empty texts are one piece that holds the end id. Repeated rows are packed each. Clashing columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from runledger.llm.storage import plain_documents, stored
from runledger.llm.tokens import encoder, tokenizer_path

CAPACITY = 2048
#: Pieces ranked together.
BLOCK_ROWS = 10_000
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """Every document's ids and the end id, cut where longer than a sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path), np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            doc, number, start, length, crc = [], [], [], [], []
            texts = [text or "" for text in batch.column("text").to_pylist()]
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode(texts), strict=True):
                ids += end
                for i, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    doc.append(doc_id), number.append(i), start.append(at // 4), length.append(len(part) // 4), crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(number, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return plain_documents(docs).mapInArrow(run, _PIECES)


class Plan:
    """Slots: the pieces of one length with ranks from first_rank on go to sequences from first_sequence on, at one offset."""

    def __init__(self, counts: np.ndarray, capacity: int = CAPACITY) -> None:
        """counts[n]: pieces of length n."""
        self.capacity, self.left = capacity, counts.astype(np.int64).copy()
        self.used = np.zeros(capacity + 1, np.int64)
        self.slots: list[tuple[int, int, int, int]] = []  # length, first rank, first sequence, offset
        self.n_sequences = 0
        self._reduce()
        self.n_fixed = self.n_sequences
        self._best_fit()
        self.slots.sort()
        self.keys = np.array([length << 44 | rank for length, rank, _, _ in self.slots], np.int64)
        self.where = np.array([s for s in self.slots], np.int64).reshape(-1, 4)

    def _put(self, length: int, times: int, sequence: int, offset: int) -> None:
        self.slots.append((length, int(self.used[length]), sequence, offset))
        self.used[length] += times
        self.left[length] -= times

    def _fix(self, lengths: tuple[int, ...], times: int) -> None:
        offset = 0
        for length in lengths:
            self._put(length, times, self.n_sequences, offset)
            offset += length
        self.n_sequences += times

    def _longest(self, limit: int) -> int:
        """The longest remaining length up to limit, or 0."""
        there = np.flatnonzero(self.left[: limit + 1])
        return int(there[-1]) if len(there) else 0

    def _smallest(self, n: int) -> list[int]:
        """Lengths of the n smallest remaining pieces."""
        found: list[int] = []
        for length in np.flatnonzero(self.left)[:n]:
            found += [int(length)] * min(n - len(found), int(self.left[length]))
        return found[:n]

    def _longest_pair(self, limit: int) -> int:
        best, there = 0, np.flatnonzero(self.left[: limit + 1])
        low, high = 0, len(there) - 1
        while low <= high:
            total = int(there[low] + there[high])
            if total > limit or (low == high and self.left[there[low]] < 2):
                high -= 1
            else:
                best, low = max(best, total), low + 1
        return best

    def _reduce(self) -> None:
        for length in range(self.capacity, 0, -1):
            while self.left[length]:
                room = self.capacity - length
                self.left[length] -= 1  # the piece itself; what is beside it is another one
                other, small = self._longest(room), self._smallest(3)
                pair = self._longest_pair(room) if other and other < room and sum(small[:2]) <= room and sum(small) > room else None
                self.left[length] += 1
                if not other:
                    self._fix((length,), int(self.left[length]))
                elif other == room or len(small) < 2 or sum(small[:2]) > room or (pair is not None and pair <= other):
                    times = self.left[length] // 2 if other == length else min(self.left[length], self.left[other])
                    # Unless the sequence is full, using up the smallest pieces can change what fits: one at a time.
                    self._fix((length, other), int(times) if other == room or other > max(small, default=0) else 1)
                else:
                    break

    def _best_fit(self) -> None:
        rooms: dict[int, list[tuple[int, int]]] = {}  # free tokens: runs of sequences (first, how many)
        open_rooms = np.zeros(self.capacity + 1, bool)

        def free(room: int, first: int, times: int) -> None:
            if room and times:
                rooms.setdefault(room, []).append((first, times))
                open_rooms[room] = True

        for length in range(self.capacity, 0, -1):
            while self.left[length]:
                there = np.flatnonzero(open_rooms[length:])
                if len(there):
                    room = length + int(there[0])
                    first, many = rooms[room].pop()
                    open_rooms[room] = bool(rooms[room])
                    times = int(min(many, self.left[length]))
                    self._put(length, times, first, self.capacity - room)
                    free(room - length, first, times)
                    free(room, first + times, many - times)
                else:
                    full = self.capacity // length
                    whole, rest = divmod(int(self.left[length]), full)
                    for times, per in ((whole, full), (1, rest)):
                        if times and per:
                            first, self.n_sequences = self.n_sequences, self.n_sequences + times
                            for i in range(per):
                                self._put(length, times, first, i * length)
                            free(self.capacity - per * length, first, times)

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slot = self.where[np.searchsorted(self.keys, length << 44 | rank, side="right") - 1]
        return slot[:, 2] + rank - slot[:, 1], slot[:, 3]


def plan_for(cut: DataFrame, capacity: int = CAPACITY) -> Plan:
    counts = np.zeros(capacity + 1, np.int64)
    for row in cut.groupBy("length").count().collect():  # as many rows as lengths, at most capacity
        counts[row["length"]] = row["count"]
    return Plan(counts, capacity)


def ranked(cut: DataFrame) -> DataFrame:
    """Adds the rank (from 0) of each piece among those of its length."""
    blocks = max(1, cut.count() // BLOCK_ROWS + 1)
    dealt = cut.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(blocks)))
    within = Window.partitionBy("length", "block").orderBy("doc_id", "piece", "ids_crc32")
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("length", "block").count().select("length", "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    return dealt.withColumn("within", F.row_number().over(within)).join(counts, ["length", "block"]).withColumn("rank", F.col("before") + F.col("within") - 1).drop("block", "within", "before")


def pack(docs: DataFrame, path: str | None = None, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    cut = stored(pieces(docs, path or tokenizer_path("word_bpe_49k.json"), end_id, capacity))
    plan = plan_for(cut, capacity)

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset = plan.place(length.to_numpy(), rank.to_numpy())
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    placed = ranked(cut).withColumn("place", place("length", "rank"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "place.sequence_id", "place.offset")
