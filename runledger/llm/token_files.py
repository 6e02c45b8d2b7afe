"""Token ids in binary blocks: each document a zstandard frame of its own, all with one shared dictionary.

A file set is a folder with two tables. `dictionary` holds the dictionary and its SHA-256. `blocks` holds rows of about
BLOCK_BYTES of frames in ascending doc_id order: the hash of the dictionary they need, the doc_ids, the number of ids of
each document, the offset of each frame, and how many ids come before the block in its part. Spark writes both, so a
lost executor's blocks are written again and only whole parts are committed. One document is read by its block's doc_id
range and its offset, without touching its neighbours.

The dictionary is trained on the id arrays of at most SAMPLE_DOCUMENTS documents (those with the smallest hash of their
doc_id); it affects sizes only, and with too few documents for training it is empty. Null and empty texts hold the end
id only. Repeated doc_ids are kept in the order of their texts; null doc_ids come first.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.llm.storage import partitions, plain_documents
from runledger.llm.tokens import encoder, tokenizer_path
from runledger.session import shared_folder

SAMPLE_DOCUMENTS = 256
DICTIONARY_BYTES = 64 << 10
BLOCK_BYTES = 4 << 20
LEVEL = 3
_BLOCK = (
    "part int, block int, first_id long, last_id long, n_ids long, ids_before long, width int, dictionary_sha256 string, "
    "doc_ids array<long>, n_tokens array<int>, offsets array<long>, frames binary"
)


def _serialized(ids: bytes, width: int) -> bytes:
    return ids if width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()


def train_dictionary(docs: DataFrame, path: str, width: int) -> bytes:
    sample = [r.doc_id for r in docs.where("doc_id IS NOT NULL").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCUMENTS).collect()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_serialized(ids, width) for ids in encoder(path)([t or "" for t in batch.column("text").to_pylist()])], pa.binary())], ["ids"])

    rows = docs.where(F.col("doc_id").isin(sample)).mapInArrow(run, "ids binary").limit(2 * SAMPLE_DOCUMENTS).collect() if sample else []
    # Frames hold few ids, so samples of their usual size serve best.
    parts = [bytes(r.ids[at : at + 4096]) for r in rows for at in range(0, len(r.ids), 4096)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, parts).as_bytes()
    except zstandard.ZstdError:  # too few or too uniform samples
        return b""


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if raw else None


def write(docs: DataFrame, folder: str, path: str | None = None, end_id: int = 2) -> None:
    """Encodes every whole text, appends the end id and writes the file set."""
    spark, path = docs.sparkSession, path or tokenizer_path("byte_bpe_50k.json")
    width = 2 if max(encoder(path).tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    plain = plain_documents(docs)
    raw = train_dictionary(plain, path, width)
    digest = hashlib.sha256(raw).hexdigest()
    spark.createDataFrame([(digest, bytearray(raw))], "sha256 string, dictionary binary").coalesce(1).write.parquet(f"{folder}/dictionary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encode, end = TaskContext.get().partitionId(), encoder(path), np.array([end_id], "<u4").tobytes()
        shared = _dictionary(raw)
        compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared) if shared else zstandard.ZstdCompressor(level=LEVEL)
        doc_ids, counts, frames, size, block, before = [], [], [], 0, 0, 0

        def row() -> pa.RecordBatch:
            known = [d for d in doc_ids if d is not None]
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in frames])]).tolist()
            values = [part, block, min(known, default=None), max(known, default=None), sum(counts), before, width, digest, doc_ids, counts, offsets, b"".join(frames)]
            return pa.RecordBatch.from_arrays([pa.array([v], type=t) for v, t in zip(values, types, strict=True)], names)

        for batch in batches:
            texts = [text or "" for text in batch.column("text").to_pylist()]
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode(texts), strict=True):
                ids += end
                frame = compressor.compress(_serialized(ids, width))
                doc_ids.append(doc_id), counts.append(len(ids) // 4), frames.append(frame)
                size += len(frame)
                if size >= BLOCK_BYTES:
                    yield row()
                    before += sum(counts)
                    doc_ids, counts, frames, size, block = [], [], [], 0, block + 1
        if doc_ids:
            yield row()

    names = [c.strip().split(" ")[0] for c in _BLOCK.split(",")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    types = [kinds[c.strip().split(" ")[1]] for c in _BLOCK.split(",")]
    ordered = plain.repartitionByRange(partitions(spark), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    ordered.mapInArrow(run, _BLOCK).write.option("compression", "none").parquet(f"{folder}/blocks")


def _load_dictionary(spark: SparkSession, folder: str) -> tuple[bytes, str]:
    found = spark.read.parquet(f"{folder}/dictionary").first()
    raw = bytes(found.dictionary)
    if hashlib.sha256(raw).hexdigest() != found.sha256:
        raise ValueError(f"the dictionary of {folder} is damaged")
    return raw, found.sha256


def _frames(row: dict, shared: zstandard.ZstdCompressionDict | None, digest: str, wanted: set[int] | None = None) -> Iterator[tuple[int, int | None, np.ndarray]]:
    if row["dictionary_sha256"] != digest:
        raise ValueError("a block needs another dictionary than the one in its folder")
    decompressor = zstandard.ZstdDecompressor(dict_data=shared) if shared else zstandard.ZstdDecompressor()
    kind, frames, offsets = "<u4" if row["width"] == 4 else "<u2", memoryview(row["frames"]), row["offsets"]
    for i, doc_id in enumerate(row["doc_ids"]):
        if wanted is None or doc_id in wanted:
            yield i, doc_id, np.frombuffer(decompressor.decompress(frames[offsets[i] : offsets[i + 1]]), kind).astype("<u4")


def read(spark: SparkSession, folder: str, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id and ids of all documents, or of the few that are named: then only blocks that may hold them are read."""
    raw, digest = _load_dictionary(spark, folder)
    blocks, wanted = spark.read.parquet(f"{folder}/blocks"), set(doc_ids) if doc_ids is not None else None
    if doc_ids is not None:
        hit = F.lit(False)
        for d in doc_ids:
            hit = hit | ((F.col("first_id") <= d) & (F.col("last_id") >= d))
        blocks = blocks.where(hit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = _dictionary(raw)
        for batch in batches:
            for row in batch.to_pylist():
                found = [(d, ids.tolist()) for _, d, ids in _frames(row, shared, digest, wanted)]
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in found], pa.int64()), pa.array([x for _, x in found], pa.list_(pa.int64()))], ["doc_id", "ids"])

    return blocks.mapInArrow(run, "doc_id long, ids array<long>")


def summary(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files. The driver gets one sum per part."""
    raw, digest = _load_dictionary(spark, folder)
    blocks = spark.read.parquet(f"{folder}/blocks")
    begins, total = {}, 0
    for part, n in sorted((r.part, r.n) for r in blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()):
        begins[part], total = total, total + n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = _dictionary(raw)
        for batch in batches:
            for row in batch.to_pylist():
                starts = begins[row["part"]] + row["ids_before"] + np.concatenate([[0], np.cumsum(row["n_tokens"][:-1], dtype=np.int64)])
                read_back = [(len(ids), zlib.crc32(ids.tobytes())) for _, _, ids in _frames(row, shared, digest)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(starts.astype(np.int64)), *(pa.array([x[i] for x in read_back], pa.int64()) for i in (0, 1))],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return blocks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame) -> DataFrame:
    """Writes a file set in the shared folder and summarizes it from what was read back."""
    folder = f"{shared_folder(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write(docs, folder)
    return summary(docs.sparkSession, folder)
