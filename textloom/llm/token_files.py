"""Token ids in binary files: one shared zstandard dictionary, each document compressed alone, with an offset index.

A file set is a Parquet table of shards (any Hadoop file system), in ascending doc_id order. A shard's
payload is: magic, version, id width, dictionary hash, document count, (offset, tokens) of each document,
then the frames. A document is read by its offset without touching the others. The dictionary is a table
of one row beside the shards. Frames are compressed before the only large shuffle, a range partitioning by doc_id and, where ids repeat, by content.

Defined results: null text is empty (only the end id); equal doc_ids stand next to each other, ordered by their number
of tokens and a hash of their frame; null doc_ids come first; a text of any length is one frame, encoded whole in one
task; an empty table gives empty files; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, vocab

MAGIC, VERSION = b"LOOMIDS\0", 1
HEAD = struct.Struct("<8sHH32sI")
ENTRY = struct.Struct("<QQ")
#: Documents whose ids train the dictionary, the longest of them, the dictionary's bytes, and the compression level.
SAMPLE_DOCS, SAMPLE_CHARS, DICT_BYTES, LEVEL = 512, 50_000, 32 << 10, 3
#: A shard is closed at so many bytes or documents.
SHARD_BYTES, SHARD_DOCS = 2 << 20, 4096
SHARDS = "shard_part int, shard_no int, first_id long, last_id long, n_docs int, n_tokens long, doc_ids array<long>, payload binary"


def dictionary_of(samples: list[bytes]) -> bytes:
    """A trained dictionary; where there is too little to train on, the samples themselves serve as content."""
    samples = [s[i : i + 8192] for s in samples for i in range(0, len(s), 8192)]
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-DICT_BYTES:] or bytes(8)


def train_dictionary(docs: DataFrame, spec, end_id: int) -> tuple[bytes, int]:
    """The dictionary and the id width, from one task over a bounded sample; spec: the tokenizer's file, broadcast.

    Sampled are the SAMPLE_DOCS different documents of least hashes among those of up to SAMPLE_CHARS characters: the
    dictionary is for short documents. A hash threshold set by the row count keeps each task's share of them small.
    """
    key = F.xxhash64("doc_id", "text")
    fitting = docs.where(F.col("text").isNotNull() & (F.length("text") <= SAMPLE_CHARS))
    picked = fitting.withColumn("key", key).where(common.rarer(F.col("key"), SAMPLE_DOCS, docs.count())).groupBy("key").agg(F.min("text").alias("text"))

    def run(stream):
        encoder = vocab.worker(vocab.Encoder, spec.value)
        rows = sorted(r for batch in stream for r in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True))
        end = end_id.to_bytes(encoder.width, "little")
        content = dictionary_of([encoder.encode(t) + end for _, t in rows[:SAMPLE_DOCS]])
        yield pa.RecordBatch.from_arrays([pa.array([content], pa.binary()), pa.array([encoder.width], pa.int32())], ["dictionary", "width"])

    row = picked.repartition(1).mapInArrow(run, "dictionary binary, width int").first()
    return (bytes(row.dictionary), row.width) if row else (dictionary_of([]), 4)  # no document, no task


def pack(rows: list[tuple[int, int, bytes]], width: int, digest: bytes) -> bytes:
    """rows: doc_id, tokens, frame."""
    at, index = 0, []
    for _, n, frame in rows:
        index.append(ENTRY.pack(at, n))
        at += len(frame)
    return b"".join([HEAD.pack(MAGIC, VERSION, width, digest, len(rows)), *index, *(f for _, _, f in rows)])


def unpack(payload: bytes, digest: bytes) -> tuple[int, list[tuple[int, bytes]]]:
    """The id width, and (tokens, frame) of each document; refuses another format or dictionary."""
    magic, version, width, found, n = HEAD.unpack_from(payload)
    if magic != MAGIC or version != VERSION or found != digest:
        raise ValueError("not a shard of this file set and dictionary")
    index = [ENTRY.unpack_from(payload, HEAD.size + i * ENTRY.size) for i in range(n)]
    base = HEAD.size + n * ENTRY.size
    ends = [*(at for at, _ in index[1:]), len(payload) - base]
    return width, [(t, payload[base + at : base + to]) for (at, t), to in zip(index, ends, strict=True)]


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1) -> None:
    """Writes path/dictionary and path/shards."""
    spark = docs.sparkSession
    common.tidy(spark)
    spec = Path(tokenizer_path).read_text()
    docs = docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text")
    source = spark.sparkContext.broadcast(spec)
    dictionary, width = train_dictionary(docs, source, end_id)
    digest = hashlib.sha256(dictionary).digest()
    spark.createDataFrame([(bytearray(dictionary), digest.hex())], "dictionary binary, sha256 string").coalesce(1).write.mode("overwrite").parquet(f"{path}/dictionary")

    def encode(stream):
        encoder = vocab.worker(vocab.Encoder, source.value)
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary))
        end = end_id.to_bytes(encoder.width, "little")
        for batch in stream:
            raw = [encoder.encode(t or "") + end for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(r) // encoder.width for r in raw], pa.int64()), pa.array([packer.compress(r) for r in raw], pa.binary())],
                ["doc_id", "n_tokens", "frame"],
            )

    scratch = common.Scratch(spark, "ids")
    frames = scratch.table(docs.mapInArrow(encode, "doc_id long, n_tokens long, frame binary"), "frames", "none")
    size = frames.agg(F.sum(F.length("frame").cast("long"))).first()[0] or 0

    def shard(stream):
        part, no, rows, size = TaskContext.get().partitionId(), 0, [], 0

        def close():
            ids = [r[0] for r in rows]
            known = [i for i in ids if i is not None]
            values = [[part], [no], [known[0] if known else None], [known[-1] if known else None], [len(rows)], [sum(r[1] for r in rows)], [ids], [pack(rows, width, digest)]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary()), strict=True)], SHARD_NAMES)

        for batch in stream:
            for row in zip(batch.column("doc_id").to_pylist(), batch.column("n_tokens").to_pylist(), batch.column("frame").to_pylist(), strict=True):
                rows.append(row)
                size += len(row[2])
                if size >= SHARD_BYTES or len(rows) >= SHARD_DOCS:
                    yield close()
                    no, rows, size = no + 1, [], 0
        if rows:
            yield close()

    # rows of one doc_id (or none) may be many: they spread by content, and equal ones by where they were written
    ties = frames.withColumns({"_hash": F.xxhash64("frame"), "_row": F.monotonically_increasing_id()})
    order = ["doc_id", "n_tokens", "_hash", "_row"]
    ordered = ties.repartitionByRange(common.parts(size, 32 << 20, 4), *order).sortWithinPartitions(*order).select("doc_id", "n_tokens", "frame")
    ordered.mapInArrow(shard, SHARDS).write.mode("overwrite").option("compression", "none").parquet(f"{path}/shards")
    scratch.drop("frames")
    source.destroy()


SHARD_NAMES = [x.split()[0] for x in SHARDS.split(", ")]


def _dictionary(spark: SparkSession, path: str) -> tuple[bytes, bytes]:
    row = spark.read.schema("dictionary binary, sha256 string").parquet(f"{path}/dictionary").first()
    content = bytes(row.dictionary)
    if hashlib.sha256(content).hexdigest() != row.sha256:
        raise ValueError("the dictionary was changed")
    return content, bytes.fromhex(row.sha256)


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of each document, from the files.

    Starts: sums by range partition (as many rows as partitions) are added up in one task, then shards within their partition.
    """
    common.tidy(spark)  # batches are cut by bytes: a few shards each
    shards = spark.read.schema(SHARDS).parquet(f"{path}/shards")
    sums = shards.groupBy("shard_part").agg(F.sum("n_tokens").alias("part_tokens"))
    sums = sums.select("shard_part", (F.sum("part_tokens").over(Window.orderBy("shard_part")) - F.col("part_tokens")).alias("part_start"))
    starts = shards.select("shard_part", "shard_no", "n_tokens").join(sums, "shard_part")
    within = F.sum("n_tokens").over(Window.partitionBy("shard_part").orderBy("shard_no")) - F.col("n_tokens")
    starts = starts.select("shard_part", "shard_no", (F.col("part_start") + within).alias("shard_start"))
    content, digest = _dictionary(spark, path)
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    def decode(stream):
        opener = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content))
        for batch in stream:
            for ids, begin, payload in zip(batch.column("doc_ids").to_pylist(), batch.column("shard_start").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                width, docs = unpack(payload, digest)
                starts, counts, sums, lists = [], [], [], []
                for n, frame in docs:
                    wide = np.frombuffer(opener.decompress(frame), f"<u{width}").astype("<u4")
                    if len(wide) != n:
                        raise ValueError("a frame has another number of ids than the index says")
                    starts.append(begin)
                    counts.append(n)
                    sums.append(zlib.crc32(wide.tobytes()))
                    begin += n
                    if with_ids:
                        lists.append(wide.astype(np.int64))
                columns = [pa.array(x, pa.int64()) for x in (ids, starts, counts, sums)] + [pa.array(lists, pa.list_(pa.int64()))] * with_ids
                yield pa.RecordBatch.from_arrays(columns, names)

    joined = shards.select("shard_part", "shard_no", "doc_ids", "payload").join(starts, ["shard_part", "shard_no"])
    return joined.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """The ids of one document (a list for each row of that id): prunes shards by their id range and opens only its frames."""
    content, digest = _dictionary(spark, path)
    opener = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content))
    out = []
    for row in spark.read.schema(SHARDS).parquet(f"{path}/shards").where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id)).orderBy("shard_part", "shard_no").select("doc_ids", "payload").toLocalIterator():
        width, docs = unpack(bytes(row.payload), digest)
        out += [np.frombuffer(opener.decompress(docs[i][1]), f"<u{width}").tolist() for i, x in enumerate(row.doc_ids) if x == doc_id]
    return out
