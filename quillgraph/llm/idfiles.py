"""Token-ID output (2): files of range-coded id blocks, and their reader.

Documents are dealt out by ranges of doc_id, tokenized, given an end id, and written in ascending
doc_id order. A file row is a chunk of one range's documents: their ids and lengths, and range-coded blocks
(``rangecoder``) over all their ids, each readable alone and with its own checksum. Rows carry
their range and number, so that readers know the order; where each range starts follows from the
sums of the ranges before it, one number a range.

Files are Parquet with the blocks as binary values: every store that Spark reaches will do, and
writing commits or leaves nothing when an executor is lost.

Null and empty texts have the end id only. Null doc_ids come first; documents of one doc_id are
ordered by text. A chunk ends after the document that brings it to ``CHUNK`` ids, so a longer
document is one chunk. Extra columns are ignored; an empty table makes files without rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernels as K
from .base import bounded_batches, new_path, rough_bytes
from .rangecoder import decode_blocks, encode_blocks
from .tokens import default_path, encoder

END_ID = 1
CHUNK = 8_000_000
RANGE_BYTES = 20 << 20  # of compressed text
MOST_RANGES = 1 << 16  # beyond that many, ranges grow and hold more chunks

DDL = "part int, chunk int, n_ids long, doc_ids array<long>, doc_tokens array<long>, blocks array<binary>"
SCHEMA = pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())), ("blocks", pa.list_(pa.binary()))])


def with_end(ids: np.ndarray, sizes: np.ndarray, end_id: int) -> np.ndarray:
    out = np.full(len(ids) + len(sizes), end_id, np.uint32)
    place = np.ones(len(out), bool)
    place[np.cumsum(sizes + 1) - 1] = False
    out[place] = ids
    return out


def file_writer(path: str, end_id: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, chunk, enc = TaskContext.get().partitionId(), 0, encoder(path)
        names: list = []
        sizes: list[np.ndarray] = []
        held: list[np.ndarray] = []
        n = 0

        def row() -> pa.RecordBatch:
            ids = np.concatenate(held)
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((part, chunk, len(ids), names, np.concatenate(sizes).tolist(), encode_blocks(ids)), SCHEMA)], schema=SCHEMA)

        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for i, j, buf, offsets in K.groups(batch.column(1)):
                ids, own = enc.encode_group(buf, offsets)
                names += doc_ids[i:j]
                sizes.append(own + 1)
                held.append(with_end(ids, own, end_id).astype(np.uint16 if not len(ids) or ids.max() < 1 << 16 else np.uint32))
                n += len(held[-1])
                if n >= CHUNK:
                    yield row()
                    names, sizes, held, n, chunk = [], [], [], 0, chunk + 1
        if held:
            yield row()

    return write


def write_ids(docs: DataFrame, to: str, path: str | None = None, end_id: int = END_ID) -> None:
    bounded_batches(docs.sparkSession)
    parts = min(MOST_RANGES, max(1, -(-rough_bytes(docs) // RANGE_BYTES)))
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = narrow.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    dealt.mapInArrow(file_writer(path or default_path(), end_id), DDL).write.option("compression", "none").parquet(to)


def chunk_ids(blocks: list[bytes]) -> np.ndarray:
    """Ids of a chunk; raises ValueError where a block is damaged."""
    return decode_blocks(blocks)


READ = pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document of chunks; start counts from the chunk's begin."""
    for batch in batches:
        for part, chunk, doc_ids, tokens, blocks in zip(*(batch.column(i) for i in range(5))):
            ids = decode_blocks(blocks.as_py()).astype("<u4")
            raw = ids.data.cast("B")
            ends = np.cumsum(np.array(tokens.as_py(), np.int64))
            if (ends[-1] if len(ends) else 0) != len(ids):
                raise ValueError("documents and ids of a chunk differ in number")
            starts = np.concatenate(([0], ends[:-1]))
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
            n = len(ends)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part.as_py(), np.int32)), pa.array(np.full(n, chunk.as_py(), np.int32)), pa.array(doc_ids.as_py(), pa.int64()), pa.array(starts), pa.array(np.diff(ends, prepend=0)), pa.array(crc, pa.int64())], schema=READ)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Documents of files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    files = spark.read.schema(DDL).parquet(path)
    found = files.select("part", "chunk", "doc_ids", "doc_tokens", "blocks").mapInArrow(digest, "part int, chunk int, doc_id long, start long, n_tokens long, ids_crc32 long")
    # one row a chunk of CHUNK ids or more: a billion ids are under two hundred rows
    order = Window.orderBy("part", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    begin = files.select("part", "chunk", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).alias("before"))
    return found.join(begin, ["part", "chunk"]).select("doc_id", (F.col("before") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def written_and_read(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    to = new_path(spark, "ids")
    write_ids(docs, to)
    return read_ids(spark, to)
