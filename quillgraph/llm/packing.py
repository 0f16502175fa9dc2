"""Packing (5): power-of-two decomposition of documents.

Each document's n ids are cut into pieces whose lengths are the powers of two of n's binary
form, none longer than the sequence length: whole multiples of it first, then the rest from
long to short. A piece is a sequence of its own. Sequences of equal length form a bucket, from
which batches without padding can be drawn, and no sequence crosses documents.

A null or empty text has the end id only and makes one piece of length 1. Repeated rows are
packed as often as they occur. Very long texts are tokenized part by part. Extra columns are
ignored; an empty table gives an empty result. Sequence ids are unique: (bucket, input
partition, number within both); they are the same whenever the same input splits are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .base import bounded_batches
from .tokens import default_path, encoder

MAX_LENGTH, END_ID = 4096, 2
FIELDS = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]


def pieces(n: int, most: int = MAX_LENGTH) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; ``most`` is a power of two."""
    out = [(at, most) for at in range(0, n - most + 1, most)]
    at = n - n % most
    bit = most >> 1
    while bit:
        if n & bit:
            out.append((at, bit))
            at += bit
        bit >>= 1
    return out


def packer(path: str, most: int, end_id: int, with_ids: bool):
    schema = pa.schema(FIELDS + [("ids", pa.list_(pa.int32()))] * with_ids)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, numbers = TaskContext.get().partitionId(), [0] * 64
        enc = encoder(path)
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for i, _, buf, offsets in K.groups(batch.column(1)):
                ids, sizes = enc.encode_group(buf, offsets)
                ends = np.cumsum(sizes)
                rows: list[list] = [[] for _ in schema]
                for k, (end, size) in enumerate(zip(ends.tolist(), sizes.tolist())):
                    own = np.append(ids[end - size : end], np.uint32(end_id)).astype("<u4")
                    raw = own.data.cast("B")
                    for start, length in pieces(size + 1, most):
                        bucket = length.bit_length() - 1
                        values = (doc_ids[i + k], start, length, zlib.crc32(raw[4 * start : 4 * (start + length)]), size + 1, bucket << 57 | part << 36 | numbers[bucket], 0)
                        numbers[bucket] += 1
                        for column, value in zip(rows, values):
                            column.append(value)
                        if with_ids:
                            rows[-1].append(own[start : start + length].astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema)], schema=schema)

    return pack


def pack_documents(docs: DataFrame, path: str | None = None, most: int = MAX_LENGTH, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """A row for each sequence; ``ids`` array<int> unless only the digests are wanted."""
    if most < 1 or most & (most - 1):
        raise ValueError("the sequence length must be a power of two")
    bounded_batches(docs.sparkSession)
    ddl = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return narrow.mapInArrow(packer(path or default_path(), most, end_id, with_ids), ddl)


def write_buckets(sequences: DataFrame, path: str) -> None:
    """Sequences as Parquet, a folder for each length."""
    sequences.write.partitionBy("length").parquet(path)
