"""Substring dedup (7): a log-structured index of window fingerprints.

Documents come in batches of ascending doc_id. Every 13-word window of a batch is hashed; blocks
of documents send each distinct window once, with the smallest document that has it, to buckets
of the hash space. Later documents of the same block are known to repeat it. A bucket merge-joins
its sorted fingerprints with the sorted immutable runs of earlier batches, verifies matches by
further hash bits, answers the blocks, and writes the batch's new fingerprints as a run.
When an index has ``FANOUT`` runs, they are compacted into one. An index has a manifest of its runs,
so that a later session opens it and dedups new documents against all that came before.

A fingerprint is the bucket's bits and 48 more of a window's hash; eight check bits come from an
independent hash. Buckets grow with the data, so the odds of a false match don't.

Null or empty texts have no words; texts of fewer words than a window are never touched. Rows
with a null doc_id are neither indexed nor changed. Rows with an equal doc_id don't repeat each
other. Long documents are hashed part by part. Extra columns pass through
``drop_repeated_passages``. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from ..sources.storage import exists, file_system
from .base import bounded_batches, delete, fresh, new_path, power_of_two, release_shuffles, text_bytes, written
from .jaccard import PACKED, PACKED_SCHEMA, batch_of, by_bucket

WIDTH = 13
BATCHES, FANOUT = 3, 2
BUCKET_BYTES = 4 << 20
BLOCK_ENTRIES = 1_000_000
BROADCAST_BYTES = 32 << 20

RUN, ENTRIES, SELF, HITS = 1, 0, 2, 3
LOW48 = np.uint64((1 << 48) - 1)


def pack_planes(values: np.ndarray) -> bytes:
    """Unsigned integers as one byte for their width and their bytes plane by plane, which compresses well."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    return bytes([width]) + values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpack_planes(blob: bytes) -> np.ndarray:
    width = blob[0]
    planes = np.frombuffer(blob, np.uint8, offset=1).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack_planes(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack_planes(blob), dtype=np.uint64)


def sender(bits: int, width: int, batch_no: int):
    """mapInArrow function: (doc_id, tag, text) to packed rows. tag tells texts of one doc_id apart."""

    def flush(block: int, ids: list, tags: list, sizes: list, hashes: list, checks: list) -> Iterator[pa.RecordBatch]:
        doc_id, n = np.concatenate(ids), np.concatenate(sizes)
        h, check = np.concatenate(hashes), np.concatenate(checks)
        owner = np.repeat(doc_id, n)
        order = np.lexsort((owner, check, h))
        h, check, owner = h[order], check[order], owner[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (check[1:] != check[:-1])
        first = np.flatnonzero(new)
        least = np.repeat(owner[first], np.diff(np.append(first, len(h))))
        send = owner == least
        known = np.zeros(len(h), bool)
        known[order[~send]] = True
        rows = [(block % (1 << bits), block, SELF, doc_id.astype("<i8").tobytes(), np.concatenate(tags).astype("<i8").tobytes(), n.astype("<i8").tobytes(), np.packbits(known).tobytes())]
        h, check, owner, place = h[send], check[send], owner[send], order[send]
        key = (h & LOW48) << np.uint64(8) | check.astype(np.uint64)
        for bucket, s in by_bucket(h, bits):
            # a bucket's keys are sorted by its own low bits
            o = np.argsort(key[s], kind="stable")
            ids_of = owner[s][o]
            base = int(ids_of.min())
            rows.append((bucket, block, ENTRIES, pack_sorted(key[s][o]), pack_planes((ids_of - base).astype(np.uint64)), base.to_bytes(8, "little", signed=True), pack_planes(place[s][o].astype(np.uint64))))
        for i in range(0, len(rows), 64):
            yield batch_of(rows[i : i + 64], PACKED_SCHEMA)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.kept("substring")
        part, k = TaskContext.get().partitionId(), 0
        held: tuple[list, ...] = ([], [], [], [], [])
        n = 0
        for batch in batches:
            doc_ids, tags = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            for i, j, buf, offsets in K.groups(batch.column(2)):
                counts, (one, two) = K.word_hashes(buf, offsets, K.SPACED, lanes=2)
                _, start = K.whole_windows(counts, width)
                own = (doc_ids[i:j], tags[i:j], np.maximum(counts - width + 1, 0), K.window_hashes(one, width, 0)[start], (K.window_hashes(two, width, 1)[start] & np.uint64(255)).astype(np.uint8))
                if n and n + len(start) > BLOCK_ENTRIES:
                    yield from flush(batch_no << 48 | part << 24 | k, *held)
                    held, n, k = ([], [], [], [], []), 0, k + 1
                    K.settle()
                for column, values in zip(held, own):
                    column.append(values)
                n += len(start)
        if held[0]:
            yield from flush(batch_no << 48 | part << 24 | k, *held)

    return send


def merge_join(bucket: int, rows: pa.Table, runs: list[np.ndarray], keep: bool) -> pa.Table:
    """One bucket of a batch against its runs: answers to blocks, and with ``keep`` the bucket's part of the new run."""
    kinds, blocks = rows["kind"].to_pylist(), rows["block"].to_pylist()
    a, b, c, d = (rows[x].to_pylist() for x in "abcd")
    out, keys, ids, who = [], [], [], []
    for i, kind in enumerate(kinds):
        if kind == SELF:
            out.append((bucket, blocks[i], SELF, a[i], b[i], c[i], d[i]))
            continue
        keys.append(unpack_sorted(a[i]))
        ids.append(unpack_planes(b[i]).astype(np.int64) + int.from_bytes(c[i], "little", signed=True))
        who.append(i)
    if who:
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        ids_all = np.concatenate(ids)
        least = np.full(len(distinct), np.iinfo(np.int64).max)
        np.minimum.at(least, at, ids_all)
        old = np.zeros(len(distinct), bool)
        for run in runs:
            if len(run):
                place = np.minimum(np.searchsorted(run, distinct), len(run) - 1)
                old |= run[place] == distinct
        hit = old[at] | (ids_all > least[at])
        begin = 0
        for i, own in zip(who, keys):
            mine = hit[begin : begin + len(own)]
            begin += len(own)
            if mine.any():
                out.append((bucket, blocks[i], HITS, pack_sorted(np.sort(unpack_planes(d[i])[mine])), None, None, None))
        if keep:
            out.append((bucket, 0, RUN, pack_sorted(distinct[~old]), None, None, None))
    K.settle()
    return pa.Table.from_batches([batch_of(out, PACKED_SCHEMA)])


def joined_with_runs(keep: bool):
    return lambda key, rows, runs: merge_join(key[0].as_py(), rows, [unpack_sorted(x) for x in runs["a"].to_pylist()], keep)


def joined_with_none(keep: bool):
    return lambda key, rows: merge_join(key[0].as_py(), rows, [], keep)


def compacted(key: tuple, rows: pa.Table) -> pa.Table:
    """Runs of one bucket as one."""
    keys = np.unique(np.concatenate([unpack_sorted(x) for x in rows["a"].to_pylist()]))
    return pa.Table.from_batches([batch_of([(key[0].as_py(), 0, RUN, pack_sorted(keys), None, None, None)], PACKED_SCHEMA)])


SPANS = "doc_id long, tag long, starts array<long>, ends array<long>"


def spans_of(width: int):
    """One block's answers: a row for each document with repeated windows; spans count words."""

    def spans(rows: pa.Table) -> pa.Table:
        places = []
        for kind, a, b, c, d in zip(*(rows[x].to_pylist() for x in ("kind", "a", "b", "c", "d"))):
            if kind == SELF:
                ids, tags, n, known = np.frombuffer(a, "<i8"), np.frombuffer(b, "<i8"), np.frombuffer(c, "<i8"), d
            else:
                places.append(unpack_sorted(a).astype(np.int64))
        total = int(n.sum())
        hit = np.unpackbits(np.frombuffer(known, np.uint8), count=total).astype(bool)
        for p in places:
            hit[p] = True
        begin = np.concatenate(([0], np.cumsum(n)))
        at = np.flatnonzero(hit)
        doc = np.searchsorted(begin, at, "right") - 1
        cuts = np.searchsorted(doc, np.arange(len(ids) + 1))
        out: list[list] = [[], [], [], []]
        for i in np.flatnonzero(np.diff(cuts)):
            own = at[cuts[i] : cuts[i + 1]] - begin[i]
            new = np.flatnonzero(np.concatenate(([True], own[1:] > own[:-1] + width)))
            for column, value in zip(out, (int(ids[i]), int(tags[i]), own[new], own[np.append(new[1:], len(own)) - 1] + width)):
                column.append(value)
        return pa.table({"doc_id": pa.array(out[0], pa.int64()), "tag": pa.array(out[1], pa.int64()), "starts": pa.array(out[2], pa.list_(pa.int64())), "ends": pa.array(out[3], pa.list_(pa.int64()))})

    return spans


class FingerprintIndex:
    """Sorted immutable runs in a shared folder, with a manifest of them. ``bits``: of the bucket; fixed for an index's life.

    An index at a ``path`` outlives its session: whoever opens it there goes on with its runs. Each change of the
    runs is a new manifest, written before what it replaces is deleted, so an index is never without whole runs;
    what a failed batch has written is not in the manifest and adds nothing. One writer at a time.
    """

    def __init__(self, spark: SparkSession, bits: int, width: int = WIDTH, fanout: int = FANOUT, path: str | None = None):
        self.spark, self.bits, self.width, self.fanout = spark, bits, width, fanout
        self.path = path or new_path(spark, "index")
        self.paths: list[str] = []
        self.batches = self.version = 0

    @classmethod
    def open(cls, spark: SparkSession, path: str, fanout: int = FANOUT) -> FingerprintIndex:
        """The index that lies at ``path``. Raises FileNotFoundError where there is none."""
        found = spark.read.text(f"{path}/manifests/*.json", wholetext=True) if exists(spark, f"{path}/manifests") else None
        manifest = max((json.loads(r.value) for r in found.collect()), key=lambda m: m["version"], default=None) if found is not None else None
        if manifest is None:
            raise FileNotFoundError(f"no index in {path}")
        index = cls(spark, manifest["bits"], manifest["width"], fanout, path)
        index.paths, index.batches, index.version = manifest["runs"], manifest["batches"], manifest["version"]
        return index

    def _commit(self, runs: list[str]) -> None:
        """The runs from now on: a manifest of its own name, then the one before goes."""
        fs, _ = file_system(self.spark, self.path)
        name = lambda v: self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifests/{v}.json")
        text = json.dumps({"version": self.version + 1, "bits": self.bits, "width": self.width, "batches": self.batches, "runs": runs})
        out = fs.create(name(self.version + 1), True)
        out.write(bytearray(text.encode()))
        out.close()
        fs.delete(name(self.version), False)
        self.paths, self.version = runs, self.version + 1

    def _run(self, path: str) -> DataFrame:
        return self.spark.read.schema("bucket long, a binary").parquet(f"{self.path}/{path}")

    def history(self) -> DataFrame | None:
        out = None
        for path in self.paths:
            out = self._run(path) if out is None else out.unionByName(self._run(path))
        return out

    def add(self, docs: DataFrame, keep: bool = True) -> DataFrame:
        """Spans of ``docs`` (doc_id, tag, text) that repeat earlier documents; then, with ``keep``, indexes them.

        All documents of earlier calls count as earlier than those of this one. The spans are read from a
        table in the shared folder.
        """
        sent = docs.mapInArrow(sender(self.bits, self.width, self.batches), PACKED).groupBy("bucket")
        history = self.history()
        if history is not None:
            answered = sent.cogroup(history.groupBy("bucket")).applyInArrow(joined_with_runs(keep), PACKED)
        else:
            answered = sent.applyInArrow(joined_with_none(keep), PACKED)
        batch = f"runs/batch-{self.batches}-{uuid.uuid4().hex}"
        answered.write.partitionBy("kind").option("compression", "zstd").parquet(f"{self.path}/{batch}")
        self.batches += 1
        run = f"{batch}/kind={RUN}"
        self._commit([*self.paths, run] if exists(self.spark, f"{self.path}/{run}") else self.paths)
        release_shuffles(self.spark)
        answers = self.spark.read.schema(PACKED).parquet(f"{self.path}/{batch}").where(F.col("kind") != RUN)
        return answers.groupBy("block").applyInArrow(spans_of(self.width), SPANS)

    def compact(self) -> None:
        """All runs as one, if there are ``fanout`` of them."""
        if len(self.paths) < self.fanout:
            return
        merged = f"runs/run-{self.batches}-{uuid.uuid4().hex}"
        self.history().groupBy("bucket").applyInArrow(compacted, PACKED).select("bucket", "a").write.option("compression", "zstd").parquet(f"{self.path}/{merged}")
        old = self.paths
        self._commit([merged])
        delete(self.spark, *[f"{self.path}/{p}" for p in old])  # answers to blocks stay beside them
        release_shuffles(self.spark)

    def drop(self) -> None:
        delete(self.spark, self.path)
        self.paths = []


def tag_of(text) -> F.Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def keyed(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, tag, text) of documents that have an id: what an index takes."""
    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), tag_of(F.col(text)).alias("tag"), F.col(text).alias("text"))


def bucket_bits(size: int) -> int:
    """Bits of the bucket for so many bytes of text, in all that an index is to hold."""
    return power_of_two(size / BUCKET_BYTES).bit_length() - 1


def repeated_spans(docs: DataFrame, text: str = "text", width: int = WIDTH, batches: int = BATCHES, fanout: int = FANOUT, path: str | None = None) -> DataFrame:
    """(doc_id, tag, starts, ends): for documents with repeated windows, spans of words to remove. A written table.

    With ``path``, an index is kept there, or the one that is there is gone on with: documents of earlier calls,
    in this session or another, then count as earlier than all of these.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    narrow = keyed(docs, text)
    inner = [k / batches for k in range(1, batches)]
    cuts = sorted(set(narrow.select(F.percentile_approx("doc_id", inner, 10_000)).first()[0] or [])) if inner else []
    if path is not None and exists(spark, f"{path}/manifests"):
        index = FingerprintIndex.open(spark, path, fanout)
    else:
        index = FingerprintIndex(spark, bucket_bits(text_bytes(docs, text)), width, fanout, path)
    found = []
    for low, high in zip([None, *cuts], [*cuts, None]):
        part = narrow
        if low is not None:
            part = part.where(F.col("doc_id") > low)
        if high is not None:
            part = part.where(F.col("doc_id") <= high)
        # nothing comes after the last batch of an index that isn't kept
        more = high is not None or path is not None
        found.append(written(index.add(part, keep=more).distinct(), "spans")[0])
        if more:
            index.compact()
    if path is None:
        index.drop()
    release_shuffles(spark)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def marked(docs: DataFrame, out: str, text: str = "text", **options) -> DataFrame:
    """``docs`` with a struct column ``out`` (starts, ends), null where nothing repeats.

    Spans go by broadcast where they are small, measured, and else by a hash join on the document;
    that join deals out texts by document, so no key is hot.
    """
    spans = repeated_spans(docs, text, **options)
    size = spans.select(F.sum(64 + 16 * F.size("starts").cast("long"))).first()[0] or 0
    d, t = fresh(docs, "__d"), fresh(docs, "__t")
    other = spans.select(F.col("doc_id").alias(d), F.col("tag").alias(t), F.struct("starts", "ends").alias(out))
    other = F.broadcast(other) if size <= BROADCAST_BYTES else other.hint("shuffle_hash")
    return docs.join(other, (F.col("doc_id") == F.col(d)) & (tag_of(F.col(text)) == F.col(t)), "left").drop(d, t)


def kept_words(text: str | None, span: dict | None) -> tuple[int, int, bytes]:
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if not span:
        return len(words), 0, b" ".join(words)
    keep = np.ones(len(words), bool)
    for s, e in zip(span["starts"], span["ends"]):
        keep[s:e] = False
    return len(words), len(words) - int(keep.sum()), b" ".join(compress(words, keep.tolist()))


DIGEST = pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])


def digests(texts: pa.Array, found: pa.Array) -> pa.Array:
    n, gone, sha = [], [], []
    for text, span in zip(texts, found):
        a, b, kept = kept_words(text.as_py(), span.as_py())
        n.append(a)
        gone.append(b)
        sha.append(hashlib.sha256(kept).hexdigest())
    return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], fields=list(DIGEST))


def rewritten(texts: pa.Array, found: pa.Array) -> pa.Array:
    return pa.array([t.as_py() if not s.is_valid else kept_words(t.as_py(), s.as_py())[2].decode("utf-8", "surrogatepass") for t, s in zip(texts, found)], pa.string())


def dedup_report(docs: DataFrame) -> DataFrame:
    df = marked(docs.select("doc_id", "text"), "span")
    out = F.arrow_udf(digests, "struct<n_words:bigint,n_removed:bigint,kept_sha256:string>").asNondeterministic()("text", "span")
    return df.select("doc_id", out.alias("r"), "span").select("doc_id", "r.n_words", "r.n_removed", "r.kept_sha256", F.col("span.starts").alias("removed_starts"), F.col("span.ends").alias("removed_ends"))


def drop_repeated_passages(docs: DataFrame) -> DataFrame:
    """``docs`` without repeated passages; a text that had some is its kept words, joined by spaces.

    Documents of which nothing is left go; n_chars, where there is such a column, is counted anew.
    """
    span = fresh(docs, "__span")
    df = marked(docs, span)
    new = F.arrow_udf(rewritten, "string")("text", span)
    changed = df.withColumn("text", F.when(F.col(span).isNull(), F.col("text")).otherwise(new))
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.when(F.col(span).isNull(), F.col("n_chars")).otherwise(F.char_length("text")).cast(docs.schema["n_chars"].dataType))
    return changed.where(F.col(span).isNull() | (F.col("text") != "")).select(*[F.col(f"`{c}`") for c in docs.columns])
