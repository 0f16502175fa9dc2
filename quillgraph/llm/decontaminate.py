"""Benchmark decontamination (4): one Aho-Corasick automaton over normalised test texts.

Every window of 13 words of a benchmark item (an item of fewer words: the whole of it) is a
pattern, with one space around each word. A document is lower-cased (A-Z) and reduced to its words with
one space between, and scanned once; ends of matches are mapped back to words and, for reports,
to character offsets of the original text.

The benchmark's size is checked before it goes to the driver: up to ``SHARD_BYTES`` of text it is
one automaton, and documents are scanned once. A larger one, larger than any public one, is taken in shards
of that size, one after the other: driver and workers hold one shard and its automaton at a time, and
what a shard finds is written (texts with hits only) before the next is read. Spans of all shards are
then merged by text.

Null or empty texts have no words and no hits; null or empty items have no windows. Repeated
items count by their own item_id. Repeated rows and texts are hit alike. Extra columns pass
through ``decontaminate``, whatever their names; an empty benchmark contaminates nothing.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .base import bounded_batches, fresh, written

WINDOW, SHARE = 13, 20
SHARD_BYTES = 8 << 20
TABLE = bytes(int(K.LOWER[i]) if K.LETTERS[i] else 32 for i in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

LISTS = ("starts", "ends", "first", "last")
FIELDS = [("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), *((c, pa.list_(pa.int64())) for c in LISTS)]
KIND = pa.struct(FIELDS)
DDL = "struct<n_words:bigint,n_hit:bigint,items:array<string>," + ",".join(f"{c}:array<bigint>" for c in LISTS) + ">"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


def automaton(items: list[tuple[str, bytes]], width: int = WINDOW) -> ahocorasick.Automaton | None:
    """Pattern: (words, items that have it). Bytes are held as one character each."""
    patterns: dict[str, tuple[int, list[str]]] = {}
    for item, text in items:
        words = words_of(text)
        for at in range(max(1, len(words) - width + 1) if words else 0):
            part = words[at : at + width]
            key = (b" " + b" ".join(part) + b" ").decode("latin-1")
            patterns.setdefault(key, (len(part), []))[1].append(item)
    if not patterns:
        return None
    out = ahocorasick.Automaton()
    for key, value in patterns.items():
        out.add_word(key, value)
    out.make_automaton()
    return out


def matches(machine: ahocorasick.Automaton, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
    """Which words are hit, and the items with an occurring window."""
    ends, lengths, items = [], [], set()
    for end, (n, own) in machine.iter((b" " + b" ".join(words) + b" ").decode("latin-1")):
        ends.append(end)
        lengths.append(n)
        items.update(own)
    if not ends:
        return np.zeros(0, bool), items
    gaps = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)  # of the space after each word
    last = np.searchsorted(gaps, np.array(ends))
    marks = np.zeros(len(words) + 1, np.int64)
    np.add.at(marks, last + 1 - np.array(lengths), 1)
    np.add.at(marks, last + 1, -1)
    return np.cumsum(marks[:-1]) > 0, items


def original_spans(text: str, hit: np.ndarray) -> tuple[list[int], list[int], list[int], list[int]]:
    """Runs of hit words: character offsets in the text as it is (start, end), and words (first, one after the last)."""
    edges = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    places = [m.span() for m in WORD.finditer(text)]
    first, last = np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist()
    return [places[i][0] for i in first], [places[i - 1][1] for i in last], first, last


def scanner(shared, digest: str, width: int):
    """Arrow function over texts; the automaton is built once a worker from the broadcast items, and is the only one it keeps."""

    def scan(texts: pa.Array) -> pa.Array:
        kept = K.kept("decontaminate")
        if digest not in kept:
            kept.clear()
            kept[digest] = automaton(shared.value, width)
        machine = kept[digest]
        out: list[list] = [[] for _ in FIELDS]
        for _, _, buf, offsets in K.groups(texts):
            whole = buf.tobytes()
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                words = words_of(whole[a:b])
                hit, found = matches(machine, words) if machine is not None and words else (np.zeros(0, bool), set())
                spans = original_spans(whole[a:b].decode("utf-8", "surrogatepass"), hit) if found else ([], [], [], [])
                for column, value in zip(out, (len(words), int(hit.sum()), sorted(found), *spans)):
                    column.append(value)
        return pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip(out, KIND)], fields=list(KIND))

    return scan


def merged(found: pa.Array) -> pa.Array:
    """One struct for each list of structs of one text: spans that overlap or touch are one."""
    rows = []
    for parts in found.to_pylist():
        spans = sorted((f, l, s, e) for p in parts for s, e, f, l in zip(*(p[c] for c in LISTS)))
        out: list[list[int]] = []
        for first, last, start, end in spans:
            if out and first <= out[-1][1]:
                if last > out[-1][1]:
                    out[-1][1], out[-1][3] = last, end
            else:
                out.append([first, last, start, end])
        rows.append({"n_words": parts[0]["n_words"], "n_hit": sum(x[1] - x[0] for x in out), "items": sorted({i for p in parts for i in p["items"]}), "first": [x[0] for x in out], "last": [x[1] for x in out], "starts": [x[2] for x in out], "ends": [x[3] for x in out]})
    return pa.array(rows, KIND)


def scan_column(items: list[tuple[str, bytes]], spark, text: F.Column, width: int):
    """The scan of a text column by one shard of items, and its broadcast."""
    digest = hashlib.sha256(repr((width, sorted(items))).encode()).hexdigest()
    shared = spark.sparkContext.broadcast(items)
    return F.arrow_udf(scanner(shared, digest, width), DDL).asNondeterministic()(F.coalesce(text, F.lit(""))), shared


def scanned(docs: DataFrame, benchmark: DataFrame, out: str, text: str = "text", item: str = "item_id", width: int = WINDOW) -> DataFrame:
    """``docs`` with a struct column ``out``: n_words, n_hit, items (sorted), and hit spans in characters and words."""
    spark = docs.sparkSession
    bounded_batches(spark)
    size = benchmark.select(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES))
    rows = benchmark.where(F.col("text").isNotNull()).select(F.col(item).cast("string").alias("item"), F.col("text").alias("text"))
    shard = F.pmod(F.xxhash64("item", "text"), F.lit(shards))
    own = lambda k: [(r.item or "", r.text.encode("utf-8", "surrogatepass")) for r in (rows if shards == 1 else rows.where(shard == k)).collect()]
    if shards == 1:
        return docs.withColumn(out, scan_column(own(0), spark, F.col(text), width)[0])
    # texts are told apart by two hashes and their length
    key = lambda c: F.struct(F.xxhash64(c), F.hash(c), F.octet_length(c))
    none, found = F.col("f")["n_hit"] == 0, None
    for k in range(shards):
        scan, shared = scan_column(own(k), spark, F.col("t"), width)
        hits = docs.select(F.col(text).alias("t")).where("t is not null").withColumn("f", scan).where(~none).select(key(F.col("t")).alias("key"), "f")
        part, _ = written(hits.groupBy("key").agg(F.first("f").alias("f")), "shard")
        shared.destroy()
        found = part if found is None else found.unionByName(part)
    # a text has one row a shard at most
    of_text = found.groupBy("key").agg(F.arrow_udf(merged, DDL)(F.collect_list("f")).alias("f"))
    of_text, _ = written(of_text, "hits")
    k, f = fresh(docs, "__key"), fresh(docs, "__found")
    joined = docs.join(of_text.select(F.col("key").alias(k), F.col("f").alias(f)), key(F.col(text)) == F.col(k), "left")
    words = F.size(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), lambda w: w != "")).cast("long")
    bare = F.struct(words.alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"), *[F.array().cast("array<bigint>").alias(c) for c in LISTS])
    return joined.withColumn(out, F.coalesce(F.col(f), bare)).drop(k, f)


def contaminated(f, share: int = SHARE) -> F.Column:
    return (f["n_hit"] > 0) & (share * f["n_hit"] >= f["n_words"])


def decontamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    f = F.col("f")
    out = scanned(docs.select("doc_id", "text"), benchmark, "f").drop("text")
    return out.select("doc_id", f["n_words"].alias("n_words"), f["n_hit"].alias("n_hit"), F.size(f["items"]).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", f["items"]), 256).alias("items_sha256"), contaminated(f).alias("contaminated"), f["starts"].alias("span_starts"), f["ends"].alias("span_ends"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, cut: bool = False) -> DataFrame:
    """The documents without a benchmark passage, with their columns as they are.

    With ``cut``, of documents with passages only the contaminated ones go; the others stay without the spans
    that are hits, and n_chars, where there is such a column, is counted anew. A text without hits stays as it is.
    """
    f = fresh(docs, "__scan")
    found = scanned(docs, benchmark, f)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    if not cut:
        return found.where(F.col(f)["n_hit"] == 0).select(*columns)
    clean = found.where(~contaminated(F.col(f)))
    hit = F.col(f)["n_hit"] > 0
    starts, ends = F.col(f)["starts"].cast("array<int>"), F.col(f)["ends"].cast("array<int>")
    # what lies between one span's end and the next one's start
    gaps = F.arrays_zip(F.concat(F.array(F.lit(0)), ends).alias("a"), F.concat(starts, F.array(F.char_length("text"))).alias("b"))
    left = F.array_join(F.transform(gaps, lambda g: F.substring(F.col("text"), g["a"] + 1, g["b"] - g["a"])), "")
    changed = clean.withColumn("text", F.when(hit, left).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.when(hit, F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return changed.select(*columns)
