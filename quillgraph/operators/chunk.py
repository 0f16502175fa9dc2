"""Paragraphs to chunks: an order-dependent fold by section, and what is counted about chunks.

Texts, tokens and vectors are columns; only the fold itself, over the token counts and likenesses of
a section's pieces, is a vectorised Python function. A section's texts never lie in one cell, its
numbers (two a piece) do, as its chunks depend on each other.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import vector as V

FLOOR, SOFT, LEAST, TARGET, MOST = 40, 84, 120, 450, 800
DRIFT = 0.35


def split_long(text: str, most: int, count: Callable[[str], int] = lambda s: len(s.split())) -> list[str]:
    """Sentences packed up to ``most`` tokens. A longer sentence is cut by words; what waited before it comes out first."""
    out: list[str] = []
    held: list[str] = []
    n = 0

    def flush() -> None:
        nonlocal n
        if held:
            out.append(" ".join(held))
        held.clear()
        n = 0

    for sentence in (s.strip() for s in re.split(r"(?<=[.!?])\s+", text)):
        size = count(sentence)
        if size == 0:
            continue
        if size > most:
            flush()
            for word in sentence.split():
                own = count(word)
                if n + own > most:
                    flush()
                held.append(word)
                n += own
            flush()
            continue
        if n + size > most:
            flush()
        held.append(sentence)
        n += size
    flush()
    return out or [text]


def fold(tokens: list[int], likeness: list[float], least: int = LEAST, target: int = TARGET, most: int = MOST, drift: float = DRIFT) -> list[int]:
    """The chunk of each piece, from 0. A chunk ends before it would exceed ``most``, or, once it has
    ``target`` tokens, where the topic turns: where a piece is less like the one before than ``drift``."""
    out, chunk, size = [], 0, 0
    for n, like in zip(tokens, likeness):
        if size and (size + n > most or (size >= target and size >= least and like < drift)):
            chunk, size = chunk + 1, 0
        out.append(chunk)
        size += n
    return out


def merge_small(sizes: list[int], least: int = LEAST, most: int = MOST) -> list[int]:
    """The new chunk of each chunk, from 0. One of under ``least`` tokens joins the one before if both
    fit, else is joined with the next; what came of that is not looked at again."""
    out: list[int] = []
    merged: list[int] = []
    k = 0
    while k < len(sizes):
        if sizes[k] < least and merged and merged[-1] + sizes[k] <= most:
            merged[-1] += sizes[k]
        elif sizes[k] < least and k + 1 < len(sizes) and sizes[k] + sizes[k + 1] <= most:
            merged.append(sizes[k] + sizes[k + 1])
            out.append(len(merged) - 1)
            k += 1
        else:
            merged.append(sizes[k])
        out.append(len(merged) - 1)
        k += 1
    return out


def numbers(tokens: list[int], likeness: list[float], least: int, target: int, most: int, drift: float) -> list[int]:
    """The final chunk of each piece, from 1."""
    first = fold(tokens, likeness, least, target, most, drift)
    sizes = np.bincount(first, tokens).astype(int).tolist() if first else []
    new = merge_small(sizes, least, most)
    return [new[c] + 1 for c in first]


def pieces(paras: DataFrame, section: str, order: str = "para", text: str = "text", most: int = MOST, count: Callable[[Column], Column] = T.word_count) -> DataFrame:
    """(section, para, piece, text, tokens): paragraphs, those of over ``most`` tokens split; pieces without a token are left out."""

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_long(t, most) if t is not None else [])

    value, n = F.col("text"), count(F.col("text"))
    rows = paras.select(F.col(section).cast("string").alias("section"), F.col(order).alias("para"), F.col(text).alias("text"))
    # only long texts go to Python
    parts = F.when(n > most, cut(F.when(n > most, value))).otherwise(F.array(value))
    opened = rows.select("section", "para", F.posexplode(parts).alias("piece", "text"))
    return opened.withColumn("tokens", count(F.col("text"))).where("tokens > 0")


def chunks(paras: DataFrame, section: str, order: str = "para", text: str = "text", embed: Callable[[Column], Column] | None = V.hashed_embedding, strict: bool = False, least: int = LEAST, target: int = TARGET, most: int = MOST, drift: float = DRIFT, count: Callable[[Column], Column] = T.word_count) -> DataFrame:
    """Chunks of each section, numbered from 1: section, chunk, text, token_count, n_paragraphs.

    Each piece is embedded by itself. Without ``embed`` every piece counts as a turn of the topic.
    ``strict``: a chunk of under FLOOR tokens is an error.
    """
    cut = pieces(paras, section, order, text, most, count)
    if embed is not None:
        cut = cut.withColumn("vector", embed(F.col("text")))
    order_of = Window.partitionBy("section").orderBy("para", "text", "piece")
    like = F.lit(0.0) if embed is None else V.cosine(F.lag("vector").over(order_of), F.col("vector"))
    placed = cut.withColumn("at", F.row_number().over(order_of)).withColumn("like", F.when(F.col("at") == 1, 1.0).otherwise(like)).drop("vector")

    @F.pandas_udf("array<int>")
    def number(tokens: pd.Series, likeness: pd.Series) -> pd.Series:
        return pd.Series([numbers(t.tolist(), x.tolist(), least, target, most, drift) for t, x in zip(tokens, likeness)])

    ordered = F.array_sort(F.collect_list(F.struct("at", "tokens", "like")))
    folded = placed.groupBy("section").agg(ordered.alias("p")).select("section", number(F.col("p.tokens"), F.col("p.like")).alias("n"))
    named = placed.join(folded.select("section", F.posexplode("n").alias("at", "chunk")).withColumn("at", F.col("at") + 1), ["section", "at"])
    texts = F.array_sort(F.collect_list(F.struct("at", "text")))
    out = named.groupBy("section", "chunk").agg(F.trim(F.array_join(F.transform(texts, lambda x: x["text"]), "\n\n")).alias("text"), F.sum("tokens").cast("int").alias("token_count"), F.count("*").cast("int").alias("n_paragraphs"))
    if strict:
        low = F.concat(F.lit("chunk "), F.col("chunk").cast("string"), F.lit(" of section "), F.col("section"), F.lit(f" has fewer than {FLOOR} tokens"))
        out = out.withColumn("token_count", F.when(F.col("token_count") < FLOOR, F.raise_error(low).cast("int")).otherwise(F.col("token_count")))
    return out


def chunk_id(book, section, chunk):
    return F.format_string("P%02d-S%03d-C%03d", book, section, chunk)


def numbered(rows: DataFrame, group: list[str], order: str) -> DataFrame:
    return rows.withColumn("chunk_index", F.row_number().over(Window.partitionBy(*group).orderBy(order)))


def stats(chunked: DataFrame, book: str) -> DataFrame:
    """Of each book, and of all (null book)."""
    return chunked.rollup(book).agg(F.count("*").alias("chunks"), F.sum("token_count").alias("tokens"), F.min("token_count").alias("min_tokens"), F.max("token_count").alias("max_tokens"), F.avg("token_count").alias("avg_tokens"))


def metadata(chunked: DataFrame, book: str, input_hash: str, input_file: str, model: str, tokenizer: str) -> DataFrame:
    """One row about a run: when and from what, chunks in all and by book (one entry a book), and the limits."""
    by_book = chunked.groupBy(F.coalesce(F.col(book).cast("string"), F.lit("Unknown")).alias("book")).agg(F.count("*").alias("n"))
    limits = {"min_tokens": LEAST, "target_tokens": TARGET, "max_tokens": MOST}
    return by_book.agg(
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"), F.lit(input_hash).alias("input_hash"), F.lit(input_file).alias("input_file"), F.coalesce(F.sum("n"), F.lit(0)).alias("chunk_count"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("book", "n")))).alias("book_chunk_counts"), F.lit(model).alias("model"), F.lit(tokenizer).alias("tokenizer"),
        F.create_map(*[F.lit(x) for kv in limits.items() for x in kv]).alias("token_limits"),
    )


def buckets(chunked: DataFrame) -> DataFrame:
    n = F.col("token_count")
    return chunked.agg(F.count_if(n < FLOOR).alias("below_floor"), F.count_if((n >= FLOOR) & (n < SOFT)).alias("below_soft"), F.count_if((n >= SOFT) & (n < LEAST)).alias("below_preferred"), F.count_if(n > MOST).alias("above_max"))


def violations(chunked: DataFrame, key: str) -> DataFrame:
    """(key, rule) of chunks that break one: floor, soft, max, empty, duplicate id."""
    n = F.col("token_count")
    flags = F.array(F.when(n < FLOOR, "floor"), F.when((n >= FLOOR) & (n < SOFT), "soft"), F.when(n > MOST, "max"), F.when(F.trim("text") == "", "empty"))
    own = chunked.select(key, F.explode(F.array_compact(flags)).alias("rule"))
    twice = chunked.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key, F.lit("duplicate").alias("rule"))
    return own.unionByName(twice)
