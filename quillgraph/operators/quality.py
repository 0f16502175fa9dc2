"""Checks: each returns the rows or counts that break a rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon


def missing_fields(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field) of required fields that are null or blank."""
    flags = F.array(*[F.when(F.col(f).isNull() | (F.trim(F.col(f).cast("string")) == ""), F.lit(f)) for f in fields])
    return df.select(key, F.explode(F.filter(flags, lambda x: x.isNotNull())).alias("field"))


def totals(df: DataFrame, text: str = "text") -> DataFrame:
    from ..functions.text import word_count

    return df.agg(F.count("*").alias("n_rows"), F.sum(word_count(F.col(text)).cast("long")).alias("words"), F.sum(F.char_length(text).cast("long")).alias("characters"), F.count_if(F.trim(text) == "").alias("empty"))


def count_mismatch(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys whose numbers of rows differ between two tables."""
    a = left.groupBy(key).agg(F.count("*").alias("n_left"))
    b = right.groupBy(key).agg(F.count("*").alias("n_right"))
    return a.join(b, key, "full").select(key, F.coalesce("n_left", F.lit(0)).alias("n_left"), F.coalesce("n_right", F.lit(0)).alias("n_right")).where("n_left != n_right")


def advertised_mismatch(df: DataFrame, key: str, stated: str, actual) -> DataFrame:
    return df.select(key, F.col(stated).alias("stated"), actual.alias("actual")).where("stated != actual")


def page_warnings(pages: DataFrame, key: str, required: tuple[str, ...] = ("page_number", "text", "word_count"), optional: tuple[str, ...] = ("has_section_marker", "has_parva_marker")) -> DataFrame:
    """(key, level, rule): pages without a required field (error), without an optional one or with an empty text (warning)."""
    flag = lambda hit, level, rule: F.when(hit, F.struct(F.lit(level).alias("level"), F.lit(rule).alias("rule")))
    flags = [flag(F.col(f).isNull(), "error", f"no {f}") for f in required] + [flag(F.col(f).isNull(), "warning", f"no {f}") for f in optional]
    flags.append(flag(F.trim(F.coalesce(F.col("text"), F.lit(""))) == "", "warning", "empty text"))
    return pages.select(key, F.explode(F.array_compact(F.array(*flags))).alias("f")).select(key, "f.level", "f.rule")


def structure_findings(tree: DataFrame, expected: int = 18, names=lexicon.BOOK_NAMES) -> DataFrame:
    """(level, rule, book, detail) about books (name, section_count, sections of section_number and paragraphs)."""
    row = lambda df, level, rule, book, detail: df.select(F.lit(level).alias("level"), F.lit(rule).alias("rule"), book.cast("string").alias("book"), detail.cast("string").alias("detail"))
    none = F.lit(None).cast("string")
    number = tree.agg(F.count("*").alias("n")).where(F.col("n") != expected)
    out = row(number, "error", "number of books", none, F.col("n"))
    twice = tree.groupBy("name").agg(F.count("*").alias("n")).where("n > 1")
    out = out.unionByName(row(twice, "error", "book twice", F.col("name"), F.col("n")))
    out = out.unionByName(row(tree.where(F.col("name").isNull() | ~F.col("name").isin(*names)).select("name").distinct(), "warning", "unknown name", F.col("name"), none))
    odd = tree.where("section_count != size(sections)")
    out = out.unionByName(row(odd, "warning", "section count", F.col("name"), F.size("sections")))
    opened = tree.select("name", F.posexplode("sections").alias("at", "s")).select("name", "at", F.trim(F.col("s.section_number").cast("string")).alias("number"), F.size("s.paragraphs").alias("n"))
    again = opened.groupBy("name", "number").agg(F.count("*").alias("n")).where("n > 1")
    out = out.unionByName(row(again, "error", "section twice", F.col("name"), F.col("number")))
    return out.unionByName(row(opened.where("n <= 0"), "warning", "empty section", F.col("name"), F.col("number")))


def structure_totals(tree: DataFrame) -> DataFrame:
    """One row: books, sections, paragraphs and empty sections."""
    n = F.transform("sections", lambda s: F.greatest(F.size(s["paragraphs"]), F.lit(0)))
    add = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    per = tree.select(F.size("sections").alias("s"), add(n).alias("p"), F.size(F.filter(n, lambda x: x == 0)).alias("e"))
    return per.agg(F.count("*").alias("books"), F.sum("s").alias("sections"), F.sum("p").alias("paragraphs"), F.sum("e").alias("empty_sections"))


def run_findings(chunks: DataFrame, metadata: DataFrame, stats: DataFrame, manifest: DataFrame, vectors: DataFrame, done: DataFrame, expected_dim: int, expected_books: int = 18) -> DataFrame:
    """(part, rule, level, stated, actual) of what a run's records say against what is there.

    One row each: ``metadata`` (chunk_count), ``stats`` (total_chunks, total_tokens, min_tokens, max_tokens)
    and ``manifest`` (dimension, count). ``vectors``: embedding; ``done``: book; ``chunks``: token_count.
    """
    real = chunks.agg(F.count("*").alias("n"), F.sum("token_count").alias("t"), F.min("token_count").alias("low"), F.max("token_count").alias("high"))
    sizes = vectors.agg(F.count("*").alias("v"), F.min(F.size("embedding")).alias("d0"), F.max(F.size("embedding")).alias("d1"))
    books = done.agg(F.countDistinct("book").alias("books"))
    m = metadata.agg(F.first("chunk_count").alias("m_n"))
    s = stats.agg(*[F.first(c).alias(f"s_{c}") for c in ("total_chunks", "total_tokens", "min_tokens", "max_tokens")])
    e = manifest.agg(F.first("dimension").alias("e_d"), F.first("count").alias("e_n"))
    one = real
    for other in (sizes, books, m, s, e):  # one row each
        one = one.crossJoin(F.broadcast(other))
    c = F.col
    rules = [
        ("metadata", "no chunk_count", "error", c("m_n").isNull(), c("m_n"), c("n")),
        ("metadata", "chunk_count", "warning", c("m_n") != c("n"), c("m_n"), c("n")),
        ("stats", "total_chunks", "warning", c("s_total_chunks") != c("n"), c("s_total_chunks"), c("n")),
        ("stats", "total_tokens", "warning", c("s_total_tokens") != c("t"), c("s_total_tokens"), c("t")),
        ("stats", "min_tokens", "warning", c("s_min_tokens") != c("low"), c("s_min_tokens"), c("low")),
        ("stats", "max_tokens", "warning", c("s_max_tokens") != c("high"), c("s_max_tokens"), c("high")),
        ("embeddings", "count", "warning", F.coalesce(c("e_n"), c("v")) != c("n"), F.coalesce(c("e_n"), c("v")), c("n")),
        ("embeddings", "dimension", "error", (c("d0") != c("e_d")) | (c("d1") != c("e_d")), c("e_d"), c("d1")),
        ("embeddings", "expected dimension", "warning", c("d1") != expected_dim, F.lit(expected_dim), c("d1")),
        ("checkpoint", "books", "warning", c("books") != expected_books, F.lit(expected_books), c("books")),
    ]
    flags = [F.when(hit, F.struct(F.lit(part).alias("part"), F.lit(rule).alias("rule"), F.lit(level).alias("level"), stated.cast("long").alias("stated"), actual.cast("long").alias("actual"))) for part, rule, level, hit, stated, actual in rules]
    return one.select(F.explode(F.array_compact(F.array(*flags))).alias("f")).select("f.*")


# inspectors: what a person looks at, as tables


def page_sample(pages: DataFrame, number: int, page: str = "page_number", text: str = "text", size: int = 1000) -> DataFrame:
    """One page: its first characters, and how many more there are."""
    return pages.where(F.col(page) == number).select(page, F.substring(text, 1, size).alias("sample"), F.greatest(F.char_length(text) - size, F.lit(0)).alias("more"))


def structure_summary(tree: DataFrame) -> DataFrame:
    """(name, sections, paragraphs) of each book."""
    n = F.aggregate(F.transform("sections", lambda s: F.size(s["paragraphs"])), F.lit(0), lambda s, x: s + x)
    return tree.select("name", F.size("sections").alias("sections"), n.alias("paragraphs"))


def section_sample(tree: DataFrame, name: str, section: str, start: int = 1, most: int = 1) -> DataFrame:
    """(para, text): paragraphs of a section, from the start-th."""
    opened = tree.where(F.lower("name") == name.lower()).select(F.explode("sections").alias("s")).where(F.col("s.section_number").cast("string") == section)
    return opened.select(F.posexplode("s.paragraphs").alias("at", "text")).where(F.col("at").between(start - 1, start + most - 2)).select((F.col("at") + 1).alias("para"), "text")


def report(**checks: DataFrame) -> DataFrame:
    """(name, violations) of each check; one row a check."""
    out = None
    for name, df in checks.items():
        one = df.agg(F.lit(name).alias("name"), F.count("*").alias("violations"))
        out = one if out is None else out.unionByName(one)
    return out
