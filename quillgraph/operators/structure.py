"""Documents to pages, books, sections and paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon
from ..functions import text as T


def lines(pattern: str) -> str:
    """A header's pattern for Java: case-insensitive, its ends at line feeds only, classes over Unicode."""
    return f"(?imdU){pattern}"


BOOK_HEADER, BOOK_HEADER_INLINE = lines(lexicon.BOOK_HEADER), lines(lexicon.BOOK_HEADER_INLINE)


def section_header(title: str | None = None) -> str:
    """Lines that start a section; with ``title`` (a pattern of the work's name) running headers that name it too."""
    running = rf"|{title}[^\n]*?Section" if title else ""
    return lines(rf"^[ \t]*(?:SECTION{running})[ \t]+([IVXLCDM]+|\d+)\b.*$")


SECTION_HEADER = section_header()


def page_metrics(pages: DataFrame, page: str = "page_number", text: str = "text") -> DataFrame:
    upper = F.upper(F.col(text))
    return pages.select(page, T.word_count(F.col(text)).alias("word_count"), upper.contains("SECTION").alias("has_section_marker"), upper.contains("PARVA").alias("has_parva_marker"))


def page_gaps(pages: DataFrame, page: str = "page_number") -> DataFrame:
    """Page numbers that are missing between the first and the last: gaps between neighbours, opened up."""
    ordered = pages.select(F.col(page).cast("long").alias("p")).where("p is not null").distinct()
    nexts = ordered.withColumn("bucket", F.floor(F.col("p") / 1000)).withColumn("n", F.lead("p").over(Window.partitionBy("bucket").orderBy("p")))
    # the last page of a bucket looks into the bucket that follows
    ends = ordered.groupBy(F.floor(F.col("p") / 1000).alias("bucket")).agg(F.min("p").alias("first"), F.max("p").alias("last"))
    follow = ends.withColumn("n", F.lead("first").over(Window.orderBy("bucket"))).select(F.col("last").alias("p"), "n")
    every = nexts.where("n is not null").select("p", "n").unionByName(follow.where("n is not null"))
    return every.where("n > p + 1").select(F.explode(F.sequence(F.col("p") + 1, F.col("n") - 1)).alias(page))


def after_front_matter(pages: DataFrame, page: str = "page_number", text: str = "text", least: int = 50, headers: tuple[str, ...] = (BOOK_HEADER, BOOK_HEADER_INLINE)) -> DataFrame:
    """Pages from the first header at or after ``least``; all of them if there is none."""
    found = F.lit(False)
    for h in headers:
        found = found | F.col(text).rlike(h)
    cut = pages.where((F.col(page) >= least) & found).agg(F.coalesce(F.min(page), F.lit(1)).alias("_cut"))
    return pages.crossJoin(F.broadcast(cut)).where(F.col(page) >= F.col("_cut")).drop("_cut")  # one row


def concat_pages(pages: DataFrame, key: list[str], page: str = "page_number", text: str = "text") -> DataFrame:
    """One text a book (key): its pages in order, with a blank line between. A book has to fit in a row,
    as headers and paragraphs may run over the ends of pages."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), F.col(text).alias("t"))))
    return pages.where(F.col(text).isNotNull()).groupBy(*key).agg(F.array_join(F.transform(ordered, lambda x: x["t"]), "\n\n").alias(text))


NUMBER, NAME, HEAD, REST = "\u0001", "\u0002", "\u0003", "\u0004"


def spans(docs: DataFrame, header: str, key: list[str], text: str = "text", named: bool = False, number=lambda c: F.trim(c)) -> DataFrame:
    """key, at, number, name, body: from each header to the next that has another number, in text order.

    A header whose number came before starts nothing: it stays in the body, as pages repeat them.
    Headers are marked once, so the text is not matched again. ``named``: the pattern's second group is a name.
    """
    bare = F.translate(F.col(text), NUMBER + NAME + HEAD + REST, "")
    parts = F.split(F.regexp_replace(bare, header, f"{NUMBER}$1{NAME}{'$2' if named else ''}{HEAD}$0{REST}"), NUMBER)
    rows = docs.select(*key, F.posexplode(parts).alias("at", "part")).where("at > 0")
    head, rest = F.substring_index("part", REST, 1), F.substring("part", F.locate(REST, F.col("part")) + 1, F.length("part"))
    label = F.substring_index(head, HEAD, 1)
    cut = rows.select(*key, "at", number(F.substring_index(label, NAME, 1)).alias("number"), F.trim(F.substring_index(label, NAME, -1)).alias("name"), F.substring_index(head, HEAD, -1).alias("head"), rest.alias("rest"))
    new = F.row_number().over(Window.partitionBy(*key, "number").orderBy("at")) == 1
    grouped = cut.withColumn("new", new).withColumn("g", F.sum(F.col("new").cast("int")).over(Window.partitionBy(*key).orderBy("at")))
    own = F.struct("at", F.when(F.col("new"), F.col("rest")).otherwise(F.concat("head", "rest")).alias("t"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(own)), lambda x: x["t"]), "")
    found = grouped.groupBy(*key, "g").agg(F.min("at").alias("at"), F.min_by("number", "at").alias("number"), F.min_by("name", "at").alias("name"), body.alias("body"))
    return found.select(*key, "at", "number", "name", F.regexp_replace("body", r"(?U)\A\s+|\s+\z", "").alias("body"))


def books(docs: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """Books of documents: by headers over several lines; in a document without any, by inline ones."""
    many = F.coalesce(F.col(text).rlike(BOOK_HEADER), F.lit(False))
    of = lambda rows, header: spans(rows, header, key, text, named=True, number=lambda c: c.try_cast("int"))
    return of(docs.where(many), BOOK_HEADER).unionByName(of(docs.where(~many), BOOK_HEADER_INLINE))


def parse(docs: DataFrame, key: list[str], text: str = "text", title: str | None = None) -> DataFrame:
    """(key, book, book_name, section_index, section, para, text): books, their narrative sections and paragraphs.

    A book without sections is one, FULL_TEXT; sections without paragraphs are left out.
    """
    found = canonical_books(books(docs, key, text), None, "name").select(*key, F.col("number").alias("book"), F.col("canonical").alias("book_name"), F.col("body").alias("text"))
    where = [*key, "book", "book_name"]
    cut = spans(found, section_header(title), where).select(*where, "at", "number", "body")
    paras = paragraphs(cut, [*where, "at", "number"], "body", "reference")
    kept = paras.join(narrative_sections(paras, where, "number", order="at"), [*where, "number"], "left_semi")
    bare = found.join(kept.select(*where).distinct(), where, "left_anti").withColumn("at", F.lit(0)).withColumn("number", F.lit("FULL_TEXT"))
    every = kept.unionByName(paragraphs(bare, [*where, "at", "number"], "text", "reference"))
    index = F.dense_rank().over(Window.partitionBy(*where).orderBy("at"))
    return every.select(*where, index.alias("section_index"), F.col("number").alias("section"), "para", "text")


def whole_text_sections(docs: DataFrame, sections: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """Sections, and for documents without any one that is the whole text."""
    bare = docs.join(sections.select(*key).distinct(), key, "left_anti").select(*key, F.lit(0).alias("at"), F.lit("FULL_TEXT").alias("number"), F.col(text).alias("body"))
    return sections.select(*key, "at", "number", "body").unionByName(bare)


def reference_paragraphs(text) -> Column:
    """Line ends become spaces unless blank lines follow; what is then between blank lines is a paragraph. A
    single one of over 400 characters is split into sentences that start with a capital."""
    strip = lambda x: F.regexp_replace(x, r"(?U)\A\s+|\s+\z", "")
    folded = F.regexp_replace(strip(text), r"(?U)\n(?!\s*\n)", " ")
    parts = F.filter(F.transform(F.split(folded, r"(?U)\n\s*\n+"), strip), lambda x: x != "")
    alone = (F.size(parts) == 1) & (F.length(parts[0]) > 400)
    cut = F.filter(F.transform(F.split(F.get(parts, 0), r"(?U)(?<=[.!?])\s+(?=[A-Z])"), strip), lambda x: x != "")
    return F.when(alone, cut).otherwise(parts)


def paragraphs(docs: DataFrame, key: list[str], text: str = "text", mode: str = "line") -> DataFrame:
    """Key, para, text. ``line``: a paragraph a line; ``blank_line``: between blank lines;
    ``reference``: see ``reference_paragraphs``."""
    if mode == "reference":
        found = reference_paragraphs(F.col(text))
    else:
        parts = F.split(F.col(text), "\n" if mode == "line" else r"\n\s*\n")
        found = F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")
    return docs.select(*key, F.posexplode(found).alias("para", "text"))


def normalized_paragraphs(paras: DataFrame, text: str = "text") -> DataFrame:
    return paras.withColumn(text, T.paragraph_normalize(F.col(text))).where(F.col(text).isNotNull() & (F.col(text) != ""))


def narrative_sections(paras: DataFrame, book: str | list[str], section: str, text: str = "text", least: int = 60, order: str | None = None) -> DataFrame:
    """Sections with a long or mixed-case paragraph, or after a section of the book that had a long one. ``order``: of sections, by default their own."""
    key = [book] if isinstance(book, str) else book
    long = F.max((F.length(text) >= least).cast("int"))
    mixed = F.max((F.col(text).rlike("[a-z].*[A-Z]|[A-Z].*[a-z]")).cast("int"))
    flags = paras.groupBy(*key, section).agg(long.alias("long"), mixed.alias("mixed"), F.min(order or section).alias("_at"))
    before = F.max("long").over(Window.partitionBy(*key).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1))
    return flags.withColumn("started", F.coalesce(before, F.lit(0))).where("long = 1 or mixed = 1 or started = 1").select(*key, section)


def canonical_books(books: DataFrame, names: DataFrame | None = None, name: str = "name", spellings=lexicon.BOOK_SPELLINGS, word: str = "Parva") -> DataFrame:
    """``canonical``: the listed name that is equal but for case, after spelling replacements; the titled name
    otherwise. ``names``: book_name, by default the lexicon's."""
    bare = F.regexp_replace(F.trim(F.regexp_replace(F.col(name), "-", " ")), rf"(?is)\s+{word}.*$", f" {word}")
    titled = F.initcap(bare)
    mended = F
    for wrong, right in spellings.items():
        mended = mended.when(titled == wrong, right)
    mended = mended.otherwise(titled) if spellings else titled
    whole = F.when(F.endswith(mended, F.lit(word)), mended).otherwise(F.concat(mended, F.lit(f" {word}")))
    if names is None:
        names = books.sparkSession.createDataFrame([(n,) for n in lexicon.BOOK_NAMES], "book_name string")
    keyed = books.withColumn("_titled", whole)
    listed = names.select(F.lower("book_name").alias("_k"), "book_name")
    return keyed.join(listed, F.lower("_titled") == F.col("_k"), "left").withColumn("canonical", F.coalesce("book_name", "_titled")).drop("_k", "book_name", "_titled")


def context_units(paras: DataFrame, group: list[str], size: int = 3, order: str = "para") -> DataFrame:
    """Consecutive groups of ``size`` paragraphs: group, unit, n_paragraphs, text."""
    unit = F.floor(F.col(order) / size)
    ordered = F.array_sort(F.collect_list(F.struct(order, "text")))
    return paras.groupBy(*group, unit.alias("unit")).agg(F.count("*").alias("n_paragraphs"), F.array_join(F.transform(ordered, lambda x: x["text"]), "\n\n").alias("text"))


def assemble(paras: DataFrame, book: str, section: str, order: str = "para", section_order: str | None = None) -> DataFrame:
    """The nested tree for export, a row for each book: sections with their paragraphs, in the order of ``section_order``."""
    at = F.min(section_order or section).alias("_at")
    per = paras.groupBy(book, section).agg(at, F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda x: x["text"]).alias("paragraphs"))
    ordered = F.array_sort(F.collect_list(F.struct("_at", F.col(section).alias("section_number"), F.size("paragraphs").alias("paragraph_count"), "paragraphs")))
    sections = F.transform(ordered, lambda x: F.struct(x["section_number"].alias("section_number"), x["paragraph_count"].alias("paragraph_count"), x["paragraphs"].alias("paragraphs")))
    return per.groupBy(book).agg(F.count("*").cast("int").alias("section_count"), sections.alias("sections"))


def duplicate_numbers(sections: DataFrame, book: str, section: str) -> DataFrame:
    return sections.groupBy(book, section).agg(F.count("*").alias("n")).where("n > 1")
