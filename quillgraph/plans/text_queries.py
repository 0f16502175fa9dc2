"""Queries over texts, structure, chunks and vectors. A document's source stands for its book, lines for
paragraphs, three lines for a chunk; lexicons are words that the tables hold or that are planted in them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunk, events, quality, structure, vector
from ..sources import io, pdf, storage
from . import samples as S
from .catalog import Catalog, table

CATALOG = Catalog()
query = CATALOG.add

SENTENCES = r"""list_filter(list_transform(string_split(regexp_replace({0}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')"""
WORDS = r"len(list_filter(regexp_split_to_array({0}, '\s+'), lambda x: x <> ''))"
PARAS = "paras AS (SELECT doc_id, source, lang, unnest(range(len(ps)))::INT AS para, unnest(ps) AS text FROM (SELECT doc_id, source, lang, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ps FROM documents))"


def docs(spark, folder):
    return storage.spread(table(spark, folder, "documents"))


def paras(spark, folder):
    return structure.paragraphs(docs(spark, folder), ["doc_id", "source", "lang"])


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)),
 lambda x: NOT regexp_matches(x, '^\d+$') AND NOT (starts_with(upper(x), 'THE ') AND NOT contains(upper(x), 'THAT'))), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '\A\s+|\s+\z', '', 'g') AS cleaned FROM documents""")
def page_clean(spark, folder):
    return docs(spark, folder).select("doc_id", T.page_clean(F.col("text"), headers=("THE ",), unless="THAT").alias("cleaned"))


@query(f"SELECT doc_id, {WORDS.format('text')}::INT AS word_count, contains(upper(text), 'SECTION') AS has_section_marker, contains(upper(text), 'PARVA') AS has_parva_marker FROM documents")
def page_metrics(spark, folder):
    return structure.page_metrics(docs(spark, folder), "doc_id")


@query("SELECT doc_id FROM (SELECT unnest(range(min(doc_id), max(doc_id) + 1)) AS doc_id FROM labels) WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def page_gaps(spark, folder):
    return structure.page_gaps(table(spark, folder, "labels"), "doc_id")


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(?:script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages")
def page_text(spark, folder):
    return table(spark, folder, "pages").select("page_id", T.strip_tags(F.col("html")).alias("text"))


@query(f"WITH {PARAS} SELECT doc_id, para, text FROM paras")
def line_paragraphs(spark, folder):
    return paras(spark, folder).select("doc_id", "para", "text")


@query(rf"WITH {PARAS}, n AS (SELECT doc_id, para, trim(regexp_replace(replace(text, chr(13), ''), '\s+', ' ', 'g')) AS text FROM paras) SELECT doc_id, para, text FROM n WHERE text <> '' AND NOT regexp_matches(text, '(?i)^(table of contents|index|downloaded|file:///)')")
def paragraph_normalize(spark, folder):
    return structure.normalized_paragraphs(paras(spark, folder)).select("doc_id", "para", "text")


@query(f"SELECT doc_id, unnest(range(len(s)))::INT AS sentence_index, unnest(s) AS sentence FROM (SELECT doc_id, {SENTENCES.format('text')} AS s FROM documents)")
def sentence_split(spark, folder):
    return docs(spark, folder).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("sentence_index", "sentence"))


@query(rf"""SELECT doc_id, sentence_index, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, 'https?://\S+', '', 'g'), 'file://\S+', '', 'g'), '(?i)\bm\d+\w*\.htm', '', 'g'), '\bwww\.\S+', '', 'g'),
 '(?i)\b(?:said|spoke|replied|answered|continued),?--', '', 'g'), '\s+', ' ', 'g')) AS sentence FROM (SELECT doc_id, unnest(range(len(s)))::INT AS sentence_index, unnest(s) AS s FROM (SELECT doc_id, {SENTENCES.format('text')} AS s FROM documents))""")
def sentence_clean(spark, folder):
    return events.sentence_table(docs(spark, folder), ["doc_id"])


@query(r"SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g')) AS name FROM part")
def name_normalize(spark, folder):
    return table(spark, folder, "part").select("p_partkey", T.name_normalize(F.col("p_name")).alias("name"))


_STOP = """'the','and','of','in','to','a','an','on','at','by','for','with','as','from','that','this','these','those','who','whom','whose','which','what','when','where','how','why',
 'is','was','were','are','be','been','it','its','their','his','her','him','she','he','they','them','you','your','yours','we','our','ours','but','or'"""


@query(f"""SELECT doc_id, len(t)::INT AS n_terms, array_to_string(t, ' ') AS terms FROM (SELECT doc_id, list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-zA-Z'']+'), lambda x: length(x) > 3 AND x NOT IN ({_STOP})))) AS t FROM documents)""")
def key_terms(spark, folder):
    t = T.key_terms(F.col("text"))
    return docs(spark, folder).select("doc_id", F.size(t).alias("n_terms"), F.array_join(t, " ").alias("terms"))


@query(r"SELECT doc_id, CASE WHEN length(text) <= 600 THEN text ELSE regexp_replace(substring(text, 1, 600), '\s\S*\z', '') || '...' END AS snippet FROM documents")
def snippets(spark, folder):
    return docs(spark, folder).select("doc_id", T.snippet(F.col("text")).alias("snippet"))


@query(f"WITH {PARAS} SELECT doc_id, (para // 3)::BIGINT AS unit, count(*) AS n_paragraphs, string_agg(text, chr(10) || chr(10) ORDER BY para) AS text FROM paras GROUP BY 1, 2")
def context_units(spark, folder):
    return structure.context_units(paras(spark, folder), ["doc_id"])


@query(f"""WITH {PARAS}, f AS (SELECT source, doc_id, max((length(text) >= 60)::INT) AS long, max((regexp_matches(text, '[a-z]') AND regexp_matches(text, '[A-Z]'))::INT) AS mixed FROM paras GROUP BY 1, 2),
 w AS (SELECT *, coalesce(max(long) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS started FROM f) SELECT source, doc_id FROM w WHERE long = 1 OR mixed = 1 OR started = 1""")
def narrative_running_filter(spark, folder):
    return structure.narrative_sections(paras(spark, folder), "source", "doc_id")


@query(f"""WITH {PARAS}, t AS (SELECT source, lang, count(*) AS n_paragraphs, md5(string_agg(text, '|' ORDER BY doc_id, para)) AS digest FROM paras GROUP BY 1, 2) SELECT source, (row_number() OVER (PARTITION BY source ORDER BY lang) - 1)::INT AS at_, lang, n_paragraphs, digest FROM t""")
def structure_assemble(spark, folder):
    tree = structure.assemble(paras(spark, folder).withColumn("para", F.struct("doc_id", "para")), "source", "lang")
    flat = tree.select("source", F.posexplode("sections").alias("at_", "s"))
    return flat.select("source", "at_", F.col("s.section_number").alias("lang"), F.col("s.paragraph_count").cast("long").alias("n_paragraphs"), F.md5(F.array_join("s.paragraphs", "|")).alias("digest"))


@query("SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_sections(spark, folder):
    return structure.duplicate_numbers(docs(spark, folder), "source", "lang")


@query(r"""WITH p AS (SELECT doc_id, string_split(regexp_replace(text, '\n(The|Is|And|La|Le|Die|Der)\b', chr(1) || '\1' || chr(2), 'g'), chr(1)) AS ps FROM documents),
 r AS (SELECT doc_id, unnest(range(len(ps)))::INT AS pos, unnest(ps) AS part FROM p),
 n AS (SELECT doc_id, pos, regexp_extract(part, '(?s)^([^\x02]*)\x02(.*)$', 1) AS number, regexp_extract(part, '(?s)^([^\x02]*)\x02(.*)$', 2) AS rest FROM r WHERE pos > 0),
 f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, number ORDER BY pos) = 1 AS new FROM n), g AS (SELECT *, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS grp FROM f)
 SELECT doc_id, min(pos) AS pos, arg_min(number, pos) AS number, regexp_replace(string_agg(CASE WHEN new THEN rest ELSE chr(10) || number || rest END, '' ORDER BY pos), '\A\s+|\s+\z', '', 'g') AS body FROM g GROUP BY doc_id, grp""")
def section_spans(spark, folder):
    """Headers that are words of the texts; a repeated one stays in the body."""
    return structure.spans(docs(spark, folder), r"\n(The|Is|And|La|Le|Die|Der)(?![A-Za-z0-9_])", ["doc_id"]).select("doc_id", F.col("at").alias("pos"), "number", "body")


def book_docs(spark, folder):
    return docs(spark, folder).select("doc_id", S.pick(S.BOOK_TEXTS, F.col("doc_id")).alias("text"))


BOOKS = [
    (0, 1, "ADI PARVA", "SECTION I\nThe first body, long enough to be a narrative paragraph of its own.\nSECTION II\nsecond Body\nSECTION I\nagain in section two"),
    (0, 2, "SABHA-PARVA", "no sections Here, only text."),
    (1, 3, "VANA PARVA", "The Chronicle, Book 3: Vana Parva: Section 4\nA tale of the forest, told at length so that it counts as narrative.\n\n\nIn section V they rest.\nsection V\nshort\nBOOK 3: VANA PARVA\nrepeated header"),
    (1, 4, "VIRATA PARVA", "CONTINUED\nSECTION X\nTales Untold"),
    (3, 12, "SANTI PARVA", "SECTION 1\nSECTION 2\nIn the beginning there was a king who ruled long and well over all lands.\nSECTION 3\nx"),
]
PARSED = [
    (0, 1, "Adi Parva", 1, "I", 0, "The first body, long enough to be a narrative paragraph of its own."), (0, 1, "Adi Parva", 2, "II", 0, "second Body SECTION I again in section two"), (0, 2, "Sabha Parva", 1, "FULL_TEXT", 0, "no sections Here, only text."),
    (1, 3, "Vana Parva", 1, "4", 0, "A tale of the forest, told at length so that it counts as narrative."), (1, 3, "Vana Parva", 1, "4", 1, "In section V they rest."), (1, 3, "Vana Parva", 2, "V", 0, "short BOOK 3: VANA PARVA repeated header"), (1, 4, "Virata Parva", 1, "X", 0, "Tales Untold"),
    (3, 12, "Shanti Parva", 1, "2", 0, "In the beginning there was a king who ruled long and well over all lands."), (3, 12, "Shanti Parva", 2, "3", 0, "x"),
]


@query(f"SELECT doc_id, number, name, body FROM documents JOIN {S.rows_of(BOOKS)} AS t(k, number, name, body) ON doc_id % 4 = k")
def book_spans(spark, folder):
    """Books of planted texts with headers of all forms; what they hold is written out by hand."""
    return structure.books(book_docs(spark, folder), ["doc_id"]).select("doc_id", "number", "name", "body")


@query(f"SELECT doc_id, book, book_name, section_index, section, para, t.text FROM documents JOIN {S.rows_of(PARSED)} AS t(k, book, book_name, section_index, section, para, text) ON doc_id % 4 = k")
def structure_parse(spark, folder):
    """Planted texts to books, sections by plain and running headers, and paragraphs."""
    return structure.parse(book_docs(spark, folder), ["doc_id"], title=r"The\s+Chronicle")


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 2 THEN 'FULL_TEXT' ELSE 'I' END AS number FROM documents")
def full_text_fallback(spark, folder):
    some = docs(spark, folder).select("doc_id", F.when(F.col("doc_id") % 4 == 2, F.col("text")).otherwise(F.concat(F.lit("SECTION I\n"), "text")).alias("text"))
    found = structure.spans(some, structure.SECTION_HEADER, ["doc_id"])
    return structure.whole_text_sections(some, found, ["doc_id"]).select("doc_id", "number")


SPELLED = ["ADI-PARVA continued", "SABHA PARVA", "Santi Parva", "aswamedha parva: part 2", "Other", "karna"]


@query(f"SELECT s_suppkey, {S.picked(['Adi Parva', 'Sabha Parva', 'Shanti Parva', 'Ashvamedhika Parva', 'Other Parva', 'Karna Parva'], 's_suppkey')} AS canonical FROM supplier")
def book_names(spark, folder):
    return structure.canonical_books(table(spark, folder, "supplier").select("s_suppkey", S.pick(SPELLED, F.col("s_suppkey")).alias("name"))).select("s_suppkey", "canonical")


@query(r"WITH p AS (SELECT doc_id, text FROM documents), c AS (SELECT coalesce(min(doc_id), 1) AS cut FROM p WHERE doc_id >= 50 AND regexp_matches(text, '(?i)^\s*De ')) SELECT doc_id FROM p, c WHERE doc_id >= cut")
def front_matter(spark, folder):
    """Pages from the first that starts with a header."""
    return structure.after_front_matter(docs(spark, folder), "doc_id", headers=(r"(?i)\A\s*De ",)).select("doc_id")


@query("SELECT conv_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn, text)) AS digest FROM conversations WHERE text IS NOT NULL GROUP BY 1")
def ordered_concat(spark, folder):
    """A conversation's turns as pages of one text."""
    return structure.concat_pages(table(spark, folder, "conversations"), ["conv_id"], "turn").select("conv_id", F.md5("text").alias("digest"))


@query(f"""WITH n AS (SELECT doc_id, text || {S.picked(S.NOTES, 'doc_id')} AS t FROM documents) SELECT doc_id, md5(regexp_replace(regexp_replace(t, '(?i)table of contents\\s+index[^\n]*', '', 'g'), '(?i)downloaded from:[^\n]*\n', '', 'g')) AS digest FROM n""".replace("\\\\", "\\"))
def noise_removal(spark, folder):
    return docs(spark, folder).select("doc_id", F.md5(T.remove_noise(F.concat("text", S.pick(S.NOTES, F.col("doc_id"))))).alias("digest"))


@query(rf"""WITH n AS (SELECT p_partkey, {S.picked(S.TEXTS + S.NOTES, 'p_partkey')} AS t FROM part), a AS (SELECT p_partkey, regexp_replace(t, '^[^\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+$', '', 'g') AS t FROM n),
 b AS (SELECT p_partkey, regexp_replace(regexp_replace(t, '(?i)^(?:the|a|an|and|or|but|with|of|from|to|for|in|by|at)\s+', ''), '(?i)\s+(?:the|a|an|and|or|but|with|of|from|to|for|in|by|at)$', '') AS t FROM a) SELECT p_partkey, trim(regexp_replace(t, '\s+', ' ', 'g')) AS cleaned FROM b""")
def entity_clean(spark, folder):
    return table(spark, folder, "part").select("p_partkey", T.entity_clean(S.pick(S.TEXTS + S.NOTES, F.col("p_partkey"))).alias("cleaned"))


SPACED = r"""d AS (SELECT doc_id, regexp_replace(CASE doc_id % 3 WHEN 0 THEN replace(text, chr(10), chr(10) || chr(10) || ' ' || chr(10)) WHEN 1 THEN replace(text, chr(10), chr(10) || ' ' || chr(10)) ELSE text END, '\A\s+|\s+\z', '', 'g') AS t FROM documents)"""


@query(rf"""WITH {SPACED}, m AS (SELECT doc_id, replace(regexp_replace(regexp_replace(regexp_replace(t, '\n\s*\n\s*\n\s*', chr(1), 'g'), '\n([^\S\n]*)\n', chr(2) || '\1 ', 'g'), '\n', ' ', 'g'), chr(2), chr(10)) AS t FROM d),
 s AS (SELECT doc_id, list_filter(list_transform(string_split(t, chr(1)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> '') AS ps FROM m),
 f AS (SELECT doc_id, CASE WHEN len(ps) = 1 AND length(ps[1]) > 400 THEN list_filter(list_transform(string_split(regexp_replace(ps[1], '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') ELSE ps END AS ps FROM s)
 SELECT doc_id, unnest(range(len(ps)))::INT AS para, unnest(ps) AS text FROM f""")
def reference_paragraphs(spark, folder):
    """Texts whose lines are set apart by three, two or one line ends."""
    text = F.when(F.col("doc_id") % 3 == 0, F.replace("text", F.lit("\n"), F.lit("\n\n \n"))).when(F.col("doc_id") % 3 == 1, F.replace("text", F.lit("\n"), F.lit("\n \n"))).otherwise(F.col("text"))
    return structure.paragraphs(docs(spark, folder).select("doc_id", text.alias("text")), ["doc_id"], mode="reference")


@query(rf"""WITH d AS (SELECT doc_id, replace(text, chr(10), chr(10) || chr(9) || chr(10)) AS t FROM documents), s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(t, '\n\s*\n', chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS ps FROM d) SELECT doc_id, unnest(range(len(ps)))::INT AS para, unnest(ps) AS text FROM s""")
def blank_line_paragraphs(spark, folder):
    text = F.replace("text", F.lit("\n"), F.lit("\n\t\n"))
    return structure.paragraphs(docs(spark, folder).select("doc_id", text.alias("text")), ["doc_id"], mode="blank_line")


# sources and sinks: written to the shared folder, read again


@query(f"SELECT page_id::INT AS page_number, length(html)::BIGINT AS size, {WORDS.format('html')}::INT AS word_count, contains(upper(html), 'SECTION') AS has_section_marker, contains(upper(html), 'PARVA') AS has_parva_marker FROM pages")
def page_sink_scan(spark, folder):
    pages = table(spark, folder, "pages").select(F.col("page_id").cast("int").alias("page_number"), F.col("html").alias("text"))
    path = storage.new_path(spark, "pages")
    io.write_pages(pages.join(structure.page_metrics(pages), "page_number"), path)
    return io.read_pages(spark, path).select("page_number", F.char_length("text").cast("long").alias("size"), "word_count", "has_section_marker", "has_parva_marker")


@query("SELECT 'f' || p_partkey AS path, 1 AS page_number, 'Section of ' || p_name AS text, len(string_split(p_name, ' '))::INT + 2 AS word_count, true AS has_section_marker FROM part UNION ALL SELECT 'f' || p_partkey, 3, p_brand, 1, false FROM part WHERE p_partkey % 3 <> 0")
def pdf_scan(spark, folder):
    """A file of each part: a page of its name, one with a page number only, which goes, and one of its brand, for some empty."""
    make = F.udf(lambda name, brand: bytearray(S.pdf_of([f"Section of {name}", "12", brand])), "binary")
    brand = F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.col("p_brand"))
    parts = storage.spread(table(spark, folder, "part").select("p_partkey", "p_name", "p_brand"))
    files = parts.select(F.concat(F.lit("f"), "p_partkey").alias("path"), make("p_name", brand).alias("content"))
    return pdf.pages_of(files).select("path", "page_number", "text", "word_count", "has_section_marker")


def tree_of(spark, folder):
    tree = structure.assemble(paras(spark, folder).withColumn("para", F.struct("doc_id", "para")), "source", "lang")
    return tree.select(F.substring("source", 4, 9).cast("int").alias("number"), F.col("source").alias("name"), "section_count", "sections")


@query(f"WITH {PARAS} SELECT substring(source, 4)::INT AS book_number, source AS book_name, (dense_rank() OVER (PARTITION BY source ORDER BY lang) - 1)::INT AS section_index, lang AS section_number, (row_number() OVER (PARTITION BY source, lang ORDER BY doc_id, para) - 1)::INT AS para, text FROM paras")
def structure_sink_scan(spark, folder):
    path = storage.new_path(spark, "structure")
    io.write_structure(tree_of(spark, folder), path, "tables", 0, "parsed")
    return io.explode_structure(io.read_structure(spark, path))


@query("SELECT 'c' || conv_id AS chunk_id, arg_max(text, turn) AS text, max(turn)::INT AS chunk_index FROM conversations GROUP BY 1")
def chunk_scan(spark, folder):
    """Chunks of equal id on several lines of a file: the last one stays."""
    path = storage.new_path(spark, "chunks")
    rows = table(spark, folder, "conversations").select("conv_id", "turn", F.concat(F.lit("c"), "conv_id").alias("chunk_id"), "text", F.col("turn").cast("int").alias("chunk_index"))
    io.write_json(rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn").select("chunk_id", "text", "chunk_index"), path)
    return io.read_chunks(spark, path).select("chunk_id", "text", "chunk_index")


@query("SELECT 'v' || vec_id AS chunk_id, 64 AS dimension, (SELECT count(*) FROM embeddings) AS count, round(list_sum(embedding::DOUBLE[]), 5) AS total FROM embeddings")
def embedding_manifest(spark, folder):
    v = vectors(spark, folder).select(F.concat(F.lit("v"), "vec_id").alias("chunk_id"), "embedding")
    path = storage.new_path(spark, "manifest")
    io.write_embeddings(v, v, path, "given")
    manifest, found = io.read_embeddings(spark, path)
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return found.crossJoin(F.broadcast(manifest)).select("chunk_id", "dimension", "count", F.round(total, 5).alias("total"))  # one row


@query(f"WITH {PARAS} SELECT doc_id, (para // 3)::BIGINT AS unit, 2::BIGINT AS n FROM paras GROUP BY 1, 2")
def context_unit_append(spark, folder):
    """Units that were appended twice stand twice."""
    path = storage.new_path(spark, "units")
    for _ in range(2):
        io.append_units(units(spark, folder), path)
    return io.read_json(spark, path, "doc_id long, unit long, text string").groupBy("doc_id", "unit").agg(F.count("*").alias("n"))


@query("SELECT text AS query, count(*) AS n, 2 AS retrieved FROM conversations WHERE role = 'user' GROUP BY 1")
def query_log(spark, folder):
    path = storage.new_path(spark, "log")
    asked = table(spark, folder, "conversations").where("role = 'user'")
    io.append_log(asked.select(F.col("text").alias("query"), F.array(F.lit("a"), F.lit("b")).alias("retrieved_chunk_ids"), F.array(F.lit("a")).alias("used_chunk_ids")), path)
    return io.read_json(spark, path, io.QUERY_LOG).where("timestamp is not null").groupBy("query").agg(F.count("*").alias("n"), F.max(F.size("retrieved_chunk_ids")).alias("retrieved"))


@query("SELECT sha256(string_agg(n_name || chr(10), '' ORDER BY n_nationkey)) AS sha256 FROM nation")
def file_hash(spark, folder):
    path = storage.new_path(spark, "file")
    table(spark, folder, "nation").coalesce(1).sortWithinPartitions("n_nationkey").select("n_name").write.text(path)
    return io.file_hashes(spark, path + "/*.txt").select("sha256")


@query("SELECT 1 AS step, true AS built, count(*) AS n FROM customer UNION ALL SELECT 2, false, count(*) FROM customer UNION ALL SELECT 3, true, count(*) FROM supplier UNION ALL SELECT 4, true, count(*) FROM supplier UNION ALL SELECT 5, true, count(*) FROM customer UNION ALL SELECT 6, true, count(*) FROM supplier")
def stage_checkpoint(spark, folder):
    """A stage is kept while its input is the same; a changed input drops it and what came after."""
    root = storage.new_path(spark, "stages")
    first, second = table(spark, folder, "customer"), table(spark, folder, "supplier")
    out = []
    for step, name, df in ((1, "one", first), (2, "one", first), (3, "two", second), (4, "one", second), (5, "one", first), (6, "two", second)):
        found, built = io.run_stage(spark, root, name, io.content_hash(df), lambda df=df: df)
        out.append((step, built, found.count()))
    return spark.createDataFrame(out, "step int, built boolean, n long")


@query("SELECT source, count(*) AS n FROM documents WHERE source NOT IN ('src1', 'src2') GROUP BY 1")
def book_resume(spark, folder):
    """What is left to do after two books were written."""
    path = storage.new_path(spark, "books")
    io.write_partitions(docs(spark, folder).where("source in ('src1', 'src2')"), path, "source")
    return io.remaining(docs(spark, folder), path, "source").groupBy("source").agg(F.count("*").alias("n"))


@query("SELECT 'same' AS state, true AS up_to_date UNION ALL SELECT 'other input', false UNION ALL SELECT 'other model', false UNION ALL SELECT 'forced', false UNION ALL SELECT 'no output', false")
def up_to_date_check(spark, folder):
    c, path = table(spark, folder, "customer"), storage.new_path(spark, "run")
    io.write_json(c.select("c_custkey"), f"{path}/out")
    h = io.content_hash(c)
    io.save_manifest(spark, f"{path}/manifest", {"status": "complete", "input_hash": h, "model": "m"})
    ask = lambda h, m, outputs, force=False: io.up_to_date(spark, f"{path}/manifest", h, m, outputs, force)
    rows = [("same", ask(h, "m", [f"{path}/out"])), ("other input", ask(io.content_hash(table(spark, folder, "supplier")), "m", [f"{path}/out"])), ("other model", ask(h, "n", [f"{path}/out"])), ("forced", ask(h, "m", [f"{path}/out"], True)), ("no output", ask(h, "m", [f"{path}/none"]))]
    return spark.createDataFrame(rows, "state string, up_to_date boolean")


# chunks


def units(spark, folder):
    """Three lines each: what stands for a chunk."""
    return structure.context_units(paras(spark, folder), ["doc_id", "source"]).withColumn("token_count", T.word_count(F.col("text")))


UNITS = PARAS + f", units AS (SELECT doc_id, source, para // 3 AS unit, string_agg(text, chr(10) || chr(10) ORDER BY para) AS text, sum({WORDS.format('text')})::INT AS t FROM paras GROUP BY 1, 2, 3)"


def md5_cell(w):
    """A word's cell by a hash that SQL has too."""
    return F.pmod(F.conv(F.substring(F.md5(w.cast("binary")), 1, 4), 16, 10).cast("int"), F.lit(64))


def embed(text):
    return vector.hashed_embedding(text, 64, md5_cell)


CELLS = "list_transform(list_filter(regexp_split_to_array(lower({0}), '\\s+'), lambda x: x <> ''), lambda w: ('0x' || md5(w)[1:4])::INT % 64)"
# paragraphs of over {0} words: their sentences packed one by one, into piece after piece
PIECES = """sized AS (SELECT doc_id, para, text, {words} AS n FROM paras), sents AS (SELECT doc_id, para, unnest(range(len(s)))::INT AS i, unnest(s) AS s FROM (SELECT doc_id, para, {sentences} AS s FROM sized WHERE n > {most})),
 ss AS (SELECT *, {swords} AS n FROM sents), rec AS (SELECT doc_id, para, i, s, n, 0 AS base, CASE WHEN n > {most} THEN ceil(n / {most})::INT ELSE 0 END AS cur, CASE WHEN n > {most} THEN 0 ELSE n END AS held FROM ss WHERE i = 0
 UNION ALL SELECT x.doc_id, x.para, x.i, x.s, x.n, CASE WHEN (x.n > {most} OR held + x.n > {most}) AND held > 0 THEN cur + 1 ELSE cur END, CASE WHEN x.n > {most} THEN cur + (held > 0)::INT + ceil(x.n / {most})::INT WHEN held + x.n > {most} AND held > 0 THEN cur + 1 ELSE cur END,
 CASE WHEN x.n > {most} THEN 0 WHEN held + x.n > {most} THEN x.n ELSE held + x.n END FROM rec JOIN ss x ON x.doc_id = rec.doc_id AND x.para = rec.para AND x.i = rec.i + 1),
 pieces AS (SELECT doc_id, para, 0 AS piece, text FROM sized WHERE n <= {most} AND n > 0 UNION ALL SELECT doc_id, para, base, string_agg(s, ' ' ORDER BY i) FROM rec WHERE n <= {most} GROUP BY 1, 2, 3
 UNION ALL SELECT doc_id, para, base + (k // {most})::INT, string_agg(w, ' ' ORDER BY k) FROM (SELECT doc_id, para, base, unnest(range(n)) AS k, unnest(list_filter(regexp_split_to_array(s, '\\s+'), lambda x: x <> '')) AS w FROM rec WHERE n > {most}) GROUP BY 1, 2, 3)"""
PIECES_OF = lambda most: PIECES.format(most=most, words=WORDS.format("text"), swords=WORDS.format("s"), sentences=SENTENCES.format("text"))


@query(f"WITH RECURSIVE {PARAS}, {PIECES_OF(12)} SELECT doc_id::VARCHAR AS section, para, piece, text, {WORDS.format('text')}::INT AS tokens FROM pieces")
def long_paragraph_split(spark, folder):
    """Lines of over twelve words as pieces of at most twelve."""
    return chunk.pieces(paras(spark, folder), "doc_id", most=12)


FOLD = f"""{PIECES_OF(800)}, p AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY para, text, piece) AS pos, text, {WORDS.format('text')} AS t FROM pieces),
 cell AS (SELECT doc_id, pos, c, count(*) AS n FROM (SELECT doc_id, pos, unnest({CELLS.format('text')}) AS c FROM p) GROUP BY 1, 2, 3), norm AS (SELECT doc_id, pos, sqrt(sum(n * n)) AS size FROM cell GROUP BY 1, 2),
 both_ AS (SELECT b.doc_id, b.pos, sum(a.n * b.n) AS dot FROM cell a JOIN cell b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 AND a.c = b.c GROUP BY 1, 2),
 q AS (SELECT p.doc_id, p.pos, text, t, coalesce(dot / (a.size * b.size), 0) AS alike FROM p JOIN norm b ON b.doc_id = p.doc_id AND b.pos = p.pos LEFT JOIN norm a ON a.doc_id = p.doc_id AND a.pos = p.pos - 1 LEFT JOIN both_ ON both_.doc_id = p.doc_id AND both_.pos = p.pos),
 f AS (SELECT doc_id, pos, 0 AS chunk, t AS size FROM q WHERE pos = 1 UNION ALL SELECT q.doc_id, q.pos, CASE WHEN size + t > 800 OR (size >= 450 AND alike < 0.35) THEN chunk + 1 ELSE chunk END, CASE WHEN size + t > 800 OR (size >= 450 AND alike < 0.35) THEN t ELSE size + t END FROM f JOIN q ON q.doc_id = f.doc_id AND q.pos = f.pos + 1),
 c AS (SELECT f.doc_id, chunk AS k, sum(t) AS size FROM f JOIN q ON q.doc_id = f.doc_id AND q.pos = f.pos GROUP BY 1, 2), cn AS (SELECT *, lead(size) OVER (PARTITION BY doc_id ORDER BY k) AS follow FROM c),
 m AS (SELECT doc_id, k, 0 AS new, CASE WHEN size < 120 AND size + follow <= 800 THEN size + follow ELSE size END AS last, coalesce(size < 120 AND size + follow <= 800, false) AS two FROM cn WHERE k = 0
 UNION ALL SELECT x.doc_id, x.k, CASE WHEN x.size < 120 AND last + x.size <= 800 THEN new ELSE new + 1 END, CASE WHEN x.size < 120 AND last + x.size <= 800 THEN last + x.size WHEN x.size < 120 AND x.size + follow <= 800 THEN x.size + follow ELSE x.size END,
 coalesce(x.size < 120 AND last + x.size > 800 AND x.size + follow <= 800, false) FROM m JOIN cn x ON x.doc_id = m.doc_id AND x.k = m.k + 1 + m.two::INT),
 named AS (SELECT doc_id, k, new FROM m UNION ALL SELECT doc_id, k + 1, new FROM m WHERE two), folded AS (SELECT q.doc_id, new + 1 AS chunk, string_agg(text, chr(10) || chr(10) ORDER BY q.pos) AS text, sum(t)::INT AS token_count, count(*)::INT AS n_paragraphs
 FROM q JOIN f ON f.doc_id = q.doc_id AND f.pos = q.pos JOIN named ON named.doc_id = q.doc_id AND named.k = f.chunk GROUP BY 1, 2)"""


@query(f"WITH RECURSIVE {PARAS}, {FOLD} SELECT doc_id::VARCHAR AS section, chunk::INT AS chunk, md5(text) AS digest, token_count, n_paragraphs FROM folded")
def chunk_fold(spark, folder):
    """Lines of each document folded into chunks, by the topics of their vectors."""
    return chunk.chunks(paras(spark, folder), "doc_id", embed=embed).select("section", "chunk", F.md5("text").alias("digest"), "token_count", "n_paragraphs")


@query(f"WITH {UNITS} SELECT source, count(*) AS chunks, sum(t)::BIGINT AS tokens, min(t) AS min_tokens, max(t) AS max_tokens, round(avg(t), 6) AS avg_tokens FROM units GROUP BY ROLLUP(source)")
def chunk_stats_rollup(spark, folder):
    return chunk.stats(units(spark, folder), "source").withColumn("avg_tokens", F.round("avg_tokens", 6))


@query(f"WITH {UNITS} SELECT count(*) FILTER (t < 40) AS below_floor, count(*) FILTER (t >= 40 AND t < 84) AS below_soft, count(*) FILTER (t >= 84 AND t < 120) AS below_preferred, count(*) FILTER (t > 800) AS above_max FROM units")
def token_buckets(spark, folder):
    return chunk.buckets(units(spark, folder))


@query(f"""WITH {UNITS}, u AS (SELECT doc_id // 2 || '-' || unit AS id, CASE WHEN doc_id % 9 = 0 THEN ' ' ELSE text END AS text, t FROM units), v AS (SELECT id, CASE WHEN t < 40 THEN 'floor' END AS rule FROM u UNION ALL SELECT id, CASE WHEN t >= 40 AND t < 84 THEN 'soft' END FROM u
 UNION ALL SELECT id, CASE WHEN t > 800 THEN 'max' END FROM u UNION ALL SELECT id, CASE WHEN trim(text) = '' THEN 'empty' END FROM u UNION ALL SELECT id, 'duplicate' FROM u GROUP BY id HAVING count(*) > 1) SELECT id, rule, count(*) AS n FROM v WHERE rule IS NOT NULL GROUP BY 1, 2""")
def chunk_validate(spark, folder):
    """Units whose id two documents share, some of them empty."""
    u = units(spark, folder).withColumn("id", F.concat(F.floor(F.col("doc_id") / 2).cast("string"), F.lit("-"), F.col("unit").cast("string"))).withColumn("text", F.when(F.col("doc_id") % 9 == 0, " ").otherwise(F.col("text")))
    return chunk.violations(u, "id").groupBy("id", "rule").agg(F.count("*").alias("n"))


@query(f"WITH {UNITS} SELECT 'h' AS input_hash, count(*) AS chunk_count, (SELECT string_agg(source || ':' || n, ',' ORDER BY source) FROM (SELECT source, count(*) AS n FROM units GROUP BY 1)) AS counts, 'words' AS tokenizer, 120 AS low, 800 AS high FROM units")
def chunk_metadata(spark, folder):
    m = chunk.metadata(units(spark, folder), "source", "h", "documents", "hashed", "words")
    counts = F.array_join(F.transform(F.array_sort(F.map_entries("book_chunk_counts")), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")
    return m.where("created_at is not null").select("input_hash", "chunk_count", counts.alias("counts"), "tokenizer", F.col("token_limits")["min_tokens"].alias("low"), F.col("token_limits")["max_tokens"].alias("high"))


@query(f"""WITH {UNITS}, r AS (SELECT count(*) AS n, sum(t)::BIGINT AS t, min(t) AS low, max(t) AS high FROM units), e AS (SELECT count(*) AS v FROM embeddings) SELECT 'metadata' AS part, 'chunk_count' AS rule, 'warning' AS level, n + 1 AS stated, n AS actual FROM r UNION ALL SELECT 'stats', 'total_tokens', 'warning', t - 5, t FROM r
 UNION ALL SELECT 'stats', 'max_tokens', 'warning', 7, high FROM r UNION ALL SELECT 'embeddings', 'count', 'warning', v, n FROM r, e UNION ALL SELECT 'embeddings', 'dimension', 'error', 32, 64 UNION ALL SELECT 'embeddings', 'expected dimension', 'warning', 768, 64 UNION ALL SELECT 'checkpoint', 'books', 'warning', 18, (SELECT count(DISTINCT source) FROM documents)""")
def run_cross_checks(spark, folder):
    """Records of a run of which some state other numbers than there are."""
    u, v = units(spark, folder), vectors(spark, folder)
    real = u.agg(F.count("*").alias("n"), F.sum("token_count").alias("t"), F.min("token_count").alias("low"))
    stats = real.select(F.col("n").alias("total_chunks"), (F.col("t") - 5).alias("total_tokens"), F.col("low").alias("min_tokens"), F.lit(7).alias("max_tokens"))
    manifest = v.agg(F.lit(32).alias("dimension"), F.count("*").alias("count"))
    return quality.run_findings(u, real.select((F.col("n") + 1).alias("chunk_count")), stats, manifest, v, docs(spark, folder).select(F.col("source").alias("book")), 768)


FLAWED_TREE = """b AS (SELECT source, CASE source WHEN 'src1' THEN 'Adi Parva' WHEN 'src2' THEN 'Adi Parva' WHEN 'src3' THEN 'Karna Parva' ELSE source END AS name, lang, count(*) AS n FROM documents GROUP BY 1, 2, 3)"""


@query(f"""WITH {FLAWED_TREE}, t AS (SELECT source, name, count(*) AS s FROM b GROUP BY 1, 2) SELECT 'error' AS level, 'number of books' AS rule, NULL AS book, count(*)::VARCHAR AS detail FROM t UNION ALL SELECT 'error', 'book twice', 'Adi Parva', '2' UNION ALL SELECT DISTINCT 'warning', 'unknown name', name, NULL FROM t WHERE name LIKE 'src%'
 UNION ALL SELECT 'warning', 'section count', name, (s + 2)::VARCHAR FROM t WHERE source = 'src3' UNION ALL SELECT 'error', 'section twice', name, 'xx' FROM t WHERE source = 'src3' UNION ALL SELECT 'warning', 'empty section', name, 'xx' FROM t, range(2) WHERE source = 'src3'
 UNION ALL SELECT 'error', 'section twice', 'Adi Parva', lang FROM b WHERE name = 'Adi Parva' GROUP BY lang HAVING count(*) > 1""")
def structure_check(spark, folder):
    """Twenty books, of which two have one name and one has two empty sections of one number."""
    tree = tree_of(spark, folder)
    name = F.when(F.col("name").isin("src1", "src2"), "Adi Parva").when(F.col("name") == "src3", "Karna Parva").otherwise(F.col("name"))
    extra = F.array_repeat(F.struct(F.lit("xx").alias("section_number"), F.lit(0).alias("paragraph_count"), F.array().cast("array<string>").alias("paragraphs")), 2)
    return quality.structure_findings(tree.select(name.alias("name"), "section_count", F.when(F.col("name") == "src3", F.concat("sections", extra)).otherwise(F.col("sections")).alias("sections")))


@query(f"WITH {PARAS} SELECT count(DISTINCT source) AS books, count(DISTINCT (source, lang)) AS sections, count(*) AS paragraphs, 0::BIGINT AS empty_sections FROM paras")
def structure_totals(spark, folder):
    return quality.structure_totals(tree_of(spark, folder))


@query(f"""WITH {PARAS}, s AS (SELECT source, lang, count(*) AS n FROM paras GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (ORDER BY doc_id, para) AS r FROM paras WHERE source = 'src5' AND lang = 'en') SELECT 'book ' || source AS what, count(*)::INT AS a, sum(n)::INT AS b, NULL AS text FROM s GROUP BY source
 UNION ALL SELECT 'paragraph', r::INT, 0, text FROM o WHERE r BETWEEN 2 AND 4 UNION ALL SELECT 'page', 7, greatest(length(text) - 100, 0)::INT, substring(text, 1, 100) FROM documents WHERE doc_id = 7""")
def inspect_structure(spark, folder):
    """What a person looks at: a summary of books, some paragraphs of a section, a page."""
    tree = tree_of(spark, folder)
    a = quality.structure_summary(tree).select(F.concat(F.lit("book "), "name").alias("what"), F.col("sections").alias("a"), F.col("paragraphs").alias("b"), F.lit(None).cast("string").alias("text"))
    b = quality.section_sample(tree, "SRC5", "en", 2, 3).select(F.lit("paragraph").alias("what"), F.col("para").alias("a"), F.lit(0).alias("b"), "text")
    c = quality.page_sample(docs(spark, folder), 7, "doc_id", size=100).select(F.lit("page").alias("what"), F.col("doc_id").cast("int").alias("a"), F.col("more").alias("b"), F.col("sample").alias("text"))
    return a.unionByName(b).unionByName(c)


@query("""SELECT doc_id, printf('P%02d-S%03d-C%03d', length(source), length(lang), chunk_index) AS chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS chunk_index FROM documents)""")
def chunk_ids(spark, folder):
    rows = chunk.numbered(docs(spark, folder), ["source", "lang"], "doc_id")
    return rows.select("doc_id", chunk.chunk_id(F.length("source"), F.length("lang"), F.col("chunk_index")).alias("chunk_id"))


def vectors(spark, folder):
    return table(spark, folder, "embeddings")


def expansions(spark, folder):
    """Every twentieth vector is a query; a hundred consecutive ids are expansions of one question."""
    return vectors(spark, folder).where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.floor(F.col("vec_id") / 100).alias("question"), F.transform("embedding", lambda x: x.cast("double")).alias("q"))


TOP = "q AS (SELECT vec_id AS qid, vec_id // 100 AS question, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT qid, question, vec_id, label, list_inner_product(q, embedding::DOUBLE[]) AS score FROM q, embeddings), t AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 30)"


def found(spark, folder, k=30):
    return vector.top_k(expansions(spark, folder), vectors(spark, folder), k)


@query(f"WITH {TOP} SELECT qid, vec_id, rank::INT AS rank, round(score, 6) AS score FROM t")
def knn_topk(spark, folder):
    return found(spark, folder).select("qid", "vec_id", "rank", F.round("score", 6).alias("score"))


@query(f"WITH {TOP} SELECT question, vec_id, round(max(score), 6) AS score FROM t GROUP BY 1, 2")
def knn_expanded_merge(spark, folder):
    return vector.merged(found(spark, folder), key="question").withColumn("score", F.round("score", 6))


BOOSTS = [(0, 1.08), (1, 1.10), (2, 1.05)]


@query(f"WITH {TOP} SELECT question, vec_id, round(max(score * CASE label WHEN 0 THEN 1.08 WHEN 1 THEN 1.10 WHEN 2 THEN 1.05 ELSE 1.0 END), 6) AS score FROM t GROUP BY 1, 2")
def knn_boosted(spark, folder):
    boosts = spark.createDataFrame(BOOSTS, "label int, boost double")
    return vector.merged(found(spark, folder), boosts, "label", key="question").withColumn("score", F.round("score", 6))


@query(f"WITH {TOP} SELECT qid, vec_id, rank::INT AS rank FROM t WHERE label = 3")
def knn_postfilter(spark, folder):
    return found(spark, folder).where("label = 3").select("qid", "vec_id", "rank")


FLAWED = "v AS (SELECT vec_id, CASE WHEN vec_id % 11 = 0 THEN NULL WHEN vec_id % 7 = 0 THEN embedding[1:63] ELSE embedding END AS e FROM embeddings WHERE vec_id % 13 <> 5)"


@query(f"WITH {FLAWED} SELECT vec_id AS id, 'dimension' AS rule FROM v WHERE e IS NULL OR len(e) <> 64 UNION ALL SELECT vec_id, 'no vector' FROM embeddings WHERE vec_id % 13 = 5")
def embedding_checks(spark, folder):
    """Vectors of which some are missing, null or too short."""
    every = vectors(spark, folder)
    k = F.col("vec_id")
    flawed = every.where(k % 13 != 5).withColumn("embedding", F.when(k % 11 == 0, None).when(k % 7 == 0, F.slice("embedding", 1, 63)).otherwise(F.col("embedding")))
    short = vector.dimension_errors(flawed, 64).select(k.alias("id"), F.lit("dimension").alias("rule"))
    return short.unionByName(vector.without_vector(every, flawed, "vec_id").select(k.alias("id"), F.lit("no vector").alias("rule")))


@query("SELECT vec_id, i::INT AS i, round(embedding[i + 1]::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS x FROM embeddings, range(64) AS t(i)")
def vector_normalize(spark, folder):
    return vectors(spark, folder).select("vec_id", F.posexplode(vector.unit(F.col("embedding"))).alias("i", "x")).withColumn("x", F.round("x", 6))


@query("""WITH n AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: (x / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])))::FLOAT::DOUBLE) AS e FROM (SELECT vec_id, list_transform(embedding, lambda x: x * (1 + vec_id % 3)) AS embedding FROM embeddings)), s AS (SELECT a.vec_id AS qid, b.vec_id, list_inner_product(a.e, b.e) AS score FROM n a, n b WHERE a.vec_id % 20 = 0)
 SELECT qid, vec_id, round(score, 5) AS score FROM s QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) <= 5""")
def index_search(spark, folder):
    """Vectors of three lengths, stored as an index of unit vectors, loaded and searched."""
    long = vectors(spark, folder).select("vec_id", F.transform("embedding", lambda x: x * (1 + F.col("vec_id") % 3)).alias("embedding"))
    index = vector.ensure_index(long, storage.new_path(spark, "index"))
    asked = index.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    return vector.top_k(asked, index, 5).select("qid", "vec_id", F.round("score", 5).alias("score"))


@query("""WITH f AS (SELECT label, arg_min(embedding, vec_id) AS base FROM embeddings GROUP BY label) SELECT vec_id, round(list_inner_product(embedding::DOUBLE[], base::DOUBLE[]) / (sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_inner_product(base::DOUBLE[], base::DOUBLE[]))), 6) AS cosine FROM embeddings JOIN f USING (label)""")
def cosine_pairs(spark, folder):
    v = vectors(spark, folder)
    first = v.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("base"))
    return v.join(first, "label").select("vec_id", F.round(vector.cosine(F.col("embedding"), F.col("base")), 6).alias("cosine"))


@query(f"WITH c AS (SELECT doc_id, {CELLS.format('text')} AS c FROM documents) SELECT doc_id, array_to_string(list_transform(range(64), lambda i: len(list_filter(c, lambda x: x = i))), ',') AS counts FROM c")
def hashed_embedding(spark, folder):
    e = docs(spark, folder).select("doc_id", embed(F.col("text")).alias("e"))
    return e.select("doc_id", F.array_join(F.transform("e", lambda x: x.cast("int").cast("string")), ",").alias("counts"))


def measure():
    """A service that stands for a model: it answers in another order than asked."""
    return lambda texts: [(i, [float(len(t)), float(t.count(" "))]) for i, t in reversed(list(enumerate(texts)))]


@query("SELECT doc_id, length(text)::DOUBLE AS size, (length(text) - length(replace(text, ' ', '')))::DOUBLE AS spaces FROM documents")
def embedding_service(spark, folder):
    e = vector.embed_batches(docs(spark, folder), "doc_id", "text", measure)
    return e.select("doc_id", F.col("embedding")[0].cast("double").alias("size"), F.col("embedding")[1].cast("double").alias("spaces"))


@query(f"""SELECT count(*) AS n_rows, sum({WORDS.format('text')})::BIGINT AS words, sum(length(text))::BIGINT AS characters, count(*) FILTER (trim(text) = '') AS empty FROM documents""")
def corpus_totals(spark, folder):
    return quality.totals(docs(spark, folder))


@query("SELECT doc_id, n_chars + (doc_id % 5 = 0)::INT AS stated, length(text)::BIGINT AS actual FROM documents WHERE n_chars + (doc_id % 5 = 0)::INT <> length(text)")
def advertised_counts(spark, folder):
    """Every fifth document states one character too many."""
    d = docs(spark, folder).withColumn("n_chars", F.col("n_chars") + (F.col("doc_id") % 5 == 0).cast("int"))
    return quality.advertised_mismatch(d, "doc_id", "n_chars", F.char_length("text").cast("long"))


@query("SELECT doc_id, count(*) FILTER (k = 1) AS n_left, count(*) FILTER (k = 2) AS n_right FROM (SELECT doc_id, 1 AS k FROM documents UNION ALL SELECT doc_id, 2 FROM labels) GROUP BY doc_id HAVING n_left <> n_right")
def embedding_count_mismatch(spark, folder):
    return quality.count_mismatch(docs(spark, folder), table(spark, folder, "labels"), "doc_id")


@query("SELECT conv_id, turn, f AS field FROM (SELECT conv_id, turn, CASE WHEN turn % 3 = 1 OR trim(coalesce(role, '')) = '' THEN 'role' END AS f FROM conversations UNION ALL SELECT conv_id, turn, CASE WHEN turn % 4 = 2 OR trim(coalesce(text, '')) = '' THEN 'text' END FROM conversations) WHERE f IS NOT NULL")
def required_fields(spark, folder):
    """Turns of which some have a null role or a blank text."""
    c, k = table(spark, folder, "conversations"), F.col("turn")
    flawed = c.withColumn("role", F.when(k % 3 == 1, None).otherwise(F.col("role"))).withColumn("text", F.when(k % 4 == 2, "  ").otherwise(F.col("text"))).withColumn("id", F.struct("conv_id", "turn"))
    return quality.missing_fields(flawed, "id", ["role", "text"]).select("id.conv_id", "id.turn", "field")


@query("""SELECT doc_id, level, rule FROM (SELECT doc_id, 'error' AS level, 'no text' AS rule, doc_id % 10 = 1 AS hit FROM documents UNION ALL SELECT doc_id, 'warning', 'empty text', doc_id % 10 = 1 OR trim(text) = '' FROM documents UNION ALL SELECT doc_id, 'error', 'no word_count', doc_id % 10 = 2 FROM documents UNION ALL SELECT doc_id, 'warning', 'no has_parva_marker', doc_id % 10 = 3 FROM documents) WHERE hit""")
def page_warnings(spark, folder):
    """Pages of which some lack a field."""
    k = F.col("doc_id")
    d = docs(spark, folder).select(k, k.alias("page_number"), F.when(k % 10 != 1, F.col("text")).alias("text"), F.when(k % 10 != 2, F.lit(1)).alias("word_count"), F.lit(True).alias("has_section_marker"), F.when(k % 10 != 3, F.lit(True)).alias("has_parva_marker"))
    return quality.page_warnings(d, "doc_id")
