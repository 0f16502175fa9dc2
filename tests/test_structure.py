"""Structure, planner and evidence functions by hand."""

from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.operators import evidence, graph, plan, quality, structure


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_books_sections_and_fallback(spark):
    text = "front\nSECTION I\nfirst body, in section V too\nSECTION II\nsecond\nSECTION I\nagain"
    docs = spark.createDataFrame([(1, text), (2, "no header at all")], "book int, text string")
    found = structure.spans(docs, structure.SECTION_HEADER, ["book"])
    assert [(r.number, r.body) for r in found.orderBy("at").collect()] == [("I", "first body, in section V too"), ("II", "second\nSECTION I\nagain")]
    every = structure.whole_text_sections(docs, found, ["book"])
    assert {(r.book, r.number) for r in every.collect()} == {(1, "I"), (1, "II"), (2, "FULL_TEXT")}


def test_front_matter(spark):
    pages = spark.createDataFrame([(n, "BOOK 1: ADI PARVA" if n in (10, 60) else "text") for n in range(1, 70)], "page_number int, text string")
    assert structure.after_front_matter(pages).agg(F.min("page_number")).first()[0] == 60
    assert structure.after_front_matter(pages.where("page_number < 20")).count() == 19


def test_book_names(spark):
    books = spark.createDataFrame([("ADI-PARVA continued",), ("bhisma parva",), ("Other",)], "name string")
    names = spark.createDataFrame([("Adi Parva",), ("Bhishma Parva",)], "book_name string")
    got = {r.name: r.canonical for r in structure.canonical_books(books, names, spellings={"Bhisma Parva": "Bhishma Parva"}).collect()}
    assert got == {"ADI-PARVA continued": "Adi Parva", "bhisma parva": "Bhishma Parva", "Other": "Other Parva"}


def test_text_functions(spark):
    row = one(
        spark,
        a=T.remove_noise(F.lit("Table of Contents Index x\nkeep\nDownloaded from: y\nrest")), b=T.entity_clean(F.lit("-the king of the ")), c=T.paragraph_normalize(F.lit("Index of things")),
        d=T.sentence_clean(F.lit("He said,--see http://x.y/z now  www.a.b m04037.htm end")), e=T.holds(F.lit("They STRUCK  down it"), F.lit("they struck  down it"), r"struck?\s+down|x(?:a|b)?y"), f=T.holds(F.lit("awarded"), F.lit("awarded"), "war"),
    )
    assert row.a.strip().endswith("keep\nrest") and row.b == "king of" and row.c is None and row.d == "He see now end" and row.e and not row.f
    assert T.alternatives("a|b(?:c|d)|e") == ["a", "b(?:c|d)", "e"]


def test_planner_lookups(spark):
    q = spark.createDataFrame([("Karna",), ("Nobody",)], "entity string")
    table = spark.createDataFrame([("karna", "Arjuna", ["arjuna", "partha"])], "entity string, agent string, names array<string>")
    assert {r.entity: r.agent for r in plan.agents(q, table).collect()} == {"Karna": "Arjuna", "Nobody": None}
    row = one(spark, a=plan.legacy_entities(F.lit("Where is KARNA?"), ["karna", "drona"]), b=plan.legacy_phases(F.lit("the dice game"), {"exile": ("forest",), "dice": ("dice", "game")}))
    assert row.a == ["karna"] and row.b == ["dice"]
    df = spark.createDataFrame([("Partha",), ("x",)], "t string")
    assert [r[0] for r in df.select(plan.legacy_alias(F.col("t"))).collect()] == ["Arjuna", "x"]


def test_names_types_and_roles(spark):
    row = one(spark, a=graph.entity_id(F.lit("PERSON"), F.lit("King Of X")), b=graph.infer_type(F.lit("the sage")), c=graph.infer_type(F.lit("the sage"), whole_words=True), d=graph.infer_type(F.lit("arjuna of the city")))
    assert row.a == "person_king_of_x" and row.b == "TIME" and row.c == "PERSON" and row.d == "PERSON"


def test_answers_and_bundles(spark):
    ranked = spark.createDataFrame([(1, i, f"c{i}", f"First {i}. Second.", 1.0 / i) for i in range(1, 12)], "qid int, rank int, chunk_id string, text string, score double")
    units = ranked.select("qid", "rank", F.col("chunk_id").alias("unit_id"), F.lit("p").alias("parva"), F.lit("s").alias("section"), F.lit(None).cast("string").alias("story_phase"), "text", F.array("text").alias("paragraphs"))
    shown = {r.qid: r for r in evidence.formatted(spark.createDataFrame([(1, "q", None), (2, "r", "given")], "qid int, text string, answer string"), units).collect()}
    assert shown[1].answer == "First 1. Second...." and shown[1].supporting[:2] == ["c1", "c2"] and shown[1].valid and "Story Phase: Unknown" in shown[1].display
    assert shown[2].answer == evidence.NO_UNITS and not shown[2].valid and shown[2].supporting == []
    ev = spark.createDataFrame([(1, "E1"), (1, "E1"), (1, "E2")], "qid int, event_id string")
    events, chunks = evidence.bundle(ev, ranked)
    assert events.count() == 2 and chunks.count() == 8
    row = one(spark, a=evidence.or_default(F.array().cast("array<string>"), F.array(*[F.lit(f"c{i}") for i in range(9)])))
    assert len(row.a) == 5


def test_checks(spark):
    good = spark.createDataFrame([(1, "a")], "k int, v string")
    bad = spark.createDataFrame([(1, None), (2, " ")], "k int, v string")
    got = {r.name: r.violations for r in quality.report(a=quality.missing_fields(good, "k", ["v"]), b=quality.missing_fields(bad, "k", ["v"]), c=quality.count_mismatch(good, bad, "k")).collect()}
    assert got == {"a": 0, "b": 2, "c": 1}
    entities = spark.createDataFrame([("p", "x" * 60, "ODD")], "entity_id string, canonical_name string, type string")
    assert graph.bad_types(entities).count() == 1 and graph.long_names(entities).count() == 1
    edges = spark.createDataFrame([("p", "e", [])], "source_id string, target_id string, evidence array<string>")
    assert graph.missing_evidence(edges).count() == 1
