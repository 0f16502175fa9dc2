"""The whole way on a few hand-written chunks."""

from pyspark.sql import functions as F

from quillgraph.operators import graph, resolve
from quillgraph.plans import engine

CHUNKS = [
    ("P01-S001-C001", "Arjuna killed Karna in battle. Arjuna slew Jayadratha. Partha killed Karna near Kurukshetra."),
    ("P01-S001-C002", "Bhishma vowed an oath for Duryodhana. Bhishma commanded Duryodhana to wait."),
    ("P01-S001-C003", "Dhrishtadyumna slew Drona. Dhrishtadyumna bestowed a gift on Arjuna. Drona died in the war."),
]


def test_documents_to_answers(spark, tmp_path):
    chunks = spark.createDataFrame(CHUNKS, "chunk_id string, text string")
    built = engine.build_graph(chunks, graph.alias_table(spark))
    engine.save(str(tmp_path / "kg"), *built)
    questions = spark.createDataFrame([(1, "Who killed Karna?"), (2, "Why did Bhishma support Duryodhana?"), (3, "Who benefited from Drona's death?"), (4, "Who killed Nobody?")], "qid int, text string")
    entities, nodes, edges = engine.io.read_graph(spark, str(tmp_path / "kg"))
    asked, matched = engine.ask(questions, entities, nodes, edges)
    by = {r.qid: r for r in asked.collect()}
    assert by[1].seeds == ["karna"] and by[2].intent == "CAUSAL" and by[4].seeds == []
    kinds = {(r.qid, r.type) for r in matched.select("qid", "type").collect()}
    assert (1, "KILL") in kinds and any(q == 2 for q, _ in kinds) and not any(q == 4 for q, _ in kinds)
    answers = engine.answers(asked, matched, entities).collect()
    top = {r.qid: r for r in answers if r.rank in (None, 1)}
    assert top[1].answer_type == "ENTITY" and top[1].entity_id == "person_arjuna"
    assert top[4].answer_type == "NO_ANSWER" and top[4].confidence == "high" and {r.qid for r in answers} == {1, 2, 3, 4}
    assert engine.validation(entities, nodes, edges).where("name = 'entity_types'").first().violations == 0
    assert engine.io.read_json(spark, str(tmp_path / "kg" / "validation_report"), "name string, violations long").count() == 5
    _, one = engine.run_question(spark, str(tmp_path / "kg"), "Who killed Karna?")
    assert one.count() == matched.where("qid = 1").count()
    assert {r.chunk_id for r in engine.retrieve(questions.where("qid = 1"), chunks, most=1).collect()} == {"P01-S001-C001"}


def test_causal_and_temporal_questions_are_answered(spark):
    """A vow before a support is a chain; events after a death are a list; unknown intents have no answer."""
    ev = [("E0", 0, "VOW", ["b"]), ("E1", 1, "SUPPORTED", ["b", "d"]), ("E2", 2, "DEATH", ["k"]), ("E3", 3, "BATTLE", ["k", "b"]), ("E4", 4, "BATTLE", ["b", "d"])]
    nodes = spark.createDataFrame(ev, "event_id string, ordinal long, type string, participants array<string>")
    entities = spark.createDataFrame([(e, "PERSON", 2) for e in "bdk"], "entity_id string, type string, event_count long")
    plans = spark.createDataFrame([(1, "CAUSAL", ["SUPPORTED"], None), (2, "TEMPORAL", ["BATTLE"], "AFTER"), (3, "TEMPORAL", ["BATTLE"], "BEFORE"), (4, "OTHER", ["BATTLE"], None)], "qid int, intent string, targets array<string>, temporal_order string").withColumn("agent_required", F.lit(False))
    seeds = spark.createDataFrame([(1, "b"), (2, "k"), (3, "k"), (4, "b")], "qid int, entity_id string")
    matches = spark.createDataFrame([(q,) for q in (1, 2, 3, 4)], "qid int").crossJoin(nodes)
    got = {}
    for r in resolve.answers(plans, seeds, matches, entities).collect():
        got.setdefault(r.qid, []).append((r.answer_type, r.rank, r.event_id, r.chain, r.confidence))
    assert got[1] == [("CHAIN", 1, None, ["b", "E0", "d", "E1"], "medium")]
    assert sorted(got[2]) == [("EVENT_LIST", 1, "E3", None, "medium"), ("EVENT_LIST", 2, "E4", None, "medium")]
    assert sorted(x[:3] for x in got[3]) == [("EVENT_LIST", 1, "E1"), ("EVENT_LIST", 2, "E0")]
    assert got[4] == [("NO_ANSWER", None, None, None, "high")]
