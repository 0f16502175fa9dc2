"""Graph queries against a plain model on seeded random graphs, and graph building by hand."""

import random

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import lexicon
from quillgraph.operators import events, evidence, graph, kgquery, plan, resolve
from quillgraph.sources import io

KINDS = ["KILL", "DEATH", "BATTLE", "VOW", "SUPPORTED"]


def random_graph(seed):
    rng = random.Random(seed)
    people = [f"P{i}" for i in range(8)]
    ev = {f"E{i}": (rng.choice(KINDS), [rng.choice(people) for _ in range(rng.randint(1, 3))]) for i in range(25)}
    edges = sorted({(p, e) for e, (_, ps) in ev.items() for p in ps})
    return people, ev, edges


def frames(spark, people, ev, edges):
    e = spark.createDataFrame([(k, int(k[1:]), t, p) for k, (t, p) in ev.items()], "event_id string, ordinal long, type string, participants array<string>")
    d = spark.createDataFrame(edges, "source_id string, event_id string")
    n = spark.createDataFrame([(p, p.lower(), "PERSON", [p], 0) for p in people], "entity_id string, canonical_name string, type string, aliases array<string>, event_count int")
    return n, d, e


def asked(spark, seeds, targets, intent="FACT", agent=False, order=None, depth=2):
    return spark.createDataFrame([(1, intent, seeds, targets, agent, order, depth)], "qid int, intent string, seeds array<string>, targets array<string>, agent_required boolean, temporal_order string, depth int")


def bfs(ev, edges, seeds, targets, most):
    seen, queue, found = set(seeds), [(s, 0) for s in seeds], {}
    while queue:
        who, d = queue.pop(0)
        for p, e in edges:
            if p != who or e in found or ev[e][0] not in targets:
                continue
            found[e] = d
            if d < most:
                for o in ev[e][1]:
                    if o not in seen:
                        seen.add(o)
                        queue.append((o, d + 1))
    return found


@pytest.mark.parametrize("seed", range(3))
def test_executors_equal_the_model(spark, seed):
    people, ev, edges = random_graph(seed)
    n, d, e = frames(spark, people, ev, edges)
    index = kgquery.alias_index(n)
    targets = ["KILL", "DEATH", "VOW"]
    of = lambda **k: kgquery.resolve_seeds(asked(spark, ["p1", "P3", "nobody"], k.pop("targets", targets), **k), index)
    mine = {x for p, x in edges if p in ("P1", "P3")}
    assert {r.event_id for r in kgquery.fact(of(), d, e).collect()} == {x for x in mine if ev[x][0] in targets}
    assert {r.event_id for r in kgquery.fact(of(targets=[], agent=True), d, e).collect()} == {x for x in mine if len(ev[x][1]) >= 2}
    assert {r.event_id: r.hop for r in kgquery.causal(of(), d, e, 2).collect()} == bfs(ev, edges, ["P1", "P3"], targets, 2)
    seeds = sorted((p, x) for p, x in edges if p in ("P1", "P3") and ev[x][0] in targets)
    assert sorted((r.entity_id, r.event_id) for r in kgquery.seed_events(of(), d, e).collect()) == seeds
    if seeds:
        last = int(max(x for _, x in seeds)[1:])
        want = [x for x in sorted(ev) if int(x[1:]) > last and ev[x][0] in targets][:20]
        got = kgquery.temporal(of(order="AFTER"), d, e).orderBy("rank").collect()
        assert [r.event_id for r in got] == want
        first = int(min(x for _, x in seeds)[1:])
        want = [x for x in sorted(ev, reverse=True) if int(x[1:]) < first and ev[x][0] in targets][:20]
        assert [r.event_id for r in kgquery.temporal(of(order="BEFORE"), d, e).orderBy("rank").collect()] == want
    trig = {x for _, x in seeds if ev[x][0] in lexicon.TRIGGER_TYPES}
    near = {q for x in trig for q in ev[x][1]}
    cons = {x for p, x in edges if p in near and ev[x][0] in targets} - trig
    got = {(r.phase, r.event_id) for r in kgquery.multi_hop(of(), d, e).collect()}
    assert got == {("TRIGGER", x) for x in trig} | {("CONSEQUENCE", x) for x in cons}


def test_depth_follows_the_plans(spark):
    """A plan of depth 3 is followed to its end, beside one of depth 1."""
    ev = {f"E{i}": ("VOW", [f"P{i}", f"P{i + 1}"]) for i in range(6)}
    edges = sorted({(p, e) for e, (_, ps) in ev.items() for p in ps})
    n, d, e = frames(spark, [f"P{i}" for i in range(7)], ev, edges)
    deep = asked(spark, ["p0"], ["VOW"], "CAUSAL", depth=3).unionByName(asked(spark, ["p0"], ["VOW"], "CAUSAL", depth=1).withColumn("qid", F.lit(2)))
    got = {(r.qid, r.event_id) for r in kgquery.execute(deep, n, d, e).collect()}
    assert got == {(1, f"E{i}") for i in range(4)} | {(2, "E0"), (2, "E1")}


def test_unknown_seed_and_empty_targets(spark):
    n, d, e = frames(spark, *random_graph(5))
    s = kgquery.resolve_seeds(asked(spark, ["nobody"], ["KILL"]), kgquery.alias_index(n))
    assert kgquery.fact(s, d, e).isEmpty() and kgquery.causal(s, d, e, 2).isEmpty()
    s = kgquery.resolve_seeds(asked(spark, ["p1"], []), kgquery.alias_index(n))
    assert kgquery.seed_events(s, d, e).isEmpty() and not kgquery.fact(s, d, e).isEmpty()


def test_plans_of_the_four_questions(spark):
    names = spark.createDataFrame([("karna", "karna", "PERSON"), ("radheya", "karna", "PERSON"), ("bhishma", "bhishma", "PERSON"), ("duryodhana", "duryodhana", "PERSON"), ("abhimanyu", "abhimanyu", "PERSON"), ("drona", "drona", "PERSON")], "alias string, canonical string, type string")
    q = spark.createDataFrame([(1, "Who killed Karna?"), (2, "Why did Bhishma support Duryodhana?"), (3, "What happened after Abhimanyu's death?"), (4, "Who benefited from Drona's death?")], "qid int, text string")
    got = {r.qid: r for r in plan.plans(q, names).collect()}
    assert [got[i].intent for i in (1, 2, 3, 4)] == ["FACT", "CAUSAL", "TEMPORAL", "MULTI_HOP"]
    assert [got[i].seeds for i in (1, 2, 3, 4)] == [["karna"], ["bhishma", "duryodhana"], ["abhimanyu"], ["drona"]]
    assert got[1].targets[0] == "KILL" and got[1].agent_required and got[1].depth == 1
    assert got[2].causal_chain and got[3].temporal_order == "AFTER" and got[4].depth == 2


def test_seeds_are_whole_words_as_they_stand(spark):
    names = spark.createDataFrame([("abhimanyu", "abhimanyu", "PERSON"), ("dharma-raja", "yudhishthira", "PERSON"), ("the old king of the west", "varuna", "GROUP"), ("him", "somebody", "PERSON"), ("drona", "drona", "PERSON"), ("drona", "teacher", "GROUP")], "alias string, canonical string, type string")
    texts = ["What of Abhimanyu's death?", "Where is Dharma-Raja?", "Where is Dharma Raja?", "tell him of THE OLD KING OF THE WEST now", "Dronas army, adrona", "(drona)"]
    q = spark.createDataFrame(list(enumerate(texts)), "qid int, text string")
    got = {r.qid: r.seeds for r in plan.seeds(q, names).collect()}
    assert got == {0: ["abhimanyu"], 1: ["yudhishthira"], 3: ["varuna"], 5: ["drona", "teacher"]}


def test_boundaries_of_the_default_lexicon(spark):
    texts = ["They appointed general Karna.", "appointed as leader", "appointed.", "awarded wars", "the warrior's war-horse", "Schwarze war"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, sentence string")
    got = {(r.doc_id, r.event_type) for r in events.detect(df).collect()}
    assert got == {(0, "APPOINTED_AS"), (1, "APPOINTED_AS"), (4, "BATTLE"), (5, "BATTLE")}


SENTENCES = [(1, "Arjuna killed Karna in battle. Then Drona said nothing of war."), (2, "Bhishma vowed an oath. Krishna spoke."), (3, "Satyaki attacked Drona and fell upon the army near Kurukshetra with force.")]


def test_events_by_the_default_lexicon(spark):
    df = spark.createDataFrame(SENTENCES, "doc_id int, text string")
    found = {(r.doc_id, r.event_type) for r in events.detect(events.sentence_table(df, ["doc_id"])).collect()}
    assert {(1, "KILL"), (1, "BATTLE"), (2, "VOW"), (3, "ATTACKED")} <= found
    assert not any(d == 1 and t == "COMMAND" for d, t in found)  # a micro verb rejects the second sentence


def test_arguments_gate_and_graph(spark):
    df = spark.createDataFrame(SENTENCES, "doc_id int, text string")
    found = events.extract(events.detect(events.sentence_table(df, ["doc_id"])), by_role=True)
    gated = events.admitted(events.meso_gate(found, places=("kurukshetra",)))
    rows = {(r.doc_id, r.event_type): [a.text for a in r.arguments] for r in gated.collect()}
    assert rows[1, "KILL"] == ["Arjuna", "Karna", "Karna"] and rows[3, "ATTACKED"][:2] == ["Satyaki", "Drona"]
    numbered = graph.number_events(gated, "doc_id", "sentence_index", "type_order").withColumn("chunk_id", F.col("doc_id").cast("string"))
    adm = graph.admit(numbered, graph.alias_table(spark))
    ents, edges = graph.build_entities(adm), graph.build_edges(adm)
    ids = {r.entity_id for r in ents.collect()}
    assert {"person_arjuna", "person_karna", "person_drona"} <= ids
    assert edges.where("source_id = 'person_karna'").count() >= 1
    ev = numbered.select("event_id", "ordinal", F.col("event_type").alias("type"), "tier", "sentence", "chunk_id").join(graph.build_participants(adm), "event_id")
    kept, left = graph.prune(ents, edges)
    assert kept.where("type = 'PERSON' and event_count < 2").isEmpty()
    places = graph.recover_places(graph.place_mentions(ev), ents.where("canonical_name != 'kurukshetra'"))
    assert [r.entity_id for r in places.select("entity_id").distinct().collect()] == ["place_kurukshetra"]
    assert graph.occurred_edges(places, ev).count() == places.count()
    assert graph.downgrade_concepts(ents, ev, edges).count() == ents.count()


def test_entity_noise(spark):
    texts = ["he", "12", "the", "of the", "having gone", "x" * 51, "a", "Karna", "http karna"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r.text for r in df.where(graph.admissible_entity(F.col("text"))).collect()] == ["Karna"]


def test_evidence_guard_pair(spark):
    chunks = spark.createDataFrame([("c1", "Arjuna killed Karna in battle.")], "chunk_id string, text string")
    answers = spark.createDataFrame([(1, "Karna was killed by Arjuna in battle."), (2, "Bhishma was appointed commander of the host."), (3, " ")], "answer_id int, text string")
    cited = spark.createDataFrame([(1, "c1"), (2, "c1"), (2, "unknown"), (3, "c1")], "answer_id int, chunk_id string")
    got = {r.answer_id: r.supported for r in evidence.answers_supported(answers, cited, chunks).collect()}
    assert got == {1: True, 2: False, 3: False}


def test_citations_and_fallback(spark):
    df = spark.createDataFrame([("x P01-S002-C003 y P01-S002-C003 [E1] [E9]", ["E1"])], "t string, ok array<string>")
    row = df.select(evidence.cited_ids(F.col("t")).alias("a"), evidence.bracketed_ids(F.col("t"), F.col("ok")).alias("b"), evidence.fallback(F.lit("One. Two."), F.lit("Ev"), F.lit(1), F.lit(0)).alias("c")).first()
    assert row.a == ["P01-S002-C003"] and row.b == ["E1"] and row.c.answer == "One." and row.c.confidence == "medium"
    assert resolve.resolver("FACT") is resolve.fact and resolve.resolver("OTHER") is None
    assert [r[0] for r in spark.range(4).select(resolve.confidence(F.col("id"))).collect()] == ["low", "high", "medium", "medium"]


def test_graph_round_trip_and_resume(spark, tmp_path):
    n = spark.createDataFrame([("p", "p", "PERSON", ["p"], 1, 1, 1, 0)], io.ENTITIES)
    e = spark.createDataFrame([("E0", 0, "KILL", "MACRO", "s", "c", ["p"])], io.EVENTS)
    d = spark.createDataFrame([("p", "E0", "PARTICIPATED_IN", "E0", "KILL", 1, ["c"])], io.EDGES)
    io.write_graph(str(tmp_path / "kg"), n, e, d)
    assert [x.count() for x in io.read_graph(spark, str(tmp_path / "kg"))] == [1, 1, 1]
    assert io.read_registry(spark, str(tmp_path / "kg" / "entity_registry")).first().evidence_chunks == 1
    with pytest.raises(RuntimeError):
        io.read_graph(spark, str(tmp_path / "none"))
    assert io.read_registry(spark, str(tmp_path / "none")).isEmpty()
    io.save_manifest(spark, str(tmp_path / "m"), {"status": "complete", "input_hash": io.content_hash(n), "model": "x"})
    done = [str(tmp_path / "kg" / "events")]
    assert io.up_to_date(spark, str(tmp_path / "m"), io.content_hash(n), "x", done) and not io.up_to_date(spark, str(tmp_path / "m"), "other", "x", done)
    items = spark.createDataFrame([("a", 1), ("b", 2)], "book string, v int")
    io.write_partitions(items.where("book = 'a'"), str(tmp_path / "parts"), "book")
    assert [r.book for r in io.remaining(items, str(tmp_path / "parts"), "book").collect()] == ["b"]


def test_query_log_stream(spark, tmp_path):
    from quillgraph.streaming import querylog

    io.append_log(spark.createDataFrame([("q", ["a", "b"], ["a"]), ("r", ["a"], ["a"])], "query string, retrieved_chunk_ids array<string>, used_chunk_ids array<string>"), str(tmp_path / "log"))
    q = querylog.usage(querylog.read_log(spark, str(tmp_path / "log"))).writeStream.outputMode("complete").format("memory").queryName("usage").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(uses) FROM usage WHERE chunk_id = 'a'").first()[0] == 2


def test_chunk_reader_keeps_last(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"chunk_id": "x", "text": "one"}\n\n{"chunk_id": "x", "text": "two"}\n')
    assert [r.text for r in io.read_chunks(spark, str(tmp_path / "c.jsonl")).collect()] == ["two"]
