"""What a step holds at once."""

import numpy as np
from pyspark.sql import functions as F

from quillgraph.operators import community, evidence, resolve, vector
from quillgraph.sources import storage


def test_vector_scores_come_in_blocks(monkeypatch):
    monkeypatch.setattr(vector, "SCORES", 300)
    rng = np.random.default_rng(1)
    rows, queries = rng.normal(size=(100, 8)), rng.normal(size=(50, 8))
    blocks = list(vector.best_of(rows, queries, 5))
    assert len(blocks) == 17 and max(len(b[0]) for b in blocks) == 15
    who, row, _ = (np.concatenate([b[k] for b in blocks]) for k in range(3))
    want = np.argsort(-(queries @ rows.T), axis=1, kind="stable")[:, :5]
    assert all(set(row[who == q]) == set(want[q]) for q in range(50))


def test_rounds_of_communities_are_written(spark):
    edges = spark.createDataFrame([("a", "x", 1), ("b", "x", 1), ("b", "y", 2), ("c", "y", 1)], "source_id string, target_id string, weight long")
    out = community.label_propagation(edges)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString() and out.count() == 5


def test_roles_take_one_exchange_after_the_join(spark):
    rows = [(1, "E1", 1, "KILL", ["a", "a", "b"]), (1, "E2", 2, "DEATH", ["b", "b"])]
    m, _ = storage.written(spark.createDataFrame(rows, "qid int, event_id string, ordinal long, type string, participants array<string>"), "m")
    n = spark.createDataFrame([("a", "PERSON", 1), ("b", "PERSON", 2)], "entity_id string, type string, event_count long")
    r = resolve.roles(m.unionByName(m), n)
    assert sorted((x.event_id, x.entity_id, x.role) for x in r.collect()) == [("E1", "a", "AGENT"), ("E1", "b", "PATIENT"), ("E2", "b", "PATIENT")]
    plan = r._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert sum("Exchange hashpartitioning(qid" in line for line in plan.splitlines()) == 1


def test_claims_held_once_are_as_before(spark):
    df = spark.createDataFrame([("Karna was slain near Anga.", "There karna, king of anga, was slain near it"), ("Karna was slain.", "karna sat")], "f string, c string")
    both = df.select(evidence.claims(F.col("f")).alias("f"), evidence.held(F.col("c")).alias("c")).select(evidence.holds(F.col("f"), F.col("c")).alias("ok"))
    assert [r.ok for r in both.collect()] == [r.ok for r in df.select(evidence.sentence_supported(F.col("f"), F.col("c")).alias("ok")).collect()] == [True, False]
