"""Hops over lists of events, with hubs and long lists made common by small limits, against a plain search; and what the store builds."""

import numpy as np
import pyarrow as pa
import pytest

from quillgraph.operators import kgquery, reach
from test_graph import asked, bfs, frames, random_graph


@pytest.mark.parametrize("hub", [1, 3])
def test_hubs_are_met_as_themselves(spark, monkeypatch, hub):
    monkeypatch.setattr(reach, "HUB", hub)
    monkeypatch.setattr(reach, "BLOCK", 4)
    people, ev, edges = random_graph(7)
    n, d, e = frames(spark, people, ev, edges)
    targets = ["KILL", "DEATH", "VOW"]
    seeded = kgquery.resolve_seeds(asked(spark, ["p1", "P3"], targets), kgquery.alias_index(n))
    got = {f"E{x}": r.hop for r in kgquery.causal_lists(seeded, d, e, 2).collect() for x in r.ordinals}
    assert got == bfs(ev, edges, ["P1", "P3"], targets, 2)
    both = kgquery.summed(kgquery.multi_hop_lists(seeded, d, e), "qid").first()
    rows = kgquery.multi_hop(seeded, d, e).collect()
    assert (both.n_events, both.events) == (len(rows), sum(r.ordinal for r in rows)) and len({r.event_id for r in rows}) == len(rows)


def test_lists_unite_across_batches(monkeypatch):
    """A key's rows in several batches, pieces of long results, and values that are known."""
    monkeypatch.setattr(reach, "LONGEST", 3)
    rng = np.random.default_rng(3)
    rows = sorted((int(rng.integers(6)), bool(rng.integers(3) == 0), rng.integers(0, 60, rng.integers(1, 9)).tolist()) for _ in range(200))
    table = pa.table({"k": [r[0] for r in rows], "old": [r[1] for r in rows], "ordinals": pa.array([r[2] for r in rows], pa.list_(pa.int64()))})
    out = list(reach.unite(1, ["k", "ordinals"])(iter(table.to_batches(max_chunksize=7))))
    got: dict = {}
    for b in out:
        for k, xs in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            assert len(xs) <= 3
            got[k] = got.get(k, []) + xs
    want = {k: sorted({x for a, o, xs in rows if a == k and not o for x in xs} - {x for a, o, xs in rows if a == k and o for x in xs}) for k in range(6)}
    assert got == {k: v for k, v in want.items() if v}
    wide = reach.minus(np.array([0, 0, 1]), np.array([-(1 << 62), 1 << 62, 5]), np.array([False, True, False]), 2)
    assert [x.tolist() for x in wide] == [[0, 1], [-(1 << 62), 5]]


def test_only_what_is_asked_for_is_built(spark):
    from quillgraph.plans import store

    store._BUILT.clear()
    kg = store.graph_of(spark, "/root/testdata/sf0.001")
    events, links = kg.events.collect(), kg.links.collect()
    assert [set(t) for t in store._BUILT.values()] == [{"events"}]
    assert sum(r.n for r in links) == sum(len(r.participants) for r in events) == kg.arguments.count()
    assert {(r.entity_id, r.event_id) for r in links} == {(p, r.event_id) for r in events for p in r.participants} and len(links) == len({(r.entity_id, r.event_id) for r in links})


def test_questions_are_not_broadcast(spark, monkeypatch):
    """However small Spark takes the questions for: names are what is broadcast, or nothing where they are many."""
    from pyspark.sql import functions as F

    from quillgraph.operators import plan

    names = spark.createDataFrame([("karna", "karna", "PERSON"), ("old king", "king", "GROUP"), ("king", "king", "GROUP")], "alias string, canonical string, type string")
    q = spark.range(50).select(F.col("id").alias("qid"), F.concat(F.lit("Karna and the old king "), F.col("id")).alias("text"))
    rows = []
    for small, most in ((plan.SMALL, 1), (0, 0)):
        monkeypatch.setattr(plan, "SMALL", small)
        p = plan.plans(q, names)
        text = p._jdf.queryExecution().executedPlan().toString()
        assert text.count("BroadcastExchange") == most
        rows.append(sorted((r.qid, tuple(r.seeds)) for r in p.collect()))
    assert rows[0] == rows[1] == [(i, ("karna", "king")) for i in range(50)]


def test_files_of_a_small_table_are_dealt_out(spark):
    from quillgraph import registry

    assert registry.queries()["pdf_scan"](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_orphans_of_the_queries_are_suppliers(spark, tmp_path):
    """A customer without an order is an orphan to ``graph.orphans``; the SQL of orphan_check lists suppliers."""
    import shutil

    from quillgraph import registry
    from quillgraph.operators import graph
    from quillgraph.plans import store

    source = "/root/testdata/sf0.001"
    for t in ("supplier", "part", "orders", "lineitem"):
        shutil.copy(f"{source}/{t}.parquet", tmp_path / f"{t}.parquet")
    c = spark.read.parquet(f"{source}/customer.parquet")
    c.unionByName(c.limit(1).selectExpr("cast(900000 as bigint) c_custkey", "'Customer#000900000' c_name", "c_nationkey", "c_acctbal", "c_mktsegment")).coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    folder = str(tmp_path)
    want = sorted(f"S{r.s_suppkey}" for r in spark.read.parquet(f"{source}/supplier.parquet").collect())
    assert sorted(r.entity_id for r in registry.queries()["orphan_check"](spark, folder).collect()) == want
    kg = store.graph_of(spark, folder)
    assert sorted(r.entity_id for r in graph.orphans(kg.entities, kg.edges).collect()) == sorted([*want, "C900000"])
    report = {r.relation: r.n for r in registry.queries()["kg_sink_scan"](spark, folder).collect()}
    assert report["report orphans"] == len(want) and report["entities"] == kg.names.count()
