"""Connected components of an edge table by alternating star contraction.

Each round is two aggregations with joins back on a node; the edges of hubs are dealt out with salts,
so that a node with a third of all edges is no single task. Rounds are written to the shared folder, so lost executors cost no more than one round.
Nothing is gathered on the driver but a count and a checksum of each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import delete, written

MAX_ROUNDS = 60
#: Nodes with more edges than HUB, or than a MOST_HUBS-th of all edges, are dealt out by SALTS; there are 2 * MOST_HUBS of them at most.
HUB, MOST_HUBS, SALTS = 64, 50_000, 64


def _met(edges: DataFrame, low: DataFrame, total: int) -> DataFrame:
    """Edges (u, v) with m of their u, from ``low`` (u, m, n: edges of u). Edges of a hub are dealt to many tasks by their other end."""
    many = F.col("n") > max(HUB, total // MOST_HUBS)
    # by their number of edges, hubs are few enough to be sent out
    hubs = F.broadcast(low.where(many).select("u", F.lit(True).alias("hub")))
    salted = edges.join(hubs, "u", "left").select("u", "v", F.when(F.col("hub"), F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).otherwise(0).alias("salt"))
    spread = low.select("u", "m", F.explode(F.sequence(F.lit(0), F.when(many, SALTS - 1).otherwise(0))).alias("salt"))
    return salted.join(spread, ["u", "salt"]).select("u", "v", "m")


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return _met(both, low, 2 * total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = _met(down, low, total).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def components(edges: DataFrame) -> tuple[DataFrame, str]:
    """(node, root) for each node that has an edge, with the smallest node of its component, and the table's path.

    Self edges, repeated edges and either direction are allowed; an empty table gives an empty result.
    """
    spark = edges.sparkSession
    now, path = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), "edges")
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = mark(now)
    for _ in range(MAX_ROUNDS):
        if not before[0]:
            break
        after, to = written(_small_star(_large_star(now, before[0]), 2 * before[0]), "edges")
        then = mark(after)
        delete(spark, path)
        now, path = after, to
        if tuple(then) == tuple(before):
            break
        before = then
    else:
        raise RuntimeError(f"no fixed point after {MAX_ROUNDS} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots), path
