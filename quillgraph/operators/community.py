"""Communities: label propagation over a weighted graph, a fixed number of rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import storage


def label_propagation(edges: DataFrame, rounds: int = 3) -> DataFrame:
    """(node, label). edges: source_id, target_id, weight; taken in both directions.

    Each round a node takes the label with the most weight among its neighbours and itself, the
    smallest of equal ones. Weights are summed by label and labels ranked where a node's votes lie, after one
    exchange; pairs and each round's labels are written, so that no round is run again by the next.
    """
    both = edges.select(F.col("source_id").alias("node"), F.col("target_id").alias("other"), F.col("weight").cast("double").alias("weight")).unionByName(edges.select(F.col("target_id").alias("node"), F.col("source_id").alias("other"), F.col("weight").cast("double").alias("weight")))
    pairs, _ = storage.written(both.groupBy("node", "other").agg(F.sum("weight").alias("weight")), "pairs")
    labels, _ = storage.written(pairs.select("node").distinct().withColumn("label", F.col("node")), "labels")
    for _ in range(rounds):
        heard = pairs.join(labels.withColumnRenamed("node", "other"), "other").select("node", "label", "weight")
        own = labels.select("node", "label", F.lit(0.5).alias("weight"))
        votes = heard.unionByName(own).repartition("node").groupBy("node", "label").agg(F.sum("weight").alias("w"))
        best = votes.groupBy("node").agg(F.min(F.struct((-F.col("w")).alias("w"), "label"))["label"].alias("label"))
        labels, _ = storage.written(best, "labels")
    return labels
