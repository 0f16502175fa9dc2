"""A training corpus from ``documents``: five stages, each written as Parquet and read by the next.

Quality rules drop documents; of each group of near duplicates the smallest doc_id stays; repeated
passages are cut out of the later documents (documents of which nothing is left go); documents
with a passage of the benchmark go, however short its share, as what is trained on is measured on it;
what remains is tokenized and packed. All stages but the last return the columns of
``documents``. Null, empty and very long texts, ties, repeated rows, empty tables and extra columns
are handled as each operator's docstring states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm import decontaminate, jaccard, packing, quality, substring
from quillgraph.llm.base import delete, table, written
from quillgraph.sources.storage import made, sweep


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.quality_filter(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.drop_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring.drop_repeated_passages(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", pack),
]

#: Quantile sketches, components and token ids are not SQL; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sequences. When a stage's table is written, what its operator wrote on the way and the table before go."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        since = len(made())
        docs, path = written(stage(spark, docs, sf_dir), name)
        sweep(spark, since, path)
        if before is not None:
            delete(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
