"""Shared plumbing: tables, written intermediate tables (see ``sources.storage``), sizes and names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.storage import clean, delete, new_path, plan_bytes, shared_dir, written

__all__ = ["bounded_batches", "clean", "delete", "fresh", "new_path", "power_of_two", "release_shuffles", "rough_bytes", "shared_dir", "table", "text_bytes", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release_shuffles(spark: SparkSession) -> None:
    """Let the context cleaner drop shuffle files of finished steps.

    Spark deletes them once the driver has collected the plans that used them; after a step has
    been written as a table, that need not wait for the next natural collection.
    """
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches to Python workers by bytes: by rows alone, long texts would make them large.

    A session's own smaller setting stays.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jsparkSession.sessionState().conf().getConfString(key, "2147483647").rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of a text column; sizes buckets in proportion to the data. One narrow scan."""
    from pyspark.sql import functions as F

    return docs.select(F.sum(F.octet_length(column).cast("long"))).first()[0] or 0


def rough_bytes(docs: DataFrame) -> int:
    """Size of a table as Spark's statistics have it (files as they lie), without a scan; counted where they have none."""
    size = plan_bytes(docs)
    return size if size < 1 << 50 else text_bytes(docs)


def power_of_two(n: float) -> int:
    return 1 << max(0, int(n - 1).bit_length()) if n > 1 else 1


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
