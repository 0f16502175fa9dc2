"""The folder that driver and executors share, and tables that are written there to end a lineage."""

from __future__ import annotations

import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

#: By application: the folder made on a master of one machine.
_OWN: dict[str, str] = {}
#: Tables up to this size are dealt out to all cores: files of one row group would else be one task.
SPREAD_BYTES = 256 << 20


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    Only on a master of one machine, whose threads share its disks, is a folder made where the
    session names none; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="quillgraph-")
        found = _OWN[app]
    return found.rstrip("/")


_MADE = threading.local()


def made() -> list[str]:
    """Paths that this thread has given out, in order."""
    if not hasattr(_MADE, "paths"):
        _MADE.paths = []
    return _MADE.paths


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/quillgraph/{name}-{uuid.uuid4().hex}"
    made().append(path)
    return path


def sweep(spark: SparkSession, since: int, *keep: str) -> None:
    """Deletes what was written to paths given out from the since-th on, but for ``keep``: for callers that have
    written all results that still read it."""
    delete(spark, *[p for p in made()[since:] if p not in keep])
    made()[since:] = [p for p in made()[since:] if p in keep]


def written(df: DataFrame, name: str, by: list[str] | None = None) -> tuple[DataFrame, str]:
    """Write ``df`` once as Parquet in the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write
    if by:
        writer = writer.partitionBy(*by)
    writer.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def delete(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        fs, p = file_system(spark, path)
        fs.delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = file_system(spark, path)
    return fs.exists(p)


def clean(spark: SparkSession) -> None:
    """Removes all tables that operators left in the shared folder; results that still read them must be written before."""
    delete(spark, f"{shared_dir(spark)}/quillgraph")


def plan_bytes(df: DataFrame) -> int:
    """Size as Spark's statistics have it (files as they lie), without a scan."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def spread(df: DataFrame) -> DataFrame:
    """A small table dealt out to all cores; larger ones, which have splits enough, stay as they are."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if plan_bytes(df) <= SPREAD_BYTES else df
