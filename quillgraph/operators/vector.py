"""Vectors: a deterministic embedding, a stored index, exact search, merged and boosted results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..sources import storage


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(v) -> Column:
    """The vector at length 1; a zero vector as it is."""
    return F.transform(F.arrays_zip(v.alias("x"), F.array_repeat(F.greatest(norm(v), F.lit(1e-300)), F.size(v)).alias("n")), lambda p: p["x"].cast("double") / p["n"])


def cosine(a, b) -> Column:
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def counted(dim: int) -> Callable[[pa.Array], pa.Array]:
    """Arrow function: how often each of ``dim`` cells stands in a list."""

    def count(cells: pa.Array) -> pa.Array:
        row = np.repeat(np.arange(len(cells)), pc.list_value_length(cells).fill_null(0).to_numpy(zero_copy_only=False))
        found = np.bincount(row * dim + cells.flatten().to_numpy(), minlength=len(cells) * dim).astype(np.float32)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(cells) + 1) * dim, pa.int32()), pa.array(found))

    return count


def hashed_embedding(text, dim: int = 64, cell: Callable[[Column], Column] | None = None) -> Column:
    """Bag of words in ``dim`` hashed cells: the default where no model is at hand. Words are split and
    hashed as columns, only the counting is by array."""
    of = cell or (lambda w: F.pmod(F.xxhash64(w), F.lit(dim)))
    cells = F.transform(tokens(F.lower(F.coalesce(text, F.lit("")))), lambda w: of(w).cast("int"))
    return F.arrow_udf(counted(dim), "array<float>")(cells)


def embed_batches(df: DataFrame, key: str, text: str, connect: Callable[[], Callable[[list[str]], list[tuple[int, list[float]]]]], batch: int = 100) -> DataFrame:
    """(key, embedding) by a service: ``connect`` gives, once a partition, a function of up to ``batch``
    texts to (index, vector) pairs in any order; the index puts them back in place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = connect()
        for rows in batches:
            for at in range(0, rows.num_rows, batch):
                part = rows.slice(at, batch)
                found = sorted(ask(["" if t is None else t for t in part.column(1).to_pylist()]), key=lambda p: p[0])
                if [i for i, _ in found] != list(range(part.num_rows)):
                    raise ValueError("the service left out a text")
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([v for _, v in found], pa.list_(pa.float32()))], names=[key, "embedding"])

    kind = dict(df.dtypes)[key]
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, embedding array<float>")


#: Queries of one scan: what is broadcast, and scored against a batch of vectors at a time.
QUERY_BYTES, SCORES = 8 << 20, 1 << 19


def best_of(vectors: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, row, score) of the k best rows for each query, some queries at a time; of equal scores the row with
    the smaller id. Rows are in order of their ids."""
    for at in range(0, len(queries), max(1, SCORES // max(1, len(vectors)))):
        scores = queries[at : at + max(1, SCORES // max(1, len(vectors)))] @ vectors.T
        n = min(k, scores.shape[1])
        if n < scores.shape[1]:
            best = np.argpartition(-scores, n - 1, axis=1)[:, :n]
            least = np.take_along_axis(scores, best, 1).min(axis=1)
            tied = np.flatnonzero((scores >= least[:, None]).sum(axis=1) > n)
            best[tied] = np.argsort(-scores[tied], axis=1, kind="stable")[:, :n]
        else:
            best = np.tile(np.arange(n), (len(scores), 1))
        yield np.repeat(np.arange(at, at + len(scores)), n), best.ravel(), np.take_along_axis(scores, best, 1).ravel()


def searcher(shared, k: int, names: list[str]):
    """mapInArrow function over (id, vector): the k best of each batch for each query, as matrix products."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, flat, dim = shared.value
        queries = np.frombuffer(flat, np.float64).reshape(-1, dim)
        for batch in batches:
            own = batch.filter(pc.equal(pc.list_value_length(batch.column(1)), dim))
            if not own.num_rows:
                continue
            own = own.take(pc.sort_indices(own.column(0)))
            vectors = own.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            for who, rows, scores in best_of(vectors, queries, k):
                yield pa.RecordBatch.from_arrays([qids.take(pa.array(who)), own.column(0).take(pa.array(rows)), pa.array(scores)], names=names)

    return search


def top_k(queries: DataFrame, vectors: DataFrame, k: int, qid: str = "qid", vid: str = "vec_id", q: str = "q", v: str = "embedding") -> DataFrame:
    """Exact search by inner product: the columns of both tables, score and rank.

    A stated set of queries against all rows. Their bytes are summed up, and blocks of at most
    QUERY_BYTES go to the workers, one scan of the vectors a block; each batch of vectors is one
    matrix product and keeps its k best, and partitions rank before anything is shuffled. Queries of
    different lengths are different blocks; vectors of another length than a query's score nothing.
    """
    spark = queries.sparkSession
    sizes = queries.where(F.col(q).isNotNull()).groupBy(F.size(q).alias("dim")).agg(F.count("*").alias("n")).collect()
    kinds, found = dict(vectors.dtypes), None
    schema = f"_q {dict(queries.dtypes)[qid]}, _v {kinds[vid]}, score double"
    for dim, n in sorted((r.dim, r.n) for r in sizes):
        blocks = max(1, -(-n * (8 * dim + 16) // QUERY_BYTES))
        for b in range(blocks):
            own = queries.where((F.size(q) == dim) & (F.pmod(F.xxhash64(qid), F.lit(blocks)) == b)).select(qid, F.col(q).cast("array<double>").alias("q")).toArrow().combine_chunks()
            if not own.num_rows:
                continue
            column = lambda name: own.column(name).combine_chunks()  # noqa: B023, E731
            shared = spark.sparkContext.broadcast((column(qid), column("q").flatten().to_numpy().tobytes(), dim))
            scored = vectors.select(vid, v).mapInArrow(searcher(shared, k, ["_q", "_v", "score"]), schema)
            found = scored if found is None else found.unionByName(scored)
    if found is None:
        found = spark.createDataFrame([], schema)
    order = Window.partitionBy("_q").orderBy(F.desc("score"), "_v")
    # a rank filter above a row number is pushed below the shuffle (WindowGroupLimit)
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    # k rows a query meet the tables again for their other columns
    left = queries.select(*[F.col(c) for c in queries.columns if c not in vectors.columns or c == qid])
    return best.join(left, F.col("_q") == left[qid]).drop("_q").join(vectors, F.col("_v") == vectors[vid]).drop("_v")


def merged(found: DataFrame, boosts: DataFrame | None = None, group: str | None = None, vid: str = "vec_id", key: str | None = None) -> DataFrame:
    """Best score of each vector over all expansions of a question; boosts multiply it after the search."""
    out = found
    if boosts is not None:
        out = out.join(boosts, group, "left").withColumn("score", F.col("score") * F.coalesce("boost", F.lit(1.0)))
    keys = ([key] if key else []) + [vid]
    return out.groupBy(*keys).agg(F.max("score").alias("score"))


def dimension_errors(vectors: DataFrame, dim: int, v: str = "embedding") -> DataFrame:
    return vectors.where(F.col(v).isNull() | (F.size(v) != dim))


def without_vector(items: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    return items.join(vectors, key, "left_anti")


# a stored index: unit vectors, and a manifest that they are held against


def save_index(vectors: DataFrame, path: str, vid: str = "vec_id", v: str = "embedding") -> None:
    """Unit vectors and a manifest (dim, ntotal, ids). Vectors of different lengths are an error."""
    seen = vectors.agg(F.min(F.size(v)).alias("low"), F.max(F.size(v)).alias("dim"), F.count("*").alias("ntotal"), F.countDistinct(vid).alias("ids")).first()
    if not seen.ntotal:
        raise ValueError("there are no vectors")
    if seen.low != seen.dim:
        raise ValueError(f"vectors have {seen.low} to {seen.dim} dimensions")
    vectors.withColumn(v, unit(F.col(v)).cast("array<float>")).write.mode("overwrite").parquet(f"{path}/vectors")
    vectors.sparkSession.createDataFrame([(seen.dim, seen.ntotal, seen.ids)], "dim int, ntotal long, ids long").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def load_index(spark: SparkSession, path: str) -> DataFrame:
    """The stored unit vectors. Raises FileNotFoundError without an index, ValueError where rows and ids differ in number."""
    if not storage.exists(spark, f"{path}/manifest/_SUCCESS") or not storage.exists(spark, f"{path}/vectors/_SUCCESS"):
        raise FileNotFoundError(f"no index in {path}; save one first")
    stated = spark.read.schema("dim int, ntotal long, ids long").json(f"{path}/manifest").first()
    found = spark.read.parquet(f"{path}/vectors")
    if found.count() != stated.ntotal or stated.ids != stated.ntotal:
        raise ValueError("the index and its ids differ in number")
    return found


def ensure_index(vectors: DataFrame, path: str, force: bool = False, **names) -> DataFrame:
    """The index in ``path``; built where there is none, or anew with ``force``."""
    spark = vectors.sparkSession
    if force or not storage.exists(spark, f"{path}/manifest/_SUCCESS"):
        save_index(vectors, path, **names)
    return load_index(spark, path)
