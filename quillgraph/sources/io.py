"""Readers and writers of the engine's relations. Schemas are declared, never inferred."""

from __future__ import annotations

import json

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon
from .storage import delete, exists

PAGES = "page_number int, text string, word_count int, has_section_marker boolean, has_parva_marker boolean"
CHUNKS = "chunk_id string, parva_number int, parva_name string, section_number string, section_index int, chunk_index int, text string, token_count int, source string, language string"
SECTIONS = "array<struct<section_number:string,paragraph_count:int,paragraphs:array<string>>>"
STRUCTURE = f"number int, name string, section_count int, sections {SECTIONS}, source string, total_pages long, extraction_stage string"
EMBEDDINGS = "chunk_id string, embedding array<float>"
MANIFEST = "model string, dimension int, count long"
ENTITIES = "entity_id string, canonical_name string, type string, aliases array<string>, event_count long, mentions long, n_chunks long, first_seen long"
EVENTS = "event_id string, ordinal long, type string, tier string, sentence string, chunk_id string, participants array<string>"
EDGES = "source_id string, target_id string, edge_type string, event_id string, event_type string, weight long, evidence array<string>"
QUERY_LOG = "timestamp string, query string, retrieved_chunk_ids array<string>, used_chunk_ids array<string>"


def read_json(spark: SparkSession, path: str, schema: str, multi_line: bool = False) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, PAGES)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks by id. Of equal ids the row that comes last within the last file stays."""
    rows = spark.read.text(path).where("trim(value) != ''").select(F.from_json("value", CHUNKS).alias("c"), F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("at"))
    return rows.select("c.*", "at").groupBy("chunk_id").agg(F.max(F.struct("at", *[c.split()[0] for c in CHUNKS.split(", ")])).alias("r")).select("r.*").drop("at")


def write_pages(pages: DataFrame, path: str) -> None:
    """Pages as JSON lines; columns of PAGES."""
    write_json(pages.select(*[c.split()[0] for c in PAGES.split(", ")]), path)


def write_structure(tree: DataFrame, path: str, source: str, total_pages: int, stage: str) -> None:
    """Books (number, name, section_count, sections) as JSON lines, a book a line, with where they come from."""
    write_json(tree.select("number", "name", "section_count", "sections", F.lit(source).alias("source"), F.lit(total_pages).cast("long").alias("total_pages"), F.lit(stage).alias("extraction_stage")), path)


def read_structure(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, STRUCTURE)


def explode_structure(tree: DataFrame) -> DataFrame:
    """The nested tree as (book_number, book_name, section_index, section_number, para, text)."""
    sections = tree.select(F.col("number").alias("book_number"), F.col("name").alias("book_name"), F.posexplode("sections").alias("section_index", "s"))
    return sections.select("book_number", "book_name", "section_index", "s.section_number", F.posexplode("s.paragraphs").alias("para", "text"))


def write_embeddings(chunks: DataFrame, vectors: DataFrame, path: str, model: str) -> None:
    """Vectors of chunks, joined by chunk_id, and a manifest. Chunks without a vector and vectors of different lengths are errors."""
    joined = chunks.select("chunk_id").join(vectors.select("chunk_id", "embedding"), "chunk_id", "left")
    joined.write.mode("overwrite").parquet(f"{path}/chunks")
    spark = chunks.sparkSession
    seen = spark.read.parquet(f"{path}/chunks").agg(F.count("*").alias("n"), F.count("embedding").alias("v"), F.min(F.size("embedding")).alias("low"), F.max(F.size("embedding")).alias("dim")).first()
    if seen.v != seen.n:
        raise ValueError(f"{seen.n - seen.v} chunks have no vector")
    if seen.low != seen.dim:
        raise ValueError(f"vectors have {seen.low} to {seen.dim} dimensions")
    write_json(spark.createDataFrame([(model, seen.dim, seen.n)], MANIFEST).coalesce(1), f"{path}/manifest")


def read_embeddings(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(manifest of one row, vectors by chunk_id)."""
    return read_json(spark, f"{path}/manifest", MANIFEST), spark.read.schema(EMBEDDINGS).parquet(f"{path}/chunks")


def write_graph(path: str, entities: DataFrame, events: DataFrame, edges: DataFrame, report: DataFrame | None = None) -> None:
    """Entities, events and edges, their statistics, the registry, and the report of their validation, if there is one."""
    spark = entities.sparkSession
    for name, df in (("entities", entities), ("events", events), ("edges", edges)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    rows = [(n, spark.read.parquet(f"{path}/{n}").count()) for n in ("entities", "events", "edges")]
    write_json(spark.createDataFrame([tuple(n for _, n in rows)], "entity_count long, event_count long, edge_count long").coalesce(1), f"{path}/graph_stats")
    kept = spark.read.parquet(f"{path}/entities")
    if {"canonical_name", "type", "aliases", "event_count", "n_chunks"} <= set(kept.columns):
        registry = kept.select("entity_id", "canonical_name", F.col("type").alias("entity_type"), "aliases", "event_count", F.col("n_chunks").alias("evidence_chunks"))
        write_json(registry, f"{path}/entity_registry")
    if report is not None:
        write_json(report.coalesce(1), f"{path}/validation_report")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Raises RuntimeError where a relation is missing."""
    out = []
    for name, schema in (("entities", ENTITIES), ("events", EVENTS), ("edges", EDGES)):
        if not exists(spark, f"{path}/{name}"):
            raise RuntimeError(f"the graph has no {name}")
        out.append(spark.read.schema(schema).parquet(f"{path}/{name}"))
    return tuple(out)


REGISTRY = "entity_id string, canonical_name string, entity_type string, aliases array<string>, event_count long, evidence_chunks long"


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """The entity registry, or none where there is no file."""
    return read_json(spark, path, REGISTRY) if exists(spark, path) else spark.createDataFrame([], REGISTRY)


def graphml(nodes: DataFrame, edges: DataFrame, attributes=tuple(sorted({a for own in lexicon.NODE_TYPES.values() for a in own}))) -> DataFrame:
    """(part, id, line): a GraphML document of nodes (node_id, type, attributes) and edges (source_id, target_id,
    edge_type), a line each, in order of part and id."""
    spark = nodes.sparkSession
    safe = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    data = lambda k, v: F.concat(F.lit('<data key="'), k, F.lit('">'), safe(v), F.lit("</data>"))
    keys = "".join(f'<key id="{a}" for="node" attr.name="{a}" attr.type="string"/>' for a in ("type", *attributes))
    head = '<?xml version="1.0" encoding="UTF-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns">' + keys + '<key id="link" for="edge" attr.name="type" attr.type="string"/><graph edgedefault="directed">'
    ends = spark.createDataFrame([(0, "", head), (3, "", "</graph></graphml>")], "part int, id string, line string")
    own = F.array_join(F.transform(F.array_sort(F.map_entries("attributes")), lambda e: data(e["key"], e["value"])), "")
    a = nodes.select(F.lit(1).alias("part"), F.col("node_id").alias("id"), F.concat(F.lit('<node id="'), safe(F.col("node_id")), F.lit('">'), data(F.lit("type"), F.col("type")), own, F.lit("</node>")).alias("line"))
    b = edges.select(F.lit(2).alias("part"), F.concat_ws(" ", "source_id", "target_id").alias("id"), F.concat(F.lit('<edge source="'), safe(F.col("source_id")), F.lit('" target="'), safe(F.col("target_id")), F.lit('">'), data(F.lit("link"), F.col("edge_type")), F.lit("</edge>")).alias("line"))
    return ends.unionByName(a).unionByName(b)


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Text files that, joined in order of their names, are one GraphML document."""
    graphml(nodes, edges).repartitionByRange("part", "id").sortWithinPartitions("part", "id").select("line").write.mode("overwrite").text(path)


def append_units(units: DataFrame, path: str) -> None:
    """Context units as JSON lines, after those that are there: a second run repeats its rows."""
    write_json(units, path, "append")


def append_log(entries: DataFrame, path: str) -> None:
    """entries: query, retrieved_chunk_ids, used_chunk_ids."""
    entries.select(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), "query", "retrieved_chunk_ids", "used_chunk_ids").write.mode("append").json(path)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of files; a file has to fit in a row (2 GB)."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def content_hash(df: DataFrame) -> str:
    """One hash of a table whatever its row order: what resumed stages are keyed by."""
    row = df.select(F.xxhash64(F.to_json(F.struct(*df.columns))).cast("decimal(38,0)").alias("h")).agg(F.count("*"), F.sum("h")).first()
    return f"{row[0]}:{row[1]}"


def save_manifest(spark: SparkSession, path: str, manifest: dict) -> None:
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0]) if exists(spark, path) else {}


def up_to_date(spark: SparkSession, manifest_path: str, input_hash: str, model: str, outputs: list[str], force: bool = False) -> bool:
    m = load_manifest(spark, manifest_path)
    return not force and m.get("status") == "complete" and m.get("input_hash") == input_hash and m.get("model") == model and all(exists(spark, o) for o in outputs)


def run_stage(spark: SparkSession, root: str, name: str, input_hash: str, build: Callable[[], DataFrame]) -> tuple[DataFrame, bool]:
    """The table of a stage, and whether it was built now. A stage of the same input is read again; where
    the input's hash differs, it and all stages that were built after it are dropped and it is built anew."""
    stages = dict(load_manifest(spark, f"{root}/manifest").get("stages", []))
    if stages.get(name) == input_hash and exists(spark, f"{root}/{name}/_SUCCESS"):
        return spark.read.parquet(f"{root}/{name}"), False
    names = list(stages)
    for later in names[names.index(name) :] if name in stages else []:
        delete(spark, f"{root}/{later}")
        del stages[later]
    build().write.mode("overwrite").parquet(f"{root}/{name}")
    stages[name] = input_hash
    save_manifest(spark, f"{root}/manifest", {"stages": list(stages.items())})
    return spark.read.parquet(f"{root}/{name}"), True


def remaining(items: DataFrame, done_path: str, key: str) -> DataFrame:
    """Items whose partition isn't written yet: resume by book, keyed by the input's hash in the path."""
    if not exists(items.sparkSession, done_path):
        return items
    done = items.sparkSession.read.parquet(done_path).select(key).distinct()
    return items.join(done, key, "left_anti")


def write_partitions(df: DataFrame, path: str, key: str) -> None:
    df.write.mode("append").partitionBy(key).parquet(path)
