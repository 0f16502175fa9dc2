"""The whole way: documents to a repaired graph, and a table of questions to evidence and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon
from ..operators import events, evidence, graph, kgquery, plan, quality, resolve, vector
from ..sources import io

LEXICON = {"patterns": lexicon.EVENT_PATTERNS, "macro": lexicon.MACRO_TYPES, "micro": lexicon.MICRO_VERBS}


def build_graph(chunks: DataFrame, aliases: DataFrame, places: tuple[str, ...] = (), **words) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, events, edges) from chunks (chunk_id, text); repaired: places recovered, rare entities pruned."""
    found = events.detect(events.sentence_table(chunks, ["chunk_id"]), **(LEXICON | words))
    stored = events.admitted(events.meso_gate(events.extract(found, by_role=True), places))
    numbered = graph.number_events(stored, "chunk_id", "sentence_index", "type_order")
    admitted = graph.admit(numbered, aliases)
    entities, edges = graph.build_entities(admitted), graph.build_edges(admitted)
    nodes = numbered.select("event_id", "ordinal", F.col("event_type").alias("type"), "tier", "sentence", "chunk_id").join(graph.build_participants(admitted), "event_id", "left")
    nodes = nodes.withColumn("participants", F.coalesce("participants", F.array().cast("array<string>")))
    entities = graph.downgrade_concepts(entities, nodes, edges)
    recovered = graph.recover_places(graph.place_mentions(nodes), entities)
    entities = graph.with_places(entities, edges, recovered)
    kept, left = graph.prune(entities, edges.unionByName(graph.occurred_edges(recovered, nodes)))
    return kept, nodes, left


def validation(entities: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, violations) of the graph's checks."""
    return quality.report(entity_types=graph.bad_types(entities), orphans=graph.orphans(entities, edges), evidence=graph.missing_evidence(edges), alias_collisions=graph.alias_collisions(entities), long_names=graph.long_names(entities))


def save(path: str, entities: DataFrame, nodes: DataFrame, edges: DataFrame) -> None:
    io.write_graph(path, entities, nodes, edges)
    stored = io.read_graph(entities.sparkSession, path)
    io.write_json(validation(*stored).coalesce(1), f"{path}/validation_report")


def name_table(entities: DataFrame, order: str = "first_seen") -> DataFrame:
    """(alias, canonical, type) for the planner: lower-cased names; of equal ones those of the entity that comes last in ``order``."""
    names = entities.select(F.col(order).alias("_at"), "entity_id", F.lower("canonical_name").alias("canonical"), "type", F.explode(F.array_distinct(F.transform(F.concat(F.array("canonical_name"), "aliases"), lambda x: F.lower(x)))).alias("alias"))
    return names.where("alias != ''").groupBy("alias").agg(F.max(F.struct("_at", "entity_id", "canonical", "type")).alias("e")).select("alias", "e.canonical", "e.type")


def ask(questions: DataFrame, entities: DataFrame, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(plans, matched events) of questions (qid, text), all at once."""
    asked = plan.plans(questions, name_table(entities))
    matched = kgquery.execute(asked, entities, edges, nodes, order="first_seen")
    return asked, matched.join(nodes.drop("type"), "event_id")


def answers(asked: DataFrame, matched: DataFrame, entities: DataFrame) -> DataFrame:
    """Answers of all questions by their intent; NO_ANSWER where there is none. See ``resolve.answers``."""
    seeds = kgquery.resolve_seeds(asked.drop("targets", "agent_required"), kgquery.alias_index(entities, "first_seen")).select("qid", "entity_id")
    return resolve.answers(asked, seeds, matched, entities)


def retrieve(questions: DataFrame, chunks: DataFrame, k: int = 30, most: int = 8, dim: int = 64, embed=vector.hashed_embedding, book: str | None = None) -> DataFrame:
    """(qid, chunk_id, score, text): exact search over unit vectors, a question about a death by all its wordings,
    with boosts of books if ``book`` names their column; the best score of each chunk, reranked."""
    entity = plan.death_subject(F.col("text"))
    wordings = F.when(F.col("entity").isNotNull(), plan.expansions(F.col("entity"))).otherwise(F.array("text"))
    asked = questions.select("qid", "text", entity.alias("entity"))
    worded = asked.select("qid", "entity", F.posexplode(wordings).alias("w", "wording")).select(F.concat_ws("#", F.col("qid").cast("string"), F.col("w").cast("string")).alias("wid"), "qid", "entity", vector.unit(embed(F.col("wording"), dim)).alias("q"))
    v = chunks.select("chunk_id", "text", (F.col(book) if book else F.lit(None).cast("string")).alias("book"), vector.unit(embed(F.col("text"), dim)).alias("embedding"))
    found = vector.top_k(worded, v, k, qid="wid", vid="chunk_id")
    boosted = found.withColumn("score", F.col("score") * plan.boost(F.col("entity"), F.col("book")))
    best = boosted.groupBy("qid", "chunk_id").agg(F.max("score").alias("score"), F.min("entity").alias("entity"), F.min("text").alias("text"))
    scored = best.withColumn("score", evidence.rerank_score(F.col("score"), F.col("text"), F.col("entity")))
    return evidence.top_ranked(scored, most, before="chunk_id", key="qid").select("qid", "chunk_id", "score", "text")


def run_question(spark: SparkSession, path: str, text: str) -> tuple[DataFrame, DataFrame]:
    """One question over a saved graph."""
    entities, nodes, edges = io.read_graph(spark, path)
    return ask(spark.createDataFrame([(1, text)], "qid int, text string"), entities, nodes, edges)
