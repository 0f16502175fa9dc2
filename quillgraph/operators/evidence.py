"""Reranking, windows of evidence, support of answers, and citations."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon
from ..functions import text as T


def rerank_score(score, text, entity, keywords=lexicon.DEATH_KEYWORDS) -> Column:
    """A tenth more if the text has the entity; and, for questions about an entity, a twentieth for each keyword up to three."""
    low = F.lower(text)
    named = F.when(entity.isNotNull() & F.contains(low, F.lower(entity)), 1.1).otherwise(1.0)
    hits = T.count_contained(low, keywords)
    focus = F.when(entity.isNotNull(), 1.0 + 0.05 * F.least(hits, F.lit(3))).otherwise(1.0)
    return score * named * focus


def top_ranked(rows: DataFrame, k: int, score: str = "score", before: str = "rank", key: str | None = None) -> DataFrame:
    """The k best, in a stable order: of equal scores the one that was ahead."""
    if key is None:
        return rows.orderBy(F.desc(score), before).limit(k)
    order = Window.partitionBy(key).orderBy(F.desc(score), before)
    return rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")


def positions(parts, words) -> Column:
    """Indices of sentences that hold one of the words."""
    at = F.transform(parts, lambda s, i: F.when(F.exists(words, lambda w: F.contains(s, w)), i))
    return F.filter(at, lambda x: x.isNotNull())


def near(a, b, window: int = 2) -> Column:
    return F.exists(a, lambda x: F.exists(b, lambda y: F.abs(x - y) <= window))


def death_evidence(chunks: DataFrame, target: str, aliases, verbs=lexicon.DEATH_VERBS, window: int = 2, text: str = "text", rank: str | None = None, most: int = 20) -> DataFrame:
    """``chunks`` with death_hit, agent_hit and cooccur: sentence distances inside each row, no join.

    With ``rank``, of which smaller is better, only the ``most`` best chunks are looked at.
    """
    literal = lambda ws: F.array(*[F.lit(w.lower()) for w in ws])
    df = chunks if rank is None else chunks.orderBy(rank).limit(most)
    df = df.withColumn("_s", T.sentences(F.lower(F.col(text))))
    df = df.withColumn("_e", positions(F.col("_s"), literal([target]))).withColumn("_v", positions(F.col("_s"), literal(verbs))).withColumn("_a", positions(F.col("_s"), literal(aliases)))
    death = near(F.col("_e"), F.col("_v"), window)
    agent = F.size("_a") > 0
    return df.withColumn("death_hit", death).withColumn("agent_hit", agent).withColumn("cooccur", death & near(F.col("_e"), F.col("_a"), window)).drop("_s", "_e", "_v", "_a")


def supported(evidence: DataFrame) -> DataFrame:
    return evidence.agg(F.coalesce(F.bool_or("cooccur") | (F.bool_or("death_hit") & F.bool_or("agent_hit")), F.lit(False)).alias("supported"))


def citations(evidence: DataFrame, key: str, rank: str, most: int = 6) -> DataFrame:
    """(key, tier): co-occurring chunks, then deaths, then agents, by rank; at most ``most``."""
    tier = F.when(F.col("cooccur"), 0).when(F.col("death_hit"), 1).when(F.col("agent_hit"), 2)
    found = evidence.withColumn("tier", tier).where("tier is not null").groupBy(key).agg(F.min("tier").alias("tier"), F.min(rank).alias(rank))
    return found.orderBy("tier", rank, key).limit(most)


def claims(sentence, actions=lexicon.ACTION_KEYWORDS) -> Column:
    """(names, actions, terms, need) of a sentence: what a chunk has to hold, and how many of its terms."""
    names = F.transform(F.regexp_extract_all(sentence, F.lit(r"(?<![A-Za-z0-9_])([A-Z][a-zA-Z]+)(?![A-Za-z0-9_])"), 1), lambda x: F.lower(x))
    used = F.filter(F.array(*[F.lit(a) for a in actions]), lambda a: F.contains(F.lower(sentence), a))
    found = F.regexp_extract_all(F.lower(sentence), F.lit("([a-zA-Z']+)"), 1)
    n = F.size(F.filter(found, lambda x: (F.length(x) > 3) & ~x.isin(*lexicon.STOPWORDS)))
    need = F.when(n > 0, F.greatest(F.lit(2), F.least(F.lit(4), n))).otherwise(0)
    return F.struct(names.alias("names"), used.alias("actions"), T.key_terms(sentence).alias("terms"), need.alias("need"))


def held(chunk) -> Column:
    """(low, terms) of a chunk, which claims are held against."""
    return F.struct(F.lower(chunk).alias("low"), T.key_terms(chunk).alias("terms"))


def holds(claim, chunk) -> Column:
    """A chunk (of ``held``) holds all names of a sentence (of ``claims``), one of its actions if it has any, and enough of its terms."""
    low, used = chunk["low"], claim["actions"]
    overlap = F.size(F.array_intersect(claim["terms"], chunk["terms"]))
    return F.forall(claim["names"], lambda x: F.contains(low, x)) & ((F.size(used) == 0) | F.exists(used, lambda a: F.contains(low, a))) & (overlap >= claim["need"])


def sentence_supported(sentence, chunk, actions=lexicon.ACTION_KEYWORDS) -> Column:
    """``holds`` for one sentence and one chunk; of many pairs, ``claims`` and ``held`` are better made once each."""
    return holds(claims(sentence, actions), held(chunk))


def answers_supported(answers: DataFrame, cited: DataFrame, chunks: DataFrame) -> DataFrame:
    """(answer_id, supported): each sentence by one cited, known, non-empty chunk. answers: answer_id, text;
    cited: answer_id, chunk_id; chunks: chunk_id, text."""
    parts = answers.select("answer_id", F.posexplode(T.sentences(F.trim("text"))).alias("i", "sentence"))
    known = cited.join(chunks.where(F.trim("text") != "").select("chunk_id", F.col("text").alias("chunk")), "chunk_id")
    each = parts.join(known, "answer_id", "left").groupBy("answer_id", "i").agg(F.coalesce(F.bool_or(sentence_supported(F.col("sentence"), F.col("chunk"))), F.lit(False)).alias("ok"))
    return answers.select("answer_id").join(each.groupBy("answer_id").agg(F.bool_and("ok").alias("ok")), "answer_id", "left").select("answer_id", F.coalesce("ok", F.lit(False)).alias("supported"))


def valid_citations(answer, ids, known) -> Column:
    """A non-empty answer, citations all different and all known."""
    return (F.trim(answer) != "") & (F.size(F.array_distinct(ids)) == F.size(ids)) & (F.size(F.array_except(ids, known)) == 0)


CHUNK_ID, EVENT_ID = r"(P\d{2}-S\d{3}-C\d{3})", r"\[(E\d+)\]"


def cited_ids(text) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(CHUNK_ID), 1))


def bracketed_ids(text, allowed, most: int = 6, pattern: str = r"\[([^\[\]]+)\]") -> Column:
    """The first ``most`` bracketed ids that are allowed."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), 1))
    return F.slice(F.filter(found, lambda x: F.array_contains(allowed, x)), 1, most)


def grounded_citations(text, chunk_ids, event_ids, most: int = 6) -> Column:
    """(chunks, events, confidence) of an answer: cited ids that were given to it; without any the five first
    chunks and the three first events."""
    chunks = bracketed_ids(text, chunk_ids, 1 << 30, r"\[([A-Z]\d{2}-S\d+-C\d+)\]")
    events = bracketed_ids(text, event_ids, 1 << 30, EVENT_ID)
    own_chunks, own_events = or_default(chunks, chunk_ids, 5), or_default(events, event_ids, 3)
    return F.struct(F.slice(own_chunks, 1, most).alias("chunks"), F.slice(own_events, 1, most).alias("events"), F.when((F.size(own_chunks) > 0) | (F.size(own_events) > 0), "high").otherwise("medium").alias("confidence"))


def prompt(question, chunks, events, intro: str) -> Column:
    """What a model is asked: the question, six chunks and five events with their ids, cut to 400 and 300 characters.
    chunks and events: arrays of struct<id, text>, best first."""
    lines = lambda rows, k, size: F.transform(F.slice(rows, 1, k), lambda x: F.concat(F.lit("["), x["id"], F.lit("] "), F.substring(F.trim(x["text"]), 1, size)))
    head = F.array(F.lit(intro), F.lit(""), F.concat(F.lit("QUESTION: "), question), F.lit(""), F.lit("RETRIEVED TEXT CHUNKS:"))
    graph = F.when(F.size(events) > 0, F.concat(F.array(F.lit(""), F.lit("KNOWLEDGE GRAPH EVENTS:")), lines(events, 5, 300))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(head, lines(chunks, 6, 400), graph, F.array(F.lit(""), F.lit("ANSWER (cite IDs in brackets):"))), "\n")


def synthesize(questions: DataFrame, connect, intro: str = "Answer the question using ONLY the evidence. Be concise and cite ids in [brackets].") -> DataFrame:
    """(qid, answer, chunks, events, confidence): answers of a model, with the citations that hold; where it
    fails, ``fallback``. questions: qid, text, chunks and events as for ``prompt``. ``connect`` gives, once a
    partition, a function of a prompt to an answer."""

    def run(batches):
        ask = connect()
        for rows in batches:
            said = []
            for p in rows.column(1).to_pylist():
                try:
                    said.append(ask(p))
                except Exception:  # noqa: BLE001 - any failure of the service leaves the fallback
                    said.append(None)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(said, pa.string())], names=["qid", "said"])

    kind = dict(questions.dtypes)["qid"]
    asked = questions.select("qid", prompt(F.col("text"), F.col("chunks"), F.col("events"), intro).alias("p"))
    said = asked.mapInArrow(run, f"qid {kind}, said string")
    ids = lambda c: F.transform(c, lambda x: x["id"])
    own = grounded_citations(F.trim("said"), ids(F.col("chunks")), ids(F.col("events")))
    plain = fallback(F.get("chunks", 0)["text"], F.get("events", 0)["text"], F.size("chunks"), F.size("events"))
    cited = F.struct(F.slice(ids(F.col("chunks")), 1, 5).alias("chunks"), F.slice(ids(F.col("events")), 1, 5).alias("events"), plain["confidence"].alias("confidence"))
    out = questions.join(said, "qid").withColumn("_c", F.when(F.col("said").isNull(), cited).otherwise(own))
    return out.select("qid", F.coalesce(F.trim("said"), plain["answer"]).alias("answer"), "_c.chunks", "_c.events", "_c.confidence")


def first_sentence(text) -> Column:
    return F.try_element_at(T.sentences(text), F.lit(1))


def extractive_answer(ranked: DataFrame, key: str, rank: str, most: int = 5, text: str = "text") -> DataFrame:
    """One row: first sentences of the best chunks with their ids, and the ids."""
    best = ranked.orderBy(rank).limit(most)
    ordered = F.array_sort(F.collect_list(F.struct(rank, first_sentence(F.col(text)).alias("s"), F.col(key).cast("string").alias("id"))))
    return best.agg(F.array_join(F.transform(ordered, lambda x: F.concat(x["s"], F.lit(" ["), x["id"], F.lit("]"))), " ").alias("answer"), F.transform(ordered, lambda x: x["id"]).alias("citations"))


def or_default(citations_, retrieved, most: int = 5) -> Column:
    return F.when(F.size(citations_) > 0, citations_).otherwise(F.slice(retrieved, 1, most))


NOTHING = "No grounded answer was found from the provided evidence."
UNCLEAR = "Relevant passages retrieved but unable to synthesize answer."


def fallback(chunk_text, event_sentence, n_chunks, n_events) -> Column:
    """(answer, confidence) without a model: the best chunk's first clause, else the best event's; low confidence without evidence."""
    clause = lambda t: F.trim(F.substring_index(F.trim(F.coalesce(t, F.lit(""))), ".", 1))
    a, b = clause(chunk_text), clause(event_sentence)
    said = F.when((n_chunks > 0) & (a != ""), F.concat(a, F.lit("."))).when((n_events > 0) & (b != ""), F.concat(b, F.lit("."))).otherwise(UNCLEAR)
    nothing = (n_chunks <= 0) & (n_events <= 0)
    return F.struct(F.when(nothing, NOTHING).otherwise(said).alias("answer"), F.when(nothing, "low").otherwise("medium").alias("confidence"))


def bundle(events: DataFrame, chunks: DataFrame, most: int = 8, key: str = "qid") -> tuple[DataFrame, DataFrame]:
    """Evidence of questions: events once each with score 1, and their best chunks."""
    return events.dropDuplicates([key, "event_id"]).withColumn("score", F.lit(1.0)), top_ranked(chunks, most, key=key)


NO_UNITS = "No relevant information found."


def formatted(questions: DataFrame, units: DataFrame, size: int = 500) -> DataFrame:
    """(qid, answer, parva, section, story_phase, passage, supporting, valid, display): the best unit of each question
    as its answer. questions: qid, text, and answer (null: the unit's first characters); units: qid, rank,
    unit_id, parva, section, story_phase, text, paragraphs; the units of a question are what was retrieved for it."""
    listed = F.array_sort(F.collect_list(F.struct("rank", "unit_id")))
    best = units.groupBy("qid").agg(F.min_by(F.struct("parva", "section", "story_phase", "text", "paragraphs"), "rank").alias("b"), F.transform(listed, lambda x: x["unit_id"]).alias("supporting"))
    out = questions.join(best, "qid", "left")
    said = F.coalesce("answer", F.concat(F.substring("b.text", 1, size), F.lit("...")))
    passage = F.array_join("b.paragraphs", " ")
    phase = F.coalesce("b.story_phase", F.lit("Unknown"))
    shown = F.concat(F.lit("Query: "), "text", F.lit("\n\nAnswer:\n"), said, F.lit("\n\nRetrieved from:\nParva: "), "b.parva", F.lit("\nSection: "), "b.section", F.lit("\nStory Phase: "), phase, F.lit('\n\nContextual Passage:\n"'), passage, F.lit('"\n'))
    some = F.col("b").isNotNull()
    return out.select(
        "qid", F.when(some, said).otherwise(NO_UNITS).alias("answer"), "b.parva", "b.section", F.when(some, phase).alias("story_phase"), F.when(some, passage).alias("passage"),
        F.coalesce("supporting", F.array().cast("array<string>")).alias("supporting"), F.coalesce(some & (passage != ""), F.lit(False)).alias("valid"), F.when(some, shown).alias("display"),
    )
