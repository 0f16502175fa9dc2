"""Matched events to answers: roles by position, then ranking, ordering or chains.

``matches``: qid, event_id, ordinal, type, participants. ``entities``: entity_id, type, event_count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon
from ..sources import storage

PATIENT_ONLY = ("DEATH", "RETREATED")


def roles(matches: DataFrame, entities: DataFrame) -> DataFrame:
    """(qid, event_id, ordinal, type, entity_id, role): first person AGENT, second PATIENT; a lone one of a death or retreat is PATIENT."""
    people = entities.where("type = 'PERSON'").select("entity_id", "event_count")
    each = matches.select("qid", "event_id", "ordinal", "type", F.posexplode(F.array_distinct("participants")).alias("pos", "entity_id")).join(people, "entity_id")
    # one exchange for both the repeated matches and the ranks
    once = each.repartition("qid", "event_id").groupBy("qid", "event_id", "ordinal", "type", "entity_id", "event_count").agg(F.min("pos").alias("pos"))
    w = Window.partitionBy("qid", "event_id")
    ranked = once.withColumn("r", F.row_number().over(w.orderBy("pos"))).withColumn("n", F.count("*").over(w))
    lone = (F.col("n") == 1) & F.col("type").isin(*PATIENT_ONLY)
    role = F.when(lone, "PATIENT").when(F.col("r") == 1, "AGENT").when(F.col("r") == 2, "PATIENT")
    return ranked.withColumn("role", role).where("role is not null").select("qid", "event_id", "ordinal", "type", "entity_id", "event_count", "role")


def rank_entities(found: DataFrame, most: int) -> DataFrame:
    """(qid, entity_id, frequency, rank): by frequency, then number of events, then id."""
    counted = found.groupBy("qid", "entity_id").agg(F.countDistinct("event_id").alias("frequency"), F.max("event_count").alias("event_count"))
    order = Window.partitionBy("qid").orderBy(F.desc("frequency"), F.desc("event_count"), "entity_id")
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("qid", "entity_id", "frequency", "rank")


def fact(with_roles: DataFrame, targets: DataFrame, most: int = 2) -> DataFrame:
    """Most frequent agents of events of the wanted types; with agent_required only of events that have a patient too. targets: qid, type, agent_required."""
    wanted = with_roles.join(targets, ["qid", "type"])
    both = Window.partitionBy("qid", "event_id")
    complete = wanted.withColumn("_p", F.max((F.col("role") == "PATIENT").cast("int")).over(both))
    agents = complete.where((F.col("role") == "AGENT") & (~F.col("agent_required") | (F.col("_p") == 1)))
    return rank_entities(agents, most)


def temporal(matches: DataFrame, with_roles: DataFrame, seeds: DataFrame, most: int = 5) -> DataFrame:
    """The first events beyond the seed's last death (AFTER), the last ones before it (BEFORE), else the first ones. seeds: qid, entity_id, temporal_order."""
    deaths = with_roles.where("type = 'DEATH' and role = 'PATIENT'").join(seeds, ["qid", "entity_id"])
    anchors = seeds.groupBy("qid").agg(F.max("temporal_order").alias("order")).join(deaths.groupBy("qid").agg(F.max("ordinal").alias("anchor")), "qid", "left")
    known = matches.join(anchors, "qid")
    ok = F.when(F.col("anchor").isNull(), True).when(F.col("order") == "AFTER", F.col("ordinal") > F.col("anchor")).when(F.col("order") == "BEFORE", F.col("ordinal") < F.col("anchor")).otherwise(True)
    order = Window.partitionBy("qid").orderBy(F.when(F.col("order") == "BEFORE", -F.col("ordinal")).otherwise(F.col("ordinal")))
    return known.where(ok).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("qid", "event_id", "ordinal", "type", "rank")


def multi_hop(with_roles: DataFrame, seeds: DataFrame, benefit=lexicon.BENEFIT_TYPES, triggers=("DEATH", "KILL"), most: int = 5) -> DataFrame:
    """Persons that gain after the seed was the patient of a trigger: agents and patients of benefit events of its participants. seeds: qid, entity_id."""
    first = with_roles.where(F.col("type").isin(*triggers) & (F.col("role") == "PATIENT")).join(seeds, ["qid", "entity_id"], "left_semi").select("qid", "event_id").distinct()
    people = with_roles.join(first, ["qid", "event_id"], "left_semi").select("qid", "entity_id").distinct()
    gains = with_roles.where(F.col("type").isin(*benefit))
    near = gains.join(people, ["qid", "entity_id"], "left_semi").select("qid", "event_id").distinct()
    return rank_entities(gains.join(near, ["qid", "event_id"], "left_semi").join(seeds, ["qid", "entity_id"], "left_anti"), most)


def causal(with_roles: DataFrame, seeds: DataFrame, effects=("SUPPORTED", "DEFENDED", "COMMAND"), causes=("VOW", "COMMAND")) -> DataFrame:
    """(qid, agent, cause_event, effect_event): the latest earlier vow or command of the agent of a supporting act.

    As-of: both kinds of rows of an agent in one window, no join of pairs.
    """
    mine = with_roles.where("role = 'AGENT'").join(seeds, ["qid", "entity_id"], "left_semi")
    is_cause = F.col("type").isin(*causes)
    w = Window.partitionBy("qid", "entity_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    latest = F.max(F.when(is_cause, F.struct("ordinal", "event_id"))).over(w)
    found = mine.withColumn("cause", latest).where(F.col("type").isin(*effects) & F.col("cause").isNotNull())
    best = F.max(F.struct("ordinal", F.col("event_id").alias("effect_event"), F.col("entity_id").alias("agent"), F.col("cause.event_id").alias("cause_event")))
    return found.groupBy("qid").agg(best.alias("b")).select("qid", "b.agent", "b.cause_event", "b.effect_event")


def confidence(n_answers, inferred=None) -> Column:
    guess = F.lit(False) if inferred is None else inferred
    return F.when((n_answers == 1) & ~guess, "high").when(n_answers >= 1, "medium").otherwise("low")


ANSWER = "qid, intent, answer_type, rank, entity_id, event_id, chain, frequency, confidence"


def answers(plans: DataFrame, seeds: DataFrame, matches: DataFrame, entities: DataFrame) -> DataFrame:
    """(qid, intent, answer_type, rank, entity_id, event_id, chain, frequency, confidence) by each question's intent.

    FACT and MULTI_HOP give entities, TEMPORAL events, CAUSAL a chain of entity, event, entity, event.
    Questions without one, and those of unknown intent, are a NO_ANSWER row each. ``plans``: qid, intent,
    targets, agent_required, temporal_order; ``seeds``: qid, entity_id; ``matches`` as for ``roles``.
    """
    once = matches.dropDuplicates(["qid", "event_id"])
    # written: four kinds of answers read it
    with_roles, _ = storage.written(roles(once, entities), "roles")
    of = lambda intent: seeds.join(plans.where(F.col("intent") == intent).select("qid", "temporal_order"), "qid").select("qid", "entity_id", "temporal_order")
    mine = lambda intent: with_roles.join(plans.where(F.col("intent") == intent).select("qid"), "qid", "left_semi")
    none = F.lit(None).cast("string")
    no_chain = F.lit(None).cast("array<string>")
    facts = plans.where("intent = 'FACT'").select("qid", F.explode("targets").alias("type"), "agent_required")
    found = fact(mine("FACT"), facts).select("qid", F.lit("ENTITY").alias("answer_type"), "rank", "entity_id", none.alias("event_id"), no_chain.alias("chain"), "frequency")
    gained = multi_hop(mine("MULTI_HOP"), of("MULTI_HOP").select("qid", "entity_id"))
    found = found.unionByName(gained.select("qid", F.lit("ENTITY").alias("answer_type"), "rank", "entity_id", none.alias("event_id"), no_chain.alias("chain"), "frequency"))
    listed = temporal(once.join(plans.where("intent = 'TEMPORAL'").select("qid"), "qid", "left_semi"), mine("TEMPORAL"), of("TEMPORAL"))
    found = found.unionByName(listed.select("qid", F.lit("EVENT_LIST").alias("answer_type"), "rank", none.alias("entity_id"), "event_id", no_chain.alias("chain"), F.lit(None).cast("long").alias("frequency")))
    why = causal(mine("CAUSAL"), of("CAUSAL").select("qid", "entity_id"))
    patients = with_roles.where("role = 'PATIENT'").select("qid", F.col("event_id").alias("effect_event"), F.col("entity_id").alias("patient"))
    chain = F.array_compact(F.array("agent", "cause_event", "patient", "effect_event"))
    why = why.join(patients, ["qid", "effect_event"], "left").select("qid", F.lit("CHAIN").alias("answer_type"), F.lit(1).alias("rank"), none.alias("entity_id"), none.alias("event_id"), chain.alias("chain"), F.lit(None).cast("long").alias("frequency"))
    found = found.unionByName(why)
    n = found.groupBy("qid").agg(F.count("*").alias("_n"))
    kind = plans.select("qid", "intent")
    sure = found.join(n, "qid").join(kind, "qid").withColumn("confidence", confidence(F.col("_n"), F.col("intent") != "FACT")).drop("_n")
    left = kind.join(n.select("qid"), "qid", "left_anti").select("qid", "intent", F.lit("NO_ANSWER").alias("answer_type"), F.lit(None).cast("int").alias("rank"), none.alias("entity_id"), none.alias("event_id"), no_chain.alias("chain"), F.lit(None).cast("long").alias("frequency"), F.lit("high").alias("confidence"))
    return sure.unionByName(left).select(*ANSWER.split(", "))


RESOLVERS = {"FACT": fact, "TEMPORAL": temporal, "MULTI_HOP": multi_hop, "CAUSAL": causal}


def resolver(intent: str):
    """The resolver of an intent; None for unknown ones, which have no answer."""
    return RESOLVERS.get(intent)
