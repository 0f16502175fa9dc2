"""Questions to plans, by rules over a table of questions: intent, seeds, types, constraints, depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon
from ..functions.text import contains_any, unicode, words_pattern
from ..sources import storage


def intent(text, rules=lexicon.INTENT_PATTERNS) -> Column:
    """The first rule in order of priority; FACT if none matches."""
    out = None
    for name, patterns in rules:
        hit = text.rlike(unicode("|".join(patterns)))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("FACT")


def target_types(text, kind, types=lexicon.INTENT_TYPES) -> Column:
    base = None
    for name, values in types.items():
        own = F.array(*[F.lit(v) for v in values])
        base = F.when(kind == name, own) if base is None else base.when(kind == name, own)
    base = base.otherwise(F.array().cast("array<string>"))
    killed = F.concat(F.array(F.lit("KILL")), F.array_remove(base, "KILL"))
    moved = F.when(text.rlike(words_pattern("killed|slew|slain")), killed).otherwise(base)
    cursed = F.when(text.rlike(words_pattern("curse|cursed|curses")), F.array(F.lit("CURSE"))).otherwise(moved)
    return F.when(text.rlike(words_pattern("why")) & (kind == "CAUSAL"), F.array_remove(cursed, "DEATH")).otherwise(cursed)


def agent_required(text) -> Column:
    return text.rlike(words_pattern("killed|slew"))


def causal_chain(text) -> Column:
    return F.contains(F.lower(text), F.lit("why"))


def temporal_order(text) -> Column:
    out = None
    for word in ("after", "before", "during", "first", "last"):
        hit = text.rlike(words_pattern(word))
        out = F.when(hit, word.upper()) if out is None else out.when(hit, word.upper())
    return out


def depth(kind) -> Column:
    return F.when(kind.isin("CAUSAL", "TEMPORAL", "MULTI_HOP"), 2).otherwise(1)


def type_rank(kind) -> Column:
    out = None
    for k, name in enumerate(lexicon.TYPE_ORDER):
        out = F.when(kind == name, k) if out is None else out.when(kind == name, k)
    return out.otherwise(len(lexicon.TYPE_ORDER))


NOT_WORD = r"(?U)\W+"
#: Bytes of a table of names, as it lies, up to which it is broadcast.
SMALL = 4 << 20


def words_of(text) -> Column:
    return F.filter(F.split(F.lower(text), NOT_WORD), lambda w: w != "")


def seeds(questions: DataFrame, aliases: DataFrame, qid: str = "qid", text: str = "text") -> DataFrame:
    """(qid, seeds): canonical names of aliases that stand in the text as whole words, by type and name.

    ``aliases``: alias (lower-cased), canonical, type. An alias is looked up by its first word, an
    equi-join; those of several words or with other characters are then compared with the text as
    they are. An alias without a letter or digit is never found.
    """
    first = F.get(words_of(F.col("alias")), 0)
    usable = aliases.where(~F.col("alias").isin(*lexicon.SEED_PRONOUNS)).select("alias", "canonical", type_rank(F.col("type")).alias("_rank"), first.alias("_word")).where("_word is not null")
    # written, so that its size is known: questions, whose size Spark guesses far too low, must not be what is broadcast
    usable, _ = storage.written(usable, "names")
    asked = questions.select(F.col(qid).alias("_q"), F.col(text).alias("_text"))
    word = F.explode(F.array_distinct(words_of(F.col("_text")))).alias("_word")
    quoted = F.regexp_replace("alias", r"([^\p{L}\p{N}_\s])", r"\\$1")
    stands = F.rlike(F.lower("_text"), F.concat(F.lit(r"(?U)\b"), quoted, F.lit(r"\b")))
    if storage.plan_bytes(usable) <= SMALL:
        met = asked.select("_q", "_text", word).join(F.broadcast(usable), "_word")
        every = met.where((F.col("alias") == F.col("_word")) | stands).select("_q", "canonical", "_rank")
    else:
        met = asked.select("_q", word).join(usable.hint("merge"), "_word")
        longer = met.where("alias != _word").join(asked.hint("merge"), "_q").where(stands)
        every = met.where("alias = _word").select("_q", "canonical", "_rank").unionByName(longer.select("_q", "canonical", "_rank"))
    hits = every.groupBy("_q", "canonical").agg(F.min("_rank").alias("_rank"))
    ordered = F.array_sort(F.collect_list(F.struct("_rank", "canonical")))
    return hits.groupBy("_q").agg(F.transform(ordered, lambda x: x["canonical"]).alias("seeds")).withColumnRenamed("_q", qid)


def plans(questions: DataFrame, aliases: DataFrame, qid: str = "qid", text: str = "text") -> DataFrame:
    """One plan a question: qid, intent, seeds, targets, agent_required, temporal_order, causal_chain, depth."""
    q = F.trim(F.col(text))
    kind = F.col("intent")
    base = questions.withColumn("intent", intent(q)).select(qid, "intent", target_types(q, kind).alias("targets"), agent_required(q).alias("agent_required"), temporal_order(q).alias("temporal_order"), causal_chain(q).alias("causal_chain"), depth(kind).alias("depth"))
    found = seeds(questions, aliases, qid, text)
    return base.join(found.hint("merge"), qid, "left").withColumn("seeds", F.coalesce("seeds", F.array().cast("array<string>")))


def death_subject(text) -> Column:
    """Who a question about a death asks for; null for other questions."""
    low = F.lower(text)
    who = F.regexp_extract(low, r"who\s+(?:killed|slew|slain|defeated)\s+([a-z][a-z\s'\-]+)\??", 1)
    how = F.regexp_extract(low, r"how\s+did\s+([a-z][a-z\s'\-]+)\s+die\??", 1)
    name = F.trim(F.when(who != "", who).otherwise(how))
    return F.when(name != "", F.initcap(F.regexp_replace(name, r"\s+", " ")))


def expansions(entity, templates=lexicon.EXPANSIONS, books=tuple(lexicon.WAR_BOOKS)) -> Column:
    """All wordings of a question about an entity's death, sorted and distinct."""
    plain = [F.concat(*[x for p in _around(t) for x in ([F.lit(p)] if p is not None else [entity])]) for t in templates]
    booked = [c for b in books for c in (F.concat(entity, F.lit(f" {b}")), F.concat(F.lit("death of "), entity, F.lit(f" {b}")))]
    return F.array_sort(F.array_distinct(F.array(*plain, *booked)))


def _around(template: str) -> list[str | None]:
    before, after = template.split("%s")
    return [x for x in (before, None, after) if x != ""]


def boost(entity, book, books=lexicon.WAR_BOOKS, own: float = lexicon.OWN_BOOK_BOOST) -> Column:
    """A book's factor; of an entity's own book a larger one. Without an entity 1."""
    out = F.lit(1.0)
    for name, factor in books.items():
        out = F.when(book == name, factor).otherwise(out)
    mine = F.lower(entity).isin("drona", "bhishma", "karna") & (book == F.concat(F.initcap(entity), F.lit(" Parva")))
    return F.when(entity.isNull(), 1.0).when(mine, own).otherwise(out)


def agents(questions: DataFrame, table: DataFrame, entity: str = "entity") -> DataFrame:
    """Questions with the known agent of their entity and its names. ``table``: entity, agent, names."""
    return questions.join(table.withColumnRenamed("entity", "_e"), F.lower(F.col(entity)) == F.col("_e"), "left").drop("_e")


def legacy_entities(text, names=lexicon.PARSER_NAMES) -> Column:
    """Names that stand anywhere in the text, in the list's order."""
    low = F.lower(text)
    return F.array_compact(F.array(*[F.when(F.contains(low, F.lit(n.lower())), F.lit(n)) for n in names]))


def legacy_phases(text, keywords=lexicon.PARSER_PHASES) -> Column:
    """Phases with a keyword inside the text, in the table's order."""
    low = F.lower(text)
    return F.array_compact(F.array(*[F.when(contains_any(low, words), F.lit(p)) for p, words in keywords.items()]))


def legacy_intent(text, keywords=lexicon.PARSER_INTENTS) -> Column:
    """The first kind with a keyword inside the text, else factual."""
    low, out = F.lower(text), F
    for name, words in keywords.items():
        out = out.when(contains_any(low, words), name)
    return out.otherwise("factual")


def legacy_scope(text, scopes=lexicon.PARSER_SCOPES) -> Column:
    """Where in time a question lies, by the first word of the table inside it; null without any."""
    low, out = F.lower(text), F
    for word, scope in scopes.items():
        out = out.when(F.contains(low, F.lit(word)), scope)
    return out


def legacy_parse(text) -> Column:
    return F.struct(text.alias("original_query"), legacy_entities(text).alias("entities"), legacy_phases(text).alias("story_phases"), legacy_intent(text).alias("intent"), legacy_scope(text).alias("temporal_scope"))


def legacy_alias(name, aliases=lexicon.PARSER_ALIASES) -> Column:
    """The table's name for an alias, whatever its case; a name that it doesn't have stays as it is."""
    table = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(name)), name)
