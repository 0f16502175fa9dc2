"""Events in sentences: detection by lexicon, arguments by patterns, and the gates that they pass."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon
from ..functions import text as T


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is computed once: the optimizer copies no expression across a generator."""
    return df.select(*[c for c in df.columns if c != name], F.explode(F.array(value)).alias(name))


def sentence_table(docs: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    found = docs.select(*key, F.posexplode(T.sentences(F.col(text))).alias("sentence_index", "sentence"))
    return once(found, "sentence", T.sentence_clean(F.col("sentence")))


def detect(sentences: DataFrame, patterns=lexicon.EVENT_PATTERNS, macro=lexicon.MACRO_TYPES, micro=lexicon.MICRO_VERBS, least: int = 5) -> DataFrame:
    """One event for each type of which a sentence holds a pattern, in the lexicon's order; none in
    sentences with a micro verb. One pass over the sentence, no join with the lexicon."""
    text, low = F.col("sentence"), F.lower("sentence")
    usable = sentences.where(F.length("sentence") >= least)
    head = T.any_head([p for own in patterns.values() for p in own])
    if head is not None:
        usable = usable.where(low.rlike(head))
    usable = usable.where(~T.holds(text, low, micro))
    flags = F.array(*[F.when(T.holds_any(text, low, own), F.struct(F.lit(k).alias("type_order"), F.lit(name).alias("event_type"), F.lit("MACRO" if name in macro else "MESO").alias("tier"))) for k, (name, own) in enumerate(patterns.items())])
    return usable.select("*", F.explode(F.array_compact(flags)).alias("_e")).select("*", "_e.*").drop("_e")


def type_histogram(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count("*").alias("n"))


#: Runs of capitalised words; longer runs are cut, as no name is that long.
CAPITALS = r"((?:[\p{Lu}][\p{L}]+)(?:\s+(?:of\s+)?[\p{Lu}][\p{L}]+){0,30})"


def candidate_ok(text) -> Column:
    low = F.lower(F.trim(text))
    words = F.split(low, r"\s+")
    out = (F.length(text) >= 2) & ~low.isin(*lexicon.ARGUMENT_PRONOUNS) & (F.size(words) <= 4)
    for phrase in lexicon.STOP_PHRASES:
        out = out & ~F.contains(low, F.lit(phrase))
    common = (text == low) & (F.size(words) > 1) & F.forall(words, lambda w: w.isin(*lexicon.COMMON_WORDS))
    prepositions = F.forall(words, lambda w: w.isin(*lexicon.PREPOSITIONS))
    return out & ~common & ~F.regexp_replace(low, " ", "").rlike(r"^\d+$") & text.rlike(r"[\p{L}\p{N}]") & ~low.rlike(r"\.htm|http|www|\.com") & ~prepositions


ARGUMENTS = "array<struct<role:string,text:string,start:int,end:int>>"
#: Sentences up to this length are searched by role patterns; their nested repeats are slow on longer ones.
LONGEST = 4_000
BEFORE, WITHIN, AFTER = "\u0001", "\u0002", "\u0003"


def role_arguments(sentence, patterns: dict[str, tuple[str, str, str]]) -> Column:
    """Arguments of one type: by role, what stands between two patterns (before, entity, after), with its
    offsets in the sentence. Matches are marked once, and offsets follow from the lengths of what lies between marks."""
    bare = F.translate(sentence, BEFORE + WITHIN + AFTER, "")

    def of(role: str, pattern: tuple[str, str, str]) -> Column:
        marked = F.regexp_replace(bare, T.unicode("(%s)(%s)(%s)" % pattern), f"{BEFORE}$1{WITHIN}$2{AFTER}$3")
        parts = F.split(marked, BEFORE)

        def argument(part: Column, k: Column) -> Column:
            lead, found = F.substring_index(part, WITHIN, 1), F.substring_index(F.substring_index(part, AFTER, 1), WITHIN, -1)
            # two marks are left in each part after the first
            start = F.length(F.array_join(F.slice(parts, 1, k), "")) - 2 * (k - 1) + F.length(lead)
            return F.when(k > 0, F.struct(F.lit(role).alias("role"), T.entity_clean(found).alias("text"), start.alias("start"), (start + F.length(found)).alias("end")))

        return F.array_compact(F.transform(parts, argument))

    found = [of(role, tuple(p)) for role, p in patterns.items()]
    every = F.concat(*found) if found else F.array()
    return F.when(F.length(sentence) <= LONGEST, every.cast(ARGUMENTS)).otherwise(F.array().cast(ARGUMENTS))


def name_arguments(sentence) -> Column:
    """Default recogniser where no model is at hand: runs of capitalised words, the first an agent, others a group."""
    parts = F.split(F.regexp_replace(F.translate(sentence, BEFORE + WITHIN + AFTER, ""), CAPITALS, f"{BEFORE}$1{AFTER}"), BEFORE)

    def argument(part: Column, k: Column) -> Column:
        found = F.substring_index(part, AFTER, 1)
        start = F.length(F.array_join(F.slice(parts, 1, k), "")) - (k - 1)
        return F.when(k > 0, F.struct(F.when(k == 1, "agent").otherwise("group").alias("role"), T.entity_clean(found).alias("text"), start.alias("start"), (start + F.length(found)).alias("end")))

    return F.array_compact(F.transform(parts, argument)).cast(ARGUMENTS)


def dedupe_arguments(args) -> Column:
    """The first of equal (lower-cased text, role), in order."""
    key = lambda x: F.struct(F.lower(x["text"]), x["role"])
    keys = F.transform(args, key)
    return F.filter(args, lambda x, i: F.array_position(keys, key(x)) == i + 1)


def agents_first(args) -> Column:
    """Arguments with agents, then patients and recipients, then others: roles can then be told by position."""
    of = lambda test: F.filter(args, lambda x: test(x["role"]))
    agent, patient = (lambda r: r.startswith("agent")), (lambda r: r.isin("patient", "recipient"))
    return F.concat(of(agent), of(patient), of(lambda r: ~agent(r) & ~patient(r)))


def extract(events: DataFrame, roles: dict[str, dict] = lexicon.ROLE_PATTERNS, recogniser: Callable[[Column], Column] = name_arguments, by_role: bool = False) -> DataFrame:
    """``arguments`` of each event: those of its type's patterns, and the recogniser's where fewer than
    three of them are candidates. An event without any keeps an empty list. ``by_role``: in the order of ``agents_first``."""
    own = F
    for kind, patterns in roles.items():
        own = own.when(F.col("event_type") == kind, role_arguments(F.col("sentence"), patterns))
    none = F.array().cast(ARGUMENTS)
    usable = lambda args: F.filter(args, lambda x: candidate_ok(x["text"]))
    found = once(events, "_own", usable(own.otherwise(none)) if roles else none)
    both = F.when(F.size("_own") < 3, F.concat("_own", usable(recogniser(F.col("sentence")).cast(ARGUMENTS)))).otherwise(F.col("_own"))
    every = once(once(found, "_all", both), "arguments", dedupe_arguments(F.col("_all"))).drop("_own", "_all")
    return once(every, "arguments", agents_first(F.col("arguments"))) if by_role else every


def meso_gate(events: DataFrame, places: tuple[str, ...] = (), tactical=lexicon.TACTICAL_VERBS) -> DataFrame:
    """Tactical events need two actors, or one and a place, and two points of confidence; others lose their arguments."""
    low = F.transform("arguments", lambda x: F.lower(x["text"]))
    is_place = lambda x: x.isin(*places) if places else F.lit(False)
    actors = F.size(F.array_distinct(F.filter(low, lambda x: ~is_place(x))))
    n_places = F.size(F.array_distinct(F.filter(low, is_place)))
    many = (actors >= 2) | ((actors >= 1) & (n_places >= 1))
    points = many.cast("int") + F.col("sentence").rlike(T.words_pattern(tactical)).cast("int") + (n_places >= 1).cast("int") - (T.word_count(F.col("sentence")) < 8).cast("int")
    keep = (F.col("tier") != "MESO") | (many & (points >= 2))
    kept = F.when(keep, F.col("arguments")).otherwise(F.array().cast(ARGUMENTS))
    judged = once(events, "_g", F.struct(points.alias("confidence"), kept.alias("arguments")))
    return judged.drop("arguments").select("*", "_g.confidence", "_g.arguments").drop("_g")


def admitted(events: DataFrame) -> DataFrame:
    return events.where(F.size("arguments") >= 1)
