"""Queries over questions, events in sentences, evidence and answers. Questions come from the customers, one each;
sentences are the documents' with planted ones. The SQL spells out its own lexicons."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon
from ..functions import text as T
from ..operators import events, evidence, graph, kgquery, plan, resolve
from ..sources import storage
from . import samples as S
from .catalog import Catalog, table
from .graph_queries import KG, mixed, seeded
from .store import graph_of
from .text_queries import SENTENCES, docs

CATALOG = Catalog()
query = CATALOG.add

W = r"[^\p{L}\p{N}_]"


def has(body: str, column: str = "text") -> str:
    """Whole words by a pattern that DuckDB has; its own edges, no word boundary of the engine's."""
    return f"regexp_matches({column}, '(?i)(^|{W})(?:{body})($|{W})')"


# questions


def questions(spark, folder):
    """(qid, text): a question of each customer about the name of its nation."""
    c = table(spark, folder, "customer")
    text = F.replace(S.pick(S.TEMPLATES, F.col("c_custkey")), F.lit("{x}"), S.pick(S.NAMES, F.col("c_nationkey")))
    return c.select(F.col("c_custkey").alias("qid"), text.alias("text"))


def names(spark):
    rows = [(n.lower(), n.lower(), ("PERSON", "GROUP", "PLACE", "TIME", "LITERAL", "OTHER")[k % 6]) for k, n in enumerate(S.NAMES)] + S.ALIASES
    return spark.createDataFrame(rows, "alias string, canonical string, type string")


ASKED = f"q AS (SELECT c_custkey AS qid, replace({S.picked(S.TEMPLATES, 'c_custkey')}, '{{x}}', {S.picked(S.NAMES, 'c_nationkey')}) AS text FROM customer)"
NAMED = f"a AS (SELECT lower(n) AS alias, lower(n) AS canonical, k % 6 AS r FROM (SELECT unnest({S.listed(S.NAMES)}) AS n, unnest(range({len(S.NAMES)})) AS k) UNION ALL SELECT alias, canonical, CASE type WHEN 'PERSON' THEN 0 WHEN 'GROUP' THEN 1 WHEN 'PLACE' THEN 2 WHEN 'TIME' THEN 3 ELSE 4 END FROM {S.rows_of(S.ALIASES)} AS t(alias, canonical, type) WHERE alias <> 'who')"
SEEDED = f"seeded AS (SELECT qid, string_agg(canonical, ',' ORDER BY r, canonical) AS seeds FROM (SELECT qid, canonical, min(r) AS r FROM q JOIN a ON CASE WHEN contains(lower(text), alias) THEN regexp_matches(lower(text), '(^|{W})' || regexp_escape(alias) || '($|{W})') ELSE false END GROUP BY 1, 2) GROUP BY 1)"
INTENT = f"CASE WHEN {has('why|because|reason')} THEN 'CAUSAL' WHEN {has('before|after|during|first|last')} THEN 'TEMPORAL' WHEN {has('benefit|benefited|benefits|consequences?|impact|impacts|impacted|led to|result in|resulted in|gained|advantage')} THEN 'MULTI_HOP' ELSE 'FACT' END"


@query(f"WITH {ASKED} SELECT qid, {INTENT} AS intent FROM q UNION ALL SELECT 1000000 + conv_id * 1000 + turn, {INTENT} FROM conversations WHERE text IS NOT NULL")
def intent_classify(spark, folder):
    turns = table(spark, folder, "conversations").where("text is not null").select((1000000 + F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), "text")
    every = questions(spark, folder).unionByName(storage.spread(turns))
    return every.select("qid", plan.intent(F.col("text")).alias("intent"))


#: Words of the conversations as names, of up to five words.
COMMON = [("the", "article", "PERSON"), ("la", "article", "PERSON"), ("und", "link", "GROUP"), ("et", "link", "GROUP"), ("of the", "of", "PLACE"), ("que", "that", "TIME"), ("that", "that", "TIME"), ("de la", "de", "PLACE"), ("with the", "with", "GROUP")]


@query(f"""WITH a AS (SELECT * FROM {S.rows_of(COMMON)} AS t(alias, canonical, type)), h AS (SELECT conv_id, turn, canonical, min(CASE type WHEN 'PERSON' THEN 0 WHEN 'GROUP' THEN 1 WHEN 'PLACE' THEN 2 ELSE 3 END) AS k FROM conversations JOIN a ON CASE WHEN contains(lower(text), alias) THEN regexp_matches(lower(text), '(^|{W})' || alias || '($|{W})') ELSE false END GROUP BY 1, 2, 3)
 SELECT conv_id, turn, string_agg(canonical, ',' ORDER BY k, canonical) AS seeds FROM h GROUP BY 1, 2""")
def seed_entities(spark, folder):
    q = storage.spread(table(spark, folder, "conversations")).withColumn("qid", F.struct("conv_id", "turn"))
    found = plan.seeds(q, spark.createDataFrame(COMMON, "alias string, canonical string, type string"))
    return found.select("qid.conv_id", "qid.turn", F.array_join("seeds", ",").alias("seeds"))


BASE = "CASE intent WHEN 'FACT' THEN ['KILL', 'DEATH', 'BATTLE', 'CORONATION', 'APPOINTED_AS', 'CURSE'] WHEN 'CAUSAL' THEN ['SUPPORTED', 'DEFENDED', 'VOW', 'COMMAND'] WHEN 'TEMPORAL' THEN ['DEATH', 'BATTLE', 'RETREATED'] WHEN 'MULTI_HOP' THEN ['KILL', 'DEATH', 'BOON', 'CURSE'] END"
TARGETS = f"CASE WHEN {has('curse|cursed|curses')} THEN ['CURSE'] WHEN {has('killed|slew|slain')} THEN list_concat(['KILL'], list_filter({BASE}, lambda x: x <> 'KILL')) ELSE {BASE} END"
ORDER = "CASE " + " ".join(f"WHEN {has(w)} THEN '{w.upper()}'" for w in ("after", "before", "during", "first", "last")) + " END"


@query(f"""WITH {ASKED}, {NAMED}, {SEEDED}, i AS (SELECT qid, text, {INTENT} AS intent FROM q) SELECT qid, intent, coalesce(seeds, '') AS seeds, array_to_string({TARGETS}, ',') AS targets, {has('killed|slew')} AS agent_required,
 {ORDER} AS temporal_order, contains(lower(text), 'why') AS causal_chain, CASE WHEN intent = 'FACT' THEN 1 ELSE 2 END AS depth FROM i LEFT JOIN seeded USING (qid)""")
def query_plan_batch(spark, folder):
    p = plan.plans(questions(spark, folder), names(spark))
    return p.select("qid", "intent", F.array_join("seeds", ",").alias("seeds"), F.array_join("targets", ",").alias("targets"), "agent_required", "temporal_order", "causal_chain", "depth")


DEATH = r"""CASE WHEN regexp_extract(lower(text), 'who\s+(?:killed|slew|slain|defeated)\s+([a-z][a-z\s''\-]+)\??', 1) <> '' THEN trim(regexp_extract(lower(text), 'who\s+(?:killed|slew|slain|defeated)\s+([a-z][a-z\s''\-]+)\??', 1))
 ELSE trim(regexp_extract(lower(text), 'how\s+did\s+([a-z][a-z\s''\-]+)\s+die\??', 1)) END"""
DIED = f"d AS (SELECT qid, {DEATH} AS n FROM q), e AS (SELECT qid, array_to_string(list_transform(string_split(n, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS entity FROM d WHERE n <> '')"


def asked_about(spark, folder):
    return questions(spark, folder).select("qid", plan.death_subject(F.col("text")).alias("entity")).where("entity is not null")


@query(f"WITH {ASKED}, {DIED} SELECT qid, entity FROM e")
def death_questions(spark, folder):
    return asked_about(spark, folder)


@query(f"""WITH {ASKED}, {DIED}, x AS (SELECT qid, replace(t, '%', entity) AS wording FROM e, (VALUES ('death of %'), ('% death'), ('% slain in battle'), ('% killed in battle'), ('% slain'), ('% fall in battle'), ('% defeat'),
 ('% Bhishma Parva'), ('% Drona Parva'), ('% Karna Parva'), ('% Shalya Parva'), ('% Sauptika Parva'), ('death of % Bhishma Parva'), ('death of % Drona Parva'), ('death of % Karna Parva'), ('death of % Shalya Parva'), ('death of % Sauptika Parva')) AS t(t)) SELECT DISTINCT qid, wording FROM x""")
def expansion_templates(spark, folder):
    return asked_about(spark, folder).select("qid", F.explode(plan.expansions(F.col("entity"))).alias("wording"))


BOOKS = ["Bhishma Parva", "Drona Parva", "Karna Parva", "Shalya Parva", "Sauptika Parva", "Adi Parva"]


@query(f"""WITH {ASKED}, {DIED}, b AS (SELECT * FROM (VALUES ('Bhishma Parva', 1.08), ('Drona Parva', 1.1), ('Karna Parva', 1.08), ('Shalya Parva', 1.05), ('Sauptika Parva', 1.05), ('Adi Parva', 1.0)) AS t(book, f)) SELECT qid, book, CASE WHEN entity || ' Parva' = book AND entity IN ('Karna', 'Drona', 'Bhishma') THEN 1.12 ELSE f END::DOUBLE AS boost FROM e, b""")
def book_boosts(spark, folder):
    rows = asked_about(spark, folder).select("qid", "entity", F.explode(F.array(*[F.lit(b) for b in BOOKS])).alias("book"))
    return rows.select("qid", "book", plan.boost(F.col("entity"), F.col("book")).cast("double").alias("boost"))


@query(f"""WITH {ASKED}, {DIED} SELECT qid, entity, agent, array_to_string(names, ',') AS names FROM e LEFT JOIN (VALUES ('karna', 'Arjuna', ['arjuna', 'partha', 'dhananjaya', 'pandava', 'parth']), ('drona', 'Dhrishtadyumna', ['dhrishtadyumna', 'dhristadyumna', 'panchala prince', 'prince of the panchalas']),
 ('bhishma', 'Shikhandi and Arjuna', ['shikhandi', 'shikhandin', 'arjuna', 'partha', 'dhananjaya']), ('jayadratha', 'Arjuna', ['arjuna', 'partha', 'dhananjaya']), ('bhurishravas', 'Satyaki', ['satyaki', 'yuyudhana'])) AS t(k, agent, names) ON lower(entity) = k""")
def known_agents(spark, folder):
    known = spark.createDataFrame([(k, a, list(n)) for k, (a, n) in lexicon.AGENTS.items()], "entity string, agent string, names array<string>")
    return plan.agents(asked_about(spark, folder), known).select("qid", "entity", "agent", F.array_join("names", ",").alias("names"))


PHASES = {"Origins": "creation|ancient|beginning", "RiseOfThePandavas": "rise|youth|swayamvara", "Exile": "exile|forest|agyatvasa|wandering", "PreludeToWar": "prelude|negotiation|diplomacy", "KurukshetraWar": "war|kurukshetra|battle", "ImmediateAftermath": "aftermath|mourning", "PostWarInstruction": "instruction|teaching", "WithdrawalFromTheWorld": "withdrawal|heaven|death"}


@query(f"""WITH {ASKED}, l AS (SELECT qid, lower(text) AS t FROM q) SELECT qid, array_to_string(list_filter(['Arjuna', 'Yudhishthira', 'Bhima', 'Draupadi', 'Krishna', 'Karna', 'Duryodhana', 'Ashvatthama', 'Drona', 'Bhishma'], lambda n: contains(t, lower(n))), ',') AS entities,
 coalesce(array_to_string([{', '.join(f"CASE WHEN regexp_matches(t, '{w}') THEN '{p}' END" for p, w in PHASES.items())}], ','), '') AS phases,
 CASE WHEN regexp_matches(t, 'when|during|time') THEN 'temporal' WHEN regexp_matches(t, 'where|location|place') THEN 'location' WHEN regexp_matches(t, 'why|reason|cause') THEN 'causal' WHEN regexp_matches(t, 'what happened|what did') THEN 'narrative' ELSE 'factual' END AS intent,
 CASE WHEN contains(t, 'agyatvasa') THEN 'Exile.Year13.Agyatvasa' WHEN contains(t, 'forest') THEN 'Exile.ForestYears' WHEN contains(t, 'war') THEN 'KurukshetraWar' END AS scope FROM l""")
def legacy_parse(spark, folder):
    p = questions(spark, folder).select("qid", plan.legacy_parse(F.col("text")).alias("p"))
    return p.select("qid", F.array_join("p.entities", ",").alias("entities"), F.array_join("p.story_phases", ",").alias("phases"), "p.intent", F.col("p.temporal_scope").alias("scope"))


@query(f"""WITH n AS (SELECT c_custkey AS k, {S.picked(S.TEXTS + S.NAMES, 'c_custkey')} AS name FROM customer) SELECT k, coalesce(canonical, name) AS resolved FROM n LEFT JOIN (VALUES ('partha', 'Arjuna'), ('dhananjaya', 'Arjuna'), ('brihannala', 'Arjuna'), ('dharmaraja', 'Yudhishthira'), ('kanka', 'Yudhishthira'), ('bhimasena', 'Bhima'), ('vrikodara', 'Bhima'),
 ('ballava', 'Bhima'), ('krishnaa', 'Draupadi'), ('panchali', 'Draupadi'), ('sairindhri', 'Draupadi'), ('vasudeva', 'Krishna'), ('hari', 'Krishna'), ('govinda', 'Krishna')) AS t(alias, canonical) ON lower(name) = alias""")
def legacy_alias(spark, folder):
    return table(spark, folder, "customer").select(F.col("c_custkey").alias("k"), plan.legacy_alias(S.pick(S.TEXTS + S.NAMES, F.col("c_custkey"))).alias("resolved"))


# evidence

KEYS = ("was", "with", "from", "that")


@query("SELECT doc_id, round(1.0 / (1 + doc_id) * CASE WHEN contains(lower(text), 'thea') THEN 1.1 ELSE 1.0 END * (1.0 + 0.05 * least(contains(lower(text), 'was')::INT + contains(lower(text), 'with')::INT + contains(lower(text), 'from')::INT + contains(lower(text), 'that')::INT, 3)), 9) AS score FROM documents ORDER BY score DESC, doc_id LIMIT 20")
def rerank_score(spark, folder):
    d = docs(spark, folder).withColumn("s", 1.0 / (1 + F.col("doc_id")))
    scored = d.withColumn("score", F.round(evidence.rerank_score(F.col("s"), F.col("text"), F.lit("Thea"), KEYS), 9))
    return evidence.top_ranked(scored, 20, before="doc_id").select("doc_id", "score")


VERBS, AGENTS, TARGET = ("was", "from"), ("with", "have"), "that"
AT = lambda test: f"list_filter(range(len(s)), lambda i: {test})"
NEAR = lambda a, b: f"len(list_filter({a}, lambda x: len(list_filter({b}, lambda y: abs(x - y) <= 2)) > 0)) > 0"
EVIDENCE = f"""s AS (SELECT doc_id, {SENTENCES.format('lower(text)')} AS s FROM {{0}}), a AS (SELECT doc_id, {AT("contains(s[i + 1], 'that')")} AS e, {AT("contains(s[i + 1], 'was') OR contains(s[i + 1], 'from')")} AS v, {AT("contains(s[i + 1], 'with') OR contains(s[i + 1], 'have')")} AS g FROM s),
 h AS (SELECT doc_id, {NEAR('e', 'v')} AS death_hit, len(g) > 0 AS agent_hit, {NEAR('e', 'v')} AND {NEAR('e', 'g')} AS cooccur FROM a)"""
EVERY, BEST = EVIDENCE.format("documents"), EVIDENCE.format("(SELECT * FROM documents ORDER BY doc_id DESC LIMIT 20)")


@query(f"WITH {EVERY} SELECT doc_id, death_hit, agent_hit, cooccur FROM h")
def evidence_window(spark, folder):
    return evidence.death_evidence(docs(spark, folder), TARGET, AGENTS, VERBS).select("doc_id", "death_hit", "agent_hit", "cooccur")


@query(f"WITH {BEST} SELECT coalesce(bool_or(cooccur) OR (bool_or(death_hit) AND bool_or(agent_hit)), false) AS supported FROM h")
def support_decision(spark, folder):
    """By the twenty best chunks; a larger id is the better rank."""
    return evidence.supported(evidence.death_evidence(docs(spark, folder).withColumn("rank", -F.col("doc_id")), TARGET, AGENTS, VERBS, rank="rank"))


@query(f"WITH {EVERY}, t AS (SELECT doc_id, CASE WHEN cooccur THEN 0 WHEN death_hit THEN 1 WHEN agent_hit THEN 2 END AS tier FROM h) SELECT doc_id, tier FROM t WHERE tier IS NOT NULL ORDER BY tier, doc_id LIMIT 6")
def citation_select(spark, folder):
    found = evidence.death_evidence(docs(spark, folder), TARGET, AGENTS, VERBS)
    return evidence.citations(found.withColumn("rank", F.col("doc_id")), "doc_id", "rank").select("doc_id", "tier")


STOP = """('the','and','of','in','to','a','an','on','at','by','for','with','as','from','that','this','these','those','who','whom','whose','which','what','when','where','how','why',
 'is','was','were','are','be','been','it','its','their','his','her','him','she','he','they','them','you','your','yours','we','our','ours','but','or')"""
TERMS = lambda c: f"list_filter(regexp_extract_all(lower({c}), '[a-zA-Z'']+'), lambda x: length(x) > 3 AND x NOT IN {STOP})"
ACTIONS = "['killed', 'slew', 'slain', 'defeated', 'command', 'leader', 'senapati', 'appointed', 'made', 'became', 'fell', 'died']"
SUPPORT = f"""len(list_filter(regexp_extract_all(f, '\\b[A-Z][a-zA-Z]+\\b'), lambda x: NOT contains(lower(chunk), lower(x)))) = 0
 AND (len(list_filter({ACTIONS}, lambda x: contains(lower(f), x))) = 0 OR len(list_filter({ACTIONS}, lambda x: contains(lower(f), x) AND contains(lower(chunk), x))) > 0)
 AND len(list_intersect(list_distinct({TERMS('f')}), list_distinct({TERMS('chunk')}))) >= CASE WHEN len({TERMS('f')}) > 0 THEN greatest(2, least(4, len({TERMS('f')}))) ELSE 0 END"""
PAIRS = f"""l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ps, text FROM documents), u AS (SELECT doc_id, unnest(range(len(ps))) AS para, unnest(ps) || CASE WHEN doc_id % 3 = 0 THEN ' He was slain.' ELSE '' END AS line, unnest(ps[2:]) || ' Karna fell.' AS chunk FROM l)"""


@query(f"""WITH {PAIRS}, s AS (SELECT doc_id, para, line, chunk, unnest({SENTENCES.format('line')}) AS f FROM (SELECT * FROM u WHERE line IS NOT NULL)), b AS (SELECT doc_id, para, f, line AS chunk, 'own' AS of FROM s UNION ALL SELECT doc_id, para, f, coalesce(chunk, ' Karna fell.'), 'next' FROM s)
 SELECT doc_id, para::INT AS para, of, count(*) AS n, count(*) FILTER ({SUPPORT}) AS supported FROM b GROUP BY 1, 2, 3""")
def sentence_support(spark, folder):
    """Every sentence of a line (a planted one among them) against the line itself, and against the next one."""
    lines = docs(spark, folder).select("doc_id", F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "").alias("ps"))
    # a line goes with the next one only, not with its document
    pairs = F.arrays_zip(F.col("ps").alias("line"), F.slice("ps", 2, F.greatest(F.size("ps"), F.lit(1))).alias("next"))
    u = lines.select("doc_id", F.posexplode(pairs).alias("para", "p"))
    line = F.concat("p.line", F.when(F.col("doc_id") % 3 == 0, " He was slain.").otherwise(""))
    follow = F.concat(F.coalesce("p.next", F.lit("")), F.lit(" Karna fell."))
    # what a chunk holds is found once a chunk, what a sentence claims once a sentence
    both = events.once(u.select("doc_id", "para", line.alias("line"), follow.alias("next")), "_c", F.struct(evidence.held(F.col("line")).alias("own"), evidence.held(F.col("next")).alias("next")))
    said = events.once(both.select("doc_id", "para", "_c", F.explode(T.sentences(F.col("line"))).alias("f")), "f", evidence.claims(F.col("f")))
    tested = said.select("doc_id", "para", *[evidence.holds(F.col("f"), F.col("_c")[of]).alias(of) for of in ("own", "next")])
    counted = tested.groupBy("doc_id", "para").agg(F.count("*").alias("n"), F.count_if("own").alias("own"), F.count_if("next").alias("next"))
    sides = F.explode(F.array(*[F.struct(F.lit(of).alias("of"), F.col(of).alias("supported")) for of in ("own", "next")])).alias("s")
    return counted.select("doc_id", "para", "n", sides).select("doc_id", "para", "s.of", "n", "s.supported")


@query(f"""WITH a AS (SELECT doc_id, trim(list_extract(string_split(text, chr(10)), 1)) AS t FROM documents), s AS (SELECT doc_id, unnest({SENTENCES.format('t')}) AS f, unnest(range(len({SENTENCES.format('t')}))) AS i FROM a),
 c AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN doc_id ELSE doc_id + 1 END AS cited FROM a), p AS (SELECT s.doc_id, i, f, d.text AS chunk FROM s JOIN c ON c.doc_id = s.doc_id LEFT JOIN documents d ON d.doc_id = cited AND trim(d.text) <> ''),
 e AS (SELECT doc_id, i, coalesce(bool_or({SUPPORT}), false) AS ok FROM p GROUP BY 1, 2) SELECT doc_id AS answer_id, coalesce(bool_and(ok), false) AS supported FROM a LEFT JOIN e USING (doc_id) GROUP BY 1""")
def answer_support(spark, folder):
    """A document's first line as an answer that cites the document itself (even ids) or the next one, and one that doesn't exist."""
    d = docs(spark, folder)
    answers = d.select(F.col("doc_id").alias("answer_id"), F.get(F.split("text", "\n"), 0).alias("text"))
    own = F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")).otherwise(F.col("doc_id") + 1)
    cited = d.select(F.col("doc_id").alias("answer_id"), F.explode(F.array(own, F.lit(-1).cast("long"))).alias("chunk_id"))
    return evidence.answers_supported(answers, cited, d.select(F.col("doc_id").alias("chunk_id"), "text"))


@query("WITH b AS (SELECT doc_id, list_extract(" + SENTENCES.format("text") + ", 1) AS f FROM documents ORDER BY doc_id LIMIT 5) SELECT string_agg(f || ' [' || doc_id || ']', ' ' ORDER BY doc_id) AS answer, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS citations FROM b")
def extractive_answer(spark, folder):
    out = evidence.extractive_answer(docs(spark, folder), "doc_id", "doc_id")
    return out.select("answer", F.array_join("citations", ",").alias("citations"))


@query("SELECT conv_id, turn, trim(coalesce(text, '')) <> '' AND turn % 4 NOT IN (1, 2) AND conv_id % 5 <> 0 AS valid FROM conversations")
def answer_validity(spark, folder):
    """Turns as answers: some cite twice, some cite what is not known, some say nothing."""
    k = F.col("turn")
    ids = F.when(k % 4 == 1, F.array(F.lit("a"), F.lit("a"))).when(k % 4 == 2, F.array(F.lit("a"), F.lit("z"))).otherwise(F.array(F.lit("a"), F.lit("b")))
    said = F.when(F.col("conv_id") % 5 == 0, " ").otherwise(F.coalesce("text", F.lit("")))
    return table(spark, folder, "conversations").select("conv_id", "turn", evidence.valid_citations(said, ids, F.array(F.lit("a"), F.lit("b"), F.lit("c"))).alias("valid"))


GIVEN = "['P01-S001-C00' || doc_id % 9, 'P01-S002-C007', 'P02-S001-C001']"
CITING = "'He fell [P01-S001-C00' || doc_id % 7 || '] and rose [P02-S001-C001], [P09-S001-C001]. [E' || doc_id % 3 || '] [P02-S001-C001]'"


@query(f"""WITH t AS (SELECT doc_id, {GIVEN} AS c, ['E1', 'E2', 'E5', 'E6'] AS e, CASE WHEN doc_id % 4 = 0 THEN 'Nothing cited.' ELSE {CITING} END AS said FROM documents), x AS (SELECT *, list_filter(['P01-S001-C00' || doc_id % 7, 'P02-S001-C001'], lambda v: list_contains(c, v)) AS own, list_filter(['E' || doc_id % 3], lambda v: list_contains(e, v)) AS ev FROM t)
 SELECT doc_id, array_to_string(CASE WHEN doc_id % 4 = 0 THEN c ELSE own END, ',') AS chunks, array_to_string(CASE WHEN doc_id % 4 = 0 OR len(ev) = 0 THEN ['E1', 'E2', 'E5'] ELSE ev END, ',') AS events, 'high' AS confidence FROM x""")
def citation_extract(spark, folder):
    """Planted answers: cited ids that were given, and the first given ones where none is."""
    k = F.col("doc_id")
    given = F.array(F.concat(F.lit("P01-S001-C00"), k % 9), F.lit("P01-S002-C007"), F.lit("P02-S001-C001"))
    citing = F.concat(F.lit("He fell [P01-S001-C00"), k % 7, F.lit("] and rose [P02-S001-C001], [P09-S001-C001]. [E"), k % 3, F.lit("] [P02-S001-C001]"))
    said = F.when(k % 4 == 0, "Nothing cited.").otherwise(citing)
    c = docs(spark, folder).select("doc_id", evidence.grounded_citations(said, given, F.array(*[F.lit(e) for e in ("E1", "E2", "E5", "E6")])).alias("c"))
    return c.select("doc_id", F.array_join("c.chunks", ",").alias("chunks"), F.array_join("c.events", ",").alias("events"), "c.confidence")


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'P01-S001-C001,P01-S001-C002' WHEN 1 THEN 'c1,c2,c3,c4,c5' WHEN 2 THEN 'P99-S999-C999' ELSE '' END AS citations FROM documents""")
def citation_default(spark, folder):
    """Ids in a text, each once; where there is none the first five retrieved."""
    said = S.pick(["x P01-S001-C001 (P01-S001-C002) P01-S001-C001", "none P1-S1-C1", "P99-S999-C9999", "nothing retrieved"], F.col("doc_id"))
    got = F.when(F.col("doc_id") % 4 == 3, F.array().cast("array<string>")).otherwise(F.array(*[F.lit(f"c{i}") for i in range(1, 8)]))
    return docs(spark, folder).select("doc_id", F.array_join(evidence.or_default(evidence.cited_ids(said), got), ",").alias("citations"))


@query(r"""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 5 IN (0, 1) THEN 0 ELSE 1 END AS c, CASE WHEN doc_id % 5 IN (0, 2) THEN 0 ELSE 2 END AS e, CASE WHEN doc_id % 5 = 4 THEN ' . x' ELSE text END AS text FROM documents), x AS (SELECT *, trim(string_split(trim(text), '.')[1]) AS first FROM t)
 SELECT doc_id, CASE WHEN c = 0 AND e = 0 THEN 'No grounded answer was found from the provided evidence.' WHEN c > 0 AND first <> '' THEN first || '.' WHEN e > 0 THEN 'Karna fell.' ELSE 'Relevant passages retrieved but unable to synthesize answer.' END AS answer, CASE WHEN c = 0 AND e = 0 THEN 'low' ELSE 'medium' END AS confidence FROM x""")
def answer_fallback(spark, folder):
    k = F.col("doc_id") % 5
    n_chunks, n_events = F.when(k.isin(0, 1), 0).otherwise(1), F.when(k.isin(0, 2), 0).otherwise(2)
    text = F.when(k == 4, " . x").otherwise(F.col("text"))
    f = evidence.fallback(F.when(n_chunks > 0, text), F.when(n_events > 0, F.lit("Karna fell. He rose.")), n_chunks, n_events)
    return docs(spark, folder).select("doc_id", f.alias("f")).select("doc_id", "f.answer", "f.confidence")


def echo():
    """A service that stands for a model: it cites the first chunk of the prompt, and fails on some questions."""

    def ask(prompt: str) -> str:
        if "no answer" in prompt:
            raise RuntimeError("the service is down")
        return prompt.split("RETRIEVED TEXT CHUNKS:\n")[1].split(" ")[0] + f" says so in {len(prompt)} characters."

    return ask


@query(f"""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'no answer' ELSE 'why?' END AS q, 'P01-S001-C' || lpad((doc_id % 1000)::VARCHAR, 3, '0') AS id, trim(text) AS text FROM documents), p AS (SELECT *, 'Cite.' || chr(10) || chr(10) || 'QUESTION: ' || q || chr(10) || chr(10) || 'RETRIEVED TEXT CHUNKS:' || chr(10) || '[' || id || '] ' || substring(text, 1, 400) || chr(10) || chr(10) || 'KNOWLEDGE GRAPH EVENTS:' || chr(10) || '[E1] fell' || chr(10) || chr(10) || 'ANSWER (cite IDs in brackets):' AS prompt FROM t)
 SELECT doc_id AS qid, CASE WHEN q <> 'no answer' THEN '[' || id || '] says so in ' || length(prompt) || ' characters.' WHEN trim(string_split(text, '.')[1]) <> '' THEN trim(string_split(text, '.')[1]) || '.' ELSE 'fell.' END AS answer, id AS chunks, 'E1' AS events, CASE WHEN q = 'no answer' THEN 'medium' ELSE 'high' END AS confidence FROM p""")
def answer_service(spark, folder):
    """Answers by a service, and the fallback where it fails."""
    k = F.col("doc_id")
    q = docs(spark, folder).select(k.alias("qid"), F.when(k % 3 == 0, "no answer").otherwise("why?").alias("text"), F.array(F.struct(F.format_string("P01-S001-C%03d", k % 1000).alias("id"), F.col("text").alias("text"))).alias("chunks"), F.array(F.struct(F.lit("E1").alias("id"), F.lit("fell").alias("text"))).alias("events"))
    out = evidence.synthesize(q, echo, "Cite.")
    return out.select("qid", "answer", F.array_join("chunks", ",").alias("chunks"), F.array_join("events", ",").alias("events"), "confidence")


@query(f"WITH {KG}, d AS (SELECT DISTINCT qid, event_id FROM plans JOIN edges ON source_id = seed), c AS (SELECT qid, arg.entity_id, count(*) AS n FROM d JOIN arg USING (event_id) GROUP BY 1, 2), t AS (SELECT qid, entity_id FROM c QUALIFY row_number() OVER (PARTITION BY qid ORDER BY n DESC, entity_id) <= 8) SELECT qid, 'event' AS kind, event_id AS id FROM d UNION ALL SELECT qid, 'chunk', entity_id FROM t")
def evidence_bundle(spark, folder):
    """Events of each question, each once though matched twice, and its eight best chunks (here entities by how often they take part)."""
    kg = graph_of(spark, folder)
    found = kgquery.fact(seeded(spark, folder, []), kg.edges, kg.events).select("qid", "event_id", "participants")
    near = found.select("qid", F.explode("participants").alias("rank")).groupBy("qid", "rank").agg(F.count("*").alias("score"))
    ev, chunks = evidence.bundle(found.select("qid", "event_id").unionAll(found.select("qid", "event_id")), near)
    return ev.where("score = 1.0").select("qid", F.lit("event").alias("kind"), F.col("event_id").alias("id")).unionByName(chunks.select("qid", F.lit("chunk").alias("kind"), F.col("rank").alias("id")))


@query("""WITH u AS (SELECT conv_id AS qid, turn, 'T' || turn AS unit_id, text FROM conversations WHERE role = 'assistant'), b AS (SELECT qid, arg_min(text, turn) AS text, string_agg(unit_id, ',' ORDER BY turn) AS supporting, count(*) AS n FROM u GROUP BY 1), q AS (SELECT DISTINCT conv_id AS qid FROM conversations)
 SELECT qid, CASE WHEN n IS NULL THEN 'No relevant information found.' WHEN qid % 2 = 0 THEN 'given' ELSE substring(text, 1, 500) || '...' END AS answer, CASE WHEN n IS NOT NULL THEN 'Unknown' END AS story_phase, coalesce(supporting, '') AS supporting, n IS NOT NULL AS valid,
 CASE WHEN n IS NOT NULL THEN md5('Query: q' || chr(10) || chr(10) || 'Answer:' || chr(10) || CASE WHEN qid % 2 = 0 THEN 'given' ELSE substring(text, 1, 500) || '...' END || chr(10) || chr(10) || 'Retrieved from:' || chr(10) || 'Parva: p' || chr(10) || 'Section: s' || chr(10) || 'Story Phase: Unknown' || chr(10) || chr(10) || 'Contextual Passage:' || chr(10) || '"' || text || ' end"' || chr(10)) END AS display FROM q LEFT JOIN b USING (qid)""")
def answer_display(spark, folder):
    """A conversation as a question, its assistant turns as the units retrieved."""
    c = table(spark, folder, "conversations")
    q = c.select(F.col("conv_id").alias("qid")).distinct().select("qid", F.lit("q").alias("text"), F.when(F.col("qid") % 2 == 0, "given").alias("answer"))
    u = c.where("role = 'assistant'").select(F.col("conv_id").alias("qid"), F.col("turn").alias("rank"), F.concat(F.lit("T"), "turn").alias("unit_id"), F.lit("p").alias("parva"), F.lit("s").alias("section"), F.lit(None).cast("string").alias("story_phase"), F.col("text").alias("text"), F.array("text", F.lit("end")).alias("paragraphs"))
    out = evidence.formatted(q, u.withColumnRenamed("text", "text"))
    return out.select("qid", "answer", "story_phase", F.array_join("supporting", ",").alias("supporting"), "valid", F.md5("display").alias("display"))


# events


def planted(spark, folder):
    """Documents with two planted sentences each."""
    k = F.col("doc_id")
    return docs(spark, folder).select("doc_id", F.concat("text", F.lit(". "), S.pick(S.SENTENCES, k), F.lit(" "), S.pick(S.SENTENCES, F.floor(k / 7) + 3)).alias("text"))


PLANTED = f"pl AS (SELECT doc_id, text || '. ' || {S.picked(S.SENTENCES, 'doc_id')} || ' ' || {S.picked(S.SENTENCES, 'doc_id // 7 + 3')} AS text FROM documents)"
CLEANED = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw, 'https?://\S+', '', 'g'), 'file://\S+', '', 'g'), '(?i)\bm\d+\w*\.htm', '', 'g'), '\bwww\.\S+', '', 'g'), '(?i)\b(?:said|spoke|replied|answered|continued),?--', '', 'g'), '\s+', ' ', 'g'))"
SENT = f"se AS (SELECT doc_id, unnest(range(len(s)))::INT AS sentence_index, unnest(s) AS raw FROM (SELECT doc_id, {SENTENCES.format('text')} AS s FROM pl)), sc AS (SELECT doc_id, sentence_index, {CLEANED} AS sentence FROM se)"
MICRO = "said|spoke|replied|answered|told|asked|questioned|went|came|arrived|departed|returned|reached|saw|looked|beheld|witnessed|observed|thought|knew|understood|remembered|forgot|stood|sat|lay|arose|rose"
TYPES = {
    "KILL": "kill|killed|slay|slew|slain|struck?\\s+down|struck?\\s+dead|smote|smitten|slaughter|beheaded|beheading|decapitated|murder|murdered",
    "COMMAND": "command|commanded|led|ordered|instructed|directed|sent|dispatch|deputed",
    "BATTLE": "battle|fought|clash|combat|war|duel|skirmish",
    "VOW": "vow|vowed|vowing|swore|sworn|swear|oath|promise|promised",
    "CURSE": "curse|cursed|cursing|accursed|doomed|condemned|imprecation",
    "BOON": "boon|granted|favour|favor|gift|bestowed",
    "DEATH": "died|death|perish|perished|fallen|fell|expire|expired|breathed\\s+(?:his|her)\\s+last|passed\\s+away|succumb|succumbed",
    "CORONATION": "crowned|coronation|anointed|installed\\s+as\\s+king|made\\s+king|enthroned|ascended\\s+(?:the\\s+)?throne",
    "ENGAGED_IN_BATTLE": "engaged\\s+(?:in\\s+)?(?:battle|combat|fight)|encountered\\s+(?:in\\s+)?battle|met\\s+(?:in\\s+)?battle|joined\\s+battle\\s+with|stood\\s+against|opposed|confronted|advanced\\s+against|assailed|attacked|surged\\s+against",
    "DEFEATED": "defeated|overcame|vanquished|routed|conquered|subdued|overpowered|worsted|broke\\s+the\\s+ranks\\s+of",
    "PROTECTED": "protected|defended|shielded|guarded|covered\\s+the\\s+retreat\\s+of|supported|reinforced|held\\s+firm\\s+for",
    "PURSUED": "pursued|chased|followed|hunted|tracked",
    "RESCUED": "rescued|saved|delivered\\s+from|liberated|freed",
    "APPOINTED_AS": "appointed\\s+[\\p{L}\\p{N}_]+|installed\\s+as|made\\s+(?:commander|general|minister|king)|designated\\s+as",
    "ABANDONED": "abandoned|left|forsook|deserted|renounced|retreated\\s+before|fled\\s+from|fell\\s+back\\s+before",
    "ATTACKED": "attacked|assailed|assaulted|struck\\s+at|charged\\s+at|fell\\s+upon|made\\s+war\\s+upon",
    "DEFENDED": "defended|shielded|protected|held\\s+the\\s+line\\s+against|stood\\s+fast\\s+against",
    "RETREATED": "retreated|fell\\s+back|withdrew|fled\\s+from|turned\\s+back\\s+before",
    "SURROUNDED": "surrounded|encompassed|hemmed\\s+in|closed\\s+in\\s+upon",
    "SUPPORTED": "supported|reinforced|succoured|came\\s+to\\s+the\\s+aid\\s+of|covered\\s+the\\s+retreat\\s+of",
    "FORMED_ARRAY_AGAINST": "formed\\s+(?:an\\s+)?array\\s+against|arrayed\\s+against|drew\\s+up\\s+against|entered\\s+the\\s+ranks\\s+of",
}
DETECT = f"WITH {PLANTED}, {SENT}, su AS (SELECT * FROM sc WHERE length(sentence) >= 5 AND NOT {has(MICRO, 'sentence')}), de AS (" + " UNION ALL ".join(f"SELECT doc_id, sentence_index, sentence, {k} AS k, '{n}' AS event_type, '{'MACRO' if k < 8 else 'MESO'}' AS tier FROM su WHERE {has(b, 'sentence')}" for k, (n, b) in enumerate(TYPES.items())) + ")"


def detected(spark, folder):
    return events.detect(events.sentence_table(planted(spark, folder), ["doc_id"]))


@query(f"{DETECT} SELECT doc_id, sentence_index, event_type, tier, sentence FROM de")
def event_detect(spark, folder):
    return detected(spark, folder).select("doc_id", "sentence_index", "event_type", "tier", "sentence")


#: Frequent words of the tables as a lexicon, so that nearly every sentence is an event.
FREQUENT = {"KILL": (r"\b(?:was|ist)\b",), "BATTLE": (r"\b(?:with)\b",), "DEATH": (r"\b(?:that|que)\b",), "VOW": (r"\b(?:for)\b",), "SUPPORTED": (r"\b(?:from|avec)\b",), "DEFENDED": (r"\b(?:this|nicht)\b",)}
FREQUENT_SQL = {"KILL": "was|ist", "BATTLE": "with", "DEATH": "that|que", "VOW": "for", "SUPPORTED": "from|avec", "DEFENDED": "this|nicht"}


@query(f"WITH {PLANTED.replace('pl AS', 'other AS')}, pl AS (SELECT doc_id, text FROM documents), {SENT}, su AS (SELECT * FROM sc WHERE length(sentence) >= 5 AND NOT {has('is|be', 'sentence')}) " + " UNION ALL ".join(f"SELECT doc_id, sentence_index, '{n}' AS event_type, '{'MESO' if n in ('SUPPORTED', 'DEFENDED') else 'MACRO'}' AS tier FROM su WHERE {has(b, 'sentence')}" for n, b in FREQUENT_SQL.items()))
def event_detect_frequent(spark, folder):
    found = events.detect(events.sentence_table(docs(spark, folder), ["doc_id"]), FREQUENT, ("KILL", "BATTLE", "DEATH", "VOW"), ("is", "be"))
    return found.select("doc_id", "sentence_index", "event_type", "tier")


@query(f"{DETECT} SELECT event_type, count(*) AS n FROM de GROUP BY 1")
def event_type_histogram(spark, folder):
    return events.type_histogram(detected(spark, folder))


@query(f"{DETECT} SELECT tier, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM de GROUP BY 1")
def event_tier_profile(spark, folder):
    return detected(spark, folder).groupBy("tier").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))


@query(f"WITH {PLANTED}, {SENT} SELECT doc_id, count(*) AS n_rejected FROM sc WHERE {has(MICRO, 'sentence')} GROUP BY 1")
def micro_verb_antifilter(spark, folder):
    s = events.sentence_table(planted(spark, folder), ["doc_id"])
    return s.where(T.holds(F.col("sentence"), F.lower("sentence"), lexicon.MICRO_VERBS)).groupBy("doc_id").agg(F.count("*").alias("n_rejected"))


@query(f"{DETECT} SELECT 'E' || (row_number() OVER (ORDER BY doc_id, sentence_index, k) - 1) AS event_id, doc_id, sentence_index, event_type FROM de")
def event_numbering(spark, folder):
    return graph.number_events(detected(spark, folder), "doc_id", "sentence_index", "type_order").select("event_id", "doc_id", "sentence_index", "event_type")


R = r"[\p{L}\p{N}_]"
LEAD = "the|a|an|and|or|but|with|of|from|to|for|in|by|at"
CLEAN = lambda x: f"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '^{W}+|{W}+$', '', 'g'), '(?i)^(?:{LEAD})\\s+', ''), '(?i)\\s+(?:{LEAD})$', ''), '\\s+', ' ', 'g'))"
#: By type and role: what precedes, the participant, what follows.
ROLES = {
    "KILL": {"patient": (r"(?:killed|slew|slain)\s+", rf"[a-z]+(?:\s+(?:of|the)\s+{R}+)*", r"(?:\s|,|\.|$)")},
    "COMMAND": {"agent": (r"(?:, )?", rf"[a-z]+(?:\s+{R}+)*", r"(?:\s+commanded|\s+ordered)"), "patient": (r"(?:commanded|ordered)\s+", rf"[a-z]+(?:\s+{R}+)*", r"(?:\s+(?:to|not)\s|\s|,|\.|$)")},
    "BATTLE": {"agent1": (r"(?:between|with)\s+", r"[a-z]+(?:\s+and\s+|,\s+)*", r"(?:\s+and|\s+,)"), "agent2": (r"(?:\s+and|\s+,)\s+", rf"[a-z]+(?:\s+{R}+)*", r"(?:\s|,|\.|$)")},
    "VOW": {"agent": (r"(?:, )?", rf"[a-z]+(?:\s+{R}+)*", r"(?:\s+vowed|\s+swore)")},
    "CURSE": {"agent": (r"(?:, )?", rf"[a-z]+(?:\s+{R}+)*", r"(?:\s+cursed)"), "patient": (r"(?:cursed)\s+", rf"[a-z]+(?:\s+{R}+)*", r"(?:\s|,|\.|$)")},
    "BOON": {"agent": (r"(?:, )?", rf"[a-z]+(?:\s+{R}+)*", r"(?:\s+granted)"), "recipient": (r"(?:granted)\s+(?:to\s+)?", rf"[a-z]+(?:\s+{R}+)*", r"(?:\s|,|\.|$)")},
    "DEATH": {"agent": (r"(?:, )?", rf"[a-z]+(?:\s+{R}+)*", r"(?:\s+died|\s+perished)")},
}
ARGS = lambda roles: "[]" if not roles else " || ".join(f"list_transform(regexp_extract_all(sentence, '(?i)(?:{a})({e})(?:{z})', 1), lambda x: {{'role': '{r}', 'text': {CLEAN('x')}}})" for r, (a, e, z) in roles.items())
OWN = "CASE event_type " + " ".join(f"WHEN '{t}' THEN {ARGS(r)}" for t, r in ROLES.items()) + " ELSE [] END"
CAPS = r"list_transform(regexp_extract_all(sentence, '(\p{Lu}\p{L}+(?:\s+(?:of\s+)?\p{Lu}\p{L}+){0,30})', 1), lambda x, i: {'role': CASE WHEN i = 1 THEN 'agent' ELSE 'group' END, 'text': " + CLEAN("x") + "})"
WORDS_OF = lambda t: f"string_split(lower({t}), ' ')"
COMMONS = "['the','a','an','and','or','but','in','on','at','to','from','for','of','with','by','as','is','was','are','were','been','be','have','has','had','do','does','did','will','would','could','should','may','might','can','must','shall']"
FITS = f"""length(x.text) >= 2 AND lower(x.text) NOT IN ('thou','thee','thy','him','her','they','them','his','hers','their','who','whom','whose','he','she','it','we','you','i','me','my') AND len({WORDS_OF('x.text')}) <= 4
 AND NOT regexp_matches(lower(x.text), 'having|being|the presence|the act of|in order to|which is|that is|as well as') AND NOT (x.text = lower(x.text) AND len({WORDS_OF('x.text')}) > 1 AND len(list_filter({WORDS_OF('x.text')}, lambda w: NOT list_contains({COMMONS}, w))) = 0)
 AND NOT regexp_matches(replace(x.text, ' ', ''), '^[0-9]+$') AND regexp_matches(x.text, '[\\p{{L}}\\p{{N}}]') AND NOT regexp_matches(lower(x.text), '\\.htm|http|www|\\.com') AND len(list_filter({WORDS_OF('x.text')}, lambda w: w NOT IN ('the','of','in','on','at','to','from','for','by','with'))) > 0"""
EXTRACT = f"{DETECT}, ow AS (SELECT *, list_filter({OWN}, lambda x: {FITS}) AS own FROM de), al AS (SELECT *, CASE WHEN len(own) < 3 THEN own || list_filter({CAPS}, lambda x: {FITS}) ELSE own END AS every FROM ow), ar AS (SELECT *, list_filter(every, lambda x, i: list_position(list_transform(every, lambda y: lower(y.text) || '|' || y.role), lower(x.text) || '|' || x.role) = i) AS args FROM al)"


def shown(args):
    return F.array_join(F.transform(args, lambda x: F.concat(x["role"], F.lit(":"), x["text"])), ", ")


@query(f"{EXTRACT} SELECT doc_id, sentence_index, event_type, array_to_string(list_transform(args, lambda x: x.role || ':' || x.text), ', ') AS arguments FROM ar")
def event_arguments(spark, folder):
    """Arguments by role patterns and names: filtered, each once."""
    return events.extract(detected(spark, folder)).select("doc_id", "sentence_index", "event_type", shown(F.col("arguments")).alias("arguments"))


@query(f"{EXTRACT}, o AS (SELECT doc_id, sentence_index, event_type, unnest(args) AS a, sentence FROM ar) SELECT doc_id, sentence_index, event_type, a.role AS role, true AS found FROM o WHERE a.role IN ('patient', 'recipient')")
def argument_offsets(spark, folder):
    """Arguments after a verb stand in the sentence where their offsets say."""
    a = events.extract(detected(spark, folder)).select("doc_id", "sentence_index", "event_type", "sentence", F.explode("arguments").alias("a")).where("a.role in ('patient', 'recipient')")
    return a.select("doc_id", "sentence_index", "event_type", "a.role", (T.entity_clean(F.expr("substring(sentence, a.start + 1, a.end - a.start)")) == F.col("a.text")).alias("found"))


PLACES = ("kurukshetra", "matsya", "panchala", "anga")
TACTICAL = "attack|assail|assault|strike|charged|fell upon|made war|defend|shield|protect|hold the line|stood fast|pursue|chase|hunt|follow|retreat|withdrew|fled|fell back|turned back|surround|hemmed in|closed in|arrayed|formed array|entered the ranks|support|reinforce|succour|cover the retreat"
GATED = f"""{EXTRACT}, ac AS (SELECT *, len(list_distinct(list_filter(list_transform(args, lambda x: lower(x.text)), lambda t: t NOT IN ('kurukshetra', 'matsya', 'panchala', 'anga')))) AS actors, len(list_distinct(list_filter(list_transform(args, lambda x: lower(x.text)), lambda t: t IN ('kurukshetra', 'matsya', 'panchala', 'anga')))) AS places FROM ar),
 po AS (SELECT *, (actors >= 2 OR (actors >= 1 AND places >= 1)) AS many FROM ac), ga AS (SELECT *, many::INT + {has(TACTICAL, 'sentence')}::INT + (places >= 1)::INT - (len(string_split(sentence, ' ')) < 8)::INT AS confidence FROM po),
 st AS (SELECT *, CASE WHEN tier <> 'MESO' OR (many AND confidence >= 2) THEN args ELSE [] END AS kept FROM ga)"""


def gated(spark, folder):
    return events.meso_gate(events.extract(detected(spark, folder)), PLACES)


@query(f"{GATED} SELECT doc_id, sentence_index, event_type, tier, confidence::INT AS confidence, len(kept)::INT AS n_arguments FROM st")
def meso_gate(spark, folder):
    return gated(spark, folder).select("doc_id", "sentence_index", "event_type", "tier", "confidence", F.size("arguments").alias("n_arguments"))


@query(f"{GATED} SELECT event_type, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM st WHERE len(kept) >= 1 GROUP BY 1")
def event_admission(spark, folder):
    return events.admitted(gated(spark, folder)).groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))


# entities

NORMAL = "trim(regexp_replace(regexp_replace(lower(t), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g'))"
SAME = "(VALUES ('partha', 'arjuna'), ('dhananjaya', 'arjuna'), ('vibhatsu', 'arjuna'), ('kiritin', 'arjuna'), ('phalguna', 'arjuna'), ('bhimasena', 'bhima'), ('vrikodara', 'bhima'), ('dharma', 'yudhishthira'), ('suyodhana', 'duryodhana'), ('keshava', 'krishna'), ('vasudeva', 'krishna'), ('janardana', 'krishna'), ('madhava', 'krishna'), ('achyuta', 'krishna'), ('radheya', 'karna'), ('vasusena', 'karna'), ('panchali', 'draupadi'), ('pritha', 'kunti')) AS s(alias, name)"
RESOLVED = f"""x AS (SELECT c_custkey AS k, {S.picked(S.TEXTS + S.NAMES, 'c_custkey')} AS t FROM customer), n AS (SELECT k, t, {NORMAL} AS n FROM x), r AS (SELECT k, t, n, coalesce(name, n) AS canonical, CASE WHEN regexp_matches(n, 'krishna|arjuna|bhima|drona|karna|yudhishthira|duryodhana|bhishma|draupadi') THEN 'PERSON'
 WHEN regexp_matches(n, 'pandava|kaurava|warrior|army|clan|tribe|race|kingdom') THEN 'GROUP' WHEN regexp_matches(n, 'kurukshetra|india|hastinapura|indraprastha|forest|city|kingdom|palace|land') THEN 'PLACE' WHEN regexp_matches(n, 'morning|evening|night|day|year|age') THEN 'TIME' ELSE 'PERSON' END AS type,
 length(t) BETWEEN 2 AND 50 AND n NOT IN ('he','she','it','they','them','his','her','its','their','thou','thee','thy','him','whom','whose','hers','i','me','my','we','us','our','you','your') AND NOT regexp_matches(n, '^[0-9]+$') AND NOT regexp_matches(n, 'http|www')
 AND n NOT IN ('one','two','three','many','some','other','all','the','a','an','and','or','but','with','to','in','on','at','from','for','by','of','as') AND NOT regexp_matches(n, '^(having|being|doing|making) ') AND NOT (contains(n, ' ') AND len(list_filter(string_split(n, ' '), lambda w: w NOT IN ('the','a','an','and','or','but','in','on','at','to','from','for','of','with','by'))) = 0) AS admitted FROM n LEFT JOIN {SAME} ON n = alias)"""


def mentions(spark, folder):
    k = F.col("c_custkey")
    return table(spark, folder, "customer").select(k.alias("k"), S.pick(S.TEXTS + S.NAMES, k).alias("text"))


@query(f"WITH {RESOLVED} SELECT k, admitted, canonical, type, regexp_replace(lower(type || '_' || canonical), '[^a-z0-9_]', '_', 'g') AS entity_id FROM r")
def entity_resolution(spark, folder):
    """Planted names: whether they are admitted, their name, type and id."""
    named = graph.resolve_aliases(mentions(spark, folder), graph.alias_table(spark))
    typed = named.withColumn("type", graph.infer_type(T.name_normalize(F.col("text"))))
    return typed.select("k", graph.admissible_entity(F.col("text")).alias("admitted"), "canonical", "type", graph.entity_id(F.col("type"), F.col("canonical")).alias("entity_id"))


@query(f"WITH {RESOLVED} SELECT 'E' || (k // 3) AS event_id, (k % 3)::INT AS pos, regexp_replace(lower(type || '_' || canonical), '[^a-z0-9_]', '_', 'g') AS entity_id FROM r WHERE admitted")
def event_participants(spark, folder):
    """Three names an event, of which those that are admitted take part, in order."""
    e = mentions(spark, folder).groupBy(F.concat(F.lit("E"), F.floor(F.col("k") / 3)).alias("event_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "text"))), lambda x: F.struct(F.lit("agent").alias("role"), x["text"].alias("text"))).alias("arguments"))
    return graph.admit(e.withColumn("event_type", F.lit("KILL")).withColumn("chunk_id", F.lit("c")), graph.alias_table(spark)).select("event_id", "pos", "entity_id")


# answers

ROLE = f"""WITH {KG}, m AS (SELECT DISTINCT qid, event_id FROM plans JOIN edges ON source_id = seed), pe AS (SELECT qid, arg.event_id, entity_id, min((line, pk)) AS k FROM m JOIN arg USING (event_id) GROUP BY 1, 2, 3),
 rk AS (SELECT qid, event_id, entity_id, row_number() OVER (PARTITION BY qid, event_id ORDER BY k) AS r, count(*) OVER (PARTITION BY qid, event_id) AS n FROM pe),
 ro AS (SELECT qid, rk.event_id, ordinal, type, entity_id, CASE WHEN rk.n = 1 AND type IN ('DEATH', 'RETREATED') THEN 'PATIENT' WHEN r = 1 THEN 'AGENT' WHEN r = 2 THEN 'PATIENT' END AS role FROM rk JOIN ev USING (event_id) WHERE r <= 2),
 ec AS (SELECT entity_id, count(DISTINCT event_id) AS event_count FROM arg GROUP BY 1)"""


def people(kg):
    """All entities as persons, so that parts have roles too."""
    return kg.entities.withColumn("type", F.lit("PERSON"))


def with_roles(spark, folder):
    """Roles in all events of the seeds."""
    kg = graph_of(spark, folder)
    matches, _ = storage.written(kgquery.fact(seeded(spark, folder, []), kg.edges, kg.events).select("qid", "event_id", "ordinal", "type", "participants"), "matches")
    return matches, storage.written(resolve.roles(matches, people(kg)), "roles")[0]


def seeds_of(spark, folder, order=None):
    return seeded(spark, folder, [], order=order).select("qid", "entity_id", "temporal_order")


@query(f"{ROLE} SELECT qid, event_id, entity_id, role FROM ro")
def resolve_roles(spark, folder):
    return with_roles(spark, folder)[1].select("qid", "event_id", "entity_id", "role")


@query(f"""{ROLE}, p AS (SELECT DISTINCT qid, event_id FROM ro WHERE role = 'PATIENT'), f AS (SELECT qid, entity_id, count(DISTINCT event_id) AS frequency FROM ro JOIN p USING (qid, event_id) WHERE role = 'AGENT' AND type IN ('KILL', 'BATTLE') GROUP BY 1, 2)
 SELECT qid, entity_id, frequency, rank FROM (SELECT qid, entity_id, frequency, row_number() OVER (PARTITION BY qid ORDER BY frequency DESC, event_count DESC, entity_id)::INT AS rank FROM f JOIN ec USING (entity_id)) WHERE rank <= 2""")
def resolve_fact_rank(spark, folder):
    _, r = with_roles(spark, folder)
    wanted = table(spark, folder, "customer").select(F.col("c_custkey").alias("qid"), F.explode(F.array(F.lit("KILL"), F.lit("BATTLE"))).alias("type"), F.lit(True).alias("agent_required"))
    return resolve.fact(r, wanted)


# the seed is the first to take part, so an anchor is a death that it took part in alone or second; parts stand second
ANCHORED = f"""{ROLE}, se AS (SELECT qid, min(entity_id) AS victim, CASE qid % 3 WHEN 0 THEN 'AFTER' WHEN 1 THEN 'BEFORE' ELSE 'DURING' END AS ord FROM ro WHERE type = 'DEATH' AND role = 'PATIENT' GROUP BY 1), an AS (SELECT ro.qid, max(ordinal) AS anchor FROM ro JOIN se ON se.qid = ro.qid AND victim = entity_id WHERE type = 'DEATH' AND role = 'PATIENT' GROUP BY 1),
 t AS (SELECT m.qid, event_id, ordinal, ord, row_number() OVER (PARTITION BY m.qid ORDER BY CASE WHEN ord = 'BEFORE' THEN -ordinal ELSE ordinal END)::INT AS rank FROM m JOIN ev USING (event_id) JOIN se ON se.qid = m.qid LEFT JOIN an ON an.qid = m.qid WHERE ord = 'DURING' OR (ord = 'AFTER' AND ordinal > anchor) OR (ord = 'BEFORE' AND ordinal < anchor))"""


def victims(roles):
    """The first patient (by id) of a death in each question's events, and the order that is asked for."""
    order = F.when(F.col("qid") % 3 == 0, "AFTER").when(F.col("qid") % 3 == 1, "BEFORE").otherwise("DURING")
    return roles.where("type = 'DEATH' and role = 'PATIENT'").groupBy("qid").agg(F.min("entity_id").alias("entity_id")).withColumn("temporal_order", order)


@query(f"{ANCHORED} SELECT qid, event_id, rank FROM t WHERE rank <= 5")
def resolve_temporal_top5(spark, folder):
    """Events after, before or during, by the death of a question's victim."""
    matches, r = with_roles(spark, folder)
    return resolve.temporal(matches, r, victims(r)).select("qid", "event_id", "rank")


MULTI = ROLE + """, m2 AS (SELECT qid, max(entity_id) AS victim FROM ro WHERE type IN ('DEATH', 'KILL') AND role = 'PATIENT' GROUP BY 1), f AS (SELECT DISTINCT ro.qid, event_id FROM ro JOIN m2 USING (qid) WHERE type IN ('DEATH', 'KILL') AND role = 'PATIENT' AND ro.entity_id = m2.victim), pp AS (SELECT DISTINCT qid, entity_id FROM ro JOIN f USING (qid, event_id)),
 g AS (SELECT * FROM ro WHERE type = 'SUPPORTED'), nr AS (SELECT DISTINCT g.qid, g.event_id FROM g JOIN pp ON pp.qid = g.qid AND pp.entity_id = g.entity_id),
 c AS (SELECT g.qid, g.entity_id, count(DISTINCT g.event_id) AS frequency FROM g JOIN nr ON nr.qid = g.qid AND nr.event_id = g.event_id ANTI JOIN m2 ON m2.qid = g.qid AND victim = g.entity_id GROUP BY 1, 2)"""


@query(f"{MULTI} SELECT qid, entity_id, frequency, rank FROM (SELECT qid, entity_id, frequency, row_number() OVER (PARTITION BY qid ORDER BY frequency DESC, event_count DESC, entity_id)::INT AS rank FROM c JOIN ec USING (entity_id)) WHERE rank <= 5")
def resolve_multi_hop(spark, folder):
    """Who gained after the last patient (by name) of each question's events."""
    _, r = with_roles(spark, folder)
    last = r.where("type in ('DEATH', 'KILL') and role = 'PATIENT'").groupBy("qid").agg(F.max("entity_id").alias("entity_id"))
    return resolve.multi_hop(r, last)


CHAIN = ROLE + """, a AS (SELECT ro.* FROM ro JOIN plans ON plans.qid = ro.qid AND seed = entity_id WHERE role = 'AGENT'), w AS (SELECT *, max(CASE WHEN type = 'VOW' THEN ordinal END) OVER (PARTITION BY qid, entity_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cause FROM a),
 e AS (SELECT * FROM w WHERE type = 'SUPPORTED' AND cause IS NOT NULL QUALIFY row_number() OVER (PARTITION BY qid ORDER BY ordinal DESC) = 1)"""


@query(f"{CHAIN} SELECT qid, entity_id AS agent, 'E' || cause AS cause_event, event_id AS effect_event FROM e")
def resolve_causal_chain(spark, folder):
    _, r = with_roles(spark, folder)
    return resolve.causal(r, seeds_of(spark, folder))


@query("SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 1 AND c_custkey % 3 <> 0 THEN 'high' WHEN c_custkey % 4 >= 1 THEN 'medium' ELSE 'low' END AS confidence FROM customer")
def answer_confidence(spark, folder):
    k = F.col("c_custkey")
    return table(spark, folder, "customer").select(k.alias("k"), resolve.confidence(k % 4, k % 3 == 0).alias("confidence"))


@query(f"""{CHAIN}, asked AS (SELECT qid, CASE qid % 6 WHEN 0 THEN 'FACT' WHEN 1 THEN 'MULTI_HOP' WHEN 2 THEN 'CAUSAL' WHEN 3 THEN 'TEMPORAL' WHEN 4 THEN 'TEMPORAL' ELSE 'OTHER' END AS intent FROM plans), ok AS (SELECT qid FROM plans WHERE qid % 31 <> 0),
 fa AS (SELECT qid, entity_id, count(DISTINCT event_id) AS frequency FROM ro JOIN ok USING (qid) WHERE role = 'AGENT' AND type IN ('KILL', 'DEATH') AND qid % 6 = 0 GROUP BY 1, 2),
 fr AS (SELECT qid, 'ENTITY' AS answer_type, row_number() OVER (PARTITION BY qid ORDER BY frequency DESC, event_count DESC, entity_id)::INT AS rank, entity_id, NULL AS event_id, NULL AS chain FROM fa JOIN ec USING (entity_id) QUALIFY rank <= 2),
 te AS (SELECT m.qid, 'EVENT_LIST', row_number() OVER (PARTITION BY m.qid ORDER BY ordinal)::INT AS rank, NULL, event_id, NULL FROM m JOIN ok USING (qid) JOIN ev USING (event_id) WHERE m.qid % 6 IN (3, 4) QUALIFY rank <= 5),
 ca AS (SELECT e.qid, 'CHAIN', 1, NULL, NULL, e.entity_id || ',E' || cause || coalesce(',' || p.entity_id, '') || ',' || e.event_id FROM e JOIN ok USING (qid) LEFT JOIN ro p ON p.qid = e.qid AND p.event_id = e.event_id AND p.role = 'PATIENT' WHERE e.qid % 6 = 2),
 every AS (SELECT * FROM fr UNION ALL SELECT * FROM te UNION ALL SELECT * FROM ca), n AS (SELECT qid, count(*) AS n FROM every GROUP BY 1) SELECT qid, intent, answer_type, rank, entity_id, event_id, chain, CASE WHEN n = 1 AND intent = 'FACT' THEN 'high' ELSE 'medium' END AS confidence FROM every JOIN n USING (qid) JOIN asked USING (qid)
 UNION ALL SELECT qid, intent, 'NO_ANSWER', NULL, NULL, NULL, NULL, 'high' FROM asked ANTI JOIN n USING (qid)""")
def answer_dispatch(spark, folder):
    """Answers by intent over all events of a question's customer: entities, event lists, chains, and none."""
    kg = graph_of(spark, folder)
    asked = mixed(spark, folder)
    seeds, _ = storage.written(kgquery.resolve_seeds(asked, kg.aliases).select("qid", "entity_id"), "seeds")
    matches, _ = storage.written(kgquery.touching(seeds, kg.edges).select("qid", "event_id").distinct().join(kg.events.select("event_id", "ordinal", "type", "participants"), "event_id"), "matches")
    out = resolve.answers(asked.drop("seeds"), seeds, matches, people(kg))
    return out.select("qid", "intent", "answer_type", "rank", "entity_id", "event_id", F.array_join("chain", ",").alias("chain"), "confidence")
