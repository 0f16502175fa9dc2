"""DuckDB statements for the registered queries that SQL can express: written from the contracts, not from the operators."""

from __future__ import annotations

#: [^\x20\x09-\x0D]+ of whole texts, and A-Z lower-cased
SPACED = r"regexp_extract_all(coalesce({0}, ''), '[^ \t\n\x0B\f\r]+')"
LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
LETTERS = r"regexp_extract_all(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')"

OP4 = f"""
WITH b AS (SELECT item_id::VARCHAR AS item, {LETTERS.format('text')} AS w FROM benchmark),
p AS (SELECT DISTINCT item, least(13, len(w)) AS m, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS key
  FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, {LETTERS.format('text')} AS w FROM documents),
x AS (SELECT doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS key
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM p) WHERE len(w) >= m)),
h AS (SELECT doc_id, x.m, i, item FROM x JOIN p ON p.m = x.m AND p.key = x.key),
hit AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM h) GROUP BY 1),
it AS (SELECT doc_id, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(it.n, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""

OP7 = f"""
WITH d AS (SELECT doc_id, {SPACED.format('text')} AS w FROM documents),
x AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS key FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
f AS (SELECT key, min(doc_id) AS first FROM x GROUP BY 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k FROM x JOIN f USING (key) WHERE doc_id > first),
o AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM d),
s AS (SELECT o.doc_id, string_agg(word, ' ' ORDER BY o.k) AS kept FROM o ANTI JOIN c ON c.doc_id = o.doc_id AND c.k = o.k GROUP BY 1),
r AS (SELECT doc_id, count(*) AS n FROM c GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN s USING (doc_id) LEFT JOIN r USING (doc_id)
"""

OP9 = f"""
WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, {SPACED.format('text')} AS w FROM documents),
ln AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM t) WHERE regexp_matches(l, '[^ \\t\\n\\x0B\\f\\r]') GROUP BY 1),
v AS (SELECT doc_id, i, array_to_string(w[i : i + 4], ' ') AS key FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM t WHERE len(w) >= 5)),
rp AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS k FROM v JOIN (SELECT doc_id, key FROM v GROUP BY 1, 2 HAVING count(*) > 1) USING (doc_id, key)) GROUP BY 1),
f AS (SELECT t.doc_id, lang, source, len(w)::BIGINT AS n_words, list_sum(list_transform(w, lambda x: length(x)))::BIGINT AS chars, (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
  coalesce(n_dup, 0)::BIGINT AS n_dup, coalesce(rp.n, 0)::BIGINT AS n_rep, coalesce(n_lines, 0)::BIGINT AS n_lines, (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')))::BIGINT AS n_upper
  FROM t LEFT JOIN ln ON ln.doc_id = t.doc_id LEFT JOIN rp ON rp.doc_id = t.doc_id),
g AS (SELECT *, coalesce(chars, 0) AS word_chars, n_words < 10 OR 100 * n_rep > 20 * n_words AS failed FROM f),
-- counts above and below each rate
rt AS (SELECT doc_id, lang, source, failed, rate, over, greatest(under, 1)::DOUBLE AS under, both_ FROM g, LATERAL (VALUES ('symbol_rate', n_symbols, n_words, false), ('dup_line_rate', n_dup, n_lines, false), ('upper_rate', n_upper, word_chars, false), ('word_length', word_chars, n_words, true)) AS r(rate, over, under, both_)),
sk AS (SELECT lang, source, rate, CASE WHEN over / under >= 0.0001 THEN ceil(ln(over / under) / ln(1.01 / 0.99))::INT END AS bucket, count(*) AS n FROM rt WHERE NOT failed GROUP BY ALL),
l0 AS (SELECT rate, bucket, sum(n) AS n FROM sk GROUP BY ALL), l1 AS (SELECT lang, rate, bucket, sum(n) AS n FROM sk GROUP BY ALL),
r0 AS (SELECT *, sum(n) OVER (PARTITION BY rate ORDER BY bucket NULLS FIRST) AS seen, sum(n) OVER (PARTITION BY rate) AS total FROM l0),
-- fifty texts that stand for all texts, at even ranks
d0 AS (SELECT rate, bucket, floor((100 * seen + total) / (2 * total)) - floor((100 * (seen - n) + total) / (2 * total)) AS n FROM r0),
m1 AS (SELECT lang, rate, bucket, sum(n) AS n FROM (SELECT lang, rate, bucket, n FROM l1 UNION ALL SELECT k.lang, d0.rate, d0.bucket, d0.n FROM (SELECT DISTINCT lang FROM l1) k, d0 WHERE d0.n > 0) GROUP BY ALL),
r1 AS (SELECT *, sum(n) OVER (PARTITION BY lang, rate ORDER BY bucket NULLS FIRST) AS seen, sum(n) OVER (PARTITION BY lang, rate) AS total FROM m1),
d1 AS (SELECT lang, rate, bucket, floor((100 * seen + total) / (2 * total)) - floor((100 * (seen - n) + total) / (2 * total)) AS n FROM r1),
m2 AS (SELECT lang, source, rate, bucket, sum(n) AS n FROM (SELECT lang, source, rate, bucket, n FROM sk UNION ALL SELECT k.lang, k.source, d1.rate, d1.bucket, d1.n FROM (SELECT DISTINCT lang, source FROM sk) k JOIN d1 ON d1.lang IS NOT DISTINCT FROM k.lang WHERE d1.n > 0) GROUP BY ALL),
al AS (SELECT 0 AS level, NULL AS lang, NULL AS source, rate, bucket, n FROM l0 UNION ALL SELECT 1, lang, NULL, rate, bucket, n FROM m1 UNION ALL SELECT 2, lang, source, rate, bucket, n FROM m2),
rk AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, rate ORDER BY bucket NULLS FIRST) AS seen, sum(n) OVER (PARTITION BY level, lang, source, rate) AS total,
  CASE WHEN bucket IS NULL THEN 0.0 ELSE exp(bucket * ln(1.01 / 0.99)) * 2 / (1 + 1.01 / 0.99) END AS x FROM al),
q AS (SELECT level, lang, source, rate, min(x) FILTER (seen >= ceil(total * 0.1)) AS least, min(x) FILTER (seen >= ceil(total * 0.25)) AS q1, min(x) FILTER (seen >= ceil(total * 0.75)) AS q3, min(x) FILTER (seen >= ceil(total * 0.9)) AS most FROM rk GROUP BY ALL),
fe AS (SELECT level, lang, source, rate, least(q1 - 3 * (q3 - q1), least * 0.98 - 0.0001) AS low, greatest(q3 + 3 * (q3 - q1), most * 1.02 + 0.0001) AS high FROM q),
lv AS (SELECT rt.*, CASE WHEN EXISTS (SELECT 1 FROM (SELECT DISTINCT lang, source FROM sk) k WHERE k.lang IS NOT DISTINCT FROM rt.lang AND k.source IS NOT DISTINCT FROM rt.source) THEN 2 WHEN EXISTS (SELECT 1 FROM (SELECT DISTINCT lang FROM sk) k WHERE k.lang IS NOT DISTINCT FROM rt.lang) THEN 1 ELSE 0 END AS level FROM rt),
ok AS (SELECT doc_id, bool_and(coalesce((over - sqrt(over)) / under <= high, true) AND (NOT both_ OR coalesce((over + sqrt(over)) / under >= low, true))) AS ok
  FROM lv LEFT JOIN fe ON fe.level = lv.level AND fe.rate = lv.rate AND (lv.level = 0 OR fe.lang IS NOT DISTINCT FROM lv.lang) AND (lv.level < 2 OR fe.source IS NOT DISTINCT FROM lv.source) GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup AS n_dup_lines, n_rep AS n_repeat_words, failed AS base_failed, NOT failed AND ok AS kept FROM g JOIN ok USING (doc_id)
"""

OP10 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {SPACED.format(LOWER.format('text'))} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, key FROM (SELECT doc_id, array_to_string(w[i : i + 4], ' ') AS key FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM d WHERE len(w) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS both_ FROM s a JOIN s b ON a.key = b.key AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT u, v FROM p JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * both_ >= 75 * (a.n + b.n - both_)),
g AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
r AS (SELECT doc_id AS u, doc_id AS v FROM d UNION SELECT r.u, g.v FROM r JOIN g ON g.u = r.v),
c AS (SELECT u, min(v) AS root FROM r GROUP BY 1)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, root AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN c ON c.u = doc_id
"""
