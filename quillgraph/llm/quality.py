"""Quality rules (9): adaptive thresholds from mergeable quantile sketches per language and source.

Base rules reject a text of fewer than ten words, or one of whose words over a fifth lie in
repeated five-word windows. Beyond that nothing is a fixed cutoff: rates of each text are
counted into logarithmic buckets (relative error ``ERROR``) by language and source. Such a
sketch is a set of (bucket, count) rows, so sketches merge by adding counts: partial sums on the
map side, a language's sketch from those of its sources, today's with yesterday's. A fence lies
three interquartile ranges beyond its quartile, or at the group's outer tenth if that is further
out: rates that are zero for most texts have no quartiles to speak of. Beyond the sketch's own
error nothing is added. A text is judged by its count less the standard error of a count (its
root), so that one occurrence in a short text is no evidence. A source's sketch is merged with
``PRIOR`` texts that stand for its language, a language's with ``PRIOR`` that stand for all: the
fewer texts a group has, the more its fences are those of the level above, with no switch at
any size. Documents are joined to the fences of their group.

Null and empty texts have no words and fail the base rules. A null language or source is a
group of its own. Ties and repeated rows count as often as they occur. An empty table gives an
empty result. Extra columns pass through ``quality_filter`` unchanged, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .base import bounded_batches, fresh, written

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")
KIND = pa.struct([(c, pa.int64()) for c in COUNTS])
DDL = "struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ">"
REPEAT_WIDTH = 5

#: Relative error of a sketch's quantiles, and the value under which rates count as zero.
ERROR, LEAST = 0.01, 1e-4
#: Rate: (numerator, denominator, sides that are fenced).
RATES = {
    "symbol_rate": ("n_symbols", "n_words", "upper"),
    "dup_line_rate": ("n_dup_lines", "n_lines", "upper"),
    "upper_rate": ("n_upper", "word_chars", "upper"),
    "word_length": ("word_chars", "n_words", "both"),
}
SPREAD, TAIL = 3.0, 0.1
PRIOR = 50  # texts by which the level above weighs in a group's sketch
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
GAPS = " \t\n\x0b\x0c\r"


def _sum_by_doc(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _lines(text: str) -> tuple[int, int]:
    lines = [x for x in text.split("\n") if x.strip(GAPS)]
    return len(lines), len(lines) - len(set(lines))


def _repeated(counts: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Words by document that lie in a window found twice or more in it."""
    doc, start = K.whole_windows(counts, REPEAT_WIDTH)
    if not len(doc):
        return np.zeros(len(counts), np.int64)
    window = K.window_hashes(hashes, REPEAT_WIDTH)[start] ^ K.mix(doc.astype(np.uint64) + np.uint64(1))
    order = np.argsort(window, kind="stable")
    ordered = window[order]
    same = ordered[1:] == ordered[:-1]
    twice = np.zeros(len(window), bool)
    twice[1:] |= same
    twice[:-1] |= same
    inside = K.covered(start[order[twice]], REPEAT_WIDTH, len(hashes))
    return _sum_by_doc(inside, np.concatenate(([0], np.cumsum(counts))))


def count_features(texts: pa.Array) -> pa.Array:
    K.kept("quality")
    parts: list[list[np.ndarray]] = []
    for _, _, buf, offsets in K.groups(texts):
        counts, (hashes,) = K.word_hashes(buf, offsets)
        lines = np.array([_lines(buf[a:b].tobytes().decode("utf-8", "surrogatepass")) for a, b in zip(offsets[:-1], offsets[1:])]).reshape(-1, 2)
        chars = K.SPACED[buf] & ((buf & 0xC0) != 0x80)
        upper = (buf >= 65) & (buf <= 90)
        parts.append([counts, _sum_by_doc(chars, offsets), _sum_by_doc(SYMBOLS[buf], offsets), lines[:, 1], _repeated(counts, hashes), lines[:, 0], _sum_by_doc(upper, offsets)])
    columns = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0) for i in range(len(COUNTS))]
    return pa.StructArray.from_arrays([pa.array(c.astype(np.int64)) for c in columns], fields=list(KIND))


def features(text) -> F.Column:
    """Counts of a text as one struct column."""
    return F.arrow_udf(count_features, DDL).asNondeterministic()(F.coalesce(text, F.lit("")))


def base_failed(f) -> F.Column:
    return (f["n_words"] < 10) | (100 * f["n_repeat_words"] > 20 * f["n_words"])


def _rate(f, name: str, errors: int = 0) -> F.Column:
    over, under, _ = RATES[name]
    count = f[over] + errors * F.sqrt(f[over]) if errors else f[over]
    return count / F.greatest(f[under], F.lit(1))


def sketch(counted: DataFrame, f: str, lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, rate, bucket, n): bucket null for (nearly) zero. Merge sketches by summing n."""
    gamma = math.log((1 + ERROR) / (1 - ERROR))
    rates = F.explode(F.array(*[F.struct(F.lit(r).alias("rate"), _rate(F.col(f), r).alias("x")) for r in RATES]))
    bucket = F.when(F.col("r.x") >= LEAST, F.ceil(F.log("r.x") / gamma).cast("int"))
    kept = counted.where(~base_failed(F.col(f))).select(F.col(lang).alias("lang"), F.col(source).alias("source"), rates.alias("r"))
    return kept.groupBy("lang", "source", F.col("r.rate").alias("rate"), bucket.alias("bucket")).agg(F.count("*").alias("n"))


def merge_sketches(*sketches: DataFrame) -> DataFrame:
    out = sketches[0]
    for s in sketches[1:]:
        out = out.unionByName(s)
    return out.groupBy("lang", "source", "rate", "bucket").agg(F.sum("n").alias("n"))


def fences(sketches: DataFrame) -> DataFrame:
    """(level, lang, source, n_docs, <rate>_low, <rate>_high) for each source of a language, language and all.

    Levels: 2 a language's source, 1 a language, 0 all. ``sketches`` is read several times: a written table, as a rule.
    """
    gamma = math.log((1 + ERROR) / (1 - ERROR))
    keys = ["level", "lang", "source", "rate"]
    sizes = Window.partitionBy(*keys)
    order = sizes.orderBy(F.col("bucket").asc_nulls_first())
    ranking = lambda df: df.withColumn("seen", F.sum("n").over(order)).withColumn("all", F.sum("n").over(sizes))

    def level(k: int) -> DataFrame:
        lang, source = (F.col("lang") if k else F.lit(None).cast("string")), (F.col("source") if k == 2 else F.lit(None).cast("string"))
        return sketches.groupBy(F.lit(k).alias("level"), lang.alias("lang"), source.alias("source"), "rate", "bucket").agg(F.sum("n").alias("n"))

    def shrunk(own: DataFrame, above: DataFrame) -> DataFrame:
        """``own`` with PRIOR texts more in each group: those at evenly spaced ranks of the group's sketch in ``above``."""
        drawn = lambda seen: F.floor((2 * PRIOR * seen + F.col("all")) / (2 * F.col("all")))
        prior = ranking(above).withColumn("n", drawn(F.col("seen")) - drawn(F.col("seen") - F.col("n"))).where("n > 0")
        groups = own.select("level", "lang", "source").distinct()
        if above is every:
            prior = groups.join(F.broadcast(prior.select("rate", "bucket", "n")))
        else:
            prior = groups.join(prior.select(F.col("lang").alias("of"), "rate", "bucket", "n"), F.col("lang").eqNullSafe(F.col("of"))).drop("of")
        return own.withColumn("own", F.col("n")).unionByName(prior.withColumn("own", F.lit(0).cast("long"))).groupBy(*keys, "bucket").agg(F.sum("n").alias("n"), F.sum("own").alias("own"))

    every = level(0)
    langs = shrunk(level(1), every)
    merged = every.withColumn("own", F.col("n")).unionByName(langs).unionByName(shrunk(level(2), langs.drop("own")))
    ranked = ranking(merged)
    value = F.when(F.col("bucket").isNull(), 0.0).otherwise(F.exp(F.col("bucket") * gamma) * 2 / (1 + math.exp(gamma)))
    quantile = lambda q: F.min(F.when(F.col("seen") >= F.ceil(F.col("all") * q), value))
    found = ranked.groupBy(*keys).agg(F.sum("own").alias("n_docs"), *[quantile(q).alias(name) for name, q in (("least", TAIL), ("q1", 0.25), ("q3", 0.75), ("most", 1 - TAIL))])
    reach = SPREAD * (F.col("q3") - F.col("q1"))
    low = F.least(F.col("q1") - reach, F.col("least") * (1 - 2 * ERROR) - LEAST)
    high = F.greatest(F.col("q3") + reach, F.col("most") * (1 + 2 * ERROR) + LEAST)
    wide = found.groupBy("level", "lang", "source").pivot("rate", list(RATES)).agg(F.max(low).alias("low"), F.max(high).alias("high"), F.max("n_docs").alias("n"))
    return wide.withColumn("n_docs", F.greatest(*[F.coalesce(f"{r}_n", F.lit(0)) for r in RATES])).drop(*[f"{r}_n" for r in RATES])


MAX_BROADCAST_ROWS = 100_000
SALTS = 64


def judged(counted: DataFrame, f: str, limits: DataFrame, lang: str, source: str, out: str) -> DataFrame:
    """``counted`` with a boolean column ``out``: the verdict of the base rules and the group's fences.

    ``limits`` is a written table. Its one row for all texts becomes literals; the levels below are
    broadcast if they have at most MAX_BROADCAST_ROWS rows, else they are dealt out with salts, as one
    source may hold a third of the documents. Names that ``counted`` has are not used.
    """
    n = limits.count()
    edges = [c for c in limits.columns if c.endswith(("_low", "_high"))]
    whole = limits.where("level = 0").select(*edges).first()
    found = [F.struct(*[F.lit(whole[e] if whole else None).cast("double").alias(e) for e in edges])]
    joined = counted
    for k in (1, 2):
        name = {c: fresh(joined, f"__{c}{k}") for c in ("lang", "source", "edges", "salt")}
        mine = limits.where(f"level = {k}").select(F.col("lang").alias(name["lang"]), F.col("source").alias(name["source"]), F.struct(*edges).alias(name["edges"]))
        on = F.col(f"`{lang}`").eqNullSafe(F.col(name["lang"]))
        if k == 2:
            on = on & F.col(f"`{source}`").eqNullSafe(F.col(name["source"]))
        if n <= MAX_BROADCAST_ROWS:
            mine = F.broadcast(mine)
        else:
            mine = mine.withColumn(name["salt"], F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            on = on & (F.pmod(F.xxhash64(F.col(f)), F.lit(SALTS)) == F.col(name["salt"]))
        joined = joined.join(mine, on, "left")
        found.insert(0, F.col(name["edges"]))
    edge = F.coalesce(*found)
    ok = ~base_failed(F.col(f))
    for r, (_, _, sides) in RATES.items():
        ok = ok & F.coalesce(_rate(F.col(f), r, -1) <= edge[f"{r}_high"], F.lit(True))
        if sides == "both":
            ok = ok & F.coalesce(_rate(F.col(f), r, 1) >= edge[f"{r}_low"], F.lit(True))
    return joined.withColumn(out, ok).select(*[F.col(f"`{c}`") for c in counted.columns], out)


def quality_filter(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The documents that the rules keep, with their columns as they are.

    Texts are counted twice, once for the sketches and once beside the verdict: that costs less
    than to shuffle or store whole texts between the two.
    """
    bounded_batches(docs.sparkSession)
    f = fresh(docs, "__counts")
    v = fresh(docs, "__kept")
    counted = docs.withColumn(f, features(F.col(text)))
    buckets, _ = written(sketch(docs.select(lang, source, text).withColumn(f, features(F.col(text))), f, lang, source), "sketch")
    limits, _ = written(fences(buckets), "fences")
    return judged(counted, f, limits, lang, source, v).where(v).select(*[F.col(f"`{c}`") for c in docs.columns])


def quality_report(docs: DataFrame) -> DataFrame:
    """doc_id, counts, base_failed and kept of each document. Counts are written once: they are narrow."""
    bounded_batches(docs.sparkSession)
    counted, _ = written(docs.select("doc_id", "lang", "source", features(F.col("text")).alias("f")), "counts")
    buckets, _ = written(sketch(counted, "f"), "sketch")
    limits, _ = written(fences(buckets), "fences")
    out = judged(counted, "f", limits, "lang", "source", "kept")
    return out.select("doc_id", *[F.col(f"f.{c}").alias(c) for c in COUNTS[:5]], base_failed(F.col("f")).alias("base_failed"), "kept", *[_rate(F.col("f"), r).alias(r) for r in RATES])
