"""URL filters (1): rules first, then a character language-model ratio.

Two variable-order Markov models of a URL's characters, one of accepted and one of rejected URLs,
are counted over all URLs that rules accept or reject: for each character, its contexts of
``ORDERS`` characters before it, each (context, character) by itself. Probabilities are
smoothed from short contexts to long ones (Witten-Bell). A URL's score is the difference of its
log-likelihoods under both models, divided by its length. The threshold is calibrated on URLs
that were kept out of the counts: the score that ``PASS`` of the accepted ones don't exceed.

Counts are a distributed table that grows with the contexts there are: a partial sum for each
batch of URLs, then a sum by (context, character). It is sent out whole if it has at most
``MAX_PAIRS`` rows. Else it is dealt into shards by the character before, which all contexts of a
character share, and scores are summed shard by shard: the result is the same.

A null URL, or one without ``://``, has an empty host and path; no rule fits it, and it is
scored as it is (null as an empty text, score 0). Without accepted or without rejected URLs
everything that no rule judges is allowed. Ties and repeated rows are judged alike. Extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .base import written

#: Rules: (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
ORDERS = (0, 1, 2, 3, 4)
MAX_PAIRS = 4_000_000  # rows of counts that are sent out at once: about 30 bytes each
PASS = 0.99
FOLD = 5  # one URL in so many is kept out of the counts, for the threshold
BLOCK = 50_000


def split_url(url) -> tuple[F.Column, F.Column]:
    """Host and path columns of a URL column."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    authority = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    host = F.translate(authority, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_for(host, path, rules=RULES) -> F.Column:
    """The longest fitting rule as (size, rule, verdict), null where none fits. At equal length the first."""
    fits = []
    for k, (verdict, name, start) in enumerate(rules):
        ok = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        fits.append(F.when(ok, F.struct(F.lit(len(name + start)).alias("size"), F.lit(-k).alias("first"), F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_max(F.filter(F.array(*fits), lambda x: x.isNotNull()))


def contexts(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
    """By group of URLs: lengths, the document of each byte, and by order the keys of (context, byte) and of the context.

    A context has nine bits for each byte, the last byte lowest, so keys of up to five bytes are exact.
    """
    for _, _, buf, offsets in K.groups(column):
        lengths = np.diff(offsets)
        doc = np.repeat(np.arange(len(lengths)), lengths)
        within = np.arange(len(buf)) - np.repeat(offsets[:-1], lengths)
        context = np.zeros(len(buf), np.int64)
        out = []
        for order in range(max(ORDERS) + 1):
            if order:
                before = np.zeros(len(buf), np.int64)
                before[order:] = buf[:-order]
                before += 2
                before[within < order] = 1  # the start of the URL
                context = context | before << 9 * (order - 1)
            if order in ORDERS:
                out.append((context << 8 | buf, context))
        yield lengths, doc, out


#: Occurrences n of a key (context, byte) of the order ``tab``.
PAIR_DDL = "class int, tab int, slot long, n long"


def counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class, url) to counts by key of each batch; class 0 rejected, 1 accepted."""
    for batch in batches:
        kinds = batch.column(0).to_numpy(zero_copy_only=False)
        at = 0
        held: dict[tuple[int, int], np.ndarray] = {}
        for lengths, doc, slots in contexts(batch.column(1)):
            of = kinds[at : at + len(lengths)][doc]
            at += len(lengths)
            for k, (pair, _) in enumerate(slots):
                for kind in (0, 1):
                    values, n = np.unique(pair[of == kind], return_counts=True)
                    old = held.get((kind, k))
                    if old is not None:
                        values, inverse = np.unique(np.concatenate((old[0], values)), return_inverse=True)
                        n = np.bincount(inverse, np.concatenate((old[1], n))).astype(np.int64)
                    held[kind, k] = np.stack((values, n))
        for (kind, k), (values, n) in held.items():
            m = len(values)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m, kind, np.int32)), pa.array(np.full(m, k, np.int32)), pa.array(values), pa.array(n)], names=["class", "tab", "slot", "n"])


def _looked_up(keys: np.ndarray, sought: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """The values of each sought key, 0 where it is not among the sorted keys."""
    if not len(keys):
        return [np.zeros(len(sought)) for _ in values]
    at = np.minimum(np.searchsorted(keys, sought), len(keys) - 1)
    return [np.where(keys[at] == sought, v[at], 0) for v in values]


class UrlModel:
    """Two smoothed models. tables[class, order]: sorted keys and their n; sorted contexts, their n and their different bytes.

    ``part`` of ``parts``: the model has only contexts whose last byte is dealt to it, and scores those bytes.
    """

    def __init__(self, tables: dict, part: int = 0, parts: int = 1):
        self.tables, self.part, self.parts = tables, part, parts

    def log_probability(self, kind: int, slots: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        p = np.full(len(slots[0][0]), 1 / 256)
        for k, (pair, context) in enumerate(slots):
            keys, n, around, totals, different = self.tables[kind, k]
            (seen,), (total, kinds) = _looked_up(keys, pair, n), _looked_up(around, context, totals, different)
            p = (seen + kinds * p) / np.maximum(total + kinds, 1) + np.where(total + kinds == 0, p, 0)
        return np.log(p)

    def scores(self, urls: pa.Array) -> np.ndarray:
        """Mean log-likelihood ratio of a byte, rejected over accepted; bytes of other parts count 0."""
        out = []
        for lengths, doc, slots in contexts(urls):
            # the longest context and its byte say all of the shorter ones
            _, first, of = np.unique(slots[-1][0], return_index=True, return_inverse=True)
            some = [(pair[first], context[first]) for pair, context in slots]
            ratio = self.log_probability(0, some) - self.log_probability(1, some)
            ratio[(some[-1][1] & 511) % self.parts != self.part] = 0
            out.append(np.bincount(doc, ratio[of], minlength=len(lengths)) / np.maximum(lengths, 1))
        return np.concatenate(out) if out else np.zeros(0)


def count_pairs(labelled: DataFrame) -> DataFrame:
    return labelled.mapInArrow(counter, PAIR_DDL).groupBy("class", "tab", "slot").agg(F.sum("n").alias("n"))


def model_of(counts: DataFrame, part: int = 0, parts: int = 1) -> UrlModel:
    """The model of a part of the counts; those of order 0 have no byte before and belong to all."""
    mine = (F.col("tab") == 0) | (F.shiftright("slot", 8).bitwiseAND(F.lit(511)) % parts == part)
    rows = counts.where(mine).toArrow()
    kinds, tabs, slots, ns = (rows[c].to_numpy() for c in ("class", "tab", "slot", "n"))
    tables = {}
    for kind in (0, 1):
        for k in range(len(ORDERS)):
            of = (kinds == kind) & (tabs == k)
            order = np.argsort(slots[of])
            keys, n = slots[of][order], ns[of][order]
            around, first, different = np.unique(keys >> 8, return_index=True, return_counts=True)
            tables[kind, k] = keys, n, around, np.add.reduceat(n, first) if len(n) else n, different
    return UrlModel(tables, part, parts)


def fit(labelled: DataFrame) -> UrlModel:
    """From (class, url): the whole model, counted over all rows."""
    return model_of(count_pairs(labelled))


def scored(urls, model: UrlModel, spark) -> F.Column:
    shared = spark.sparkContext.broadcast((model.tables, model.part, model.parts))

    def score(column: pa.Array) -> pa.Array:
        return pa.array(UrlModel(*shared.value).scores(column))

    return F.arrow_udf(score, "double").asNondeterministic()(F.coalesce(urls, F.lit("")))


def judge(pages: DataFrame, rules=RULES, share: float = PASS) -> DataFrame:
    """page_id, host, path, rule, verdict, score and threshold of each page."""
    spark = pages.sparkSession
    host, path = split_url(F.col("url"))
    named = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    ruled = named.withColumn("r", rule_for(F.col("host"), F.col("path"), rules))
    held_out = F.pmod(F.xxhash64("url"), F.lit(FOLD)) == 0
    kind = (F.col("r.verdict") == "allow").cast("int")
    labelled = ruled.where("r is not null").select(kind.alias("class"), F.col("url"), held_out.alias("held_out"))
    counts, _ = written(count_pairs(labelled.where("not held_out").select("class", "url")), "pairs")
    n, classes = counts.agg(F.count("*"), F.countDistinct("class")).first()
    parts = max(1, -(-n // MAX_PAIRS))
    with_scores = ruled.select("page_id", "url", "host", "path", "r.rule", F.col("r.verdict").alias("ruled"), held_out.alias("held_out"), F.lit(0.0).alias("score"))
    for part in range(parts):
        score = F.col("score") + scored(F.col("url"), model_of(counts, part, parts), spark)
        with_scores, _ = written(with_scores.withColumn("score", score), "urls")
    both = classes == 2
    limit = with_scores.where("held_out and ruled = 'allow'").agg(F.percentile_approx("score", share, 10_000)).first()[0] if both else None
    limit = float("inf") if limit is None else max(limit, 0.0)
    verdict = F.coalesce("ruled", F.when(F.col("score") > limit, "block").otherwise("allow"))
    return with_scores.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score", F.lit(limit).alias("threshold"))
