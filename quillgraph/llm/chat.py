"""Chat formatting (3): quotation linking, in DataFrame functions only.

A line's quote level is the number of ``>`` before its text. Consecutive lines of one level are a
quoted passage. Passages and their lines are normalised (A-Z lower-cased, everything but letters
and digits one space), hashed, and joined to the earliest message of the conversation whose own,
unquoted words are the same, as a whole or as a line. A message replies to the message that its
outermost quotes come from; passages count before lines, many matches before few, late messages
before early ones. Reply trees are walked by doubling, so their depth costs its logarithm.

Each message yields its text without quotes, what it replies to, its thread (the tree's first
turn), depth, and its path of turns; sorting by conversation and path gives the reply order. A
message that quotes nothing known starts a thread.

With ``partial``, a passage is also split at its blank quoted lines, and paragraphs of messages are
indexed beside their lines, so that paragraphs of a message link when they are quoted without the
rest or re-wrapped; whole passages count before paragraphs, ``n_linked`` counts paragraphs. The
registered query is without, as its SQL is.

Null texts are empty messages. Messages without a conv_id or turn are never linked. Rows with one
conv_id and turn are one place in a conversation: replies to it are the same, each row has its own
text. Quotes that hold no letter or digit link nothing. Long texts are lines like others. Extra
columns are ignored; an empty table gives an empty result. Only conversations that quote are
indexed; a key is (conversation, hash) with its first turn, summed before the shuffle, so a
phrase or a conversation that fills a third of the table is no group that has to be gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import delete, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MARKS = r"^(?:[ \t]*>)+[ \t]?"
BLANK = r"\n(?:[ \t]*\n)+"
KEY = ["conv_id", "turn", "tag"]


def level_of(line) -> F.Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 0), "[^>]", ""))


def normalised(text) -> F.Column:
    return F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), r"[^\p{L}\p{N}]+", " "))


def own_text(text) -> F.Column:
    """The text without quoted lines; blank lines at its ends go if there were any."""
    lines = F.split(text, "\n")
    own = F.filter(lines, lambda x: ~x.rlike(r"^[ \t]*>"))
    return F.when(F.size(own) == F.size(lines), text).otherwise(F.regexp_replace(F.array_join(own, "\n"), r"\A\n+|\n+\z", ""))


def _hash(text) -> F.Column:
    return F.xxhash64(normalised(text))


def quoted_keys(quoting: DataFrame, partial: bool = False) -> DataFrame:
    """(conv_id, turn, tag, level, whole, h): hashes of quoted passages and of their lines.

    whole is 0 for a line and 1 for a passage; with ``partial`` 1 for a paragraph of one and 2 for one of several paragraphs.
    """
    lines = quoting.select(*KEY, F.posexplode(F.split("text", "\n")).alias("at", "line")).withColumn("level", level_of(F.col("line"))).where("level > 0")
    lines = lines.withColumn("line", F.regexp_replace("line", MARKS, ""))
    run = F.col("at") - F.row_number().over(Window.partitionBy(*KEY, "level").orderBy("at"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n" if partial else " ")
    passages = lines.withColumn("run", run).groupBy(*KEY, "level", "run").agg(joined.alias("line"))
    whole = F.lit(1)
    if partial:
        passages = passages.withColumn("parts", F.filter(F.split("line", BLANK), lambda x: normalised(x) != ""))
        whole = F.when(F.size("parts") > 1, 2).otherwise(1)
    every = lines.select(*KEY, "level", F.lit(0).alias("whole"), "line").unionByName(passages.select(*KEY, "level", whole.alias("whole"), "line"))
    if partial:
        every = every.unionByName(passages.where(F.size("parts") > 1).select(*KEY, "level", F.lit(1).alias("whole"), F.explode("parts").alias("line")))
    return every.where(normalised(F.col("line")) != "").select(*KEY, "level", "whole", _hash(F.col("line")).alias("h"))


def links(messages: DataFrame, partial: bool = False) -> DataFrame:
    """(conv_id, turn, tag, reply_to, n_linked) of messages that quote something known."""
    quoting = messages.where(F.col("text").rlike(r"(?m)^[ \t]*>") & F.col("conv_id").isNotNull() & F.col("turn").isNotNull()).select(*KEY, "text").dropDuplicates(KEY)
    talks = quoting.select("conv_id").distinct()
    spoken = messages.where(F.col("turn").isNotNull()).join(talks, "conv_id", "left_semi").select("conv_id", "turn", own_text(F.col("text")).alias("own"))
    pieces = [F.array("own"), F.split("own", "\n")] + ([F.split("own", BLANK)] if partial else [])
    parts = F.explode(F.array_distinct(F.concat(*pieces))).alias("part")
    index = spoken.select("conv_id", "turn", parts).where(normalised(F.col("part")) != "").groupBy("conv_id", _hash(F.col("part")).alias("h")).agg(F.min("turn").alias("said"))
    found = quoted_keys(quoting, partial).join(index, ["conv_id", "h"]).where("said < turn")
    votes = found.groupBy(*KEY, "level", "whole", "said").agg(F.count("*").alias("n"))
    best = F.max(F.struct((-F.col("level")).alias("level"), "whole", "n", "said"))["said"]
    return votes.groupBy(*KEY).agg(best.alias("reply_to"), _linked(partial).alias("n_linked"))


def _linked(partial: bool) -> F.Column:
    if not partial:
        return F.sum(F.col("n") * F.col("whole"))
    of = lambda whole: F.sum(F.when(F.col("whole") == whole, F.col("n")).otherwise(0))
    return F.greatest(of(1), of(2))


def paths(edges: DataFrame) -> DataFrame:
    """(conv_id, turn, thread, path) for each (conv_id, turn, reply_to); replies go to earlier turns."""
    spark = edges.sparkSession
    now, at = written(edges.select("conv_id", "turn", F.col("reply_to").alias("top"), F.array("turn").alias("path")), "replies")
    while not now.isEmpty():
        above = now.select("conv_id", F.col("turn").alias("top"), F.col("top").alias("next"), F.col("path").alias("before"))
        if now.join(above, ["conv_id", "top"], "left_semi").isEmpty():
            break
        moved = now.join(above, ["conv_id", "top"], "left").select("conv_id", "turn", F.coalesce("next", "top").alias("top"), F.when(F.col("next").isNull(), F.col("path")).otherwise(F.concat("before", "path")).alias("path"))
        then, to = written(moved, "replies")
        delete(spark, at)
        now, at = then, to
    return now.select("conv_id", "turn", F.col("top").alias("thread"), F.concat(F.array("top"), "path").alias("path"))


def format_chats(conversations: DataFrame, partial: bool = False) -> DataFrame:
    """A row for each message: conv_id, turn, role, body, reply_to, n_linked, thread, depth, path."""
    messages = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    messages = messages.withColumn("tag", F.xxhash64("text"))
    linked, _ = written(links(messages, partial), "links")
    places, _ = written(paths(linked.groupBy("conv_id", "turn").agg(F.max("reply_to").alias("reply_to"))), "paths")
    # the left side may have a hot conversation; both joins are on the message
    out = messages.join(linked, KEY, "left").join(places, ["conv_id", "turn"], "left")
    path = F.coalesce("path", F.array("turn"))
    return out.select("conv_id", "turn", "role", own_text(F.col("text")).alias("body"), "reply_to", F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), F.coalesce("thread", "turn").alias("thread"), (F.size(path) - 1).cast("long").alias("depth"), F.when(F.col("turn").isNotNull(), F.array_join(path, "/")).alias("path"))


def in_reply_order(chats: DataFrame, partitions: int) -> DataFrame:
    """Dealt out and sorted by conversation and path: files hold conversations in reply order, long ones over several."""
    order = F.transform(F.split("path", "/"), lambda x: x.cast("long"))
    keyed = chats.withColumn("__order", order)
    return keyed.repartitionByRange(partitions, "conv_id", "__order").sortWithinPartitions("conv_id", "__order").drop("__order")


ORACLE = r"""
WITH RECURSIVE m AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text, row_number() OVER () AS r FROM conversations
), b AS (
  SELECT *, string_split(text, chr(10)) AS ls FROM m
), o AS (
  SELECT *, list_filter(ls, lambda x: NOT regexp_matches(x, '^[ \t]*>')) AS own FROM b
), w AS (
  SELECT *, CASE WHEN len(own) = len(ls) THEN text
    ELSE regexp_replace(array_to_string(own, chr(10)), '\A\n+|\n+\z', '', 'g') END AS body FROM o
), l AS (
  SELECT r, conv_id, turn, i, ls[i] AS line,
    length(regexp_replace(regexp_extract(ls[i], '^(?:[ \t]*>)+[ \t]?'), '[^>]', '', 'g')) AS lv
  FROM (SELECT r, conv_id, turn, ls, unnest(range(1, len(ls) + 1)) AS i FROM w WHERE conv_id IS NOT NULL AND turn IS NOT NULL)
), q AS (
  SELECT r, conv_id, turn, i, lv, regexp_replace(line, '^(?:[ \t]*>)+[ \t]?', '') AS line,
    i - row_number() OVER (PARTITION BY r, lv ORDER BY i) AS run
  FROM l WHERE lv > 0
), k AS (
  SELECT r, conv_id, turn, lv, 0 AS whole, line FROM q
  UNION ALL
  SELECT r, conv_id, turn, lv, 1, string_agg(line, ' ' ORDER BY i) FROM q GROUP BY r, conv_id, turn, lv, run
), kn AS (
  SELECT r, conv_id, turn, lv, whole, trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\p{L}\p{N}]+', ' ', 'g')) AS h FROM k
), ix AS (
  SELECT conv_id, trim(regexp_replace(translate(p, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\p{L}\p{N}]+', ' ', 'g')) AS h, min(turn) AS said
  FROM (SELECT conv_id, turn, body AS p FROM w UNION ALL SELECT conv_id, turn, unnest(string_split(body, chr(10))) FROM w)
  WHERE conv_id IN (SELECT conv_id FROM kn) GROUP BY 1, 2
), v AS (
  SELECT r, kn.conv_id, kn.turn, lv, whole, said, count(*) AS n FROM kn JOIN ix ON kn.conv_id = ix.conv_id AND kn.h = ix.h
  WHERE kn.h <> '' AND said < kn.turn GROUP BY ALL
), e AS (
  SELECT r, conv_id, turn, sum(n * whole) AS n_linked, arg_max(said, (-lv, whole, n, said)) AS reply_to FROM v GROUP BY r, conv_id, turn
), t AS (
  SELECT conv_id, turn, max(reply_to) AS up FROM e GROUP BY conv_id, turn
), p AS (
  SELECT conv_id, turn, up AS thread, 1 AS depth, up::VARCHAR || '/' || turn::VARCHAR AS path FROM t
  UNION ALL
  SELECT p.conv_id, p.turn, t.up, depth + 1, t.up::VARCHAR || '/' || path FROM p JOIN t ON p.conv_id = t.conv_id AND p.thread = t.turn
), d AS (
  SELECT conv_id, turn, max_by(thread, depth) AS thread, max(depth) AS depth, max_by(path, depth) AS path FROM p GROUP BY conv_id, turn
)
SELECT w.conv_id, w.turn, w.role, body, reply_to, coalesce(n_linked, 0)::BIGINT AS n_linked,
  coalesce(thread, w.turn) AS thread, coalesce(depth, 0)::BIGINT AS depth, coalesce(path, w.turn::VARCHAR) AS path
FROM w LEFT JOIN e ON w.r = e.r LEFT JOIN d ON w.conv_id = d.conv_id AND w.turn = d.turn
"""
