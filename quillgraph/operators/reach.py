"""Events that questions reach over shared participants, as lists of event numbers: a row a question and list, not a row an event.

An event's neighbours are listed once for all questions; a hop joins a question's events with these lists and
unites them by question in numpy. Entities of many events are hubs: their events are listed by the entity,
in blocks, and a question meets each hub once, so lists never grow with the square of an entity's events.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import storage

#: Events of a wanted type from which an entity is a hub; numbers of a hub's block, and of a result's row at most.
HUB, BLOCK, LONGEST = 256, 1 << 12, 1 << 18
#: Bytes of a batch that goes to Python.
BATCH = 4 << 20


class Lists(NamedTuple):
    """light, heavy: (entity_id, type, ordinals), heavy in blocks; near: (ordinal, type, ordinals); hubs: (ordinal, type, entity_id)
    of an event's hubs. heavy and hubs are None where there are no hubs."""

    light: DataFrame
    heavy: DataFrame | None
    near: DataFrame
    hubs: DataFrame | None


def split(ids: np.ndarray, run: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(run of each piece, offsets): values by run, runs of over LONGEST values in pieces."""
    sizes = np.bincount(run, minlength=n)
    pieces = -(-sizes // LONGEST)
    owner = np.repeat(np.arange(n), pieces)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    return owner, np.append((np.cumsum(sizes) - sizes)[owner] + nth * LONGEST, len(ids))


def minus(run: np.ndarray, value: np.ndarray, old: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(run, value) that are new, each once, in order: values that an old row of their run has are left out."""
    low = int(value.min()) if len(value) else 0
    bits = (int(value.max()) - low).bit_length() if len(value) else 0
    if bits + n.bit_length() > 62:
        parts = [np.setdiff1d(value[(run == k) & ~old], value[(run == k) & old]) for k in range(n)]
        return np.repeat(np.arange(n), [len(p) for p in parts]), np.concatenate(parts)
    key = (run.astype(np.int64) << bits) | (value - low)
    fresh, known = np.unique(key[~old]), np.unique(key[old])
    if len(known):
        at = np.minimum(np.searchsorted(known, fresh), len(known) - 1)
        fresh = fresh[known[at] != fresh]
    return fresh >> bits, (fresh & ((1 << bits) - 1)) + low


def runs_of(batch: pa.RecordBatch, n_keys: int) -> np.ndarray:
    """Whether a row's key differs from that of the row before."""
    first = np.zeros(batch.num_rows, bool)
    first[0] = True
    for c in batch.columns[:n_keys]:
        first[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
    return first


def unite(n_keys: int, names: list[str]):
    """mapInArrow function over (keys, old, ordinals) in order of the keys: for each key the numbers of its rows that no old row has."""

    def opened(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        first = runs_of(batch, n_keys)
        lists = batch.column(n_keys + 1)
        row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        old = batch.column(n_keys).to_numpy(zero_copy_only=False)
        return np.flatnonzero(first), (np.cumsum(first) - 1)[row], lists.flatten().to_numpy(zero_copy_only=False), old[row]

    def made(batch: pa.RecordBatch) -> pa.RecordBatch:
        starts, run, value, old = opened(batch)
        run, value = minus(run, value, old, len(starts))
        owner, offsets = split(value, run, len(starts))
        keys = [c.take(pa.array(starts[owner])) for c in batch.columns[:n_keys]]
        return pa.RecordBatch.from_arrays([*keys, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(value, pa.int64()))], names=names)

    def shorter(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        """Rows of one key as two: its old numbers, and its others."""
        _, _, value, old = opened(batch := pa.concat_batches(held))
        both = [np.unique(value[old]), np.unique(value[~old])]
        lists = pa.ListArray.from_arrays(pa.array([0, len(both[0]), len(both[0]) + len(both[1])], pa.int32()), pa.array(np.concatenate(both), pa.int64()))
        return pa.RecordBatch.from_arrays([*[c.take(pa.array([0, 0])) for c in batch.columns[:n_keys]], pa.array([True, False]), lists], schema=batch.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the last key so far
        size = least = LONGEST
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = pa.RecordBatch.from_arrays(batch.columns, names=[*names[:-1], "old", "ordinals"])
            tail = int(np.flatnonzero(runs_of(batch, n_keys))[-1])
            same = bool(held) and all(batch.column(k)[0].equals(held[0].column(k)[0]) for k in range(n_keys))
            if tail == 0 and same:
                held.append(batch)
                size += len(batch.column(n_keys + 1).flatten())
                if size > 2 * least:
                    held = [shorter(held)]
                    size = least = max(LONGEST, len(held[0].column(n_keys + 1).flatten()))
                continue
            ready = [b for b in (*held, batch.slice(0, tail)) if b.num_rows]
            if ready:
                yield made(pa.concat_batches(ready))
            held, size, least = [batch.slice(tail)], LONGEST, LONGEST
        if held:
            yield made(pa.concat_batches(held))

    return run


def united(rows: DataFrame, *keys: str, old: DataFrame | None = None) -> DataFrame:
    """(keys, ordinals): distinct numbers of the rows' lists by key, in order, without those that ``old`` has; long ones in several rows."""
    spark = rows.sparkSession
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jsparkSession.sessionState().conf().getConfString(name, "2147483647").rstrip("b")
    if not now.isdigit() or int(now) > BATCH:
        spark.conf.set(name, str(BATCH))
    every = rows.select(*keys, F.lit(False).alias("old"), "ordinals")
    if old is not None:
        every = every.unionByName(old.select(*keys, F.lit(True).alias("old"), "ordinals"))
    kinds = dict(every.dtypes)
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "ordinals array<long>"])
    dealt = every.where(F.size("ordinals") > 0).repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(unite(len(keys), [*keys, "ordinals"]), schema).where(F.size("ordinals") > 0)


def lists_of(links: DataFrame, people: DataFrame, kinds: DataFrame) -> Lists:
    """links: (entity_id, type, ordinal); people: (ordinal, entity_id) of the events from which hops go on; kinds: the wanted types."""
    mine = links.join(F.broadcast(kinds), "type", "left_semi").where("ordinal is not null").select("entity_id", "type", "ordinal")
    mine, _ = storage.written(mine, "links")
    hubs = mine.groupBy("entity_id", "type").agg(F.count("*").alias("n")).where(F.col("n") > HUB).select("entity_id", "type")
    hubs, _ = storage.written(hubs, "hubs")
    packed = lambda df, *keys: df.groupBy(*keys).agg(F.collect_list("ordinal").alias("ordinals"))
    heavy = of_event = None
    light = mine
    if not hubs.isEmpty():
        light = mine.join(hubs, ["entity_id", "type"], "left_anti")
        blocks = mine.join(hubs, ["entity_id", "type"]).withColumn("_b", F.floor(F.col("ordinal") / BLOCK))
        heavy, _ = storage.written(packed(blocks, "entity_id", "type", "_b").drop("_b"), "heavy")
        of_event, _ = storage.written(people.join(hubs, "entity_id").select("ordinal", "type", "entity_id").distinct(), "hubs")
    light, _ = storage.written(packed(light.repartition("entity_id"), "entity_id", "type"), "lists")
    near, _ = storage.written(united(people.join(light, "entity_id").select("ordinal", "type", "ordinals"), "ordinal", "type"), "near")
    return Lists(light, heavy, near, of_event)


def first(seeds: DataFrame, types: DataFrame, lists: Lists) -> DataFrame:
    """(qid, ordinals): wanted events of the seeds (qid, entity_id); types: (qid, type)."""
    asked = seeds.select("qid", "entity_id").distinct().join(types, "qid")
    out = asked.join(lists.light, ["entity_id", "type"]).select("qid", "ordinals")
    if lists.heavy is not None:
        out = out.unionByName(asked.join(lists.heavy, ["entity_id", "type"]).select("qid", "ordinals"))
    return united(out, "qid")


def further(frontier: DataFrame, types: DataFrame, lists: Lists, known: DataFrame, met: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(qid, ordinals) of wanted events that share a participant with the frontier (qid, ordinals) and aren't known, and the hubs
    (qid, type, entity_id) that questions have met by then."""
    asked = frontier.select("qid", F.explode("ordinals").alias("ordinal")).join(types, "qid")
    out = asked.join(lists.near, ["ordinal", "type"]).select("qid", "ordinals")
    if lists.heavy is not None:
        hubs = asked.join(lists.hubs, ["ordinal", "type"]).select("qid", "type", "entity_id").distinct()
        hubs, _ = storage.written(hubs if met is None else hubs.join(met, ["qid", "type", "entity_id"], "left_anti"), "met")
        met = hubs if met is None else met.unionByName(hubs)
        out = out.unionByName(hubs.join(lists.heavy, ["entity_id", "type"]).select("qid", "ordinals"))
    return united(out, "qid", old=known), met
