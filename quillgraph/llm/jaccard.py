"""N-gram Jaccard join (10): size-banded tiles with hashed bitmap signatures, exact.

1. Every document's distinct shingles are hashed and sent, packed by block of documents, to
   buckets of the hash space. A bucket answers each block with those of its shingles that occur
   in two documents or more, and how often. Shingles that are frequent within one block go as
   one (shingle, count) pair, so a shingle of a third of all documents costs a bucket one entry
   a block.
2. A document of n shingles fewer than 75 % of which occur elsewhere has no partner. The rest
   keep their repeated shingles, rarest first. Equal sets become one representative.
3. Representatives with an equal min-hash are compared with the smallest of their group: linear
   in the group, and enough to join most copies into components.
4. Exactness: two linked documents share a shingle of their prefixes (the first n - ceil(0.75 n)
   + 1 in the global rarest-first order). Prefix shingles whose documents already lie in one
   component are settled. The others are dealt into tiles by size band: documents of one band
   and the band below. In a tile, bit counts of hashed bitmaps bound each overlap from above.
   Tiles of at most ``SMALL`` documents hold bitmaps only; pairs that pass are met with their
   sorted arrays once, however many tiles they share, and intersected exactly. Larger groups are
   dealt into tiles of about ``TILE`` documents a side that hold the arrays too, and documents
   that a tile has already joined aren't compared again.

Null or empty texts have no shingles and link with nothing; a null doc_id is never linked and
has a null component. Rows with an equal doc_id are one node. Fewer words than a shingle has
make one shingle of the whole sequence. Extra columns are ignored. An empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .base import bounded_batches, delete, power_of_two, release_shuffles, text_bytes, written
from .components import components

WIDTH, PERCENT = 5, 75
BUCKET_BYTES = 2 << 20  # of text by bucket of the hash space
BLOCK_DOCS, BLOCK_ENTRIES = 16_384, 1_000_000
HOT = 64  # occurrences in a block from which a shingle is sent as a count
SEEDS = (0x51ED270B, 0x2545F491, 0x9E3779B9, 0x7F4A7C15)
TILE, SMALL = 1024, 64

PACKED = "bucket long, block long, kind int, a binary, b binary, c binary, d binary"
ENTRIES, COUNTS, SELF = 0, 1, 2


def pack48(values: np.ndarray) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack48(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


LOW48 = np.uint64((1 << 48) - 1)


def by_bucket(hashes: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """Slices of sorted hashes, by their top bits."""
    if not len(hashes):
        return
    if bits == 0:
        yield 0, slice(0, len(hashes))
        return
    top = hashes >> np.uint64(64 - bits)
    cuts = np.flatnonzero(np.concatenate(([True], top[1:] != top[:-1])))
    for a, b in zip(cuts, np.append(cuts[1:], len(hashes))):
        yield int(top[a]), slice(int(a), int(b))


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


PACKED_SCHEMA = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("kind", pa.int32()), *((c, pa.binary()) for c in "abcd")])


def sender(bits: int, width: int):
    """mapInArrow function: (doc_id, text) to packed rows."""

    def flush(block: int, ids: list, sizes: list, docs: list, hashes: list) -> Iterator[pa.RecordBatch]:
        n_ids = np.concatenate(ids)
        doc, h = np.concatenate(docs), np.concatenate(hashes)
        order = np.argsort(h, kind="stable")
        h, doc = h[order], doc[order].astype(np.uint16)
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
        times = np.diff(np.append(first, len(h)))
        hot = np.repeat(times >= HOT, times)
        rows = [(block % (1 << bits), block, SELF, n_ids.astype("<i8").tobytes(), np.concatenate(sizes).astype("<i8").tobytes(), h[hot].tobytes(), doc[hot].tobytes())]
        light, of = h[~hot], doc[~hot]
        for bucket, s in by_bucket(light, bits):
            rows.append((bucket, block, ENTRIES, pack48(light[s]), of[s].tobytes(), None, None))
        heavy, many = h[first][times >= HOT], times[times >= HOT]
        for bucket, s in by_bucket(heavy, bits):
            rows.append((bucket, block, COUNTS, pack48(heavy[s]), many[s].astype("<u4").tobytes(), None, None))
        for i in range(0, len(rows), 64):
            yield batch_of(rows[i : i + 64], PACKED_SCHEMA)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.kept("jaccard")
        part, k = TaskContext.get().partitionId(), 0
        ids, sizes, docs, hashes, n_docs, n = [], [], [], [], 0, 0
        for batch in batches:
            doc_ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, j, buf, offsets in K.groups(batch.column(1)):
                counts, (h,) = K.word_hashes(buf, offsets, K.SPACED, lower=True)
                doc, shingles = K.shingle_sets(counts, h, width)
                if n_docs and (n_docs + j - i > BLOCK_DOCS or n + len(shingles) > BLOCK_ENTRIES):
                    yield from flush(part << 24 | k, ids, sizes, docs, hashes)
                    ids, sizes, docs, hashes, n_docs, n, k = [], [], [], [], 0, 0, k + 1
                for a in range(0, j - i, BLOCK_DOCS):  # many short texts may make one group
                    b = min(j - i, a + BLOCK_DOCS)
                    if a:
                        yield from flush(part << 24 | k, ids, sizes, docs, hashes)
                        ids, sizes, docs, hashes, n_docs, n, k = [], [], [], [], 0, 0, k + 1
                    mine = slice(*np.searchsorted(doc, (a, b)))
                    ids.append(doc_ids[i + a : i + b])
                    sizes.append(np.bincount(doc[mine] - a, minlength=b - a))
                    docs.append(doc[mine] - a + n_docs)
                    hashes.append(shingles[mine])
                    n_docs, n = n_docs + b - a, n + mine.stop - mine.start
        if n_docs:
            yield from flush(part << 24 | k, ids, sizes, docs, hashes)

    return send


def rank_of(df: np.ndarray) -> np.ndarray:
    """Document frequencies as one byte that keeps their order (coarsely)."""
    return np.minimum(np.log2(df) * 6, 255).astype(np.uint8)


def answer(key: tuple, rows: pa.Table) -> pa.Table:
    """One bucket: to each block, its shingles that occur twice or more, with the rank of their frequency."""
    bucket = key[0].as_py()
    kinds, blocks = rows["kind"].to_pylist(), rows["block"].to_pylist()
    a, b, c, d = (rows[x].to_pylist() for x in "abcd")
    out, values, weights, owner = [], [], [], []
    for i, kind in enumerate(kinds):
        if kind == SELF:
            out.append((0, blocks[i], SELF, a[i], b[i], c[i], d[i]))
            continue
        v = unpack48(a[i])
        values.append(v)
        weights.append(np.ones(len(v), np.int64) if kind == ENTRIES else np.frombuffer(b[i], "<u4").astype(np.int64))
        owner.append(i)
    if values:
        distinct, at = np.unique(np.concatenate(values), return_inverse=True)
        df = np.bincount(at, np.concatenate(weights)).astype(np.int64)
        top = np.uint64(bucket << 48)
        begin = 0
        for i, v in zip(owner, values):
            mine = df[at[begin : begin + len(v)]]
            begin += len(v)
            keep = mine >= 2
            if keep.any():
                refs = np.frombuffer(b[i], np.uint16)[keep].tobytes() if kinds[i] == ENTRIES else None
                out.append((0, blocks[i], kinds[i], (v[keep] | top).tobytes(), refs, rank_of(mine[keep]).tobytes(), None))
    K.settle()
    return pa.Table.from_batches([batch_of(out, PACKED_SCHEMA)])


SET_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("class", pa.binary()), ("hashes", pa.list_(pa.int64())), ("prefix", pa.int32()), ("keys", pa.list_(pa.int64())), ("map", pa.binary())])
SETS = "doc_id long, n long, class binary, hashes array<long>, prefix int, keys array<long>, map binary"


def gatherer(bits: int, percent: int):
    """One block: a row per document; hashes (rarest first) only of documents that may have a partner."""

    def gather(rows: pa.Table) -> pa.Table:
        hashes, refs, ranks, hot_h, hot_r = [], [], [], [], []
        ids = sizes = own_h = own_r = None
        for kind, a, b, c, d in zip(*(rows[x].to_pylist() for x in ("kind", "a", "b", "c", "d"))):
            if kind == SELF:
                ids, sizes = np.frombuffer(a, "<i8"), np.frombuffer(b, "<i8")
                own_h, own_r = np.frombuffer(c, np.uint64), np.frombuffer(d, np.uint16)
            elif kind == ENTRIES:
                hashes.append(np.frombuffer(a, np.uint64))
                refs.append(np.frombuffer(b, np.uint16))
                ranks.append(np.frombuffer(c, np.uint8))
            else:
                hot_h.append(np.frombuffer(a, np.uint64))
                hot_r.append(np.frombuffer(c, np.uint8))
        if len(own_h):
            heavy, rank = np.concatenate(hot_h), np.concatenate(hot_r)
            order = np.argsort(heavy)
            short = (own_h & LOW48) | ((own_h >> np.uint64(64 - bits)) << np.uint64(48) if bits else np.uint64(0))
            at = order[np.searchsorted(heavy[order], short)]
            hashes.append(short)
            refs.append(own_r)
            ranks.append(rank[at])
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        r = np.concatenate(refs) if refs else np.zeros(0, np.uint16)
        k = np.concatenate(ranks) if ranks else np.zeros(0, np.uint8)
        found = np.bincount(r, minlength=len(ids))
        may = (sizes > 0) & (100 * found >= percent * sizes)
        keep = may[r]
        h, r, k = h[keep], r[keep], k[keep]
        order = np.lexsort((h, k, r))
        h, r = h[order], r[order]
        cuts = np.searchsorted(r, np.arange(len(ids) + 1))
        signed = h.view(np.int64)
        minima = [K.mix(h ^ np.uint64(s)) for s in SEEDS]
        out = []
        for i in np.flatnonzero(may):
            s = slice(cuts[i], cuts[i + 1])
            n, u = int(sizes[i]), int(found[i])
            same = hashlib.blake2b(np.sort(h[s]).tobytes(), digest_size=16).digest() if u >= n else None
            prefix = n - (percent * n + 99) // 100 + 1 - (n - u)
            keys = [int(((m[s].min() >> np.uint64(2)) << np.uint64(2) | np.uint64(j)).view(np.int64)) for j, m in enumerate(minima)]
            out.append((int(ids[i]), n, same, signed[s], max(prefix, 1), keys, bitmap(h[s], n).tobytes()))
        out += [(int(ids[i]), int(sizes[i]), None, None, None, None, None) for i in np.flatnonzero(~may)]
        K.settle()
        return pa.Table.from_batches([batch_of(out, SET_SCHEMA)])

    return gather


def bitmap(hashes: np.ndarray, n: int) -> np.ndarray:
    """64-bit words in which bit h mod bits is set for each hash; twice as many bits as shingles, as a power of two."""
    bits = power_of_two(max(256, 2 * n))
    flags = np.zeros(bits, bool)
    flags[(hashes & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(flags, bitorder="little").view(np.uint64)


def aligned(maps: list[np.ndarray]) -> np.ndarray:
    """One row for each bitmap, folded to the shortest."""
    width = min(len(m) for m in maps)
    return np.stack([np.bitwise_or.reduce(m.reshape(-1, width), axis=0) for m in maps])


def linked(a: np.ndarray, n_a: int, b: np.ndarray, n_b: int, percent: int) -> bool:
    """Exact, over sorted arrays of the shingles that occur elsewhere."""
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (n_a + n_b - shared)


def possible(n: np.ndarray, ones: np.ndarray, maps: np.ndarray, i: int, others: np.ndarray, percent: int) -> np.ndarray:
    """Those of ``others`` that sizes and bit counts don't rule out as partners of i.

    A set bit of i that the other lacks stands for at least one shingle that the other lacks.
    """
    missing = ones[i] - np.bitwise_count(maps[others] & maps[i]).sum(axis=1)
    bound = np.minimum(n[i] - missing, n[others] - np.maximum(0, ones[others] - (ones[i] - missing)))
    return others[100 * bound >= percent * (n[i] + n[others] - bound)]


def tile_pairs(n: np.ndarray, maps: np.ndarray, group: np.ndarray, side: np.ndarray, sets: list[np.ndarray] | None, percent: int) -> list[tuple[int, int]]:
    """Pairs of sides 0 and 1 that are in different groups (components known before).

    With ``sets``: links that join the tile's documents as far as they are linked. Without: the
    pairs that sizes and bit counts leave possible.
    """
    ones = np.bitwise_count(maps).sum(axis=1).astype(np.int64)
    _, group = np.unique(group, return_inverse=True)
    group = group.copy()
    out = []
    for i in np.flatnonzero(side == 0):
        for j in possible(n, ones, maps, i, np.flatnonzero((group != group[i]) & (side == 1)), percent):
            if sets is None:
                out.append((i, j))
            elif group[j] != group[i] and linked(sets[i], n[i], sets[j], n[j], percent):
                out.append((i, j))
                group[group == group[j]] = group[i]
    return out


def verifier(percent: int):
    """mapInArrow function: (u, v, n_u, n_v, s_u, s_v) to linked (u, v)."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v, n_u, n_v = (batch.column(i).to_numpy() for i in range(4))
            keep = []
            for i in range(batch.num_rows):
                a, b = (np.sort(batch.column(c)[i].values.to_numpy().view(np.uint64)) for c in (4, 5))
                n, maps = np.array([n_u[i], n_v[i]]), aligned([bitmap(a, n_u[i]), bitmap(b, n_v[i])])
                ones = np.bitwise_count(maps).sum(axis=1).astype(np.int64)
                if len(possible(n, ones, maps, 0, np.array([1]), percent)) and linked(a, n_u[i], b, n_v[i], percent):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(u[keep]), pa.array(v[keep])], names=["u", "v"])

    return verify


def tiler(percent: int, exact: bool):
    def tile(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks().sort_by("doc_id")
        ids, n, group, side = (rows[c].to_numpy() for c in ("doc_id", "n", "root", "side"))
        out = []
        if len(ids) > 1:
            maps = aligned([np.frombuffer(x.as_py(), np.uint64) for x in rows["map"]])
            sets = [np.sort(x.values.to_numpy().view(np.uint64)) for x in rows["hashes"]] if exact else None
            out = tile_pairs(n, maps, group, side, sets, percent)
        u, v = ([int(ids[p[k]]) for p in out] for k in (0, 1))
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return tile


def shingle_table(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> tuple[DataFrame, str]:
    """SETS of each document with a doc_id, as a written table."""
    buckets = power_of_two(text_bytes(docs) / BUCKET_BYTES)
    bits = buckets.bit_length() - 1
    spark = docs.sparkSession
    sent = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(sender(bits, width), PACKED)
    # the group key must reach its own function
    answered = sent.groupBy("bucket").applyInArrow(lambda key, rows: answer(key, rows), PACKED)
    out = written(answered.groupBy("block").applyInArrow(gatherer(bits, percent), SETS), "sets")
    release_shuffles(spark)
    return out


def band_of(n, percent: int = PERCENT) -> F.Column:
    """Band of a size: partners lie in one band or in two neighbours."""
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(100 / percent + 1e-9))).cast("int")


def _tiles(open_rows: DataFrame, reps: DataFrame, roots: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Groups of (key, doc_id) with several components: pairs that small tiles leave possible; links of large ones."""
    rows = open_rows.join(reps.select("doc_id", "n"), "doc_id").withColumn("band", band_of(F.col("n"), percent))
    roles = F.explode(F.array(F.struct(F.col("band").alias("band"), F.lit(0).alias("low")), F.struct((F.col("band") + 1).alias("band"), F.lit(1).alias("low")))).alias("t")
    placed = rows.select("key", "doc_id", roles).select("key", "doc_id", "t.band", "t.low")
    sizes = placed.groupBy("key", "band").agg(F.sum(1 - F.col("low")).alias("upper"), F.count("*").alias("members")).where("upper > 0 and members > 1")
    blocks = F.when(F.col("members") <= SMALL, 0).otherwise(F.ceil(F.col("members") / TILE)).cast("int")
    # written first: the join then is one that can be split where a group is large
    counted, _ = written(sizes.select("key", "band", blocks.alias("s")), "sizes")
    dealt = placed.join(counted, ["key", "band"])
    small = dealt.where("s = 0")
    # every member meets the uppers: both sides of a small tile are one row each
    side_0 = small.where("low = 0").select("key", "band", "doc_id", F.lit(0).alias("side"))
    side_1 = small.select("key", "band", "doc_id", F.lit(1).alias("side"))
    light = side_0.unionByName(side_1).join(reps.select("doc_id", "n", "map"), "doc_id").join(roots, "doc_id")
    pairs = light.groupBy("key", "band").applyInArrow(tiler(percent, exact=False), "u long, v long")
    # block i of the uppers meets every block j of the members
    large = dealt.where("s > 0").withColumn("mine", F.pmod(F.xxhash64("doc_id", "key"), F.col("s")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("s") - 1))
    side_0 = large.where("low = 0").select("key", "band", "doc_id", F.col("mine").alias("i"), every.alias("j"), F.lit(0).alias("side"))
    side_1 = large.select("key", "band", "doc_id", every.alias("i"), F.col("mine").alias("j"), F.lit(1).alias("side"))
    full = side_0.unionByName(side_1).join(reps.select("doc_id", "n", "map", "hashes"), "doc_id").join(roots, "doc_id")
    links = full.groupBy("key", "band", "i", "j").applyInArrow(tiler(percent, exact=True), "u long, v long")
    return pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), links


def _compared(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (u, v) that are linked; sizes are met before sets."""
    left = reps.select(F.col("doc_id").alias("u"), F.col("n").alias("n_u"), F.col("hashes").alias("s_u"))
    right = reps.select(F.col("doc_id").alias("v"), F.col("n").alias("n_v"), F.col("hashes").alias("s_v"))
    near = F.least("n_u", "n_v") * 100 >= percent * F.greatest("n_u", "n_v")
    sized = pairs.join(left.drop("s_u"), "u").join(right.drop("s_v"), "v").where(near).select("u", "v")
    met = sized.join(left, "u").join(right, "v").select("u", "v", "n_u", "n_v", "s_u", "s_v")
    return met.mapInArrow(verifier(percent), "u long, v long")


def jaccard_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    sets, _ = shingle_table(docs, width, percent)
    alive = sets.where("hashes is not null")
    shared = alive.where("class is not null").groupBy("class").agg(F.min(F.struct("doc_id", "n", "hashes", "prefix", "keys", "map")).alias("r"))
    reps, reps_path = written(shared.select("r.*").unionByName(alive.where("class is null").select("doc_id", "n", "hashes", "prefix", "keys", "map")), "reps")
    release_shuffles(spark)

    keys = reps.select("doc_id", F.explode("keys").alias("key"))
    # written first, as tile sizes are below: the join can then be split where a key is frequent
    leaders, _ = written(keys.groupBy("key").agg(F.min("doc_id").alias("v"), F.count("*").alias("m")).where("m > 1").select("key", "v"), "leaders")
    stars = keys.join(leaders, "key").where("doc_id != v").select(F.col("doc_id").alias("u"), "v").distinct()
    links, links_path = written(_compared(stars, reps, percent), "links")
    first, _ = components(links)
    release_shuffles(spark)
    roots = reps.select("doc_id").join(first.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("root", "doc_id").alias("root"))

    prefixes = reps.select("doc_id", F.explode(F.slice("hashes", F.lit(1), F.col("prefix"))).alias("key")).join(roots, "doc_id")
    unsettled = prefixes.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("m"), F.sum(F.xxhash64("doc_id").cast("decimal(38,0)")).alias("who")).where("lo != hi")
    # shingles with the same documents need one tile only
    once = unsettled.groupBy("who", "m").agg(F.min("key").alias("key"))
    open_rows, open_path = written(prefixes.select("key", "doc_id").join(once.select("key"), "key"), "open")
    pairs, large = _tiles(open_rows, reps, roots, percent)
    possible_pairs, pairs_path = written(pairs, "pairs")
    release_shuffles(spark)
    more, more_path = written(_compared(possible_pairs, reps, percent), "links")
    most, most_path = written(large, "links")
    final, _ = components(links.unionByName(more).unionByName(most))
    delete(spark, open_path, pairs_path, links_path, more_path, most_path, reps_path)
    release_shuffles(spark)

    classes = sets.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("rep"))
    grouped = sets.where("class is not null").join(classes, "class").select("doc_id", "n", "rep")
    ungrouped = sets.where("class is null").select("doc_id", "n", F.col("doc_id").alias("rep"))
    named = grouped.unionByName(ungrouped).join(final.withColumnRenamed("node", "rep"), "rep", "left")
    # rows with one doc_id and several texts are one node
    out = named.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "rep").alias("component_id"))
    nameless = docs.where("doc_id is null").select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return out.unionByName(nameless)


def drop_near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The documents that are the smallest of their component, with their columns as they are."""
    found = jaccard_components(docs.select("doc_id", "text"), width, percent)
    gone, _ = written(found.where("component_id != doc_id").select("doc_id").distinct(), "gone")
    release_shuffles(docs.sparkSession)
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
