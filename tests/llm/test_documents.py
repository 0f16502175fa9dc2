"""Operators over documents against brute force, on rows that are awkward on purpose."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillgraph.llm import decontaminate, idfiles, jaccard, licenses, packing, quality, substring, tokens

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def lower(s):
    return s.translate({k: k + 32 for k in range(65, 91)})


def corpus(seed=1, n=120):
    rng = random.Random(seed)
    vocab = ["alpha", "Beta", "gamma,", "délta", "epsilon.", "zeta", "eta", "Theta", "iota", "kappa", "λ", "mu", "nu", "xi"] + [f"w{i}" for i in range(300)]
    say = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    passage = say(60)
    rows = [(i, say(rng.randint(1, 80)) + rng.choice([" ", "\n", "\t"]) + say(rng.randint(1, 60))) for i in range(n)]
    base = say(100)
    for k in range(40):  # near copies
        words = base.split()
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = f"edit{rng.randrange(999)}"
        rows.append((1000 + k, " ".join(words)))
    rows += [(2000 + k, base) for k in range(15)] + [(3000 + k, say(20) + "\n" + passage + " " + say(20)) for k in range(15)]
    rows += [(4000, None), (4001, ""), (4002, " \n\t "), (4003, "one"), (4004, "ONE"), (4005, "a b c d"), (4006, "A b\nc d"), (4007, "x" * 3000), (4008, "same line\n" * 30), (4009, "é" * 40 + " ü"), (4010, "cc by cc by 4.0 All Rights Reserved"), (-5, base)]
    rows += [(4011, (say(3000) + "\n") * 8), (4012, "a\x00b \u2028 c <|endoftext|> İ ΣΑΣ don't")]
    return [(i, t, rng.choice(["en", "de", None]), rng.choice(["s0", "s0", "s1", None]), len(t or "")) for i, t in rows]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    # extra columns whose names operators use themselves
    return df.withColumn("n", F.lit(1)).withColumn("f", F.lit("x")).withColumn("kept", F.lit(None).cast("string")).withColumn("__counts", F.lit(2)).withColumn("span", F.lit(3)).withColumn("tag", F.lit(4))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text):
    w = SPACED.findall(lower(text or ""))
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_jaccard_components(docs, rows):
    sets = {i: shingles(t) for i, t, *_ in rows}
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = list(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect()}
    assert got == {i: (len(sets[i]), top(i)) for i in ids}


def test_jaccard_large_tiles_are_exact(docs, rows, monkeypatch):
    want = {tuple(r) for r in jaccard.jaccard_components(docs).collect()}
    monkeypatch.setattr(jaccard, "SMALL", 1)
    monkeypatch.setattr(jaccard, "TILE", 4)
    monkeypatch.setattr(jaccard, "SEEDS", jaccard.SEEDS[:1])
    assert {tuple(r) for r in jaccard.jaccard_components(docs).collect()} == want


@pytest.mark.parametrize("percent", [30, 50, 75, 90])
def test_bands_of_possible_partners_are_neighbours(spark, percent):
    bands = {r.n: r.band for r in spark.range(1, 300).select(F.col("id").alias("n"), jaccard.band_of(F.col("id"), percent).alias("band")).collect()}
    assert all(bands[m] - bands[n] in (0, 1) for n in bands for m in bands if n <= m and 100 * n >= percent * m)


def test_jaccard_blocks_and_buckets_change_nothing(docs, monkeypatch):
    want = {tuple(r) for r in jaccard.jaccard_components(docs).collect()}
    monkeypatch.setattr(jaccard, "BUCKET_BYTES", 2000)
    assert {tuple(r) for r in jaccard.jaccard_components(docs).collect()} == want


def test_near_duplicates_keep_one(docs, rows):
    left = jaccard.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    ids = {r.doc_id for r in left.select("doc_id").collect()}
    assert -5 in ids and not any(2000 <= i < 2015 for i in ids) and 4001 in ids and 4000 in ids


def brute_substring(rows):
    first, out = {}, {}
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        w = SPACED.findall(t or "")
        gone, mine = [False] * len(w), []
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            if first.get(key, i) < i:
                gone[k : k + 13] = [True] * 13
            mine.append(key)
        for key in mine:
            first.setdefault(key, i)
        kept = " ".join(a for a, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("options", [{}, {"batches": 1}, {"batches": 5, "fanout": 2}, {"batches": 4, "fanout": 9}])
def test_substring_dedup(docs, rows, options, monkeypatch):
    if options:
        monkeypatch.setattr(substring, "BATCHES", options["batches"])
        spans = substring.repeated_spans(docs, **options)
        got = {r.doc_id: sum(e - s for s, e in zip(r.starts, r.ends)) for r in spans.collect()}
        assert got == {i: v[1] for i, v in brute_substring(rows).items() if v[1]}
    else:
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.dedup_report(docs).collect()}
        assert got == brute_substring(rows)


def test_substring_without_broadcast(docs, rows, monkeypatch):
    monkeypatch.setattr(substring, "BROADCAST_BYTES", 0)
    got = {r.doc_id: r.kept_sha256 for r in substring.dedup_report(docs).collect()}
    assert got == {i: v[2] for i, v in brute_substring(rows).items()}


def test_incremental_index_equals_one_batch(spark, rows):
    index = substring.FingerprintIndex(spark, bits=2, fanout=2)
    found = {}
    keyed = sorted((r for r in rows if r[1] is not None), key=lambda r: r[0])
    for k in range(0, len(keyed), 60):
        df = spark.createDataFrame([(r[0], 0, r[1]) for r in keyed[k : k + 60]], "doc_id long, tag long, text string")
        found |= {r.doc_id: sum(e - s for s, e in zip(r.starts, r.ends)) for r in index.add(df).collect()}
        index.compact()
        assert len(index.paths) <= 1
    assert found == {i: v[1] for i, v in brute_substring(rows).items() if v[1]}


def test_index_is_opened_again_by_another_session(spark, rows, tmp_path):
    """Batches in sessions of their own, each from the path alone, find what one batch finds; a batch that failed adds nothing."""
    path = "file://" + str(tmp_path / "index")
    with pytest.raises(FileNotFoundError):
        substring.FingerprintIndex.open(spark, path)
    ordered = sorted(rows, key=lambda r: r[0])
    found, sizes = {}, []
    for k in range(0, len(ordered), 50):
        session = spark.newSession()
        spans = substring.repeated_spans(session.createDataFrame(ordered[k : k + 50], SCHEMA), batches=1, path=path)
        found |= {r.doc_id: sum(e - s for s, e in zip(r.starts, r.ends)) for r in spans.collect()}
        sizes.append(substring.FingerprintIndex.open(session, path).batches)
        # what a lost driver leaves behind: a run that no manifest names
        session.createDataFrame([(0, b"junk")], "bucket long, a binary").write.parquet(f"{path}/runs/batch-{k}-lost")
    assert found == {i: v[1] for i, v in brute_substring(rows).items() if v[1]}
    assert sizes == list(range(1, len(sizes) + 1)) and len(list((tmp_path / "index" / "manifests").glob("*.json"))) == 1


def test_dropping_passages_rewrites_texts(docs, rows):
    out = substring.drop_repeated_passages(docs)
    assert out.columns == docs.columns
    got = {r.doc_id: r for r in out.collect()}
    want = brute_substring(rows)
    for i, t, *_ in rows:
        n, gone, sha = want[i]
        if gone == 0:
            assert got[i].text == t
        elif gone == n:
            assert i not in got
        else:
            assert hashlib.sha256(got[i].text.encode()).hexdigest() == sha and got[i].n_chars == len(got[i].text)


ITEMS = [(1, "w1 w2 w3"), (2, None), (3, ""), (4, "ONE"), (5, " ".join(f"w{i}" for i in range(30)))]


def test_decontamination(spark, docs, rows):
    planted = [(5000, "Start " + " ".join(f"W{i}" for i in range(4, 20)) + "! end", "en", "s", 1), (5001, "pad " * 900 + "w1, w2; w3", "en", "s", 1)]
    bench = [*ITEMS, (6, rows[3][1])]
    df = docs.select("doc_id", "text", "lang", "source", "n_chars").union(spark.createDataFrame(planted, SCHEMA))
    items = spark.createDataFrame(bench, "item_id long, text string")
    windows = collections.defaultdict(set)
    for i, t in bench:
        w = LETTERS.findall(lower(t or ""))
        for k in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[k : k + 13])].add(str(i))

    def brute(t):
        w = LETTERS.findall(lower(t or ""))
        hit, found = [False] * len(w), set()
        for win, own in windows.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    found |= own
                    hit[k : k + len(win)] = [True] * len(win)
        n = sum(hit)
        return len(w), n, len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), n > 0 and 20 * n >= len(w)

    report = decontaminate.decontamination_report(df, items).collect()
    texts = {r[0]: r[1] for r in [*rows, *planted]}
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in report} == {i: brute(t) for i, t in texts.items()}
    for r in report:  # offsets are of the text as it is
        for s, e in zip(r.span_starts, r.span_ends):
            assert LETTERS.findall(lower(texts[r.doc_id][s:e]))
    assert sum(len(LETTERS.findall(lower(texts[r.doc_id][s:e]))) for r in report for s, e in zip(r.span_starts, r.span_ends)) == sum(r.n_hit for r in report)
    kept = {r.doc_id for r in decontaminate.decontaminate(df, items).select("doc_id").collect()}
    assert kept == {r.doc_id for r in report if r.n_hit == 0}
    cut = decontaminate.decontaminate(df, items, cut=True)
    assert {r.doc_id for r in cut.select("doc_id").collect()} == {r.doc_id for r in report if not r.contaminated}
    for left in (decontaminate.decontaminate(df, items), cut):  # nothing of the benchmark is left
        assert decontaminate.decontamination_report(left, items).where("n_hit > 0").count() == 0


def test_kept_documents_lose_benchmark_passages(spark):
    """Hits under 5 % of a document are cut out; nothing else of it changes."""
    item = " ".join(f"W{i}" for i in range(20))
    a, b = "Ünder 𝄞 pad, " * 200, " and, more pad" * 200 + " "
    rows = [(1, f"{a}{item}{b}{item.upper()}!", "en", "s", 1), (2, a, "en", "s", 7), (3, item, "en", "s", 1), (4, None, None, None, None)]
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: (r.text, r.n_chars) for r in decontaminate.decontaminate(spark.createDataFrame(rows, SCHEMA), items, cut=True).collect()}
    assert got == {1: (f"{a}{b}!", len(f"{a}{b}!")), 2: (a, 7), 4: (None, None)}


def test_decontamination_in_shards(spark, docs, monkeypatch):
    """Three and more shards find what one automaton finds, and no more than one shard's items go to the driver at a time."""
    items = spark.createDataFrame([*ITEMS, (7, "alpha Beta"), (8, "kappa"), (9, "w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15")], "item_id long, text string")
    df = docs.withColumn("__key", F.lit(1)).withColumn("__found", F.lit(2)).withColumn("key", F.lit(3)).withColumn("t", F.lit(4))
    df = df.unionByName(df.where("doc_id < 40"))
    pick = lambda: sorted((r.doc_id is None, r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, tuple(r.span_starts), tuple(r.span_ends)) for r in decontaminate.decontamination_report(df, items).collect())
    want, sizes = pick(), []
    build = decontaminate.scan_column

    def watched(rows, *rest):
        sizes.append(sum(len(t) for _, t in rows))
        return build(rows, *rest)

    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 60)
    monkeypatch.setattr(decontaminate, "scan_column", watched)
    assert pick() == want and len(sizes) >= 3 and sum(sizes) == sum(len((r.text or "").encode()) for r in items.collect())
    left = decontaminate.decontaminate(df, items)
    assert left.columns == df.columns and left.count() == sum(r[3] == 0 for r in want)


CLASHES = ["__l1", "__e0", "__e1", "__lang1", "__edges2", "__salt1", "__d", "__t", "__span", "__scan", "__counts", "__kept", "root", "rep", "class", "hashes", "map", "bucket", "block", "kind", "f", "r", "starts", "tag", "key", "level"]


@pytest.mark.parametrize("operator", ["quality", "salted quality", "jaccard", "substring", "substring join", "decontaminate"])
def test_clashing_names_pass_through(spark, docs, operator, monkeypatch):
    """Columns with the names that operators use themselves are neither used nor lost."""
    base = docs.select("doc_id", "text", "lang", "source", "n_chars")
    wide = base.select("*", *[F.lit(c).alias(c) for c in CLASHES])
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    if operator == "salted quality":
        monkeypatch.setattr(quality, "MAX_BROADCAST_ROWS", 0)
    if operator == "substring join":
        monkeypatch.setattr(substring, "BROADCAST_BYTES", 0)
    run = {"quality": quality.quality_filter, "jaccard": jaccard.drop_near_duplicates, "substring": substring.drop_repeated_passages, "decontaminate": lambda d: decontaminate.decontaminate(d, items)}[operator.split()[-1] if operator.startswith("salted") else operator.split()[0]]
    plain, kept = run(base), run(wide)
    assert kept.columns == wide.columns
    rows = kept.collect()
    assert all(r[c] == c for r in rows for c in CLASHES)
    assert sorted((r.doc_id, r.text or "") for r in rows) == sorted((r.doc_id, r.text or "") for r in plain.collect())


def test_very_long_texts_go_piece_by_piece(spark):
    """Texts of several MiB, beyond what is hashed or tokenized at once, give what their words say."""
    rng = random.Random(3)
    words = [f"w{rng.randrange(5000)}" for _ in range(420_000)]
    long = " ".join(words) + " Ünder " + "z" * 3000
    near = " ".join(words[:200] + ["changed"] + words[201:]) + " Ünder " + "z" * 3000
    rows = [(1, long, "en", "s", 0), (2, near, "en", "s", 0), (3, " ".join(words[100_000:100_050]) + " own words here", "en", "s", 0), (4, None, "en", "s", 0)]
    assert len(long) > 4 * (1 << 19)
    df = spark.createDataFrame(rows, SCHEMA)
    sets = {i: shingles(t) for i, t, *_ in rows}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df).collect()}
    assert got == {1: (len(sets[1]), 1), 2: (len(sets[2]), 1), 3: (len(sets[3]), 3), 4: (0, 4)}
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.dedup_report(df).collect()} == brute_substring(rows)
    n = collections.Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    counts = {r.doc_id: r for r in quality.quality_report(df).collect()}
    assert counts[1].n_words == len(words) + 2 and counts[1].word_chars == sum(map(len, SPACED.findall(long))) and counts[1].n_repeat_words >= sum(v > 1 for v in n.values())
    ids = whole_ids(rows)
    for r in packing.pack_documents(df).where("start = 0").collect():
        assert r.doc_tokens == len(ids[r.doc_id]) + 1
    at = 0
    for i in sorted(ids):
        x = np.append(ids[i], np.uint32(1)).astype("<u4")
        ids[i] = (at, len(x), zlib.crc32(x.tobytes()))
        at += len(x)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in idfiles.written_and_read(df).collect()} == ids


def whole_ids(rows):
    t = Tokenizer.from_file(tokens.default_path())
    return {r[0]: np.array(e.ids, "<u4") for r, e in zip(rows, t.encode_batch([r[1] or "" for r in rows], add_special_tokens=False))}


@pytest.mark.parametrize("most", [4096, 64])
def test_packing(docs, rows, most):
    want = whole_ids(rows)
    by = collections.defaultdict(list)
    seen = set()
    for r in packing.pack_documents(docs, most=most).collect():
        by[r.doc_id].append(r)
        assert r.length & (r.length - 1) == 0 and r.length <= most and r.offset == 0 and r.sequence_id not in seen
        seen.add(r.sequence_id)
    for i, ids in want.items():
        ids = np.append(ids, np.uint32(2)).astype("<u4")
        at = 0
        for r in sorted(by[i], key=lambda r: r.start):
            part = ids[at : at + r.length]
            assert r.start == at and r.doc_tokens == len(ids) and r.ids == part.tolist() and r.ids_crc32 == zlib.crc32(part.tobytes())
            at += r.length
        assert at == len(ids)


def test_pieces_are_binary():
    for n in range(1, 300):
        p = packing.pieces(n, 64)
        assert sum(x for _, x in p) == n and len([x for _, x in p if x < 64]) == bin(n % 64).count("1")


@pytest.mark.parametrize("chunk", [6_000_000, 500])
def test_id_files_round_trip(docs, rows, chunk, monkeypatch):
    monkeypatch.setattr(idfiles, "CHUNK", chunk)
    monkeypatch.setattr(idfiles, "RANGE_BYTES", 20_000)
    want, at, ids = {}, 0, whole_ids(rows)
    for i in sorted(ids):
        x = np.append(ids[i], np.uint32(1)).astype("<u4")
        want[i] = (at, len(x), zlib.crc32(x.tobytes()))
        at += len(x)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in idfiles.written_and_read(docs).collect()} == want


def test_quality_base_counts(docs, rows):
    def brute(t):
        t = t or ""
        w = SPACED.findall(t)
        lines = [x for x in t.split("\n") if SPACED.search(x)]
        c = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        inside = [False] * len(w)
        for k in range(len(w) - 4):
            if c[tuple(w[k : k + 5])] > 1:
                inside[k : k + 5] = [True] * 5
        n = sum(inside)
        return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), n, len(w) < 10 or 100 * n > 20 * len(w)

    report = quality.quality_report(docs).collect()
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in report} == {r[0]: brute(r[1]) for r in rows}
    assert not any(r.kept and r.base_failed for r in report)
    kept = quality.quality_filter(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {r.doc_id for r in report if r.kept}


def test_adaptive_fences_follow_the_group(spark):
    """A rate that is usual in one source is junk in another; fences agree with exact quartiles."""
    words = [f"word{i}" for i in range(40)]
    plain = lambda k: " ".join(words[k % 7 : k % 7 + 20])
    marked = lambda k: " # ".join(words[k % 7 : k % 7 + 20])
    rows = [(i, plain(i) + f" a{i}", "en", "clean", 0) for i in range(300)] + [(1000 + i, marked(i) + f" a{i}", "en", "code", 0) for i in range(300)] + [(5000, marked(1), "en", "clean", 0)]
    got = {r.doc_id: r.kept for r in quality.quality_report(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not got[5000] and all(v for k, v in got.items() if k != 5000)


def test_fences_follow_spread_of_each_rate(spark):
    """Rates that the sketch shows as outliers go, though small; rates that a tenth of a group have stay."""
    rng = random.Random(6)
    line = lambda: " ".join(rng.choice("bcdfg") + rng.choice("aeiou") + str(rng.randrange(100, 999)) for _ in range(3))
    text = lambda again=0: "\n".join(x for lines in [[line() for _ in range(60)]] for x in lines + lines[:again])
    rows = [(i, text(), "en", "once", 0) for i in range(300)] + [(1000, text(5), "en", "once", 0), (1001, text(1), "en", "once", 0), (1002, text() + " #" * 12, "en", "once", 0), (1003, text().replace("b", "B"), "en", "once", 0)]
    rows += [(2000 + i, text(5 if i % 5 == 0 else 0), "en", "often", 0) for i in range(300)]
    got = {r.doc_id: r.kept for r in quality.quality_report(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {k for k, v in got.items() if not v} == {1000, 1002, 1003}


def test_small_groups_keep_their_own_fences(spark):
    """A source is judged by its own rates at 199 texts and at 60, whatever is usual in its language."""
    words = [f"word{i}" for i in range(40)]
    text = lambda k, gap: gap.join(words[k % 7 : k % 7 + 20]) + f" a{k}"
    rows = [(i, text(i, " "), "en", "clean", 0) for i in range(900)] + [(1000 + i, text(i, " # "), "en", "code", 0) for i in range(199)]
    rows += [(2000 + i, text(i, " "), "en", "small", 0) for i in range(60)] + [(3000, text(1, " # "), "en", "small", 0)]
    got = {r.doc_id: r.kept for r in quality.quality_report(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[1000 + i] for i in range(199))
    assert not got[3000]


def test_sketches_merge_and_bound_quantiles(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(["#" if rng.random() < p else f"y{j}" for j in range(200)] + [f"x{j}" for j in range(300)]) for p in rng.random(400) * 0.2]
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    counted = df.withColumn("f", quality.features(df["text"]))
    whole = quality.fences(quality.sketch(counted, "f")).where("level = 2").first()
    halves = [quality.sketch(counted.where(f"doc_id % 2 = {k}"), "f") for k in (0, 1)]
    merged = quality.fences(quality.merge_sketches(*halves)).where("level = 2").first()
    assert whole == merged
    rates = sorted(t.count("#") / len(t.split()) for t in texts if not _repeats(t))
    q1, q3 = rates[len(rates) // 4], rates[3 * len(rates) // 4]
    assert abs(whole.symbol_rate_high - (q3 + max(3 * (q3 - q1), 0.1))) < 0.02


def _repeats(t):
    w = t.split()
    c = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    inside = [False] * len(w)
    for k in range(len(w) - 4):
        if c[tuple(w[k : k + 5])] > 1:
            inside[k : k + 5] = [True] * 5
    return 100 * sum(inside) > 20 * len(w)


def test_license_base_places(docs, rows):
    phrases = {tuple(k.split()): v for k, v in licenses.PHRASES.items()}

    def brute(t):
        w = LETTERS.findall(lower(t or ""))
        at = [(k, label) for p, label in phrases.items() for k in range(len(w) - len(p) + 1) if tuple(w[k : k + len(p)]) == p]
        starts = [k for k, _ in at]
        return len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))

    got = licenses.scan_licenses(docs).collect()
    assert {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got} == {r[0]: brute(r[1]) for r in rows}
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)


def test_license_templates_and_statistics(spark):
    mit = licenses.TEMPLATES["mit"]
    rows = [(1, "Copyright. " + mit.upper() + " x"), (2, mit[: len(mit) // 4]), (3, "pad " + " ".join(w if i % 23 else "changed" for i, w in enumerate(mit.split()))), (4, "nothing here")]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert got[1].labels == "mit" and got[1].score == 1.0 and got[3].labels == "mit" and got[2].labels == "" and got[4].score == 0
    scan = licenses.Scanner(licenses.PHRASES, licenses.NOTICES, licenses.TEMPLATES)
    every = [words for _, words in scan.templates]
    stream = every[0][5:20] + [0] + every[1][3:9] + every[0][:4]
    best = {}
    for at in range(len(stream)):
        for m in range(at + 1, 0, -1):
            run = stream[at + 1 - m : at + 1]
            if any(run == t[k : k + m] for t in every + [[scan.ids[w.encode()] for w in p.split()] for p in (*licenses.PHRASES, *licenses.NOTICES) if all(w.encode() in scan.ids for w in p.split())] for k in range(len(t) - m + 1)):
                best[at] = m
                break
    assert {at: run for at, run, _ in scan.statistics(stream)} == best


def test_license_chains_are_the_best():
    """Runs that overlap, stray ends of a template before it, and chains after a longer one lose nothing."""
    scan = licenses.Scanner({}, {}, licenses.TEMPLATES)
    mit = licenses.TEMPLATES["mit"]
    cut, stray, far = mit.replace("to deal in the software ", ""), "and or sell copies of the software", " pad" * 80
    got = [scan.scan(t.encode()) for t in (cut, stray + " pad " + mit, stray + far + " " + mit, " ".join(mit.split()[:20]) + far + " " + stray)]
    assert [(r["labels"], round(r["score"] * 49)) for r in got] == [("mit", 44), ("mit", 49), ("mit", 49), ("", 20)]
    assert (got[1]["starts"], got[1]["ends"]) == ([8], [57])


def test_license_chains_agree_with_brute_force():
    """Against the longest common subsequence of the words that lie in shared runs."""
    rng = random.Random(8)
    scan = licenses.Scanner({}, {}, {"t": " ".join(f"w{k % 17}" for k in range(40))})
    template = scan.templates[0][1]
    for _ in range(40):
        words = []
        while len(words) < 38:
            a = rng.randrange(36)
            words += template[a : a + rng.randint(3, 14)] + [0] * rng.randint(0, 1)
        pairs = {(i + k, p + k) for i in range(len(words) - 4) for p in range(36) if words[i : i + 5] == template[p : p + 5] for k in range(5)}
        best = np.zeros((len(words) + 1, 41), int)
        for i in range(len(words)):
            for p in range(40):
                best[i + 1, p + 1] = max(best[i, p + 1], best[i + 1, p], best[i, p] + ((i, p) in pairs))
        runs = [at - 4 for at, run, _ in scan.statistics(words) if run >= 5]
        covered, _ = scan._chain(words, runs, 0, template)
        assert covered == best[-1, -1]


def test_empty_tables(spark, empty):
    items = spark.createDataFrame([], "item_id long, text string")
    for df in (jaccard.jaccard_components(empty), jaccard.drop_near_duplicates(empty), substring.dedup_report(empty), substring.drop_repeated_passages(empty), decontaminate.decontamination_report(empty, items), packing.pack_documents(empty), idfiles.written_and_read(empty), quality.quality_report(empty), quality.quality_filter(empty), licenses.scan_licenses(empty)):
        assert df.collect() == []


def test_empty_benchmark(spark, docs):
    items = spark.createDataFrame([], "item_id long, text string")
    assert not any(r.contaminated for r in decontaminate.decontamination_report(docs, items).collect())


def test_null_ids_and_repeated_rows(spark):
    text = " ".join(f"t{i}" for i in range(40))
    rows = [(None, text, None, None, None), (None, None, None, None, None), (1, text, "en", "s", 3), (1, text, "en", "s", 3), (2, text, "en", "s", 3), (1, "other text", "en", "s", 3)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(map(tuple, jaccard.jaccard_components(df).collect()), key=repr)
    assert got == sorted([(None, 0, None), (None, 0, None), (1, 36, 1), (1, 36, 1), (2, 36, 1), (1, 1, 1)], key=repr)
    removed = sorted(((r.doc_id, r.n_words, r.n_removed) for r in substring.dedup_report(df).collect()), key=repr)
    assert removed == sorted([(None, 40, 0), (None, 0, 0), (1, 40, 0), (1, 40, 0), (2, 40, 40), (1, 2, 0)], key=repr)
    assert packing.pack_documents(df).select("doc_id").distinct().count() == 3
    assert idfiles.written_and_read(df).count() == 6
    assert quality.quality_report(df).count() == 6


def test_components_with_hubs(spark, monkeypatch):
    """Stars, chains and both at once, with hubs dealt out by salts, against union-find."""
    from quillgraph.llm import components

    monkeypatch.setattr(components, "HUB", 3)
    rng = random.Random(7)
    edges = [(0, k) for k in range(1, 200)] + [(k, k + 1) for k in range(1000, 1060)] + [(5000, 1030)] + [(5000 + k, 5000) for k in range(1, 90)] + [(rng.randrange(7000, 7100), rng.randrange(7000, 7100)) for _ in range(70)] + [(3, 3), (0, 1), (1, 0)]
    parent = {x: x for e in edges for x in e}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = top(a), top(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long"))[0].collect()}
    assert got == {x: top(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}
