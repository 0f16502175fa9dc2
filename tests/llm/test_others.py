"""URLs, conversations, toxicity and the pipeline."""

import collections
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import chat, queries, toxicity, urls


def brute_url(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    k = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host, tail = rest[:k].translate({c: c + 32 for c in range(65, 91)}), rest[k:]
    path = tail[: next((i for i, c in enumerate(tail) if c in "?#"), len(tail))]
    best = None
    for verdict, h, p in urls.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return (host, path, *(best or (None, None)))


def test_urls(spark):
    rng = random.Random(2)
    made = [f"http{rng.choice(['', 's'])}://{rng.choice(['www.', 'M.', ''])}site{rng.randrange(30)}.{rng.choice(['example.net', 'Example.com', 'example.org', 'net'])}/{rng.choice(['en', 'de', 'fr', ''])}/{rng.randrange(99)}" for _ in range(800)]
    made += [None, "", "no scheme", "://", "http://", "http://net", "http://net/", "http://NET/?q", "x://a.net#f/en/", "ftp://example.net/en/?a://b", "http://notexample.net/en/x", "http://fr.org/fr/", "http://a.b\n.net/en/\nx?y", "http://é.example.com/de/ü"]
    rows = [(i, u, "<html>") for i, u in enumerate(made)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = {r.page_id: r for r in urls.judge(df).collect()}
    for i, u, _ in rows:
        host, path, rule, verdict = brute_url(u)
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, rule), u
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")
    spam = [got[i].score for i, u, _ in rows if brute_url(u)[3] == "block"]
    good = [got[i].score for i, u, _ in rows if brute_url(u)[3] == "allow"]
    assert np.mean(spam) > np.mean(good)
    kept = [got[i] for i, u, _ in rows if brute_url(u)[3] == "allow"]
    assert np.mean([r.score > r.threshold for r in kept]) < 0.05


def brute_model(urls_):
    """log p of each byte of a URL, by counting strings: Witten-Bell from order 0 to order 4."""
    pairs, after = collections.Counter(), collections.defaultdict(set)
    for u in urls_:
        b = u.encode()
        for i, c in enumerate(b):
            for k in range(5):
                context = (k, b[max(0, i - k) : i] if k <= i else b"^" * (k - i) + b[:i])
                pairs[context, c] += 1
                after[context].add(c)
    total = collections.Counter()
    for (context, _), n in pairs.items():
        total[context] += n

    def log_p(u):
        b, out = u.encode(), 0.0
        for i, c in enumerate(b):
            p = 1 / 256
            for k in range(5):
                context = (k, b[max(0, i - k) : i] if k <= i else b"^" * (k - i) + b[:i])
                if total[context]:
                    p = (pairs[context, c] + len(after[context]) * p) / (total[context] + len(after[context]))
            out += np.log(p)
        return out

    return log_p


def test_url_scores_equal_a_counted_model(spark):
    rng = random.Random(12)
    made = [f"http{rng.choice(['', 's'])}://s{rng.randrange(12)}.{rng.choice(['example.net/en', 'example.com/de', 'example.org/fr', 'net', 'é.io'])}/{rng.randrange(999)}" for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(made)), "page_id long, url string").withColumn("score", F.lit("clash"))
    fold = {r.page_id: r.f for r in df.select("page_id", (F.pmod(F.xxhash64("url"), F.lit(urls.FOLD)) == 0).alias("f")).collect()}
    kind = {i: brute_url(u)[3] for i, u in enumerate(made)}
    good, bad = (brute_model([u for i, u in enumerate(made) if kind[i] == v and not fold[i]]) for v in ("allow", "block"))
    want = {i: (bad(u) - good(u)) / len(u.encode()) for i, u in enumerate(made)}
    got = {r.page_id: r for r in urls.judge(df).collect()}
    assert all(abs(got[i].score - want[i]) < 1e-9 for i in want)
    limit = max(0.0, np.sort([want[i] for i in want if fold[i] and kind[i] == "allow"])[-1])
    for i in want:
        if kind[i] is None:
            assert got[i].verdict == ("block" if want[i] > got[i].threshold else "allow")
    assert 0 <= got[0].threshold <= limit + 1e-9


def test_urls_without_held_out_accepted_ones_are_allowed(spark):
    """No accepted URL outside the counts: the threshold is infinite, and all that no rule judges is allowed."""
    made = [f"http://a{i}.example.org/fr/{i}" for i in range(40)] + [f"http://b{i}.net/x" for i in range(40)] + [f"http://c{i}.io/net/net" for i in range(9)]
    df = spark.createDataFrame(list(enumerate(made)), "page_id long, url string")
    kept = df.where((F.pmod(F.xxhash64("url"), F.lit(urls.FOLD)) != 0) | ~F.col("url").contains("example.org"))
    got = urls.judge(kept).collect()
    assert {r.threshold for r in got} == {float("inf")} and all(r.verdict == "allow" for r in got if r.rule is None)


def test_urls_without_labels(spark):
    df = spark.createDataFrame([(1, "http://a.io/"), (2, None)], "page_id long, url string")
    assert {r.verdict for r in urls.judge(df).collect()} == {"allow"}
    assert urls.judge(df.where("page_id > 9")).collect() == []


def test_url_model_probabilities_sum_to_one(spark):
    df = spark.createDataFrame([(k % 2, f"http://a{k % 7}.net/x{k}") for k in range(200)], "class int, url string")
    model = urls.fit(df)
    import pyarrow as pa

    prefix = b"http://a1"
    total = 0.0
    for c in range(256):
        (_, _, slots), = urls.contexts(pa.array([prefix + bytes([c])], pa.binary()))
        total += float(np.exp(model.log_probability(1, slots)[-1]))
    assert abs(total - 1) < 0.1  # hashing may let contexts share counters


def test_url_model_is_exact_beyond_any_table_size(spark, monkeypatch):
    """Probabilities sum to one with over 32,768 contexts, and shards of the counts give the same scores."""
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    made = [f"http://{word(9)}.{rng.choice(['example.net/en', 'example.com/de', 'example.org'])}/{word(20)}" for _ in range(6000)]
    model = urls.fit(spark.createDataFrame([(k % 2, u) for k, u in enumerate(made)], "class int, url string"))
    import pyarrow as pa

    for prefix in [u[: 12 + k % 9].encode() for k, u in enumerate(made[:20])]:
        found = [next(urls.contexts(pa.array([prefix + bytes([c])], pa.binary())))[2] for c in range(256)]
        assert abs(sum(np.exp(model.log_probability(1, slots)[-1]) for slots in found) - 1) < 1e-9
    df = spark.createDataFrame(list(enumerate(made)), "page_id long, url string")
    whole = {r.page_id: r for r in urls.judge(df).collect()}
    monkeypatch.setattr(urls, "MAX_PAIRS", 100_000)
    for r in urls.judge(df).collect():
        assert abs(r.score - whole[r.page_id].score) < 1e-9 and abs(r.threshold - whole[r.page_id].threshold) < 1e-9


TALK = [
    (1, 0, "user", "Hello there!\nHow are you?"), (1, 1, "assistant", "> hello there\nHi. I am fine.\nThanks"), (1, 2, "user", "> Hi.  I am fine\n>> Hello there\nGood"), (1, 3, "user", "no quote"),
    (1, 4, "user", ">>> how are you\n>nothing known\nx"), (2, 0, "user", "Hello there!"), (2, 1, "user", "> Hi. I am fine.\nq"), (2, 2, None, None), (None, 1, "user", "> x"), (3, 1, "u", "a\n\n"), (3, 1, "u", "> a"),
    (3, 2, "u", ">a\n> \n\nb"), (1, 5, "user", "> Hi. I am fine.\n> Thanks\nok"), (1, 5, "user", "> Good\nok2"), (1, 6, "u", "> ok2\n\n>ok\n"), (4, None, "u", "> a"), (5, 3, "u", ""), (5, 3, "u", ""),
]


def test_quotes(spark):
    df = spark.createDataFrame(TALK, "conv_id long, turn long, role string, text string").withColumn("tag", F.lit(1)).withColumn("path", F.lit("clash"))
    got = sorted(map(tuple, chat.format_chats(df).collect()), key=repr)
    con = duckdb.connect()
    con.register("conversations", df.select("conv_id", "turn", "role", "text").toArrow())
    assert got == sorted(con.execute(chat.ORACLE).fetchall(), key=repr)
    by = {(r[0], r[1], r[3]): r for r in got}
    assert by[1, 2, "Good"][4] == 1 and by[1, 2, "Good"][8] == "0/1/2" and by[1, 6, ""][8] == "0/1/2/5/6"
    assert chat.format_chats(df.limit(0)).collect() == []


def test_paragraphs_quoted_in_part_link(spark):
    """Re-wrapped paragraphs of a longer message link, with their count; other results stay."""
    first = "One two three four five six.\n\nSeven eight nine\nten eleven.\n\nTwelve thirteen."
    reply = "> One two three\n> four five six.\n>\n> Seven eight\n> nine ten\n> eleven.\nI agree."
    rows = [(1, 0, "u", first), (1, 1, "u", reply), (2, 0, "u", "P1 a b\nP2 c d\nP3 e f"), (2, 1, "u", "> P1 a\n> b\n>\n> P2\n> c d\nyes"), (3, 0, "u", "a b\n\nc d"), (3, 1, "u", "> a b\n>\n> c d\nall")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): (r.reply_to, r.n_linked, r.path) for r in chat.format_chats(df, partial=True).collect()}
    assert all(got[k, 1] == (0, 2, "0/1") and got[k, 0] == (None, 0, "0") for k in (1, 2, 3))


def test_long_reply_chain(spark):
    rows = [(1, 0, "u", "word0")] + [(1, k, "u", f"> word{k - 1}\nword{k}") for k in range(1, 40)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.turn: r for r in chat.format_chats(df).collect()}
    assert all(got[k].depth == k and got[k].path == "/".join(map(str, range(k + 1))) and got[k].body == f"word{k}" for k in range(40))
    ordered = [r.turn for r in chat.in_reply_order(chat.format_chats(df), 1).collect()]
    assert ordered == list(range(40))


def test_chat_is_native(spark):
    df = spark.createDataFrame(TALK, "conv_id long, turn long, role string, text string")
    plan = chat.format_chats(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def toxic_corpus(n=900):
    rng = random.Random(4)
    bad = {"en": ["idiot", "scum"], "de": ["achlichkeiten", "achlichungen", "achlichsten"]}
    rows, labels = [], []
    for i in range(n):
        lang = rng.choice(["en", "de"])
        words = [f"{lang}{rng.randrange(200)}" for _ in range(rng.randint(5, 60))]
        toxic = rng.random() < 0.2
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(bad[lang]))
        rows.append((i, " ".join(words), lang, "s", 0))
        if rng.random() < 0.7:
            labels.append((i, 1, int(toxic)))
    rows += [(n, None, None, None, None), (n + 1, "", "en", "s", 0), (n + 2, "word " * 600_000 + "idiot scum idiot", "en", "s", 0), (n + 3, "word " * 100, "en", "s", 0)]
    labels += [(n + 99, 0, 1), (3, None, None), (None, 1, 1)]
    return rows, labels


def test_toxicity(spark):
    rows, labels = toxic_corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score_documents(docs, lab).collect()}
    assert len(got) == len(rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    held = [(got[i].predicted, t) for i, _, t in labels if i in got and t is not None and got[i].held_out]
    assert np.mean([p == t for p, t in held]) > 0.9
    assert got[902].predicted == 1 and got[903].predicted == 0  # the end of a very long text counts
    assert got[900].score == got[901].score


def test_scores_are_those_of_a_plain_forward_pass():
    """The scorer of many texts at a time against loops over words, filters and positions, very long texts among them."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    texts = ["", "one", "a b", " ".join(f"w{rng.integers(40)}" for _ in range(60)), "Longerword longerwords longest", "x " * 700_000 + "w1 w2 w3"] + [" ".join(f"w{rng.integers(40)}" for _ in range(rng.integers(1, 9))) for _ in range(30)]
    hashes = [toxicity.word_hashes(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[1] for t in texts]
    model = toxicity.Convolution(toxicity.Words(hashes, min_docs=2))
    model.embedding[1:] = rng.normal(0, 1, model.embedding[1:].shape)
    for b in (*model.banks, *model.bias):
        b[:] = rng.normal(0, 1, b.shape)
    model.out, model.base, model.shift, model.scale = rng.normal(0, 1, model.out.shape).astype(np.float32), np.float32(0.3), 0.1, 0.7

    def plain(rows):
        x = [sum(model.embedding[r].astype(float) for r in word) for word in rows]
        best = []
        for w, bank, bias in zip(toxicity.WIDTHS, model.banks, model.bias):
            for f in range(toxicity.FILTERS):
                values = [float(bias[f]) + sum(float(x[at + k] @ bank[k, :, f]) for k in range(w) if at + k < len(x)) for at in range(max(1, len(x)))]
                best.append(max(0.0, max(values)))
        z = float(np.dot(best, model.out)) + float(model.base)
        return 1 / (1 + np.exp(-(z - model.shift) * model.scale))

    got = toxicity.Scorer(model).scores(pa.array(texts)).to_pylist()
    short = [i for i, t in enumerate(texts) if len(t) < 10_000]
    assert all(abs(got[i] - plain(model.words(hashes[i]))) < 1e-5 for i in short)
    # of the very long one the middle repeats, so a shorter one has the same windows
    assert abs(got[5] - plain(model.words(toxicity.word_hashes(*(lambda b: (b, np.array([0, len(b)])))(np.frombuffer(b"x x x x x w1 w2 w3", np.uint8)))[1]))) < 1e-5


def test_toxicity_trains_alike_with_repeated_ids_and_clashing_names(spark):
    rows, labels = toxic_corpus(300)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    twice = [*rows, *[(i, t and t + " zz", *rest) for i, t, *rest in rows]]
    df = lambda r: spark.createDataFrame(r, "doc_id long, text string, lang string, source string, n_chars long").withColumn("toxic", F.lit(1)).withColumn("hashes", F.lit("x"))
    a, b = ({(r.doc_id, r.score) for r in toxicity.score_documents(df(r), lab).collect()} for r in (twice, list(reversed(twice))))
    assert a == b


@pytest.mark.parametrize("labels", [[], [(1, 1, 0), (2, 1, 0)]])
def test_toxicity_without_both_labels(spark, labels):
    docs = spark.createDataFrame([(i, "a b", "en", "s", 0) for i in range(4)], "doc_id long, text string, lang string, source string, n_chars long")
    got = toxicity.score_documents(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == 4 and {r.predicted for r in got} == {0}


def test_registered_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("benchmark", "conversations", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, folder)
        result = con.execute(sql)
        names = [d[0] for d in result.description]
        assert sorted(names) == sorted(df.columns)
        assert sorted(map(tuple, df.select(*names).collect()), key=repr) == sorted(result.fetchall(), key=repr)


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, folder).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns and 0 < docs.count() <= before
        before = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert packed.select("doc_id").distinct().count() == before
    assert corpus_pipeline.run(spark, folder).count() == packed.count()
    assert len(corpus_pipeline.STAGES) == 5


def test_pipeline_equals_its_stages_in_sql_and_loops(spark):
    """All of run()'s rows against SQL for the first four stages, and a tokenizer and a loop for the last."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    from quillgraph.llm import oracles, tokens

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE TABLE {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    keep = lambda sql: con.execute(f"CREATE OR REPLACE TABLE documents AS {sql}")
    sizes = [con.execute("SELECT count(*) FROM documents").fetchone()[0]]
    texts = oracles.OP7.replace("sha256(coalesce(kept, ''))", "coalesce(kept, '')")
    assert texts != oracles.OP7
    for sql in (
        f"SELECT d.* FROM documents d JOIN ({oracles.OP9}) q USING (doc_id) WHERE q.kept",
        f"SELECT d.* FROM documents d JOIN ({oracles.OP10}) q USING (doc_id) WHERE component_id = doc_id",
        f"SELECT d.* REPLACE (CASE WHEN n_removed > 0 THEN kept_sha256 ELSE text END AS text) FROM documents d JOIN ({texts}) q USING (doc_id) WHERE n_removed = 0 OR kept_sha256 <> ''",
        f"SELECT d.* FROM documents d JOIN ({oracles.OP4}) q USING (doc_id) WHERE n_hit = 0",
    ):
        keep(sql)
        sizes.append(con.execute("SELECT count(*) FROM documents").fetchone()[0])
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] > sizes[4] > 0
    rows = con.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall()
    tokenizer, want = Tokenizer.from_file(tokens.default_path()), set()
    for (doc_id, _), e in zip(rows, tokenizer.encode_batch([t for _, t in rows], add_special_tokens=False)):
        ids, at = [*e.ids, 2], 0
        while at < len(ids):
            left = len(ids) - at
            length = 4096 if left >= 4096 else 1 << left.bit_length() - 1
            want.add((doc_id, at, length, zlib.crc32(np.array(ids[at : at + length], "<u4").tobytes()), len(ids)))
            at += length
    from quillgraph.sources import storage

    since = len(storage.made())
    packed = corpus_pipeline.run(spark, folder)
    left = [p.rsplit("/", 1)[1] for p in storage.made()[since:] if storage.exists(spark, p)]
    assert len(left) == 1 and left[0].startswith("benchmark_decontamination-")
    got = packed.collect()
    assert {(r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got} == want and len(got) == len(want)


def test_buckets_of_sequences_are_folders(spark, tmp_path):
    from quillgraph.llm import packing

    docs = spark.createDataFrame([(1, "one two three four five"), (2, None)], "doc_id long, text string")
    packing.write_buckets(packing.pack_documents(docs), str(tmp_path / "s"))
    lengths = {int(p.name.split("=")[1]) for p in (tmp_path / "s").glob("length=*")}
    read = spark.read.parquet(str(tmp_path / "s"))
    assert 1 in lengths and read.count() == packing.pack_documents(docs).count() and all(len(r.ids) == r.length for r in read.collect())
