"""Grouped Python operators against plain loops, and their invariants."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillgraph.operators import chunk, community, structure, vector


def loop(pieces, least, target, most, drift, like):
    """Chunks as they are told of in words: a list of lists of pieces."""
    chunks, now = [], []
    for i, n in enumerate(pieces):
        size = sum(pieces[j] for j in now)
        if now and size + n > most:
            chunks.append(now)
            now = []
        elif now and size >= target and size >= least and like(i) < drift:
            chunks.append(now)
            now = []
        now = now + [i]
    chunks = chunks + [now] if now else chunks
    total = lambda c: sum(pieces[j] for j in c)
    merged = []
    while chunks:
        c, chunks = chunks[0], chunks[1:]
        if total(c) >= least:
            merged.append(c)
        elif merged and total(merged[-1]) + total(c) <= most:
            merged[-1] = merged[-1] + c
        elif chunks and total(c) + total(chunks[0]) <= most:
            merged.append(c + chunks[0])
            chunks = chunks[1:]
        else:
            merged.append(c)
    return merged


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 800), min_size=1, max_size=14), st.integers(0, 1 << 14))
def test_fold_equals_the_loop(sizes, turns):
    alike = [0.0 if turns >> i & 1 else 1.0 for i in range(len(sizes))]
    got = chunk.numbers(sizes, alike, 120, 450, 800, 0.35)
    want = loop(sizes, 120, 450, 800, 0.35, lambda i: alike[i])
    assert got == [k for k, c in enumerate(want, 1) for _ in c]


def test_small_chunks_join_once():
    # what came of a join forward is not looked at again
    assert chunk.merge_small([50, 50, 700]) == [0, 0, 1]
    assert chunk.merge_small([700, 50, 50]) == [0, 0, 0]
    assert chunk.merge_small([760, 50, 780]) == [0, 1, 2]


def test_long_sentence_keeps_what_waited():
    parts = chunk.split_long("one two. " + "x " * 12 + "end. tail.", 5)
    assert " ".join(parts).split() == ("one two. " + "x " * 12 + "end. tail.").split()
    assert all(len(p.split()) <= 5 for p in parts)


def test_chunks_by_section_equal_the_loop(spark):
    rows = [(s, i, f"w{s * i % 7} " * ((i * 37) % 200 + 1)) for s in range(5) for i in range(9)]
    df = spark.createDataFrame(rows, "section int, para int, text string")
    got = {(r.section, r.chunk): r.token_count for r in chunk.chunks(df, "section").collect()}
    want = {}
    for s in range(5):
        own = [t for a, _, t in rows if a == s]
        # all words of a piece are one word, so neighbours are alike if it is the same (or shares a cell)
        alike = lambda i, own=own: 1.0 if own[i].split()[0] == own[i - 1].split()[0] else 0.0
        for k, c in enumerate(loop([len(t.split()) for t in own], 120, 450, 800, 0.35, alike), 1):
            want[str(s), k] = sum(len(own[j].split()) for j in c)
    assert got == want


def test_pieces_of_a_long_paragraph_have_their_own_topics(spark):
    text = " ".join(["a"] * 500) + ". " + " ".join(["b"] * 500) + ". " + " ".join(["c"] * 500) + "."
    df = spark.createDataFrame([(1, 0, text), (1, 1, " ")], "section int, para int, text string")
    assert [r.token_count for r in chunk.chunks(df, "section").orderBy("chunk").collect()] == [500, 500, 500]
    with pytest.raises(Exception, match="fewer than 40 tokens"):
        chunk.chunks(df.where("para = 2").unionByName(spark.createDataFrame([(2, 0, "too few")], df.schema)), "section", strict=True).collect()


def test_paragraph_modes(spark):
    df = spark.createDataFrame([(1, "A b.\n\n\nC d.\ne")], "id int, text string")
    of = lambda mode: [r.text for r in structure.paragraphs(df, ["id"], mode=mode).orderBy("para").collect()]
    assert of("line") == ["A b.", "C d.", "e"]
    assert of("blank_line") == ["A b.", "C d.\ne"]
    assert of("reference") == ["A b.", "C d. e"]


def test_hashed_embedding_counts_words(spark):
    df = spark.createDataFrame([("a b a",), ("",)], "text string")
    rows = [r[0] for r in df.select(vector.hashed_embedding(F.col("text"), 16)).collect()]
    assert sum(rows[0]) == 3 and max(rows[0]) >= 2 and sum(rows[1]) == 0


def test_top_k_matches_numpy(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(9, v[7].astype(float).tolist())], "qid long, q array<double>")
    got = [r.vec_id for r in vector.top_k(q, df, 5).orderBy("rank").collect()]
    assert got == np.argsort(-(v.astype(float) @ v[7].astype(float)), kind="stable")[:5].tolist()


def test_top_k_keeps_ties_in_order_of_ids(spark):
    df = spark.createDataFrame([(i, [1.0, 0.0] if i % 3 else [2.0, 0.0]) for i in range(40)], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0])], "qid string, q array<double>")
    got = {k: [r.vec_id for r in vector.top_k(q, df.repartition(5), 16).where(F.col("qid") == k).orderBy("rank").collect()] for k in "abc"}
    assert got["a"] == [*range(0, 40, 3), 1, 2] and got["b"] == list(range(16)) and got["c"] == []


def test_index_is_held_against_its_manifest(spark, tmp_path):
    v = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 2.0])], "vec_id long, embedding array<float>")
    path = str(tmp_path / "index")
    with pytest.raises(FileNotFoundError):
        vector.load_index(spark, path)
    assert {r.vec_id: [round(x, 3) for x in r.embedding] for r in vector.ensure_index(v, path).collect()} == {1: [0.6, 0.8], 2: [0.0, 1.0]}
    vector.save_index(v.unionByName(v), path)
    with pytest.raises(ValueError, match="differ in number"):
        vector.load_index(spark, path)
    with pytest.raises(ValueError, match="dimensions"):
        vector.save_index(v.unionByName(spark.createDataFrame([(3, [1.0])], v.schema)), path)


def test_zero_vectors_have_no_direction(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert df.select(vector.cosine(F.col("a"), F.col("b"))).first()[0] == 0.0
    assert df.select(vector.unit(F.col("a"))).first()[0] == [0.0, 0.0]


def test_communities_split_two_cliques(spark):
    edges = [(f"{g}{a}", f"{g}{b}", 1.0) for g in ("x", "y") for a in range(4) for b in range(a)] + [("x0", "y0", 0.1)]
    got = {r.node: r.label for r in community.label_propagation(spark.createDataFrame(edges, "source_id string, target_id string, weight double"), 4).collect()}
    assert len({got[f"x{i}"] for i in range(4)}) == 1 and len({got[f"y{i}"] for i in range(4)}) == 1 and got["x1"] != got["y1"]
