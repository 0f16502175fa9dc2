"""The driver's contract holds without the training-data operators, and exports are what they say."""

import shutil
import subprocess
import sys
import xml.etree.ElementTree as ET
from pathlib import Path

from pyspark.sql import functions as F

from quillgraph import registry
from quillgraph.operators import graph
from quillgraph.sources import io

ROOT = Path(__file__).resolve().parent.parent
TALK = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(len(q), len(s), any(k.startswith('op') and k[2].isdigit() for k in q), 'pipeline' in q)"


def said(folder) -> list[str]:
    run = subprocess.run([sys.executable, "-B", "-c", TALK], cwd=folder, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(folder)}, timeout=120)
    assert run.returncode == 0, run.stderr
    return run.stdout.split()


def test_queries_without_the_llm_folders(tmp_path):
    shutil.copytree(ROOT / "quillgraph", tmp_path / "quillgraph", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    want = [str(len(registry.queries())), str(len(registry.oracle_sql())), "False", "False"]
    assert said(tmp_path) == want
    # the pipeline's file alone, without what it imports, adds nothing
    (tmp_path / "corpus_pipeline.py").write_text("from quillgraph.llm import base\n")
    assert said(tmp_path) == want


def test_graphml_files_are_one_document(spark, tmp_path):
    units = spark.createDataFrame([(i, f"D{i}", i % 2, f"b{i % 2}", "I", "Exile", 'a < b & "c"') for i in range(6)], "at int, unit_id string, parva_number int, parva string, section string, story_phase string, text string")
    nodes, links = graph.property_nodes(units, concepts=()), graph.property_links(units)
    assert graph.ontology_errors(nodes, links).isEmpty()
    io.write_graphml(nodes, links, str(tmp_path / "g"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "g").glob("part-*")))
    tree = ET.fromstring(text)
    space = "{http://graphml.graphdrawing.org/xmlns}"
    assert len(tree.findall(f"{space}graph/{space}node")) == nodes.count() and len(tree.findall(f"{space}graph/{space}edge")) == links.count()
    assert any(d.text == 'a < b & "c"' for d in tree.iter(f"{space}data"))


def test_sweeping_keeps_what_is_named(spark):
    from quillgraph.sources import storage

    since = len(storage.made())
    (a, kept), (b, gone) = (storage.written(spark.range(n), "swept") for n in (3, 4))
    storage.sweep(spark, since, kept)
    assert storage.exists(spark, kept) and not storage.exists(spark, gone) and a.count() == 3 and storage.made()[since:] == [kept]


def test_every_query_has_sql():
    assert sorted(registry.queries()) == sorted(registry.oracle_sql())


def test_numbers_follow_the_order(spark):
    rows = [(f"long-common-prefix-{i % 50}", i % 3, i) for i in range(600)]
    df = spark.createDataFrame(rows, "chunk_id string, sentence_index int, k int")
    got = [r.k for r in graph.number_events(df, "chunk_id", "sentence_index", "k").orderBy("ordinal").select("k", F.col("ordinal")).collect()]
    assert got == [k for _, _, k in sorted(rows)]
