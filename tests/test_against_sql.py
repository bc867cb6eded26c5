"""Queries on small made tables against their SQL in DuckDB."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from loomgraph.operators import merge
from loomgraph.plans import graph_catalog, run_catalog
from loomgraph.sources import writers


@pytest.fixture
def both(spark, tmp_path):
    def run(name, **tables):
        db = duckdb.connect()
        for table, rows in tables.items():
            rows.to_parquet(f"{tmp_path}/{table}.parquet", index=False)
            db.execute(f"create view {table} as select * from '{tmp_path}/{table}.parquet'")
        want = db.execute(f"select * from ({driver.oracle_sql()[name]})").fetchall()
        got = driver.queries()[name](spark, str(tmp_path)).collect()
        plain = lambda v: round(v, 9) if isinstance(v, float) else v
        listed = lambda rows: sorted((tuple(plain(v) for v in r) for r in rows), key=repr)
        return listed(got), listed(want)

    return run


@pytest.mark.parametrize(("name", "edge"), [("band_pairs", 0.2), ("band_pairs", 0.3), ("cosine_pairs", 0.3)])
def test_pairs_count_by_their_rounded_score(both, name, edge):
    cosines = [edge - 2e-7, edge - 8e-7, edge + 2e-7]
    vectors = [[1.0, 0.0]] + [[c, np.sqrt(1 - c * c)] for c in cosines]
    got, want = both(name, embeddings=pd.DataFrame({"vec_id": range(4), "embedding": vectors, "label": 1}))
    assert got == want and {r[3] for r in got if r[1] == 0} != set()


def _documents(texts):
    n = len(texts)
    return pd.DataFrame({"doc_id": range(n), "text": texts, "lang": "en", "source": "s", "n_chars": [len(t) for t in texts]})


@pytest.mark.parametrize("name", ["online_registry", "fusion_mapping", "hybrid_pairs", "aligned_entities"])
def test_names_that_end_like_companies(both, name):
    texts = ["Alpha beta co and more", "Alpha beta Co. and more", "gamma delta inc and so on", "Alpha betaco rest of it", "gamma delta ltd and so on", "co inc ltd more words"] * 3
    got, want = both(name, documents=_documents(texts))
    assert got == want and got


def test_evidence_of_edges_that_fall_together(both):
    suppliers = pd.DataFrame({"s_suppkey": range(1, 200), "s_nationkey": [k % 2 for k in range(1, 200)], "s_name": [f"S{k}" for k in range(1, 200)]})
    customers = pd.DataFrame({"c_custkey": range(1, 30), "c_nationkey": [k % 2 for k in range(1, 30)], "c_name": [f"C{k}" for k in range(1, 30)]})
    nations = pd.DataFrame({"n_nationkey": [0, 1], "n_name": ["A", "B"]})
    got, want = both("fusion_edges", supplier=suppliers, customer=customers, nation=nations)
    assert got == want and max(len(r[5]) for r in got if r[2] == "hasRisk") > 1


def test_keywords_of_texts_not_of_roles(both):
    # 200 more frequent words, then some that a role holds
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}xx" for i in range(200)]
    others = [f"other{chr(97 + i)}" for i in range(25)]
    docs = _documents([" ".join(words * 3 + ["assist", "user", "plainword"] + others)])
    talks = pd.DataFrame({"conv_id": [1, 1, 2, 2, None], "turn": [0, 1, 0, 0, 0], "role": ["user", "assistant", "user", "user", "user"], "text": ["nothing", None, "plainword", "assist", "assist"]}).astype({"conv_id": "Int64"})
    got, want = both("taxonomy_keywords", documents=docs, conversations=talks)
    assert got == want and len(got) == 4


def test_names_of_the_first_words(both):
    texts = [" \t lead one two three four five", "one two three four", "one two three four \n", "  one two three ", "\none  two\x0bthree\x0cfour\rfive six seven", "one two\u00a0x three four", "", None, "    ", "x two three four", "ab two three four five six seven eight"]
    got, want = both("wide_entities", documents=_documents([t or "" for t in texts]).assign(text=texts))
    assert got == want and len(got) > 8


def test_mentions_are_worked_out_once(spark, both, monkeypatch):
    made, real = spark.sparkContext.accumulator(0), run_catalog._mentions

    def counted(parts):
        for part in parts:
            made.add(part.num_rows)
            yield part

    def mentions(spark, sf_dir):
        rows = real(spark, sf_dir)
        return rows.mapInArrow(counted, rows.schema)

    monkeypatch.setattr(run_catalog, "_mentions", mentions)
    got, want = both("aligned_entities", documents=_documents([f"alpha{i % 5} beta gamma delta{i}" for i in range(20)]))
    assert got == want and made.value == 40


def test_triples_are_told_apart_in_bounded_tasks(spark, both, tmp_path, monkeypatch):
    monkeypatch.setattr(writers, "TASK_ROWS", 100, raising=False)
    suppliers = pd.DataFrame({"s_suppkey": range(1, 60), "s_nationkey": [k % 2 for k in range(1, 60)], "s_name": [f"S{k}" for k in range(1, 60)]})
    customers = pd.DataFrame({"c_custkey": range(1, 400), "c_nationkey": [k % 2 for k in range(1, 400)], "c_name": [f"C{k}" for k in range(1, 400)]})
    nations = pd.DataFrame({"n_nationkey": [0, 1], "n_name": ["A", "B"]})
    got, want = both("triples", supplier=suppliers, customer=customers, nation=nations)
    assert got == want and got
    nodes, edges = graph_catalog.graph(spark, str(tmp_path))
    meta = nodes.groupBy("event_id").agg(F.lit(None).cast("string").alias("first_seen"), F.lit(None).cast("string").alias("last_seen"), F.count("*").alias("report_count"))
    rows = writers.triples(nodes, edges, merge.statements(edges), meta)
    parts = rows.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in parts) == rows.count() > 2000 and max(r["count"] for r in parts) < 200
    # twice the same rows make no more triples
    again = writers.triples(nodes.union(nodes), edges.union(edges), merge.statements(edges), meta)
    assert again.count() == rows.count()
