import re

import pytest
from pyspark.sql import functions as F
from test_eval import NODE, node

from loomgraph.functions import encode
from loomgraph.operators import package


def _reports(spark, sizes):
    rows = [(e, f"{e}-{i}", i, t, None, f"text of {t} with Alpha" if i % 2 else "nothing") for e, titles in sizes.items() for i, t in enumerate(titles)]
    return spark.createDataFrame(rows, "event_id string, doc_id string, pos int, title string, summary string, content string")


def _chosen(spark, sizes, names=()):
    docs = _reports(spark, sizes)
    meta = docs.groupBy("event_id").agg(package.strategy(F.count("*")).alias("strategy"))
    known = spark.createDataFrame([(e, n) for e in sizes for n in names], "event_id string, name string")
    got = package.chosen_reports(docs, meta, known, encode.encoded(docs.select(package.label(docs).alias("name"))))
    out = {}
    for r in got.orderBy("event_id", "rank").collect():
        out.setdefault(r.event_id, []).append(int(r.doc_id.split("-")[1]))
    return out


def test_small_events_have_all_reports(spark):
    assert _chosen(spark, {"a": ["same title"] * 5, "b": [None, "x"]}) == {"a": [0, 1, 2, 3, 4], "b": [0, 1]}


def test_medium_events_have_unlike_ones_and_then_rich_ones(spark):
    titles = [f"{w} report {w}{w}" for w in ("red", "green", "blue")] + ["red report redred"] * 7 + [None]
    assert _chosen(spark, {"m": titles}) == {"m": [0, 1, 2]}
    assert _chosen(spark, {"m": titles}, ["ALPHA"]) == {"m": [0, 1, 2, 3, 5, 7, 9]}
    assert _chosen(spark, {"m": [f"{chr(97 + i) * 4} {chr(110 + i) * 5}" for i in range(12)]}, ["alpha"]) == {"m": list(range(8))}
    assert _chosen(spark, {"m": ["same title"] * 8}) == {"m": list(range(8))}  # no more than are wanted


def test_large_events_have_unlike_ones_of_each_chunk(spark):
    titles = ["one same title"] * 12 + [f"{chr(97 + i % 12) * 4} {chr(110 + i % 12) * 5}" for i in range(12)] + ["another title"] * 11 + ["zzz yyy xxx"]
    assert _chosen(spark, {"l": titles}) == {"l": [0, 12, 13, 14, 24, 35]}
    many = {"l": [f"{chr(97 + i % 12) * 4} {chr(110 + i % 12) * 5}" for i in range(100)]}
    assert _chosen(spark, many)["l"] == [12 * c + k for c in range(5) for k in range(3)]


@pytest.mark.parametrize("n", [1, 6, 40])
def test_whole_package(spark, n):
    docs = _reports(spark, {"e": [f"title {i}" for i in range(n)]}).withColumns({"publish_time": F.lit("2020"), "source_name": F.lit("s"), "language": F.lit("en")})
    rows = [node("e", i, "Alpha" if i % 2 else "Beta", "AISystem" if i < 3 else "AIModel") for i in range(n)]
    entities = spark.createDataFrame(rows, NODE).withColumn("source_doc_ids", F.array(F.concat(F.lit("e-"), F.col("pos").cast("string"))))
    got = package.evidence_package(docs, entities, encode.encoded(docs.select(F.col("title").alias("name"))))
    assert got.metadata.first().report_count == n and got.reports.count() >= 1
    assert got.conflicts.filter("kind = 'type_conflict'").count() == (2 if n > 4 else 0)
    support = {r.name: r.support for r in got.support.collect()}
    assert support.keys() == ({"Alpha", "Beta"} if n > 1 else {"Beta"})
    core = got.core.first()
    assert core.ai_systems == ["Beta", "Alpha"][:n] and core.ai_models == (["Alpha", "Beta"] if n > 4 else [])


def test_no_name_of_the_query_is_left_out(spark):
    from loomgraph.plans.catalog import QUERIES, entities

    sf_dir = "/root/testdata/sf0.001"
    lists = [c for c in QUERIES["categorize"](spark, sf_dir).columns if c != "event_id"]
    got = sum(sum(len(r[c]) for c in lists) for r in QUERIES["categorize"](spark, sf_dir).collect())
    assert got == entities(spark, sf_dir).count()


def test_a_lexicon_goes_to_the_sentences(spark, monkeypatch):
    from loomgraph.sources import providers

    docs = spark.createDataFrame([("e", i, f"The cat of {i}. A dog, the end!") for i in range(20)], "event_id string, doc_id int, content string")
    lexicon = spark.createDataFrame([("The", "AISystem"), ("the end", "AIModel"), ("bird", "AIModel")], "name string, entity_type string")
    got = providers.gazetteer(docs, lexicon)
    rows = sorted(map(tuple, got.collect()))
    assert len(rows) == 60 and "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(providers, "LEXICON", 1)
    assert rows == sorted(map(tuple, providers.gazetteer(docs, lexicon).collect()))


def test_longest_sentences_by_place(spark):
    import random

    from loomgraph.plans.run_catalog import _longest_said

    rng, kinds = random.Random(4), ("x", "y", "z")
    docs = [(f"e{i % 3}", i, f"d{i}", f"t{i}", None if i == 7 else " ".join("w" * rng.randrange(4) + "." for _ in range(rng.randrange(9)))) for i in range(40)]
    want = {}
    for event, pos, doc, title, text in docs:
        for i, value in enumerate(re.split(r"(?<=[.!?])\s+", text) if text is not None else []):
            key = (event, kinds[i % 3])
            found = (len(value), -pos, -i, value, title, doc)
            want[key] = max(want.get(key, found), found)
    got = {(r.event_id, r.field): (r.value, r.evidence, r.source_doc_id) for r in _longest_said(spark.createDataFrame(docs, "event_id string, pos long, doc_id string, title string, content string"), kinds).collect()}
    assert got == {k: v[3:] for k, v in want.items()} and len(got) == 9


@pytest.mark.parametrize("part_rows", [3, 16, None])
def test_names_of_a_common_part_are_dealt_to_tasks(spark, part_rows):
    rows = [(f"k{i % 2}", f"Unit {i % 23:03d} {'of lab' * (i % 3 == 0)}"[: 4 + i % 13], i) for i in range(160)]
    got = package.alias_targets(spark.createDataFrame(rows, "kind string, name string, pos long"), part_rows=part_rows)
    want = {}
    for kind, name, _ in rows:
        over = [(-len(h), p, h) for k, h, p in rows if k == kind and len(name) >= 3 and name.lower() in h.lower() and name.lower() != h.lower()]
        if over:
            want[kind, name] = min(over)[2]
    assert {(r.kind, r.name): r.alias_of for r in got.collect()} == want and len(want) > 20


def test_far_parts_of_long_names_need_not_be_asked(spark, monkeypatch):
    monkeypatch.setattr(package, "PLACE_BITS", 2)
    rows = [("k", "common words and then rare", 0), ("k", "say common words and then rare", 1), ("k", "common words alone", 2), ("k", "words", 3)]
    got = {r.name: r.alias_of for r in package.alias_targets(spark.createDataFrame(rows, "kind string, name string, pos long")).collect()}
    assert got == {"common words and then rare": "say common words and then rare", "words": "say common words and then rare"}


def test_labels_are_not_moved(spark):
    """Titles that are whole texts are brought to vectors where they are read; the choice is that of a table of vectors."""
    docs = spark.range(400).select((F.col("id") % 3).cast("string").alias("event_id"), F.col("id").alias("doc_id"), F.col("id").alias("pos"), F.when(F.col("id") % 11 > 0, F.concat(F.lit("title "), F.sha2((F.col("id") % 50).cast("string"), 256))).alias("title"), F.lit("text").alias("content"))
    docs = docs.withColumns({"source_name": F.lit("s"), "language": F.lit("en"), "publish_time": F.lit(None).cast("string")})
    meta, names = package.event_metadata(docs), docs.select("event_id", F.lit("none such").alias("name"))
    chosen = lambda vectors: sorted(map(tuple, package.chosen_reports(docs, meta, names, vectors).collect()))
    assert chosen(encode.name_vector) == chosen(encode.encoded(docs.select(F.col("title").alias("name"))))
    rows = package.labelled(docs, encode.name_vector)
    assert {r.name for r in rows.collect()} == {"", None} and "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
