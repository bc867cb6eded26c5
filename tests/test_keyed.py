import random

import pytest

from loomgraph.sources import keyed

SCHEMA = "k int, docs array<string>, score double, name string"


def _files(path):
    return {p for p in path.rglob("*.parquet")}


def _plain(batches):
    held = {}
    for rows in batches:
        for k, docs, score, name in rows:
            old = held.get(k, ([], None, None))
            docs = docs or []
            held[k] = ([d for d in dict.fromkeys(old[0]) if d not in docs] + docs, max((x for x in (old[1], score) if x is not None), default=None), name if name is not None else old[2])
    return sorted((k, *v) for k, v in held.items())


def _made(rng, keys):
    return [(k, rng.choice([None, rng.sample("abcd", rng.randrange(4))]), rng.choice([None, rng.random()]), rng.choice([None, "x", "y"])) for k in keys]


def _rows(table):
    return sorted(map(tuple, table.rows().select("k", "docs", "score", "name").collect()))


@pytest.mark.parametrize("changes", [1, 3, 50])
def test_like_updates_one_by_one(spark, tmp_path, changes):
    rng = random.Random(changes)
    table = keyed.KeyedTable(spark, f"file://{tmp_path}/t", ["k"], ("docs",), ("score",), buckets=4, changes=changes)
    batches = [_made(rng, rng.sample(range(40), 15)) for _ in range(5)]
    for i, b in enumerate(batches):
        table.upsert(spark.createDataFrame(b, SCHEMA), i)
    assert _rows(table) == _plain(batches)


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    table = keyed.KeyedTable(spark, f"file://{tmp_path}/t", ["k"], ("docs",), ("score",), buckets=8, changes=2)
    whole = _made(random.Random(1), range(200))
    table.upsert(spark.createDataFrame(whole, SCHEMA))
    before, parts = _files(tmp_path), table.parts()
    one = [(7, ["z"], 9.0, "seven")]
    for _ in range(4):
        table.upsert(spark.createDataFrame(one, SCHEMA))
    own = {p["bucket"] for p in table.parts() if p not in parts}
    assert len(own) == 1 and [p for p in table.parts() if p["bucket"] not in own] == [p for p in parts if p["bucket"] not in own]
    table.clean()
    assert {f for f in before if f.parent.name != f"bucket={min(own)}"} <= _files(tmp_path)
    assert len(table.parts()) <= 8 + 2 and _rows(table) == _plain([whole, one])
    some = table.rows(spark.createDataFrame(one, SCHEMA))
    assert {r.k for r in some.collect()} < {r[0] for r in whole} and some.filter("k = 7").first().name == "seven"


def test_replays_and_stops(spark, tmp_path, monkeypatch):
    table = keyed.KeyedTable(spark, f"file://{tmp_path}/t", ["k"], ("docs",), ("score",), buckets=2)
    assert table.rows() is None
    batches = [_made(random.Random(i), range(i, 30, 2)) for i in range(3)]
    for i, b in enumerate(batches):
        table.upsert(spark.createDataFrame(b, SCHEMA), i)
    table.upsert(spark.createDataFrame(batches[2], SCHEMA), 2)
    want = _plain(batches)
    assert _rows(table) == want

    def stop(*_):
        raise KeyError

    with monkeypatch.context() as m:
        m.setattr(keyed.KeyedTable, "_switch", stop)
        with pytest.raises(KeyError):
            table.upsert(spark.createDataFrame(batches[0], SCHEMA))
    assert _rows(table) == want
    table.clean()
    assert _rows(table) == want


def test_property_graph(spark, tmp_path):
    nodes = "event_id string, pos int, id string, name string, entity_type string, extraction_mode string, confidence double, source_doc_ids array<string>"
    edges = "event_id string, pos int, subject_id string, predicate string, object_id string, confidence double, evidence array<string>, extraction_mode string"
    graph = keyed.PropertyGraph(spark, f"file://{tmp_path}/g", 4)
    for i, event in enumerate(("e1", "e2")):
        n = spark.createDataFrame([(event, 0, f"{event}a", "Acme", "AISystem", "explicit", 0.5 + i / 10, [f"d{i}"]), (event, 1, f"{event}r", "harm", "Risk", "explicit", 0.4, ["d"])], nodes)
        graph.write(n, spark.createDataFrame([(event, 0, f"{event}a", "hasRisk", f"{event}r", 0.7, ["s"], "explicit")], edges), i)
    held = {(r.label, r.key): r for r in graph.nodes.rows().collect()}
    assert held["AISystem", "Acme"].event_ids == ["e1", "e2"] and held["AISystem", "Acme"].confidence == 0.6 and len(held) == 3
    assert graph.edges.rows().count() == 2
