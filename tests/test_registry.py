import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.streaming import registry

SCHEMA = "id string, name string, entity_type string, support_count int, confidence double, pos long"


def _one_by_one(rows, vectors, threshold):
    """(key, id, name, support) of entries registered one after another."""
    entries, key_of = [], {}
    for id_, name, _, support, _, _ in rows:
        key = "".join(name.lower().split())
        if key not in key_of:
            v = vectors[name]
            best, score = None, 0.0
            for n, e in enumerate(entries):
                w = vectors[e["name"]]
                s = round(float(v @ w / (np.linalg.norm(v) * np.linalg.norm(w))), 9)
                if s >= threshold and s > score:
                    best, score = n, s
            if best is None:
                entries.append({"key": key, "id": id_, "name": name, "support": 0})
                best = len(entries) - 1
            key_of[key] = best
        entries[key_of[key]]["support"] += support
    return sorted((e["key"], e["id"], e["name"], e["support"]) for e in entries)


@pytest.mark.parametrize(("sizes", "seed"), [([60], 1), ([20, 1, 39], 2)])
def test_like_one_by_one_whatever_the_batches(spark, tmp_path, sizes, seed):
    rng = random.Random(seed)
    angles = {f"n{i}": rng.random() * 3 for i in range(40)}
    vectors = {n: np.array([np.cos(a), np.sin(a)]) for n, a in angles.items()}
    rows = [(f"i{k}", rng.choice(list(angles)), "AISystem", rng.randrange(1, 5), 0.5, k) for k in range(sum(sizes))]
    table = spark.createDataFrame([(n, v.tolist()) for n, v in vectors.items()], "name string, vector array<double>")
    held = registry.Registry(spark, f"file://{tmp_path}/r", table, 0.99)
    for number, end in enumerate(itertools.accumulate(sizes)):
        held.absorb(spark.createDataFrame(rows[end - sizes[number] : end], SCHEMA), number)
    got = sorted((r.key, r.id, r.name, r.support_count) for r in held.current().collect())
    assert got == _one_by_one(rows, vectors, 0.99) and len(got) < len({r[1] for r in rows})


def _batch(spark, *names):
    return spark.createDataFrame([(f"{n}{i}", n, "AISystem", 1, 0.5, i) for i, n in enumerate(names)], SCHEMA)


def _keys(held):
    return sorted((r.key, r.support_count) for r in held.current().collect())


def test_a_writer_that_stops_anywhere_loses_nothing(spark, tmp_path, monkeypatch):
    held = registry.Registry(spark, f"file://{tmp_path}/r")
    for i, names in enumerate([("a", "b"), ("b", "c"), ("c",), ("d",)]):
        held.absorb(_batch(spark, *names), i)
    whole = _keys(held)
    assert whole == [("a", 1), ("b", 2), ("c", 2), ("d", 1)]

    class Stopped(Exception):
        pass

    def stop(*_):
        raise Stopped

    for step in ("_switch", "clean"):  # before the new manifest is there, and before the old parts are dropped
        with monkeypatch.context() as m:
            m.setattr(registry.Registry, step, stop)
            with pytest.raises(Stopped):
                held.compact()
        assert _keys(registry.Registry(spark, held.path)) == whole
    held.compact()
    assert _keys(held) == whole and len(list((tmp_path / "r").glob("v=*"))) == 2 == len(held.parts())
    held.absorb(_batch(spark, "c"), 1)  # held by the compacted part
    held.absorb(_batch(spark, "d", "e"), 3)  # in place of the last batch
    assert _keys(held) == [("a", 1), ("b", 2), ("c", 2), ("d", 1), ("e", 1)]
    with monkeypatch.context() as m:  # a batch that stops before its manifest is not there
        m.setattr(registry.Registry, "_switch", stop)
        with pytest.raises(Stopped):
            held.absorb(_batch(spark, "z"), 4)
    assert ("z", 1) not in _keys(held)
    held.clean()
    assert len(list((tmp_path / "r").glob("v=*"))) == 2


def test_of_two_writers_the_second_fails(spark, tmp_path, monkeypatch):
    one = registry.Registry(spark, f"file://{tmp_path}/r")
    one.absorb(_batch(spark, "a"), 0)
    stale = one._manifests()
    one.absorb(_batch(spark, "b"), 1)
    with monkeypatch.context() as m:
        m.setattr(registry.Registry, "_manifests", lambda self: stale)
        with pytest.raises(RuntimeError):
            one._switch([])
    assert _keys(one) == [("a", 1), ("b", 1)]


def test_only_blocks_with_fresh_rows_meet(spark):
    from loomgraph.operators.similarity import similar_pairs

    rows = spark.range(60).select(F.lit("k").alias("kind"), "id", F.array(F.lit(1.0), (F.col("id") % 3).cast("double")).alias("vector"), (F.col("id") >= 50).alias("fresh"))
    all_ = {(r.a, r.b, r.score) for r in similar_pairs(rows, 0.9, kind="kind", block=7).collect()}
    some = {(r.a, r.b, r.score) for r in similar_pairs(rows, 0.9, kind="kind", block=7, fresh="fresh").collect()}
    assert some == {p for p in all_ if p[1] >= 50}


def test_no_pairs_leave_a_batch(spark, tmp_path, monkeypatch):
    """Names that are all alike are as many rows as entries, not as many as pairs."""
    from loomgraph.operators import similarity

    def none(*_, **__):
        raise AssertionError("pairs are made")

    monkeypatch.setattr(similarity, "similar_pairs", none)
    monkeypatch.setattr(registry, "similar_pairs", none, raising=False)
    table = spark.range(90).select(F.concat(F.lit("n"), "id").alias("name"), F.array(F.lit(1.0), F.col("id") / 1e9).alias("vector"))
    held = registry.Registry(spark, f"file://{tmp_path}/r", table, 0.99)
    for i in range(3):
        held.absorb(_batch(spark, *(f"n{k}" for k in range(i, 90, 3))), i)
    assert _keys(held) == [("n0", 90)]


def test_nearest_like_all_pairs(spark):
    from loomgraph.operators.similarity import nearest

    rng = np.random.default_rng(5)
    rows = [(f"k{i % 2}", f"{'h' if i % 3 else 'a'}{i}", rng.integers(0, 3, 4).astype(float).tolist(), int(rng.integers(0, 40))) for i in range(400)]
    table = spark.createDataFrame(rows, "kind string, id string, vector array<double>, place long").withColumn("at", F.struct("place", "id"))
    got = {r.id: (r.best, r.score) for r in nearest(table.filter("id like 'a%'"), table.filter("id like 'h%'"), 0.9, most=30).collect()}
    want = {}
    for kind, a, v, place in rows:
        met = []
        for k, h, w, p in rows:
            size = np.linalg.norm(v) * np.linalg.norm(w)
            if a[0] == "a" and h[0] == "h" and k == kind and (p, h) < (place, a) and size and (s := round(float(np.dot(v, w) / size), 9)) >= 0.9:
                met.append((-s, p, h))
        if met:
            want[a] = (min(met)[2], -min(met)[0])
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1], abs=1e-9) for k in got)
