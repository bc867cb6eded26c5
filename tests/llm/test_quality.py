import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from loomgraph.llm import _text, quality
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.1"


def test_pairs_are_learnt():
    rng = np.random.default_rng(2)
    x = rng.random((4000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x, y)
    assert {(a, b) for a, b, *_ in model.pairs} & {(0, 1)}
    fresh = rng.random((2000, 4))
    right = ((fresh[:, 0] > 0.5) ^ (fresh[:, 1] > 0.5)) == (model.score(fresh) > 0.5)
    assert right.mean() > 0.9


def test_score_is_a_sum_of_table_entries():
    rng = np.random.default_rng(3)
    x = rng.random((500, 3))
    model = quality.fit(x, (x[:, 0] + x[:, 1] > 1).astype(float), rounds=10)
    for row in x[:20]:
        total = model.bias + sum(t[int((e <= v).sum())] for e, t, v in zip(model.edges, model.tables, row, strict=True))
        total += sum(t[int((ea <= row[a]).sum()), int((eb <= row[b]).sum())] for a, b, ea, eb, t in model.pairs)
        assert model.score(row[None])[0] == pytest.approx(1 / (1 + np.exp(-total)))


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.classify(docs, labels).join(labels, "doc_id").filter("held_out")
    rows = got.agg(F.count("*").alias("n"), F.avg((F.col("predicted") == F.col("quality")).cast("int")).alias("acc")).first()
    assert rows.n > 500 and rows.acc > 0.97


def test_hard_tables(spark):
    docs = spark.createDataFrame([(None, None, 1.0), (1, "", 1.0), (2, "x " * 50_000, 1.0), (3, "some words", 1.0), (3, "some words", 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(2, 0), (3, 1), (None, 1), (4, None)], "doc_id long, quality int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert quality.classify(docs, labels.limit(0)).count() == 5
    assert quality.classify(docs.limit(0), labels).count() == 0
    kept = quality.keep_good(docs, labels, threshold=0.0)
    assert kept.columns == docs.columns and kept.filter("score = 1.0").count() == 5


def plain_features(text):
    """The features of one text, word by word."""
    raw = (text or "").encode()
    words = [w.lower() if w.isascii() else bytes(b + 32 if 65 <= b <= 90 else b for b in w) for w in raw.split()]
    own = raw.split()
    lines = [line for line in raw.split(b"\n") if line]
    symbols = {i for i in range(33, 127) if not chr(i).isalnum() and chr(i) not in ".,;:'\"()-?"}
    n, size = max(len(words), 1), max(len(raw), 1)
    count = Counter(words)
    repeat = [i for i in range(1, len(words)) if words[i] == words[i - 1]]
    lone = [all(b in symbols for b in w) for w in words]
    out = [
        math.log1p(len(words)), sum(map(len, words)) / n, sum(len(w) > 20 for w in words) / n, sum(65 <= b <= 90 for b in raw) / size, sum(b in symbols for b in raw) / size,
        sum(48 <= b <= 57 for b in raw) / size, len(count) / n, max(count.values(), default=0) / n, len(repeat) / n, 1 - len(set(lines)) / max(len(lines), 1),
        math.log(n / max(len(lines), 1)), sum(b in b".?!" for b in raw) / n, sum(lone) / n, sum(w[-1] in symbols for w in words) / n,
    ]
    worst = [0.0] * 5
    for lo in range(0, len(words), quality.BLOCK):
        part = range(lo, min(lo + quality.BLOCK, len(words)))
        k = len(part)
        if k < quality.BLOCK // 2 and n >= quality.BLOCK // 2:
            continue
        letters = max(sum(len(words[i]) for i in part), 1)
        found = (
            sum(65 <= b <= 90 for i in part for b in own[i]) / letters, sum(b in symbols for i in part for b in words[i]) / letters, sum(i in repeat for i in part) / k,
            sum(lone[i] for i in part) / k, 1 - len({words[i] for i in part}) / k,
        )
        worst = [max(a, b) for a, b in zip(worst, found, strict=True)]
    return [*out, *worst, math.log1p(max(map(len, words), default=0))]


def test_features_word_by_word(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    texts += ["", None, "  \n\t", "a", "A a  b\nB b\n\nB b", "!!! ## x#", "w " * 100 + "END!", "É é 漢字 9 9 9", "x" * 5000, "a b\n" * 30]
    got = quality.features(*_text.text_bytes(pa.array(texts, pa.large_string())))
    assert np.allclose(got, np.array([plain_features(t) for t in texts]), atol=1e-9)


def test_trees_are_the_best_there_are():
    """Cuts and two-level trees against all that are possible."""
    rng = np.random.default_rng(2)
    gain = lambda g, h: g * g / (h + quality.REGULAR)
    for _ in range(30):
        g, h = rng.normal(size=9), rng.random(9) * 3
        best, at = quality._best_cut(g, h)
        can = {c: gain(g[:c].sum(), h[:c].sum()) + gain(g[c:].sum(), h[c:].sum()) - gain(g.sum(), h.sum()) for c in range(1, 9) if min(h[:c].sum(), h[c:].sum()) >= quality.LEAST}
        assert best == pytest.approx(max([0.0, *can.values()])) and (best <= 0 or can[at] == pytest.approx(best))
        tree = quality._stump3(g, h)
        parts = np.flatnonzero(np.diff(tree)) + 1
        assert len(parts) <= 2
        for a, b in zip([0, *parts], [*parts, 9]):
            assert tree[a] == pytest.approx(-g[a:b].sum() / (h[a:b].sum() + quality.REGULAR))
        grid_g, grid_h = rng.normal(size=(5, 4)), rng.random((5, 4)) * 4
        value, leaves = quality._tree4(grid_g, grid_h)
        total = 0.0
        for cut in range(1, 5):
            now = -gain(grid_g.sum(), grid_h.sum())
            for rows in (slice(0, cut), slice(cut, None)):
                gs, hs = grid_g[rows].sum(axis=0), grid_h[rows].sum(axis=0)
                sides = [gain(gs[:c].sum(), hs[:c].sum()) + gain(gs[c:].sum(), hs[c:].sum()) for c in range(1, 4) if min(hs[:c].sum(), hs[c:].sum()) >= quality.LEAST]
                now += max([gain(gs.sum(), hs.sum()), *sides])
            total = max(total, now)
        assert value == pytest.approx(total) and (value == 0) == (not leaves.any())


def test_a_score_is_a_sum_of_table_entries():
    rng = np.random.default_rng(3)
    x = rng.random((600, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x, y, rounds=20, pair_rounds=20)
    for row, score in zip(x[:50], model.score(x[:50]), strict=True):
        total = model.bias + sum(t[np.searchsorted(e, v, side="right")] for e, t, v in zip(model.edges, model.tables, row, strict=True))
        total += sum(t[np.searchsorted(ea, row[a], side="right"), np.searchsorted(eb, row[b], side="right")] for a, b, ea, eb, t in model.pairs)
        assert score == pytest.approx(1 / (1 + math.exp(-total)))
    assert ((model.score(x) > 0.5) == y).mean() > 0.9  # only the pair tells


def test_keep_good_with_clashing_columns(spark):
    names = ["score", "_own_score", "Score_", "x", "part"]
    df = spark.createDataFrame([(i, "some fine words here. " * 5, *[f"{n}{i}" for n in names]) for i in range(4)], ["doc_id", "text", *names])
    labels = spark.createDataFrame([(0, 1), (1, 0), (3, 1)], "doc_id long, quality int")
    got = quality.keep_good(df, labels, threshold=0.0)
    assert got.schema == df.schema and sorted(map(tuple, got.collect())) == sorted(map(tuple, df.collect()))
