import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from loomgraph.llm import packing, tokenbin
from pyspark.sql import functions as F
from tokenizers import Tokenizer


def naive(lengths, capacities, overhead):
    """The same choices by plain search over all bins."""
    plans = []
    for usual in (u for k in range(1, len(capacities) + 1) for u in itertools.combinations(capacities, k)):
        bins = []
        left = sum(lengths)
        for n in sorted(lengths, reverse=True):
            fit = [b for b in bins if b[0] >= n]
            if fit:
                b = min(fit, key=lambda b: b[0])
            else:
                can = [c for c in usual if c >= n] or [min(c for c in capacities if c >= n)]
                b = [min(can, key=lambda c: ((c + overhead) / min(c, left), c)), 0]
                bins.append(b)
            b[0] -= n
            b[1] += n
            left -= n
        plans.append(sum(min(c for c in capacities if c >= b[1]) + overhead for b in bins))
    return min(plans)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=40))
def test_best_fit_costs_what_plain_search_does(lengths):
    where, capacity = packing.best_fit(np.array(lengths, np.int64), (10, 20, 40), 3)
    content = np.bincount(where, weights=lengths, minlength=len(capacity)) if lengths else np.empty(0)
    assert all(c == min(x for x in (10, 20, 40) if x >= n) for c, n in zip(capacity, content, strict=True))
    assert capacity.sum() + 3 * len(capacity) == (naive(lengths, (10, 20, 40), 3) if lengths else 0)


def check(packed, texts, capacities):
    """Each sequence decodes to its pieces, and each document's pieces, in order, to its ids."""
    plain = Tokenizer.from_file(tokenbin.default_tokenizer())
    by_doc: dict = {}
    for r in packed:
        assert r.capacity == min(c for c in capacities if c >= len(r.ids))
        assert [p.bin_offset for p in r.pieces] == [0, *itertools.accumulate(p.length for p in r.pieces)][:-1]
        assert len(r.ids) == sum(p.length for p in r.pieces)
        for p in r.pieces:
            by_doc.setdefault(p.doc_id, []).append((p.fragment, p.start, r.ids[p.bin_offset : p.bin_offset + p.length]))
    want: dict = {}
    for d, t in texts:
        want.setdefault(d, []).append(plain.encode(t or "", add_special_tokens=False).ids + [tokenbin.END_ID])
    assert by_doc.keys() == want.keys()
    for d, pieces in by_doc.items():
        if len(want[d]) > 1:  # repeated rows: as many of each piece
            assert sorted(i for _, _, ids in pieces for i in ids) == sorted(i for ids in want[d] for i in ids)
            continue
        pieces.sort()
        assert [f for f, _, _ in pieces] == list(range(len(pieces)))
        assert [i for _, _, ids in pieces for i in ids] == want[d][0]
        assert [s for _, s, _ in pieces] == [0, *itertools.accumulate(len(ids) for _, _, ids in pieces)][:-1]


def test_small_tables(spark):
    rows = [(1, "a b c"), (2, None), (3, ""), (3, ""), (4, "w " * 9000), (5, "x\ty  z\n"), (6, "w " * 4095), (None, "no id"), (3, "other")]
    df = spark.createDataFrame([(*r, 9, "g") for r in rows], "doc_id long, text string, length int, group string")
    check(packing.sequences(df).collect(), rows, packing.CAPACITIES)
    assert packing.sequences(df.limit(0)).count() == 0
    nothing = spark.createDataFrame([(1, 5)], "doc_id long, x int").withColumn("text", F.lit(None).cast("string"))
    assert packing.sequences(nothing).first().ids == [tokenbin.END_ID]


@pytest.mark.parametrize("group_tokens", [40_000, 4_000_000])
def test_whole_table(spark, group_tokens):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = packing.sequences(df, group_tokens=group_tokens).collect()
    check(got, [(r.doc_id, r.text) for r in df.collect()], packing.CAPACITIES)
    used, room = sum(len(r.ids) for r in got), sum(r.capacity for r in got)
    assert used / room > (0.98 if group_tokens > 1_000_000 else 0.9)


def test_layout_does_not_matter(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    df = df.union(df.limit(40)).union(df.filter("doc_id < 3"))
    got = [sorted(map(tuple, packing.placements(packing.sequences(d, group_tokens=5_000)).collect()), key=str) for d in (df.coalesce(1), df.repartition(3), df.orderBy(F.desc("text")))]
    assert got[0] == got[1] == got[2]
