import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from loomgraph.llm import _text, dartminhash


def shingle_counts(text, width=5):
    w = text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split()
    return Counter(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else Counter()


def jaccard(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def brute(rows):
    """class_id per row by comparing all pairs."""
    sets = [shingle_counts(t or "") for _, t in rows]
    part = list(range(len(rows)))

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    holders = {}
    for i, s in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(i)
    for i, s in enumerate(sets):
        for j in {j for g in s for j in holders[g] if j > i}:
            if jaccard(s, sets[j]) >= 0.8:
                part[root(j)] = root(i)
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(root(i), []).append(d)
    size = {k: len(v) for k, v in ids.items()}
    return sorted((d, min(ids[root(i)]), size[root(i)]) for i, (d, _) in enumerate(rows))


def test_signature_estimates_weighted_similarity():
    rng = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    a = [rng.choice(words) for _ in range(300)]
    texts = [" ".join(a), " ".join(a[:240] + [rng.choice(words) for _ in range(60)]), " ".join(a[:200] * 2), "one"]
    raw, off = _text.text_bytes(pa.array(texts))
    cell, docs = dartminhash.cells(_text.tokenize(raw, off, _text.VISIBLE))
    sig = dartminhash.signatures(cell, docs, 4, 4096)
    sets = [shingle_counts(t) for t in texts]
    for i, j in ((0, 1), (0, 2), (1, 2), (0, 3)):
        assert abs((sig[i] == sig[j]).mean() - jaccard(sets[i], sets[j])) < 0.04


def variants(rng, base, n, most):
    out = []
    for _ in range(n):
        w = base.split()
        for _ in range(rng.randrange(most)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("block", [2048, 7])
def test_near_groups_against_brute_force(spark, block):
    rng = random.Random(block)
    texts = []
    for g in range(4):
        texts += variants(rng, " ".join(f"g{g}w{rng.randrange(10**6)}" for _ in range(150)), 40, 8)
    texts += ["A b", "a B", "a b c d e f", "", None, "  ", texts[3], texts[3] + " ", "é " * 4000, "é " * 4001]
    rows = list(enumerate(texts))
    rows.append(rows[5])
    df = spark.createDataFrame([(d, t, "k") for d, t in rows], "doc_id long, text string, key string")
    got = sorted(map(tuple, dartminhash.near_duplicates(df, block=block).collect()))
    assert got == brute(rows)
    kept = sorted(r.doc_id for r in dartminhash.keep_one(df).collect())
    blank = [d for d, t in rows if not (t or "").strip()]
    assert kept == sorted({c for d, c, _ in got if d not in blank} | set(blank))
    assert dartminhash.near_duplicates(df.limit(0)).count() == 0


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    assert sorted(map(tuple, dartminhash.near_duplicates(df).collect())) == brute([tuple(r) for r in df.collect()])


def test_every_banded_pair_is_checked_exactly(spark):
    """Pairs that share one band of two and agree on little else are linked by their true similarity."""
    rng = random.Random(8)
    rows, pairs = [], []
    for g in range(600):
        words = [f"g{g}w{k}" for k in range(60)]
        other = words[:]
        other[rng.randrange(10, 50)] = "other"
        pairs.append((len(rows), len(rows) + 1))
        rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(other))]
    texts = pa.array([t for _, t in rows])
    cell, docs = dartminhash.cells(_text.tokenize(*_text.text_bytes(texts), _text.VISIBLE))
    sig = dartminhash.signatures(cell, docs, len(rows), 6)
    band = dartminhash.bands(sig)
    banded = [(a, b) for a, b in pairs if (band[a] == band[b]).any()]
    assert sum((sig[a] == sig[b]).sum() == 3 for a, b in banded) > 0
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in dartminhash.near_duplicates(df, coords=6).collect()}
    assert [(a, b) for a, b in pairs if got[a] == got[b]] == banded


def test_keep_one_with_clashing_columns_and_ties(spark):
    names = ["key", "one", "Chosen_ID", "chosen_key", "class", "v", "size"]
    rows = [(1, "a b c", *names), (1, "A b c", *names), (1, "a b c", *["x"] * 7), (2, "a  b c", *names), (3, None, *names), (3, " ", *names)]
    df = spark.createDataFrame([(*r, float(i)) for i, r in enumerate(rows)], ["doc_id", "text", *names, "weight"])
    for parts in (1, 3):
        got = dartminhash.keep_one(df.repartition(parts))
        assert got.columns == df.columns and got.schema == df.schema
        assert sorted((r.doc_id, r.text or "", r.weight) for r in got.collect()) == [(1, "A b c", 1.0), (3, "", 4.0), (3, " ", 5.0)]


def test_recall_by_similarity(spark):
    """Of pairs of texts at each similarity the share that is linked."""
    rng = random.Random(4)
    rows, true = [], {}
    for g in range(900):
        words = [f"g{g}w{k}" for k in range(120)]
        for at in rng.sample(range(5, 115), 1 + g % 3):
            words[at] = "other"
        a, b = " ".join(f"g{g}w{k}" for k in range(120)), " ".join(words)
        true[g] = jaccard(shingle_counts(a), shingle_counts(b))
        rows += [(2 * g, a), (2 * g + 1, b)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in dartminhash.near_duplicates(df).collect()}
    assert all((got[2 * g] == got[2 * g + 1]) == (s >= 0.8) for g, s in true.items())
    assert sum(0.8 <= s < 0.85 for s in true.values()) > 100
