import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import anchors


def _plain(rows, window):
    """(doc_id, words, removed, kept) of each row, window by window."""
    least = {}
    for i, text in rows:
        words = (text or "").encode().split()
        if i is not None:
            for k in range(len(words) - window + 1):
                g = tuple(words[k : k + window])
                least[g] = min(i, least.get(g, i))
    out = []
    for i, text in rows:
        words = (text or "").encode().split()
        cut = [False] * len(words)
        if i is not None:
            for k in range(len(words) - window + 1):
                if least[tuple(words[k : k + window])] < i:
                    cut[k : k + window] = [True] * window
        out.append((i, len(words), sum(cut), b" ".join(w for w, c in zip(words, cut, strict=True) if not c).decode()))
    return sorted(out, key=repr)


def _got(spark, rows, window, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in anchors.remove_repeats(df, window, **options).collect()), key=repr)


@pytest.mark.parametrize(("window", "seed"), [(5, 1), (6, 2), (8, 3), (50, 4)])
def test_against_plain(spark, window, seed):
    rng = random.Random(seed)
    shared = [" ".join(rng.choice("ab c'é dd".split()) + str(rng.randrange(40)) for _ in range(rng.randrange(window // 2, 4 * window))) for _ in range(8)]
    rows = []
    for i in rng.sample(range(1000), 150):
        parts = [rng.choice(shared) if rng.random() < 0.6 else " ".join(str(rng.randrange(99)) for _ in range(rng.randrange(2 * window))) for _ in range(rng.randrange(5))]
        cut = " ".join(parts).split(" ")
        a = rng.randrange(len(cut))
        rows.append((i, rng.choice([" ", "\n", "\t \r"]).join(cut[a:] if rng.random() < 0.5 else cut)))
    rows += [(rows[0][0], rows[1][1]), (rows[0][0], rows[0][1]), (None, rows[2][1]), (None, None), (-5, ""), (2000, None), (2001, " ".join("xyz")), (2002, " ")]
    want = _plain(rows, window)
    assert _got(spark, rows, window, piece_bytes=3000, shard_words=700) == want
    assert _got(spark, rows, window) == want


def test_a_passage_in_most_documents_and_a_long_text(spark):
    rng = random.Random(9)
    passage = " ".join(f"p{k}" for k in range(80))
    rows = [(i, " ".join([*(f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(60))), passage, *(f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(60)))])) for i in range(700)]
    rows += [(5000, "again " * 60_000), (5001, "again " * 70 + "other"), (5002, rows[3][1] + " " + rows[4][1])]
    assert _got(spark, rows, 50, piece_bytes=5000, shard_words=5000) == _plain(rows, 50)


def test_spans_digests_and_columns(spark):
    text = " ".join(f"v{k}" for k in range(100))
    rows = [(1, text, "x", 0), (2, "a b " + " ".join(text.split()[10:90]) + " c", "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, piece string, SHARD int").withColumn("words", F.lit(1))
    got = {r.doc_id: r for r in anchors.remove_repeats(df).collect()}
    assert (got[1].n_removed, got[1].kept, got[1].spans) == (0, text, [])
    assert (got[2].n_words, got[2].n_removed, got[2].kept) == (83, 80, "a b c")
    assert [tuple(s) for s in got[2].spans] == [(2, 82)]
    digests = {r.doc_id: r.kept_sha256 for r in anchors.remove_repeats(df, digest=True).collect()}
    assert digests == {1: hashlib.sha256(text.encode()).hexdigest(), 2: hashlib.sha256(b"a b c").hexdigest()}


def test_empty_table(spark):
    assert anchors.remove_repeats(spark.createDataFrame([], "doc_id int, text string")).collect() == []


def test_a_piece_asks_for_a_hash_once(spark):
    """Copies within a piece do not add to what it sends, so a group of copies costs a row for each piece."""
    hashes = np.unique(np.random.default_rng(1).integers(0, 2**63, 5000, dtype=np.uint64))
    marks = (hashes % np.uint64(3)).astype(np.uint8)
    back = anchors.unpacked(anchors.packed(hashes, marks), np.uint64, np.uint8)
    assert (back[0] == hashes).all() and (back[1] == marks).all()
    df = spark.createDataFrame([(i, " ".join(f"v{k}" for k in range(200))) for i in range(50)], "doc_id long, text string")
    piece = df.coalesce(1).mapInArrow(anchors._pieces_of(1 << 20), "piece long, words long, payload binary").collect()
    assert len(piece) == 1 and piece[0].words == 10_000
    opened = anchors.Piece.opened(__import__("pyarrow").py_buffer(piece[0].payload))
    at, _, asked, asked_marks = anchors.anchor_asks(opened, 25, 40)
    assert len(at) == 50 * 176 and len(asked) == 176 and (asked_marks & 2).all() and (asked_marks & 1).sum() == 8
