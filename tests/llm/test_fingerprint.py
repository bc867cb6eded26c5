import hashlib

import numpy as np
import pyarrow as pa
import pytest
from loomgraph.llm import _ranges, _text, fingerprint


def brute(rows, **_):
    """(doc_id, n_chars, edited_sha256) per row in order; doc_id first, then text."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out = []
    for i, (d, t) in enumerate(rows):
        t = t or ""
        k = len(t) // 4
        after = rows[(i + 1) % len(rows)][1] or ""
        edited = t[: len(t) - k] + after[:k]
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), edited, after))
    return out


def shingles(text):
    w = [x.lower() for x in text.encode().split()]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_packing_round_trip():
    low = np.random.default_rng(1).integers(0, 16, (3, 256)).astype(np.uint8)
    packed = fingerprint.pack(low, np.array([True, True, False]))
    assert (fingerprint.unpack(packed[0]) == low[0]).all() and len(packed[1]) == 256 and packed[2] == ""


def test_sketch_by_hand():
    """Minimum of each bin by a plain loop, empty bins by their own probes."""
    raw, off = _text.text_bytes(pa.array(["a b c d e f g h i j k l m n", "x y"]))
    hashes, docs = _text.shingles(_text.tokenize(raw, off, _text.VISIBLE), 5)
    low, has = fingerprint.sketch_texts(raw, off, 16, 4)
    code = _text.seeded(16, 11)
    for d in (0, 1):
        bins: dict = {}
        for h in hashes[docs == d].tolist():
            b, v = (h >> 32) % 16, h & 0xFFFFFFFF
            bins[b] = min(bins.get(b, v), v)
        for b in range(16):
            at, tries = b, 0
            while at not in bins:
                at = int(_text.mix(np.array([(int(code[b]) + tries * 0xA24BAED4963EE407) % 2**64], np.uint64))[0] % 16)
                tries += 1
            assert low[d, b] == int(_text.mix(np.array([bins[at]], np.uint64))[0]) & 15
    assert has.all()


@pytest.mark.parametrize(("range_bytes", "listed"), [(1 << 24, 256), (2000, 256), (2000, 3)])
def test_small_tables(spark, range_bytes, listed, monkeypatch):
    monkeypatch.setattr(_ranges, "LISTED", listed)
    rows = [(i * 3 % 40, f"text {i} " + "word%d " % i * (i * 7 % 90)) for i in range(40)]
    rows += [(None, "first of all"), (None, None), (7, ""), (7, "tie"), (100, "é😀" * 4000), (101, "last one here")]
    df = spark.createDataFrame([(*r, "p") for r in rows], "doc_id long, text string, part string")
    got = fingerprint.edit_check(df, range_bytes=range_bytes).collect()
    want = brute(rows)
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=str) == sorted((w[:3] for w in want), key=str)
    assert fingerprint.edit_check(df.limit(0)).count() == 0
    one = fingerprint.edit_check(df.filter("doc_id = 101")).first()
    assert one.edited_sha256 == hashlib.sha256(b"last one hlas").hexdigest()


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in df.collect()]
    text = dict(rows)
    got = {r.doc_id: r for r in fingerprint.edit_check(df, range_bytes=200_000).collect()}
    wrong = []
    for d, n, sha, edited, after in brute(rows):
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (n, sha)
        wrong += [abs(r.near_edited - jaccard(text[d], edited)), abs(r.near_next - jaccard(text[d], after))]
    assert np.mean(wrong) < 0.03 and np.quantile(wrong, 0.99) < 0.15
    same = {}
    for d, r in got.items():
        assert same.setdefault(text[d], r.fingerprint) == r.fingerprint
