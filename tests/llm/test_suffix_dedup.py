import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from loomgraph.llm import suffix_dedup


def brute(rows, length):
    texts = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(t[i : i + length] for _, t in texts for i in range(len(t) - length + 1))
    out = []
    for d, t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((d, len(t), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("bucket_rows", [4096, 1])
@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed, bucket_rows):
    rng = random.Random(seed)
    rand = lambda n: "".join(rng.choice("abé\n") for _ in range(n))
    parts = [rand(rng.randrange(5, 120)) for _ in range(12)]
    texts = ["".join(rng.choice([*parts, rand(7)]) for _ in range(rng.randrange(8))) for _ in range(60)]
    texts += ["", None, "a" * 300, "ab" * 100, "xyz" * 14, rand(19), rand(20), texts[0], rand(3000)]
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, texts[4]), (None, texts[9]), (5, "other " + texts[9])]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, check int")
    got = suffix_dedup.remove_repeats(df, length=20, gram=7, bucket_rows=bucket_rows, digest=True)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 20)


def test_chunks_and_full_output(spark, monkeypatch):
    rng = random.Random(5)
    a = "".join(rng.choice("abcdef ") for _ in range(700))
    rows = [(1, a + "1" + a[100:400]), (2, "q" * 150 + a[50:500])]
    runs = suffix_dedup.text_runs(*_bytes(rows), 20, 7)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 64)
    cut = suffix_dedup.text_runs(*_bytes(rows), 20, 7)
    assert sum(runs[5] - runs[4] + 1) == sum(cut[5] - cut[4] + 1) == sum(len(t) - 19 for _, t in rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for r in suffix_dedup.remove_repeats(df).collect():
        assert r.n_removed == sum(s.end - s.begin for s in r.spans)
        assert (r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) in brute(rows, 200)
    assert suffix_dedup.remove_repeats(df.limit(0)).count() == 0


def _bytes(rows):
    import pyarrow as pa
    from loomgraph.llm import _text

    return _text.text_bytes(pa.array([t for _, t in rows]))


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = suffix_dedup.remove_repeats(df, digest=True)
    assert sorted(map(tuple, got.collect()), key=str) == brute([tuple(r) for r in df.collect()], 200)


def test_equal_identifiers_of_other_bytes():
    raw = np.frombuffer(b"abcdXabcdYabceZbcd", np.uint8)
    at = np.array([0, 5, 10, 1, 6, 15])
    none = np.zeros(len(at), np.uint64)
    assert suffix_dedup.repeated((none[:2],), at[:2], raw, 4).tolist() == [True, True]
    assert suffix_dedup.repeated((none[:3],), at[:3], raw, 4).tolist() == [True, True, False]
    assert suffix_dedup.repeated((none, np.array([1, 1, 2, 3, 3, 3], np.uint64)), at, raw, 3).tolist() == [True, True, False, True, True, True]


def test_very_long_texts_and_repeated_rows(spark):
    rng = random.Random(9)
    apart = "".join(rng.choice("abcdefghijklmnop") for _ in range(300_000))
    rows = [(1, "a" * 1_000_000), (2, apart), (3, apart[:150] + "z" * 100 + apart[-150:]), *[(4, "same " * 60)] * 50]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r)[:4] for r in suffix_dedup.remove_repeats(df, digest=True).collect()]
    assert sorted(got) == [(1, 1_000_000, 1_000_000, 1), (2, 300_000, 0, 0), (3, 400, 0, 0), *[(4, 300, 300, 1)] * 50]
