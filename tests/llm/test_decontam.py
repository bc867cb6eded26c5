import hashlib
import re

import pytest
from loomgraph.llm import decontam

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
A = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(A))


def brute(docs, items, width=10):
    out = []
    grams = {}
    for i, t in items:
        w = words(t)
        for k in range(max(0, len(w) - min(len(w), width) + 1) if w else 0):
            grams.setdefault(tuple(w[k : k + min(len(w), width)]), set()).add(i)
    sizes = {len(g) for g in grams}
    for d, t in docs:
        w = words(t)
        hit, found = set(), set()
        for m in sizes:
            for k in range(len(w) - m + 1):
                if ids := grams.get(tuple(w[k : k + m])):
                    hit.update(range(k, k + m))
                    found |= {str(i) for i in ids if i is not None}
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


ITEMS = [(1, "One two three four five six seven eight nine ten eleven twelve"), (2, "short Élan"), (3, ""), (4, None), (12, "seven eight nine ten eleven twelve alpha beta gamma delta"), (None, "no id at all")]
DOCS = [
    (1, "x one TWO three, four five six seven eight nine ten eleven twelve y"), (2, "nothing here"), (3, None), (4, ""), (5, "short élan short Élan"), (5, "short élan short Élan"),
    (6, "one two three four five six seven eight nine"), (None, "a short élan b"), (7, "pad " * 900_000 + "one two three four five six seven eight nine ten tail"), (8, "pad " * 300_000 + "short Élan"),
    (9, "seven eight nine ten eleven twelve alpha beta gamma delta no id at all"),
]


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame([(*d, "h") for d in DOCS], "doc_id long, text string, hits string").coalesce(1)
    return docs, spark.createDataFrame(ITEMS, "item_id long, text string")


@pytest.mark.parametrize("most", [1_000_000, 40])
def test_against_brute_force(tables, most):
    docs, bench = tables
    got = decontam.scan(docs, bench, ["doc_id"], block_bytes=most)
    want = brute(DOCS, ITEMS)
    assert sorted(((r.doc_id, r.n_words, len(r.hits), len(r["items"])) for r in got.collect()), key=str) == [w[:4] for w in want]
    if most > 40:
        assert sorted(map(tuple, decontam.contamination(docs, bench).collect()), key=str) == want


@pytest.mark.parametrize("most", [1_000_000, 40])
def test_removal(tables, most):
    docs, bench = tables
    clean = [w[0] for w in brute(DOCS, ITEMS) if not w[5]]
    kept = decontam.remove_documents(docs, bench, block_bytes=most)
    assert kept.columns == docs.columns and sorted([r.doc_id for r in kept.collect()], key=str) == sorted(clean, key=str)
    cut = {r.doc_id: r.text for r in decontam.remove_spans(docs, bench, block_bytes=most).collect()}
    assert cut[1] == "x  y" and cut[2] == "nothing here" and cut[3] is None and cut[5] == "short élan "  # only A-Z are lower-cased
    assert cut[7].endswith("pad  tail") and len(cut[7]) == 4 * 900_000 + 5


def test_one_cut_whatever_the_blocks(spark):
    q, z = (" ".join(f"{c}{i}" for i in range(1, 11)) for c in "qz")
    joined = " ".join([*(f"q{i}" for i in range(1, 6)), *(f"z{i}" for i in range(1, 6))])
    items = spark.createDataFrame([(1, joined), (2, q), (3, z)], "item_id long, text string")
    text = " ".join(f"q{i}" for i in range(1, 6)) + " " + q + " " + " ".join(f"z{i}" for i in range(1, 6)) + " end"
    docs = spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")
    for size in (1 << 20, 60, 10):
        assert {r.text for r in decontam.remove_spans(docs, items, block_bytes=size).collect()} == {"q1 q2 q3 q4 q5  z1 z2 z3 z4 z5 end"}


def test_same_hash_other_words():
    import pyarrow as pa

    table = decontam.HashSet(pa.array([7, 8, 7]), pa.array(["a b", "c d", "a b"]), 2)
    hashes, first, start, size, item = table._distinct(decontam.np.zeros(3, decontam.np.uint64), decontam.np.array([0, 2, 4]), 2)
    assert len(hashes) == 2 and sorted(size.tolist()) == [1, 2] and sorted(item.tolist()) == [0, 1, 2]


def test_empty_tables(tables):
    docs, bench = tables
    assert decontam.contamination(docs.limit(0), bench).count() == 0
    assert decontam.contamination(docs, bench.limit(0)).filter("contaminated").count() == 0
    assert decontam.remove_documents(docs, bench.limit(0)).count() == len(DOCS)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    assert sorted(map(tuple, decontam.contamination(docs, bench).collect()), key=str) == brute([tuple(r) for r in docs.collect()], [tuple(r) for r in bench.select("item_id", "text").collect()])
