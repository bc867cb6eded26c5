import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from loomgraph.llm import variants


def _one(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def _plain(count):
    near = {w: [x for x in count if _one(w, x)] for w in count}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-count[x], x), default=None)
        form[w] = best if best and count[best] >= 2 * count[w] else None
    out = []
    for w in count:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, count[w], len(near[w]), count[form[w]] if form[w] else None))
    return sorted(out)


def _made(rng, n, letters, sizes):
    words = {"".join(rng.choice(letters) for _ in range(rng.choice(sizes))) for _ in range(n)}
    return {w: rng.choice([3, 4, 7, 20, 99]) for w in words}


def test_near_pairs_by_brute_force():
    rng = random.Random(4)
    for letters, sizes in [("ab", range(6)), ("abcé", range(1, 5)), ("a", range(30))]:
        rows = sorted({(rng.randrange(3), "".join(rng.choice(letters) for _ in range(rng.choice(sizes)))) for _ in range(200)})
        a, b = variants.near_pairs(np.array([g for g, _ in rows]), [r for _, r in rows])
        got = sorted((min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist(), strict=True))
        want = [(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if rows[i][0] == rows[j][0] and _one(rows[i][1], rows[j][1])]
        assert got == want
    assert [len(x) for x in variants.near_pairs(np.empty(0, np.int64), [])] == [0, 0]


@pytest.mark.parametrize(("letters", "sizes", "bucket"), [("ab", [5, 6, 7, 8], 20_000), ("ab", [5, 6, 7, 9], 12), ("aéÿ", [5, 6], 3), ("abcdefgh", [5, 6, 12], 40), ("x", list(range(5, 60)), 1)])
def test_forms_against_plain(spark, letters, sizes, bucket):
    count = _made(random.Random(len(letters)), 400, letters, sizes)
    df = spark.createDataFrame(sorted(count.items()), "word string, n long")
    got = variants.forms(df, bucket).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert sorted(map(tuple, got)) == _plain(count)


def test_a_chain_of_forms_and_long_words(spark):
    long = "lorem" * 600
    count = {"aaaaa": 3, "aaaab": 6, "aaabb": 12, "aabbb": 24, "abbbb": 48, "bbbbb": 96, long: 3, long[:1700] + "x" + long[1701:]: 9, long + "m": 18}
    df = spark.createDataFrame(sorted(count.items()), "word string, n long")
    assert sorted(map(tuple, variants.forms(df).select("word", "form", "root", "n", "n_near", "form_n").collect())) == _plain(count)


def _words(rows):
    count = Counter()
    for i, text in rows:
        run = ""
        for c in (text or "") + " ":
            if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
                run += c.lower() if c.isascii() else c
                continue
            if run:
                h = zlib.crc32(f"{i}:{run}".encode()) if i is not None else 1
                word = run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]
                if len(word) >= 5:
                    count[word] += 1
            run = ""
    return {w: n for w, n in count.items() if n >= 3}


def test_whole_texts(spark):
    rng = random.Random(8)
    base = ["Straße", "ÉTUDE", "étude", "colour", "color", "colours", "naïve", "don't", "x1y", "ab×cd", "Ωmega", "wörter", "W", ""]
    rows = [(i, rng.choice([" ", "\n", "-"]).join(rng.choice(base) for _ in range(rng.randrange(60)))) for i in range(300)]
    rows += [(None, "colour " * 50), (1, None), (None, None), (2, ""), (3, rows[0][1]), (3, rows[0][1]), (9, "verylong " * 100_000)]
    df = spark.createDataFrame([(*r, "w", 0) for r in rows], "doc_id long, text string, word string, N int")
    want = _words(rows)
    assert want["verylong"] > 90_000 and len(want) > 15
    got = variants.spelling_variants(df)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(_plain(want), key=repr)


def test_empty_tables(spark):
    schema = "doc_id long, text string"
    assert variants.spelling_variants(spark.createDataFrame([], schema)).collect() == []
    assert variants.spelling_variants(spark.createDataFrame([(1, None), (2, "only few")], schema)).collect() == []


def test_pairs_come_once_whatever_the_prefix(spark):
    count = _made(random.Random(3), 300, "ab", [5, 6, 7])
    df = spark.createDataFrame(sorted(count.items()), "word string, n long")
    seen = defaultdict(int)
    for r in variants.pairs_at_one(df, bucket=30).collect():
        seen[frozenset((r.word, r.near))] += 1
    assert set(seen.values()) == {1}
    assert len(seen) == sum(_one(a, b) for a in count for b in count if a < b)
