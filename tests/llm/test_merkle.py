import hashlib
import random
import zlib

import pytest

from loomgraph.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(row):
    return _h(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in row])


def _climb(nodes):
    """(root, the (left, right) siblings of each node) of a list of nodes."""
    steps, place, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for k, p in enumerate(place):
            run = level[p // 16 * 16 : p // 16 * 16 + 16]
            steps[k].append(("".join(run[: p % 16]), "".join(run[p % 16 + 1 :])))
        level = [_h(*level[a : a + 16]) for a in range(0, len(level), 16)]
        place = [p // 16 for p in place]
    return level[0], steps


def _plain(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)
    out, tops = [], []
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        own = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r)))
        tops.append((own, *_climb([_leaf(r) for r in own])))
    root, above = _climb([t[1] for t in tops])
    for (own, subroot, steps), more in zip(tops, above, strict=True):
        for row, path in zip(own, steps, strict=True):
            changed = row
            if row[0] is not None and row[4] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0:
                changed = (*row[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4]))
            folded = _leaf(changed)
            for a, b in path + more:
                folded = _h(a, folded, b)
            out.append((row[0], _leaf(row), subroot, root, _h(*[a + b for a, b in path + more]), folded, folded == root))
    return sorted(out, key=repr)


def _rows(rng, sizes):
    out, k = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            out.append((k, source, rng.choice(["en", None]), rng.choice([3, None]), rng.choice([None, "", "Ab é", "low", f"T{k}"])))
            k += 1
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("sizes", [{"a": 1}, {None: 1, "b": 16}, {"a": 17, None: 2, "é": 256, "B": 257, "": 1}, {"hot": 5000, "x": 15, **{f"s{i}": 1 for i in range(300)}}])
def test_against_plain(spark, sizes):
    rows = _rows(random.Random(1), sizes)
    got = merkle.tampered(spark.createDataFrame(rows, SCHEMA), sorted_rows=700)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=repr) == _plain(rows)


def test_ties_nulls_and_repeated_rows(spark):
    rows = [(7, "s", "en", 1, f"T{i % 3}") for i in range(40)] + [(None, "s", None, None, None)] * 20 + [(None, None, None, None, None), (-1, None, "", 0, "")]
    assert sorted(map(tuple, merkle.tampered(spark.createDataFrame(rows, SCHEMA), sorted_rows=9).collect()), key=repr) == _plain(rows)


def test_long_text_and_clashing_columns(spark):
    rows = [(1, "s", "en", 1, "Word " * 400_000), (2, "s", "en", 1, "b")]
    df = spark.createDataFrame([(*r, "x", 0, 1) for r in rows], SCHEMA + ", `group` string, node int, KEY int")
    assert sorted(map(tuple, merkle.tampered(df).collect()), key=repr) == _plain(rows)
    path = {r.doc_id: r for r in merkle.manifest(df).collect()}
    assert merkle_root(path[2].leaf, path[2].path) == path[2].root == path[1].root


def merkle_root(leaf, path):
    for s in path:
        leaf = _h(s.left, leaf, s.right)
    return leaf


def test_manifest_paths_lead_to_the_root(spark):
    rows = _rows(random.Random(2), {"a": 300, "b": 5, None: 1})
    got = merkle.manifest(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows) and len({r.root for r in got}) == 1
    assert all(merkle_root(r.leaf, r.path) == r.root for r in got)


def test_empty_table(spark):
    assert merkle.tampered(spark.createDataFrame([], SCHEMA)).collect() == []
