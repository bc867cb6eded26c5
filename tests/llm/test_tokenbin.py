import random
import zlib

import numpy as np
import pytest
from loomgraph.llm import tokenbin
from pyspark.sql import functions as F
from tokenizers import Tokenizer

PATH = tokenbin.default_tokenizer()


def test_ids_equal_whole_texts():
    rng = random.Random(3)
    bits = [" ", "  ", "\n", "\t", "a", "don't", "É", "1234", "...", " ", " ", "<|endoftext|>", "the", "\x1c", "\x85", "word", "漢字", "\0", "\0x", "'s", " \n", "😀", "​"]
    texts = ["", " ", "  a", "a  ", "a b", "a \n b"] + ["".join(rng.choice(bits) for _ in range(rng.randrange(30))) for _ in range(3000)]
    plain = Tokenizer.from_file(PATH)
    coder = tokenbin.Encoder(PATH, room=500)
    for lo in range(0, len(texts), 100):
        ids, counts = coder.encode(texts[lo : lo + 100])
        bound = np.concatenate([[0], np.cumsum(counts)])
        for t, a, b in zip(texts[lo : lo + 100], bound, bound[1:]):
            assert ids[a:b].tolist() == plain.encode(t, add_special_tokens=False).ids + [2], t


def test_file(tmp_path):
    url = f"file://{tmp_path}/x.tid"
    w = tokenbin.Writer(url)
    rng = np.random.default_rng(1)
    counts = rng.integers(1, 50_000, 40)
    counts[7] = 400_000
    ids = rng.integers(0, 50_000, counts.sum()).astype(np.uint32)
    bound = np.concatenate([[0], np.cumsum(counts)])
    for a, b in ((0, 10), (10, 11), (11, 40)):
        w.add(np.arange(a, b), np.ones(b - a), counts[a:b], ids[bound[a] : bound[b]])
    assert w.close() == counts.sum()
    r = tokenbin.Reader(url)
    assert len(r.frames) > 3
    assert (r.document(25) == ids[bound[25] : bound[26]]).all() and r.decompressed == 1
    for i in (0, 7, 8, 39):
        assert (r.document(i) == ids[bound[i] : bound[i + 1]]).all()
    path = tmp_path / "x.tid"
    raw = bytearray(path.read_bytes())
    raw[100] ^= 1
    path.write_bytes(raw)
    with pytest.raises(Exception):
        tokenbin.Reader(url).document(0)


def brute(rows):
    plain, at, out = Tokenizer.from_file(PATH), 0, []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = plain.encode(t or "", add_special_tokens=False).ids + [2]
        out.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return sorted(out, key=str)


def test_small_tables(spark):
    rows = [(5, "five"), (3, None), (None, "no id"), (4, ""), (5, "five"), (9, "é" * 9000), (-2, "a <|endoftext|> b")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, shard int")
    assert sorted(map(tuple, tokenbin.round_trip(df).collect()), key=str) == brute(rows)
    assert tokenbin.round_trip(df.limit(0)).count() == 0


def test_whole_table(spark, tmp_path):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    (tmp_path / "ids").mkdir()
    url = f"file://{tmp_path}/ids"
    got = tokenbin.read(spark, url, tokenbin.write(df, url, shard_bytes=40_000))
    assert len(list((tmp_path / "ids").iterdir())) > 4
    assert sorted(map(tuple, got.collect()), key=str) == brute([tuple(r) for r in df.collect()])


def test_fetch_by_id(spark, tmp_path):
    rows = [(i, f"text number {i} " * (i % 40)) for i in range(300)] + [(7, "again"), (None, "no id"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    url = f"file://{tmp_path}"
    shards = tokenbin.write(df, url, shard_bytes=20_000)
    assert shards.count() > 3 and not list(tmp_path.glob("*.part"))
    plain = Tokenizer.from_file(PATH)
    wanted = spark.createDataFrame([(7,), (250,), (299,), (5000,), (250,)], "doc_id long")
    got = sorted((r.doc_id, r.ids) for r in tokenbin.fetch(wanted, url, shards).collect())
    want = [(d, plain.encode(t or "", add_special_tokens=False).ids + [2]) for d, t in rows if d in (7, 250, 299)]
    assert got == sorted([*want, *[w for w in want if w[0] == 250]])
    reader = tokenbin.Reader(f"{url}/part-000000.tid")
    assert [len(reader.document(i)) for i in reader.find(None)] == [1, len(plain.encode("no id").ids) + 1] and reader.find(10**9) == []


def test_ranges_in_two_steps(spark):
    from loomgraph.llm import _ranges

    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("x" * 50).alias("text"))
    one, n = _ranges.with_range(df, 2500)
    two, m = _ranges.with_range(df, 2500, at_once=10)
    for rows, parts in ((one, n), (two, m)):
        got = rows.groupBy("part").agg(F.count("*").alias("n"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).orderBy("part").collect()
        assert [r.part for r in got] == list(range(parts)) and 80 <= parts <= 130
        assert all(r.b - r.a + 1 == r.n and 20 <= r.n <= 100 for r in got)
    dealt = _ranges.partitioned(two, "part", m, partitions=4)
    assert dealt.rdd.getNumPartitions() == 4 if hasattr(dealt, "rdd") else True
