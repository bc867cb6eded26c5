import random

from pyspark.sql import functions as F

from loomgraph.operators import analytics, keywords, package


def _texts(rng, n):
    return [(rng.choice(["hot", "hot", "hot", "a", "b", None]), i, None if rng.random() < 0.05 else "".join(rng.choice("abcé ") for _ in range(rng.randrange(40)))) for i in range(n)]


def test_found_words_by_brute_force(spark):
    rng = random.Random(5)
    texts = _texts(rng, 300)
    words = [(rng.choice(["hot", "a", "c", None]), "".join(rng.choice("abcé ") for _ in range(rng.randrange(0, 5)))) for _ in range(150)] + [("a", None), ("b", "")]
    want = sorted({(i, w) for s, i, t in texts for z, w in words if s is not None and s == z and t is not None and w is not None and w in t})
    t, w = spark.createDataFrame(texts, "event string, id int, text string"), spark.createDataFrame(words, "event string, text string")
    for block, stretch in ((1 << 20, 1 << 20), (40, 500)):
        got = keywords.found_words(t, w, "event", "id", "text", "text", block_bytes=block, stretch_bytes=stretch)
        assert sorted({tuple(r) for r in got.collect()}) == want and got.count() == len(want)
        some = keywords.found_words(t, w, "event", "id", "text", "text", any_=True, block_bytes=block, stretch_bytes=stretch)
        assert {r.key for r in some.collect()} == {i for i, _ in want}
    assert keywords.found_words(t, w.limit(0), "event", "id", "text", "text").collect() == []


def test_a_hot_event_spreads_over_tasks(spark):
    texts = spark.range(4000).select(F.lit("hot").alias("event"), F.col("id"), F.concat(F.lit("word "), F.repeat("id", F.lit(20))).alias("text"))
    words = spark.createDataFrame([("hot", f"word {i}") for i in range(50)], "event string, word string")
    got = keywords.found_words(texts, words, "event", "id", "text", "word", stretch_bytes=4000)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = got.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(tasks) > 1 and got.filter("key = 37").count() == 2  # `word 3` and `word 37`


def test_rules_by_an_automaton(spark):
    rng = random.Random(6)
    rules = [(f"r{i}", [rng.choice("xyz") + "".join(rng.choice("abc") for _ in range(3)) for _ in range(15)]) for i in range(8)]
    texts = [("".join(rng.choice("abcxyzABC ") for _ in range(rng.randrange(60))), rng.choice([None, "", "xabc zccc"])) for _ in range(200)] + [(None, None)]

    def plain(text):
        low = (text or "").lower()
        return next((code for code, words in rules if any(w in low for w in words)), None)

    df = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "id int, a string, b string")
    got = {r.id: r.code for r in df.select("id", analytics.classify([F.col("a"), F.col("b")], rules).alias("code")).collect()}
    assert got == {i: plain(a) or plain(b) for i, (a, b) in enumerate(texts)} and len(set(got.values())) > 4
    assert df.select(analytics.classify([F.col("a")], [*rules, ("all", [""])]).alias("code")).filter("code is null").count() == 0


def test_entity_rich_of_one_event(spark):
    docs = spark.createDataFrame([("e", i, i, f"text {i} " + ("Alpha" if i % 3 == 0 else "beta")) for i in range(40)] + [("f", 0, 0, "alpha"), ("f", 1, 1, None)], "event_id string, doc_id int, pos int, content string")
    names = spark.createDataFrame([("e", "ALPHA"), ("e", "gamma"), ("f", "beta")], "event_id string, name string")
    chosen = spark.createDataFrame([("e", 0), ("e", 1)], "event_id string, doc_id int")
    assert sorted(r.doc_id for r in package.entity_rich(docs, names, chosen).collect()) == [3, 6, 9, 12, 15, 18]
