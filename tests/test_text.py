import re

import pytest
from loomgraph.functions import json_repair, text, vocab
from pyspark.sql import functions as F

NAMES = ["OpenAI, Inc.", " Acme Corp., Ltd", "Foo Co. Limited", "x-Y_z. 3.5", "GPT-4", "ChatGPT", "Claude 3.5", "OpenAI_API", "v1.2.x", "a. b .5", "", None, "  ", "ABC limited co", "Büro Co."]


def key(name):
    name = (name or "").strip().lower()
    for s in text.LEGAL_SUFFIXES:
        if name.endswith(s):
            name = name[: -len(s)].strip()
    return re.sub(r"\s+", "", re.sub(r"[-_.]", "", name))


def tokens(name):
    t = re.sub(r"([a-z])([A-Z])", r"\1 \2", (name or "").strip()).lower().replace("_", " ")
    t = re.sub(r"(?<!\d)\.", " ", re.sub(r"\.(?!\d)", " ", t)).replace("-", " ")
    return re.sub(r"(\d)([a-zA-Z])", r"\1 \2", re.sub(r"([a-zA-Z])(\d)", r"\1 \2", t)).split()


@pytest.fixture(scope="module")
def names(spark):
    return spark.createDataFrame([(i, n) for i, n in enumerate(NAMES)], "i int, name string")


def test_keys_and_tokens(names):
    for r in names.select("i", text.match_key(F.col("name")).alias("k"), text.bm25_tokens(F.col("name")).alias("t")).collect():
        assert r.k == key(NAMES[r.i]) and r.t == tokens(NAMES[r.i]), NAMES[r.i]


def test_vocabulary(spark):
    rows = [("LLM ", "AIModel"), ("大模型", "AIModel"), ("gpaimodel", "GPAIModel"), ("penalty", "EnforcementAction"), ("x", None), (None, None)]
    got = spark.createDataFrame(rows, "raw string, want string").select("want", vocab.normalize_class(F.col("raw")).alias("c")).collect()
    assert all(r.want == r.c for r in got)
    rel = spark.createDataFrame([("developed by", "develops"), ("Leads To", "leadsTo"), ("HASRISK", "hasRisk"), ("nope", None)], "raw string, want string")
    assert all(r.want == r.c for r in rel.select("want", vocab.normalize_relation(F.col("raw")).alias("c")).collect())
    assert len(vocab.CLASSES) == 43 and len(vocab.RELATIONS) == 37 == len(vocab.CONSTRAINTS)
    assert sum(len(v.split(",")) for v in vocab.CLASS_ALIASES.values()) == 86 and sum(len(v.split(",")) for v in vocab.RELATION_ALIASES.values()) == 43


def test_mentions_choices_and_windows(spark):
    row = spark.range(1).select(
        text.mention_span(F.lit("The Big apple"), F.lit("big")).alias("loose"), text.mention_span(F.lit("a"), F.lit("")).alias("none"), text.parse_choice(F.lit(" 2 · yes")).alias("c"), text.parse_choice(F.lit("x")).alias("no"),
        text.strip_links(F.lit("see [it](https://a.b/c) now")).alias("link"), text.source_doc_id(F.lit("event_level"), F.lit("[d7] text"), F.lit("f")).alias("doc"), text.source_doc_id(F.lit(None).cast("string"), F.lit("text"), F.lit("f")).alias("fall"),
        text.context_window(F.lit("y" * 3000 + "needle" + "z" * 3000), F.lit("needle")).alias("w"), text.camel(F.lit("is_part of")).alias("camel"), text.year_of(F.lit("2021-03")).alias("year"),
    ).first()
    assert (row.loose.start, row.loose.end, row.loose.text) == (4, 7, "Big") and row.none is None
    assert (row.c, row.no, row.link, row.doc, row.fall, row.camel, row.year) == (2, -1, "see it now", "d7", "f", "isPartOf", 2021)
    assert "needle" in row.w and len(row.w) < 1200


def test_web_page(spark):
    nav = ["Sign in", "Subscribe", "My profile", "x"]
    body = ["A long line about the robot incident in the city today", "more text of the story that goes on", "short"]
    page = "\n".join([*nav, *body, "f" * 600, "end", ""])
    got = spark.range(1).select(text.clean_web_page(F.lit(page), F.lit("Robot incident report")).alias("a"), text.clean_web_page(F.lit("tiny"), F.lit("t")).alias("b"), text.clean_web_page(F.lit(page.replace("Sign in", "Hello")), F.lit("t")).alias("c")).first()
    assert got.a == "\n".join([*body, "f" * 600]) and got.b == "tiny" and got.c == page.replace("Sign in", "Hello")


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ('{"a": 1}', {"a": 1}), ('```json\n{"a": [1, 2,],}\n```', {"a": [1, 2]}), ('Sure: {"a": "b"} done', {"a": "b"}), ('{"n": seven}', {"n": 7}), ('{"a": "say "hi" now", "b": 2}', {"a": 'say "hi" now', "b": 2}),
        ('{a: 1, b: "x"}', {"a": 1, "b": "x"}), ('{"a": "x"\n"b": 2}', {"a": "x", "b": 2}), ('{"a": 1 // note\n}', {"a": 1}), ('{"u": "[t](https://x.y)"}', {"u": "t"}), ('{"a": "line\nbreak"}', {"a": "line break"}), ("nothing", None), ("", None), (None, None),
    ],
)
def test_json_repair(raw, want):
    assert json_repair.parse(raw) == want


def test_json_column(spark):
    rows = spark.createDataFrame([('{"a": 1}',), ("{a: 2}",), ("no",), (None,)], "raw string").select(json_repair.repaired_json(F.col("raw")).alias("x"), json_repair.composed(F.lit("ﬁne")).alias("c")).collect()
    assert [r.x for r in rows] == ['{"a": 1}', '{"a": 2}', None, None] and rows[0].c == "fine"
