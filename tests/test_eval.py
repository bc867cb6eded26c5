import json

import pytest
from loomgraph.functions import taxonomy
from loomgraph.operators import analytics, arbitration, judged, metrics, package, similarity
from loomgraph.plans import align, build
from loomgraph.sources import readers, writers
from loomgraph.streaming import registry
from pyspark.sql import functions as F

NODE = f"event_id string, pos long, id string, name string, entity_type string, description string, evidence {build.EVIDENCE}, extraction_mode string, confidence double, support_count int, source_doc_ids array<string>, attributes map<string,string>, reasoning string"


def node(event, pos, name, kind="AISystem", support=1, attributes=None):
    return (event, pos, f"{event}-{pos}", name, kind, name, [], "explicit", 0.5, support, ["d"], attributes or {}, None)


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def ratings(spark):
    data = [(1, "e1", "a", 3), (3, "e1", "a", 3), (1, "e1", "b", 2), (3, "e1", "b", 1), (1, "e2", "a", 1), (3, "e2", "a", 1), (1, "e2", "b", 1), (1, "e3", "a", 2), (2, "e4", "a", 1), (4, "e4", "a", 2), (None, "e4", "a", 3)]
    return spark.createDataFrame(data, "rater int, event_id string, field string, rating int")


def test_pairs_and_tasks(spark, ratings):
    assert rows(arbitration.common_events(ratings), "pair", "event_id") == [(1, "e1"), (1, "e2"), (2, "e4")]
    tasks = {r.event_id: r for r in arbitration.slot_tasks(ratings).collect()}
    assert tasks.keys() == {"e1", "e4"}  # a field that one rater left open is no dispute
    assert [tuple(x) for x in tasks["e1"].agreed] == [("a", 3)] and [tuple(x) for x in tasks["e1"].disputed] == [("b", 2, 1)]
    assert rows(arbitration.dispute_counts(arbitration.slot_tasks(ratings)), "pair", "field", "n") == [(1, "b", 1), (2, "a", 1)]
    decided = spark.createDataFrame([("e1", "a", 3), ("e1", "b", 3), ("e3", "a", 1), ("e9", "a", 1)], "event_id string, field string, rating int")
    got = rows(arbitration.arbitrated(ratings, decided), "event_id", "field", "rating", "origin")
    assert got == [("e1", "a", 3, "arbitrated"), ("e1", "b", 3, "arbitrated"), ("e2", "a", 1, "unsettled"), ("e2", "b", 1, "unsettled"), ("e3", "a", 2, "original"), ("e4", "a", 1, "unsettled")]
    assert arbitration.slot_tasks(ratings.limit(0)).count() == arbitration.arbitrated(ratings.limit(0), decided).count() == 0


def test_label_disputes(spark):
    data = [(1, "e", "x", ["A"]), (3, "e", "x", ["B"]), (1, "e", "y", ["A"]), (3, "e", "y", ["A"]), (1, "f", "x", ["A"]), (3, "f", "x", ["A"]), (3, "f", "x", ["A"])]
    got = arbitration.label_disputes(spark.createDataFrame(data, "rater int, event_id string, text string, labels array<string>")).collect()
    assert [(r.event_id, [tuple(m) for m in r.only_a], [tuple(m) for m in r.only_b]) for r in got] == [("e", [("x", ["A"])], [("x", ["B"])])]


def test_deleted_predictions_count_once_an_annotation(spark):
    predicted = spark.createDataFrame([("t", 1), ("t", 2), ("u", 3)], "task string, item int")
    kept = spark.createDataFrame([("t", "a", 1), ("t", "b", 1), ("t", "b", 2)], "task string, annotation string, item int")
    assert rows(metrics.deleted(predicted, kept, ["task", "item"]), "annotation", "task", "item", "outcome") == [("a", "t", 2, "fp")]


def test_stakeholders_are_summed_up_once(spark):
    spans = spark.createDataFrame([("Regulator", "exact"), ("AIUser", "fp"), ("AISystem", "exact")], "kind string, outcome string")
    got = {r.kind: (r.tp, r.predicted) for r in metrics.precision_recall(metrics.with_stakeholders(spans)).collect()}
    assert got == {"Regulator": (1.0, 1), "AIUser": (0.0, 1), "AISystem": (1.0, 1), "Stakeholder(agg)": (1.0, 2), "Overall": (2.0, 3)}


def test_judge_and_people(spark):
    a = spark.createDataFrame([(1, 2), (2, 1), (3, 0), (4, 2)], "edge_key int, label int")
    b = spark.createDataFrame([(1, 2), (2, 0), (3, 0), (4, 1)], "edge_key int, label int")
    c = spark.createDataFrame([(2, 1)], "edge_key int, label int")
    assert rows(judged.consensus(a), "edge_key", "label") == [(1, 2), (2, 1), (3, 0), (4, 2)]
    assert rows(judged.consensus(a, b), "edge_key", "label") == [(1, 2), (3, 0)]
    settled = judged.consensus(a, b, c)
    assert rows(settled, "edge_key", "label") == [(1, 2), (2, 1), (3, 0)]
    judge = spark.createDataFrame([(1, True), (2, True), (3, False)], "edge_key int, verdict boolean")
    folds = {r.fold: r for r in judged.judge_folds(settled, judge).collect()}
    assert (folds["strict"].tp, folds["strict"].fp, folds["strict"].accuracy) == (1, 1, 0.6667) and (folds["lenient"].tp, folds["lenient"].kappa) == (2, 1.0)
    labels = spark.createDataFrame([(i, 2 if i % 4 else 0) for i in range(200)], "edge_key int, label int")
    got = judged.adjusted_support(labels, 9000, 3000).first()
    assert (got.n, got.rate, got.esr) == (200, 0.75, 93.8) and 92.0 < got.low < 92.7 and 94.8 < got.high < 95.6
    assert judged.adjusted_support(labels, 9000, 3000).first() == got


def test_groups_of_statements(spark):
    nodes = spark.createDataFrame([node("e", i, n, k) for i, (n, k) in enumerate([("s", "AISystem"), ("x", "Risk"), ("y", "Impact"), ("z", "Risk"), ("r", "Regulator"), ("t", "Stakeholder")])], NODE)
    data = [(0, "uses", 1), (1, "uses", 2), (2, "has", 1), (3, "has", 3), (4, "involvesStakeholder", 4), (5, "involvesStakeholder", 5), (6, "one", 1)]
    names = ["s", "x", "y", "z", "r", "t"]
    edges = spark.createDataFrame([("e", p, f"i{p}", "e-0", "S", rel, f"e-{o}", names[o].upper(), "explicit") for p, rel, o in data], "event_id string, pos long, id string, subject_id string, subject_name string, predicate string, object_id string, object_name string, extraction_mode string")
    said = spark.createDataFrame([("full|e|group|s|uses", True)], "key string, verdict boolean")
    got = {r.predicate: (r.objects, r.rule_ok, r.verdict) for r in judged.statement_groups(edges, nodes, said).collect()}
    assert got == {"uses": (2, False, True), "has": (2, True, None), "involvesStakeholder": (2, True, None), "one": (1, True, None)}
    one = judged.consistency(judged.statement_groups(edges, nodes, said)).first()
    assert (one.groups, one.multi, one.judged, one.cdc_rule, one.cdc_judged) == (4, 3, 1, 75.0, 50.0)


def test_taxonomy(spark):
    assert len(taxonomy.SUBDOMAINS) == 23 and {s[0] for s in taxonomy.SUBDOMAINS} == taxonomy.DOMAINS.keys()
    said = spark.createDataFrame([(1, "2.2", "nonsense"), (2, "0", None), (3, "9.9", "Other"), (4, "9.9", "x"), (5, None, None)], "id int, subdomain_id string, domain string")
    assert rows(taxonomy.validated(said), "id", "subdomain_id", "domain") == [(1, "2.2", "Privacy & security"), (2, "0", "Other"), (3, "0", "Other"), (4, None, None), (5, None, None)]
    names = spark.createDataFrame([("x_AIUser",), ("the AIDeployer",), ("y_z",), (None,), ("none",)], "n string")
    assert [r[0] for r in names.select(taxonomy.tracked_role(F.col("n"))).collect()] == ["AIUser", "AIDeployer", None, None, None]
    assert rows(analytics.shares(taxonomy.validated(said).select("domain"), ["domain"], taxonomy.domains(spark).drop("rank")).filter("n > 0"), "domain", "n", "share") == [("Other", 2, 0.6667), ("Privacy & security", 1, 0.3333)]
    assert analytics.shares(said.limit(0).select("domain"), ["domain"], taxonomy.domains(spark).drop("rank")).filter("share > 0").count() == 0


def test_system_attributes(spark):
    nodes = spark.createDataFrame([node("e", 0, "a"), node("e", 1, "b", support=3, attributes={"k": "", "own": "1"}), node("e", 2, "c", "AIModel", 9), node("f", 0, "d")], NODE)
    given = spark.createDataFrame([("e", "k", "v", 0.5), ("e", "k", "w", 0.9), ("e", "own", "2", 0.9), ("e", "low", "x", 0.4), ("e", "none", "", 0.9), ("e", "new", "n", 0.7), ("g", "k", "v", 0.9)], "event_id string, attribute string, value string, confidence double")
    got = {r.id: r.attributes for r in build.with_system_attributes(nodes, given).collect()}
    assert got == {"e-0": {}, "e-1": {"k": "w", "own": "1", "new": "n"}, "e-2": {}, "f-0": {}}
    core = {r.event_id: r for r in build.core_for_roles(nodes).collect()}
    assert core["e"].ai_systems == ["a", "b"] and core["e"].ai_models == ["c"] and core["f"].regulations == []


def test_shapes(spark):
    raw = spark.createDataFrame([('{"a": 1}',), ("[1]",), ('[{"a": 1}, 2, "x", {"b": 2}]',), ("broken {",), (None,)], "r string")
    got = raw.select(build.safe_section(F.col("r")).alias("s"), build.safe_list(F.col("r")).alias("l")).collect()
    assert [r.s for r in got] == ['{"a": 1}', "{}", "{}", "{}", "{}"]
    assert [[json.loads(x) for x in r.l] for r in got] == [[], [], [{"a": 1}, {"b": 2}], [], []]


def test_alias_holds_in_its_own_event(spark):
    nodes = spark.createDataFrame([node("1", 0, "Vision"), node("1", 1, "Vision Pro"), node("2", 0, "Vision"), node("2", 1, "Vision Max")], NODE)
    vectors = spark.createDataFrame([("Vision", [1.0, 0.0, 0.0]), ("Vision Pro", [0.0, 1.0, 0.0]), ("Vision Max", [0.0, 0.0, 1.0])], "name string, vector array<double>")
    none = spark.createDataFrame([], "a string, b string, same boolean")
    got = align.align_event_entities(nodes, vectors, none)
    assert rows(got, "event_id", "name") == [("1", "Vision"), ("2", "Vision")]  # the first of each two gives the name


def test_verified_pairs_are_joined(spark):
    nodes = spark.createDataFrame([node("1", 0, "red fox"), node("1", 1, "crimson fox"), node("1", 2, "blue bird")], NODE)
    vectors = spark.createDataFrame([("red fox", [1.0, 0.0]), ("crimson fox", [0.8, 0.6]), ("blue bird", [0.0, 1.0])], "name string, vector array<double>")
    pairs = align.hybrid_pairs(nodes.select(F.lit("1|AISystem").alias("kind"), "id", "name"), vectors, 0.55).collect()
    assert [(r.a, r.b) for r in pairs] == [("1-0", "1-1")] and pairs[0].score < 0.8
    for same, n in ((True, 2), (False, 3)):
        verdict = spark.createDataFrame([("1-0", "1-1", same)], "a string, b string, same boolean")
        assert align.align_event_entities(nodes, vectors, verdict).count() == n


def test_registry_survives_restarts_and_replays(spark, tmp_path):
    path = f"file://{tmp_path}/registry"
    batch = lambda *n: spark.createDataFrame([node("e", i, x, "AISystem", 2) for i, x in n], NODE)
    registry.Registry(spark, path).absorb(batch((0, "Alpha"), (1, "Beta")), 0)
    again = registry.Registry(spark, path)
    again.absorb(batch((2, "ALPHA")), 1)
    again.absorb(batch((2, "ALPHA")), 1)  # the same batch once more
    registry.Registry(spark, path).absorb(batch((3, "Gamma")), 2)
    held = registry.Registry(spark, path)
    assert rows(held.current(), "key", "support_count") == [("alpha", 4), ("beta", 2), ("gamma", 2)]
    held.compact()
    assert held.versions() == [2, 3] and rows(held.current(), "key", "support_count") == [("alpha", 4), ("beta", 2), ("gamma", 2)]
    vectors = spark.createDataFrame([("Alpha", [1.0, 0.0]), ("ALPHA", [1.0, 0.0]), ("Alfa", [0.99, 0.1]), ("Beta", [0.0, 1.0]), ("Gamma", [0.7, 0.7]), ("Delta", [-1.0, 0.0])], "name string, vector array<double>")
    semantic = registry.Registry(spark, path, vectors, 0.95)
    semantic.absorb(batch((4, "Alfa"), (5, "Delta")))
    assert rows(semantic.current(), "key", "support_count") == [("alpha", 6), ("beta", 2), ("delta", 2), ("gamma", 2)]


def test_pairs_of_equal_keys_and_blocks(spark):
    data = [(i, "k", [float(i % 7), 1.0, float(i % 3)]) for i in range(60)] + [(5, "k", [0.0, 0.0, 0.0]), (None, "k", [1.0, 1.0, 1.0]), (61, None, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(data, "id int, kind string, vector array<double>")
    got = [rows(similarity.similar_pairs(df, 0.99, kind="kind", block=b), "kind", "a", "b", "score") for b in (1024, 7)]
    assert got[0] == got[1] and all(a < b for _, a, b, _ in got[0]) and len({r[:3] for r in got[0]}) == len(got[0])
    assert not any(5 in r[1:3] for r in got[0])  # of two vectors of one key the least counts


def test_files(spark, tmp_path):
    (tmp_path / "docs.jsonl").write_text('{"case_id": "", "id": "1", "text": "a"}\n{"case_id": "2", "text": "b", "translated_text": "B"}\n\n{"id": "1", "text": "later"}\n{"text": "no id"}\n')
    assert rows(readers.load_docs(spark, f"file://{tmp_path}/docs.jsonl"), "doc_id", "content") == [("1", "later"), ("2", "B")]
    for read in (readers.load_docs, readers.read_cases, readers.read_case_map, readers.read_events):
        with pytest.raises(FileNotFoundError):
            read(spark, f"file://{tmp_path}/nothing.json")
    df = spark.createDataFrame([("a", 1), ("b,c", 2)], "x string, n int")
    writers.write_rows(df, f"file://{tmp_path}/csv")
    writers.write_rows(df, f"file://{tmp_path}/json", "jsonl")
    assert rows(readers.read_csv(spark, f"file://{tmp_path}/csv", "x string, n int"), "x", "n") == rows(spark.read.json(f"file://{tmp_path}/json"), "x", "n") == [("a", 1), ("b,c", 2)]
    assert writers.clear(spark, f"file://{tmp_path}/csv") and not writers.clear(spark, f"file://{tmp_path}/csv")
    with pytest.raises(ValueError):
        writers.write_rows(df, f"file://{tmp_path}/x", "xml")
    (tmp_path / "c.json").write_text('{"a": {"b": "${NOT_SET:7}"}}')
    assert readers.load_config(f"{tmp_path}/c.json", {"a": {"c": 1}}).values == {"a": {"b": 7, "c": 1}}
    assert readers.load_config(f"{tmp_path}/none.json", {"a": 1}).get("a") == 1


def test_strongest(spark):
    held = spark.createDataFrame([("e", "b", 2), ("e", "a", 2), ("e", "c", 9)], "event_id string, name string, support int")
    assert [r.name for r in package.strongest(held, 2).orderBy("rank").collect()] == ["c", "a"]


def test_resamples_are_summed_up_in_tasks(spark):
    rows = spark.createDataFrame([(str(i), None if i % 7 == 0 else i % 3 == 0) for i in range(50)] + [(None, True)], "id string, yes boolean").coalesce(1)
    each = metrics.replicates(rows, "id", 30, 5).groupBy("replicate")
    said = F.col("yes").cast("int")
    want = each.agg(F.sum("weight").alias("drawn"), F.sum(F.when(said.isNotNull(), F.col("weight")).otherwise(0)).alias("known"), F.sum(F.when(F.col("yes"), F.col("weight")).otherwise(0)).alias("true"))
    got = metrics.resampled(rows, "id", F.col("yes"), 30, 5)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert metrics.resampled(rows.filter("id = 'none'"), "id", F.col("yes"), 30).count() == 0
