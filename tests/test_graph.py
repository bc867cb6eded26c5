import json

import numpy as np
import pytest
from loomgraph.functions.vocab import constraints
from loomgraph.operators import components, merge, metrics, package, similarity, validate
from loomgraph.plans import align, build, pipeline
from loomgraph.sources import providers, readers, writers
from loomgraph.streaming import registry
from pyspark.sql import functions as F

EMPTY = "event_id string, field string, value string, evidence string, source_doc_id string, confidence double, reasoning string"


def entity(event, pos, name, kind, docs, conf=0.5, desc="", attrs=None, reason=None, support=1):
    proof = [(f"e{pos}", f"about {name}", docs[0], conf)]
    return (event, pos, f"{event}-{pos}", name, kind, desc, proof, "explicit", conf, support, docs, attrs or {}, reason)


@pytest.fixture(scope="module")
def entities(spark):
    rows = [
        entity("e1", 0, "OpenVision", "AISystem", ["d1"], 0.6, "short", {"a": "", "b": "1"}),
        entity("e1", 1, "OpenVision", "AISystem", ["d2", "d1"], 0.912, "a longer one", {"a": "2", "b": "3"}, "why"),
        entity("e1", 2, "Acme, Inc.", "Stakeholder", ["d1"]), entity("e1", 3, "acme", "Stakeholder", ["d2"]),
        entity("e1", 4, "Face matching", "AITechnique", ["d1"]), entity("e1", 5, "Data Office", "Regulator", ["d1"]), entity("e1", 6, "Data Act", "Regulation", ["d1"]),
        entity("e2", 0, "OpenVision", "AISystem", ["d3"], 0.4, support=4), entity("e2", 1, "algorithm", "AISystem", ["d3"]),
    ]
    types = f"event_id string, pos long, id string, name string, entity_type string, description string, evidence {build.EVIDENCE}, extraction_mode string, confidence double, support_count int, source_doc_ids array<string>, attributes map<string,string>, reasoning string"
    return spark.createDataFrame(rows, types)


@pytest.fixture(scope="module")
def reports(spark):
    rows = [("e1", 0, "d1", "A robot hurt one worker", "OpenVision and Acme. More.", "Paper", "u", "2020-01-02", "en"), ("e1", 1, "d2", "Robot", "text", None, "u", "2019-05-01", "en"), ("e2", 0, "d3", "", "text", "", "u", None, "de")]
    return spark.createDataFrame(rows, "event_id string, pos long, doc_id string, title string, content string, source_name string, url string, publish_time string, language string")


@pytest.fixture(scope="module")
def given(spark, entities):
    slots = [("e1", s, f"the {s}", "[d2] seen", None, None) for s in ("risk_source", "risk", "consequence", "impact", "hazard", "vulnerability", "risk_control")] + [("e2", "risk", "r", None, "d3", 0.4), ("e2", "impact", "i", None, "d3", 0.9), ("e2", "misuse", "m", None, "d3", 0.9)]
    roles = [("e1", "ACME, INC.", "AIDeveloper", "made it", "d1", None, "said so", 0), ("e1", "nobody", "AIUser", "x", "d1", 0.5, None, 1)]
    names = [r.name for r in entities.select("name").distinct().collect()]
    vectors = [(n, [1.0, 0.0] if "cme" in n.lower() else [0.0, 1.0] if n == "OpenVision" else [float(i), -1.0]) for i, n in enumerate(sorted(names))]
    return pipeline.Providers(
        entities, spark.createDataFrame(slots, "event_id string, slot string, value string, evidence string, source_doc_id string, confidence double"),
        spark.createDataFrame([("e1", "purpose", "watch", "", None, None, "r"), ("e2", "domain", "work", "", None, 0.8, "r")], EMPTY),
        spark.createDataFrame([("e1", "enforcement_action", "a fine", "", "d1", None, "r"), ("e1", "obligation", "tell", "", "d1", None, "r"), ("e1", "trend", "up", "", "d1", None, "r")], EMPTY),
        spark.createDataFrame(roles, "event_id string, stakeholder_name string, role string, evidence string, source_doc_id string, confidence double, reasoning string, pos long"),
        spark.createDataFrame(vectors, "name string, vector array<double>"), spark.createDataFrame([], "a string, b string, same boolean"),
    )


def test_merge(entities):
    got = {(r.event_id, r.name): r for r in merge.merge_entities(entities, [F.col("event_id"), F.col("name"), F.col("entity_type")]).collect()}
    one = got["e1", "OpenVision"]
    assert (one.id, one.description, one.confidence, one.support_count, one.source_doc_ids) == ("e1-0", "a longer one", 0.91, 2, ["d1", "d2"])
    assert one.attributes == {"a": "2", "b": "1"} and one.reasoning == "why" and [e.evidence_id for e in one.evidence] == ["e0", "e1"]
    assert got["e2", "OpenVision"].support_count == 4


def test_components_of_a_long_chain(spark):
    rows = spark.range(60).withColumnRenamed("id", "id")
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(40, 45), (45, 41), (50, 50)], "a long, b long")
    got = {r.id: r.component for r in components.connected_components(rows, links).collect()}
    assert all(got[i] == 0 for i in range(31)) and got[41] == got[45] == 40 and got[50] == 50 and len(got) == 60


def test_pairs_do_not_depend_on_blocks(spark):
    import random

    rng = random.Random(1)
    rows = spark.createDataFrame([(i, i % 2, [rng.gauss(0, 1) for _ in range(4)]) for i in range(80)] + [(99, None, [0.0] * 4)], "id int, kind int, vector array<double>")
    want = sorted(map(tuple, similarity.similar_pairs(rows, 0.5, kind="kind").collect()))
    assert want == sorted(map(tuple, similarity.similar_pairs(rows, 0.5, kind="kind", block=7).collect())) and len(want) > 50
    few = similarity.similar_pairs(rows, 0.5, kind="kind", block=20, best=2)
    top = lambda pairs: sorted(map(tuple, similarity.top_pairs(pairs, 2, "kind").collect()))
    assert few.count() <= 2 * 2 * 10 < len(want) and top(few) == top(spark.createDataFrame(want, few.schema))


def test_graphs(reports, given):
    out = pipeline.run_events(reports, given)
    nodes = {(r.event_id, r.entity_type): r for r in out["nodes"].collect()}
    edges = [(r.event_id, r.subject_name, r.predicate, r.object_name) for r in out["edges"].collect()]
    assert nodes["e1", "AIRiskIncident"].name == "A robot hurt one worker" and nodes["e2", "AIRiskIncident"].name == "e2"
    assert nodes["e1", "AIDeveloper"].name in ("Acme, Inc.", "acme") and ("e2", "Misuse") not in nodes
    for step in ((None, "the risk_source", "causes", "the risk"), (None, "the risk", "leadsTo", "the consequence"), (None, "the consequence", "impacts", "the impact"), (None, "the risk_control", "mitigates", "the risk")):
        assert ("e1", *step[1:]) in edges
    kinds = {(e, p) for e, _, p, _ in edges}
    assert ("e2", "impacts") not in kinds and ("e2", "hasRisk") in kinds and ("e1", "hasVulnerability") in kinds and ("e1", "hasHazard") in kinds
    assert set() == {("e1", p) for p in ("develops", "roleHeldBy", "hasRoleInIncident", "roleInvolvesSystem", "enforces", "investigates", "compliesWithRegulation", "usesTechnique", "hasCapability", "respondsToIncident", "imposesRequirement", "hasInformationSource", "hasReport", "involvesAISystem")} - kinds
    assert nodes["e2", "AITechnique"].name == "algorithm"
    rules = {(r.event_id, r.rule) for r in out["violations"].collect()}
    assert ("e2", "no consequence") in rules and not any(e == "e1" and r.startswith("no ") and r != "no evidence" for e, r in rules)
    fused = pipeline.fuse_events(out, given)
    ids = {r.event_id: r.id for r in fused["nodes"].filter("name = 'OpenVision'").collect()}
    assert ids["e1"] == ids["e2"] and fused["mapping"].filter("old_id != new_id").count() >= 1
    for variant in ("no_agg", "no_inference", "no_ontology", "no_evidence"):
        assert pipeline.run_events(reports, given, variant)["nodes"].count() > 0
    with pytest.raises(ValueError):
        pipeline.run_events(reports, given, "other")


def test_export(spark, reports, given, tmp_path):
    out = pipeline.run_events(reports, given)
    facts = writers.triples(out["nodes"], out["edges"], out["statements"], out["metadata"])
    lines = [r.value for r in writers.turtle_lines(facts).collect()]
    assert all(line.startswith("<") and line.endswith(" .") for line in lines) and any('"OpenVision"' in line for line in lines)
    writers.write_json(writers.nested(out["metadata"], out["nodes"], out["edges"], out["statements"]), f"file://{tmp_path}/json")
    back = [json.loads(x) for f in tmp_path.glob("json/*/*.json") for x in f.read_text().splitlines()]
    assert {b["event_id"] for b in back} == {"e1", "e2"} and all(b["nodes"] and b["edges"] for b in back)
    again = readers.read_subgraphs(spark, f"file://{tmp_path}/json/*/*.json")
    nodes, edges, told = readers.flatten_subgraphs(again)
    assert nodes.count() == out["nodes"].count() and edges.count() == out["edges"].count() and told.count() > 0
    assert writers.property_edges(out["edges"], out["nodes"]).count() > 0


def test_sources(spark, tmp_path, monkeypatch):
    (tmp_path / "cases.jsonl").write_text('{"id": "c1", "text": "old"}\n\n{"id": "", "original_id": "c2", "text_en": "two"}\n{"id": "c1", "text": "new", "from_database": "aiid", "release_date": "2020"}\n')
    (tmp_path / "events.json").write_text(json.dumps({"events": [{"incident_id": "i1", "ids": ["c2", "gone", "c1"]}], "gold_standard": [{"event_id": "g1", "labeling_cases": ["c1"]}]}))
    (tmp_path / "map.json").write_text(json.dumps({"k": {"title_cn": "t", "text_en": "", "text_cn": "x"}}))
    cases = readers.read_cases(spark, f"file://{tmp_path}/cases.jsonl")
    docs = readers.documents_of(readers.read_events(spark, f"file://{tmp_path}/events.json"), cases).orderBy("pos").collect()
    assert [(d.event_id, d.doc_id, d.content, d.language) for d in docs] == [("i1", "c2", "two", "en"), ("i1", "c1", "new", "en")]
    assert readers.read_events(spark, f"file://{tmp_path}/events.json", "gold").first().event_id == "g1"
    assert readers.read_case_map(spark, f"file://{tmp_path}/map.json").first().asDict() == {"case_id": "k", "title": "t", "text": "x", "summary": None, "source_name": None, "language": "zh"}
    with pytest.raises(ValueError):
        readers.read_events(spark, "x", "none")
    with pytest.raises(FileNotFoundError):
        readers.require(spark, f"file://{tmp_path}/nothing")
    monkeypatch.setenv("PORT", "7")
    c = readers.Config({"a": {"b": "${PORT:1}", "c": "${NONE:true}"}}, {"a": {"d": 2}})
    assert (c.get("a.b"), c.get("a.c"), c.get("a.d"), c.get("x.y", 9)) == (7, True, 2, 9)
    notes = spark.createDataFrame([("v", "1", "x", False, 1, 0), ("v", "2", "y", False, 1, 1), ("v", "3", "z", True, 1, 2), ("w", "1", "q", None, 1, 3)], "val_id string, updated_at string, choice string, was_cancelled boolean, completed_by int, pos int")
    assert {tuple(r) for r in readers.latest_choice(notes).collect()} == {("v", "y"), ("w", "q")}
    with pytest.raises(ValueError):
        readers.latest_choice(notes.withColumn("completed_by", F.col("pos")))


def test_extraction(spark, reports):
    lexicon = spark.createDataFrame([("OpenVision", "ai system"), ("Acme", "company"), ("other", "Risk")], "name string, entity_type string")
    assert {r.mention for r in providers.gazetteer(reports, lexicon).collect()} == {"OpenVision", "Acme"}
    raw = '{"entities": [{"mention": "OpenVision", "entity_type": "AI System", "evidence": "OpenVision and Acme.", "confidence": 1.7}, {"mention": "", "entity_type": "Risk", "confidence": 1}, {"mention": "x", "entity_type": "Risk", "evidence": "e", "confidence": 0.5},]}'
    answers = spark.createDataFrame([("e1", "d1", raw), ("e1", "d2", "I'm sorry")], "event_id string, doc_id string, raw string")
    got = providers.extracted_entities(providers.parsed_extractions(answers), reports).collect()
    assert [(r.name, r.entity_type, r.confidence, r.mention_span.start) for r in got] == [("OpenVision", "AISystem", 1.0, 0)]
    row = spark.range(1).select(providers.parsed_verdict(F.lit(" Yes ")).alias("y"), providers.bucket_of(F.lit('{"bucket_id": "b2"}'), ("b1", "b2")).alias("b"), providers.bucket_of(F.lit("maybe b1"), ("b1", "b2")).alias("m"), providers.bucket_of(F.lit("?"), ("b1",)).alias("o")).first()
    assert (row.y, row.b, row.m, row.o) == (True, "b2", "b1", "other")


def test_unions_and_support(spark, entities, reports):
    assert align.union_nodes(entities).filter("event_id = 'e1' and name = 'OpenVision'").first().support_count == 1
    rel = spark.createDataFrame([("e1", "openvision", "uses", "ACME"), ("e1", "x", "uses", "acme")], "event_id string, subject_name string, predicate string, object_name string")
    nodes, edges = align.union_by_name(entities, rel)
    assert edges.count() == 1 and nodes.filter("key = 'openvision' and event_id = 'e1'").first().mentions == 2
    chunks = {r.name: r.support for r in package.support_by_chunk(entities.filter("event_id = 'e1'"), reports).collect()}
    assert chunks["OpenVision"] == 2
    assert package.low_support(entities, reports).count() == 0
    est = metrics.bootstrap_interval(spark.createDataFrame([(i, i % 4 > 0) for i in range(200)], "id int, verdict boolean"), resamples=2000).first()
    assert est.estimate == 0.75 and 0.66 < est.low < 0.72 and 0.78 < est.high < 0.84


def test_streams(spark, entities, tmp_path):
    rows = entities.select("event_id", "pos", "id", "name", "entity_type", "support_count", "confidence")
    for i, part in enumerate(("e1", "e2")):
        rows.filter(F.col("event_id") == part).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    held = registry.Registry(spark, f"file://{tmp_path}/registry")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    held.follow(stream, f"file://{tmp_path}/check").awaitTermination()
    assert held.version == 2
    batch = {(r.kind, r.key, r.support_count) for r in registry.registered(rows).collect()}
    assert {(r.kind, r.key, r.support_count) for r in held.current().collect()} == batch
    events = spark.createDataFrame([("2024-01-01 00:00:01", 1), ("2024-01-01 00:00:30", 1)], "t string, user_id int").select(F.to_timestamp("t").alias("ts"), "user_id")
    assert registry.stream_rate(events, most=1).filter("not allowed").count() == 3  # windows that start 20 and 10 seconds before the minute, and at it


def test_rules_table(spark):
    rules = constraints(spark)
    assert rules.count() == 37
    nodes = spark.createDataFrame([("e", "a", "AIDeveloper"), ("e", "b", "AISystem")], "event_id string, id string, entity_type string")
    edges = spark.createDataFrame([("e", "a", "develops", "b"), ("e", "b", "develops", "a"), ("e", "a", "unknown", "b"), ("e", "a", "develops", "a"), ("e", "a", "develops", "z")], "event_id string, subject_id string, predicate string, object_id string")
    got = [(r.subject_id, r.predicate, r.object_id, r.problem) for r in validate.judged_edges(edges, nodes, rules).collect()]
    assert set(got) == {("a", "develops", "b", None), ("b", "develops", "a", "ontology"), ("a", "unknown", "b", None), ("a", "develops", "a", "self-loop"), ("a", "develops", "z", "dangling")}


def test_regulators_of_one_event_spread_over_tasks(spark):
    node = lambda n, kind, p: build.make_nodes(spark.range(n), event_id=F.lit("e"), pos=F.col("id"), id=F.concat(F.lit(p), "id"), name=F.col("id").cast("string"), entity_type=F.lit(kind), extraction_mode=F.lit("explicit"), confidence=F.lit(0.5), source_doc_ids=F.array(F.lit("d")))
    incident = spark.createDataFrame([("e", "incident")], "event_id string, name string")
    edges = build.regulator_edges(node(5000, "Regulator", "r").unionByName(node(40, "Regulation", "g")), incident)
    enforced = edges.filter("predicate = 'enforces'").withColumn("task", F.spark_partition_id())
    assert enforced.select("subject_id", "object_id").distinct().count() == enforced.count() == 200_000
    assert enforced.select("task").distinct().count() > 1 and edges.filter("predicate = 'investigates'").count() == 5000


@pytest.mark.parametrize("heads", [9, 40, None])
def test_greedy_by_vector_makes_no_pairs(spark, monkeypatch, heads):
    rng = np.random.default_rng(5)
    made = [(i, None if i % 9 == 0 else i % 2, -i // 2, rng.normal(size=3).tolist()) for i in range(200)] + [(900, 1, 7, None), (901, 1, 8, [0.0, 0.0, 0.0])]
    rows = spark.createDataFrame(made, "id long, group long, pos long, vector array<double>")
    apart = rows.withColumn("pos", F.struct("pos", "id"))
    want = similarity.greedy_leaders(apart, similarity.similar_pairs(rows, 0.6, kind="group").select("a", "b")).collect()
    monkeypatch.setattr(similarity, "similar_pairs", None)
    got = similarity.greedy_by_vector(rows, 0.6, heads=heads).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, want), key=repr) and 5 < sum(r.kept for r in got) < 100


def test_copies_of_regulations_do_not_grow_with_regulators(spark):
    held = lambda n: spark.range(n).select((F.col("id") % 3).cast("string").alias("event_id"), F.concat(F.lit("r"), "id").alias("_rid"))
    blocks = lambda n: build._blocks(held(n), 10).agg(F.sum("_blocks")).first()[0]
    most = build.ENFORCING * build._tasks(held(1)) + 3
    assert blocks(300) == 30 and blocks(30_000) <= most and blocks(90_000) <= most
    rules = spark.range(12).select((F.col("id") % 3).cast("string").alias("event_id"), "id")
    met = build._dealt(rules, held(3000), 10).select("event_id", "id", "_rid")
    assert met.count() == met.distinct().count() == 12 * 1000


def test_titles_of_an_incident_are_not_moved(spark):
    """Of 300 long titles the first five and the shortest leave their tasks."""
    def shuffled():
        context = spark.sparkContext
        stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    long = F.concat_ws(" ", *[F.sha2(F.concat(F.col("id").cast("string"), F.lit(f"-{i}")), 512) for i in range(16)])
    title = F.when(F.col("id") == 200, "of no more words").when(F.col("id") % 10 > 0, long)
    rows = spark.range(300).select(F.lit("e").alias("event_id"), F.col("id").alias("pos"), F.col("id").cast("string").alias("doc_id"), title.alias("title"))
    before = shuffled()
    (got,) = build.incidents(rows).collect()
    assert got.name == "of no more words" and [e.source_doc_id for e in got.evidence] == ["1", "2", "3", "4", "5"] and len(got.source_doc_ids) == 300
    assert shuffled() - before < 100_000
