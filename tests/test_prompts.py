import json

from loomgraph.sources import providers


def test_sections_of_long_and_short_prompts(spark):
    core = spark.createDataFrame([("e", ["a", "é"], [], ["t"]), ("f", ["x"], [], [])], "event_id string, ai_systems array<string>, stakeholders array<string>, ai_techniques array<string>")
    evidence = spark.createDataFrame([("e", i, f"s{i}", f"d{i}" if i != 2 else None) for i in range(1, 50)] + [("g", 1, "s", "d")], "event_id string, rank int, sentence string, doc_id string")
    support = spark.createDataFrame([("e", f"n{i:02}", 40 - i // 2) for i in range(40)], "event_id string, name string, support int")
    got = {r.section: r for r in providers.prompt_inputs(core, evidence, support).collect()}
    assert got.keys() == {"risk_chain", "inference"} and {r.event_id for r in got.values()} == {"e"}  # f has no evidence, g nothing to tell
    assert got["risk_chain"].evidence.split("\n")[:2] == ["- [d1] s1", "- [?] s2"] and len(got["risk_chain"].evidence.split("\n")) == 30 and len(got["inference"].evidence.split("\n")) == 20
    assert list(json.loads(got["risk_chain"].support).items())[:3] == [("n00", 40), ("n01", 40), ("n02", 39)] and len(json.loads(got["risk_chain"].support)) == 25
    assert json.loads(got["inference"].core) == {"ai_systems": ["a", "é"], "stakeholders": [], "ai_techniques": ["t"]} and got["inference"].support == "{}"
    short = {r.section: r for r in providers.prompt_inputs(core, evidence, support, compact=True).collect()}
    assert {k: len(r.evidence.split("\n")) for k, r in short.items()} == {"risk_chain": 12, "risk_chain_again": 4, "fields": 10, "fields_again": 6, "roles": 4, "roles_again": 4}
    assert len(json.loads(short["risk_chain_again"].support)) == 6 and json.loads(short["roles"].core) == {"ai_systems": ["a", "é"], "stakeholders": []}
    alone = providers.prompt_inputs(core, evidence, support.limit(0)).filter("section = 'risk_chain'").first()
    assert alone.support == "{}"
