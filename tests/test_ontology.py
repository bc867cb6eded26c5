import json

import pytest

from loomgraph.functions import vocab
from loomgraph.sources import readers


def test_constraints_of_a_file(spark, tmp_path):
    fixed = {r.predicate: (r.domain, r.range) for r in vocab.constraints(spark).collect()}
    file = tmp_path / "o.json"
    file.write_text(json.dumps({"relations": {p: {"domain": d, "range": r} for p, (d, r) in fixed.items()}}, indent=1))
    assert {r.predicate: (r.domain, r.range) for r in readers.read_ontology(spark, f"file://{file}").collect()} == fixed
    file.write_text('{"relations": {"causes": {"domain": [" risksource", "RISK", "Risk", "nothing"]}, "other": null}}')
    assert sorted(map(tuple, readers.read_ontology(spark, f"file://{file}").collect())) == [("causes", ["RiskSource", "Risk"], []), ("other", [], [])]
    file.write_text("{}")
    assert readers.read_ontology(spark, f"file://{file}").count() == 0
    with pytest.raises(FileNotFoundError):
        readers.read_ontology(spark, f"file://{tmp_path}/none.json")
