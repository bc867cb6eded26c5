import random

import pytest
from pyspark.sql import functions as F
from test_eval import NODE

from loomgraph.operators import merge, wide


def _made(spark, n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        proof = [{"evidence_id": f"e{i}-{k}", "evidence_sentence": "s", "source_doc_id": "d", "confidence": 0.5} for k in range(rng.randrange(3))]
        attributes = {k: rng.choice(["", "1", "2", None]) for k in rng.sample("abc", rng.randrange(3))}
        rows.append((f"e{rng.randrange(2)}", i, f"n{i}", rng.choice(["Acme", "acme", "Vision"]), rng.choice(["AISystem", "AIModel"]), rng.choice([None, "", "long", "longer"]), proof, "explicit", round(rng.random(), 3), rng.randrange(1, 4), rng.sample(["d1", "d2", "d3"], rng.randrange(4)), attributes, rng.choice([None, "", "why"])))
    return spark.createDataFrame(rows, NODE)


def _rows(df):
    order = ["event_id", "pos", "id", "name", "entity_type", "extraction_mode", "description", "evidence", "source_doc_ids", "confidence", "support_count", "reasoning"]
    own = F.array_sort(F.map_entries("attributes")).alias("attributes")
    return sorted(map(str, df.select(*order, own).collect()))


@pytest.mark.parametrize("longest", [False, True])
def test_both_forms_give_the_same_rows(spark, longest):
    entities = _made(spark, 60, 3)
    keys = [F.col("event_id"), F.lower("name"), F.col("entity_type")]
    assert _rows(wide.nested(wide.merged(wide.split(entities), keys, longest))) == _rows(merge.merge_entities(entities, keys, longest))
    assert wide.nested(wide.merged(wide.split(entities.limit(0)), keys)).count() == 0


def test_a_name_of_very_many_mentions(spark):
    """No row holds the mentions, and the first pieces of evidence are found through parts of them."""
    n = 60_000
    e = F.struct(F.concat(F.lit("e"), "id").alias("evidence_id"), F.lit("s").alias("evidence_sentence"), F.col("id").cast("string").alias("source_doc_id"), F.lit(0.5).alias("confidence"))
    rows = spark.range(n).select(
        F.lit("e").alias("event_id"), F.col("id").alias("pos"), F.concat(F.lit("n"), "id").alias("id"), F.lit("Acme").alias("name"), F.lit("AISystem").alias("entity_type"), F.lit("d").alias("description"),
        F.array(e).alias("evidence"), F.lit("explicit").alias("extraction_mode"), F.lit(0.5).alias("confidence"), F.lit(1).alias("support_count"), F.array(F.col("id").cast("string")).alias("source_doc_ids"),
        F.create_map(F.lit("k"), F.col("id").cast("string")).alias("attributes"), F.lit(None).cast("string").alias("reasoning"),
    )
    got = wide.merged(wide.split(rows), [F.col("event_id"), F.col("name")])
    one = got.entities.collect()
    assert len(one) == 1 and one[0].support_count == n and got.evidence.count() == n
    node = wide.nested(wide.WideEntities(got.entities, got.evidence, got.documents.limit(5), got.attributes), most=3).first()
    assert [x.evidence_id for x in node.evidence] == ["e0", "e1", "e2"] and node.attributes == {"k": "0"}


def test_rows_are_worked_out_once(spark):
    """Four tables come from the rows, and none of them works them out anew."""
    made, n = spark.sparkContext.accumulator(0), 60
    entities = _made(spark, n, 4)

    def counted(parts):
        for part in parts:
            made.add(part.num_rows)
            yield part

    rows = entities.mapInArrow(counted, entities.schema)
    assert _rows(wide.nested(wide.merged(wide.split(rows), [F.col("event_id"), F.lower("name")])))
    assert made.value == n
