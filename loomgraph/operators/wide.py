"""Merging where a name may have any number of mentions: evidence, documents and attributes as tables of their own.

`merge.merge_entities` puts all evidence of a merged entity in its row.  Here a row of an entity has no lists: what
grows with its mentions lies in tables with its owner and place, is moved by joins, and is put in rows only where a
sink wants it (`nested`).  Aggregates of an entity are folded on the map side.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.merge import first_filled, first_of, in_order, longest
from loomgraph.operators.rounds import settle

_PLAIN = ("event_id", "pos", "id", "name", "entity_type", "extraction_mode", "description", "confidence", "support_count", "reasoning")


@dataclass
class WideEntities:
    """entities (event_id, owner, pos and plain columns); evidence (owner, place, e), documents (owner, doc), attributes (owner, place, key, value).

    An owner is a row of its own; a place is in order of what was merged.
    """

    entities: DataFrame
    evidence: DataFrame
    documents: DataFrame
    attributes: DataFrame


def split(entities: DataFrame) -> WideEntities:
    """Entities with nested lists in the form of tables.  `event_id`, `id` and `pos` together tell rows apart.

    Rows are settled: four tables come from them, and what they are made of is worked out once.
    """
    rows = settle(entities).withColumn("owner", F.concat_ws("|", "event_id", "id", F.col("pos").cast("string")))
    at = F.struct(F.col("pos").cast("long").alias("pos"), F.col("i").cast("long").alias("i"))
    evidence = rows.select("owner", "pos", F.posexplode("evidence").alias("i", "e")).select("owner", at.alias("place"), "e")
    attributes = rows.select("owner", "pos", F.explode("attributes").alias("key", "value")).select("owner", F.struct(F.col("pos").cast("long").alias("pos"), F.lit(0).cast("long").alias("i")).alias("place"), "key", "value")
    return WideEntities(rows.select("owner", *_PLAIN), evidence, rows.select("owner", F.explode("source_doc_ids").alias("doc")).distinct(), attributes)


def merged(wide: WideEntities, keys: list[Column], longest_name: bool = False) -> WideEntities:
    """One row per group of entities with equal keys, by the rules of `merge.merge_entities`.

    The first row's owner becomes that of all.  Support counts the group's different documents.
    """
    named = [k.alias(f"_k{i}") for i, k in enumerate(keys)]
    group = F.struct(*[F.col(f"_k{i}") for i in range(len(keys))])
    rows = wide.entities.select("*", *named).withColumn("_group", group)
    order = F.struct("pos", "owner")
    folded = rows.groupBy("_group").agg(
        F.count("*").alias("_n"), F.min_by("owner", order).alias("owner"), *[first_of(c).alias(c) for c in ("event_id", "id", "entity_type", "extraction_mode")],
        (longest("name") if longest_name else first_of("name")).alias("name"), longest("description").alias("description"), F.max("confidence").alias("_max"), first_of("confidence").alias("_conf"),
        first_of("support_count").alias("_support"), first_filled("reasoning").alias("reasoning"), F.min("pos").alias("pos"),
    )
    moved = rows.select(F.col("owner").alias("_old"), "_group").join(folded.select("_group", "owner"), "_group").select("_old", "owner")
    move = lambda table: table.withColumnRenamed("owner", "_old").join(moved, "_old").drop("_old")
    documents = move(wide.documents).distinct()
    counted = documents.groupBy("owner").agg(F.count("*").alias("_docs"))
    filled = F.length(F.coalesce("value", F.lit(""))) > 0
    # a key keeps its first filled value, else its first that is not null
    attributes = move(wide.attributes).groupBy("owner", "key").agg(F.min("place").alias("place"), F.coalesce(F.min_by("value", F.when(filled, F.col("place"))), F.min_by("value", F.when(F.col("value").isNotNull(), F.col("place")))).alias("value"))
    many = F.col("_n") > 1
    entities = folded.join(counted, "owner", "left").withColumns({
        "confidence": F.when(many, F.round("_max", 2)).otherwise(F.col("_conf")),
        "support_count": F.when(many | F.lit(longest_name), F.greatest(F.lit(1), F.coalesce("_docs", F.lit(0)))).otherwise(F.col("_support")).cast("int"),
    })
    return WideEntities(entities.select("owner", *_PLAIN), move(wide.evidence), documents, attributes.select("owner", "place", "key", "value"))


def first_evidence(wide: WideEntities, most: int) -> DataFrame:
    """(owner, place, e): the first pieces of evidence of each entity, found without a row or a task that holds all of one's."""
    salt = F.pmod(F.xxhash64("place"), F.lit(64))
    part = wide.evidence.select("owner", "place", "e", salt.alias("_salt"))
    cut = lambda rows, by: rows.withColumn("_n", F.row_number().over(_by_place(by))).filter(F.col("_n") <= most).drop("_n")
    return cut(cut(part, ["owner", "_salt"]).drop("_salt"), ["owner"])


def _by_place(by: list[str]):
    from pyspark.sql import Window

    return Window.partitionBy(*by).orderBy("place")


def nested(wide: WideEntities, most: int | None = None) -> DataFrame:
    """Entities with their lists in rows, for a sink: all evidence, or the first `most` pieces of each."""
    evidence = wide.evidence if most is None else first_evidence(wide, most)
    proof = evidence.groupBy("owner").agg(in_order("e", "place").alias("evidence"))
    docs = wide.documents.groupBy("owner").agg(F.array_sort(F.collect_list("doc")).alias("source_doc_ids"))
    own = wide.attributes.groupBy("owner").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("attributes"))
    rows = wide.entities.join(proof, "owner", "left").join(docs, "owner", "left").join(own, "owner", "left")
    kinds = {f.name: f.dataType for f in proof.schema}
    return rows.withColumns({
        "evidence": F.coalesce("evidence", F.array().cast(kinds["evidence"])), "source_doc_ids": F.coalesce("source_doc_ids", F.array().cast("array<string>")),
        "attributes": F.coalesce("attributes", F.create_map().cast("map<string,string>")),
    }).drop("owner")
