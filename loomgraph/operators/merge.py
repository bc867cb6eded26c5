"""Folding rows that stand for one entity or edge; order is explicit in a column `pos`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_order(value: str, pos: str = "pos") -> Column:
    """All values of a group in order of `pos`, as an array."""
    by_place = lambda a, b: F.when(a["p"] < b["p"], -1).when(a["p"] > b["p"], 1).otherwise(0)
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(value).alias("v"))), by_place), lambda s: s["v"])


def first_of(value: str | Column, pos: str = "pos") -> Column:
    return F.min_by(value, pos)


def first_filled(value: str, pos: str = "pos") -> Column:
    """The first value that is neither NULL nor empty."""
    filled = F.col(value).isNotNull() & (F.length(value) > 0)
    return F.min_by(value, F.when(filled, F.col(pos)))


def longest(value: str, pos: str = "pos") -> Column:
    """The longest text; of equals the first."""
    return F.max_by(value, F.struct(F.length(F.coalesce(F.col(value), F.lit(""))), -F.col(pos)))


def fill_attributes(maps: Column) -> Column:
    """Maps in order folded into one: a key keeps its first non-empty value."""
    none = F.create_map().cast("map<string,string>")
    keep = lambda k, a, b: F.when(F.length(F.coalesce(a, F.lit(""))) > 0, a).when(F.length(F.coalesce(b, F.lit(""))) > 0, b).otherwise(F.coalesce(a, b))
    return F.aggregate(maps, none, lambda s, m: F.map_zip_with(s, F.coalesce(m, none), keep))


def union_docs(docs: str = "source_doc_ids") -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(docs))))


def merge_entities(entities: DataFrame, keys: list[Column], longest_name: bool = False) -> DataFrame:
    """One row per group of entities with equal keys.

    The first row gives id, name and mode.  Evidence is put in a row, documents are united, and where
    rows were merged support is the number of documents and confidence the greatest, rounded.  The longer
    description, every filled attribute and the first reasoning stay.  With `longest_name` the strictly
    longest name wins and support is always counted anew.
    """
    named = [k.alias(f"_k{i}") for i, k in enumerate(keys)]
    groups = entities.select("*", *named).groupBy(*[f"_k{i}" for i in range(len(keys))])
    merged = groups.agg(
        F.count("*").alias("_n"),
        first_of("event_id").alias("event_id"),
        first_of("id").alias("id"),
        (longest("name") if longest_name else first_of("name")).alias("name"),
        first_of("entity_type").alias("entity_type"),
        first_of("extraction_mode").alias("extraction_mode"),
        longest("description").alias("description"),
        F.flatten(in_order("evidence")).alias("evidence"),
        union_docs().alias("source_doc_ids"),
        F.max("confidence").alias("_max"),
        first_of("confidence").alias("_conf"),
        first_of("support_count").alias("_support"),
        fill_attributes(in_order("attributes")).alias("attributes"),
        first_filled("reasoning").alias("reasoning"),
        F.min("pos").alias("pos"),
    )
    many = F.col("_n") > 1
    counted = F.greatest(F.lit(1), F.size("source_doc_ids"))
    return merged.select(
        "event_id", "pos", "id", "name", "entity_type", "extraction_mode", "description", "evidence", "source_doc_ids",
        F.when(many, F.round("_max", 2)).otherwise(F.col("_conf")).alias("confidence"),
        F.when(many | F.lit(longest_name), counted).otherwise(F.col("_support")).cast("int").alias("support_count"),
        "attributes", "reasoning",
    )


def merge_document_entities(entities: DataFrame, name_key: Column) -> DataFrame:
    """Per document, name and type: evidence in a row, the greatest confidence and the longer description."""
    groups = entities.withColumn("_k", name_key).groupBy("doc_id", "_k", "entity_type")
    return groups.agg(
        first_of("id").alias("id"), first_of("name").alias("name"), F.flatten(in_order("evidence")).alias("evidence"),
        F.max("confidence").alias("confidence"), longest("description").alias("description"), first_of("support_count").alias("support_count"),
    ).drop("_k")


def dedup_edges(edges: DataFrame) -> DataFrame:
    """One row per edge id: evidence in a row, documents united, the greatest confidence; support stays the first's."""
    return edges.groupBy("event_id", "id").agg(
        *[first_of(c).alias(c) for c in ("subject_id", "subject_name", "predicate", "object_id", "object_name", "extraction_mode")],
        F.flatten(in_order("evidence")).alias("evidence"), union_docs().alias("source_doc_ids"),
        F.max("confidence").alias("confidence"), first_of("support_count").alias("support_count"),
        first_filled("reasoning").alias("reasoning"), F.min("pos").alias("pos"),
    )


def statements(edges: DataFrame) -> DataFrame:
    """One row per edge and piece of evidence."""
    return edges.select("event_id", F.col("id").alias("edge_id"), "subject_id", "predicate", "object_id", F.explode("evidence").alias("evidence"), "extraction_mode", "confidence", "support_count")


def distinct_evidence(evidence: Column) -> Column:
    """The first of each evidence id."""
    return F.aggregate(
        evidence,
        F.slice(evidence, 1, 0),
        lambda kept, e: F.when(F.exists(kept, lambda k: k["evidence_id"] == e["evidence_id"]), kept).otherwise(F.concat(kept, F.array(e))),
    )


def remap_nodes(nodes: DataFrame, mapping: DataFrame) -> DataFrame:
    """Nodes under canonical ids (old_id, new_id), folded by id in each event: support adds up, the longest name stays."""
    moved = nodes.join(mapping, nodes["id"] == mapping["old_id"], "left").withColumn("id", F.coalesce("new_id", "id")).drop("old_id", "new_id")
    return moved.groupBy("event_id", "id").agg(
        longest("name").alias("name"), first_of("entity_type").alias("entity_type"), F.flatten(in_order("evidence")).alias("evidence"),
        union_docs().alias("source_doc_ids"), F.sum("support_count").alias("support_count"), F.max("confidence").alias("confidence"), F.min("pos").alias("pos"),
    )


def remap_edges(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges between canonical ids, without loops, folded by ends and predicate; evidence of one id counts once."""
    s = mapping.select(F.col("old_id").alias("_s"), F.col("new_id").alias("_sn"))
    o = mapping.select(F.col("old_id").alias("_o"), F.col("new_id").alias("_on"))
    moved = edges.join(s, edges["subject_id"] == s["_s"], "left").join(o, edges["object_id"] == o["_o"], "left")
    moved = moved.withColumn("subject_id", F.coalesce("_sn", "subject_id")).withColumn("object_id", F.coalesce("_on", "object_id")).filter("subject_id != object_id")
    return moved.groupBy("event_id", "subject_id", "predicate", "object_id").agg(
        first_of("id").alias("id"), distinct_evidence(F.flatten(in_order("evidence"))).alias("evidence"),
        union_docs().alias("source_doc_ids"), F.max("confidence").alias("confidence"), F.min("pos").alias("pos"),
    )
