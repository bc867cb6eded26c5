"""The whole run over all events: documents to validated, fused graphs, from provider tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.encode import name_vector
from loomgraph.functions.vocab import constraints
from loomgraph.operators import merge, package, validate
from loomgraph.operators.rounds import settle
from loomgraph.plans import align, build
from loomgraph.sources.readers import experiment


@dataclass
class Providers:
    """Outputs of models as tables; see build.py and align.py for their columns."""

    entities: DataFrame
    slots: DataFrame
    inferences: DataFrame
    governance: DataFrame
    roles: DataFrame
    vectors: DataFrame
    verdicts: DataFrame | Callable[[DataFrame], DataFrame]
    attributes: DataFrame | None = None
    #: (name, vector) of the reports' titles with summaries.
    labels: DataFrame | None = None


def label_vectors(given: Providers) -> DataFrame | Callable[[Column], Column]:
    """(name, vector) of the labels of reports: what the providers give, else the local encoder, which needs no table."""
    return given.labels if given.labels is not None else name_vector


def violations(nodes: DataFrame, edges: DataFrame, reports: DataFrame, evidence: bool = True) -> DataFrame:
    """(event_id, id, rule) of all graphs; without `evidence` the rules that need it are left out."""
    found = validate.duplicate_nodes(nodes).select("event_id", "id", F.lit("duplicate node").alias("rule"))
    found = found.unionByName(validate.broken_chains(edges, nodes).select("event_id", F.col("event_id").alias("id"), "rule"))
    if evidence:
        found = found.unionByName(validate.unsupported_nodes(nodes).withColumn("rule", F.lit("no evidence")))
        found = found.unionByName(validate.unexplained(nodes, True).withColumn("rule", F.lit("unexplained node"))).unionByName(validate.unexplained(edges, False).withColumn("rule", F.lit("unexplained edge")))
        proof = nodes.select("event_id", F.col("id").alias("owner_id"), F.explode("evidence").alias("e")).select("event_id", "owner_id", "e.source_doc_id")
        proof = proof.unionByName(edges.select("event_id", F.col("id").alias("owner_id"), F.explode("evidence").alias("e")).select("event_id", "owner_id", "e.source_doc_id"))
        known = reports.select("event_id", F.col("doc_id").cast("string").alias("doc_id"))
        found = found.unionByName(validate.evidence_problems(proof, known).select("event_id", F.col("owner_id").alias("id"), F.col("problem").alias("rule")).distinct())
    return found


def run_events(reports: DataFrame, given: Providers, variant: str = "full", ontology: DataFrame | None = None) -> dict[str, DataFrame]:
    """Tables by name: metadata, representatives, core, evidence, support, conflicts (the evidence package by strategy), nodes, edges, statements, violations.

    A variant leaves stages out: without aggregation entities are only put together by name, without
    inference those tables are empty, without ontology or evidence the checks that need them are not made.
    `ontology` has the constraints of relations (as of `read_ontology`) in place of the fixed ones.
    """
    flags = experiment(variant)
    spark = reports.sparkSession
    packed = package.evidence_package(reports, given.entities, label_vectors(given))
    chosen = settle(packed.reports)
    fallback = chosen.groupBy("event_id").agg(F.min_by("doc_id", "rank").cast("string").alias("_fallback"))
    if flags["aggregation"]:
        entities = align.align_event_entities(given.entities, given.vectors, given.verdicts)
    else:
        entities = align.union_nodes(given.entities).withColumns({"description": F.col("name"), "extraction_mode": F.lit("explicit"), "attributes": F.create_map().cast("map<string,string>"), "reasoning": F.lit(None).cast("string")})
    entities = settle(entities.select(*build.NODE))
    keep = lambda t: t if flags["inference"] else t.filter("false")
    nodes, edges = build.build_graphs(reports, entities, given.slots, keep(given.inferences), keep(given.governance), keep(given.roles), fallback, given.attributes if flags["inference"] else None)
    nodes, edges = settle(nodes), settle(edges)
    rules = constraints(spark) if ontology is None else ontology
    rules = rules if flags["ontology"] else rules.filter("false")
    kept = validate.repaired(edges, nodes, rules)
    found = violations(nodes, kept, reports, flags["evidence"])
    return {"metadata": packed.metadata, "representatives": chosen, "core": packed.core, "evidence": packed.evidence, "support": packed.support, "conflicts": packed.conflicts, "nodes": nodes, "edges": kept, "statements": merge.statements(kept), "violations": found}


def fuse_events(tables: dict[str, DataFrame], given: Providers) -> dict[str, DataFrame]:
    """The tables with entities of all events under canonical ids."""
    mapping = settle(align.resolve(tables["nodes"], given.vectors, given.verdicts))
    nodes, edges, told = align.fuse(tables["nodes"], tables["edges"], tables["statements"], mapping)
    return tables | {"nodes": nodes, "edges": edges, "statements": told, "mapping": mapping}
