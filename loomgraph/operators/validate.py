"""Checks and soft repair of event graphs against the ontology."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.vocab import CHAIN, INFRA_PREDICATES, INFRA_TYPES


def allowed(domain: Column, range_: Column, subject_type: Column, object_type: Column) -> Column:
    """Both ends belong to the relation's classes; an empty side allows all."""
    fits = lambda side, kind: (F.size(side) == 0) | F.array_contains(side, kind)
    return fits(domain, subject_type) & fits(range_, object_type)


def typed_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with subject_type and object_type (NULL for a missing end)."""
    types = nodes.select("event_id", "id", "entity_type").dropDuplicates(["event_id", "id"])
    s = types.select("event_id", F.col("id").alias("subject_id"), F.col("entity_type").alias("subject_type"))
    o = types.select("event_id", F.col("id").alias("object_id"), F.col("entity_type").alias("object_type"))
    return edges.join(s, ["event_id", "subject_id"], "left").join(o, ["event_id", "object_id"], "left")


def judged_edges(edges: DataFrame, nodes: DataFrame, constraints: DataFrame) -> DataFrame:
    """Edges with `problem`: self-loop, dangling, ontology, or NULL.  Unknown predicates pass here."""
    rules = F.broadcast(constraints)  # one row per relation of the ontology
    checked = typed_edges(edges, nodes).join(rules, "predicate", "left")
    problem = (
        F.when(F.col("subject_id") == F.col("object_id"), "self-loop")
        .when(F.col("subject_type").isNull() | F.col("object_type").isNull(), "dangling")
        .when(~F.coalesce(allowed(F.col("domain"), F.col("range"), F.col("subject_type"), F.col("object_type")), F.lit(True)), "ontology")
    )
    return checked.withColumn("problem", problem).drop("domain", "range")


def repaired(edges: DataFrame, nodes: DataFrame, constraints: DataFrame) -> DataFrame:
    return judged_edges(edges, nodes, constraints).filter("problem is null").drop("problem", "subject_type", "object_type")


def duplicate_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("event_id", "id").agg(F.count("*").alias("n")).filter("n > 1")


def unsupported_nodes(nodes: DataFrame) -> DataFrame:
    """Explicit and abstracted nodes, but for incidents, that lack evidence or documents."""
    stated = F.col("extraction_mode").isin("explicit", "abstracted") & (F.col("entity_type") != "AIRiskIncident")
    bare = (F.coalesce(F.size("evidence"), F.lit(0)) <= 0) | (F.coalesce(F.size("source_doc_ids"), F.lit(0)) <= 0)
    return nodes.filter(stated & bare).select("event_id", "id")


def unexplained(rows: DataFrame, need_evidence: bool) -> DataFrame:
    """Inferred nodes without evidence or reasoning, or inferred edges without reasoning."""
    silent = F.coalesce(F.length("reasoning"), F.lit(0)) == 0
    if need_evidence:
        silent = silent | (F.coalesce(F.size("evidence"), F.lit(0)) <= 0)
    return rows.filter((F.col("extraction_mode") == "inferred") & silent).select("event_id", "id")


def unknown_documents(evidence: DataFrame, documents: DataFrame) -> DataFrame:
    """(event_id, owner_id, source_doc_id): evidence from no document of its event, where the event has any."""
    known = documents.select("event_id", F.col("doc_id").alias("source_doc_id")).distinct()
    judged = evidence.join(documents.select("event_id").distinct(), "event_id", "left_semi")
    return judged.join(known, ["event_id", "source_doc_id"], "left_anti").select("event_id", "owner_id", "source_doc_id")


def evidence_problems(evidence: DataFrame, documents: DataFrame) -> DataFrame:
    """(event_id, owner_id, source_doc_id, problem): evidence (event_id, owner_id, source_doc_id) from nowhere or from no document of its event.

    An empty, missing or event-level document is invalid; others are unknown if the event has documents but not this one.
    """
    doc = F.coalesce("source_doc_id", F.lit(""))
    invalid = doc.isin("", "event_level")
    bad = evidence.filter(invalid).select("event_id", "owner_id", "source_doc_id", F.lit("invalid document").alias("problem"))
    unknown = unknown_documents(evidence.filter(~invalid), documents)
    return bad.unionByName(unknown.withColumn("problem", F.lit("unknown document")))


def messages(problems: DataFrame, names: DataFrame) -> DataFrame:
    """(event_id, message): problems (event_id, owner_id, problem) in words, by the names of what they are about."""
    return problems.join(names.select("event_id", F.col("id").alias("owner_id"), "name"), ["event_id", "owner_id"], "left").select(
        "event_id", F.concat(F.coalesce("name", "owner_id"), F.lit(": "), "problem").alias("message")
    )


def is_content_type(kind: Column) -> Column:
    return ~kind.isin(*INFRA_TYPES)


def semantic_edges(edges: DataFrame) -> DataFrame:
    return edges.filter(~F.col("predicate").isin(*INFRA_PREDICATES) & (F.col("extraction_mode") != "completed"))


def content_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    typed = typed_edges(semantic_edges(edges), nodes)
    return typed.filter(is_content_type(F.col("subject_type")) & is_content_type(F.col("object_type")))


def complete_chains(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(event_id): events with a path source, risk, consequence, impact, actor along the right relations."""
    typed = typed_edges(edges, nodes)
    path = None
    for (_, kind, predicate), (_, target, _) in zip(CHAIN, CHAIN[1:], strict=False):
        step = typed.filter((F.col("predicate") == predicate) & (F.col("subject_type") == kind) & (F.col("object_type") == target))
        step = step.select("event_id", F.col("subject_id").alias("at"), F.col("object_id").alias("to")).distinct()
        path = step.select("event_id", F.col("to").alias("at")) if path is None else path.join(step, ["event_id", "at"]).select("event_id", F.col("to").alias("at"))
        path = path.distinct()
    return path.select("event_id").distinct()


def chain_paths(edges: DataFrame, nodes: DataFrame, per_event: int = 5) -> DataFrame:
    """(event_id, path, rank): the first chains of five names, without a repeated node, of each event."""
    from pyspark.sql import Window

    typed = typed_edges(edges, nodes)
    path = None
    for i, ((_, kind, predicate), (_, target, _)) in enumerate(zip(CHAIN, CHAIN[1:], strict=False)):
        step = typed.filter((F.col("predicate") == predicate) & (F.col("subject_type") == kind) & (F.col("object_type") == target))
        step = step.select("event_id", F.col("subject_id").alias("at"), F.col("object_id").alias("to"))
        if i == 0:
            path = step.select("event_id", F.array("at", "to").alias("path"), F.col("to").alias("at"))
        else:
            path = path.join(step, ["event_id", "at"]).filter(~F.array_contains("path", F.col("to"))).select("event_id", F.concat("path", F.array("to")).alias("path"), F.col("to").alias("at"))
    ranked = path.select("event_id", F.array_join("path", ">").alias("path")).distinct().withColumn("rank", F.row_number().over(Window.partitionBy("event_id").orderBy("path")))
    return ranked.filter(F.col("rank") <= per_event)


def broken_chains(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(event_id, rule): where the walk incident, first risk, consequence, impact stops."""
    typed = typed_edges(edges, nodes)
    hop = lambda p, kind: typed.filter((F.col("predicate") == p) & (F.col("object_type") == kind))
    events = nodes.filter("entity_type = 'AIRiskIncident'").select("event_id", F.col("id").alias("incident")).distinct()
    risk = hop("hasRisk", "Risk").groupBy("event_id", F.col("subject_id").alias("incident")).agg(F.min_by("object_id", "pos").alias("risk"))
    after = lambda p, kind, at, to: hop(p, kind).groupBy("event_id", F.col("subject_id").alias(at)).agg(F.min_by("object_id", "pos").alias(to))
    walk = events.join(risk, ["event_id", "incident"], "left").join(after("leadsTo", "Consequence", "risk", "consequence"), ["event_id", "risk"], "left")
    walk = walk.join(after("impacts", "Impact", "consequence", "impact"), ["event_id", "consequence"], "left")
    rule = F.when(F.col("risk").isNull(), "no risk").when(F.col("consequence").isNull(), "no consequence").when(F.col("impact").isNull(), "no impact")
    return walk.select("event_id", rule.alias("rule")).filter("rule is not null")
