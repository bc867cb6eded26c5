"""Writing event graphs: nested JSON, triples, and property-graph tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import safe_uri
from loomgraph.functions.vocab import CLASSES, MERGE_BY_NAME, STAKEHOLDERS

# The namespaces of written triples.
BASE = "http://example.org/kg/"
RDF, RDFS, XSD = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2000/01/rdf-schema#", "http://www.w3.org/2001/XMLSchema#"

#: Triples that a task tells apart.
TASK_ROWS = 250_000


def nested(meta: DataFrame, nodes: DataFrame, edges: DataFrame, statements: DataFrame) -> DataFrame:
    """One row per event with its nodes, edges and statements as arrays, in order."""

    def gathered(rows: DataFrame, name: str) -> DataFrame:
        own = [c for c in rows.columns if c not in ("event_id", "pos")]
        order = "pos" if "pos" in rows.columns else own[0]
        one = F.struct(F.col(order).alias("_o"), F.struct(*own).alias("x"))
        return rows.groupBy("event_id").agg(F.transform(F.array_sort(F.collect_list(one), lambda a, b: F.when(a["_o"] < b["_o"], -1).when(a["_o"] > b["_o"], 1).otherwise(0)), lambda s: s["x"]).alias(name))

    parts = [gathered(nodes, "nodes"), gathered(edges, "edges"), gathered(statements, "knowledge_statements")]
    return reduce(lambda a, b: a.join(b, "event_id", "left"), parts, meta)


def write_json(graphs: DataFrame, path: str, only_valid: DataFrame | None = None) -> None:
    """A folder per event; with a table of violations, only events without any."""
    if only_valid is not None:
        graphs = graphs.join(only_valid.select("event_id").distinct(), "event_id", "left_anti")
    graphs.withColumn("event", F.col("event_id")).write.partitionBy("event").mode("overwrite").json(path)


def uri(kind: Column, id_: Column) -> Column:
    return F.concat(F.lit(BASE), kind, F.lit("/"), safe_uri(id_))


def triples(nodes: DataFrame, edges: DataFrame, statements: DataFrame, meta: DataFrame, task_rows: int | None = None) -> DataFrame:
    """(s, p, o, datatype): datatype is NULL for resources.

    Type and label always; description and reasoning if any; confidence above 0; support above 1; a
    triple per source document; evidence as resources; edges; statements without their ends; and times
    and the number of reports on the event.  They are told apart in tasks of about `task_rows` triples, to which they
    are dealt as they are made: no task holds those of all rows that it reads.
    """
    many = lambda c: F.greatest(F.lit(0), F.coalesce(F.size(c), F.lit(0))).cast("long")
    sizes = [nodes.select((6 + many("source_doc_ids") + 3 * many("evidence")).alias("n")), edges.select(F.lit(1).alias("n")), statements.select(F.lit(2).alias("n")), meta.select(F.lit(3).alias("n"))]
    made = reduce(DataFrame.unionByName, sizes).agg(F.sum("n")).first()[0] or 0
    tasks = made // (task_rows or TASK_ROWS) + 1
    # a few bytes of a file make many times as much of triples
    nodes = nodes.repartition(tasks, "event_id", "id")
    own = lambda p: F.lit(BASE + p)
    text, number, whole, time = F.lit(XSD + "string"), F.lit(XSD + "double"), F.lit(XSD + "integer"), F.lit(XSD + "dateTime")
    link = F.lit(None).cast("string")

    def each(rows: DataFrame, s: Column, *facts: tuple[Column | None, Column, Column, Column]) -> DataFrame:
        made = F.array(*[F.when(F.lit(True) if cond is None else cond, F.struct(p.alias("p"), o.cast("string").alias("o"), d.alias("datatype"))) for cond, p, o, d in facts])
        return rows.select(s.alias("s"), F.explode(F.filter(made, lambda x: x.isNotNull())).alias("x")).select("s", "x.*")

    node = uri(F.col("entity_type"), F.col("id"))
    described, argued = F.length("description") > 0, F.length("reasoning") > 0
    out = [
        each(
            nodes, node, (None, F.lit(RDF + "type"), F.concat(F.lit(BASE), "entity_type"), link), (None, F.lit(RDFS + "label"), F.col("name"), text), (described, own("description"), F.col("description"), text),
            (F.col("confidence") > 0, own("confidenceScore"), F.col("confidence"), number), (F.col("support_count") > 1, own("hasSupportCount"), F.col("support_count"), whole), (argued, own("reasoning"), F.col("reasoning"), text),
        )
    ]
    out.append(nodes.select(node.alias("s"), own("hasSourceDocument").alias("p"), F.explode("source_doc_ids").alias("d")).select("s", "p", uri(F.lit("NewsReport"), F.col("d")).alias("o"), link.alias("datatype")))
    proof = nodes.select(node.alias("n"), F.explode("evidence").alias("e")).select("n", "e.*")
    piece = uri(F.lit("Evidence"), F.col("evidence_id"))
    out.append(proof.select(F.col("n").alias("s"), own("hasEvidence").alias("p"), piece.alias("o"), link.alias("datatype")))
    out.append(each(proof, piece, (None, F.lit(RDF + "type"), own("Evidence"), link), (None, own("evidenceText"), F.col("evidence_sentence"), text)))
    kinds = nodes.select("event_id", "id", node.alias("u")).dropDuplicates(["event_id", "id"])
    ends = edges.join(kinds.select("event_id", F.col("id").alias("subject_id"), F.col("u").alias("su")), ["event_id", "subject_id"]).join(kinds.select("event_id", F.col("id").alias("object_id"), F.col("u").alias("ou")), ["event_id", "object_id"])
    out.append(ends.select(F.col("su").alias("s"), F.concat(F.lit(BASE), "predicate").alias("p"), F.col("ou").alias("o"), link.alias("datatype")))
    told = uri(F.lit("KnowledgeStatement"), F.concat_ws("_", "edge_id", "evidence.evidence_id"))
    out.append(each(statements, told, (None, F.lit(RDF + "type"), own("KnowledgeStatement"), link), (F.col("confidence") > 0, own("confidenceScore"), F.col("confidence"), number)))
    event = uri(F.lit("AIRiskIncident"), F.col("event_id"))
    out.append(each(meta, event, (F.col("first_seen").isNotNull(), own("firstSeen"), F.col("first_seen"), time), (F.col("last_seen").isNotNull(), own("lastSeen"), F.col("last_seen"), time), (None, own("hasSupportCount"), F.col("report_count"), whole)))
    return reduce(DataFrame.unionByName, out).repartition(tasks, "s", "p", "o").distinct()


def turtle_lines(rows: DataFrame) -> DataFrame:
    """One line of N-Triples (which is Turtle) per triple."""
    escaped = F.col("o")
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        escaped = F.replace(escaped, F.lit(a), F.lit(b))
    angle = lambda c: F.concat(F.lit("<"), c, F.lit(">"))
    o = F.when(F.col("datatype").isNull(), angle(F.col("o"))).otherwise(F.concat(F.lit('"'), escaped, F.lit('"^^'), angle(F.col("datatype"))))
    return rows.select(F.concat_ws(" ", angle(F.col("s")), angle(F.col("p")), o, F.lit(".")).alias("value"))


def merge_label(kind: Column) -> Column:
    known = F.when(kind.isin(*[c for c in CLASSES if c not in ("Misuse", "ExtractionMode")]), kind).otherwise("Entity")
    return F.when(kind.isin(*STAKEHOLDERS[:6]), "Stakeholder").otherwise(known)


def ordered_union(old: Column, new: Column) -> Column:
    """What is old and not new, then all that is new."""
    return F.concat(F.array_except(old, new), new)


def property_nodes(nodes: DataFrame) -> DataFrame:
    """Upserted nodes: incidents by event, named kinds by label and name over all events, others by id.

    Confidence is the greatest, events and documents add up, and id, type and mode are the last writer's.
    """
    by_name = F.col("entity_type").isin(*MERGE_BY_NAME)
    label = F.when(F.col("entity_type") == "AIRiskIncident", "AIRiskIncident").otherwise(merge_label(F.col("entity_type")))
    key = F.when(by_name, F.col("name")).otherwise(F.col("id"))
    return nodes.groupBy(label.alias("label"), key.alias("key")).agg(
        *[F.max_by(c, F.struct("event_id", "pos")).alias(c) for c in ("id", "name", "entity_type", "extraction_mode")],
        F.max("confidence").alias("confidence"), F.sort_array(F.collect_set("event_id")).alias("event_ids"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("source_doc_ids")))).alias("source_doc_ids"),
    )


def property_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Upserted edges by ends and upper-case type; edges with an unknown end are left out; two pieces of evidence stay."""
    by_name = F.col("entity_type").isin(*MERGE_BY_NAME)
    ends = nodes.select("event_id", "id", F.concat_ws(":", merge_label(F.col("entity_type")), F.when(by_name, F.col("name")).otherwise(F.col("id"))).alias("k")).dropDuplicates(["event_id", "id"])
    s = ends.select("event_id", F.col("id").alias("subject_id"), F.col("k").alias("subject"))
    o = ends.select("event_id", F.col("id").alias("object_id"), F.col("k").alias("object"))
    kind = F.upper(F.regexp_replace("predicate", "([a-z])([A-Z])", "$1_$2")).alias("type")
    met = edges.join(s, ["event_id", "subject_id"]).join(o, ["event_id", "object_id"])
    last = F.struct("event_id", "pos")
    return met.groupBy("subject", kind, "object").agg(F.max("confidence").alias("confidence"), F.slice(F.max_by("evidence", last), 1, 2).alias("evidence"), F.max_by("extraction_mode", last).alias("extraction_mode"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], lists: list[str], most: list[str]) -> DataFrame:
    """Rows by key: lists united in order, the greatest of some columns, else the new value where there is one."""
    n = new.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in new.columns if c not in keys])
    met = old.join(n, keys, "full")
    none = lambda c: F.slice(F.coalesce(F.col(c), F.col(f"_n_{c}")), 1, 0)
    cols = []
    for c in old.columns:
        if c in keys:
            cols.append(F.col(c))
        elif c in lists:
            cols.append(ordered_union(F.coalesce(c, none(c)), F.coalesce(f"_n_{c}", none(c))).alias(c))
        else:
            cols.append((F.greatest(c, f"_n_{c}") if c in most else F.coalesce(f"_n_{c}", c)).alias(c))
    return met.select(*cols)


def label_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label")


def bucket_summary(assigned: DataFrame, samples: int = 10, width: int = 80) -> DataFrame:
    """(stage, bucket_id, count, pct, top_samples): the first distinct values of a bucket, cut and joined."""
    counts = assigned.groupBy("stage", "bucket_id").agg(F.count("*").alias("count"))
    total = F.sum("count").over(Window.partitionBy("stage"))
    distinct = assigned.select("stage", "bucket_id", F.left("slot_value", F.lit(width)).alias("v")).distinct()
    ranked = distinct.withColumn("r", F.row_number().over(Window.partitionBy("stage", "bucket_id").orderBy("v"))).filter(F.col("r") <= samples)
    joined = ranked.groupBy("stage", "bucket_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "v"))), lambda s: s["v"]), " | ").alias("top_samples"))
    return counts.withColumn("pct", F.format_string("%.1f%%", F.col("count") * 100.0 / total)).join(joined, ["stage", "bucket_id"])


def totals(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes and edges."""
    return nodes.agg(F.count("*").alias("nodes")).join(F.broadcast(edges.agg(F.count("*").alias("edges"))))


def clear(spark, path: str) -> bool:
    """Drop a stored graph; whether there was one."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True))


def write_rows(rows: DataFrame, path: str, kind: str = "csv") -> None:
    """A table as CSV with a header or as JSON lines."""
    if kind == "csv":
        rows.write.mode("overwrite").option("header", True).csv(path)
    elif kind == "jsonl":
        rows.write.mode("overwrite").json(path)
    else:
        raise ValueError(f"unknown kind {kind!r}; known: csv, jsonl")
