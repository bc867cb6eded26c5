"""Building event graphs: one DataFrame per family of nodes and edges, put together at the end.

Inputs are tables keyed by event_id.  `reports`: doc_id, title, content, source_name, url, publish_time,
language, pos.  `entities`: nodes as in NODE.  Tables of model outputs stand in for model calls: `slots`
(slot, value, evidence, source_doc_id, confidence), `inferences` and `governance` (field, value, evidence,
source_doc_id, confidence, reasoning) and `roles` (stakeholder_name, role, evidence, source_doc_id,
confidence, reasoning, pos).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import match_key, nz, source_doc_id, stable_id
from loomgraph.functions.vocab import STAKEHOLDERS
from loomgraph.operators.merge import dedup_edges
from loomgraph.operators.rounds import stored

EVIDENCE = "array<struct<evidence_id:string,evidence_sentence:string,source_doc_id:string,confidence:double>>"
NODE = ["event_id", "pos", "id", "name", "entity_type", "description", "evidence", "extraction_mode", "confidence", "support_count", "source_doc_ids", "attributes", "reasoning"]
EDGE = ["event_id", "pos", "id", "subject_id", "subject_name", "predicate", "object_id", "object_name", "evidence", "extraction_mode", "confidence", "support_count", "source_doc_ids", "reasoning"]
DERIVED, SLOT, ROLE, SOURCE, REPORT = 0.7, 0.75, 0.8, 0.9, 0.9

# Classes of chain slots, inferred fields and governance fields, and the relations of roles.
SLOTS = {
    "risk_source": "RiskSource", "risk": "Risk", "hazard": "Hazard", "threat": "Threat", "vulnerability": "Vulnerability",
    "consequence": "Consequence", "impact": "Impact", "affected_actor": "AffectedActor", "risk_control": "RiskControl",
}
MAIN_CHAIN = [("risk_source", "risk", "causes"), ("risk", "consequence", "leadsTo"), ("consequence", "impact", "impacts"), ("impact", "affected_actor", "affects")]
INCIDENT_EDGES = {"risk": "hasRisk", "consequence": "hasConsequence", "impact": "hasImpact"}
INFERRED = {"purpose": "Purpose", "lifecycle_phase": "AILifecyclePhase", "lifecycle": "AILifecyclePhase", "impact_domain": "Domain", "domain": "Domain"}
GOVERNANCE = {
    "obligation": "Obligation", "compliance_requirement": "ComplianceRequirement", "enforcement_action": "EnforcementAction", "code_of_conduct": "CodeOfConduct",
    "trend": "Trend", "documentation": "Documentation", "technical_documentation": "TechnicalDocumentation", "verification_test": "VerificationTest",
}
ROLE_CORE = {
    "ai_systems": ("AISystem",), "ai_models": ("AIModel", "GPAIModel"), "stakeholders": ("Stakeholder", "AIDeveloper", "AIProvider", "AIDeployer", "AIUser"),
    "regulations": ("Regulation",), "standards": ("Standard",),
}
ROLE_EDGES = {
    "AIDeveloper": ("develops", ("AISystem", "AIModel", "GPAIModel")), "AIProvider": ("provides", ("AISystem", "AIModel", "GPAIModel")),
    "AIDeployer": ("deploys", ("AISystem",)), "AIUser": ("uses", ("AISystem",)),
}


def _map(pairs: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), key)


def evidence_of(sentence: Column, doc: Column, confidence: Column) -> Column:
    return F.array(F.struct(stable_id(doc, sentence).alias("evidence_id"), sentence.alias("evidence_sentence"), doc.alias("source_doc_id"), confidence.cast("double").alias("confidence"))).cast(EVIDENCE)


def no_evidence() -> Column:
    return F.array().cast(EVIDENCE)


def make_nodes(rows: DataFrame, **columns: Column) -> DataFrame:
    """Rows as nodes; what is not given has its default."""
    default = {
        "pos": F.lit(0), "description": F.lit(None).cast("string"), "evidence": no_evidence(), "support_count": F.lit(1),
        "attributes": F.create_map().cast("map<string,string>"), "reasoning": F.lit(None).cast("string"),
    }
    full = default | {"event_id": F.col("event_id")} | columns
    types = {"pos": "long", "confidence": "double", "support_count": "int"}
    return rows.select(*[full[c].cast(types[c]).alias(c) if c in types else full[c].alias(c) for c in NODE])


def make_edges(rows: DataFrame, **columns: Column) -> DataFrame:
    """Rows as edges: the three best pieces of evidence, five documents, confidence rounded, id from the ends and the relation."""
    given = {"pos": F.lit(0), "reasoning": F.lit(None).cast("string"), "support_count": F.lit(1), "event_id": F.col("event_id")} | columns
    given["predicate"] = given["predicate"] if isinstance(given["predicate"], Column) else F.lit(given["predicate"])
    given["extraction_mode"] = F.lit(given.pop("mode"))
    best = F.transform(F.array_sort(F.transform(given["evidence"], lambda e, i: F.struct((-e["confidence"]).alias("c"), i.alias("i"), e.alias("e")))), lambda s: s["e"])
    given["evidence"] = F.slice(best, 1, 3)
    given["source_doc_ids"] = F.slice(given["docs"], 1, 5)
    given["confidence"] = F.round(given["confidence"], 2)
    given["id"] = stable_id(given["subject_id"], given["predicate"], given["object_id"])
    types = {"pos": "long", "confidence": "double", "support_count": "int"}
    return rows.select(*[given[c].cast(types[c]).alias(c) if c in types else given[c].alias(c) for c in EDGE])


def incidents(reports: DataFrame) -> DataFrame:
    """A node per event: named by the title of fewest words (4 at least), else by its id; evidence: the first five titles."""
    words = F.size(F.filter(F.split("title", r"(?U)\s+"), lambda w: w != ""))
    titled = nz(F.col("title"))
    short = F.when(titled.isNotNull() & (words >= 4), F.struct(words.alias("w"), F.col("pos").alias("p")))
    proof = F.when(titled.isNotNull(), F.struct(F.col("pos").alias("p"), evidence_of(F.col("title"), F.col("doc_id"), F.lit(1.0))[0].alias("e")))
    # places are compared, titles, which may be whole texts, are taken from the chosen ones alone
    first = F.slice(F.array_sort(F.collect_list(F.when(titled.isNotNull(), F.struct(F.col("pos").alias("p"))))), 1, 5)
    whole = stored(reports.groupBy("event_id").agg(
        first.alias("_first"), F.min(short).alias("_short"),
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "doc_id"))), lambda s: s["doc_id"]).alias("_docs"),
    ), "places")
    short_one = F.when(F.col("_short").isNotNull(), F.array(F.struct(F.col("_short.p").alias("p")))).otherwise(F.slice("_first", 1, 0))
    place = stored(whole.select(F.col("event_id").alias("_e"), F.explode(F.array_distinct(F.concat("_first", short_one)))).select("_e", F.col("col.p").alias("_p")), "chosen")
    few = reports.select("event_id", "pos", "title", "doc_id").join(place, F.col("event_id").eqNullSafe(F.col("_e")) & F.col("pos").eqNullSafe(F.col("_p")), "left_semi")
    told = few.groupBy("event_id").agg(F.min_by("title", short).alias("_name"), F.transform(F.slice(F.array_sort(F.collect_list(proof)), 1, 5), lambda s: s["e"]).alias("_proof"))
    rows = whole.select("event_id", "_docs").join(told, "event_id", "left").withColumn("_proof", F.coalesce("_proof", no_evidence()))
    return make_nodes(
        rows, id=F.col("event_id"), name=F.coalesce("_name", "event_id"), entity_type=F.lit("AIRiskIncident"), description=F.col("event_id"),
        evidence=F.col("_proof"), extraction_mode=F.lit("completed"), confidence=F.lit(1.0), source_doc_ids=F.col("_docs"),
    )


def _named(rows: DataFrame, incident: DataFrame) -> DataFrame:
    return rows.join(incident.select("event_id", F.col("name").alias("_incident")), "event_id")


def report_nodes(reports: DataFrame, incident: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of reports and of their sources, and the incident's edges to both."""
    source = F.coalesce(nz(F.col("source_name")), F.lit("Unknown"))
    docs = F.transform(F.array_sort(F.collect_list(F.struct("pos", "doc_id"))), lambda s: s["doc_id"])
    by_source = reports.groupBy("event_id", source.alias("_source")).agg(docs.alias("_docs"), F.min("pos").alias("_pos"))
    sid = stable_id(F.col("event_id"), F.lit("source"), F.left("_source", F.lit(30)))
    sources = make_nodes(
        by_source, id=sid, name=F.col("_source"), entity_type=F.lit("InformationSource"), description=F.concat(F.lit("Information source: "), "_source"), pos=F.col("_pos"),
        extraction_mode=F.lit("completed"), confidence=F.lit(SOURCE), source_doc_ids=F.col("_docs"), attributes=F.create_map(F.lit("report_count"), F.size("_docs").cast("string")),
    )
    proof = evidence_of(F.coalesce("title", F.lit("")), F.col("doc_id"), F.lit(1.0))
    name = F.coalesce(nz(F.col("title")), "doc_id")
    pages = make_nodes(
        reports, id=F.col("doc_id"), name=name, entity_type=F.lit("NewsReport"), description=F.left("content", F.lit(200)), evidence=proof, pos=F.col("pos"),
        extraction_mode=F.lit("explicit"), confidence=F.lit(REPORT), source_doc_ids=F.array("doc_id"),
        attributes=F.create_map(*[x for c in ("url", "publish_time", "language") for x in (F.lit(c), F.col(c).cast("string"))]),
    )
    s = make_edges(
        _named(by_source, incident), subject_id=F.col("event_id"), subject_name=F.col("_incident"), predicate="hasInformationSource", object_id=sid, object_name=F.col("_source"),
        evidence=no_evidence(), mode="completed", confidence=F.lit(1.0), docs=F.col("_docs"), pos=F.col("_pos"),
    )
    p = make_edges(
        _named(reports, incident), subject_id=F.col("event_id"), subject_name=F.col("_incident"), predicate="hasReport", object_id=F.col("doc_id"), object_name=name,
        evidence=proof, mode="explicit", confidence=F.lit(REPORT), docs=F.array("doc_id"), pos=F.col("pos"),
    )
    return sources.unionByName(pages), s.unionByName(p)


def involvement(entities: DataFrame, incident: DataFrame) -> DataFrame:
    """The incident's edges to systems and to stakeholders."""
    kind = F.when(F.col("entity_type").isin("AISystem", "GPAIModel"), "involvesAISystem").when(F.col("entity_type").isin(*STAKEHOLDERS), "involvesStakeholder")
    rows = _named(entities.withColumn("_p", kind).filter("_p is not null"), incident)
    return make_edges(
        rows, subject_id=F.col("event_id"), subject_name=F.col("_incident"), predicate=F.col("_p"), object_id=F.col("id"), object_name=F.col("name"),
        evidence=F.col("evidence"), mode="explicit", confidence=F.col("confidence"), docs=F.col("source_doc_ids"), pos=F.col("pos"),
    )


def primary(entities: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """(event_id, _pid, _pname, _pdocs): the best supported entity of these classes; of equals the first."""
    order = Window.partitionBy("event_id").orderBy(F.desc("support_count"), "pos")
    best = entities.filter(F.col("entity_type").isin(*kinds)).withColumn("_n", F.row_number().over(order)).filter("_n = 1")
    return best.select("event_id", F.col("id").alias("_pid"), F.col("name").alias("_pname"), F.col("source_doc_ids").alias("_pdocs"))


def from_primary(entities: DataFrame, of: DataFrame, relations: dict[str, str], mode: str, confidence: Column, reasoning: Column | None = None, own_docs: bool = True) -> DataFrame:
    """Edges from an event's primary entity to all entities of some classes."""
    rows = entities.withColumn("_p", _map(relations, F.col("entity_type"))).filter("_p is not null").join(of, "event_id")
    return make_edges(
        rows, subject_id=F.col("_pid"), subject_name=F.col("_pname"), predicate=F.col("_p"), object_id=F.col("id"), object_name=F.col("name"), evidence=F.col("evidence"),
        mode=mode, confidence=confidence, docs=F.col("source_doc_ids" if own_docs else "_pdocs"), pos=F.col("pos"), reasoning=reasoning if reasoning is not None else F.lit(None).cast("string"),
    )


def matched_roles(roles: DataFrame, entities: DataFrame) -> DataFrame:
    """Roles with the stakeholder they name: by exact name, else regardless of case, else by match key; others are left out.

    Each way is an equi-join on its own key, so no way compares all names.
    """
    held = entities.filter(F.col("entity_type").isin(*STAKEHOLDERS))
    held = held.select("event_id", F.col("id").alias("_sid"), F.col("name").alias("_sname"), F.col("evidence").alias("_sproof"), F.col("source_doc_ids").alias("_sdocs"), F.col("pos").alias("_spos"))
    named = roles.filter(F.col("role").isin(*STAKEHOLDERS) & nz(F.col("stakeholder_name")).isNotNull()).withColumn("_role", F.struct("event_id", "pos", "role", "stakeholder_name"))
    found = []
    for tier, key in enumerate((lambda c: c, F.lower, match_key)):
        keyed = held.select("*", key(F.col("_sname")).alias("_key"))
        found.append(named.withColumn("_key", key(F.col("stakeholder_name"))).join(keyed, ["event_id", "_key"]).withColumn("_tier", F.lit(tier)).drop("_key"))
    best = Window.partitionBy("_role").orderBy("_tier", "_spos")
    return reduce(DataFrame.unionByName, found).withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n", "_tier", "_role")


def with_system_attributes(entities: DataFrame, attributes: DataFrame, least: float = 0.5) -> DataFrame:
    """The entities; each event's best supported system, of equals the first, takes over inferred attributes it lacks.

    `attributes` (event_id, attribute, value, confidence): filled values of at least that confidence count; of several
    of one name the surest, then the first by value.
    """
    sure = attributes.filter(nz(F.col("value")).isNotNull() & (F.col("confidence") >= least))
    best = sure.groupBy("event_id", "attribute").agg(F.min_by("value", F.struct(-F.col("confidence"), "value")).alias("value"))
    maps = best.groupBy("event_id").agg(F.map_from_entries(F.collect_list(F.struct("attribute", "value"))).alias("_inferred"))
    rows = entities.join(primary(entities, ("AISystem",)).select("event_id", F.col("_pid").alias("id"), F.lit(True).alias("_main")), ["event_id", "id"], "left").join(maps, "event_id", "left")
    none = F.create_map().cast("map<string,string>")
    filled = lambda k, own, new: F.when(F.length(F.coalesce(own, F.lit(""))) > 0, own).otherwise(F.coalesce(new, own))
    merged = F.map_zip_with(F.coalesce("attributes", none), F.coalesce("_inferred", none), filled)
    return rows.withColumn("attributes", F.when(F.col("_main"), merged).otherwise(F.col("attributes"))).select(*entities.columns)


def core_for_roles(entities: DataFrame) -> DataFrame:
    """(event_id and a list of names, in order, for each of five groups): what a role assigner is told."""
    names = lambda kinds: F.transform(F.array_sort(F.collect_list(F.when(F.col("entity_type").isin(*kinds), F.struct("pos", "name")))), lambda s: s["name"])
    return entities.groupBy("event_id").agg(*[names(kinds).alias(c) for c, kinds in ROLE_CORE.items()])


def safe_section(raw: Column) -> Column:
    """A section of a model's answer (as JSON), if it is an object; else the empty one."""
    return F.when(F.coalesce(F.schema_of_variant(F.try_parse_json(raw)), F.lit("")).startswith("OBJECT"), raw).otherwise("{}")


def safe_list(raw: Column) -> Column:
    """The objects in a list of a model's answer, as JSON; none if it is no list."""
    items = F.from_json(raw, "array<string>")
    return F.filter(F.coalesce(items, F.array().cast("array<string>")), lambda x: F.coalesce(F.schema_of_variant(F.try_parse_json(x)), F.lit("")).startswith("OBJECT"))


def role_graph(roles: DataFrame, entities: DataFrame, incident: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of actors in roles and of role assignments, and their edges."""
    rows = _named(matched_roles(roles, entities), incident)
    first = entities.filter(F.col("entity_type") == "AISystem").groupBy("event_id").agg(F.min_by("id", "pos").alias("_aid"), F.min_by("name", "pos").alias("_aname"))
    rows = rows.join(first, "event_id", "left").withColumn("confidence", F.coalesce("confidence", F.lit(ROLE)))
    doc = nz(F.col("source_doc_id"))
    rows = rows.withColumn("_proof", F.when(nz(F.col("evidence")).isNotNull(), evidence_of(F.col("evidence"), F.coalesce(doc, F.lit("")), F.col("confidence"))).otherwise(F.slice("_sproof", 1, 1)))
    rows = rows.withColumn("_docs", F.when(doc.isNotNull(), F.array(doc)).otherwise(F.col("_sdocs")))
    actor, role = stable_id(F.col("event_id"), F.col("_sid"), F.lit("actor"), F.col("role")), stable_id(F.col("event_id"), F.col("_sid"), F.col("role"))
    label = F.concat_ws("_", "_sname", "role")
    common = {"evidence": F.col("_proof"), "extraction_mode": F.lit("inferred"), "confidence": F.col("confidence"), "source_doc_ids": F.col("_docs"), "reasoning": F.col("reasoning"), "pos": F.col("pos")}
    nodes = make_nodes(rows, id=actor, name=F.col("_sname"), entity_type=F.col("role"), **common).unionByName(make_nodes(rows, id=role, name=label, entity_type=F.lit("RoleAssignment"), **common))
    edge = {"evidence": F.col("_proof"), "mode": "inferred", "docs": F.col("_docs"), "reasoning": F.col("reasoning"), "pos": F.col("pos"), "subject_id": role, "subject_name": label}
    edges = make_edges(rows, predicate="roleHeldBy", object_id=actor, object_name=F.col("_sname"), confidence=F.col("confidence"), **edge)
    edges = edges.unionByName(make_edges(rows, predicate="hasRoleInIncident", object_id=F.col("event_id"), object_name=F.col("_incident"), confidence=F.col("confidence"), **edge))
    system = rows.filter("_aid is not null")
    return nodes, edges.unionByName(make_edges(system, predicate="roleInvolvesSystem", object_id=F.col("_aid"), object_name=F.col("_aname"), confidence=F.lit(DERIVED), **edge))


def role_relations(roles: DataFrame, nodes: DataFrame) -> DataFrame:
    """What actors in roles do to an event's systems and models: every target of a class that the role reaches."""
    acting = roles.filter(F.col("role").isin(*ROLE_EDGES)).withColumn("confidence", F.coalesce("confidence", F.lit(ROLE)))
    held = nodes.groupBy("event_id", F.col("entity_type").alias("role"), F.lower("name").alias("_low")).agg(F.min_by("id", "pos").alias("_sid"), F.min_by("name", "pos").alias("_sname"), F.min_by("source_doc_ids", "pos").alias("_sdocs"))
    acting = acting.withColumn("_low", F.lower("stakeholder_name")).join(held, ["event_id", "role", "_low"])
    reach = F.create_map(*[x for r, (_, kinds) in ROLE_EDGES.items() for x in (F.lit(r), F.array(*[F.lit(k) for k in kinds]))])
    target = nodes.filter(F.col("entity_type").isin("AISystem", "AIModel", "GPAIModel")).select("event_id", F.col("id").alias("_oid"), F.col("name").alias("_oname"), F.col("entity_type").alias("_kind"))
    rows = acting.withColumn("_kind", F.explode(F.element_at(reach, F.col("role")))).join(target, ["event_id", "_kind"])
    doc = nz(F.col("source_doc_id"))
    return make_edges(
        rows, subject_id=F.col("_sid"), subject_name=F.col("_sname"), predicate=_map({r: p for r, (p, _) in ROLE_EDGES.items()}, F.col("role")), object_id=F.col("_oid"), object_name=F.col("_oname"),
        evidence=F.when(nz(F.col("evidence")).isNotNull(), evidence_of(F.col("evidence"), F.coalesce(doc, F.lit("")), F.col("confidence"))).otherwise(no_evidence()),
        mode="inferred", confidence=F.col("confidence"), docs=F.when(doc.isNotNull(), F.array(doc)).otherwise(F.col("_sdocs")), reasoning=F.col("reasoning"), pos=F.col("pos"),
    )


#: Regulators of an event that meet its regulations in one block, at least; blocks for each task, of all events, at most.
ENFORCERS, ENFORCING = 1024, 4


def _tasks(rows: DataFrame) -> int:
    return 16 * rows.sparkSession.sparkContext.defaultParallelism


def _blocks(rows: DataFrame, most: int) -> DataFrame:
    """(event_id, _blocks): as many blocks as keep all tasks at work; their number, and so how often other rows are moved, does not grow with the rows."""
    each = rows.agg(F.greatest(F.lit(most), F.ceil(F.count("*") / (ENFORCING * _tasks(rows)))).alias("_most"))
    return rows.groupBy("event_id").agg(F.count("*").alias("_n")).crossJoin(each).select("event_id", F.ceil(F.col("_n") / F.col("_most")).cast("int").alias("_blocks"))


def _dealt(rows: DataFrame, other: DataFrame, most: int = ENFORCERS) -> DataFrame:
    """All pairs of two tables' rows of one event: the second's are dealt into blocks, each of which meets all of the first's, so a large event spreads over tasks."""
    size = _blocks(other, most)
    each = rows.join(size, "event_id").withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).drop("_blocks")
    part = other.join(size, "event_id").withColumn("_block", F.pmod(F.xxhash64("_rid"), F.col("_blocks")).cast("int")).drop("_blocks")
    deal = lambda df: df.repartition(_tasks(rows), "event_id", "_block")
    return deal(each).hint("shuffle_hash").join(deal(part), ["event_id", "_block"]).drop("_block")


def regulator_edges(entities: DataFrame, incident: DataFrame) -> DataFrame:
    """Each regulator enforces the event's regulations and investigates the incident."""
    regulators = entities.filter("entity_type = 'Regulator'").select("event_id", F.col("id").alias("_rid"), F.col("name").alias("_rname"), F.slice("evidence", 1, 1).alias("_proof"), F.col("source_doc_ids").alias("_rdocs"), F.col("pos").alias("_rpos"))
    common = {"subject_id": F.col("_rid"), "subject_name": F.col("_rname"), "evidence": F.col("_proof"), "mode": "inferred", "confidence": F.lit(DERIVED), "docs": F.col("_rdocs"), "pos": F.col("_rpos")}
    rules = entities.filter("entity_type = 'Regulation'").select("event_id", "id", "name")
    rules = _dealt(rules, regulators)
    enforced = make_edges(rules, predicate="enforces", object_id=F.col("id"), object_name=F.col("name"), reasoning=F.lit("A regulator of the event and a regulation that it cites."), **common)
    looked = make_edges(_named(regulators, incident), predicate="investigates", object_id=F.col("event_id"), object_name=F.col("_incident"), reasoning=F.lit("A regulator that responds to the incident."), **common)
    return enforced.unionByName(looked)


def _filled(table: DataFrame, key: str, classes: dict[str, str], cut: int, confidence: float, fallback: DataFrame) -> DataFrame:
    """Filled fields of known kinds with the id, class, document and evidence of their node."""
    rows = table.withColumn("_type", _map(classes, F.col(key))).filter(F.col("_type").isNotNull() & nz(F.col("value")).isNotNull()).join(fallback, "event_id", "left")
    rows = rows.withColumn("confidence", F.coalesce("confidence", F.lit(confidence))).withColumn("_doc", source_doc_id(F.col("source_doc_id"), F.col("evidence"), F.coalesce("_fallback", "event_id")))
    rows = rows.withColumn("_nid", stable_id(F.col("event_id"), F.col(key), F.left("value", F.lit(cut))))
    return rows.withColumn("_proof", evidence_of(F.coalesce("evidence", F.lit("")), F.col("_doc"), F.col("confidence")))


def risk_chain(slots: DataFrame, entities: DataFrame, incident: DataFrame, fallback: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of filled slots; edges between neighbouring slots only, from the incident, and to hazards, threats, vulnerabilities and risks."""
    rows = _named(_filled(slots, "slot", SLOTS, 30, SLOT, fallback), incident)
    nodes = make_nodes(rows, id=F.col("_nid"), name=F.col("value"), entity_type=F.col("_type"), evidence=F.col("_proof"), extraction_mode=F.lit("abstracted"), confidence=F.col("confidence"), source_doc_ids=F.array("_doc"))
    tail = rows.select("event_id", F.col("slot").alias("_to"), F.col("_nid").alias("_oid"), F.col("value").alias("_oname"), F.col("_proof").alias("_oproof"), F.col("confidence").alias("_oconf"), F.col("_doc").alias("_odoc"))
    head = rows.select("event_id", F.col("slot").alias("_from"), F.col("_nid").alias("_sid"), F.col("value").alias("_sname"), F.col("confidence").alias("_sconf"), F.array("_doc").alias("_sdocs"))
    steps = [(a, b, p, True) for a, b, p in MAIN_CHAIN] + [("risk_control", "risk", "mitigates", None)]
    step = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(p).alias("p")) for a, b, p, _ in steps])
    linked = head.withColumn("_s", F.explode(F.filter(step, lambda s: s["a"] == F.col("_from")))).join(tail.withColumnRenamed("_to", "_link"), "event_id").filter("_link = _s.b")
    own = rows.filter("slot = 'risk_control'").select("event_id", F.col("_proof").alias("_cproof"))
    linked = linked.join(own, "event_id", "left")
    mitigates = F.col("_s.p") == "mitigates"
    docs = F.array_sort(F.array_union("_sdocs", F.array("_odoc")))
    chain = make_edges(
        linked, subject_id=F.col("_sid"), subject_name=F.col("_sname"), predicate=F.col("_s.p"), object_id=F.col("_oid"), object_name=F.col("_oname"), mode="abstracted", docs=docs,
        evidence=F.when(mitigates, F.col("_cproof")).otherwise(F.col("_oproof")), confidence=F.when(mitigates, F.col("_sconf")).otherwise(F.least("_sconf", "_oconf")),
    )
    hub = rows.withColumn("_p", _map(INCIDENT_EDGES, F.col("slot"))).filter("_p is not null")
    hubs = make_edges(hub, subject_id=F.col("event_id"), subject_name=F.col("_incident"), predicate=F.col("_p"), object_id=F.col("_nid"), object_name=F.col("value"), evidence=F.col("_proof"), mode="abstracted", confidence=F.col("confidence"), docs=F.array("_doc"))
    system = entities.filter("entity_type = 'AISystem'").groupBy("event_id").agg(F.min_by(F.struct(F.col("id").alias("_sid"), F.col("name").alias("_sname"), F.col("source_doc_ids").alias("_sdocs")), "pos").alias("_x"))
    by_rank = head.filter(F.col("_from").isin("risk_source", "risk")).select("event_id", F.struct((F.col("_from") == "risk").alias("late"), "_sid", "_sname", "_sdocs").alias("x")).groupBy("event_id").agg(F.min("x").alias("x")).select("event_id", "x._sid", "x._sname", "x._sdocs")
    source = head.filter("_from = 'risk_source'").select("event_id", "_sid", "_sname", "_sdocs")
    exposed = system.select("event_id", "_x.*")
    exposed = exposed.unionByName(source.join(exposed.select("event_id"), "event_id", "left_anti"))
    side = by_rank.join(tail.filter(F.col("_to").isin("hazard", "threat")), "event_id").unionByName(exposed.join(tail.filter("_to = 'vulnerability'"), "event_id"))
    sides = make_edges(
        side, subject_id=F.col("_sid"), subject_name=F.col("_sname"), predicate=_map({"hazard": "hasHazard", "threat": "hasThreat", "vulnerability": "hasVulnerability"}, F.col("_to")),
        object_id=F.col("_oid"), object_name=F.col("_oname"), evidence=F.col("_oproof"), mode="abstracted", confidence=F.col("_oconf"), docs=docs,
    )
    return nodes, hubs.unionByName(chain).unionByName(sides)


def inferred(inferences: DataFrame, entities: DataFrame, incident: DataFrame, fallback: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Purposes hang on the primary system (without one they are left out), phases and domains on the incident."""
    rows = _named(_filled(inferences, "field", INFERRED, 20, DERIVED, fallback), incident).join(primary(entities, ("AISystem", "GPAIModel")), "event_id", "left")
    rows = rows.filter("field != 'purpose' or _pid is not null")
    nodes = make_nodes(rows, id=F.col("_nid"), name=F.col("value"), entity_type=F.col("_type"), evidence=F.col("_proof"), extraction_mode=F.lit("inferred"), confidence=F.col("confidence"), source_doc_ids=F.array("_doc"), reasoning=F.col("reasoning"))
    purpose = F.col("field") == "purpose"
    edges = make_edges(
        rows, subject_id=F.when(purpose, F.col("_pid")).otherwise(F.col("event_id")), subject_name=F.when(purpose, F.col("_pname")).otherwise(F.col("_incident")),
        predicate=F.when(purpose, "hasCapability").otherwise("hasEvidence"), object_id=F.col("_nid"), object_name=F.col("value"), evidence=F.col("_proof"), mode="inferred",
        confidence=F.col("confidence"), docs=F.array("_doc"), reasoning=F.col("reasoning"),
    )
    return nodes, edges


def governed(governance: DataFrame, entities: DataFrame, incident: DataFrame, fallback: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Governance and documentation nodes; enforcement, obligations and documentation have edges, the others none."""
    rows = _named(_filled(governance, "field", GOVERNANCE, 30, DERIVED, fallback), incident).join(primary(entities, ("AISystem", "GPAIModel")), "event_id", "left")
    rule = entities.filter("entity_type = 'Regulation'").groupBy("event_id").agg(F.min_by("id", "pos").alias("_gid"), F.min_by("name", "pos").alias("_gname"))
    rows = rows.join(rule, "event_id", "left")
    nodes = make_nodes(rows, id=F.col("_nid"), name=F.col("value"), entity_type=F.col("_type"), evidence=F.col("_proof"), extraction_mode=F.lit("inferred"), confidence=F.col("confidence"), source_doc_ids=F.array("_doc"), reasoning=F.col("reasoning"))
    f = F.col("field")
    answer, duty, paper = f == "enforcement_action", (f == "obligation") & F.col("_gid").isNotNull(), f.isin("documentation", "technical_documentation", "verification_test")
    rows = rows.filter(answer | duty | paper)
    edges = make_edges(
        rows,
        subject_id=F.when(answer, F.col("_nid")).when(duty, F.col("_gid")).otherwise(F.coalesce("_pid", "event_id")),
        subject_name=F.when(answer, F.col("value")).when(duty, F.col("_gname")).otherwise(F.coalesce("_pname", "_incident")),
        predicate=F.when(answer, "respondsToIncident").when(duty, "imposesRequirement").otherwise("hasEvidence"),
        object_id=F.when(answer, F.col("event_id")).otherwise(F.col("_nid")), object_name=F.when(answer, F.col("_incident")).otherwise(F.col("value")),
        evidence=F.col("_proof"), mode="inferred", confidence=F.col("confidence"), docs=F.array("_doc"), reasoning=F.col("reasoning"),
    )
    return nodes, edges


def build_graphs(reports: DataFrame, entities: DataFrame, slots: DataFrame, inferences: DataFrame, governance: DataFrame, roles: DataFrame, fallback: DataFrame, attributes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of all events at once.  `fallback` (event_id, _fallback) names a document for model outputs without one.

    `attributes` of systems (event_id, attribute, value, confidence) go onto each event's primary one.
    """
    # joined to every report: stored, it is small enough to be seen as such
    incident = stored(incidents(reports), "incidents")
    if attributes is not None:
        entities = with_system_attributes(entities, attributes)
    n1, e1 = report_nodes(reports, incident)
    n2, e2 = role_graph(roles, entities, incident)
    n3, e3 = risk_chain(slots, entities, incident, fallback)
    n4, e4 = inferred(inferences, entities, incident, fallback)
    n5, e5 = governed(governance, entities, incident, fallback)
    nodes = reduce(DataFrame.unionByName, [incident, n1, entities.select(*NODE), n2, n3, n4, n5])
    technical = from_primary(entities, primary(entities, ("AISystem", "AIModel", "GPAIModel")), {"AITechnique": "usesTechnique", "AICapability": "hasCapability", "Data": "uses"}, "abstracted", F.col("confidence"))
    rules = from_primary(entities, primary(entities, ("AISystem", "GPAIModel")), {"Regulation": "compliesWithRegulation", "Standard": "conformsToStandard"}, "inferred", F.lit(DERIVED), F.lit("The system is linked to what the evidence cites."), False)
    acts = role_relations(roles, entities.select(*NODE).unionByName(n2))
    edges = reduce(DataFrame.unionByName, [e1, involvement(entities, incident), technical, e2, e3, e4, e5, acts, regulator_edges(entities, incident), rules])
    return nodes, dedup_edges(edges)
