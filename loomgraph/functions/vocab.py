"""Controlled vocabularies of the graph: classes, relations, their aliases, and domain/range constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---- fixed values --------------------------------------------------------------------------------

CLASSES = [
    "AISystem", "AIModel", "GPAIModel", "AITechnique", "AICapability", "AIComponent", "Data",
    "Stakeholder", "AIDeveloper", "AIProvider", "AIDeployer", "AIUser", "Regulator", "AffectedActor",
    "RiskSource", "Risk", "Misuse", "Hazard", "Threat", "Vulnerability", "Consequence", "Impact", "RiskControl",
    "Regulation", "Standard", "Obligation", "ComplianceRequirement", "EnforcementAction", "CodeOfConduct",
    "NewsReport", "InformationSource", "Evidence", "KnowledgeStatement", "AIRiskIncident", "RoleAssignment",
    "ExtractionMode", "Trend", "Purpose", "AILifecyclePhase", "Domain", "Documentation", "TechnicalDocumentation", "VerificationTest",
]

RELATIONS = [
    "develops", "provides", "deploys", "uses", "hasModel", "usesTechnique", "hasCapability",
    "involvesAISystem", "involvesStakeholder", "hasRisk", "hasConsequence", "hasImpact", "hasReport",
    "roleHeldBy", "hasRoleInIncident", "roleInvolvesSystem",
    "causes", "leadsTo", "impacts", "affects", "mitigates",
    "governs", "imposesRequirement", "enforces", "investigates", "specifies", "respondsToIncident",
    "hasEvidence", "hasSourceDocument", "conflictsWith",
    "isRiskSourceFor", "hasHazard", "hasThreat", "hasVulnerability", "hasInformationSource", "compliesWithRegulation", "conformsToStandard",
]

EXTRACTION_MODES = ("explicit", "abstracted", "inferred", "completed")

CLASS_ALIASES = {
    "ai system": "AISystem",
    "ai_system": "AISystem",
    "system": "AISystem",
    "ai model": "AIModel",
    "ai_model": "AIModel",
    "model": "AIModel",
    "llm": "AIModel",
    "large language model": "AIModel",
    "foundation model": "AIModel",
    "基础模型": "AIModel",
    "大模型": "AIModel",
    "ai technique": "AITechnique",
    "ai_technique": "AITechnique",
    "technique": "AITechnique",
    "ai capability": "AICapability",
    "ai_capability": "AICapability",
    "capability": "AICapability",
    "stakeholder": "Stakeholder",
    "organization": "Stakeholder",
    "organisation": "Stakeholder",
    "company": "Stakeholder",
    "entity": "Stakeholder",
    "ai developer": "AIDeveloper",
    "ai_developer": "AIDeveloper",
    "developer": "AIDeveloper",
    "ai provider": "AIProvider",
    "ai_provider": "AIProvider",
    "provider": "AIProvider",
    "ai deployer": "AIDeployer",
    "ai_deployer": "AIDeployer",
    "deployer": "AIDeployer",
    "ai user": "AIUser",
    "ai_user": "AIUser",
    "user": "AIUser",
    "ai subject": "AffectedActor",
    "ai_subject": "AffectedActor",
    "affected actor": "AffectedActor",
    "affected_actor": "AffectedActor",
    "affected party": "AffectedActor",
    "victim": "AffectedActor",
    "regulator": "Regulator",
    "supervisory authority": "Regulator",
    "risk source": "RiskSource",
    "risk_source": "RiskSource",
    "risk": "Risk",
    "hazard": "Hazard",
    "threat": "Threat",
    "vulnerability": "Vulnerability",
    "consequence": "Consequence",
    "impact": "Impact",
    "risk control": "RiskControl",
    "risk_control": "RiskControl",
    "mitigation": "RiskControl",
    "control measure": "RiskControl",
    "regulation": "Regulation",
    "law": "Regulation",
    "act": "Regulation",
    "standard": "Standard",
    "obligation": "Obligation",
    "compliance requirement": "ComplianceRequirement",
    "enforcement action": "EnforcementAction",
    "enforcement": "EnforcementAction",
    "penalty": "EnforcementAction",
    "fine": "EnforcementAction",
    "news report": "NewsReport",
    "news_report": "NewsReport",
    "report": "NewsReport",
    "article": "NewsReport",
    "information source": "InformationSource",
    "evidence": "Evidence",
    "knowledge statement": "KnowledgeStatement",
    "ai risk incident": "AIRiskIncident",
    "incident": "AIRiskIncident",
    "event": "AIRiskIncident",
    "role assignment": "RoleAssignment",
    "trend": "Trend",
    "purpose": "Purpose",
    "lifecycle phase": "AILifecyclePhase",
    "lifecycle": "AILifecyclePhase",
    "domain": "Domain",
    "impact domain": "Domain",
    "area of impact": "Domain",
    "code of conduct": "CodeOfConduct",
    "documentation": "Documentation",
    "technical documentation": "TechnicalDocumentation",
    "verification test": "VerificationTest",
}

RELATION_ALIASES = {
    "developed_by": "develops",
    "developed by": "develops",
    "created_by": "develops",
    "built_by": "develops",
    "trained_by": "develops",
    "provided_by": "provides",
    "provided by": "provides",
    "deployed_by": "deploys",
    "deployed by": "deploys",
    "used_by": "uses",
    "used by": "uses",
    "has_risk_source": "isRiskSourceFor",
    "involves_ai_system": "involvesAISystem",
    "involves ai system": "involvesAISystem",
    "involves_stakeholder": "involvesStakeholder",
    "has_report": "hasReport",
    "role_held_by": "roleHeldBy",
    "has_role_in_incident": "hasRoleInIncident",
    "role_involves_system": "roleInvolvesSystem",
    "leads_to": "leadsTo",
    "leads to": "leadsTo",
    "results_in": "leadsTo",
    "causes": "causes",
    "impacts": "impacts",
    "affects": "affects",
    "mitigates": "mitigates",
    "governs": "governs",
    "governed_by": "governs",
    "governed by": "governs",
    "regulates": "governs",
    "imposes_requirement": "imposesRequirement",
    "enforces": "enforces",
    "investigates": "investigates",
    "specifies": "specifies",
    "responds_to_incident": "respondsToIncident",
    "has_evidence": "hasEvidence",
    "has_source_document": "hasSourceDocument",
    "conflicts_with": "conflictsWith",
    "has_hazard": "hasHazard",
    "has_threat": "hasThreat",
    "has_vulnerability": "hasVulnerability",
    "complies_with_regulation": "compliesWithRegulation",
    "conforms_to_standard": "conformsToStandard",
}

#: predicate: (domain, range); an empty side allows every class.
CONSTRAINTS = {
    "develops": (("AIDeveloper",), ("AISystem", "AIModel", "GPAIModel")),
    "provides": (("AIProvider",), ("AISystem", "AIModel", "GPAIModel")),
    "deploys": (("AIDeployer",), ("AISystem",)),
    "uses": (("AIUser", "AISystem", "AIModel", "GPAIModel"), ("AISystem", "Data")),
    "hasModel": (("AISystem",), ("AIModel",)),
    "usesTechnique": (("AISystem", "AIModel", "GPAIModel"), ("AITechnique",)),
    "hasCapability": (("AISystem", "AIModel", "GPAIModel"), ("AICapability", "Purpose")),
    "involvesAISystem": (("AIRiskIncident",), ("AISystem", "GPAIModel")),
    "involvesStakeholder": (("AIRiskIncident",), ("Stakeholder", "AIDeveloper", "AIProvider", "AIDeployer", "AIUser", "Regulator", "AffectedActor")),
    "hasRisk": (("AIRiskIncident", "AISystem"), ("Risk", "Misuse")),
    "hasConsequence": (("AIRiskIncident", "Risk"), ("Consequence",)),
    "hasImpact": (("AIRiskIncident", "Consequence"), ("Impact",)),
    "hasReport": (("AIRiskIncident",), ("NewsReport",)),
    "roleHeldBy": (("RoleAssignment",), ("Stakeholder", "AIDeveloper", "AIProvider", "AIDeployer", "AIUser", "Regulator", "AffectedActor")),
    "hasRoleInIncident": (("RoleAssignment",), ("AIRiskIncident",)),
    "roleInvolvesSystem": (("RoleAssignment",), ("AISystem", "GPAIModel")),
    "causes": (("RiskSource",), ("Risk",)),
    "leadsTo": (("Risk", "Misuse"), ("Consequence",)),
    "impacts": (("Consequence",), ("Impact",)),
    "affects": (("Impact",), ("AffectedActor",)),
    "mitigates": (("RiskControl",), ("Risk",)),
    "governs": (("Regulation", "Standard"), ("AISystem", "Stakeholder")),
    "imposesRequirement": (("Regulation",), ("ComplianceRequirement", "Obligation")),
    "enforces": (("Regulator",), ("Regulation",)),
    "investigates": (("Regulator",), ("AIRiskIncident",)),
    "specifies": (("Standard",), ("RiskControl",)),
    "respondsToIncident": (("EnforcementAction",), ("AIRiskIncident",)),
    "hasEvidence": (("KnowledgeStatement", "AIRiskIncident", "AISystem", "AIModel", "GPAIModel"), ("Evidence", "Data", "AILifecyclePhase", "Domain", "Documentation", "TechnicalDocumentation", "VerificationTest")),
    "hasSourceDocument": (("Evidence",), ("NewsReport",)),
    "conflictsWith": (("KnowledgeStatement",), ("KnowledgeStatement",)),
    "isRiskSourceFor": (("RiskSource",), ("Risk",)),
    "hasHazard": (("AISystem", "RiskSource"), ("Hazard",)),
    "hasThreat": (("AISystem", "RiskSource"), ("Threat",)),
    "hasVulnerability": (("AISystem",), ("Vulnerability",)),
    "hasInformationSource": (("AIRiskIncident",), ("InformationSource",)),
    "compliesWithRegulation": (("AISystem", "GPAIModel"), ("Regulation",)),
    "conformsToStandard": (("AISystem", "GPAIModel"), ("Standard",)),
}

#: Class partitions; modules differ in them on purpose.
STAKEHOLDERS = ("Stakeholder", "AIDeveloper", "AIProvider", "AIDeployer", "AIUser", "Regulator", "AffectedActor")
ALIGNED_STAKEHOLDERS = tuple(c for c in STAKEHOLDERS if c != "AffectedActor")
ALIGNABLE = ("AISystem", "AIModel", "GPAIModel", "AITechnique", "AICapability", "AIComponent", "Data", "Stakeholder", "AIDeveloper", "AIProvider", "AIDeployer", "AIUser", "Regulator", "Misuse", "Regulation", "Standard")
MERGE_BY_NAME = ("AISystem", "AIModel", "AITechnique", "AICapability", "Stakeholder", "AIDeveloper", "AIProvider", "AIDeployer", "AIUser", "Regulator", "AffectedActor", "Regulation", "Standard")
INFRA_TYPES = ("AIRiskIncident", "NewsReport", "InformationSource", "RoleAssignment", "Evidence", "KnowledgeStatement")
INFRA_PREDICATES = ("hasReport", "hasInformationSource", "hasSourceDocument")
STAGE2_TYPES = ("AISystem", "AIModel", "AITechnique", "AICapability", "Stakeholder", "Regulator", "Regulation", "Standard", "AffectedActor", "GPAIModel")
CHAIN = (("risk_source", "RiskSource", "causes"), ("risk", "Risk", "leadsTo"), ("consequence", "Consequence", "impacts"), ("impact", "Impact", "affects"), ("affected_actor", "AffectedActor", None))
NAME_TYPES = {"llm": "AIModel", "large language model": "AIModel", "foundation model": "AIModel", "algorithm": "AITechnique"}

# ---- end of fixed values -------------------------------------------------------------------------


def _mapping(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


_SPACE = r"(?U)^\s+|\s+$"


def normalize_class(raw: Column) -> Column:
    """The class a raw name stands for: by alias, by name, or NULL; case and outer white space do not count."""
    low = F.lower(F.regexp_replace(raw, _SPACE, ""))
    return F.coalesce(F.try_element_at(_mapping(CLASS_ALIASES), low), F.try_element_at(_mapping({c.lower(): c for c in CLASSES}), low))


def normalize_relation(raw: Column) -> Column:
    """The relation a raw name stands for; spaces become underscores first, so aliases with spaces are never met."""
    low = F.replace(F.lower(F.regexp_replace(raw, _SPACE, "")), F.lit(" "), F.lit("_"))
    return F.coalesce(F.try_element_at(_mapping(RELATION_ALIASES), low), F.try_element_at(_mapping({r.lower(): r for r in RELATIONS}), low))


def alignment_type(kind: Column, stakeholders: tuple[str, ...] = ALIGNED_STAKEHOLDERS) -> Column:
    """Subtypes of stakeholders count as Stakeholder when names are aligned."""
    return F.when(kind.isin(*stakeholders), F.lit("Stakeholder")).otherwise(kind)


def corrected_type(name: Column, kind: Column) -> Column:
    """Some names taken for systems are models or techniques."""
    return F.when(kind == "AISystem", F.coalesce(F.try_element_at(_mapping(NAME_TYPES), F.lower(F.trim(name))), kind)).otherwise(kind)


def constraints(spark: SparkSession) -> DataFrame:
    """(predicate, domain, range) as arrays: a fixed table of a row per relation."""
    rows = [(p, list(d), list(r)) for p, (d, r) in CONSTRAINTS.items()]
    return spark.createDataFrame(rows, "predicate string, domain array<string>, range array<string>")
