"""The risk taxonomy: its table, checks of classifications, and names of predicates, countries and roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.text import nz, strip

# The seven domains and 23 subdomains, in the order in which rules are tried.
DOMAINS = {
    "1": "Discrimination & toxicity",
    "2": "Privacy & security",
    "4": "Malicious actors & misuse",
    "3": "Misinformation",
    "6": "Socioeconomic & environmental harms",
    "5": "Human-computer interaction",
    "7": "AI system safety, failures & limitations",
}
SUBDOMAINS = {
    "1.2": "Exposure to toxic content",
    "1.1": "Unfair discrimination and misrepresentation",
    "1.3": "Unequal performance across groups",
    "2.1": "Compromise of privacy by leaking or inferring sensitive information",
    "2.2": "AI system security vulnerabilities and attacks",
    "4.1": "Disinformation, surveillance, and influence at scale",
    "4.2": "Cyberattacks, weapon development or use, and mass harm",
    "4.3": "Fraud, scams, and targeted manipulation",
    "3.1": "False or misleading information",
    "3.2": "Pollution of information ecosystem and loss of consensus reality",
    "6.3": "Economic and cultural devaluation of human effort",
    "6.2": "Increased inequality and decline in employment quality",
    "6.5": "Governance failure",
    "6.1": "Power centralization and unfair distribution of benefits",
    "6.4": "Competitive dynamics",
    "6.6": "Environmental harm",
    "5.1": "Overreliance and unsafe use",
    "5.2": "Loss of human agency and autonomy",
    "7.1": "AI pursuing its own goals in conflict with human goals or values",
    "7.2": "AI possessing dangerous capabilities",
    "7.4": "Lack of transparency or interpretability",
    "7.3": "Lack of capability or robustness",
    "7.5": "AI welfare and rights",
}
OTHER = ("0", "Other")
COUNTRIES = {
    "us": "United States",
    "u.s.": "United States",
    "u.s.a.": "United States",
    "usa": "United States",
    "uk": "United Kingdom",
    "u.k.": "United Kingdom",
    "uae": "United Arab Emirates",
    "u.a.e.": "United Arab Emirates",
}
MAIN_ROLES = ("AIDeveloper", "AIProvider", "AIDeployer", "AIUser")
TRACKED_ROLES = (*MAIN_ROLES, "Regulator")


def taxonomy(spark: SparkSession) -> DataFrame:
    """(rank, domain_id, domain, subdomain_id, subdomain) of all subdomains, and Other last."""
    rows = [(i, s[0], DOMAINS[s[0]], s, name) for i, (s, name) in enumerate(SUBDOMAINS.items())]
    return spark.createDataFrame([*rows, (len(rows), OTHER[0], OTHER[1], OTHER[0], OTHER[1])], "rank int, domain_id string, domain string, subdomain_id string, subdomain string")


def domains(spark: SparkSession) -> DataFrame:
    """(rank, domain) in the order of the rules, Other last."""
    return spark.createDataFrame(list(enumerate([*DOMAINS.values(), OTHER[1]])), "rank int, domain string")


def validated(rows: DataFrame) -> DataFrame:
    """Classifications (subdomain_id, domain and more) with the taxonomy's own names; all four NULL where neither fits.

    A known subdomain counts whatever its other fields say; subdomain 0 or the domain Other is Other.
    """
    known = F.broadcast(taxonomy(rows.sparkSession).drop("rank"))  # one row per subdomain
    sid = F.col("subdomain_id")
    own = F.when(sid.isin(*SUBDOMAINS), sid).when((sid == OTHER[0]) | (F.col("domain") == OTHER[1]), OTHER[0])
    keyed = rows.withColumn("subdomain_id", own).drop("domain_id", "domain", "subdomain")
    return keyed.join(known, "subdomain_id", "left")


def norm_predicate(value: Column) -> Column:
    return F.replace(F.lower(strip(F.coalesce(value, F.lit("")))), F.lit(" "), F.lit("_"))


def norm_country(value: Column) -> Column:
    """Common short forms as the full name; other names as they are."""
    own = strip(F.coalesce(value, F.lit("")))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in COUNTRIES.items() for x in kv]), F.lower(own)), own)


def tracked_role(name: Column, roles: tuple[str, ...] = TRACKED_ROLES) -> Column:
    """The role after the last underscore of an assignment's name, without one the first role it mentions; NULL if not tracked."""
    tail = strip(F.substring_index(name, "_", -1))
    low = F.lower(name)
    mentioned = F.coalesce(*[F.when(F.contains(low, F.lit(r.lower())), F.lit(r)) for r in roles])
    found = F.when(F.contains(name, F.lit("_")), tail).otherwise(mentioned)
    return F.when(found.isin(*roles), found)


def event_info(nodes: DataFrame, incidents: DataFrame) -> DataFrame:
    """(event_id, info): what a classifier is told of an event: its incident, chain and system, a line each.

    `incidents` (event_id, name, description); of a class the first node that has a name counts by position, and
    lines without a value are left out.
    """
    kinds = ("RiskSource", "Risk", "Consequence", "Impact", "AffectedActor", "AISystem", "AITechnique")
    first = nodes.filter(F.col("entity_type").isin(*kinds)).groupBy("event_id").agg(*[F.min_by("name", F.when(F.col("entity_type") == k, F.col("pos"))).alias(k) for k in kinds])
    rows = incidents.join(first, "event_id", "left")
    title = F.coalesce("name", F.lit(""))
    described = F.when(nz(F.col("description")).isNotNull() & (F.col("description") != title), F.concat(F.lit("Description: "), "description"))
    lines = [F.concat(F.lit("Incident: "), title), described, *[F.concat(F.lit(f"{k}: "), nz(F.col(k))) for k in kinds]]
    return rows.select("event_id", F.concat_ws("\n", *lines).alias("info"))
