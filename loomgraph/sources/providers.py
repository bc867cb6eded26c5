"""Tables in place of model calls: extractions from a lexicon or from raw answers, verdicts, and prompt inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.json_repair import repaired_json
from loomgraph.functions.text import mention_span, nz, stable_id, strip, strip_links
from loomgraph.functions.vocab import STAGE2_TYPES, normalize_class
from loomgraph.plans.build import EVIDENCE

RAW = "array<struct<mention:string,entity_type:string,normalized_name:string,evidence_sentence:string,evidence:string,confidence:double,attributes:map<string,string>>>"

#: Rows up to which a lexicon is broadcast.
LEXICON = 100_000


def gazetteer(documents: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Answers of an extractor that knows a lexicon (name, entity_type): a mention per sentence and known word.

    Sentences and names are met on their words, so no document is compared with the whole lexicon; names
    of several words are checked after their first word matched.  A lexicon of up to LEXICON rows goes to
    every task, so that no sentence is moved for its words; beyond it sentences move once for each of them.
    """
    sentences = documents.select("event_id", "doc_id", F.posexplode(F.split("content", r"(?<=[.!?])\s+")).alias("at", "sentence"))
    words = sentences.withColumn("word", F.explode(F.array_distinct(F.split(F.lower("sentence"), r"[^\p{L}\p{N}_]+"))))
    known = lexicon.select("name", "entity_type", F.element_at(F.split(F.lower("name"), r"[^\p{L}\p{N}_]+"), 1).alias("word"))
    few = known.limit(LEXICON + 1).count() <= LEXICON
    met = words.join(F.broadcast(known) if few else known, "word").filter(F.contains(F.lower("sentence"), F.lower("name")))
    return met.select("event_id", "doc_id", F.col("name").alias("mention"), "entity_type", F.col("name").alias("normalized_name"), F.col("sentence").alias("evidence_sentence"), F.lit(0.9).alias("confidence"), "at")


def parsed_extractions(answers: DataFrame) -> DataFrame:
    """(event_id, doc_id, pos, x): the entities in raw answers (event_id, doc_id, raw), repaired where they must be."""
    body = F.from_json(repaired_json(F.col("raw")), f"entities {RAW}")
    return answers.select("event_id", "doc_id", F.posexplode(body["entities"]).alias("pos", "x"))


def normalized_fields(x: Column) -> Column:
    """Variants of field names brought to one: the short name of the evidence counts where the long one is missing.

    A list in place of a text is its filled items with spaces between.
    """
    one = lambda c: F.coalesce(F.when(c.rlike(r"^\s*\["), F.array_join(F.filter(F.from_json(c, "array<string>"), lambda v: F.length(v) > 0), " ")), c)
    return F.struct(
        strip(one(x["mention"])).alias("mention"), one(x["entity_type"]).alias("entity_type"), strip(one(F.coalesce(x["normalized_name"], x["mention"]))).alias("name"),
        strip(one(F.coalesce(x["evidence_sentence"], x["evidence"]))).alias("evidence_sentence"), x["confidence"].alias("confidence"), x["attributes"].alias("attributes"),
    )


def is_complete(x: Column, need_evidence: bool = True) -> Column:
    """Every required field is filled; a confidence need only be there."""
    filled = lambda c: nz(c).isNotNull()
    ok = filled(x["mention"]) & filled(x["entity_type"]) & filled(x["name"]) & x["confidence"].isNotNull()
    return ok & filled(x["evidence_sentence"]) if need_evidence else ok


def extracted_entities(parsed: DataFrame, documents: DataFrame, need_evidence: bool = True, types: tuple[str, ...] = STAGE2_TYPES, blocked: tuple[str, ...] | None = None) -> DataFrame:
    """Nodes of explicit entities with the places of their mentions; other types and incomplete answers are left out.

    With `blocked` (a run without the ontology) all types but these are let in.
    """
    rows = parsed.withColumn("x", normalized_fields(F.col("x"))).filter(is_complete(F.col("x"), need_evidence))
    rows = rows.withColumn("kind", normalize_class(F.col("x.entity_type"))).filter(F.col("kind").isin(*types) if blocked is None else F.col("kind").isNotNull() & ~F.col("kind").isin(*blocked)).join(documents.select("doc_id", "content"), "doc_id")
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("x.confidence", F.lit(0.8))))
    sentence = F.coalesce(strip_links(F.col("x.evidence_sentence")), F.lit(""))
    proof = F.array(F.struct(stable_id(F.col("doc_id"), F.left(sentence, F.lit(50))).alias("evidence_id"), sentence.alias("evidence_sentence"), F.col("doc_id").cast("string").alias("source_doc_id"), sure.alias("confidence"))).cast(EVIDENCE)
    return rows.select(
        "event_id", "pos", stable_id(F.col("event_id"), F.col("doc_id"), F.col("x.name"), F.col("kind")).alias("id"), F.col("x.name").alias("name"), F.col("kind").alias("entity_type"),
        F.col("x.mention").alias("description"), proof.alias("evidence"), F.lit("explicit").alias("extraction_mode"), sure.alias("confidence"), F.lit(1).alias("support_count"),
        F.array(F.col("doc_id").cast("string")).alias("source_doc_ids"), F.coalesce("x.attributes", F.create_map().cast("map<string,string>")).alias("attributes"), F.lit(None).cast("string").alias("reasoning"),
        mention_span(F.col("content"), F.col("x.mention")).alias("mention_span"), "doc_id",
    )


def parsed_verdict(raw: Column) -> Column:
    """yes, true, same and 1 mean true, whatever the case; NULL stays."""
    return F.lower(strip(raw)).isin("yes", "true", "same", "1")


def bucket_of(raw: Column, known: tuple[str, ...]) -> Column:
    """The known bucket that an answer names: by field, else by mention; `other` if none."""
    named = F.get_json_object(raw, "$.bucket_id")
    mentioned = F.coalesce(*[F.when(F.contains(raw, F.lit(k)), k) for k in known])
    return F.coalesce(F.when(named.isin(*known), named), mentioned, F.lit("other"))


def evidence_context(evidence: DataFrame, most: int) -> DataFrame:
    """(event_id, context): lines `- [document] sentence` of an event's first sentences."""
    from pyspark.sql import Window

    ranked = evidence.withColumn("_n", F.row_number().over(Window.partitionBy("event_id").orderBy("pos"))).filter(F.col("_n") <= most)
    line = F.concat(F.lit("- ["), F.col("doc_id").cast("string"), F.lit("] "), F.col("sentence"))
    return ranked.groupBy("event_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", line.alias("x")))), lambda s: s["x"]), "\n").alias("context"))


#: Sentences and supported names that the sections of a prompt have, at first and in a shorter second try.
SECTIONS = {
    False: (("risk_chain", 30, 25), ("inference", 20, 0)),
    True: (("risk_chain", 12, 12), ("risk_chain_again", 4, 6), ("fields", 10, 0), ("fields_again", 6, 0), ("roles", 4, 0), ("roles_again", 4, 0)),
}
ROLE_CORE = ("ai_systems", "ai_models", "stakeholders", "regulations", "standards")


def prompt_inputs(core: DataFrame, evidence: DataFrame, support: DataFrame, compact: bool = False) -> DataFrame:
    """(event_id, section, core, evidence, support): what the sections of the prompts are filled with, events without evidence left out.

    `core` is JSON of all name lists by category, for roles of five of them.  `evidence` has lines `- [document] sentence`
    of the first sentences by rank, `support` is JSON of the best supported names, of equals by name, or `{}` where a
    section has none.  `compact` is for models that need short prompts.
    """
    categories = [c for c in core.columns if c != "event_id"]
    told = core.select("event_id", F.to_json(F.struct(*categories)).alias("_whole"), F.to_json(F.struct(*[c for c in ROLE_CORE if c in categories])).alias("_roles"))
    most = max(n for _, n, _ in SECTIONS[compact])
    line = F.concat(F.lit("- ["), F.coalesce(nz(F.col("doc_id").cast("string")), F.lit("?")), F.lit("] "), F.coalesce("sentence", F.lit("")))
    lines = evidence.filter(F.col("rank") <= most).groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("x"))))["x"].alias("_lines"))
    named = max(n for _, _, n in SECTIONS[compact])
    from pyspark.sql import Window

    best = support.withColumn("_n", F.row_number().over(Window.partitionBy("event_id").orderBy(F.desc("support"), "name"))).filter(F.col("_n") <= named)
    best = best.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("_n", F.col("name").alias("k"), F.col("support").cast("long").alias("v")))).alias("_best"))
    pairs = lambda n: F.map_from_entries(F.transform(F.slice(F.coalesce("_best", F.array().cast("array<struct<_n:int,k:string,v:bigint>>")), 1, n), lambda x: F.struct(x["k"], x["v"])))
    section = lambda name, sentences, names: F.struct(
        F.lit(name).alias("section"), (F.col("_roles") if name.startswith("roles") else F.col("_whole")).alias("core"), F.array_join(F.slice("_lines", 1, sentences), "\n").alias("evidence"),
        (F.to_json(pairs(names)) if names else F.lit("{}")).alias("support"),
    )
    rows = told.join(lines, "event_id").join(best, "event_id", "left")
    return rows.select("event_id", F.explode(F.array(*[section(*x) for x in SECTIONS[compact]])).alias("x")).select("event_id", "x.*")


def model_family(name: str) -> str | None:
    """The family of a model that needs short prompts and one call at a time, if it is of one."""
    return next((f for f in ("glm", "deepseek", "minimax") if f in name.lower()), None)
