"""Event-level aggregation: metadata, evidence frequency, representatives, conflicts and categories."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import match_key, normalize_name, nz
from loomgraph.operators.keywords import found_words
from loomgraph.operators.rounds import settle, stored
from loomgraph.operators.similarity import greedy_leaders, similar_pairs

SMALL, MEDIUM = 5, 30
EVIDENCE_CAP = {"small": 50, "medium": 30, "large": 40}
CHUNK, PER_CHUNK, MOST, MEDIUM_MOST = 12, 3, 15, 8
#: Cosine of labels from which reports are near duplicates.
NEAR = 0.85

#: Name lists by category of class.
CATEGORIES = {
    "ai_systems": ("AISystem",),
    "ai_models": ("AIModel",),
    "ai_techniques": ("AITechnique",),
    "ai_capabilities": ("AICapability",),
    "stakeholders": ("Stakeholder",),
    "regulations": ("Regulation",),
    "standards": ("Standard",),
}
#: The same, and lists of the classes that the packages leave out.
ALL_CATEGORIES = CATEGORIES | {
    "gpai_models": ("GPAIModel",),
    "role_holders": ("AIDeveloper", "AIProvider", "AIDeployer", "AIUser"),
    "regulators": ("Regulator",),
    "affected": ("AffectedActor",),
}


def strategy(reports: Column) -> Column:
    return F.when(reports <= SMALL, "small").when(reports <= MEDIUM, "medium").otherwise("large")


def event_metadata(documents: DataFrame) -> DataFrame:
    """(event_id, report_count, first_seen, last_seen, sources, languages, strategy); times are compared as text."""
    time = nz(F.col("publish_time"))
    return documents.groupBy("event_id").agg(
        F.count("*").alias("report_count"),
        F.min(time).alias("first_seen"),
        F.max(time).alias("last_seen"),
        F.sort_array(F.collect_set(nz(F.col("source_name")))).alias("sources"),
        F.sort_array(F.collect_set(nz(F.col("language")))).alias("languages"),
    ).withColumn("strategy", strategy(F.col("report_count")))


def evidence_top(evidence: DataFrame, meta: DataFrame) -> DataFrame:
    """(event_id, sentence, n, doc_id, rank): a large or medium event's most frequent sentences, a small one's first.

    Equal numbers go by first occurrence, whose document is given.  Small events keep repeats.
    """
    kinds = meta.select("event_id", "strategy")
    rows = evidence.join(kinds, "event_id")
    counted = rows.filter("strategy != 'small'").groupBy("event_id", "strategy", "sentence").agg(F.count("*").alias("n"), F.min("pos").alias("pos"), F.min_by("doc_id", "pos").alias("doc_id"))
    plain = rows.filter("strategy = 'small'").select("event_id", "strategy", "sentence", F.lit(1).cast("long").alias("n"), "pos", "doc_id")
    ranked = counted.unionByName(plain).withColumn("rank", F.row_number().over(Window.partitionBy("event_id").orderBy(F.desc("n"), "pos")))
    cap = F.create_map(*[F.lit(x) for kv in EVIDENCE_CAP.items() for x in kv])
    return ranked.filter(F.col("rank") <= F.element_at(cap, F.col("strategy"))).select("event_id", "sentence", "n", "doc_id", "rank")


def chunked(documents: DataFrame, size: int = CHUNK) -> DataFrame:
    """The documents of each event, in order, with the number of their chunk."""
    place = F.row_number().over(Window.partitionBy("event_id").orderBy("pos")) - 1
    return documents.withColumn("chunk", F.floor(place / size).cast("int"))


def representatives(documents: DataFrame, per_chunk: int = PER_CHUNK, most: int = MOST) -> DataFrame:
    """(event_id, doc_id, rank): the first documents of each chunk, then the first of those."""
    first = F.row_number().over(Window.partitionBy("event_id", "chunk").orderBy("pos"))
    some = chunked(documents).withColumn("_n", first).filter(F.col("_n") <= per_chunk)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("event_id").orderBy("pos")))
    return ranked.filter(F.col("rank") <= most).select("event_id", "doc_id", "rank")


def label(documents: DataFrame) -> Column:
    """What a report is compared by: its title and summary, those that are there; NULL without either."""
    parts = [nz(F.col(c)) for c in ("title", "summary") if c in documents.columns]
    return nz(F.concat_ws(" ", *parts)) if parts else F.lit(None).cast("string")


def labelled(documents: DataFrame, vectors: DataFrame | Callable[[Column], Column]) -> DataFrame:
    """(event_id, doc_id, pos, name, vector) of reports, NULL without a label, by the vectors (name, vector) of their labels.

    An encoder in column expressions in place of a table is applied where a report is read, so that no label, which may
    be a whole text, is moved; `name` is empty then.
    """
    rows = documents.select("event_id", "doc_id", "pos", label(documents).alias("name"))
    if callable(vectors):
        there = F.col("name").isNotNull()
        return rows.select("event_id", "doc_id", "pos", F.when(there, F.lit("")).alias("name"), F.when(there, vectors(F.col("name"))).alias("vector"))
    return rows.join(vectors, "name", "left").select("event_id", "doc_id", "pos", "name", "vector")


def unlike_reports(rows: DataFrame, most: int, group: list[str], threshold: float = NEAR) -> DataFrame:
    """(group, event_id, doc_id, pos): of each group the first `most` reports that no earlier one taken is near to.

    Reports, as `labelled` gives them, are compared by the vectors of their labels; one without a label is left out,
    unless its group has no more than `most` reports: then all stay.
    """
    rows = settle(rows.withColumn("_g", F.concat_ws("|", *group)).withColumn("_size", F.count("*").over(Window.partitionBy("_g"))))
    few, many = rows.filter(F.col("_size") <= most), rows.filter((F.col("_size") > most) & F.col("name").isNotNull())
    keyed = many.withColumn("_id", F.concat_ws("|", "_g", F.col("doc_id").cast("string")))
    pairs = similar_pairs(keyed, threshold, kind="_g", key="_id", vector="vector", digits=12).select("a", "b")
    kept = greedy_leaders(keyed.select(F.col("_id").alias("id"), F.col("_g").alias("group"), "pos"), pairs).filter("kept").select(F.col("id").alias("_id"))
    chosen = few.unionByName(keyed.join(kept, "_id").drop("_id"))
    ranked = chosen.drop("vector").withColumn("_n", F.row_number().over(Window.partitionBy("_g").orderBy("pos"))).filter(F.col("_n") <= most)
    return ranked.select(*dict.fromkeys([*group, "event_id", "doc_id", "pos"]))


def chosen_reports(documents: DataFrame, meta: DataFrame, names: DataFrame, vectors: DataFrame | Callable[[Column], Column]) -> DataFrame:
    """(event_id, doc_id, rank): the reports that stand for an event, by its strategy.

    A small event has all.  A medium one has those that are not near to an earlier one, filled up to MEDIUM_MOST with
    further ones that name an entity.  A large one has up to PER_CHUNK unlike ones of each chunk, MOST in all.
    """
    # texts stay where they are: labels are brought to vectors first, once
    rows = stored(labelled(documents, vectors).withColumn("name", F.when(F.col("name").isNotNull(), F.lit(""))), "labels").join(meta.select("event_id", "strategy"), "event_id")
    of = lambda kind: rows.filter(F.col("strategy") == kind).drop("strategy")
    small = of("small").select("event_id", "doc_id", F.lit(0).alias("_part"), "pos")
    unlike = settle(unlike_reports(of("medium"), MEDIUM_MOST, ["event_id"]))
    # the size of a stored table is known, so that texts are not moved to find those of few events
    texts = documents.join(stored(meta.filter("strategy = 'medium'").select("event_id"), "medium"), "event_id", "left_semi")
    rich = entity_rich(texts, names, unlike).join(rows.select("event_id", "doc_id", "pos"), ["event_id", "doc_id"])
    medium = unlike.select("event_id", "doc_id", F.lit(0).alias("_part"), "pos").unionByName(rich.select("event_id", "doc_id", F.lit(1).alias("_part"), "pos"))
    large = unlike_reports(chunked(of("large")), PER_CHUNK, ["event_id", "chunk"]).select("event_id", "doc_id", F.lit(0).alias("_part"), "pos")
    ranked = small.unionByName(medium).unionByName(large)
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("event_id").orderBy("_part", "pos"))).join(meta.select("event_id", "strategy"), "event_id")
    return ranked.filter((F.col("strategy") != "large") | (F.col("rank") <= MOST)).select("event_id", "doc_id", "rank")


@dataclass
class EvidencePackage:
    """What is handed on of each event: tables by event_id, so that no event is a single row.

    metadata; reports (doc_id, rank); core (one array of names per category); evidence (sentence, n, doc_id, rank);
    support (name, support); conflicts (kind, name, types).
    """

    metadata: DataFrame
    reports: DataFrame
    core: DataFrame
    evidence: DataFrame
    support: DataFrame
    conflicts: DataFrame


def evidence_package(documents: DataFrame, entities: DataFrame, vectors: DataFrame | Callable[[Column], Column]) -> EvidencePackage:
    """The packages of all events from their reports and the entities of single documents.

    Entities of one name and type are merged first.  Support is that of the merged entity, in a large event added
    up over the chunks that it is in; sentences are cut to the strategy's number, small events keep repeats.
    """
    from loomgraph.operators.merge import merge_entities

    meta = stored(event_metadata(documents), "metadata")
    merged = settle(merge_entities(entities, [F.col("event_id"), F.lower(normalize_name(F.col("name"))), F.col("entity_type")]))
    kinds = meta.select("event_id", "strategy")
    proof = merged.select("event_id", F.col("pos").alias("_at"), F.posexplode("evidence").alias("_i", "e")).select("event_id", F.col("e.evidence_sentence").alias("sentence"), F.col("e.source_doc_id").alias("doc_id"), F.struct("_at", "_i").alias("pos"))
    by_kind = merged.join(kinds, "event_id")
    large = by_kind.filter("strategy = 'large'")
    support = support_by_name(by_kind.filter("strategy != 'large'")).select("event_id", "name", F.col("support").cast("long").alias("support"))
    support = support.unionByName(support_by_chunk(large, documents.withColumn("doc_id", F.col("doc_id").cast("string"))).select("event_id", "name", F.col("support").cast("long").alias("support")))
    found = conflicts(merged).select("event_id", F.lit("type_conflict").alias("kind"), F.col("name_key").alias("name"), "types")
    found = found.unionByName(low_support(merged, documents).select("event_id", F.lit("low_support").alias("kind"), "name", F.lit(None).cast("array<string>").alias("types")))
    reports = chosen_reports(documents, meta, merged.select("event_id", "name"), vectors)
    return EvidencePackage(meta, reports, categorize(merged), evidence_top(proof, meta), support, found)


def entity_rich(documents: DataFrame, names: DataFrame, chosen: DataFrame, most: int = MEDIUM_MOST) -> DataFrame:
    """(event_id, doc_id): documents that name an entity and are not chosen yet, in order, up to `most` with the chosen."""
    low = documents.select("event_id", F.struct("event_id", "doc_id").alias("key"), F.lower("content").alias("text"))
    named = found_words(low, names.select("event_id", F.lower("name").alias("word")), "event_id", "key", "text", "word", any_=True)
    named = named.select("key.event_id", "key.doc_id").distinct()
    hits = documents.join(named, ["event_id", "doc_id"], "left_semi")
    fresh = hits.join(chosen.select("event_id", "doc_id"), ["event_id", "doc_id"], "left_anti")
    taken = chosen.groupBy("event_id").agg(F.count("*").alias("_taken"))
    ranked = fresh.withColumn("_r", F.row_number().over(Window.partitionBy("event_id").orderBy("pos"))).join(taken, "event_id", "left")
    return ranked.filter(F.col("_r") <= most - F.coalesce("_taken", F.lit(0))).select("event_id", "doc_id")


def support_by_name(entities: DataFrame) -> DataFrame:
    """(event_id, name, support): the support of the last entity of each name."""
    return entities.groupBy("event_id", "name").agg(F.max_by("support_count", "pos").alias("support"))


def strongest(support: DataFrame, most: int = 25) -> DataFrame:
    """(event_id, name, support, rank): an event's best supported names, of equals by name; 25 for a prompt, 12 for a short one."""
    rank = F.row_number().over(Window.partitionBy("event_id").orderBy(F.desc("support"), "name"))
    return support.withColumn("rank", rank).filter(F.col("rank") <= most)


def support_by_chunk(entities: DataFrame, documents: DataFrame) -> DataFrame:
    """(event_id, name, support): a large event's support adds up over all chunks that hold the entity."""
    where = chunked(documents).select("event_id", F.col("doc_id"), "chunk")
    met = entities.select("event_id", "id", "name", "support_count", F.explode("source_doc_ids").alias("doc_id")).join(where, ["event_id", "doc_id"])
    once = met.select("event_id", "id", "name", "support_count", "chunk").distinct()
    return once.groupBy("event_id", "name").agg(F.sum("support_count").alias("support"))


def categorize(entities: DataFrame, categories: dict[str, tuple[str, ...]] = CATEGORIES) -> DataFrame:
    """(event_id, one array of names per category), in order."""
    names = lambda kinds: F.transform(
        F.array_sort(F.collect_list(F.when(F.col("entity_type").isin(*kinds), F.struct("pos", "name")))), lambda s: s["name"]
    )
    return entities.groupBy("event_id").agg(*[names(kinds).alias(c) for c, kinds in categories.items()])


def conflicts(entities: DataFrame) -> DataFrame:
    """(event_id, name_key, types): names that several types claim."""
    keyed = entities.withColumn("name_key", F.lower(normalize_name(F.col("name"))))
    found = keyed.groupBy("event_id", "name_key").agg(F.sort_array(F.collect_set("entity_type")).alias("types"))
    return found.filter(F.size("types") > 1)


def low_support(entities: DataFrame, documents: DataFrame) -> DataFrame:
    """(event_id, name): entities of one document where the event has three and more than one entity."""
    docs = documents.groupBy("event_id").agg(F.count("*").alias("_docs"))
    many = entities.groupBy("event_id").agg(F.count("*").alias("_n"))
    return entities.join(docs, "event_id").join(many, "event_id").filter("_docs >= 3 and _n > 1 and support_count <= 1").select("event_id", "name")


#: Rows of one three-letter part that a task gets.
PART_ROWS = 65536
#: Bits of the place of a part in its name.
PLACE_BITS = 24


def alias_targets(names: DataFrame, least: int = 3, part_rows: int | None = None) -> DataFrame:
    """(kind, name, alias_of): a name of at least 3 characters stands for the longest name of its kind that contains it.

    A container holds every three-letter part of the name, so names meet on their rarest part within the
    kind: only likely pairs are compared, also where all names begin alike.  The rows of a part of more than `part_rows`
    are dealt to several tasks, each of which gets the names that ask for it.
    """
    part_rows = part_rows or PART_ROWS
    low = names.select("kind", "name", F.lower("name").alias("low"), "pos").filter(F.length("name") >= least)
    parts = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("low") - 2), lambda i: F.substring(F.col("low"), i, F.lit(3))))
    each = low.select("kind", "name", "low", "pos", F.posexplode(parts).alias("place", "part"))
    known = each.groupBy("kind", "part").agg(F.count("*").alias("n"))
    # a part for each `part_rows` rows at most
    common = F.broadcast(known.filter(F.col("n") > part_rows).withColumnRenamed("n", "_common"))
    held = each.join(common, ["kind", "part"], "left")
    rare = held.filter("_common is null").select("kind", "part", "name", "low", "place").join(known, ["kind", "part"])
    counted = rare.select("kind", "name", "low", "place", "n").unionByName(held.filter("_common is not null").select("kind", "name", "low", "place", F.col("_common").alias("n")))
    # number and place as one whole number, which is folded without a sort; any part does, so far ones need not be asked
    both = F.shiftleft("n", PLACE_BITS) + F.col("place")
    short = counted.filter(F.col("place") < 1 << PLACE_BITS).groupBy("kind", "name", "low").agg(F.min(both).alias("_least"))
    short = short.select("kind", "name", "low", F.shiftright("_least", PLACE_BITS).alias("n"), F.get(parts, F.col("_least").bitwiseAND((1 << PLACE_BITS) - 1).cast("int")).alias("part"))
    deals = lambda n: F.ceil(n / part_rows).cast("int")
    asked = short.withColumn("_deal", F.explode(F.sequence(F.lit(0), deals(F.col("n")) - 1)))
    dealt = F.pmod(F.xxhash64("name", "pos"), F.coalesce(deals(F.col("_common")), F.lit(1))).cast("int")
    holder = held.select("kind", "part", F.col("name").alias("holder"), F.col("low").alias("hlow"), F.col("pos").alias("hpos"), dealt.alias("_deal"))
    met = asked.join(holder, ["kind", "part", "_deal"]).filter((F.col("low") != F.col("hlow")) & F.contains("hlow", "low"))
    return met.groupBy("kind", "name").agg(F.min_by("holder", F.struct(-F.length("holder"), "hpos")).alias("alias_of"))


def proportional_budget(counts: DataFrame, budget: int, kind: str = "kind", n: str = "n") -> DataFrame:
    """(kind, n, allowed): a share of the budget by size, at least 1 and `n` at most, in order until it is used up.  Where the budget is enough for all, all are allowed."""
    total = Window.partitionBy(F.lit(1))
    sum_ = F.sum(n).over(total)
    share = F.when(sum_ <= budget, F.col(n)).otherwise(F.least(F.col(n), F.greatest(F.lit(1), F.round(F.lit(budget) * F.col(n) / sum_).cast("int"))))
    spent = F.sum("_want").over(Window.partitionBy(F.lit(1)).orderBy(F.col(kind)).rowsBetween(Window.unboundedPreceding, -1))
    wanted = counts.withColumn("_want", share)
    return wanted.withColumn("allowed", F.greatest(F.lit(0), F.least("_want", budget - F.coalesce(spent, F.lit(0)))).cast("int")).drop("_want")


def blocking_links(entities: DataFrame, key: str = "id", block=match_key) -> DataFrame:
    """(a, b): each entity is linked to the first of its kind with the same match key, or another function of the name."""
    keyed = entities.select(F.col(key).alias("b"), "kind", block(F.col("name")).alias("_k")).filter("_k != ''")
    first = keyed.groupBy("kind", "_k").agg(F.min("b").alias("a"), F.count("*").alias("_n")).filter("_n > 1")
    return keyed.join(first, ["kind", "_k"]).filter("a != b").select("a", "b")
