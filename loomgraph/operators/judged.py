"""Graph metrics with a judge's verdicts under composite keys, and the judge held against human labels.

Judgements are rows (key, verdict): `variant|event|evidence|number` for the number of a semantic edge in its
event's order, `variant|event|group|subject|predicate` for a group of statements.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import fold_text
from loomgraph.functions.vocab import STAKEHOLDERS
from loomgraph.operators import metrics, validate
from loomgraph.operators.metrics import resampled

# Relations that may have objects of several stakeholder classes.
MULTIROLE = ("involvesStakeholder", "roleHeldBy")
LAYERS = ("content", "hub", "role", "evidence", "other")


def numbered(edges: DataFrame, variant: str) -> DataFrame:
    """The semantic edges with `key`: their number in their event's order (pos, then id), from 0."""
    place = F.row_number().over(Window.partitionBy("event_id").orderBy("pos", "id")) - 1
    return validate.semantic_edges(edges).withColumn("key", F.concat_ws("|", F.lit(variant), "event_id", F.lit("evidence"), place.cast("string")))


def judged_edges(edges: DataFrame, matches: DataFrame, judgements: DataFrame, variant: str = "full") -> DataFrame:
    """The numbered edges with `matched` and, where they are not, the judge's `verdict` (NULL: not judged)."""
    rows = numbered(edges, variant).join(matches.select(F.col("edge_id").alias("id"), "matched"), "id", "left").withColumn("matched", F.coalesce("matched", F.lit(False)))
    return rows.join(judgements.select("key", F.col("verdict").alias("_v")), "key", "left").withColumn("verdict", F.when(~F.col("matched"), F.col("_v"))).drop("_v")


def support(rows: DataFrame) -> DataFrame:
    """One row over judged edges: edges, matched, judged, supported, esr_rule, esr_judged, coverage."""
    ok = F.col("matched") | F.coalesce("verdict", F.lit(False))
    n = lambda c: F.count(F.when(c, 1))
    got = rows.agg(F.count("*").alias("edges"), n(F.col("matched")).alias("matched"), n(F.col("verdict").isNotNull()).alias("judged"), n(ok).alias("supported"))
    open_ = F.col("edges") - F.col("matched")
    return got.select(
        "edges", "matched", "judged", "supported", metrics.ratio(F.col("matched"), F.col("edges"), 1, True).alias("esr_rule"),
        F.when(F.col("judged") > 0, metrics.ratio(F.col("supported"), F.col("edges"), 1, True)).alias("esr_judged"),
        F.when(open_ == 0, 100.0).otherwise(F.round(F.col("judged") / open_ * 100, 1)).alias("coverage"),
    )


def statement_groups(edges: DataFrame, nodes: DataFrame, judgements: DataFrame, variant: str = "full") -> DataFrame:
    """(event_id, subject, predicate, objects, rule_ok, verdict): semantic edges by folded subject name and relation.

    Of objects of one folded name the first edge's type counts.  A group of one object is consistent; of several,
    those of a relation for many roles must all be stakeholders, others of one type; missing types do not count.
    """
    typed = validate.typed_edges(validate.semantic_edges(edges), nodes)
    rows = typed.select("event_id", fold_text(F.col("subject_name")).alias("subject"), "predicate", fold_text(F.col("object_name")).alias("object"), "object_type", "pos", "id").filter("subject != '' and predicate != ''")
    objects = rows.groupBy("event_id", "subject", "predicate", "object").agg(F.min_by("object_type", F.struct("pos", "id")).alias("kind"), F.min(F.struct("pos", "id")).alias("first"))
    named = F.col("object") != ""
    kinds = F.collect_set(F.when(named, F.col("kind")))
    groups = objects.groupBy("event_id", "subject", "predicate").agg(F.count(F.when(named, 1)).alias("objects"), kinds.alias("_kinds"))
    agree = F.when(F.col("predicate").isin(*MULTIROLE), F.forall("_kinds", lambda k: k.isin(*STAKEHOLDERS))).otherwise(F.size("_kinds") <= 1)
    keyed = groups.withColumn("key", F.concat_ws("|", F.lit(variant), "event_id", F.lit("group"), "subject", "predicate")).join(judgements.select("key", F.col("verdict").alias("_v")), "key", "left")
    return keyed.select("event_id", "subject", "predicate", "objects", ((F.col("objects") <= 1) | agree).alias("rule_ok"), F.when(F.col("objects") > 1, F.col("_v")).alias("verdict"))


def consistency(groups: DataFrame) -> DataFrame:
    """One row: groups, multi (of several objects), judged, cdc_rule, cdc_judged (NULL where none of them was judged) in percent."""
    n = lambda c: F.count(F.when(c, 1))
    multi = F.col("objects") > 1
    got = groups.agg(F.count("*").alias("groups"), n(multi).alias("multi"), n(F.col("verdict").isNotNull()).alias("judged"), n(F.col("rule_ok")).alias("_rule"), n(~multi | F.coalesce("verdict", F.lit(False))).alias("_judge"))
    return got.select("groups", "multi", "judged", metrics.ratio(F.col("_rule"), F.col("groups"), 1, True).alias("cdc_rule"), F.when((F.col("judged") > 0) | (F.col("multi") == 0), metrics.ratio(F.col("_judge"), F.col("groups"), 1, True)).alias("cdc_judged"))


def _layered(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    typed = validate.typed_edges(rows, nodes)
    none = lambda c: F.coalesce(F.col(c), F.lit(""))
    return typed.withColumn("layer", metrics.layer(F.col("predicate"), none("object_type"), none("subject_type")))


def layered(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(layer, total, matched, judged, supported, esr_rule, esr_judged) by layer; infra_combined is all but content.

    The supported edges of the content layer are the graph's knowledge yield.
    """
    placed = _layered(rows, nodes).withColumn("infra", F.when(F.col("layer") != "content", "infra_combined"))
    n = lambda c: F.count(F.when(c, 1))
    aggs = [F.count("*").alias("total"), n(F.col("matched")).alias("matched"), n(F.col("verdict").isNotNull()).alias("judged"), n(F.col("matched") | F.coalesce("verdict", F.lit(False))).alias("supported")]
    sets = placed.groupingSets([["layer"], ["infra"]], "layer", "infra").agg(*aggs, F.grouping("layer").alias("_g"))
    named = sets.withColumn("layer", F.when(F.col("_g") == 0, F.col("layer")).otherwise(F.col("infra"))).filter("layer is not null")
    return named.select("layer", "total", "matched", "judged", "supported", metrics.ratio(F.col("matched"), F.col("total"), 1, True).alias("esr_rule"), metrics.ratio(F.col("supported"), F.col("total"), 1, True).alias("esr_judged"))


def layer_predicates(rows: DataFrame, nodes: DataFrame, most: int = 6) -> DataFrame:
    """(layer, predicate, n, rank): the most frequent relations of each layer; of equals the first by name."""
    counted = _layered(rows, nodes).groupBy("layer", "predicate").agg(F.count("*").alias("n"))
    return counted.withColumn("rank", F.row_number().over(Window.partitionBy("layer").orderBy(F.desc("n"), "predicate"))).filter(F.col("rank") <= most)


# ---- the judge and human labels --------------------------------------------------------------------


def relabelled(choices: DataFrame, key_map: DataFrame) -> DataFrame:
    """(edge_key, label) of choices (val_id, label) through the map (val_id, edge_key); unknown tasks are left out."""
    return choices.join(key_map, "val_id").select("edge_key", "label")


def consensus(a: DataFrame, b: DataFrame | None = None, arbitrated: DataFrame | None = None) -> DataFrame:
    """(edge_key, label): one rater's labels, or of two the shared ones and, where they differ, the arbitrator's."""
    if b is None:
        return a.select("edge_key", "label")
    both = a.select("edge_key", F.col("label").alias("_a")).join(b.select("edge_key", F.col("label").alias("_b")), "edge_key")
    if arbitrated is None:
        return both.filter("_a = _b").select("edge_key", F.col("_a").alias("label"))
    third = arbitrated.select("edge_key", F.col("label").alias("_c"))
    return both.join(third, "edge_key", "left").withColumn("label", F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(F.col("_c"))).filter("label is not null").select("edge_key", "label")


def judge_folds(labels: DataFrame, judge: DataFrame) -> DataFrame:
    """(fold, tp, fp, fn, tn, accuracy, p, r, f1, kappa) of the judge (edge_key, verdict) against labels 2, 1, 0.

    Strict: only 2 is support; lenient: 1 as well.
    """
    met = labels.join(judge, "edge_key")
    out = None
    for fold, least in (("strict", 2), ("lenient", 1)):
        got = metrics.binary_agreement(met.select((F.col("label") >= least).alias("truth"), F.col("verdict").alias("said")))
        got = got.withColumn("accuracy", F.round((F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")), 4)).withColumn("fold", F.lit(fold))
        out = got if out is None else out.unionByName(got)
    return out


def confusion(labels: DataFrame, judge: DataFrame) -> DataFrame:
    return labels.join(judge, "edge_key").groupBy("label", "verdict").agg(F.count("*").alias("n"))


def adjusted_support(labels: DataFrame, literal: int, judged: int, resamples: int = 10_000, seed: int = 42, key: str = "edge_key") -> DataFrame:
    """One row: n, rate (labels of 2), esr, low, high in percent: the share of all edges that are supported if the judged
    ones are so at the labels' rate and the `literal` ones for certain, with the 95 % interval over resamples of the labels."""
    total = literal + judged
    sure = F.col("label") == 2
    percent = lambda rate: (literal + judged * rate) / total * 100
    stats = labels.agg(F.count("*").alias("n"), (F.count_if(sure) / F.count("*")).alias("_rate"))
    rates = resampled(labels, key, F.coalesce(sure, F.lit(False)), resamples, seed).select((F.col("true") / F.col("drawn")).alias("rate"))
    interval = rates.agg(F.round(F.percentile(percent(F.col("rate")), 0.025), 1).alias("low"), F.round(F.percentile(percent(F.col("rate")), 0.975), 1).alias("high"))
    return stats.select("n", F.round("_rate", 4).alias("rate"), F.round(percent(F.col("_rate")), 1).alias("esr")).join(F.broadcast(interval))  # one row each
