"""Graph quality metrics, extraction scores and agreement between raters."""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import fold_text
from loomgraph.functions.vocab import STAKEHOLDERS
from loomgraph.operators import validate


def ratio(a: Column, b: Column, digits: int, percent: bool = False) -> Column:
    value = F.when(b == 0, 0.0).otherwise(a / b)
    return F.round(value * 100 if percent else value, digits)


def density(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: content_nodes, content_edges, content_statements, gdc and kdc (edges and statements per node)."""
    n = nodes.filter(validate.is_content_type(F.col("entity_type"))).agg(F.count("*").alias("content_nodes"))
    e = validate.content_edges(edges, nodes).agg(F.count("*").alias("content_edges"), F.coalesce(F.sum(F.greatest(F.size("evidence"), F.lit(0))), F.lit(0)).alias("content_statements"))
    both = n.join(F.broadcast(e))
    return both.select("*", ratio(F.col("content_edges"), F.col("content_nodes"), 2).alias("gdc"), ratio(F.col("content_statements"), F.col("content_nodes"), 2).alias("kdc"))


def type_diversity(nodes: DataFrame) -> DataFrame:
    """One row: tdv (mean number of content types) and tde (mean entropy of types, in bits) over events."""
    counts = nodes.filter(validate.is_content_type(F.col("entity_type"))).groupBy("event_id", "entity_type").agg(F.count("*").alias("n"))
    totals = counts.groupBy("event_id").agg(F.sum("n").alias("total"), F.count("*").alias("types"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    entropy = F.when(F.col("total") <= 1, 0.0).otherwise(F.log2("total") - F.col("s") / F.col("total"))
    return totals.agg(F.round(F.avg("types"), 1).alias("tdv"), F.round(F.avg(entropy), 2).alias("tde"))


def role_specificity(nodes: DataFrame, specific: tuple[str, ...], generic: tuple[str, ...]) -> DataFrame:
    """One row: rsr, the mean share of specific roles among all, in percent (0 for an event without)."""
    count = lambda kinds: F.count(F.when(F.col("entity_type").isin(*kinds), 1))
    per = nodes.groupBy("event_id").agg(count(specific).alias("s"), count(generic).alias("g"))
    return per.agg(F.round(F.avg(F.when(F.col("s") + F.col("g") == 0, 0.0).otherwise(F.col("s") / (F.col("s") + F.col("g")) * 100)), 1).alias("rsr"))


def redundancy(nodes: DataFrame) -> DataFrame:
    """One row: cdrr, the mean share of names that repeat another, in percent."""
    per = nodes.filter(validate.is_content_type(F.col("entity_type"))).groupBy("event_id").agg(F.count("*").alias("n"), F.countDistinct(fold_text(F.col("name"))).alias("d"))
    return per.agg(F.round(F.avg((F.col("n") - F.col("d")) / F.col("n") * 100), 1).alias("cdrr"))


def ontology_violations(nodes: DataFrame, edges: DataFrame, constraints: DataFrame) -> DataFrame:
    """One row: semantic_edges, violations and ovr in percent; an unknown predicate is a violation here."""
    typed = validate.typed_edges(validate.semantic_edges(edges), nodes).join(F.broadcast(constraints), "predicate", "left")
    good = F.coalesce(validate.allowed(F.col("domain"), F.col("range"), F.col("subject_type"), F.col("object_type")), F.lit(False))
    return typed.agg(F.count("*").alias("semantic_edges"), F.count(F.when(~good, 1)).alias("violations")).withColumn("ovr", ratio(F.col("violations"), F.col("semantic_edges"), 1, True))


def evidence_matches(evidence: DataFrame, documents: DataFrame, least: int = 4) -> DataFrame:
    """(edge_id, matched): whether all evidence of an edge stands literally in its documents, both folded."""
    texts = documents.select("doc_id", fold_text(F.col("content")).alias("_text"))
    joined = evidence.join(texts, evidence["source_doc_id"] == texts["doc_id"], "left").withColumn("_s", fold_text(F.col("sentence")))
    hit = F.coalesce((F.length("_s") >= least) & F.contains("_text", "_s"), F.lit(False))
    return joined.groupBy("edge_id").agg(F.bool_and(hit).alias("matched"))


def evidence_support(matches: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One row: edges, matched, judged, esr_rule, esr_judged and coverage; esr_judged is NULL where nothing was judged."""
    j = matches.join(verdicts, "edge_id", "left")
    ok = F.col("matched") | F.coalesce("verdict", F.lit(False))
    open_, judged = ~F.col("matched"), ~F.col("matched") & F.col("verdict").isNotNull()
    n = lambda c: F.count(F.when(c, 1))
    got = j.agg(F.count("*").alias("edges"), n(F.col("matched")).alias("matched"), n(open_).alias("_open"), n(judged).alias("judged"), n(ok).alias("_ok"))
    return got.select(
        "edges", "matched", "judged", ratio(F.col("matched"), F.col("edges"), 1, True).alias("esr_rule"),
        F.when(F.col("judged") > 0, ratio(F.col("_ok"), F.col("edges"), 1, True)).alias("esr_judged"),
        F.when(F.col("_open") == 0, 100.0).otherwise(F.round(F.col("judged") / F.col("_open") * 100, 1)).alias("coverage"),
    )


def consistency(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: groups of (event, subject name, predicate), those whose objects agree in type, and cdc in percent."""
    typed = validate.content_edges(edges, nodes)
    kind = F.when(F.col("object_type").isin(*STAKEHOLDERS), "Stakeholder").otherwise(F.col("object_type"))
    objects = typed.groupBy("event_id", fold_text(F.col("subject_name")).alias("s"), "predicate", fold_text(F.col("object_name")).alias("o")).agg(F.min_by(kind, "pos").alias("kind"))
    groups = objects.groupBy("event_id", "s", "predicate").agg(F.countDistinct("kind").alias("kinds"))
    return groups.agg(F.count("*").alias("groups"), F.count(F.when(F.col("kinds") <= 1, 1)).alias("consistent")).withColumn("cdc", ratio(F.col("consistent"), F.col("groups"), 1, True))


def layer(predicate: Column, object_type: Column, subject_type: Column) -> Column:
    return (
        F.when((predicate == "hasEvidence") | (object_type == "Evidence"), "evidence")
        .when((subject_type == "RoleAssignment") | (object_type == "RoleAssignment"), "role")
        .when((subject_type == "AIRiskIncident") | (object_type == "AIRiskIncident"), "hub")
        .when(validate.is_content_type(subject_type) & validate.is_content_type(object_type), "content")
        .otherwise("other")
    )


def layered_support(edges: DataFrame, nodes: DataFrame, matches: DataFrame) -> DataFrame:
    """(layer, n, matched, esr): by layer, and all layers but content together as infra_combined."""
    typed = validate.typed_edges(validate.semantic_edges(edges), nodes).join(matches, F.col("id") == F.col("edge_id"), "left")
    rows = typed.select(layer(F.col("predicate"), F.col("object_type"), F.col("subject_type")).alias("layer"), F.coalesce("matched", F.lit(False)).alias("m"))
    rows = rows.withColumn("infra", F.when(F.col("layer") != "content", "infra_combined"))
    sets = rows.groupingSets([["layer"], ["infra"]], "layer", "infra").agg(F.count("*").alias("n"), F.count(F.when(F.col("m"), 1)).alias("matched"), F.grouping("layer").alias("_g"))
    named = sets.select(F.when(F.col("_g") == 0, F.col("layer")).otherwise(F.col("infra")).alias("layer"), "n", "matched")
    return named.filter("layer is not null").withColumn("esr", ratio(F.col("matched"), F.col("n"), 1, True))


def deleted(predicted: DataFrame, kept: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, outcome fp): predictions that an annotation no longer holds, once for each annotation.

    `kept` holds an annotation's remaining predictions: (annotation, and the keys); every annotation judges all of its task's.
    """
    task, rest = keys[0], keys[1:]
    asked = predicted.select(*keys).distinct().join(kept.select("annotation", task).distinct(), task)
    return asked.join(kept.select("annotation", *keys).distinct(), ["annotation", *keys], "left_anti").select("annotation", task, *rest, F.lit("fp").alias("outcome"))


def complete_share(events: DataFrame, complete: DataFrame) -> DataFrame:
    """One row: events, complete and rcc, the share of events with a complete risk chain, in percent."""
    marked = events.select("event_id").distinct().join(complete.select("event_id").distinct().withColumn("_c", F.lit(1)), "event_id", "left")
    return marked.agg(F.count("*").alias("events"), F.count("_c").alias("complete")).withColumn("rcc", ratio(F.col("complete"), F.col("events"), 1, True))


def with_stakeholders(spans: DataFrame) -> DataFrame:
    """The spans, and those of all stakeholder classes once more under `Stakeholder(agg)`, for `precision_recall(...)` to sum up."""
    both = F.when(F.col("kind").isin(*STAKEHOLDERS), F.array("kind", F.lit("Stakeholder(agg)"))).otherwise(F.array("kind"))
    return spans.withColumn("kind", F.explode(both)).withColumn("again", F.col("kind") == "Stakeholder(agg)")


def precision_recall(spans: DataFrame) -> DataFrame:
    """(kind, tp, gold, predicted, p, r, f1) by kind and Overall, from rows of (kind, outcome exact|partial|fn|fp).

    Rows marked `again` (see `with_stakeholders`) do not count a second time in Overall.
    """
    if "again" in spans.columns:
        own = precision_recall(spans.drop("again")).filter("kind != 'Overall'")
        return own.unionByName(precision_recall(spans.filter("not again").drop("again")).filter("kind = 'Overall'"))
    n = lambda o: F.count(F.when(F.col("outcome") == o, 1))
    sets = spans.rollup("kind").agg(n("exact").alias("e"), n("partial").alias("pa"), n("fn").alias("fn"), n("fp").alias("fp"), F.grouping("kind").alias("_g"))
    tp, gold, pred = F.col("e") + 0.5 * F.col("pa"), F.col("e") + F.col("pa") + F.col("fn"), F.col("e") + F.col("pa") + F.col("fp")
    p, r = F.when(pred == 0, 0.0).otherwise(tp / pred), F.when(gold == 0, 0.0).otherwise(tp / gold)
    f1 = F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r))
    return sets.select(F.when(F.col("_g") == 1, "Overall").otherwise(F.col("kind")).alias("kind"), tp.alias("tp"), gold.alias("gold"), pred.alias("predicted"), F.round(p, 4).alias("p"), F.round(r, 4).alias("r"), F.round(f1, 4).alias("f1"))


def slot_accuracy(ratings: DataFrame, by: str = "slot") -> DataFrame:
    """(slot, n, accuracy, support): by slot and Overall; ratings 3, 2, 1 count 1, half, nothing, others only in n."""
    n = lambda v: F.count(F.when(F.col("rating") == v, 1))
    sets = ratings.rollup(by).agg(F.count("*").alias("n"), n(3).alias("c"), n(2).alias("pa"), F.grouping(by).alias("_g"))
    return sets.select(F.when(F.col("_g") == 1, "Overall").otherwise(F.col(by)).alias(by), "n", F.round((F.col("c") + 0.5 * F.col("pa")) / F.col("n"), 4).alias("accuracy"), F.round((F.col("c") + F.col("pa")) / F.col("n"), 4).alias("support"))


def set_agreement(a: DataFrame, b: DataFrame, keys: list[str], by: str) -> DataFrame:
    """(by, both, only_a, only_b, f1) of two raters' sets."""
    left, right = a.select(*keys).distinct().withColumn("_a", F.lit(1)), b.select(*keys).distinct().withColumn("_b", F.lit(1))
    met = left.join(right, keys, "full")
    n = lambda c: F.count(F.when(c, 1))
    got = met.groupBy(by).agg(n(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("both"), n(F.col("_b").isNull()).alias("only_a"), n(F.col("_a").isNull()).alias("only_b"))
    return got.withColumn("f1", F.round(2 * F.col("both") / (2 * F.col("both") + F.col("only_a") + F.col("only_b")), 4))


def rater_agreement(ratings: DataFrame, classes: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """One row over (a, b) ratings: n, po, kappa, ac2, weighted_ac2, alpha.

    ac2 takes twice the chance of the published first-order coefficient; the weighted one has squared
    weights; alpha is for ranks, and 1 where at most one value occurs.
    """
    k = len(classes)
    one = lambda side, c: F.count(F.when(F.col(side) == c, 1))
    n = F.col("n").cast("double")
    aggs = [F.count("*").alias("n")]
    aggs += [one(s, c).alias(f"{s}{i}") for s in ("a", "b") for i, c in enumerate(classes)]
    aggs += [F.count(F.when((F.col("a") == x) & (F.col("b") == y), 1)).alias(f"c{i}{j}") for i, x in enumerate(classes) for j, y in enumerate(classes)]
    t = ratings.filter("a is not null and b is not null").agg(*aggs)
    weight = lambda i, j: 1 - ((i - j) / (k - 1)) ** 2
    pi = [(F.col(f"a{i}") + F.col(f"b{i}")) / (2 * n) for i in range(k)]
    po = sum((F.col(f"c{i}{i}") for i in range(k)), F.lit(0)) / n
    pe = sum((F.col(f"a{i}") * F.col(f"b{i}") for i in range(k)), F.lit(0)) / (n * n)
    pa = 2 * sum((p * (1 - p) for p in pi), F.lit(0.0)) / (k - 1)
    wo = sum((F.col(f"c{i}{j}") * weight(i, j) for i in range(k) for j in range(k)), F.lit(0.0)) / n
    we = sum((pi[i] * pi[j] * weight(i, j) for i in range(k) for j in range(k)), F.lit(0.0))
    m = [F.col(f"a{i}") + F.col(f"b{i}") for i in range(k)]
    seen = [F.when(x > 0, 1).otherwise(0) for x in m]
    rank = [sum(seen[: i + 1], F.lit(0)) for i in range(k)]
    most = sum(seen, F.lit(0))
    gap = lambda i, j: F.pow((rank[i] - rank[j]) / F.greatest(most - 1, F.lit(1)), 2)
    do = sum((F.col(f"c{i}{j}") * gap(i, j) for i in range(k) for j in range(k)), F.lit(0.0)) / n
    de = sum((m[i] * m[j] * gap(i, j) for i in range(k) for j in range(k)), F.lit(0.0)) / (2 * n * (2 * n - 1))
    part = lambda o, e: F.when(1 - e <= 0, 0.0).otherwise((o - e) / (1 - e))
    full = lambda o, e: F.when(1 - e == 0, F.when(o == 1, 1.0).otherwise(0.0)).otherwise((o - e) / (1 - e))
    return t.select(
        "n", F.round(po, 4).alias("po"), F.round(part(po, pe), 4).alias("kappa"), F.round(full(po, pa), 4).alias("ac2"),
        F.round(full(wo, we), 4).alias("weighted_ac2"), F.round(F.when((most <= 1) | (de == 0), 1.0).otherwise(1 - do / de), 4).alias("alpha"),
    )


def binary_agreement(rows: DataFrame) -> DataFrame:
    """One row over booleans (truth, said): tp, fp, fn, tn, p, r, f1, kappa; f1 is NULL where p or r is 0 or NULL."""
    n = lambda t, s: F.count(F.when((F.col("truth") == t) & (F.col("said") == s), 1))
    c = rows.agg(n(True, True).alias("tp"), n(False, True).alias("fp"), n(True, False).alias("fn"), n(False, False).alias("tn"))
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    total = tp + fp + fn + tn
    p, r = F.when(tp + fp > 0, tp / (tp + fp)), F.when(tp + fn > 0, tp / (tp + fn))
    po, pe = (tp + tn) / total, ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (total * total)
    return c.select("*", F.round(p, 4).alias("p"), F.round(r, 4).alias("r"), F.round(F.when((p > 0) & (r > 0), 2 * p * r / (p + r)), 4).alias("f1"), F.round(F.when(pe == 1, 1.0).otherwise((po - pe) / (1 - pe)), 4).alias("kappa"))


#: What a draw of 32 bits must reach to weigh 1, 2, ... in a Poisson distribution of mean 1.
POISSON = tuple(math.floor(2**32 * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(12))


def replicates(rows: DataFrame, key: str, resamples: int, seed: int = 42) -> DataFrame:
    """The rows with `replicate` and `weight`: how often each is in each resample, by a hash of key, resample and seed; not where it is not in it.

    Weights are Poisson draws of mean 1, which resampling with replacement comes to; keys are different.  Work is
    rows times resamples.  For shares of a resample `resampled` sums up without making these rows.
    """
    block = F.explode(F.sequence(F.lit(0), F.lit(-(-resamples // 4) - 1))).alias("_block")
    drawn = rows.select("*", block).withColumn("_hash", F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string"), "_block")))
    part = F.explode(F.sequence(F.lit(0), F.lit(3)))
    drawn = drawn.withColumn("_part", part).withColumn("replicate", F.col("_block") * 4 + F.col("_part")).filter(F.col("replicate") < resamples)
    u = F.conv(F.substring("_hash", F.col("_part") * 8 + 1, F.lit(8)), 16, 10).cast("long")
    weight = sum(F.when(u >= t, 1).otherwise(0) for t in POISSON)
    return drawn.withColumn("weight", weight).filter("weight > 0").drop("_block", "_hash", "_part")


def _weights(resamples: int, seed: int):
    """Over batches of (key, yes): the weights of all, of those that count, and of those that are true, by resample, as one row each."""
    blocks = [f"|{i}".encode() for i in range(-(-resamples // 4))]
    steps = np.array(POISSON, np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, len(blocks) * 4), np.int64)
        for batch in batches:
            said = batch.column("yes")
            masks = np.array([np.ones(len(said), bool), said.is_valid().to_numpy(zero_copy_only=False), said.fill_null(False).to_numpy(zero_copy_only=False)])
            for k, key in enumerate(batch.column("key").to_pylist()):
                # a null key leaves nothing between the bars, not even one of them
                begun = md5(f"{seed}".encode() if key is None else f"{seed}|{key}".encode(), usedforsecurity=False)
                drawn = np.frombuffer(b"".join([_ended(begun, b) for b in blocks]), ">u4").astype(np.uint32)
                sums += masks[:, k, None] * np.searchsorted(steps, drawn, side="right")
        if sums[0].any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(resamples)), *(pa.array(s[:resamples]) for s in sums)], names=["replicate", "drawn", "known", "true"])

    return run


def _ended(begun, rest: bytes) -> bytes:
    done = begun.copy()
    done.update(rest)
    return done.digest()


def resampled(rows: DataFrame, key: str, yes: Column, resamples: int, seed: int = 42) -> DataFrame:
    """(replicate, drawn, known, true): how many rows each resample of `replicates` draws, those where `yes` is not null, and those where it is true.

    Each task sums up its rows' weights and gives a row for each resample.  Few bytes of rows are much work, so they are
    dealt to all cores however they are stored.
    """
    asked = rows.select(F.col(key).cast("string").alias("key"), yes.cast("boolean").alias("yes"))
    tasks = 4 * rows.sparkSession.sparkContext.defaultParallelism
    each = asked.repartition(tasks, "key").mapInArrow(_weights(resamples, seed), "replicate long, drawn long, known long, true long")
    sums = each.groupBy("replicate").agg(*[F.sum(c).alias(c) for c in ("drawn", "known", "true")])
    return sums.filter("drawn > 0")


def bootstrap_interval(judged: DataFrame, key: str = "id", resamples: int = 10_000, seed: int = 42) -> DataFrame:
    """One row: estimate, low, high of a share of true verdicts (key, verdict), with the 95 % interval over resamples of the rows."""
    said = F.col("verdict").cast("double")
    estimate = judged.agg(F.round(F.avg(said), 4).alias("estimate"))
    shares = resampled(judged, key, F.col("verdict"), resamples, seed).select(F.when(F.col("known") > 0, F.col("true") / F.col("drawn")).alias("x"))
    ends = shares.agg(F.round(F.percentile("x", 0.025), 4).alias("low"), F.round(F.percentile("x", 0.975), 4).alias("high"))
    return estimate.join(F.broadcast(ends))  # one row each
