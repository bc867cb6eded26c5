"""Two raters for each task: who shares tasks, where they differ, and what an arbitrator settles.

Ratings are rows (rater, event_id, field, rating), labels rows (rater, event_id, text, labels).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pairs of raters who were given the same tasks.
PAIRS = ((1, 3), (2, 4))


def common_events(rows: DataFrame, pairs: tuple[tuple[int, int], ...] = PAIRS) -> DataFrame:
    """(pair, a, b, event_id): events that both raters of a pair have."""
    held = rows.select("rater", "event_id").distinct()
    named = F.broadcast(rows.sparkSession.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs, 1)], "pair int, a int, b int"))  # a row per pair
    first = held.withColumnRenamed("rater", "a").join(named, "a")
    return first.join(held.withColumnRenamed("rater", "b"), ["b", "event_id"]).select("pair", "a", "b", "event_id")


def _sides(rows: DataFrame, common: DataFrame, keys: list[str], value: list[str]) -> DataFrame:
    """Each key of a common event with both raters' values, those that one lacks NULL."""
    side = lambda r: common.select("pair", "event_id", F.col(r).alias("rater")).join(rows, ["rater", "event_id"]).select("pair", "event_id", *keys, *[F.col(v).alias(f"{v}_{r}") for v in value])
    return side("a").join(side("b"), ["pair", "event_id", *keys], "full")


def label_disputes(labels: DataFrame, pairs: tuple[tuple[int, int], ...] = PAIRS) -> DataFrame:
    """(pair, event_id, only_a, only_b): events whose raters marked other sets of (text, labels), with what each has alone."""
    once = labels.select("rater", "event_id", F.struct("text", "labels").alias("mark")).distinct().withColumn("here", F.lit(True))
    met = _sides(once, common_events(labels, pairs), ["mark"], ["here"])
    alone = lambda mine, other: F.sort_array(F.collect_list(F.when(F.col(mine) & F.col(other).isNull(), F.col("mark"))))
    tasks = met.groupBy("pair", "event_id").agg(alone("here_a", "here_b").alias("only_a"), alone("here_b", "here_a").alias("only_b"))
    return tasks.filter((F.size("only_a") > 0) | (F.size("only_b") > 0))


def slot_tasks(ratings: DataFrame, pairs: tuple[tuple[int, int], ...] = PAIRS) -> DataFrame:
    """(pair, event_id, agreed, disputed): tasks with a field that both rated differently; only fields rated by both count.

    `agreed` (field, rating) is filled in for the arbitrator, `disputed` (field, a, b) is left open.
    """
    met = _sides(ratings.select("rater", "event_id", "field", "rating"), common_events(ratings, pairs), ["field"], ["rating"])
    same = F.col("rating_a") == F.col("rating_b")
    listed = lambda cond, *cols: F.sort_array(F.collect_list(F.when(cond, F.struct("field", *cols))))
    tasks = met.filter("rating_a is not null and rating_b is not null").groupBy("pair", "event_id")
    return tasks.agg(listed(same, F.col("rating_a").alias("rating")).alias("agreed"), listed(~same, F.col("rating_a").alias("a"), F.col("rating_b").alias("b")).alias("disputed")).filter(F.size("disputed") > 0)


def dispute_counts(tasks: DataFrame) -> DataFrame:
    """(pair, field, n): how often each field is disputed."""
    return tasks.select("pair", F.explode("disputed.field").alias("field")).groupBy("pair", "field").agg(F.count("*").alias("n"))


def arbitrated(ratings: DataFrame, decided: DataFrame, pairs: tuple[tuple[int, int], ...] = PAIRS) -> DataFrame:
    """(event_id, field, rating, origin): the first raters' tasks; where the pair differs in any field, also one that only
    one of them rated, the arbitrator's task takes its place as a whole, if there is one.

    `decided`: rows (event_id, field, rating).  Origins: original, arbitrated, unsettled (differing without an arbitration).
    """
    met = _sides(ratings.select("rater", "event_id", "field", "rating"), common_events(ratings, pairs), ["field"], ["rating"])
    differing = met.filter(~F.col("rating_a").eqNullSafe(F.col("rating_b"))).select("event_id").distinct().withColumn("_differs", F.lit(True))
    settled = decided.select("event_id").distinct().withColumn("_settled", F.lit(True))
    own = ratings.filter(F.col("rater").isin(*[a for a, _ in pairs])).select("event_id", "field", "rating")
    marked = own.join(differing, "event_id", "left").join(settled, "event_id", "left")
    kept = marked.filter("_differs is null or _settled is null").select("event_id", "field", "rating", F.when(F.col("_differs"), "unsettled").otherwise("original").alias("origin"))
    tasks = own.select("event_id").distinct().join(differing, "event_id", "left_semi")
    return kept.unionByName(decided.join(tasks, "event_id", "left_semi").select("event_id", "field", "rating", F.lit("arbitrated").alias("origin")))
