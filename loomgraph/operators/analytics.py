"""Statistics over the graphs: taxonomy, years and periods, transitions, buckets and rates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.taxonomy import norm_country
from loomgraph.operators.keywords import first_rule


#: Keywords up to which each is tested by an expression of its own.
FEW = 16


def classify(texts: list[Column], rules: list[tuple[str, list[str]]]) -> Column:
    """The code of the first rule, in order, of which the first text that matches any rule holds a keyword; NULL if none does.

    `rules` is a parameter: (code, keywords) by priority.  A few keywords are tested one by one, more by an automaton.
    """
    many = sum(len(words) for _, words in rules) > FEW

    def of(text: Column) -> Column:
        low = F.lower(F.coalesce(text, F.lit("")))
        if many:
            return first_rule(low, rules)
        hit = None
        for code, words in rules:
            if not words:
                continue
            any_ = reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])
            hit = F.when(any_, code) if hit is None else hit.when(any_, code)
        return hit if hit is not None else F.lit(None).cast("string")

    return F.coalesce(*[of(t) for t in texts])


def year_counts(rows: DataFrame) -> DataFrame:
    return rows.filter("year is not null").groupBy("year").agg(F.count("*").alias("events"))


def year_share(rows: DataFrame, domains: DataFrame) -> DataFrame:
    """(year, domain, n, share): every domain in every year, zero where nothing happened."""
    counts = rows.filter("year is not null").groupBy("year", "domain").agg(F.count("*").alias("n"))
    grid = rows.select("year").filter("year is not null").distinct().join(F.broadcast(domains.select("domain")))
    full = grid.join(counts, ["year", "domain"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return full.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("year")), 4))


def period_comparison(rows: DataFrame, first: tuple[int, int], second: tuple[int, int]) -> DataFrame:
    """(domain, first_share, second_share, change) of two spans of years."""
    inside = lambda p: (F.col("year") >= p[0]) & (F.col("year") <= p[1])
    counts = rows.groupBy("domain").agg(F.count(F.when(inside(first), 1)).alias("a"), F.count(F.when(inside(second), 1)).alias("b"))
    totals = counts.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    share = lambda n, t: F.when(F.col(t) == 0, 0.0).otherwise(F.round(F.col(n) / F.col(t), 4))
    return counts.join(F.broadcast(totals)).select("domain", share("a", "ta").alias("first_share"), share("b", "tb").alias("second_share"), F.round(share("b", "tb") - share("a", "ta"), 4).alias("change"))


def transitions(typed: DataFrame) -> DataFrame:
    """(predicate, subject_type, object_type, n, mean_support, evidence_rate)."""
    return typed.groupBy("predicate", "subject_type", "object_type").agg(
        F.count("*").alias("n"), F.round(F.avg("support_count"), 4).alias("mean_support"), F.round(F.avg(F.when(F.size("evidence") > 0, 1.0).otherwise(0.0)), 4).alias("evidence_rate")
    )


def adjacent_buckets(assigned: DataFrame, stages: list[str]) -> DataFrame:
    """(from_stage, from_bucket, to_stage, to_bucket, count): what neighbouring stages of an event hold together."""
    order = F.create_map(*[x for i, s in enumerate(stages) for x in (F.lit(s), F.lit(i))])
    rows = assigned.filter("bucket_id != 'missing'").withColumn("_i", F.try_element_at(order, F.col("stage"))).filter("_i is not null")
    a = rows.select("event_id", F.col("_i"), F.col("stage").alias("from_stage"), F.col("bucket_id").alias("from_bucket"))
    b = rows.select("event_id", (F.col("_i") - 1).alias("_i"), F.col("stage").alias("to_stage"), F.col("bucket_id").alias("to_bucket"))
    return a.join(b, ["event_id", "_i"]).groupBy("from_stage", "from_bucket", "to_stage", "to_bucket").agg(F.count("*").alias("count"))


def bucket_order(counts: DataFrame) -> DataFrame:
    """Ranks of buckets for drawing: larger first, `other` last, without `missing`."""
    order = Window.partitionBy("stage").orderBy(F.col("bucket_id") == "other", F.desc("count"), "bucket_id")
    return counts.filter("bucket_id != 'missing'").withColumn("rank", F.row_number().over(order))


def first_slot(nodes: DataFrame) -> DataFrame:
    """(event_id, entity_type, value): the first node of each type."""
    return nodes.groupBy("event_id", "entity_type").agg(F.min_by("name", "pos").alias("value"))


def role_coverage(nodes: DataFrame, roles: tuple[str, ...]) -> DataFrame:
    """(role, events) of the given classes, and `multi`: events with two or more of them."""
    held = nodes.filter(F.col("entity_type").isin(*roles)).select("event_id", "entity_type").distinct()
    single = held.groupBy(F.col("entity_type").alias("role")).agg(F.count("*").alias("events"))
    multi = held.groupBy("event_id").agg(F.count("*").alias("k")).filter("k >= 2").agg(F.lit("multi").alias("role"), F.count("*").alias("events"))
    return single.unionByName(multi)


def response_rate(nodes: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """One row: events, responding (with a node of any of these types) and rate."""
    per = nodes.groupBy("event_id").agg(F.bool_or(F.col("entity_type").isin(*types)).alias("has"))
    return per.agg(F.count("*").alias("events"), F.count(F.when(F.col("has"), 1)).alias("responding"), F.round(F.avg(F.col("has").cast("double")), 4).alias("rate"))


def most_common(rows: DataFrame, value: str, k: int, pos: str = "pos") -> DataFrame:
    """The k most frequent values; of equals the first seen."""
    counted = rows.groupBy(value).agg(F.count("*").alias("n"), F.min(pos).alias("_first"))
    return counted.orderBy(F.desc("n"), "_first").limit(k).drop("_first")


def rate_window(rows: DataFrame, seconds: int = 60, most: int = 55) -> DataFrame:
    """Rows with the calls of their user in the last `seconds`, and whether that is within the limit."""
    span = Window.partitionBy("user_id").orderBy(F.col("ts").cast("timestamp").cast("double")).rangeBetween(-seconds, 0)
    return rows.withColumn("calls", F.count("*").over(span)).withColumn("allowed", F.col("calls") <= most)


def hash_sample(rows: DataFrame, key: str, n: int, seed: str = "2026") -> DataFrame:
    """n rows in the order of a hash of their key: a uniform sample that any engine can repeat."""
    return rows.orderBy(F.sha2(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")), 256), key).limit(n)


def shares(rows: DataFrame, keys: list[str], names: DataFrame) -> DataFrame:
    """All rows of `names` with the number of `rows` of their keys, zero included, and the share of the whole."""
    counted = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    full = F.broadcast(names).join(counted, keys, "left").withColumn("n", F.coalesce("n", F.lit(0)))  # a row per name of the taxonomy
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    return full.withColumn("share", F.when(total == 0, 0.0).otherwise(F.round(F.col("n") / total, 4)))


def rate_by(rows: DataFrame, by: str, flag: Column) -> DataFrame:
    """(by, with, total, rate): how many rows of each value have the flag."""
    got = rows.groupBy(by).agg(F.count(F.when(flag, 1)).alias("with"), F.count("*").alias("total"))
    return got.withColumn("rate", F.round(F.col("with") / F.col("total"), 4))


def diversity_by(rows: DataFrame, value: str, spans: dict[str, tuple[int, int]]) -> DataFrame:
    """(span, mean) of a number over the rows (year, value) of each span of years, 0 where there are none."""
    inside = [F.avg(F.when(F.col("year").between(a, b), F.col(value))) for a, b in spans.values()]
    got = rows.agg(*[F.round(F.coalesce(m, F.lit(0.0)), 4).alias(f"s{i}") for i, m in enumerate(inside)])
    return got.select(F.explode(F.array(*[F.struct(F.lit(name).alias("span"), F.col(f"s{i}").alias("mean")) for i, name in enumerate(spans)])).alias("x")).select("x.*")


def complete_events(first: DataFrame, chain: tuple[str, ...]) -> DataFrame:
    """(event_id, path): events with a first value in every class of the chain, cut to 50 characters and joined."""
    held = first.filter(F.col("entity_type").isin(*chain) & (F.length("value") > 0)).groupBy("event_id").agg(F.map_from_entries(F.collect_list(F.struct("entity_type", "value"))).alias("m"), F.count("*").alias("k"))
    cut = lambda k: cut_short(F.element_at("m", F.lit(k)))
    return held.filter(F.col("k") == len(chain)).select("event_id", F.concat_ws(" -> ", *[cut(k) for k in chain]).alias("path"))


def cut_short(value: Column, most: int = 50) -> Column:
    """A label on one line, cut without white space before the dots."""
    line = F.replace(F.trim(value), F.lit("\n"), F.lit(" "))
    return F.when(F.length(line) <= most, line).otherwise(F.concat(F.rtrim(F.left(line, F.lit(most))), F.lit("...")))


def countries(attributes: DataFrame) -> DataFrame:
    """(country, n) over rows of attribute maps: values of keys that speak of a country, under their common names."""
    rows = attributes.select(F.explode("attributes").alias("k", "v")).filter(F.contains(F.lower("k"), F.lit("country")))
    return rows.groupBy(norm_country(F.col("v")).alias("country")).agg(F.count("*").alias("n"))


def known_transitions(rows: DataFrame, stages: list[str]) -> DataFrame:
    """Transitions (from_stage, to_stage and more) between neighbouring stages; others are left out."""
    pairs = F.array(*[F.lit(f"{a}>{b}") for a, b in zip(stages, stages[1:], strict=False)])
    return rows.filter(F.array_contains(pairs, F.concat_ws(">", "from_stage", "to_stage")))
