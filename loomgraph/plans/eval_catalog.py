"""Queries of arbitration, judged metrics, the taxonomy and statistics over applications, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import taxonomy, text
from loomgraph.operators import analytics, arbitration, judged, metrics, package
from loomgraph.plans import build, metrics_sql
from loomgraph.plans.catalog import _E, entities, query, table
from loomgraph.plans.graph_catalog import _INFRA, _SEM, GRAPH, graph
from loomgraph.sources import readers, writers

# ---- four raters: lines of orders as ratings -------------------------------------------------------

_RATINGS = """
    SELECT 1 + l_linenumber % 4 AS rater, l_orderkey % 400 AS event_id, 'f' || (l_suppkey % 6) AS field, CASE WHEN (l_orderkey % 400) % 3 = 0 THEN 1 + (l_orderkey % 400 + l_suppkey % 6) % 3 ELSE min(1 + CAST(l_quantity AS BIGINT) % 3) END AS rating
    FROM lineitem GROUP BY l_linenumber % 4, l_orderkey % 400, l_suppkey % 6, 'f' || (l_suppkey % 6)"""
_DECIDED = "SELECT e AS event_id, 'f' || f AS field, 1 + (e + f) % 3 AS rating FROM range(0, 400) x(e), range(0, 6) y(f) WHERE e % 5 <> 0"
_PAIR = "p(pair, a, b) AS (VALUES (1, 1, 3), (2, 2, 4))"
_COMMON = f"r AS ({_RATINGS}), h AS (SELECT DISTINCT rater, event_id FROM r), {_PAIR}, c AS (SELECT pair, a, b, x.event_id FROM p JOIN h x ON x.rater = a JOIN h y ON y.rater = b AND y.event_id = x.event_id)"
_MET = f"{_COMMON}, va AS (SELECT pair, c.event_id, field, rating FROM c JOIN r ON r.rater = a AND r.event_id = c.event_id), vb AS (SELECT pair, c.event_id, field, rating FROM c JOIN r ON r.rater = b AND r.event_id = c.event_id), m AS (SELECT coalesce(va.pair, vb.pair) AS pair, coalesce(va.event_id, vb.event_id) AS event_id, coalesce(va.field, vb.field) AS field, va.rating AS x, vb.rating AS y FROM va FULL JOIN vb ON va.pair = vb.pair AND va.event_id = vb.event_id AND va.field = vb.field)"


def _ratings(spark, sf_dir) -> DataFrame:
    e, f = F.col("l_orderkey") % 400, F.col("l_suppkey") % 6
    rows = table(spark, sf_dir, "lineitem").groupBy((1 + F.col("l_linenumber") % 4).alias("rater"), e.alias("event_id"), f.alias("_f")).agg(F.min(1 + F.col("l_quantity").cast("long") % 3).alias("_q"))
    rating = F.when(F.col("event_id") % 3 == 0, 1 + (F.col("event_id") + F.col("_f")) % 3).otherwise(F.col("_q"))
    return rows.select("rater", "event_id", F.concat(F.lit("f"), F.col("_f").cast("string")).alias("field"), rating.alias("rating"))


@query(f"WITH {_COMMON} SELECT pair, event_id FROM c")
def annotator_pairs(spark, sf_dir):
    return arbitration.common_events(_ratings(spark, sf_dir)).select("pair", "event_id")


@query("""WITH r AS (SELECT DISTINCT 1 + l_linenumber % 4 AS rater, l_orderkey % 400 AS event_id, l_returnflag || CASE WHEN (l_orderkey % 400) % 4 = 0 THEN '' ELSE CAST(l_partkey % 5 AS VARCHAR) END AS t, l_linestatus AS l FROM lineitem),
    p(pair, a, b) AS (VALUES (1, 1, 3), (2, 2, 4)), c AS (SELECT DISTINCT pair, a, b, x.event_id FROM p JOIN r x ON x.rater = a JOIN r y ON y.rater = b AND y.event_id = x.event_id),
    xa AS (SELECT pair, c.event_id, t, l FROM c JOIN r ON r.rater = a AND r.event_id = c.event_id), xb AS (SELECT pair, c.event_id, t, l FROM c JOIN r ON r.rater = b AND r.event_id = c.event_id),
    oa AS (SELECT pair, event_id, string_agg(t || l, ',' ORDER BY t, l) AS s FROM (FROM xa EXCEPT FROM xb) GROUP BY ALL), ob AS (SELECT pair, event_id, string_agg(t || l, ',' ORDER BY t, l) AS s FROM (FROM xb EXCEPT FROM xa) GROUP BY ALL)
    SELECT coalesce(oa.pair, ob.pair) AS pair, coalesce(oa.event_id, ob.event_id) AS event_id, coalesce(oa.s, '') AS only_a, coalesce(ob.s, '') AS only_b FROM oa FULL JOIN ob ON oa.pair = ob.pair AND oa.event_id = ob.event_id""")
def label_disputes(spark, sf_dir):
    e = F.col("l_orderkey") % 400
    word = F.concat("l_returnflag", F.when(e % 4 == 0, "").otherwise((F.col("l_partkey") % 5).cast("string")))
    rows = table(spark, sf_dir, "lineitem").select((1 + F.col("l_linenumber") % 4).alias("rater"), e.alias("event_id"), word.alias("text"), F.array("l_linestatus").alias("labels"))
    shown = lambda c: F.array_join(F.transform(c, lambda m: F.concat(m["text"], F.element_at(m["labels"], 1))), ",").alias(c)
    return arbitration.label_disputes(rows).select("pair", "event_id", shown("only_a"), shown("only_b"))


@query(f"""WITH {_MET} SELECT pair, event_id, coalesce(string_agg(field || '=' || x, ',' ORDER BY field) FILTER (x = y), '') AS agreed, string_agg(field || ':' || x || '/' || y, ',' ORDER BY field) FILTER (x <> y) AS disputed FROM m WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY ALL HAVING count(*) FILTER (x <> y) > 0""")
def slot_tasks(spark, sf_dir):
    agreed = F.array_join(F.transform("agreed", lambda s: F.concat(s["field"], F.lit("="), s["rating"].cast("string"))), ",")
    disputed = F.array_join(F.transform("disputed", lambda s: F.concat(s["field"], F.lit(":"), s["a"].cast("string"), F.lit("/"), s["b"].cast("string"))), ",")
    return arbitration.slot_tasks(_ratings(spark, sf_dir)).select("pair", "event_id", agreed.alias("agreed"), disputed.alias("disputed"))


@query(f"WITH {_MET} SELECT pair, field, count(*) AS n FROM m WHERE x <> y GROUP BY ALL")
def dispute_counts(spark, sf_dir):
    return arbitration.dispute_counts(arbitration.slot_tasks(_ratings(spark, sf_dir)))


@query(f"""WITH {_MET}, w AS ({_DECIDED}), d AS (SELECT DISTINCT event_id FROM m WHERE x IS DISTINCT FROM y), o AS (SELECT event_id, field, rating FROM r WHERE rater IN (1, 2))
    SELECT event_id, field, rating, CASE WHEN event_id IN (SELECT event_id FROM d) THEN 'unsettled' ELSE 'original' END AS origin FROM o WHERE event_id NOT IN (SELECT event_id FROM d) OR event_id NOT IN (SELECT event_id FROM w)
    UNION ALL SELECT event_id, field, rating, 'arbitrated' FROM w WHERE event_id IN (SELECT event_id FROM d) AND event_id IN (SELECT event_id FROM o)""")
def arbitrated_ratings(spark, sf_dir):
    grid = spark.range(400).withColumnRenamed("id", "event_id").filter("event_id % 5 != 0").withColumn("f", F.explode(F.sequence(F.lit(0), F.lit(5))))
    decided = grid.select("event_id", F.concat(F.lit("f"), F.col("f").cast("string")).alias("field"), (1 + (F.col("event_id") + F.col("f")) % 3).alias("rating"))
    return arbitration.arbitrated(_ratings(spark, sf_dir), decided)


@query("""WITH a AS (SELECT l_orderkey AS task, l_linenumber AS annotation, l_suppkey % 50 AS item FROM lineitem), k AS (SELECT DISTINCT task, annotation, item FROM a), p AS (SELECT DISTINCT task, item FROM a UNION SELECT DISTINCT task, 99 FROM a)
    SELECT annotation, task, p.item, 'fp' AS outcome FROM p JOIN (SELECT DISTINCT task, annotation FROM k) USING (task) WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.task = p.task AND k.annotation = annotation AND k.item = p.item) ORDER BY ALL""".replace("k.annotation = annotation", "k.annotation = t.annotation").replace("FROM k) USING (task)", "FROM k) t USING (task)"))
def deleted_predictions(spark, sf_dir):
    kept = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("task"), F.col("l_linenumber").alias("annotation"), (F.col("l_suppkey") % 50).alias("item"))
    predicted = kept.select("task", "item").union(kept.select("task", F.lit(99).cast("long")))
    return metrics.deleted(predicted, kept, ["task", "item"])


_STAKE = "('Stakeholder', 'AIDeveloper', 'AIProvider', 'AIDeployer', 'AIUser', 'Regulator')"


@query(f"""WITH x AS (SELECT entity_type AS kind, CASE pos % 9 WHEN 0 THEN 'fn' WHEN 1 THEN 'fp' WHEN 2 THEN 'partial' ELSE 'exact' END AS o FROM ({_E})), y AS (SELECT * FROM x UNION ALL SELECT 'Overall', o FROM x UNION ALL SELECT 'Stakeholder(agg)', o FROM x WHERE kind IN {_STAKE}),
    c AS (SELECT kind, count(*) FILTER (o = 'exact') AS e, count(*) FILTER (o = 'partial') AS pa, count(*) FILTER (o = 'fn') AS fn, count(*) FILTER (o = 'fp') AS fp FROM y GROUP BY kind), d AS (SELECT kind, e + 0.5 * pa AS tp, e + pa + fn AS gold, e + pa + fp AS predicted FROM c)
    SELECT kind, tp::DOUBLE AS tp, gold, predicted, round(tp::DOUBLE / predicted, 4) AS p, round(tp::DOUBLE / gold, 4) AS r, round(2 * (tp::DOUBLE / predicted) * (tp::DOUBLE / gold) / (tp::DOUBLE / predicted + tp::DOUBLE / gold), 4) AS f1 FROM d""")
def stakeholder_prf(spark, sf_dir):
    k = F.col("pos") % 9
    rows = entities(spark, sf_dir).select(F.col("entity_type").alias("kind"), F.when(k == 0, "fn").when(k == 1, "fp").when(k == 2, "partial").otherwise("exact").alias("outcome"))
    return metrics.precision_recall(metrics.with_stakeholders(rows))


# ---- judged metrics ---------------------------------------------------------------------------------

_ID = "substr(sha256(subject_id || '|' || predicate || '|' || object_id), 1, 12)"
_JUDGED = f"""sem AS (SELECT *, {_ID} AS id FROM typed WHERE {_SEM}), num AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY pos, id) - 1 AS i FROM sem), j AS (SELECT *, pos % 2 = 0 AS matched, CASE WHEN pos % 2 <> 0 AND i % 3 <> 0 AND i < 5000 THEN i % 2 = 0 END AS verdict FROM num)"""
_LAYER = f"CASE WHEN predicate = 'hasEvidence' OR ot = 'Evidence' THEN 'evidence' WHEN st = 'RoleAssignment' OR ot = 'RoleAssignment' THEN 'role' WHEN st = 'AIRiskIncident' OR ot = 'AIRiskIncident' THEN 'hub' WHEN coalesce(st, '') NOT IN {_INFRA} AND coalesce(ot, '') NOT IN {_INFRA} THEN 'content' ELSE 'other' END"


def _judged(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(judged edges, nodes): edges of even places match; the judge knows two of three numbers."""
    nodes, edges = graph(spark, sf_dir)
    keys = nodes.select("event_id").distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(4999)))).filter("i % 3 != 0")
    verdicts = keys.select(F.concat_ws("|", F.lit("full"), "event_id", F.lit("evidence"), F.col("i").cast("string")).alias("key"), (F.col("i") % 2 == 0).alias("verdict"))
    matches = edges.groupBy(F.col("id").alias("edge_id")).agg(F.bool_and(F.col("pos") % 2 == 0).alias("matched"))
    return judged.judged_edges(edges, matches, verdicts), nodes


@query(f"""WITH {GRAPH}, {_JUDGED}, c AS (SELECT count(*) AS edges, count(*) FILTER (matched) AS matched, count(*) FILTER (verdict IS NOT NULL) AS judged, count(*) FILTER (matched OR coalesce(verdict, false)) AS supported FROM j)
    SELECT *, round(matched / edges * 100, 1) AS esr_rule, round(supported / edges * 100, 1) AS esr_judged, round(judged / (edges - matched) * 100, 1) AS coverage FROM c""")
def judged_support(spark, sf_dir):
    return judged.support(_judged(spark, sf_dir)[0])


@query(f"""WITH {GRAPH}, {_JUDGED}, l AS (SELECT *, {_LAYER} AS layer FROM j), s AS (SELECT layer, matched, verdict FROM l UNION ALL SELECT 'infra_combined', matched, verdict FROM l WHERE layer <> 'content'),
    c AS (SELECT layer, count(*) AS total, count(*) FILTER (matched) AS matched, count(*) FILTER (verdict IS NOT NULL) AS judged, count(*) FILTER (matched OR coalesce(verdict, false)) AS supported FROM s GROUP BY layer)
    SELECT *, round(matched / total * 100, 1) AS esr_rule, round(supported / total * 100, 1) AS esr_judged FROM c""")
def judged_layers(spark, sf_dir):
    return judged.layered(*_judged(spark, sf_dir))


@query(f"""WITH {GRAPH}, {_JUDGED}, c AS (SELECT {_LAYER} AS layer, predicate, count(*) AS n FROM j GROUP BY ALL) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY n DESC, predicate) AS rank FROM c) WHERE rank <= 6""")
def layer_predicates(spark, sf_dir):
    return judged.layer_predicates(*_judged(spark, sf_dir)).withColumn("rank", F.col("rank").cast("long"))


def _fold(c: str) -> str:
    return f"regexp_replace(regexp_replace(lower({c}), '\\[[^\\]]*\\]', '', 'g'), '[^\\p{{L}}\\p{{N}}_]+', '', 'g')"


@query(f"""WITH {GRAPH}, sem AS (SELECT *, {_ID} AS id FROM typed WHERE {_SEM}), f AS (SELECT event_id, {_fold("subject_name")} AS s, predicate, {_fold("object_name")} AS o, ot, pos, id FROM sem WHERE {_fold("subject_name")} <> ''),
    ob AS (SELECT event_id, s, predicate, o, arg_min(ot, struct_pack(a := pos, b := id)) FILTER (ot IS NOT NULL OR true) AS kind, min(struct_pack(a := pos, b := id)) AS k FROM f GROUP BY ALL),
    g AS (SELECT event_id, s, predicate, count(*) FILTER (o <> '') AS objects, list(DISTINCT kind) FILTER (o <> '' AND kind IS NOT NULL) AS kinds FROM ob GROUP BY ALL),
    v AS (SELECT *, objects <= 1 OR CASE WHEN predicate IN ('involvesStakeholder', 'roleHeldBy') THEN len(list_filter(coalesce(kinds, []), lambda x: x NOT IN {_STAKE})) = 0 ELSE len(coalesce(kinds, [])) <= 1 END AS ok, CASE WHEN objects > 1 AND length(s) % 2 = 0 THEN length(predicate) % 2 = 0 END AS verdict FROM g)
    SELECT count(*) AS groups, count(*) FILTER (objects > 1) AS multi, count(*) FILTER (verdict IS NOT NULL) AS judged, round(count(*) FILTER (ok) / count(*) * 100, 1) AS cdc_rule, round(count(*) FILTER (objects <= 1 OR coalesce(verdict, false)) / count(*) * 100, 1) AS cdc_judged FROM v""")
def judged_consistency(spark, sf_dir):
    nodes, edges = graph(spark, sf_dir)
    known = edges.select("event_id", text.fold_text(F.col("subject_name")).alias("s"), "predicate").distinct().filter(F.length("s") % 2 == 0)
    verdicts = known.select(F.concat_ws("|", F.lit("full"), "event_id", F.lit("group"), "s", "predicate").alias("key"), (F.length("predicate") % 2 == 0).alias("verdict"))
    return judged.consistency(judged.statement_groups(edges, nodes, verdicts))


_LABELLED = "a AS (SELECT doc_id AS k, doc_id % 3 AS label FROM labels WHERE doc_id % 7 <> 0), b AS (SELECT doc_id AS k, CASE WHEN quality = 1 THEN doc_id % 3 ELSE 0 END AS label FROM labels), c AS (SELECT doc_id AS k, 1 AS label FROM labels WHERE doc_id % 2 = 0), g AS (SELECT k, CASE WHEN a.label = b.label THEN a.label ELSE c.label END AS label FROM a JOIN b USING (k) LEFT JOIN c USING (k)), s AS (SELECT g.k, g.label, toxic = 0 AS said FROM g JOIN labels ON doc_id = g.k WHERE g.label IS NOT NULL)"


def _consensus(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(labels both raters share or an arbitrator settles, the judge), all through a key map of task numbers."""
    rows = table(spark, sf_dir, "labels")
    d = F.col("doc_id")
    key_map = rows.filter(d % 7 != 0).select(F.concat(F.lit("v"), d.cast("string")).alias("val_id"), d.alias("edge_key"))
    chosen = rows.select(F.concat(F.lit("v"), d.cast("string")).alias("val_id"), (d % 3).alias("label"))
    a = judged.relabelled(chosen, key_map)
    b = rows.select(d.alias("edge_key"), F.when(F.col("quality") == 1, d % 3).otherwise(0).alias("label"))
    c = rows.filter(d % 2 == 0).select(d.alias("edge_key"), F.lit(1).cast("long").alias("label"))
    return judged.consensus(a, b, c), rows.select(d.alias("edge_key"), (F.col("toxic") == 0).alias("verdict"))


@query("SELECT doc_id AS edge_key, doc_id % 3 AS label FROM labels WHERE doc_id % 7 <> 0")
def key_map_join(spark, sf_dir):
    rows = table(spark, sf_dir, "labels")
    v = F.concat(F.lit("v"), F.col("doc_id").cast("string")).alias("val_id")
    return judged.relabelled(rows.select(v, (F.col("doc_id") % 3).alias("label")), rows.filter("doc_id % 7 != 0").select(v, F.col("doc_id").alias("edge_key")))


@query(f"""WITH {_LABELLED}, f(fold, least) AS (VALUES ('strict', 2), ('lenient', 1)), cc AS (SELECT fold, count(*) FILTER (label >= least AND said)::DOUBLE AS tp, count(*) FILTER (label < least AND said)::DOUBLE AS fp, count(*) FILTER (label >= least AND NOT said)::DOUBLE AS fn, count(*) FILTER (label < least AND NOT said)::DOUBLE AS tn FROM s, f GROUP BY fold),
    d AS (SELECT *, tp / (tp + fp) AS p, tp / (tp + fn) AS r, tp + fp + fn + tn AS n FROM cc), e AS (SELECT *, (tp + tn) / n AS po, ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n) AS pe FROM d)
    SELECT fold, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn, round(po, 4) AS accuracy, round(p, 4) AS p, round(r, 4) AS r, round(2 * p * r / (p + r), 4) AS f1, round((po - pe) / (1 - pe), 4) AS kappa FROM e""")
def judge_folds(spark, sf_dir):
    return judged.judge_folds(*_consensus(spark, sf_dir))


@query(f"WITH {_LABELLED} SELECT label, said AS verdict, count(*) AS n FROM s GROUP BY ALL")
def judge_confusion(spark, sf_dir):
    return judged.confusion(*_consensus(spark, sf_dir))


@query(f"""WITH {_LABELLED}, l AS (SELECT k, label = 2 AS y FROM g WHERE label IS NOT NULL), {metrics_sql.replicates("l", "k", 2000)}, cc AS (SELECT count(*) AS n, count(*) FILTER (y) / count(*) AS rate FROM l),
    sh AS (SELECT (9000 + 3000 * (sum(CASE WHEN y THEN weight ELSE 0 END) / sum(weight))) / 12000 * 100 AS x FROM rep GROUP BY replicate)
    SELECT n, round(rate, 4) AS rate, round((9000 + 3000 * rate) / 12000 * 100, 1) AS esr, (SELECT round(quantile_cont(x, 0.025), 1) FROM sh) AS low, (SELECT round(quantile_cont(x, 0.975), 1) FROM sh) AS high FROM cc""")
def adjusted_support(spark, sf_dir):
    return judged.adjusted_support(_consensus(spark, sf_dir)[0], 9000, 3000, resamples=2000)


# ---- taxonomy and statistics -----------------------------------------------------------------------

_TAX = "tax(rank, domain_id, domain, subdomain_id, subdomain) AS (VALUES " + ", ".join(f"({i}, '{s[0]}', '{taxonomy.DOMAINS[s[0]]}', '{s}', '{n}')" for i, (s, n) in enumerate(taxonomy.SUBDOMAINS.items())) + f", ({len(taxonomy.SUBDOMAINS)}, '0', 'Other', '0', 'Other'))"
_SAID = "said AS (SELECT event_id, user_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(1 + event_id % 8 AS VARCHAR) || '.' || CAST(1 + user_id % 4 AS VARCHAR) END AS sid, CASE WHEN event_id % 22 = 0 THEN 'Other' ELSE event_type END AS domain FROM events)"
_VALID = f"{_TAX}, {_SAID}, valid AS (SELECT event_id, user_id, tax.domain_id, tax.domain, tax.subdomain_id, tax.subdomain FROM said LEFT JOIN tax ON tax.subdomain_id = CASE WHEN sid IN (SELECT subdomain_id FROM tax WHERE subdomain_id <> '0') THEN sid WHEN sid = '0' OR said.domain = 'Other' THEN '0' END)"


def _classified(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    sid = F.when(F.col("event_id") % 11 != 0, F.concat((1 + F.col("event_id") % 8).cast("string"), F.lit("."), (1 + F.col("user_id") % 4).cast("string")))
    rows = e.select("event_id", "user_id", sid.alias("subdomain_id"), F.when(F.col("event_id") % 22 == 0, "Other").otherwise(F.col("event_type")).alias("domain"))
    return taxonomy.validated(rows)


@query(f"WITH {_VALID} SELECT * FROM valid")
def validated_classification(spark, sf_dir):
    return _classified(spark, sf_dir)


@query(f"""WITH {_VALID}, d AS (SELECT domain, min(rank) AS rank FROM tax GROUP BY domain), c AS (SELECT domain, count(*) AS n FROM valid WHERE domain IS NOT NULL GROUP BY domain), x AS (SELECT d.domain, coalesce(n, 0) AS n FROM d LEFT JOIN c USING (domain)) SELECT domain, n, round(n / sum(n) OVER (), 4) AS share FROM x""")
def domain_shares(spark, sf_dir):
    return analytics.shares(_classified(spark, sf_dir), ["domain"], taxonomy.domains(spark).drop("rank"))


@query(f"""WITH {_VALID}, c AS (SELECT subdomain_id, count(*) AS n FROM valid GROUP BY ALL), x AS (SELECT tax.domain, tax.subdomain_id, tax.subdomain, coalesce(n, 0) AS n FROM tax LEFT JOIN c USING (subdomain_id)) SELECT *, round(n / sum(n) OVER (), 4) AS share FROM x""")
def subdomain_shares(spark, sf_dir):
    return analytics.shares(_classified(spark, sf_dir).select("subdomain_id"), ["subdomain_id"], taxonomy.taxonomy(spark).drop("rank", "domain_id"))


@query(f"""WITH {_VALID} SELECT domain, count(*) FILTER (user_id % 3 = 0) AS "with", count(*) AS total, round(count(*) FILTER (user_id % 3 = 0) / count(*), 4) AS rate FROM valid WHERE domain IS NOT NULL GROUP BY domain""")
def rate_by_domain(spark, sf_dir):
    return analytics.rate_by(_classified(spark, sf_dir).filter("domain is not null"), "domain", F.col("user_id") % 3 == 0)


@query("""WITH x AS (SELECT year(o_orderdate) AS y, o_custkey % 5 AS k FROM orders), s(span, a, b) AS (VALUES ('early', 1990, 1995), ('late', 1996, 2001), ('never', 1900, 1901)) SELECT span, round(coalesce(avg(k), 0), 4) AS mean FROM s LEFT JOIN x ON y BETWEEN a AND b GROUP BY span""")
def diversity_by_period(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year"), (F.col("o_custkey") % 5).alias("k"))
    return analytics.diversity_by(rows, "k", {"early": (1990, 1995), "late": (1996, 2001), "never": (1900, 1901)})


_FIRST = "f AS (SELECT event_id, entity_type, arg_min(name, pos) AS v FROM nodes GROUP BY ALL)"
_CHAIN = ("RiskSource", "Risk", "Consequence", "Impact", "AffectedActor")


@query(f"WITH {GRAPH}, {_FIRST}, w AS (SELECT event_id, " + ", ".join(f"max(v) FILTER (entity_type = '{k}') AS {k}" for k in _CHAIN) + " FROM f GROUP BY event_id) SELECT event_id, " + " || ' -> ' || ".join(_CHAIN) + " AS path FROM w WHERE " + " AND ".join(f"{k} <> ''" for k in _CHAIN))
def complete_paths(spark, sf_dir):
    return analytics.complete_events(analytics.first_slot(graph(spark, sf_dir)[0]), _CHAIN)


@query(f"WITH {GRAPH}, t AS (SELECT DISTINCT event_id, subject_id AS a, object_id AS b, predicate AS p, st, ot FROM typed), c AS (SELECT DISTINCT a.event_id FROM t a JOIN t b ON b.event_id = a.event_id AND b.a = a.b JOIN t c ON c.event_id = b.event_id AND c.a = b.b JOIN t d ON d.event_id = c.event_id AND d.a = c.b WHERE a.p = 'causes' AND a.st = 'RiskSource' AND a.ot = 'Risk' AND b.p = 'leadsTo' AND b.ot = 'Consequence' AND c.p = 'impacts' AND c.ot = 'Impact' AND d.p = 'affects' AND d.ot = 'AffectedActor'), e AS (SELECT DISTINCT event_id FROM nodes) SELECT count(*) AS events, count(c.event_id) AS complete, round(count(c.event_id) / count(*) * 100, 1) AS rcc FROM e LEFT JOIN c USING (event_id)")
def chain_share(spark, sf_dir):
    from loomgraph.operators import validate

    nodes, edges = graph(spark, sf_dir)
    return metrics.complete_share(nodes, validate.complete_chains(edges, nodes))


@query("""WITH x AS (SELECT CASE c_custkey % 6 WHEN 0 THEN ' US ' WHEN 1 THEN 'u.k.' WHEN 2 THEN 'UAE' WHEN 3 THEN 'usa' ELSE n_name END AS v FROM customer JOIN nation ON n_nationkey = c_nationkey), y AS (SELECT trim(v) AS v FROM x)
    SELECT CASE lower(v) WHEN 'us' THEN 'United States' WHEN 'usa' THEN 'United States' WHEN 'u.k.' THEN 'United Kingdom' WHEN 'uae' THEN 'United Arab Emirates' ELSE v END AS country, count(*) AS n FROM y GROUP BY ALL""")
def country_counts(spark, sf_dir):
    k = F.col("c_custkey") % 6
    rows = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("n_nationkey") == F.col("c_nationkey"))
    v = F.when(k == 0, " US ").when(k == 1, "u.k.").when(k == 2, "UAE").when(k == 3, "usa").otherwise(F.col("n_name"))
    return analytics.countries(rows.select(F.create_map(F.when(k < 3, "Country").otherwise("home_country"), v, F.lit("region"), F.lit("US")).alias("attributes")))


@query("""WITH x AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN c_name || '_AIUser' WHEN 1 THEN 'the aideployer here' WHEN 2 THEN 'x_Nobody' WHEN 3 THEN 'a_b_Regulator' ELSE 'none' END AS n FROM customer)
    SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'AIUser' WHEN 1 THEN 'AIDeployer' WHEN 3 THEN 'Regulator' END AS role, lower(trim(replace(' Has ' || c_mktsegment || ' x', ' ', '_'), '_')) AS pred FROM x JOIN customer USING (c_custkey)""")
def tracked_roles(spark, sf_dir):
    k = F.col("c_custkey") % 5
    name = F.when(k == 0, F.concat("c_name", F.lit("_AIUser"))).when(k == 1, "the aideployer here").when(k == 2, "x_Nobody").when(k == 3, "a_b_Regulator").otherwise("none")
    pred = taxonomy.norm_predicate(F.concat(F.lit(" Has "), "c_mktsegment", F.lit(" x")))
    return table(spark, sf_dir, "customer").select("c_custkey", taxonomy.tracked_role(name).alias("role"), pred.alias("pred"))


@query(f"""WITH {GRAPH}, {_FIRST}, i AS (SELECT event_id, name, CASE WHEN CAST(event_id AS INTEGER) % 2 = 0 THEN name ELSE 'about ' || name END AS d FROM nodes WHERE entity_type = 'AIRiskIncident'),
    l AS (SELECT event_id, '0' AS o, 'Incident: ' || name AS t FROM i UNION ALL SELECT event_id, '1', 'Description: ' || d FROM i WHERE d <> name UNION ALL SELECT event_id, CAST(2 + list_position(['RiskSource', 'Risk', 'Consequence', 'Impact', 'AffectedActor', 'AISystem', 'AITechnique'], entity_type) AS VARCHAR), entity_type || ': ' || v FROM f WHERE entity_type IN ('RiskSource', 'Risk', 'Consequence', 'Impact', 'AffectedActor', 'AISystem', 'AITechnique') AND event_id IN (SELECT event_id FROM i))
    SELECT event_id, string_agg(t, chr(10) ORDER BY o) AS info FROM l GROUP BY event_id""")
def event_info(spark, sf_dir):
    nodes, _ = graph(spark, sf_dir)
    said = F.when(F.col("event_id").cast("int") % 2 == 0, F.col("name")).otherwise(F.concat(F.lit("about "), "name"))
    return taxonomy.event_info(nodes, nodes.filter("entity_type = 'AIRiskIncident'").select("event_id", "name", said.alias("description")))


# ---- prompt inputs, attributes, loading ---------------------------------------------------------------


@query(f"WITH s AS (SELECT event_id, name, arg_max(support_count, pos) AS support FROM ({_E}) GROUP BY ALL) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY support DESC, name) AS rank FROM s) WHERE rank <= 25")
def strongest_support(spark, sf_dir):
    got = package.strongest(package.support_by_name(entities(spark, sf_dir)))
    return got.withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH e AS (SELECT * FROM ({_E})), x AS (SELECT o_orderkey % 21 AS event_id, CASE o_orderkey % 3 WHEN 0 THEN 'size' WHEN 1 THEN 'maker' ELSE 'price' END AS attribute, CASE WHEN o_custkey % 7 = 0 THEN '' ELSE CAST(o_custkey AS VARCHAR) END AS value, round(o_totalprice) % 100 / 100 AS confidence FROM orders),
    b AS (SELECT event_id, attribute, arg_min(value, struct_pack(c := -confidence, v := value)) AS value FROM x WHERE value <> '' AND confidence >= 0.5 GROUP BY ALL), m AS (SELECT event_id, arg_min(id, struct_pack(s := -support_count, p := pos)) AS id FROM e WHERE entity_type = 'AISystem' GROUP BY event_id)
    SELECT m.event_id, m.id, max(value) FILTER (attribute = 'maker') AS maker, max(value) FILTER (attribute = 'price') AS price, coalesce(CASE WHEN max(p_size) % 3 <> 0 THEN CAST(max(p_size) AS VARCHAR) END, max(value) FILTER (attribute = 'size'), '') AS size FROM m JOIN part ON CAST(p_partkey AS VARCHAR) = m.id LEFT JOIN b ON b.event_id = m.event_id GROUP BY ALL""")
def system_attributes(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    name = F.when(F.col("o_orderkey") % 3 == 0, "size").when(F.col("o_orderkey") % 3 == 1, "maker").otherwise("price")
    given = o.select((F.col("o_orderkey") % 21).alias("event_id"), name.alias("attribute"), F.when(F.col("o_custkey") % 7 == 0, "").otherwise(F.col("o_custkey").cast("string")).alias("value"), (F.round("o_totalprice") % 100 / 100).alias("confidence"))
    e = entities(spark, sf_dir)
    got = build.with_system_attributes(e, given)
    main = build.primary(e, ("AISystem",)).select(F.col("_pid").alias("id"))
    return got.join(main, "id", "left_semi").select("event_id", "id", *[F.try_element_at("attributes", F.lit(k)).alias(k) for k in ("maker", "price", "size")])


@query(f"""WITH e AS (SELECT * FROM ({_E})) SELECT event_id, {", ".join(f"coalesce(string_agg(name, '|' ORDER BY pos) FILTER (entity_type IN {k if len(k) > 1 else f'({k[0]!r})'}), '') AS {c}" for c, k in build.ROLE_CORE.items())} FROM e GROUP BY event_id""")
def role_core(spark, sf_dir):
    got = build.core_for_roles(entities(spark, sf_dir))
    return got.select("event_id", *[F.array_join(c, "|").alias(c) for c in build.ROLE_CORE])


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN props ELSE '{}' END AS section, CASE event_id % 4 WHEN 1 THEN 2 ELSE 0 END AS items FROM events""")
def shape_guards(spark, sf_dir):
    k = F.col("event_id") % 4
    raw = F.when(k == 0, F.col("props")).when(k == 1, F.concat(F.lit("["), "props", F.lit(', "x", 3, '), "props", F.lit("]"))).when(k == 2, '"text"').otherwise("{broken")
    return table(spark, sf_dir, "events").select("event_id", build.safe_section(raw).alias("section"), F.size(build.safe_list(raw)).alias("items"))


@query(f"WITH {GRAPH} SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges")
def graph_totals(spark, sf_dir):
    return writers.totals(*graph(spark, sf_dir))


@query("SELECT o_orderkey AS event_id, o_custkey FROM orders WHERE o_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderkey >= 0 ORDER BY o_orderkey LIMIT 100)")
def first_events(spark, sf_dir):
    return readers.first_events(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"), "o_custkey"), 100, "event_id")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS event_id, o_custkey FROM orders WHERE o_orderkey = 77")
def event_lookup(spark, sf_dir):
    return readers.find_event(table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("event_id"), "o_custkey"), "77")


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'leadsTo' WHEN 1 THEN 'leadsTo' WHEN 2 THEN 'causes' WHEN 3 THEN 'someNewThing' WHEN 4 THEN event_type ELSE '' END AS predicate FROM events""")
def baseline_predicates(spark, sf_dir):
    k = F.col("event_id") % 6
    raw = F.when(k == 0, "leadsTo").when(k == 1, " Results In ").when(k == 2, "CAUSED BY").when(k == 3, "Some new_thing").when(k == 4, F.upper("event_type"))
    return table(spark, sf_dir, "events").select("event_id", text.baseline_predicate(raw).alias("predicate"))


@query("""WITH e AS (SELECT o_custkey % 50 AS event_id, o_orderkey AS owner_id, CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'event_level' WHEN 2 THEN CAST(o_custkey AS VARCHAR) WHEN 3 THEN 'x' END AS source_doc_id FROM orders), d AS (SELECT c_custkey % 50 AS event_id, CAST(c_custkey AS VARCHAR) AS doc_id FROM customer WHERE c_custkey % 50 < 40)
    SELECT event_id, owner_id, source_doc_id, 'invalid document' AS problem FROM e WHERE coalesce(source_doc_id, '') IN ('', 'event_level')
    UNION ALL SELECT event_id, owner_id, source_doc_id, 'unknown document' FROM e WHERE coalesce(source_doc_id, '') NOT IN ('', 'event_level') AND event_id IN (SELECT event_id FROM d) AND NOT EXISTS (SELECT 1 FROM d WHERE d.event_id = e.event_id AND doc_id = source_doc_id)""")
def evidence_problems(spark, sf_dir):
    from loomgraph.operators import validate

    k = F.col("o_orderkey") % 5
    doc = F.when(k == 0, "").when(k == 1, "event_level").when(k == 2, F.col("o_custkey").cast("string")).when(k == 3, "x")
    proof = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("event_id"), F.col("o_orderkey").alias("owner_id"), doc.alias("source_doc_id"))
    docs = table(spark, sf_dir, "customer").filter("c_custkey % 50 < 40").select((F.col("c_custkey") % 50).alias("event_id"), F.col("c_custkey").cast("string").alias("doc_id"))
    return validate.evidence_problems(proof, docs)


@query("SELECT l_returnflag AS from_stage, l_linestatus AS to_stage, count(*) AS n FROM lineitem WHERE l_returnflag || l_linestatus IN ('AF', 'FN', 'NO') GROUP BY ALL")
def known_transitions(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("from_stage"), F.col("l_linestatus").alias("to_stage")).agg(F.count("*").alias("n"))
    return analytics.known_transitions(rows, ["A", "F", "N", "O"])


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'a b' WHEN 1 THEN 'plain' WHEN 2 THEN '[broken' ELSE NULL END AS name, CASE event_id % 2 WHEN 0 THEN 'long' ELSE 'short' END AS evidence_sentence FROM events""")
def field_variants(spark, sf_dir):
    from loomgraph.sources import providers

    k = F.col("event_id") % 4
    none = F.lit(None).cast("string")
    mention = F.when(k == 0, '["a", "", "b"]').when(k == 1, " plain ").when(k == 2, "[broken")
    x = F.struct(mention.alias("mention"), F.lit("AISystem").alias("entity_type"), none.alias("normalized_name"), F.when(k % 2 == 0, "long").alias("evidence_sentence"), F.lit("short").alias("evidence"), F.lit(0.5).alias("confidence"), F.create_map().cast("map<string,string>").alias("attributes"))
    return table(spark, sf_dir, "events").select("event_id", providers.normalized_fields(x).alias("x")).select("event_id", "x.name", "x.evidence_sentence")
