import shutil

import pytest
from pyspark.sql import functions as F
from test_graph import entities, given, reports  # noqa: F401

from loomgraph.plans import pipeline, resume


def _many(df, n):
    """A table of events repeated n times under other events, documents and ids."""
    spark, tag = df.sparkSession, F.concat(F.lit("-"), F.col("_k").cast("string"))
    rows = df.join(spark.range(n).withColumnRenamed("id", "_k"))
    for c in ("event_id", "id", "doc_id", "source_doc_id"):
        if c in rows.columns:
            rows = rows.withColumn(c, F.concat(c, tag))
    if "source_doc_ids" in rows.columns:
        rows = rows.withColumn("source_doc_ids", F.transform("source_doc_ids", lambda d: F.concat(d, tag)))
    return rows.drop("_k")


def _rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_a_run_over_a_hundred_events(spark, reports, given, tmp_path):  # noqa: F811
    reports = _many(reports, 50)
    own = lambda t: _many(t, 50) if t is not None else None
    given = pipeline.Providers(own(given.entities), own(given.slots), own(given.inferences), own(given.governance), own(given.roles), given.vectors, given.verdicts)
    store = resume.GraphStore(spark, f"file://{tmp_path}/graphs")
    assert reports.select("event_id").distinct().count() == 100
    tables, built = resume.resume(reports, given, store, strict=False)
    assert built.count() == 100
    want = {t: _rows(df) for t, df in tables.items()}
    tables, built = resume.resume(reports, given, store, strict=False)
    assert built.count() == 0 and {t: _rows(df) for t, df in tables.items()} == want

    # a lost row, a changed one and a lost table of an event
    folder = next((tmp_path / "graphs").glob("run-*"))
    nodes, edges = spark.read.parquet(f"file://{folder}/nodes"), spark.read.parquet(f"file://{folder}/edges")
    one = nodes.filter("event_id = 'e1-3'").agg(F.min("id")).first()[0]
    nodes = nodes.filter(~((F.col("event_id") == "e1-3") & (F.col("id") == one)))
    nodes.withColumn("name", F.when(F.col("event_id") == "e2-7", "else").otherwise(F.col("name"))).write.parquet(f"file://{tmp_path}/n")
    edges.filter("event_id != 'e1-20'").write.parquet(f"file://{tmp_path}/e")
    for new, old in (("n", "nodes"), ("e", "edges")):
        shutil.rmtree(folder / old)
        shutil.move(tmp_path / new, folder / old)
    tables, built = resume.resume(reports, given, store, strict=False)
    assert {r.event_id for r in built.collect()} == {"e1-3", "e2-7", "e1-20"}
    assert {t: _rows(df) for t, df in tables.items()} == want

    # a file that is no table any more: its events are built again, all others stay
    file = sorted((folder / "statements").glob("part-*.parquet"))[0]
    file.write_bytes(b"damaged")
    (folder / "statements" / f".{file.name}.crc").unlink(missing_ok=True)
    tables, built = resume.resume(reports, given, store, strict=False)
    assert built.count() > 0 and {t: _rows(df) for t, df in tables.items()} == want


def test_strict_runs_build_what_fails_today(spark, reports, given, tmp_path):  # noqa: F811
    store = resume.GraphStore(spark, f"file://{tmp_path}/graphs")
    _, built = resume.resume(reports, given, store)
    assert {r.event_id for r in built.collect()} == {"e1", "e2"}
    kept = store.read()[0]
    bad = {r.event_id for r in pipeline.violations(kept["nodes"], kept["edges"], reports).collect()}
    _, built = resume.resume(reports, given, store)
    assert bad and {r.event_id for r in built.collect()} == bad
    with pytest.raises(ValueError):
        resume.resume(reports.limit(0), given, resume.GraphStore(spark, f"file://{tmp_path}/none"))
