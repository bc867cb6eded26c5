"""Runs that go on where an earlier one stopped: graphs kept by event, checked again when they are read."""

from __future__ import annotations

import json
import uuid
from dataclasses import fields, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.operators.rounds import settle
from loomgraph.plans import pipeline
from loomgraph.sources.snapshots import Snapshots

TABLES = ("nodes", "edges", "statements")
#: Events that are built and kept at once.
BATCH = 10_000


def _digests(tables: dict[str, DataFrame]) -> DataFrame:
    """(event_id, digest): the rows of an event's tables, whatever their order."""
    rows = [tables[t].select("event_id", F.xxhash64(F.lit(t), F.to_json(F.struct(*sorted(tables[t].columns)))).cast("decimal(38,0)").alias("h")) for t in TABLES]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).groupBy("event_id").agg(F.concat_ws("-", F.count("*").cast("string"), F.sum("h").cast("string")).alias("digest"))


class GraphStore(Snapshots):
    """Graphs of events in a folder: each commit is a part with the tables of some events and a record of each event.

    A record holds the digest of the event's rows as they were written.  Of an event the latest part counts.
    """

    OWN = ("run-*",)

    def commit(self, tables: dict[str, DataFrame], events: DataFrame) -> None:
        """The graphs of `events` (event_id), among them such as have no rows."""
        parts, name = self.parts(), f"run-{uuid.uuid4().hex}"
        for t in TABLES:
            tables[t].write.parquet(f"{self.path}/{name}/{t}")
        schemas = {t: tables[t].schema.json() for t in TABLES}
        part = {"folder": name, "number": max((p["number"] for p in parts), default=0) + 1, "schemas": schemas}
        written = {t: self._table(part, t) for t in TABLES}
        records = events.select("event_id").distinct().join(_digests(written), "event_id", "left").withColumn("digest", F.coalesce("digest", F.lit("")))
        records.write.parquet(f"{self.path}/{name}/records")
        self._switch([*parts, part])

    def _table(self, part: dict, name: str) -> DataFrame:
        """A part's table; damaged and missing files are left out, which the digests of their events tell."""
        schema = T.StructType([T.StructField("event_id", T.StringType()), T.StructField("digest", T.StringType())]) if name == "records" else T.StructType.fromJson(json.loads(part["schemas"][name]))
        return self.spark.read.schema(schema).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).parquet(f"{self.path}/{part['folder']}/{name}")

    def read(self) -> tuple[dict[str, DataFrame], DataFrame] | None:
        """(tables, events) of the graphs that are as they were written; None if nothing was kept yet."""
        parts = self.parts()
        if not parts:
            return None
        numbered = lambda name: [self._table(p, name).withColumn("_run", F.lit(p["number"])) for p in parts]
        union = lambda tables: tables[0] if len(tables) == 1 else union([tables[0].unionByName(tables[1], allowMissingColumns=True), *tables[2:]])
        latest = settle(union(numbered("records")).groupBy("event_id").agg(F.max("_run").alias("_run"), F.max_by("digest", "_run").alias("digest")))
        own = {t: union(numbered(t)).join(latest.select("event_id", "_run"), ["event_id", "_run"]).drop("_run") for t in TABLES}
        sound = latest.join(_digests(own).withColumnRenamed("digest", "_now"), "event_id", "left").filter(F.col("digest") == F.coalesce("_now", F.lit(""))).select("event_id")
        sound = settle(sound)
        return {t: own[t].join(sound, "event_id", "left_semi") for t in TABLES}, sound


def _of(given: pipeline.Providers, events: DataFrame) -> pipeline.Providers:
    """What the providers give for some events."""
    own = lambda df: df.join(events, "event_id", "left_semi") if isinstance(df, DataFrame) and "event_id" in df.columns else df
    return replace(given, **{f.name: own(getattr(given, f.name)) for f in fields(given)})


def resume(reports: DataFrame, given: pipeline.Providers, store: GraphStore, strict: bool = True, force: bool = False, batch: int = BATCH) -> tuple[dict[str, DataFrame], DataFrame]:
    """(nodes, edges, statements of all events with reports; the events that were built now).

    A kept graph is taken over if its rows are as they were written and, where `strict`, if it passes today's
    validation; all others are built and kept, some events at a time, so that a run that stops loses the last of
    these alone.  With `force` all are built.
    """
    events = reports.select("event_id").distinct()
    kept = None if force else store.read()
    todo = events
    if kept is not None:
        tables, sound = kept
        if strict:
            broken = pipeline.violations(tables["nodes"], tables["edges"], reports).select("event_id").distinct()
            sound = sound.join(broken, "event_id", "left_anti")
        todo = events.join(sound, "event_id", "left_anti")
    todo = settle(todo)
    groups = -(-todo.count() // batch)
    for n in range(groups):
        some = todo.filter(F.pmod(F.xxhash64("event_id"), F.lit(groups)) == n)
        made = pipeline.run_events(reports.join(some, "event_id", "left_semi"), _of(given, some))
        store.commit(made, some)
    final = store.read()
    if final is None:
        raise ValueError("there are no reports and nothing is kept")
    return {t: rows.join(events, "event_id", "left_semi") for t, rows in final[0].items()}, todo
