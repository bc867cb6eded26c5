"""Tables that are updated by key: rows lie in buckets of their keys, and changes are merged when they are read."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.sources.snapshots import Snapshots
from loomgraph.sources.writers import ordered_union, property_edges, property_nodes

BUCKETS, CHANGES = 64, 8


class KeyedTable(Snapshots):
    """Rows by key in buckets of a hash of the key; each batch adds change files to the buckets of its own keys alone.

    Reading puts a key's changes together in order of batches: lists are united (what is old and not new, then what is
    new), of the columns `most` the greatest stays, of others the last that is not null.  A bucket with more than
    `changes` parts is rewritten with the batch that made them so many; no other bucket is read or written.  Keys of
    a batch are different.  A replayed batch takes the place of its part; one that a rewrite holds already adds nothing new.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], lists: tuple[str, ...] = (), most: tuple[str, ...] = (), buckets: int = BUCKETS, changes: int = CHANGES) -> None:
        super().__init__(spark, path)
        self.keys, self.lists, self.most, self.buckets, self.changes = keys, lists, most, buckets, changes

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _read(self, parts: list[dict]) -> DataFrame:
        return self.spark.read.option("mergeSchema", True).parquet(*[f"{self.path}/{p['folder']}/bucket={p['bucket']}" for p in parts])

    def _merged(self, rows: DataFrame) -> DataFrame:
        """One row of each key, with the number of its last batch."""
        columns = [c for c in rows.columns if c not in (*self.keys, "_batch")]
        out = [F.max("_batch").alias("_batch")]
        for c in columns:
            if c in self.lists:
                changes = F.array_sort(F.collect_list(F.struct("_batch", F.col(c).alias("list"))))["list"]
                none = F.slice(F.first(c, ignorenulls=True), 1, 0)
                out.append(F.aggregate(changes, none, lambda a, x: ordered_union(a, x)).alias(c))
            else:
                out.append((F.max(c) if c in self.most else F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_batch")))).alias(c))
        return rows.groupBy(*self.keys).agg(*out).select(*self.keys, *columns, "_batch")

    def rows(self, of: DataFrame | None = None) -> DataFrame | None:
        """The table, or the buckets of the keys of some rows, which is all that a look-up of those reads."""
        parts = self.parts()
        if of is not None:
            wanted = {r[0] for r in of.select(self.bucket()).distinct().collect()}  # no more than there are buckets
            parts = [p for p in parts if p["bucket"] in wanted]
        return self._merged(self._read(parts)).drop("_batch") if parts else None

    def _written(self, rows: DataFrame, name: str) -> list[int]:
        """The buckets that rows were written to."""
        rows.withColumn("bucket", self.bucket()).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{name}")
        return [int(n[7:]) for n in self._names(f"{name}/bucket=*")]

    def upsert(self, batch: DataFrame, batch_id: int | None = None) -> None:
        parts = self.parts()
        number = (max((p["last"] for p in parts), default=0) + 1) if batch_id is None else batch_id + 1
        # the values of a rewritten bucket hold its batches; the same ones again change nothing but their order
        name = f"v={number}-{uuid.uuid4().hex}"
        filled = batch
        for c in self.lists:
            filled = filled.withColumn(c, F.coalesce(c, F.slice(c, 1, 0), F.array().cast(batch.schema[c].dataType)))
        touched = self._written(filled.withColumn("_batch", F.lit(number)), name)
        held = {(p["bucket"]) for p in parts if p["first"] < p["last"] and p["first"] <= number <= p["last"]}
        parts = [p for p in parts if not (p["first"] == p["last"] == number)]
        parts += [{"bucket": b, "first": number, "last": number, "folder": name} for b in touched if b not in held]
        full = {b for b in touched if sum(p["bucket"] == b for p in parts) > self.changes}
        if full:
            old = [p for p in parts if p["bucket"] in full]
            whole = f"v={number}-{uuid.uuid4().hex}"
            self._written(self._merged(self._read(old)), whole)
            parts = [p for p in parts if p["bucket"] not in full]
            for b in sorted(full):
                own = [p for p in old if p["bucket"] == b]
                parts.append({"bucket": b, "first": min(p["first"] for p in own), "last": max(p["last"] for p in own), "folder": whole})
        self._switch(sorted(parts, key=lambda p: (p["bucket"], p["first"])))


class PropertyGraph:
    """Nodes by label and key and edges by ends and type, as two keyed tables of a folder."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        self.nodes = KeyedTable(spark, f"{path.rstrip('/')}/nodes", ["label", "key"], ("event_ids", "source_doc_ids"), ("confidence",), buckets)
        self.edges = KeyedTable(spark, f"{path.rstrip('/')}/edges", ["subject", "type", "object"], (), ("confidence",), buckets)

    def write(self, nodes: DataFrame, edges: DataFrame, batch_id: int | None = None) -> None:
        """Events' graphs put into the folder; both tables are switched, nodes first."""
        self.nodes.upsert(property_nodes(nodes), batch_id)
        self.edges.upsert(property_edges(edges, nodes), batch_id)
