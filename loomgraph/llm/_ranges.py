"""Dealing documents into ranges of doc_id by quantiles over all rows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Ranges that one set of quantiles gives; more are found in two steps, by quantiles within coarse ranges.
AT_ONCE = 1000
#: Shuffle partitions; beyond so many ranges a partition takes some neighbouring ones, one after another.
PARTITIONS = 20_000
#: Up to so many bounds the range is found by an expression; beyond it, by bisection over batches.
LISTED = 256


def _bisect(bounds):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = bounds.value
        for batch in batches:
            ids = batch.column("doc_id")
            part = np.searchsorted(edges, ids.fill_null(0).to_numpy(zero_copy_only=False), side="right")
            part[ids.is_null().to_numpy(zero_copy_only=False)] = 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part.astype(np.int32))], names=[*batch.schema.names, "part"])

    return run


def _quantiles(n: int):
    return F.percentile_approx("doc_id", [i / n for i in range(1, n)], 20 * n)


def _dealt(documents: DataFrame, bounds: np.ndarray) -> DataFrame:
    if len(bounds) > LISTED:
        schema = T.StructType([*documents.schema.fields, T.StructField("part", T.IntegerType())])
        return documents.mapInArrow(_bisect(documents.sparkSession.sparkContext.broadcast(bounds)), schema)
    part = F.lit(0)
    if len(bounds):
        edges = F.array(*[F.lit(int(b)).cast("long") for b in bounds])
        part = F.when(F.col("doc_id").isNull(), 0).otherwise(F.size(F.filter(edges, lambda e: e <= F.col("doc_id"))))
    return documents.withColumn("part", part.cast("int"))


def with_range(documents: DataFrame, range_bytes: int, at_once: int = AT_ONCE) -> tuple[DataFrame, int]:
    """(the documents with `part`, the number of parts): ranges of doc_id, a long, of about `range_bytes` of text each.

    A null id is in the first.  Equal ids share a range.  The size of a range does not grow with the input:
    only their number does, and the bounds (8 bytes a range) are all that the driver holds.
    """
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(size // range_bytes + 1)
    coarse = n if n <= at_once else math.isqrt(n - 1) + 1
    bounds = sorted(set(documents.agg(_quantiles(coarse)).first()[0] or [])) if n > 1 else []
    if coarse < n:
        fine = -(-n // coarse)
        ids = _dealt(documents.select("doc_id"), np.array(bounds, np.int64))
        inner = ids.groupBy("part").agg(_quantiles(fine).alias("q")).select(F.explode("q").alias("q")).toArrow().column("q").to_numpy()
        bounds = np.unique(np.concatenate([np.array(bounds, np.int64), inner[~np.isnan(inner)].astype(np.int64) if inner.dtype.kind == "f" else inner]))
    bounds = np.array(bounds, np.int64)
    return _dealt(documents, bounds), len(bounds) + 1


def partitioned(rows: DataFrame, column: str, parts: int, partitions: int = PARTITIONS) -> DataFrame:
    """The rows dealt by range: a partition for each, or for some neighbouring ones; the caller sorts within."""
    n = min(parts, partitions)
    where = F.col(column) if n == parts else F.floor(F.col(column).cast("long") * n / parts).cast("int")
    return rows.repartitionById(n, where)
