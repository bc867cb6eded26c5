"""Registered queries of the core engine and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomgraph.plans import catalog, eval_catalog, graph_catalog, run_catalog  # noqa: F401  (the others add their queries to the first)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k.rstrip("_"): v for k, v in catalog.QUERIES.items()}
ORACLES: dict[str, str] = {k.rstrip("_"): v for k, v in catalog.ORACLES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports grouped into events, with the events' metadata and strategy."""
    return catalog.event_metadata(spark, sf_dir)
