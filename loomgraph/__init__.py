"""A PySpark engine for event knowledge graphs and training text."""

from __future__ import annotations

import functools
import os


def attach(spark) -> None:
    """Put this package's folder on the path of the session's Python workers, which start in folders of their own.

    For scripts that call operators themselves without the package installed; before the first job.  A cluster
    that does not share the folder gets the package installed or with --py-files.
    """
    env = spark.sparkContext.environment
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def reachable(query):
    """The function (spark, ...) with the package attached to its session."""

    @functools.wraps(query)
    def run(spark, *rest):
        attach(spark)
        return query(spark, *rest)

    return run
