"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows, of a few dozen bytes each, up to which a table is broadcast to a join; a larger one is shuffled.
LIGHT = 20_000

_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only a local session without one (as in tests) gets one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _path(spark: SparkSession, url: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(url)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared one; it goes by `drop_since`, or when the application ends."""
    url = f"{shared_dir(spark)}/loomgraph/{name}-{uuid.uuid4().hex}"
    path, fs = _path(spark, url)
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    _made.append(url)
    return url


def drop(spark: SparkSession, url: str) -> None:
    path, fs = _path(spark, url)
    fs.delete(path, True)


def mark() -> int:
    """How many folders there are: what `drop_since` is given later."""
    return len(_made)


def drop_since(spark: SparkSession, begin: int) -> None:
    """Drop all folders made since; only once nothing that reads them will be evaluated any more."""
    for url in _made[begin:]:
        drop(spark, url)
    del _made[begin:]


def drop_parts(spark: SparkSession, url: str) -> None:
    """Drop what failed attempts left beside the files of a folder."""
    path, fs = _path(spark, f"{url}/*.part")
    for found in fs.globStatus(path) or []:
        fs.delete(found.getPath(), False)


def save(df: DataFrame, url: str) -> DataFrame:
    """Write a table and read it back: later steps start from files that survive a lost executor.

    Row groups are small, as several tasks of an executor write at once and each holds one in memory.
    """
    df.write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(url)
    return df.sparkSession.read.schema(df.schema).parquet(url)


def kept_dealt(df: DataFrame, key: str) -> DataFrame:
    """The table dealt out by a key and kept in the shared folder so dealt: joins on the key do not move it again.

    A checkpoint keeps how its rows were dealt only if the plan that deals them is not adaptive.
    """
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), key).checkpoint()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def light(saved: DataFrame, rows: int = LIGHT) -> DataFrame:
    """A saved table, marked for broadcast if it has no more than so many rows, else for a join whose hot keys can be split."""
    return F.broadcast(saved) if saved.count() <= rows else saved.hint("merge")


def free_name(columns: Iterable[str], name: str) -> str:
    """A column name that is not taken, whatever the case of its letters."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
