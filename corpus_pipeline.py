"""The training-corpus pipeline: stages of the ten operators over `documents`, each written and reread.

quality (documents scored below the threshold go), near duplicates (one document of each class stays),
decontamination (documents that hold a benchmark window go), secrets (spans are replaced by a mark), and
packing (which gives the sequences of token ids to train on, not the documents).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph import reachable
from loomgraph.llm import _store, dartminhash, decontam, packing, quality, secrets


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier keeps; it learns from labelled documents outside the held-out fold."""
    return quality.keep_good(docs, _table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: that of the least doc_id."""
    return dartminhash.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without any window of the benchmark."""
    return decontam.remove_documents(docs, _table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret."""
    return secrets.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences: bin_id, capacity, doc_ids, ids, and the pieces of documents they hold."""
    return packing.sequences(docs).select("bin_id", "capacity", F.transform("pieces", lambda p: p["doc_id"]).alias("doc_ids"), "ids", "pieces")


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]
STAGES = [(name, reachable(stage)) for name, stage in STAGES]

#: SQL expresses neither the classifier nor the signatures; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again.

    What a stage was made from goes once its own rows are written.
    """
    folder = _store.new_folder(spark, "pipeline")
    docs, before = _table(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES):
        url, begin = f"{folder}/{i}-{name}", _store.mark()
        docs = _store.save(stage(spark, docs, sf_dir), url)
        _store.drop_since(spark, begin)
        if before:
            _store.drop(spark, before)
        before = url
    return docs
