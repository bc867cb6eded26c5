"""Reading cases, events, subgraphs, annotations, caches and configuration files into DataFrames."""

from __future__ import annotations

import copy
import json
import os
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import clean_web_page, nz
from loomgraph.functions.vocab import CLASS_ALIASES, CLASSES

CASE = (
    "id string, original_id string, title string, title_en string, title_cn string, text string, text_en string, text_cn string, translated_text string, "
    "new_summary string, description string, summary string, summary_en string, summary_cn string, from_database string, source string, source_name string, "
    "case_link string, from_url string, url string, release_date string, publish_time string, language string"
)
EVIDENCE = "struct<evidence_id:string,evidence_sentence:string,source_doc_id:string,mention_span:struct<text:string,start:int,end:int>,confidence:double>"
NODE = f"struct<id:string,name:string,entity_type:string,description:string,evidence:array<{EVIDENCE}>,extraction_mode:string,confidence:double,support_count:int,source_doc_ids:array<string>,attributes:map<string,string>,reasoning:string>"
EDGE = f"struct<id:string,subject_id:string,subject_name:string,predicate:string,object_id:string,object_name:string,evidence:array<{EVIDENCE}>,extraction_mode:string,confidence:double,support_count:int,source_doc_ids:array<string>,reasoning:string>"
STATEMENT = f"struct<id:string,subject_id:string,predicate:string,object_id:string,evidence:{EVIDENCE},extraction_mode:string,confidence:double,support_count:int>"
SUBGRAPH = f"event_id string, report_count int, first_seen string, last_seen string, support_statistics map<string,int>, incident_node {NODE}, nodes array<{NODE}>, edges array<{EDGE}>, knowledge_statements array<{STATEMENT}>"


def first_filled(*names: str) -> Column:
    """The first of several columns that is neither NULL nor empty."""
    return F.coalesce(*[nz(F.col(n)) for n in names])


def last_of(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """The last row of each key."""
    latest = Window.partitionBy(key).orderBy(*[c.desc() for c in order])
    return rows.withColumn("_n", F.row_number().over(latest)).filter("_n = 1").drop("_n")


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines by case_id (id, else original_id); of cases with one id the last in the files stays."""
    rows = spark.read.schema(CASE).json(require(spark, path)).withColumns({"_file": F.col("_metadata.file_path"), "_at": F.monotonically_increasing_id()})
    named = rows.withColumn("case_id", first_filled("id", "original_id")).filter("case_id is not null")
    return last_of(named, "case_id", F.col("_at")).drop("_file", "_at")


def read_case_map(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object from keys to cases; English where both languages are there."""
    fields = "struct<doc_id:string,event_id:string,title_en:string,title_cn:string,text_en:string,text_cn:string,summary_en:string,summary_cn:string,source_name:string>"
    text = spark.read.text(require(spark, path), wholetext=True).select(F.from_json("value", f"map<string,{fields}>").alias("m"))
    rows = text.select(F.explode("m").alias("key", "c")).select("key", "c.*")
    return rows.select(
        F.coalesce(nz(F.col("doc_id")), "key").alias("case_id"), first_filled("title_en", "title_cn").alias("title"), first_filled("text_en", "text_cn").alias("text"),
        first_filled("summary_en", "summary_cn").alias("summary"), "source_name", F.when(nz(F.col("text_en")).isNotNull(), "en").otherwise("zh").alias("language"),
    )


def require(spark: SparkSession, path: str) -> str:
    """The path, if anything is there; otherwise FileNotFoundError."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where):
        raise FileNotFoundError(path)
    return path


def read_ontology(spark: SparkSession, path: str) -> DataFrame:
    """(predicate, domain, range) of a file with `relations`: predicate to lists `domain` and `range`; JSON, or YAML where a parser is there.

    Classes are known ones or aliases, whatever their case; others are left out.  A relation without a list allows none.
    """
    text = "\n".join(r.value for r in spark.read.text(require(spark, path), wholetext=True).collect())  # a file of one ontology
    try:
        found = json.loads(text)
    except ValueError:
        try:
            import yaml
        except ImportError as e:
            raise ValueError(f"{path} is not JSON, and there is no parser of YAML") from e
        found = yaml.safe_load(text)
    known = {c.lower(): c for c in CLASSES}

    def classes(names: list | None) -> list[str]:
        low = [str(n).strip().lower() for n in names or []]
        return list(dict.fromkeys(c for c in (CLASS_ALIASES.get(n) or known.get(n) for n in low) if c))

    relations = (found or {}).get("relations") or {}
    rows = [(p, classes((r or {}).get("domain")), classes((r or {}).get("range"))) for p, r in relations.items()]
    return spark.createDataFrame(rows, "predicate string, domain array<string>, range array<string>")


def load_docs(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, content) of JSON lines: the translated text where there is one; of documents of one id the last in the files stays."""
    rows = spark.read.schema("case_id string, id string, translated_text string, text string").json(require(spark, path)).withColumn("_at", F.monotonically_increasing_id())
    named = rows.withColumn("doc_id", first_filled("case_id", "id")).filter("doc_id is not null")
    return last_of(named, "doc_id", F.col("_at")).select("doc_id", F.coalesce(first_filled("translated_text", "text"), F.lit("")).alias("content"))


def find_event(events: DataFrame, event_id: str) -> DataFrame:
    """The first event of this id; none if there is none."""
    return events.filter(F.col("event_id") == event_id).limit(1)


def first_events(events: DataFrame, most: int | None, pos: str = "pos") -> DataFrame:
    """The first events in order, as many as a run may take; all without a number."""
    return events if most is None else events.orderBy(pos, "event_id").limit(most)


def load_config(path: str, defaults: dict | None = None) -> Config:
    """A configuration file of JSON, or of YAML where its library is there; a missing file leaves the defaults."""
    if not os.path.exists(path):
        return Config({}, defaults)
    with open(path, encoding="utf-8") as f:
        raw = f.read()
    if path.endswith(".json"):
        return Config(json.loads(raw), defaults)
    import yaml

    return Config(yaml.safe_load(raw) or {}, defaults)


DATASETS = {"all": "events", "gold": "gold_standard", "eval500": "events"}


def read_events(spark: SparkSession, path: str, dataset: str = "all") -> DataFrame:
    """(event_id, case_ids) of a dataset; an unknown one is an error."""
    if dataset not in DATASETS:
        raise ValueError(f"unknown dataset {dataset!r}; known: {', '.join(DATASETS)}")
    entry = "array<struct<incident_id:string,event_id:string,ids:array<string>,labeling_cases:array<string>>>"
    rows = spark.read.schema(f"events {entry}, gold_standard {entry}").option("multiLine", True).json(require(spark, path))
    key = DATASETS[dataset]
    return rows.select(F.explode(F.coalesce(key, "events", "gold_standard")).alias("e")).select(first_filled("e.incident_id", "e.event_id").alias("event_id"), F.coalesce("e.ids", "e.labeling_cases").alias("case_ids"))


def documents_of(events: DataFrame, cases: DataFrame) -> DataFrame:
    """The reports of each event in order; cases that are not there are left out."""
    wanted = events.select("event_id", F.posexplode("case_ids").alias("pos", "case_id"))
    c = {n: first_filled(*[x for x in names if x in cases.columns]) for n, names in {
        "title": ("title", "title_en", "title_cn"), "content": ("text", "text_en", "new_summary", "description"), "summary": ("summary", "new_summary", "summary_en", "summary_cn"),
        "source_name": ("from_database", "source", "source_name"), "url": ("case_link", "from_url", "url"), "publish_time": ("release_date", "publish_time"),
    }.items() if any(x in cases.columns for x in names)}
    english = F.lit(False)
    if "from_database" in cases.columns:
        english = english | (F.col("from_database") == "aiid")
    if "text_en" in cases.columns:
        english = english | nz(F.col("text_en")).isNotNull()
    own = nz(F.col("language")) if "language" in cases.columns else F.lit(None)
    rows = wanted.join(cases, "case_id").select("event_id", "pos", F.col("case_id").alias("doc_id"), *[e.alias(n) for n, e in c.items()], F.coalesce(own, F.when(F.coalesce(english, F.lit(False)), "en").otherwise("zh")).alias("language"))
    return rows.withColumn("content", clean_web_page(F.col("content"), F.col("title")))


def read_subgraphs(spark: SparkSession, pattern: str) -> DataFrame:
    """Event graphs from one JSON file each; the event is named by its folder, damaged files are left out."""
    rows = spark.read.schema(SUBGRAPH).option("multiLine", True).option("mode", "DROPMALFORMED").json(pattern).filter("event_id is not null")
    return rows.withColumn("event_id", F.coalesce(nz(F.regexp_extract(F.col("_metadata.file_path"), r"pred_([^/]+)/", 1)), "event_id"))


def flatten_subgraphs(graphs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, statements) as rows."""
    nodes = graphs.select("event_id", F.posexplode("nodes").alias("pos", "x")).select("event_id", "pos", "x.*")
    edges = graphs.select("event_id", F.posexplode("edges").alias("pos", "x")).select("event_id", "pos", "x.*")
    told = graphs.select("event_id", F.explode("knowledge_statements").alias("x")).select("event_id", "x.*")
    return nodes, edges, told


def read_annotations(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """Arrays of tasks from several JSON files, as rows."""
    return spark.read.schema(schema).option("multiLine", True).json(pattern)


def latest_choice(annotations: DataFrame) -> DataFrame:
    """(val_id, choice): the newest annotation that was not cancelled; several annotators are an error.

    Of annotations of one time the later row counts.
    """
    live = annotations.filter(~F.coalesce("was_cancelled", F.lit(False)))
    many = live.agg(F.countDistinct("completed_by").alias("n")).first()["n"]
    if many > 1:
        raise ValueError(f"{many} annotators in one export")
    return last_of(live, "val_id", F.col("updated_at"), F.col("pos")).select("val_id", "choice")


def finished(cache: DataFrame, key: str = "event_id", order: str = "pos") -> DataFrame:
    """The last record of each event, without those that failed."""
    return last_of(cache, key, F.col(order)).filter("error is null").drop(order)


def pending(work: DataFrame, cache: DataFrame, key: str = "event_id", order: str = "pos") -> DataFrame:
    """The work whose last record is missing or failed."""
    return work.join(finished(cache, key, order).select(key), key, "left_anti")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def gold_ids(events: DataFrame) -> DataFrame:
    return events.select("event_id").filter("event_id is not null and event_id != ''").distinct().orderBy("event_id")


class Config:
    """Defaults under a file's values, with ${NAME:default} taken from the environment; dotted look-up."""

    def __init__(self, values: dict, defaults: dict | None = None) -> None:
        self.values = self._resolved(self._merged(copy.deepcopy(defaults or {}), values))

    @classmethod
    def _merged(cls, base: dict, over: dict) -> dict:
        for k, v in over.items():
            base[k] = cls._merged(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v
        return base

    @classmethod
    def _resolved(cls, value):
        if isinstance(value, dict):
            return {k: cls._resolved(v) for k, v in value.items()}
        if isinstance(value, list):
            return [cls._resolved(v) for v in value]
        m = re.fullmatch(r"\$\{(\w+)(?::([^}]*))?\}", value) if isinstance(value, str) else None
        if not m:
            return value
        text = os.environ.get(m[1], m[2] or "")
        for kind in (int, float):
            try:
                return kind(text)
            except ValueError:
                pass
        return {"true": True, "false": False}.get(text.lower(), text)

    def get(self, path: str, default=None):
        at = self.values
        for part in path.split("."):
            if not isinstance(at, dict) or part not in at:
                return default
            at = at[part]
        return at


#: Experiment variants: which stages a run leaves out.
VARIANTS = {
    "full": {},
    "no_ontology": {"ontology": False},
    "no_agg": {"aggregation": False},
    "no_evidence": {"evidence": False},
    "no_inference": {"inference": False},
}


def experiment(variant: str) -> dict[str, bool]:
    if variant not in VARIANTS:
        raise ValueError(f"unknown variant {variant!r}")
    return {"ontology": True, "aggregation": True, "evidence": True, "inference": True} | VARIANTS[variant]
