"""Corpus pipeline: language ID, n-gram Jaccard join, substring dedup, benchmark decontamination, mixing.

Every stage takes the documents its predecessor kept and is written as
Parquet before the next one reads it. So the intermediate tables of a stage are
deleted when another stage is called. The stages set the session's
``SETTINGS``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillage.llm import langid
from tillage.llm.decontam import benchmark_matches
from tillage.llm.mixing import mix
from tillage.llm.ngram_join import jaccard_components
from tillage.llm.substring import remove_repeated_passages
from tillage.llm.tables import dropped, packed, recorded, text_mod, written

LEAST_LANGUAGE_SCORE = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised: not ``und`` and a score of at least 0.5; so null texts and texts without letters go.

    Repeated rows and null ids are rows of their own; an empty table stays empty; other columns come back as they are.

    The model learns from the labelled documents of its input but every third by crc32 of the id."""
    model = langid.train(docs.where(text_mod(F.col("doc_id"), 3) != 1))
    text, row, back = packed(docs, "text", ())
    told = langid.predict(docs.select(text, row), model)
    return told.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select(*back)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class linked by five-word-shingle Jaccard >= 0.8: that of the least id, and of several rows with that
    id the one of least text hash. Texts without words stay, all of them. Null ids come after all others."""
    text, row, back = packed(docs, "text", ())
    found = jaccard_components(docs.select("doc_id", text, row), k=5, percent=80)
    one = found.where("component is null or doc_id <=> component_id").withColumn(
        "alone", F.when(F.col("component").isNull(), F.monotonically_increasing_id()))
    place = F.row_number().over(Window.partitionBy("component", "alone").orderBy(F.xxhash64("text")))
    return one.withColumn("place", place).where("place = 1").select(*back)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that recur; documents of which nothing is left go. Other texts stay as they are, null and empty ones, too.

    Repeated rows lose what they share; other columns come back as they are, but ``n_chars`` of a cut text is its new length."""
    text, row, back = packed(docs, "text", ())
    found = remove_repeated_passages(docs.select(text, row))
    same = F.col("n_removed") == 0
    new = {"text": F.when(same, F.col("text")).otherwise(F.col("kept_text")),
           "n_chars": F.when(same, F.col("row.n_chars")).otherwise(F.length("kept_text").cast("long"))}
    return found.where("n_removed = 0 or n_removed < n_words").select(*[new.get(c, old).alias(c) for c, old in zip(docs.columns, back)])


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; null and empty texts hold none. Rows are told by id and text, so repeated ids don't matter."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    words = F.sha2(F.col("text").cast("binary"), 256)  # ids may be null or repeat: rows are told by id and text
    told = docs.select("doc_id", words.alias("words"), "text")
    leaks = written(benchmark_matches(told, benchmark).select(F.col("doc_id").alias("leak"), F.col("words").alias("leaked")).distinct())
    return docs.join(leaks, docs["doc_id"].eqNullSafe(leaks["leak"]) & (words == leaks["leaked"]), "left_anti")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with ``copies`` (how often), sizes and targets. Null sources are one source, null texts have no words."""
    text, row, back = packed(docs, "text", ())
    return mix(docs.select("doc_id", "source", text, row)).where("copies > 0").select(*back, "size", "source_size", "target", "copies", "taken")


SETTINGS = {
    # Documents are kilobytes long: a task's Arrow batch holds a few MB of them, not the usual 10,000 rows.
    "spark.sql.execution.arrow.maxRecordsPerBatch": 1000,
    # Every shuffle serves one query, so its files go with it.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": True,
}

_behind: dict[str, tuple[str, list[str]]] = {}


def _freeing(name: str, stage):
    """The stage; the tables that another stage wrote before it are deleted first (by application: the last stage and its tables)."""
    def call(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for key, value in SETTINGS.items():
            spark.conf.set(key, value)
        app = spark.sparkContext.applicationId
        last, paths = _behind.pop(app, (name, []))
        if last != name:
            dropped(spark, paths)
            paths = []
        with recorded() as mine:
            out = stage(spark, docs, sf_dir)
        _behind[app] = (name, paths + mine)
        return out
    return call


STAGES = [(name, _freeing(name, stage)) for name, stage in (
    ("language ID", language_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("substring dedup", substring_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mixing_stage),
)]

# Learned models, automata and hashed ranks: SQL cannot express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs


QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
