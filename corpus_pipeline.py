"""The corpus pipeline: stages in order, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir) and works on all rows of ``docs``. All but the last return the
columns of ``documents``. Nulls, empty texts, repeated rows, empty tables and further columns are
treated as the operators state; further columns of ``docs`` pass through.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.llm import best_fit_packing, jaccard_join, quality_crf, substring_dedup, toxicity_knn
from pagelake.llm.tables import table, tokenizer_path
from pagelake.session import release, scratch_path

#: Characters of a plan's description that the driver keeps; it keeps those of a thousand executions.
PLAN_TEXT = 20_000


def _lean(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that begins with a driver freed of what earlier ones left, and whose plans are kept with short descriptions."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark)
        before = spark.conf.get("spark.sql.maxPlanStringLength")
        spark.conf.set("spark.sql.maxPlanStringLength", str(PLAN_TEXT))
        try:
            return stage(spark, docs, sf_dir)
        finally:
            spark.conf.set("spark.sql.maxPlanStringLength", before)

    return run_stage


@_lean
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose lines are content for the most part and that pass the plain rules."""
    return quality_crf.keep_good(docs, quality_crf.train(docs, table(spark, sf_dir, "labels")))


@_lean
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that score below one half."""
    return toxicity_knn.keep_clean(docs, toxicity_knn.train(docs, table(spark, sf_dir, "labels")))


@_lean
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least id in each group of near copies."""
    return jaccard_join.keep_first(docs)


@_lean
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes passages out of texts that a document of smaller id has too; ``n_chars`` follows."""
    return substring_dedup.without_repeats(docs).withColumn("n_chars", F.char_length("text").cast("bigint"))


@_lean
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences."""
    return best_fit_packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("packing", packing),
]

#: Several stages learn models or search, which SQL does not express; tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them goes to the folder all executors share."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        path = scratch_path(spark, f"pipeline-{i}-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
