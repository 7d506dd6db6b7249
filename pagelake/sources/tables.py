"""Keyed table writes and small input files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.session import stored

BUCKETS = 256


def replace_by_key(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The table with all rows of the incoming keys replaced."""
    return table.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows, allowMissingColumns=True)


def bucket(key: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def write_table(df: DataFrame, path: str, key: str = "version_id", mode: str = "overwrite", buckets: int = BUCKETS) -> None:
    """Parquet partitioned by key bucket; mode overwrite replaces the keys that ``df`` holds, no others.

    Only buckets of these keys are written; their rows of other keys are read first, kept beside the
    table and written back with the new ones.
    """
    rows = df.withColumn("bucket", bucket(F.col(key), buckets))
    if mode == "overwrite":
        rows = stored(rows, "table-rows")
        try:
            present = df.sparkSession.read.parquet(path)
        except AnalysisException as missing:
            if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
        else:
            touched = present.join(F.broadcast(rows.select("bucket").distinct()), "bucket", "left_semi")
            others = touched.join(rows.select(key).distinct(), key, "left_anti")
            rows = stored(rows.unionByName(others, allowMissingColumns=True), "table-rows")
    (
        rows.write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("bucket")
        .parquet(path)
    )


def append_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Writes one batch of a batch-logged table; a retried batch overwrites itself."""
    (
        df.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("batch_id")
        .parquet(path)
    )


def latest_batch(table: DataFrame, key: str | list[str]) -> DataFrame:
    """Rows of each key's last batch: replace-by-key resolved while reading."""
    keys = [key] if isinstance(key, str) else key
    last = table.groupBy(*keys).agg(F.max("batch_id").alias("batch_id"))
    return table.join(last, [*keys, "batch_id"], "left_semi").drop("batch_id")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Shuffles an input whose few files would leave most cores idle; larger inputs stay as they lie."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() * 2 > cores:
        return df
    return df.repartition(cores, key)


def read_query_set(spark: SparkSession, path: str) -> DataFrame:
    """Labelled queries: a JSON array of {id, query, relevant_titles, type}."""
    schema = "id bigint, query string, relevant_titles array<string>, type string"
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def labelled_titles(query_set: DataFrame) -> DataFrame:
    return query_set.select(F.col("id").alias("query_id"), F.explode("relevant_titles").alias("title"))


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Domain words: lines 'word freq pos', '#' starts a comment."""
    fields = F.split(F.trim("value"), r"\s+")
    return (
        spark.read.text(path)
        .filter((F.trim("value") != "") & ~F.col("value").startswith("#"))
        .select(
            fields.getItem(0).alias("word"),
            F.try_element_at(fields, F.lit(2)).cast("bigint").alias("freq"),
            F.try_element_at(fields, F.lit(3)).alias("pos"),
        )
    )
