"""Search-quality evaluation and table checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.functions.text import strip


def evaluate_queries(hits: DataFrame, relevant: DataFrame, k: int = 10, variant: str = "reference") -> DataFrame:
    """(query_id, recall, ndcg) of labelled queries.

    ``hits``: query_id, position, title. ``relevant``: query_id, title. Recall counts distinct
    relevant titles among the first k hits. nDCG takes every hit whose title is relevant.
    ``reference`` discounts by 1/rank and takes the ideal order of the retrieved hits only;
    ``standard`` discounts by 1/log2(rank+1) against an ideal list of all relevant titles.
    """
    labels = relevant.select("query_id", strip(F.col("title")).alias("title")).distinct()
    labelled = labels.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_relevant"))
    shown = hits.filter(F.col("position") <= k).select("query_id", "position", strip(F.coalesce("title", F.lit(""))).alias("title"))
    judged = shown.join(labels.withColumn("rel", F.lit(1)), ["query_id", "title"], "left").fillna(0, ["rel"])
    if variant == "reference":
        gain = F.col("rel") / F.col("position")
    else:
        gain = F.col("rel") / F.log2(F.col("position") + 1.0)
    sums = judged.groupBy("query_id").agg(
        F.sum(gain).alias("dcg"),
        F.sum("rel").alias("n_rel_hits"),
        F.countDistinct(F.when(F.col("rel") == 1, F.col("title"))).alias("n_hit_titles"),
    )
    ideal_n = F.col("n_rel_hits") if variant == "reference" else F.least(F.col("n_relevant"), F.lit(k).cast("bigint"))
    discount = (lambda i: 1.0 / i) if variant == "reference" else (lambda i: 1.0 / F.log2(i + 1.0))
    ideal = F.when(
        ideal_n > 0,
        F.aggregate(F.sequence(F.lit(1).cast("bigint"), ideal_n), F.lit(0.0), lambda s, i: s + discount(i)),
    )
    joined = labelled.join(sums, "query_id", "left").fillna(0, ["n_rel_hits", "n_hit_titles"]).fillna(0.0, ["dcg"])
    return joined.select(
        "query_id",
        (F.col("n_hit_titles") / F.col("n_relevant")).alias("recall"),
        F.coalesce(F.col("dcg") / ideal, F.lit(0.0)).alias("ndcg"),
    )


def evaluation_means(per_query: DataFrame) -> DataFrame:
    return per_query.agg(
        F.count(F.lit(1)).alias("queries_evaluated"),
        F.round(F.coalesce(F.avg("recall"), F.lit(0.0)), 3).alias("recall_mean"),
        F.round(F.coalesce(F.avg("ndcg"), F.lit(0.0)), 3).alias("ndcg_mean"),
    )


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, e.g. (version_id, page_no) of pages."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def wrong_dimension(embeddings: DataFrame, dim: int) -> DataFrame:
    return embeddings.filter(F.col("embedding").isNotNull() & (F.size("embedding") != dim))
