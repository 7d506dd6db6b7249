"""Part reachability and structure checks over package tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.constants import STRUCTURAL_PREFIXES
from pagelake.functions.scalar import rels_part, resolved_part
from pagelake.session import cut, scratch_path


def is_structural(part: Column) -> Column:
    hit = F.lit(False)
    for prefix in STRUCTURAL_PREFIXES:
        hit = hit | part.startswith(prefix) | (part == prefix.rstrip("/"))
    return hit


def part_edges(relationships: DataFrame, parts: DataFrame) -> DataFrame:
    """(file_id, part, next): internal relationships whose target is present."""
    resolved = relationships.filter(F.coalesce("target_mode", F.lit("Internal")) != "External").select(
        "file_id", "part", resolved_part(F.col("target"), F.col("part")).alias("next")
    )
    there = parts.select("file_id", F.col("part").alias("next"))
    return resolved.join(there, ["file_id", "next"], "left_semi").distinct()


def part_closure(roots: DataFrame, relationships: DataFrame, parts: DataFrame) -> DataFrame:
    """(file_id, root, part): parts each root page needs, itself included.

    A frontier join per relationship step; parts already reached are left out, so cycles end and
    the last frontier is empty. Rounds follow the depth of the relationship graph, not its size.
    Each round writes its frontier only, all rounds below one folder that is read as a whole.
    """
    spark = roots.sparkSession
    edges = cut(part_edges(relationships, parts))
    base, rounds = scratch_path(spark, "closure"), []

    def written(rows: DataFrame) -> DataFrame:
        rounds.append(f"{base}/round={len(rounds)}")
        rows.write.parquet(rounds[-1])
        return spark.read.schema(rows.schema).parquet(rounds[-1])

    first = roots.select("file_id", F.col("part").alias("root"), "part").distinct()
    frontier = written(first)
    while not frontier.isEmpty():
        step = frontier.join(edges, ["file_id", "part"]).select("file_id", "root", F.col("next").alias("part")).distinct()
        reached = spark.read.schema(first.schema).parquet(*rounds)
        frontier = written(step.join(reached, ["file_id", "root", "part"], "left_anti"))
    return spark.read.schema(first.schema).parquet(*rounds)


def kept_parts(roots: DataFrame, relationships: DataFrame, parts: DataFrame) -> DataFrame:
    """(file_id, root, part, bytes): all parts of a single-page package.

    The closure, the structural parts, and the relationship files of kept parts.
    """
    closure = part_closure(roots, relationships, parts)
    shared = roots.select("file_id", F.col("part").alias("root")).join(
        parts.filter(is_structural(F.col("part"))).select("file_id", "part"), "file_id"
    )
    core = closure.unionByName(shared).distinct()
    rels = core.select("file_id", "root", rels_part(F.col("part")).alias("part")).join(
        parts.select("file_id", "part"), ["file_id", "part"], "left_semi"
    )
    every = core.unionByName(rels.select("file_id", "root", "part")).distinct()
    return every.join(parts.select("file_id", "part", "bytes"), ["file_id", "part"]).select("file_id", "root", "part", "bytes")


def page_weights(kept: DataFrame) -> DataFrame:
    return kept.groupBy("file_id", "root").agg(F.count(F.lit(1)).alias("n_parts"), F.sum("bytes").alias("bytes"))


def orphan_parts(kept: DataFrame, parts: DataFrame) -> DataFrame:
    """Parts no page of the file needs."""
    return parts.join(kept.select("file_id", "part").distinct(), ["file_id", "part"], "left_anti")


def structure_check(files: DataFrame, slide_refs: DataFrame, declared: DataFrame, parts: DataFrame) -> DataFrame:
    """(file_id, n_slides, dangling, bad_xml, passed) of single-page packages.

    ``slide_refs``: one row per page listed in the presentation part. ``declared``: parts named
    by the content type list. ``parts``: present parts with ``xml_ok`` (null for non-XML parts).
    A package passes with exactly one page, no missing declared part and only readable XML.
    """
    pages = slide_refs.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_slides"))
    missing = (
        declared.select("file_id", "part").distinct().join(parts.select("file_id", "part"), ["file_id", "part"], "left_anti")
        .groupBy("file_id").agg(F.count(F.lit(1)).alias("dangling"))
    )
    broken = parts.filter(~F.col("xml_ok")).groupBy("file_id").agg(F.count(F.lit(1)).alias("bad_xml"))
    df = files.select("file_id").join(pages, "file_id", "left").join(missing, "file_id", "left").join(broken, "file_id", "left")
    df = df.fillna(0, ["n_slides", "dangling", "bad_xml"])
    return df.withColumn("passed", (F.col("n_slides") == 1) & (F.col("dangling") == 0) & (F.col("bad_xml") == 0))
