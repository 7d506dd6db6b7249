"""Element extraction, index text and token tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.functions.text import joined_parts, strip, table_text, tokens


def extract_elements(slides: DataFrame) -> DataFrame:
    """Text boxes, then tables, then pictures of each page's ``content``; empty ones are skipped.

    Runs inside one row: arrays are built and exploded, nothing is shuffled.
    """
    none = F.lit(None).cast("string")
    no_place = F.lit(None).cast("struct<x:bigint,y:bigint,cx:bigint,cy:bigint>")

    def element(kind, text, rid=none, target=none, position=no_place):
        return F.struct(
            kind.alias("element_type"),
            text.alias("text"),
            rid.alias("image_rid"),
            target.alias("image_target"),
            position.alias("image_position"),
        )

    kind_of = lambda s: F.coalesce(s["type"], F.lit("textbox"))
    boxes = F.transform(F.col("content.shapes"), lambda s: element(kind_of(s), strip(s["text"])))
    tables = F.transform(F.col("content.tables"), lambda t: element(F.lit("table"), table_text(F.array(t))))
    pictures = F.transform(
        F.col("content.pictures"), lambda p: element(F.lit("picture"), none, p["rid"], p["target"], p["position"])
    )
    with_text = lambda e: e["text"].isNotNull() & (e["text"] != "")
    with_target = lambda e: e["image_target"].isNotNull() & (e["image_target"] != "")
    blank = F.array().cast(
        "array<struct<element_type:string,text:string,image_rid:string,image_target:string,"
        "image_position:struct<x:bigint,y:bigint,cx:bigint,cy:bigint>>>"
    )
    every = F.concat(
        F.coalesce(F.filter(boxes, with_text), blank),
        F.coalesce(F.filter(tables, with_text), blank),
        F.coalesce(F.filter(pictures, with_target), blank),
    )
    unrolled = slides.select("slide_id", "version_id", F.posexplode_outer(every).alias("element_index", "e"))
    return unrolled.filter(F.col("element_index").isNotNull()).select("slide_id", "version_id", "element_index", "e.*")


def ai_tag_text(slide_tags: DataFrame, tags: DataFrame) -> DataFrame:
    """(slide_id, ai_tags): names of a page's model tags, sorted and joined by a space."""
    names = (
        slide_tags.filter(F.col("origin") == "ai")
        .join(tags.select("tag_id", "name"), "tag_id")
        .filter(F.col("name") != "")
        .select("slide_id", "name")
    )
    return names.groupBy("slide_id").agg(F.array_join(F.sort_array(F.collect_list("name")), " ").alias("ai_tags"))


def index_text(slides: DataFrame, ai_tags: DataFrame | None = None, with_title: bool = True) -> DataFrame:
    """Adds ``index_text``: title, text, notes, table cells, summary, model tags, file title.

    ``slides`` needs title, native_text, notes_text, content, ai_summary and, for the file
    title, presentation_title.
    """
    df = slides if ai_tags is None else slides.join(ai_tags, "slide_id", "left")
    parts = [
        F.col("title"),
        F.col("native_text"),
        F.col("notes_text"),
        table_text(F.col("content.tables")),
        F.col("ai_summary"),
    ]
    if ai_tags is not None:
        parts.append(F.col("ai_tags"))
    if with_title:
        parts.append(F.col("presentation_title"))
    return df.withColumn("index_text", joined_parts(*parts))


def token_index(df: DataFrame, text: str = "index_text", words: Iterable[str] | None = None) -> DataFrame:
    """Adds ``tokens`` and ``n_tokens``: the searchable form of a page or element. ``words``: a user's dictionary."""
    return df.withColumn("tokens", tokens(F.col(text), words)).withColumn("n_tokens", F.size("tokens"))


def postings(index: DataFrame, doc: str = "slide_id") -> DataFrame:
    """(token, doc, tf): one row per distinct token of a page."""
    return (
        index.select(doc, F.explode_outer("tokens").alias("token"))
        .filter(F.col("token").isNotNull())
        .groupBy("token", doc)
        .agg(F.count(F.lit(1)).cast("int").alias("tf"))
    )


def clustered_postings(index: DataFrame, keys: list[str]) -> DataFrame:
    """(token, *keys, n_tokens, tf), laid out by token, so that a search reads the files of its words.

    ``index`` needs tokens, n_tokens and ``keys`` (page or element, version).
    """
    flat = index.select(*keys, "n_tokens", F.explode_outer("tokens").alias("token")).filter(F.col("token").isNotNull())
    counted = flat.groupBy(*keys, "n_tokens", "token").agg(F.count(F.lit(1)).alias("tf"))
    return counted.repartitionByRange("token", *keys).sortWithinPartitions("token", *keys)


def index_totals(index: DataFrame) -> DataFrame:
    """One row (n_docs, avg_tokens)."""
    return index.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("n_tokens").alias("avg_tokens"))


def reindex(slides: DataFrame, slide_tags: DataFrame, tags: DataFrame) -> DataFrame:
    """Index rows of scoped pages plus ``needs_vector``: pages whose summary feeds the vector."""
    indexed = token_index(index_text(slides, ai_tag_text(slide_tags, tags)))
    return indexed.withColumn("needs_vector", F.coalesce(F.col("ai_summary") != "", F.lit(False)))


def reindex_totals(index: DataFrame) -> DataFrame:
    return index.agg(
        F.count(F.lit(1)).alias("total"),
        F.count("index_text").alias("reindexed"),
        F.coalesce(F.sum(F.col("needs_vector").cast("bigint")), F.lit(0)).alias("to_embed"),
    )

