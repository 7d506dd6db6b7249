"""Enrichment merges: analyses, tags, OCR text, vectors, statuses."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.constants import TAG_CATEGORIES
from pagelake.functions.scalar import percent
from pagelake.functions.text import analysis_of, is_blank, markdown_of, tokens
from pagelake.operators.changes import one_per_key

Embedder = Callable[[pd.Series], pd.Series]


def normalize_analyses(replies: DataFrame) -> DataFrame:
    """(slide_id, summary, analysis, status) from model replies (slide_id, raw)."""
    parsed = replies.withColumn("analysis", analysis_of(F.col("raw")))
    return parsed.select(
        "slide_id",
        F.col("analysis.summary").alias("summary"),
        "analysis",
        F.when(F.col("analysis").isNotNull(), "success").otherwise("failed").alias("status"),
    )


def apply_summaries(slides: DataFrame, analyses: DataFrame) -> DataFrame:
    """Sets ai_summary and ai_status of analysed pages; a failed run keeps the old summary. A page's last run counts."""
    runs = one_per_key(analyses, ["slide_id"]).select("slide_id", F.col("summary").alias("_summary"), F.col("status").alias("_status"))
    return (
        slides.join(runs, "slide_id", "left")
        .withColumn("ai_summary", F.when(F.col("_status") == "success", F.col("_summary")).otherwise(F.col("ai_summary")))
        .withColumn("ai_status", F.coalesce("_status", "ai_status"))
        .drop("_summary", "_status")
    )


def analysis_tags(analyses: DataFrame) -> DataFrame:
    """(slide_id, position, category, name, confidence): tags named by successful analyses."""
    def named(position: int, category: str, field: str):
        entry = lambda v: F.struct(F.lit(position).alias("position"), F.lit(category).alias("category"), v.alias("name"))
        return F.transform(F.col(f"analysis.{field}"), entry)

    entries = F.concat(*[named(n, category, field) for n, (category, field) in enumerate(TAG_CATEGORIES)])
    return (
        analyses.filter(F.col("status") == "success")
        .select("slide_id", F.col("analysis.confidence").alias("confidence"), F.explode_outer(entries).alias("e"))
        .select("slide_id", "e.*", "confidence")
        .filter(F.coalesce("name", F.lit("")) != "")
    )


def new_tags(named: DataFrame, tags: DataFrame) -> DataFrame:
    """Tags to create: names not known yet, with the category of their first mention."""
    first = named.groupBy("name").agg(F.min(F.struct("position", "slide_id", "category")).alias("f"))
    return first.join(tags.select("name"), "name", "left_anti").select(
        F.concat(F.lit("tag-"), F.col("name")).alias("tag_id"),
        "name",
        F.col("f.category").alias("category"),
        F.lit("ai").alias("source"),
        F.lit("active").alias("status"),
    )


def merge_ai_tags(analyses: DataFrame, tags: DataFrame, slide_tags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tags, slide_tags) after a tagging run.

    Of several successful runs of a page the last one counts (by ``at`` where there is one), as it replaces what the others
    left. Unconfirmed model tags of re-run pages go first; then each named tag is added where the page
    does not carry it yet. Manual and confirmed tags are never touched.
    """
    analyses = one_per_key(analyses.filter(F.col("status") == "success"), ["slide_id"])
    named = analysis_tags(analyses)
    all_tags = tags.unionByName(new_tags(named, tags))
    rerun = analyses.select("slide_id")
    stale = slide_tags.filter((F.col("origin") == "ai") & ~F.col("is_confirmed")).join(rerun, "slide_id", "left_semi")
    kept = slide_tags.join(stale.select("slide_id", "tag_id", "origin"), ["slide_id", "tag_id", "origin"], "left_anti")
    wanted = (
        named.groupBy("slide_id", "name").agg(F.max("confidence").alias("confidence"))
        .join(all_tags.select("name", "tag_id"), "name")
        .join(kept.select("slide_id", "tag_id"), ["slide_id", "tag_id"], "left_anti")
        .select("slide_id", "tag_id", F.lit("ai").alias("origin"), "confidence", F.lit(False).alias("is_confirmed"))
    )
    return all_tags, kept.unionByName(wanted)


def ocr_markdown(results: DataFrame, key: str = "slide_id") -> DataFrame:
    """(key, markdown) from raw OCR replies; blank when nothing was read."""
    return results.select(key, markdown_of(F.col("raw")).alias("markdown"))


def merge_ocr_text(slides: DataFrame, results: DataFrame) -> DataFrame:
    """Fills mineru_markdown of pages whose reply holds text; others keep theirs. native_text stays. A page's last reply counts."""
    read = ocr_markdown(one_per_key(results, ["slide_id"])).withColumnRenamed("markdown", "_md")
    filled = F.coalesce(F.nullif(F.col("_md"), F.lit("")), F.col("mineru_markdown"))
    return slides.join(read, "slide_id", "left").withColumn("mineru_markdown", filled).drop("_md")


def merge_element_ocr(elements: DataFrame, results: DataFrame) -> DataFrame:
    """Text and tokens of picture elements without a text; blank replies leave an empty text and no tokens. An element's last reply counts."""
    read = one_per_key(results, ["slide_id", "element_index"]).select("slide_id", "element_index", markdown_of(F.col("raw")).alias("_md"))
    open_picture = (
        (F.col("element_type") == "picture") & (F.coalesce("text", F.lit("")) == "") & F.col("_md").isNotNull()
    )
    read_now = elements.join(read, ["slide_id", "element_index"], "left").withColumn("_open", open_picture)
    filled = read_now.withColumn("text", F.when(F.col("_open"), F.col("_md")).otherwise(F.col("text")))
    if "tokens" in elements.columns:
        filled = filled.withColumn("tokens", F.when(F.col("_open"), tokens(F.col("text"))).otherwise(F.col("tokens")))
    return filled.select(*elements.columns)


def enrichment_progress(slides: DataFrame) -> DataFrame:
    """Pages with OCR text per version, in whole percent."""
    done = F.sum(F.when(~is_blank(F.col("mineru_markdown")), 1).otherwise(0))
    return slides.groupBy("version_id").agg(percent(done, F.count(F.lit(1))).alias("progress"))


# --- vectors --------------------------------------------------------------------------------


#: Words that ``hashed_bag`` hashes at once, and texts it holds vectors of; a longer text is hashed on its own.
BAG_WORDS = 1 << 17
BAG_TEXTS = 1 << 12


def hashed_bag(dim: int = 64) -> Embedder:
    """A deterministic stand-in for a model: signed feature hashing of the words."""

    def vectors(bags: list[list[str]]) -> list[list[float]]:
        words = np.array(list(chain.from_iterable(bags)), dtype=object)
        owner = np.repeat(np.arange(len(bags)), [len(bag) for bag in bags])
        h = pd.util.hash_array(words)
        sign = np.where((h >> np.uint64(32)) & np.uint64(1), 1.0, -1.0)
        place = owner * dim + (h % np.uint64(dim)).astype(np.int64)
        sums = np.bincount(place, weights=sign, minlength=len(bags) * dim).reshape(-1, dim)
        norms = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        return np.round(sums / np.maximum(norms, 1e-12), 7).tolist()

    def embed(texts: pd.Series) -> pd.Series:
        rows, bags, n = [], [], 0
        for text in texts:
            bag = text.lower().split() if text else []
            if bags and (n + len(bag) > BAG_WORDS or len(bags) == BAG_TEXTS):
                rows += vectors(bags)
                bags, n = [], 0
            bags.append(bag)
            n += len(bag)
        return pd.Series(rows + vectors(bags) if bags else rows)

    return embed


def embedding_work(indexed: DataFrame, embeddings: DataFrame, model: str) -> DataFrame:
    """(slide_id, text, source_hash): non-blank texts whose current hash has no successful vector yet."""
    todo = indexed.select("slide_id", F.col("index_text").alias("text")).withColumn(
        "source_hash", F.sha2(F.coalesce("text", F.lit("")), 256)
    )
    done = embeddings.filter((F.col("model") == model) & (F.col("status") == "success")).select("slide_id", "source_hash")
    return todo.join(done, ["slide_id", "source_hash"], "left_anti")


def build_embeddings(indexed: DataFrame, embeddings: DataFrame, model: str, embedder: Embedder) -> DataFrame:
    """New rows (slide_id, model, source_hash, status, embedding) for pages whose text changed.

    Blank texts give status EMPTY_TEXT and no vector, texts that the embedder has no vector for status failed; such a page
    is tried again next time.
    """
    work = embedding_work(indexed, embeddings, model)
    blank = is_blank(F.col("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame(
                {"slide_id": pdf["slide_id"], "source_hash": pdf["source_hash"], "embedding": embedder(pdf["text"])}
            )

    made = work.filter(~blank).mapInPandas(run, "slide_id bigint, source_hash string, embedding array<float>")
    status = F.when(F.coalesce(F.size("embedding") > 0, F.lit(False)), "success").otherwise("failed")
    done = made.select("slide_id", F.lit(model).alias("model"), "source_hash", status.alias("status"), F.when(status == "success", F.col("embedding")).alias("embedding"))
    empty = work.filter(blank).select(
        "slide_id", F.lit(model).alias("model"), "source_hash", F.lit("EMPTY_TEXT").alias("status"),
        F.lit(None).cast("array<float>").alias("embedding"),
    )
    return done.unionByName(empty)


def merge_embeddings(embeddings: DataFrame, made: DataFrame) -> DataFrame:
    """Replaces the (slide, model) rows that have a new successful vector; failures leave the old vector."""
    good = made.filter(F.col("status") == "success")
    return embeddings.join(good.select("slide_id", "model"), ["slide_id", "model"], "left_anti").unionByName(good)


def build_element_embeddings(elements: DataFrame, embedder: Embedder) -> DataFrame:
    """(slide_id, element_index, embedding_status, embedding) of elements that bear text."""
    texts = elements.filter(~is_blank(F.col("text"))).select("slide_id", "element_index", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            vectors = embedder(pdf["text"])
            status = ["success" if v is not None else "failed" for v in vectors]
            yield pd.DataFrame(
                {"slide_id": pdf["slide_id"], "element_index": pdf["element_index"], "embedding_status": status, "embedding": vectors}
            )

    return texts.mapInPandas(run, "slide_id bigint, element_index int, embedding_status string, embedding array<float>")


# --- statuses -------------------------------------------------------------------------------


def readiness(slides: DataFrame, embeddings: DataFrame, analyses: DataFrame) -> DataFrame:
    """(version_id, pages, embedded, analysed): distinct pages with a good vector and a good analysis."""
    emb = embeddings.filter(F.col("status") == "success").select("slide_id").distinct().withColumn("_e", F.lit(1))
    ana = analyses.filter(F.col("status") == "success").select("slide_id").distinct().withColumn("_a", F.lit(1))
    return (
        slides.select("slide_id", "version_id").join(emb, "slide_id", "left").join(ana, "slide_id", "left")
        .groupBy("version_id")
        .agg(F.count(F.lit(1)).alias("pages"), F.count("_e").alias("embedded"), F.count("_a").alias("analysed"))
    )


def promote_status(versions: DataFrame, ready: DataFrame, rendered: DataFrame | None = None, enriched: DataFrame | None = None) -> DataFrame:
    """Moves versions forward: rendered, then enriched, then READY when every page is complete.

    Each move happens only from the statuses that may take it. ``rendered`` and ``enriched`` hold
    the version_id of versions whose stage has finished.
    """
    status = F.col("status")
    df = versions
    if rendered is not None:
        df = df.join(rendered.select("version_id").distinct().withColumn("_r", F.lit(True)), "version_id", "left")
        status = F.when(F.col("_r") & status.isin("RENDERING", "PARSED", "UPLOADING"), "BASIC_READY").otherwise(status)
    if enriched is not None:
        df = df.join(enriched.select("version_id").distinct().withColumn("_n", F.lit(True)), "version_id", "left")
        status = F.when(F.col("_n") & status.isin("BASIC_READY", "RENDERING", "PARSED"), "ENRICHED").otherwise(status)
    df = df.join(ready, "version_id", "left")
    complete = (F.col("pages") > 0) & (F.col("embedded") >= F.col("pages")) & (F.col("analysed") >= F.col("pages"))
    status = F.when(F.coalesce(complete, F.lit(False)), "READY").otherwise(status)
    return df.withColumn("status", status).select(*versions.columns)


