"""Registered queries: every operator over the driver tables, with plain result columns."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable
from functools import wraps

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake import constants as c
from pagelake.functions import scalar, segment, text
from pagelake.operators import dedup, enrich, fusion, indexing, jobs, library, packages, quality, recall, versions
from pagelake.operators.scope import any_tag, favorites_of, scoped_slides, text_bearing
from pagelake.plans.views import MOVED, Views
from pagelake.session import scratch_path, stored
from pagelake.sources import bulk, files, snapshots, tables
from pagelake.sources import packages as source_packages
from pagelake.sources.tables import replace_by_key
from pagelake.streaming import ingest
from pagelake.streaming import jobs as job_stream

USER = 0
LETTERS = "abcdefghijklmnopqrstuvwxyz"
IDEOGRAPHS = "".join(chr(0x4E00 + i) for i in range(len(LETTERS)))
TAGS = ["tag-quality", "tag-toxic", "tag-fr"]

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(Views(spark, sf_dir))

    _QUERIES[fn.__name__] = run
    return fn


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def _flat(hits: DataFrame) -> DataFrame:
    return hits.select(
        "query_id", "position", "slide_id", "presentation_id", "page_no", "score", "text_rank", "vector_rank",
        "element_text_rank", "element_vector_rank", F.array_join("hit_reasons", "|").alias("hit_reasons"),
    )


# --- functions and scope --------------------------------------------------------------------


@query
def fingerprint(v):
    return v.slides.select("slide_id", "fingerprint")


@query
def index_text(v):
    pages = v.scoped(superuser=True)
    indexed = indexing.index_text(pages, indexing.ai_tag_text(v.slide_tags, v.tags))
    return indexed.select("slide_id", F.sha2("index_text", 256).alias("text_hash"), F.length("index_text").cast("bigint").alias("n_chars"))


@query
def tokens_postings(v):
    index = indexing.token_index(v.scoped(superuser=True), "native_text")
    return indexing.postings(index).select("token", "slide_id", F.col("tf").cast("bigint").alias("tf"))


@query
def corpus_totals(v):
    totals = indexing.index_totals(v.page_index(USER))
    return totals.select("n_docs", F.round("avg_tokens", 6).alias("avg_tokens"))


@query
def index_build(v):
    """What the kept page index holds per version."""
    held = v.page_search.postings.groupBy("version_id").agg(F.count(F.lit(1)).alias("n_postings"))
    return v.page_search.totals.join(held, "version_id").select("version_id", "n_docs", "n_tokens", "n_postings")


@query
def element_index_build(v):
    held = v.element_search.postings.groupBy("version_id").agg(F.count(F.lit(1)).alias("n_postings"))
    return v.element_search.totals.join(held, "version_id", "left").select("version_id", "n_docs", "n_tokens", "n_postings")


@query
def segmented_words(v):
    """Passages written in ideographs, one for each letter and without blanks, cut with their own words as the dictionary file."""
    ideographs = lambda c: F.translate(F.lower(c), LETTERS, IDEOGRAPHS)
    passages = v.table("benchmark")
    words = passages.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{2,}"), F.lit(0))).alias("word")).groupBy("word").count()
    path = scratch_path(v.spark, "dictionary")
    words.select(F.concat_ws(" ", ideographs(F.col("word")), F.col("count").cast("string"), F.lit("n"))).write.text(path)
    known = segment.frequencies(tables.read_dictionary(v.spark, path))
    run = ideographs(F.regexp_replace("text", "[^A-Za-z]", ""))
    cut = passages.select("item_id", segment.best_path_tokens(run, known).alias("tokens"))
    return cut.select("item_id", F.size("tokens").cast("bigint").alias("n_tokens"), F.sha2(F.array_join("tokens", " "), 256).alias("tokens_hash"))


@query
def reindex_all(v):
    index = indexing.reindex(v.scoped(superuser=True), v.slide_tags, v.tags)
    return indexing.reindex_totals(index)


@query
def scoped_slides_user(v):
    return v.scoped(USER).select("slide_id", "version_id", "presentation_id", "presentation_title")


@query
def scoped_slides_historical(v):
    return v.scoped(USER, include_historical=True).select("slide_id", "version_id", "presentation_id", "presentation_title")


@query
def tagged_slides(v):
    return any_tag(v.scoped(USER).select("slide_id", "page_no"), v.slide_tags, TAGS)


@query
def favorite_slides(v):
    pages = v.scoped(superuser=True).select("slide_id", "title")
    return pages.join(favorites_of(v.favorites, USER), "slide_id", "left_semi")


@query
def text_bearing_slides(v):
    return text_bearing(v.slides).groupBy("version_id").agg(F.count(F.lit(1)).alias("n"))


@query
def vector_distances(v):
    """Each page's vector against its source's first page vector, by column functions."""
    vectors = v.slide_embeddings.select("slide_id", "embedding", "label")
    first = vectors.groupBy("label").agg(F.min_by("embedding", "slide_id").alias("head"))
    quantised = scalar.quantised(F.col("embedding"))
    return vectors.join(first, "label").select(
        "slide_id",
        F.round(scalar.cosine_distance(F.col("embedding"), F.col("head")), 6).alias("distance"),
        F.element_at(quantised, 1).alias("first_value"),
    )


# --- library --------------------------------------------------------------------------------


@query
def library_list(v):
    listed = library.library_list(v.presentations, v.versions, v.users, v.jobs, user_id=USER, sort="page_count", title="DECK")
    return listed.select(
        "presentation_id", "title", "owner_name", "current_status", "status_group", "progress", "stage", "page_count"
    )


@query
def browse_pages(v):
    shown = library.browse_pages(v.directory, v.presentations, v.versions, user_id=USER, page=2, page_size=48)
    return shown.select("slide_id", "presentation_id", "page_no")


@query
def browse_pages_deep(v):
    """A screen a third of the way into the caller's pages; the counts tell which it is."""
    shown = library.scoped_page_count(v.directory, v.presentations, v.versions, user_id=USER)
    deep = library.browse_pages(v.directory, v.presentations, v.versions, user_id=USER, page=shown // 3 // 48 + 1, page_size=48)
    return deep.select("position", "slide_id", "presentation_id", "page_no")


@query
def presentation_versions_nested(v):
    nested = library.versions_nested(v.presentations, v.versions)
    entry = lambda x: F.concat_ws(":", x["version_no"].cast("string"), x["version_id"].cast("string"), x["status"])
    return nested.select("presentation_id", F.array_join(F.transform("versions", entry), ",").alias("versions"))


@query
def extract_elements(v):
    return v.elements.select(
        "slide_id", F.col("element_index").cast("bigint").alias("element_index"), "element_type",
        F.md5(F.col("text").cast("binary")).alias("text_hash"), "image_target",
    )


@query
def picture_parts(v):
    pictures = v.elements.filter(F.col("element_type") == "picture")
    part = scalar.image_part(F.col("image_target"))
    return pictures.select(
        "slide_id", part.alias("part"), scalar.resolved_part(F.col("image_target"), F.lit("ppt/slides/slide1.xml")).alias("resolved")
    )


@query
def recent_slides(v):
    return fusion.recent_slides(v.scoped(USER)).select("slide_id", "presentation_id", "page_no")


@query
def favorites_list(v):
    pages = v.slides.select("slide_id", "page_no", "title")
    return library.favorites_list(v.favorites, pages, USER).select("slide_id", "page_no", "title")


# --- recall and fusion ----------------------------------------------------------------------


@query
def text_recall(v):
    return recall.text_recall(v.queries, v.page_search, v.scope(USER))


@query
def element_text_recall(v):
    return recall.element_text_recall(v.queries, v.element_search, v.scope(USER))


def _scope_pages(v):
    return v.scoped(USER).select("slide_id")


@query
def vector_recall(v):
    return recall.vector_recall(v.queries, v.slide_embeddings, v.scope(USER).select("version_id"))


@query
def vector_recall_postfilter(v):
    return recall.vector_recall(v.queries, v.slide_embeddings, _scope_pages(v), filter_first=False)


@query
def element_vector_recall(v):
    return recall.element_vector_recall(v.queries, v.element_embeddings, v.scope(USER).select("version_id"))


@query
def rrf_fuse(v):
    lists = fusion.recall_lists(v.queries, v.corpus(), USER)
    fused = fusion.rrf_fuse(lists)
    return fused.select(
        "query_id", "slide_id", F.round("score", 6).alias("score"), "text_rank", "vector_rank", "element_text_rank", "element_vector_rank"
    )


@query
def hybrid_search(v):
    return _flat(fusion.hybrid_search(v.queries, v.corpus(), user_id=USER, favorite_user_id=USER))


@query
def hybrid_historical(v):
    corpus = v.corpus()
    return _flat(fusion.hybrid_search(v.queries, corpus, superuser=True, include_historical=True, filter_first=False))


@query
def hybrid_tag_boost(v):
    return _flat(fusion.hybrid_search(v.queries, v.corpus(), user_id=USER, tag_ids=TAGS))


@query
def hybrid_favorites(v):
    return _flat(fusion.hybrid_search(v.queries, v.corpus(), user_id=USER, favorite_user_id=USER, favorite_only=True))


@query
def hybrid_filter_only(v):
    blank = v.queries.withColumn("query", F.lit("  "))
    return _flat(fusion.hybrid_search(blank, v.corpus(), user_id=USER, tag_ids=TAGS, favorite_user_id=USER))


@query
def search_sorted_page(v):
    hits = fusion.hybrid_search(v.queries, v.corpus(), user_id=USER, topn=20)
    return fusion.page_of(fusion.resorted(hits, "title"), 2, 10, "sorted_position").select("query_id", "sorted_position", "slide_id")


@query
def search_by_presentation(v):
    hits = fusion.hybrid_search(v.queries, v.corpus(), user_id=USER, topn=40)
    grouped = fusion.search_by_presentation(hits, 1, 20)
    pages = F.array_join(F.transform("slides", lambda s: s["slide_id"].cast("string")), ",")
    return grouped.select("query_id", "presentation_id", "file_rank", "n_hits", pages.alias("slide_ids"))


@query
def tag_facets(v):
    hits = fusion.hybrid_search(v.queries, v.corpus(), user_id=USER, topn=c.FACET_DEPTH)
    return fusion.tag_facets(hits, v.slide_tags, v.tags)


@query
def compose_match(v):
    """An outline of every query; each seventh item has no section, each fifth no query."""
    item = F.col("query_id")
    asked = v.queries.withColumn("query", F.when(item % 5 == 4, F.lit(" ")).otherwise(F.col("query")))
    outline = asked.select(item.alias("item_no"), F.when(item % 7 == 0, F.lit(" ")).otherwise(F.concat(F.lit("part "), item.cast("string"))).alias("section"), "query")
    named = asked.filter(~text.is_blank(F.col("query")))
    best = fusion.hybrid_search(named, v.corpus(), user_id=USER, topn=1)
    return fusion.compose_match(outline, best).select("item_no", "section", "slide_id", "presentation_title", "page_no", "score", "matched")


@query
def compose_totals(v):
    item = F.col("query_id")
    outline = v.queries.select(item.alias("item_no"), F.concat(F.lit("part "), item.cast("string")).alias("section"), "query")
    best = fusion.hybrid_search(v.queries, v.corpus(), user_id=USER, topn=1)
    return fusion.compose_totals(fusion.compose_match(outline, best))


# --- duplicates -----------------------------------------------------------------------------


def _signed_scope(v):
    """Key columns and signatures of the scope, each computed once."""
    pages = v.scoped(USER)
    columns = ("slide_id", "version_id", "page_no", "title", "native_text", "fingerprint", "presentation_id", "presentation_title")
    signed = stored(dedup.signature64(pages).select("slide_id", "sig"), "signatures")
    return pages.select(*columns), signed


@query
def signatures(v):
    return dedup.signature64(v.scoped(USER)).select("slide_id", "signature")


@query
def duplicate_exact(v):
    pages = v.scoped(USER)
    groups = dedup.exact_groups(pages)
    return text_bearing(pages).select("slide_id", "fingerprint").join(groups, "fingerprint").select("slide_id", "group_id", "group_size")


@query
def duplicate_similar_pairs(v):
    _, signed = _signed_scope(v)
    found = dedup.similar_signature_pairs(signed)
    pair = [F.least("slide_a", "slide_b").alias("slide_a"), F.greatest("slide_a", "slide_b").alias("slide_b")]
    return found.select(*pair, "distance")


@query
def duplicate_clusters(v):
    _, signed = _signed_scope(v)
    return dedup.similar_clusters(signed)


@query
def duplicate_groups(v):
    pages, signed = _signed_scope(v)
    groups = dedup.duplicate_groups(pages, signed).orderBy(*dedup.listing_order())
    return groups.select("slide_id", "kind", "group_id", "group_size", "distance", "page_no", "presentation_title")


@query
def duplicate_summary(v):
    pages, signed = _signed_scope(v)
    return dedup.duplicate_summary(dedup.duplicate_groups(pages, signed))


@query
def similar_slides(v):
    pages, signed = _signed_scope(v)
    return dedup.similar_slides(pages, pages, signed)


# --- versions -------------------------------------------------------------------------------


def _old_pages(v):
    return v.page_keys.filter(F.col("version_id") % 2 == 1)


@query
def suggest_versions(v):
    found = versions.suggest_versions(_old_pages(v), v.page_keys, v.presentations)
    return found.select("version_id", "presentation_id", "title", "similarity", "page_count")


@query
def version_jaccard(v):
    pairs = versions.previous_versions(v.versions).select(F.col("from_version_id").alias("left_id"), F.col("to_version_id").alias("right_id"))
    sets = versions.version_fingerprints(v.page_keys)
    return versions.jaccard(sets, sets, pairs).select("left_id", "right_id", "n_common", F.round("jaccard", 6).alias("jaccard"))


@query
def previous_version(v):
    return versions.previous_versions(v.versions)


@query
def match_versions_exact(v):
    return versions.match_exact(versions.previous_versions(v.versions), v.page_keys)


def _matches(v):
    return versions.match_versions(versions.previous_versions(v.versions), v.signed_slides)


@query
def match_versions(v):
    return _matches(v)


@query
def version_diff_summary(v):
    return versions.version_diff(_matches(v))


@query
def file_dedup(v):
    """All uploads, and the benchmark passages as further ones, against the English uploads kept so far; copies among the new ones meet their first."""
    english = v.documents.filter(F.col("lang") == "en").select(F.col("doc_id").alias("file_id"))
    known = v.files.join(english, "file_id", "left_semi").select(
        F.col("file_id").alias("version_id"), "presentation_id", "sha256", F.col("arrived_at").alias("created_at")
    )
    more = v.table("benchmark").select((-F.col("item_id") - 1).alias("file_id"), F.sha2("text", 256).alias("sha256"))
    incoming = v.files.select("file_id", "sha256").unionByName(more)
    return versions.file_dedup(incoming, known, v.presentations).select(
        "file_id", "is_duplicate", "first_file_id", "existing_version_id", "existing_presentation_id"
    )


@query
def sha_precheck(v):
    known = v.files.select("presentation_id", "sha256")
    hashes = v.table("benchmark").select(F.sha2("text", 256).alias("sha256")).unionByName(v.files.select("sha256")).distinct()
    return versions.sha_precheck(hashes, known, v.presentations).select("sha256", "exists", "presentation_id", "presentation_title")


@query
def assign_versions(v):
    """Every upload becomes a new version of its file; each eleventh one comes without a parent."""
    parent = F.when(F.col("file_id") % 11 != 0, F.col("presentation_id"))
    incoming = v.files.select("file_id", parent.alias("parent_presentation_id"))
    return versions.assign_versions(incoming, v.versions, v.presentations)


# --- ingest ---------------------------------------------------------------------------------


@query
def detect_format(v):
    """Leading bytes of packages, of raw texts, and of texts behind PDF and OLE2 marks."""
    magic = F.element_at(F.array(F.lit(""), F.lit(c.PDF_MAGIC), F.lit(c.OLE2_MAGIC), F.lit(c.PPTX_MAGIC)), (F.col("doc_id") % 4 + 1).cast("int"))
    content = F.concat(F.unhex(magic), F.col("text").cast("binary"))
    return v.documents.select("doc_id", files.detect_format(content).alias("format"))


@query
def validate_sources(v):
    """Packages and broken relatives of them, one per document."""
    doc = F.col("file_id")
    base = v.packages
    content = (
        F.when(doc % 6 == 1, F.substring(F.col("content"), F.lit(1), F.greatest((F.length("content") / 2).cast("int"), F.lit(1))))
        .when(doc % 6 == 2, F.concat(F.unhex(F.lit(c.PDF_MAGIC)), F.col("content"), F.lit("\n%%EOF\n").cast("binary")))
        .when(doc % 6 == 3, F.unhex(F.lit(c.OLE2_MAGIC)))
        .when(doc % 6 == 4, F.lit("").cast("binary"))
        .otherwise(F.col("content"))
    )
    name = F.concat(F.lit("f"), doc.cast("string"), F.when(doc % 6 == 5, ".key").when(doc % 6 == 2, ".PDF").when(doc % 6 == 3, ".ppt").otherwise(".pptx"))
    incoming = base.select("file_id", name.alias("filename"), content.alias("content"))
    return files.validate_files(incoming, extensions=(".pptx", ".ppt", ".pdf"))


@query
def parse_packages(v):
    """Packages, some of them cut off in the middle and some that are archives of another kind."""
    other = io.BytesIO()
    with zipfile.ZipFile(other, "w") as archive:
        archive.writestr("word/document.xml", "<document/>")
    half = F.substring(F.col("content"), F.lit(1), (F.length("content") / 2).cast("int"))
    spoiled = F.when(F.col("file_id") % 17 == 3, half).when(F.col("file_id") % 17 == 5, F.lit(other.getvalue())).otherwise(F.col("content"))
    parsed = source_packages.parse_packages(v.packages.withColumn("content", spoiled))
    return parsed.select(
        "file_id", "parse_status", "page_no", F.md5(F.col("title").cast("binary")).alias("title_hash"), F.sha2("native_text", 256).alias("text_hash"), "notes_text",
        F.size("content.shapes").cast("bigint").alias("n_shapes"), F.size(text.table_cells(F.col("content.tables"))).cast("bigint").alias("n_cells"),
        F.size("content.pictures").cast("bigint").alias("n_pictures"), F.size("content.relationships").cast("bigint").alias("n_rels"),
    )


def _package_tables(v):
    parts = stored(source_packages.package_parts(v.packages), "package-parts")
    facts = stored(source_packages.part_facts(parts), "part-facts")
    rels = source_packages.part_relationships(facts)
    return parts, facts, rels, source_packages.slide_order(facts, rels)


@query
def part_closure(v):
    parts, _, rels, order = _package_tables(v)
    kept = packages.kept_parts(order, rels, parts.select("file_id", "part", "bytes"))
    return packages.page_weights(kept).select("file_id", F.col("root").alias("page_part"), "n_parts")


@query
def structure_check(v):
    parts, facts, _, order = _package_tables(v)
    present = parts.select("file_id", "part").join(facts.select("file_id", "part", "xml_ok"), ["file_id", "part"], "left")
    checked = packages.structure_check(v.documents.select(F.col("doc_id").alias("file_id")), order, source_packages.declared_parts(facts), present)
    return checked.select("file_id", "n_slides", "dangling", "bad_xml", "passed")


@query
def placeholder_pages(v):
    """Presentations seen as rendered files; versions that have pages already get none."""
    rendered = v.presentations.select(F.explode(F.array(F.col("presentation_id") * 2 + 1, F.col("presentation_id") * 2 + 1 + 1000)).alias("version_id"), "page_count")
    return files.placeholder_slides(rendered, v.slides).select("version_id", "page_no", "parse_status")


@query
def replace_pages(v):
    """Current pages replaced by their old forms' versions, as a re-parse would."""
    pages = v.slides.select("slide_id", "version_id", "page_no", "fingerprint")
    again = pages.filter(F.col("version_id") % 3 == 0).withColumn("fingerprint", F.sha2("fingerprint", 256))
    return replace_by_key(pages, again, ["version_id"])


@query
def snapshot_merges(v):
    """Two merges into a snapshot table: all pages, then a re-parse of some versions; read back as of both."""
    pages = v.page_keys
    again = pages.filter(F.col("version_id") % 3 == 0).withColumn("fingerprint", F.sha2("fingerprint", 256))
    path = scratch_path(v.spark, "snapshots")
    for rows in (pages, again):
        snapshots.merge_snapshot(rows, path, "version_id")
    first, last = (snapshots.read_snapshot(v.spark, path, n).withColumn("snapshot", F.lit(n)) for n in snapshots.snapshots(v.spark, path))
    return first.unionByName(last).select("snapshot", "slide_id", "version_id", "page_no", "fingerprint")


@query
def bulk_generate(v):
    pool = v.documents.select(F.col("doc_id").alias("slide_id"), "lang", "n_chars")
    made = bulk.bulk_pages(pool, times=3)
    return made.select("slide_id", "source_slide_id", "page_no", "lang")


# --- enrichment -----------------------------------------------------------------------------


def _replies(v):
    """Model replies made from labels: plain, fenced and talkative JSON; some break a rule."""
    doc = F.col("doc_id")
    words = text.tokens(F.col("text"))
    topic = lambda i: F.coalesce(F.try_element_at(words, F.lit(i)), F.lit("none"))
    confidence = F.when(doc % 4 == 0, F.lit('"high"')).otherwise(F.concat(F.lit("0."), (doc % 9 + 1).cast("string")))
    body = F.concat(
        F.lit('{"summary":"page '), doc.cast("string"), F.lit('","topics":["'), topic(1), F.lit('","'), topic(2), F.lit('"],"page_purpose":"'),
        topic(3), F.lit('","content_types":["'), F.col("lang"), F.lit('"],"visual_styles":7'),
        F.when(doc % 5 == 3, F.lit("")).otherwise(F.concat(F.lit(',"use_cases":["'), F.col("source"), F.lit('"]'))),
        F.lit(',"confidence":'), confidence, F.lit("}"),
    )
    raw = (
        F.when(doc % 3 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(doc % 3 == 2, F.concat(F.lit("Here it is: "), body, F.lit(" done")))
        .otherwise(body)
    )
    return v.documents.select(doc.alias("slide_id"), raw.alias("raw"))


def _analyses(v):
    return stored(enrich.normalize_analyses(_replies(v)), "analyses")


@query
def normalize_analyses(v):
    done = enrich.normalize_analyses(_replies(v))
    listed = lambda name: F.array_join(f"analysis.{name}", "|").alias(name)
    return done.select(
        "slide_id", "status", "summary", listed("topics"), listed("page_purpose"), listed("visual_styles"), listed("use_cases"),
        F.col("analysis.confidence").alias("confidence"),
    )


@query
def merge_ai_tags(v):
    _, merged = enrich.merge_ai_tags(_analyses(v), v.tags, v.slide_tags)
    return merged.select("slide_id", "tag_id", "origin", "confidence", "is_confirmed")


@query
def created_ai_tags(v):
    named = enrich.analysis_tags(_analyses(v))
    return enrich.new_tags(named, v.tags).select("tag_id", "name", "category")


def _ocr_replies(v):
    """OCR replies in the three shapes, from page text with image links put in."""
    doc = F.col("doc_id")
    md = F.concat(F.lit("![a](images/"), doc.cast("string"), F.lit(".png)\n\n\n\n"), F.col("text"), F.lit(" \u3000\n"))
    raw = (
        F.when(doc % 4 == 0, F.to_json(F.struct(md.alias("md"))))
        .when(doc % 4 == 1, F.to_json(F.struct(F.create_map(F.lit("p.png"), F.struct(md.alias("md_content"))).alias("results"))))
        .when(doc % 4 == 2, F.to_json(F.struct(F.array(md).alias("results"))))
        .otherwise(F.lit("{}"))
    )
    return v.documents.select(doc.alias("slide_id"), raw.alias("raw"))


@query
def markdown_clean(v):
    return enrich.ocr_markdown(_ocr_replies(v)).select("slide_id", F.md5(F.col("markdown").cast("binary")).alias("markdown_hash"))


@query
def merge_ocr(v):
    merged = enrich.merge_ocr_text(v.scoped(superuser=True), _ocr_replies(v))
    return merged.select("slide_id", F.md5(F.col("mineru_markdown").cast("binary")).alias("markdown_hash"), "fingerprint")


@query
def enrichment_progress(v):
    merged = enrich.merge_ocr_text(v.scoped(superuser=True), _ocr_replies(v))
    return enrich.enrichment_progress(merged)


@query
def embed_incremental(v):
    """Pages without an up-to-date vector get one; pages of English text count as done before."""
    indexed = indexing.index_text(v.scoped(superuser=True), None, with_title=False)
    english = v.documents.filter(F.col("lang") == "en").select(F.col("doc_id").alias("slide_id"))
    done = indexed.join(english, "slide_id", "left_semi").select(
        "slide_id", F.lit("m1").alias("model"), F.sha2("index_text", 256).alias("source_hash"), F.lit("success").alias("status")
    )
    bag = enrich.hashed_bag()

    def moody(texts: pd.Series) -> pd.Series:  # has no vector for texts of an odd length
        return pd.Series([None if len(t) % 2 else x for t, x in zip(texts, bag(texts), strict=True)], dtype=object)

    made = enrich.build_embeddings(indexed, done, "m1", moody)
    return made.select("slide_id", "model", "source_hash", "status", F.size("embedding").cast("bigint").alias("dim"))


@query
def element_embed(v):
    made = enrich.build_element_embeddings(v.elements, enrich.hashed_bag())
    return made.groupBy("slide_id", "embedding_status").agg(F.count(F.lit(1)).alias("n"))


@query
def readiness(v):
    return enrich.readiness(v.slides, v.slide_embeddings, _analyses(v))


@query
def promote_status(v):
    ready = enrich.readiness(
        v.slides, v.documents.select(F.col("doc_id").alias("slide_id"), F.lit("success").alias("status")),
        v.documents.filter("n_chars > 0").select(F.col("doc_id").alias("slide_id"), F.lit("success").alias("status")),
    )
    rendered = v.versions.filter(F.col("page_count") > 0).select("version_id")
    return enrich.promote_status(v.versions, ready, rendered=rendered).select("version_id", "status")


@query
def apply_summaries(v):
    """Two runs per labelled page; the second one counts, a failed one keeps the old summary."""
    pages = v.slides.select("slide_id", F.lit("old").alias("ai_summary"), F.lit("none").alias("ai_status"))
    seen = v.table("labels").select(F.col("doc_id").alias("slide_id"), "quality")
    first = seen.select("slide_id", F.lit("first").alias("summary"), F.lit("success").alias("status"), F.lit(1).alias("at"))
    again = seen.select(
        "slide_id", F.concat(F.lit("second "), F.col("slide_id").cast("string")).alias("summary"),
        F.when(F.col("quality") == 1, "success").otherwise("failed").alias("status"), F.lit(2).alias("at"),
    )
    return enrich.apply_summaries(pages, first.unionByName(again))


@query
def merge_element_ocr(v):
    """Pictures read twice; text and tokens of the later reply."""
    index = indexing.token_index(v.elements.select("slide_id", "element_index", "element_type", "text"), "text").drop("n_tokens")
    page = F.col("slide_id").cast("string")
    reply = lambda at, body: v.elements.select(
        "slide_id", "element_index", F.to_json(F.struct(body.alias("md"))).alias("raw"), F.lit(at).alias("at")
    )
    replies = reply(1, F.lit("draft")).unionByName(reply(2, F.concat(F.lit("read "), page, F.lit(" twice"))))
    merged = enrich.merge_element_ocr(index, replies)
    return merged.select(
        "slide_id", F.col("element_index").cast("bigint").alias("element_index"), F.md5(F.col("text").cast("binary")).alias("text_hash"),
        F.array_join("tokens", " ").alias("tokens"),
    )


@query
def hex_distances(v):
    """Distance of the two halves of a text's digest, and of the first one to the language code, which is seldom a number."""
    digest = F.sha2("text", 256)
    one, two = F.substring(digest, 1, 16), F.substring(digest, 17, 16)
    return v.documents.select("doc_id", scalar.hamming(one, two).alias("halves"), scalar.hamming(one, F.col("lang")).alias("odd"))


@query
def titles_from_paths(v):
    return v.files.select("file_id", text.title_from_path(F.col("path")).alias("title"))


@query
def pages_of_version(v):
    return library.version_slides(v.slides, 2).select("slide_id", "page_no", "title")


# --- jobs -----------------------------------------------------------------------------------


@query
def job_latest(v):
    return library.latest_jobs(v.jobs).select("target_type", "target_id", "job_id", "status", "progress")


@query
def job_list(v):
    return jobs.list_jobs(v.jobs, status="failed").select("job_id", "target_id", "error_code")


@query
def job_targets(v):
    named = jobs.with_targets(v.jobs, v.versions, v.slides, v.presentations)
    return named.select("job_id", "target_name", "target_parent_id", "target_parent_name", "target_page_no")


@query
def job_durations(v):
    return jobs.durations(v.jobs).select("job_id", "duration_ms", "duration")


@query
def job_upsert(v):
    """Requests from all events onto the jobs that view events have made before."""
    key = scalar.idempotency_key(F.col("job_type"), F.col("target_id"), F.col("stage"))
    old = v.jobs.filter(F.col("status") == "running").withColumn("idempotency_key", key).groupBy("idempotency_key").agg(
        F.min(F.struct("job_type", "target_type", "target_id", "stage", "status")).alias("j")
    ).select("idempotency_key", "j.*", F.lit(50).alias("progress"))
    requests = v.jobs.select("job_type", "target_type", "target_id", "stage", F.col("stage").alias("input_data"))
    merged = jobs.upsert_requests(old, requests)
    return merged.select("idempotency_key", "job_type", "target_type", "target_id", "status", "progress")


@query
def job_collapse(v):
    kind = F.when(F.col("event_type") == "error", "failure").when(F.col("event_type") == "purchase", "success").otherwise("start")
    log = v.events.select(
        F.col("user_id").cast("string").alias("idempotency_key"), kind.alias("event"), F.col("ts").alias("at"), F.col("event_id").alias("seq"),
        F.when(kind == "failure", "E").alias("error_code"),
    )
    return jobs.collapse_events(log).select(
        "idempotency_key", "status", "progress", "error_code", F.unix_micros("started_at").alias("started_us"), F.unix_micros("finished_at").alias("finished_us")
    )


# --- table maintenance ----------------------------------------------------------------------


@query
def tag_lists(v):
    return library.slide_tag_list(v.slide_tags, library.active_tags(v.tags)).select("slide_id", "name", "category", "origin", "is_confirmed")


@query
def batch_tags(v):
    """Every French page gets the quality tag."""
    pages = v.documents.filter(F.col("lang") == "fr").select(F.col("doc_id").alias("slide_id"))
    return library.batch_tags(v.slide_tags, pages, "tag-quality").select("slide_id", "tag_id", "origin", "is_confirmed")


@query
def untag_pages(v):
    gone = v.table("labels").filter("quality = 1 and toxic = 1").select(F.col("doc_id").alias("slide_id"), F.lit("tag-toxic").alias("tag_id"))
    return library.remove_slide_tags(v.slide_tags, gone).select("slide_id", "tag_id")


@query
def create_and_patch_tags(v):
    wanted = v.documents.select(F.col("source").alias("name"), F.lit("source").alias("category")).distinct()
    tags = library.create_tags(v.tags, wanted)
    changes = v.documents.select(F.concat(F.lit("tag-"), F.col("lang")).alias("tag_id"), F.lit("disabled").alias("status")).distinct()
    return library.patch_tags(tags, changes).select("tag_id", "name", "category", "source", "status")


@query
def favorites_changed(v):
    """Purchases add favourites, views remove them."""
    n_docs = v.documents.agg(F.count(F.lit(1))).scalar()
    page = (F.col("event_id") % n_docs).alias("slide_id")
    bought = v.events.filter(F.col("event_type") == "purchase").select("user_id", page, F.col("ts").alias("created_at"))
    first = bought.groupBy("user_id", "slide_id").agg(F.min("created_at").alias("created_at"))
    seen = v.events.filter(F.col("event_type") == "view").select("user_id", page)
    kept = library.remove_favorites(library.add_favorites(v.favorites, first), seen)
    return kept.select("user_id", "slide_id", F.unix_micros("created_at").alias("created_us"))


@query
def soft_delete(v):
    wanted = v.presentations.filter(F.col("visibility") == "team").select("presentation_id")
    after = library.soft_delete(v.presentations, wanted, "2024-03-01", user_id=USER)
    return after.select("presentation_id", F.unix_seconds("deleted_at").alias("deleted_s"))


@query
def restore_files(v):
    after = library.restore(v.presentations, v.presentations.select("presentation_id"), user_id=USER)
    return after.select("presentation_id", F.col("deleted_at").isNotNull().alias("in_trash"))


@query
def hard_delete_cascade(v):
    """Rows left per table after the private files are gone for good."""
    tables = {
        "presentations": v.presentations, "versions": v.versions, "slides": v.slides, "slide_tags": v.slide_tags, "favorites": v.favorites,
        "jobs": v.jobs, "matches": versions.match_exact(versions.previous_versions(v.versions), v.page_keys),
    }
    return _left(library.hard_delete(tables, v.presentations.filter(F.col("visibility") == "private")))


@query
def empty_trash(v):
    tables = {"presentations": v.presentations, "versions": v.versions, "slides": v.slides, "slide_tags": v.slide_tags, "favorites": v.favorites}
    return _left(library.empty_trash(tables, superuser=True))


def _left(tables: dict[str, DataFrame]) -> DataFrame:
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in tables.items()]
    out = counts[0]
    for part in counts[1:]:
        out = out.unionByName(part)
    return out


@query
def folder_delete(v):
    _, files_after = library.folder_delete(v.folders, v.presentations, v.folders.filter(F.col("folder_id") == 0))
    return files_after.select("presentation_id", "folder_id")


@query
def set_current(v):
    """Back to the first version everywhere; a foreign version in the request is ignored."""
    own = v.versions.filter("version_no = 1").select("presentation_id", "version_id")
    foreign = v.versions.select((F.col("presentation_id") + 1).alias("presentation_id"), "version_id")
    return library.set_current(v.presentations, v.versions, own.unionByName(foreign), superuser=True).select("presentation_id", "current_version_id")


@query
def patch_slides(v):
    changes = v.table("labels").filter("quality = 1").select(
        F.col("doc_id").alias("slide_id"), F.concat(F.lit("good page "), F.col("doc_id").cast("string")).alias("title"), F.lit(0).alias("page_no")
    )
    earlier = changes.select("slide_id", F.lit("draft").alias("title"), "page_no", F.lit(0).alias("at"))
    cleared = v.table("labels").filter("toxic = 1").select(F.col("doc_id").alias("slide_id"), F.lit("x").alias("title"), F.lit(0).alias("page_no"))
    last = changes.withColumn("at", F.lit(1)).withColumn("set_null", F.array().cast("array<string>"))
    noted = v.table("labels").select(F.col("doc_id").alias("slide_id"), F.concat(F.lit("seen "), F.col("quality").cast("string")).alias("user_note"), F.lit(3).alias("at"))
    every = (
        earlier.withColumn("set_null", F.array().cast("array<string>")).unionByName(last)
        .unionByName(cleared.withColumn("at", F.lit(2)).withColumn("set_null", F.array(F.lit("title"))))
        .unionByName(noted, allowMissingColumns=True)
    )
    pages = v.slides.select("slide_id", "version_id", "title", "page_no", F.lit("none").alias("user_note"))
    return library.patch_slides(pages, every, v.presentations, v.versions, user_id=USER).select("slide_id", "title", "page_no", "user_note")


@query
def patch_files(v):
    changes = v.presentations.select(
        "presentation_id", F.concat(F.lit("new "), F.col("title")).alias("title"),
        F.when(F.col("presentation_id") % 2 == 0, "private").otherwise("secret").alias("visibility"),
    )
    return library.patch_presentations(v.presentations, changes, user_id=USER).select("presentation_id", "title", "visibility")


# --- quality --------------------------------------------------------------------------------


def _relevant(v):
    """Relevant titles: pages whose vector shares the query's label."""
    pages = v.slide_embeddings.select("slide_id", "label").join(v.slides.select("slide_id", "title"), "slide_id")
    return v.queries.filter(F.col("label").isNotNull()).select("query_id", "label").join(pages, "label").select("query_id", "title")


def _vector_hits(v):
    ranked = recall.vector_recall(v.queries, v.slide_embeddings, _scope_pages(v), depth=10)
    return ranked.join(v.slides.select("slide_id", "title"), "slide_id").select("query_id", F.col("rank").alias("position"), "title")


@query
def eval_recall_ndcg(v):
    per = quality.evaluate_queries(_vector_hits(v), _relevant(v))
    return per.select("query_id", F.round("recall", 6).alias("recall"), F.round("ndcg", 6).alias("ndcg"))


@query
def eval_standard(v):
    per = quality.evaluate_queries(_vector_hits(v), _relevant(v), variant="standard")
    return per.select("query_id", F.round("recall", 6).alias("recall"), F.round("ndcg", 6).alias("ndcg"))


@query
def eval_means(v):
    return quality.evaluation_means(quality.evaluate_queries(_vector_hits(v), _relevant(v)))


@query
def page_key_check(v):
    return quality.duplicate_keys(v.slides, ["version_id", "page_no"])


# --- streams --------------------------------------------------------------------------------


def _stream(v, name):
    """The table as a stream, be it one file or a folder of files: as a pattern the path may name either."""
    schema = v.table(name).schema
    return v.spark.readStream.schema(schema).parquet(f"{v.sf_dir}/{{{name}}}.parquet")


@query
def stream_ingest(v):
    """Pages arrive as a stream, land in the index tables and are read back."""
    docs = _stream(v, "documents").withColumn("pid", F.expr("cast(substring(source, 4) as int)"))
    pages = v.finished(v.document_pages(docs)).withColumn("presentation_title", F.lit(None).cast("string"))
    base = scratch_path(v.spark, "stream-ingest")
    ingest.stream_slides(pages, f"{base}/tables", f"{base}/state")
    slides = ingest.read_slides(v.spark, f"{base}/tables").select("slide_id", "fingerprint", F.col("n_tokens").cast("bigint").alias("n_tokens"))
    n_elements = ingest.read_elements(v.spark, f"{base}/tables").groupBy("slide_id").agg(F.count(F.lit(1)).alias("n_elements"))
    return slides.join(n_elements, "slide_id", "left").fillna(0, ["n_elements"])


@query
def stream_search(v):
    """Words found in what a stream has indexed: a first run in two batches, then a run that replaces every third version by shorter pages."""
    pages = v.document_pages(v.documents)
    again = pages.filter((F.col("version_id") % 3 == 0) & (F.col("slide_id") % 7 != 3)).withColumn("native_text", text.first_line(F.col("native_text")))
    base = scratch_path(v.spark, "stream-search")
    for run, rows in (("one", pages.filter("slide_id % 2 = 0")), ("one", pages.filter("slide_id % 2 <> 0")), ("two", again)):
        arriving = v.finished(rows).withColumn("presentation_title", F.lit(None).cast("string")).withColumn("run_id", F.lit(run))
        arriving.write.mode("append").parquet(f"{base}/in")
        ingest.stream_slides(v.spark.readStream.schema(arriving.schema).parquet(f"{base}/in"), f"{base}/tables", f"{base}/state")
    return recall.text_recall(v.queries, ingest.page_search(v.spark, f"{base}/tables"), v.scope(USER))


@query
def stream_dedup(v):
    """Uploads arrive as a stream; those whose content is a benchmark passage are known."""
    docs = _stream(v, "documents")
    arriving = docs.select(F.sha2("text", 256).alias("sha256"), F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60).alias("arrived_at"))
    known = v.table("benchmark").select(F.sha2("text", 256).alias("sha256"))
    base = scratch_path(v.spark, "stream-files")
    for run in ("first", "again", "third"):  # the later streams repeat all files, long after
        ingest.land_new_files(arriving, known, f"{base}/files", f"{base}/state-{run}")
    return v.spark.read.parquet(f"{base}/files").select("sha256")


@query
def stream_job_state(v):
    arriving = v.as_jobs(_stream(v, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    events = arriving.select("target_type", "target_id", F.col("created_at").alias("at"), F.col("job_id").alias("seq"), "status", "progress")
    base = scratch_path(v.spark, "stream-jobs")
    job_stream.stream_job_state(events, f"{base}/jobs", f"{base}/state")
    return job_stream.read_job_state(v.spark, f"{base}/jobs").select("target_type", "target_id", "seq", "status", "progress")


__all__ = ["MOVED", "all_queries", "scoped_slides"]
