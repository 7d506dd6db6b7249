"""Reciprocal rank fusion, bonuses and the searches built on them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelake import constants as c
from pagelake.functions.text import is_blank, strip
from pagelake.operators import recall
from pagelake.operators.ranks import top_k
from pagelake.operators.scope import favorites_of, scoped_slides, scoped_versions
from pagelake.operators.search_index import SearchIndex
from pagelake.session import stored

LISTS = (
    ("text", c.WEIGHT_TEXT),
    ("vector", c.WEIGHT_VECTOR),
    ("element_text", c.WEIGHT_ELEMENT),
    ("element_vector", c.WEIGHT_ELEMENT),
)


@dataclass(frozen=True)
class Corpus:
    """The tables a search reads.

    index: slide_id, version_id, page_no, title, created_at; tokens and n_tokens where there is no page_index
    elements: slide_id, version_id, element_index, tokens, n_tokens, or their index
    page_index: the pages' inverted index, which then serves the text searches
    """

    index: DataFrame
    elements: DataFrame | SearchIndex
    embeddings: DataFrame
    element_embeddings: DataFrame
    presentations: DataFrame
    versions: DataFrame
    slide_tags: DataFrame
    favorites: DataFrame
    page_index: SearchIndex | None = None

    def scope(self, user_id=None, superuser=False, include_historical=False) -> DataFrame:
        return scoped_versions(self.presentations, self.versions, user_id, superuser, include_historical)

    def pages(self, user_id=None, superuser=False, include_historical=False) -> DataFrame:
        narrow = self.index.select("slide_id", "version_id", "page_no", "title", "created_at")
        return scoped_slides(narrow, self.presentations, self.versions, user_id, superuser, include_historical)


def rrf_fuse(lists: dict[str, DataFrame]) -> DataFrame:
    """(query_id, slide_id, score, <list>_rank ...): weighted reciprocal ranks summed over the lists."""
    weights = dict(LISTS)
    parts = [
        df.select(
            "query_id",
            "slide_id",
            F.lit(name).alias("list"),
            "rank",
            (F.lit(weights[name]) / (F.lit(float(c.RRF_K)) + F.col("rank"))).alias("part"),
        )
        for name, df in lists.items()
    ]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    # dealt anew: lists that are each dealt by query are not so together, as adaptive execution joins partitions of each on its own
    every = every.repartition("query_id", "slide_id")
    ranks = [F.max(F.when(F.col("list") == name, F.col("rank"))).alias(f"{name}_rank") for name, _ in LISTS]
    return every.groupBy("query_id", "slide_id").agg(F.sum("part").alias("score"), *ranks)


def structural_bonus(hits: DataFrame) -> DataFrame:
    """Adds title and file-title bonuses; needs query, title, presentation_title and score."""
    q = F.lower(strip(F.coalesce(F.col("query"), F.lit(""))))
    title = F.lower(F.coalesce(F.col("title"), F.lit("")))
    file_title = F.lower(F.coalesce(F.col("presentation_title"), F.lit("")))
    exact = (q != "") & (title == q)
    part = (q != "") & (title != "") & F.contains(title, q) & ~exact
    by_file = (q != "") & (file_title != "") & F.contains(file_title, q)
    bonus = (
        F.when(exact, c.BONUS_TITLE).when(part, c.BONUS_TITLE / 2).otherwise(0.0)
        + F.when(by_file, c.BONUS_FILE_TITLE).otherwise(0.0)
    )
    return (
        hits.withColumn("title_exact", exact)
        .withColumn("title_part", part)
        .withColumn("file_title_hit", by_file)
        .withColumn("score", F.col("score") + bonus)
    )


def tag_bonus(hits: DataFrame, slide_tags: DataFrame, tag_ids: list) -> DataFrame:
    """Once per origin: a wanted tag set by hand, a wanted tag set by a model."""
    if not tag_ids:
        return hits.withColumn("manual_tag", F.lit(False)).withColumn("ai_tag", F.lit(False))
    origins = (
        slide_tags.filter(F.col("tag_id").isin(*tag_ids))
        .groupBy("slide_id")
        .agg(
            F.max(F.col("origin") == "manual").alias("manual_tag"),
            F.max(F.col("origin") == "ai").alias("ai_tag"),
        )
    )
    joined = hits.join(origins, "slide_id", "left").fillna(False, ["manual_tag", "ai_tag"])
    gain = F.when(F.col("manual_tag"), c.BONUS_MANUAL_TAG).otherwise(0.0) + F.when(
        F.col("ai_tag"), c.BONUS_AI_TAG
    ).otherwise(0.0)
    return joined.withColumn("score", F.col("score") + gain)


def favorite_bonus(hits: DataFrame, favorites: DataFrame, user_id, only: bool = False) -> DataFrame:
    if user_id is None:
        return hits.withColumn("favorite", F.lit(False))
    marked = favorites_of(favorites, user_id)
    if only:
        return hits.join(marked, "slide_id", "left_semi").withColumn("favorite", F.lit(False))
    flagged = hits.join(marked.withColumn("favorite", F.lit(True)), "slide_id", "left").fillna(False, ["favorite"])
    return flagged.withColumn("score", F.col("score") + F.when(F.col("favorite"), c.BONUS_FAVORITE).otherwise(0.0))


def hit_reasons():
    """Distinct reasons in the order the bonuses apply."""
    by_element = F.col("element_text_rank").isNotNull() | F.col("element_vector_rank").isNotNull()
    return F.array_compact(
        F.array(
            F.when(F.col("text_rank").isNotNull(), c.REASON_TEXT),
            F.when(F.col("vector_rank").isNotNull(), c.REASON_VECTOR),
            F.when(by_element, c.REASON_ELEMENT),
            F.when(F.col("title_exact"), c.REASON_TITLE_EXACT),
            F.when(F.col("title_part"), c.REASON_TITLE_PART),
            F.when(F.col("file_title_hit"), c.REASON_FILE_TITLE),
            F.when(F.col("manual_tag"), c.REASON_MANUAL_TAG),
            F.when(F.col("ai_tag") & ~F.col("manual_tag"), c.REASON_AI_TAG),
            F.when(F.col("favorite"), c.REASON_FAVORITE),
        )
    )


def _no_ranks(df: DataFrame) -> DataFrame:
    for name, _ in LISTS:
        df = df.withColumn(f"{name}_rank", F.lit(None).cast("int"))
    return df.withColumn("score", F.lit(0.0))


def recent_slides(pages: DataFrame, topn: int = c.RESULT_DEPTH) -> DataFrame:
    """Newest pages of the scope."""
    return pages.orderBy(F.col("created_at").desc(), "slide_id").limit(topn)


def first_slides(pages: DataFrame, depth: int = c.LIST_DEPTH) -> DataFrame:
    """Starting rows of a search by filters alone."""
    return pages.orderBy("slide_id").limit(depth)


def recall_lists(
    queries: DataFrame, corpus: Corpus, user_id=None, superuser=False, include_historical=False, filter_first=True
) -> dict[str, DataFrame]:
    # written once: all four lists meet it, and vectors and pages stay where they lie to do so
    scope = stored(corpus.scope(user_id, superuser, include_historical), "scope")
    pages = corpus.index.select("slide_id", "version_id").join(scope.select("version_id"), "version_id", "left_semi")
    with_text = queries.filter(~is_blank(F.col("query")))
    scope_of = lambda vectors: scope.select("version_id") if "version_id" in vectors.columns else pages
    return {
        "text": recall.text_recall(with_text, corpus.page_index or corpus.index, scope).select("query_id", "slide_id", "rank"),
        "vector": recall.vector_recall(with_text, corpus.embeddings, scope_of(corpus.embeddings), filter_first).select(
            "query_id", "slide_id", "rank"
        ),
        "element_text": recall.element_text_recall(with_text, corpus.elements, scope).select(
            "query_id", "slide_id", "rank"
        ),
        "element_vector": recall.element_vector_recall(
            with_text, corpus.element_embeddings, scope_of(corpus.element_embeddings), filter_first
        ).select("query_id", "slide_id", "rank"),
    }


def hybrid_search(
    queries: DataFrame,
    corpus: Corpus,
    *,
    user_id=None,
    superuser: bool = False,
    tag_ids: list | None = None,
    tag_mode: str = "boost",
    favorite_user_id=None,
    favorite_only: bool = False,
    include_historical: bool = False,
    filter_first: bool = True,
    topn: int = c.RESULT_DEPTH,
    lists: dict[str, DataFrame] | None = None,
) -> DataFrame:
    """Best ``topn`` pages per query with score, ranks per list and reasons.

    ``queries``: query_id, query, embedding (null when the query has no vector). Blank queries
    list the newest pages, or start from the first pages of the scope when tags or favourites
    are asked for. ``tag_mode='filter'`` keeps only pages with a wanted tag.
    """
    tag_ids = list(tag_ids or [])
    pages = corpus.pages(user_id, superuser, include_historical)
    blank_query = is_blank(F.col("query"))
    asked = lists or recall_lists(queries, corpus, user_id, superuser, include_historical, filter_first)
    fused = rrf_fuse(asked)

    by_filter = bool(tag_ids) or favorite_only
    start = first_slides(pages) if by_filter else recent_slides(pages, topn)
    # at most ``topn`` or 100 ids, handed to every blank query as one value
    starting_ids = start.agg(F.collect_list("slide_id")).scalar()
    listed = (
        queries.filter(blank_query)
        .select("query_id", F.explode_outer(starting_ids).alias("slide_id"))
        .filter(F.col("slide_id").isNotNull())
    )

    hits = fused.unionByName(_no_ranks(listed))
    hits = hits.join(pages, "slide_id").join(queries.select("query_id", "query"), "query_id")
    hits = structural_bonus(hits)
    hits = tag_bonus(hits, corpus.slide_tags, tag_ids)
    if tag_ids and tag_mode == "filter":
        hits = hits.filter(F.col("manual_tag") | F.col("ai_tag"))
    if not by_filter:
        # pages listed for a blank query without filters keep score 0
        hits = hits.withColumn("_plain", blank_query)
    else:
        hits = hits.withColumn("_plain", F.lit(False))
    hits = favorite_bonus(hits, corpus.favorites, favorite_user_id, favorite_only)
    hits = (
        hits.withColumn("score", F.when(F.col("_plain"), 0.0).otherwise(F.round("score", 6)))
        .withColumn("favorite", F.col("favorite") & ~F.col("_plain"))
        .withColumn("hit_reasons", hit_reasons())
    )
    newest = F.when(F.col("_plain"), F.col("created_at"))
    ranked = top_k(hits, ["query_id"], [F.col("score").desc(), newest.desc_nulls_last(), F.col("slide_id")], topn, "position")
    return ranked.select(
        "query_id",
        "position",
        "slide_id",
        "version_id",
        "presentation_id",
        "presentation_title",
        "page_no",
        "title",
        "created_at",
        "score",
        *[f"{name}_rank" for name, _ in LISTS],
        "hit_reasons",
    )


def resorted(hits: DataFrame, by: str) -> DataFrame:
    """Reorders each query's cut list by 'relevance', 'recent' or 'title'; gives a new position."""
    order = {
        "relevance": [F.col("position")],
        "recent": [F.col("created_at").desc(), F.col("position")],
        "title": [F.coalesce(F.col("title"), F.lit("")), F.col("position")],
    }[by]
    return hits.withColumn("sorted_position", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))


def page_of(hits: DataFrame, page: int, page_size: int, position: str = "position") -> DataFrame:
    first = (page - 1) * page_size
    return hits.filter((F.col(position) > first) & (F.col(position) <= first + page_size))


def search_by_presentation(hits: DataFrame, page: int = 1, page_size: int = 20) -> DataFrame:
    """Hits per file, files in the order of their first hit, pages inside in rank order.

    ``hits`` is the search cut at page * page_size * 2, so a file holds few pages.
    """
    pages = F.struct("position", "slide_id", "page_no", "title", "hit_reasons")
    files = hits.groupBy("query_id", "presentation_id", "presentation_title").agg(
        F.min("position").alias("first_position"),
        F.count(F.lit(1)).alias("n_hits"),
        F.sort_array(F.collect_list(pages)).alias("slides"),
    )
    ranked = top_k(files, ["query_id"], [F.col("first_position")], page * page_size, "file_rank")
    return ranked.filter(F.col("file_rank") > (page - 1) * page_size)


def tag_facets(hits: DataFrame, slide_tags: DataFrame, tags: DataFrame) -> DataFrame:
    """Pages per tag among each query's hits."""
    return (
        hits.select("query_id", "slide_id")
        .join(slide_tags.select("slide_id", "tag_id"), "slide_id")
        .join(tags.select("tag_id", "name", "category"), "tag_id")
        .groupBy("query_id", "tag_id", "name", "category")
        .agg(F.countDistinct("slide_id").alias("n_slides"))
    )


def compose_match(outline: DataFrame, best: DataFrame) -> DataFrame:
    """Outline items with their best page; items without query or hit stay, unmatched.

    ``outline``: item_no, section, query. ``best``: a search over (query_id = item_no) cut at 1.
    """
    section = F.coalesce(F.nullif(strip(F.col("section")), F.lit("")), F.lit(c.UNNAMED_SECTION))
    items = outline.select("item_no", section.alias("section"), strip(F.coalesce("query", F.lit(""))).alias("query"))
    top = best.filter(F.col("position") == 1).select(
        F.col("query_id").alias("item_no"),
        "slide_id",
        "presentation_title",
        "page_no",
        F.round("score", 4).alias("score"),
        "hit_reasons",
    )
    return (
        items.join(top, "item_no", "left")
        .withColumn("matched", F.col("slide_id").isNotNull())
        .fillna(0.0, ["score"])
        .withColumn("hit_reasons", F.coalesce("hit_reasons", F.array().cast("array<string>")))
    )


def compose_totals(matches: DataFrame) -> DataFrame:
    return matches.agg(
        F.count(F.lit(1)).alias("page_count"), F.coalesce(F.sum(F.col("matched").cast("bigint")), F.lit(0)).alias("matched_count")
    )
