"""The four recall lists of a batch of queries: page text, page vectors, element text, element vectors.

Every list has the form (query_id, slide_id, score or distance, rank).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.constants import LIST_DEPTH
from pagelake.functions.text import tokens
from pagelake.operators.block_join import block_count, block_join
from pagelake.operators.indexing import index_totals
from pagelake.operators.ranks import top_k
from pagelake.operators.search_index import B, K1, SearchIndex, index_recall
from pagelake.session import cut

# Items whose distances to a strip of queries a task holds at a time.
ITEM_TILE = 8192


def query_terms(queries: DataFrame, words: Iterable[str] | None = None) -> DataFrame:
    """(query_id, terms): distinct tokens, cut with the dictionary ``words`` of the index; queries without any token are left out."""
    terms = F.array_distinct(tokens(F.col("query"), words))
    return queries.select("query_id", terms.alias("terms")).filter(F.size("terms") > 0)


def _held(index: DataFrame, keys: list[str], words: DataFrame) -> DataFrame:
    """Postings (token, *keys, n_tokens, tf) of the words, from a postings table or from pages with their tokens."""
    if "tf" in index.columns:
        return index.join(words, "token", "left_semi").select("token", *keys, "n_tokens", "tf")
    flat = index.select(*keys, "n_tokens", F.explode_outer("tokens").alias("token"))
    return flat.join(words, "token", "left_semi").groupBy("token", *keys, "n_tokens").agg(F.count(F.lit(1)).alias("tf"))


def _scores(queries: DataFrame, index: DataFrame, keys: list[str], totals: DataFrame, words: Iterable[str] | None) -> DataFrame:
    """BM25 of every (query, doc) where the doc holds all of the query's tokens.

    Only postings of the batch's words are kept. A doc meets a query through the query's rarest
    token alone, so a common word multiplies nothing; the pairs met look up their other tokens.
    """
    asked = query_terms(queries, words).select("query_id", F.size("terms").alias("n_terms"), F.explode("terms").alias("token"))
    held = cut(_held(index, keys, asked.select("token").distinct()))
    n_docs = totals.select(F.col("n_docs").cast("double")).scalar()
    avg = totals.select("avg_tokens").scalar()
    df = held.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    known = asked.join(df, "token")
    rarest = (
        known.groupBy("query_id", "n_terms").agg(F.count(F.lit(1)).alias("n"), F.min_by("token", F.struct("df", "token")).alias("token"))
        .filter(F.col("n") == F.col("n_terms")).select("query_id", "token")
    )
    met = held.select("token", *keys).join(rarest, "token").select("query_id", *keys)
    looked = met.join(known, "query_id").join(held, ["token", *keys])
    idf = F.log(1.0 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    length = K1 * (1.0 - B + B * F.col("n_tokens") / avg)
    part = idf * F.col("tf") * (K1 + 1.0) / (F.col("tf") + length)
    scored = looked.groupBy("query_id", *keys).agg(F.count(F.lit(1)).alias("n"), F.first("n_terms").alias("n_terms"), F.round(F.sum(part), 6).alias("score"))
    return scored.filter(F.col("n") == F.col("n_terms")).select("query_id", *keys, "score")


def text_recall(
    queries: DataFrame, index: DataFrame | SearchIndex, scope: DataFrame, totals: DataFrame | None = None, depth: int = LIST_DEPTH, words: Iterable[str] | None = None
) -> DataFrame:
    """Pages holding all query tokens, best BM25 first, ties by page id.

    ``index``: a ``SearchIndex``, which reads the batch's words only and skips blocks that cannot matter; or pages with tokens and n_tokens,
    or their postings (``indexing.clustered_postings``; then give ``totals``, as pages without a word are not in them). Scope applies before the cut and to the collection statistics; ``totals`` (n_docs, avg_tokens)
    saves the pass over the index when the caller keeps them.
    """
    if isinstance(index, SearchIndex):
        return index_recall(queries, index, scope, depth, words)
    scoped = index.join(scope.select("version_id"), "version_id", "left_semi")
    scored = _scores(queries, scoped, ["slide_id"], index_totals(scoped) if totals is None else totals, words)
    return top_k(scored, ["query_id"], [F.col("score").desc(), F.col("slide_id")], depth)


def element_text_recall(
    queries: DataFrame, elements: DataFrame | SearchIndex, scope: DataFrame, totals: DataFrame | None = None, depth: int = LIST_DEPTH, words: Iterable[str] | None = None
) -> DataFrame:
    """As ``text_recall`` over elements; a page scores as its best element."""
    if isinstance(elements, SearchIndex):
        return index_recall(queries, elements, scope, depth, words)
    scoped = elements.join(scope.select("version_id"), "version_id", "left_semi")
    scored = _scores(queries, scoped, ["slide_id", "element_index"], index_totals(scoped) if totals is None else totals, words)
    best = scored.groupBy("query_id", "slide_id").agg(F.max("score").alias("score"))
    return top_k(best, ["query_id"], [F.col("score").desc(), F.col("slide_id")], depth)


# --- vectors --------------------------------------------------------------------------------


def _unit(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of length 1; those without a direction as not-a-number."""
    column = column.cast(pa.large_list(pa.float64()))
    matrix = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    norms = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return np.divide(matrix, norms, out=np.full_like(matrix, np.nan), where=norms > 0)


class _Items:
    """A block's vectors, sorted by page."""

    def __init__(self, rows: pa.Table) -> None:
        owners = rows.column("id").to_numpy()
        order = np.argsort(owners, kind="stable")
        self.unit = _unit(rows.column("embedding").combine_chunks())[order]
        self.owners = owners[order]

    def tiles(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(vectors, pages, first row of each page) of some whole pages at a time."""
        pages, first = np.unique(self.owners, return_index=True)
        lo = 0
        while lo < len(pages):
            hi = max(int(np.searchsorted(first, first[lo] + ITEM_TILE)), lo + 1)
            end = first[hi] if hi < len(pages) else len(self.owners)
            yield self.unit[first[lo] : end], pages[lo:hi], first[lo:hi] - first[lo]
            lo = hi


_FOUND = "query_id bigint, slide_id bigint, distance double"


def _nearest(items: _Items, asked: pa.Table, k: int) -> pa.Table:
    """The k nearest pages of a block for each query of a strip, ties by page."""
    unit, ids = _unit(asked.column("embedding").combine_chunks()), asked.column("id").to_numpy()
    distance, page = np.full((len(ids), 0), np.inf), np.zeros((len(ids), 0), dtype=np.int64)
    for vectors, pages, first in items.tiles():
        raw = np.round(1.0 - unit @ vectors.T, 6) + 0.0
        near = np.fmin.reduceat(np.where(np.isnan(raw), np.inf, raw), first, axis=1)
        if near.shape[1] > 2 * k:
            # pages beyond the k-th distance of the tile cannot matter; all that tie with it stay until the pages decide
            worst = np.partition(near, k - 1, axis=1)[:, k - 1].max()
            some = np.flatnonzero((near <= worst).any(axis=0))
            near, pages = near[:, some], pages[some]
        distance = np.concatenate([distance, near], axis=1)
        page = np.concatenate([page, np.broadcast_to(pages, near.shape)], axis=1)
        rank = np.lexsort((page, distance), axis=1)[:, :k]
        distance, page = np.take_along_axis(distance, rank, 1), np.take_along_axis(page, rank, 1)
    row, col = np.nonzero(np.isfinite(distance))
    return pa.table({"query_id": ids[row], "slide_id": page[row, col], "distance": distance[row, col]})


def nearest_pages(queries: DataFrame, items: DataFrame, k: int = LIST_DEPTH) -> DataFrame:
    """(query_id, slide_id, distance, rank): the k pages nearest to each query vector by cosine.

    Exact. ``items`` (slide_id, embedding) may hold many rows per page; a page counts at its
    nearest row. Distances are rounded to 6 decimals, ties go to the lower page id. Blocks of items and strips of queries meet in
    keyed groups (``block_join``), so no row of either side passes the driver and the plan does not depend on
    their numbers; a task holds one block, one tile of distances and k rows per query of a strip. All vectors have one length.
    """
    asked = queries.select(F.col("query_id").cast("bigint").alias("id"), F.col("embedding").cast("array<double>").alias("embedding")).filter(F.size("embedding") > 0)
    vectors = items.select(F.col("slide_id").cast("bigint").alias("id"), F.col("embedding").cast("array<double>").alias("embedding")).filter(F.size("embedding") > 0)
    near = block_join(vectors, asked, F.col("id"), block_count(vectors), _Items, lambda held, strip: _nearest(held, strip, k), _FOUND)
    return top_k(near, ["query_id"], [F.col("distance"), F.col("slide_id")], k)


def successful(embeddings: DataFrame) -> DataFrame:
    return embeddings.filter(F.col("status") == "success")


def vector_recall(
    queries: DataFrame,
    embeddings: DataFrame,
    pages: DataFrame,
    filter_first: bool = True,
    depth: int = LIST_DEPTH,
) -> DataFrame:
    """Nearest pages within ``pages``, the caller's scope: page ids, or the scope's versions where ``embeddings`` carry
    version_id; the list of versions is short, so no vector moves.

    ``filter_first=False`` ranks over all pages and drops foreign ones afterwards, so ranks keep gaps.
    """
    usable = successful(embeddings) if "status" in embeddings.columns else embeddings
    if "version_id" in usable.columns and "version_id" in pages.columns and "slide_id" not in pages.columns:
        versions = pages.select("version_id").distinct()
        if filter_first:
            return nearest_pages(queries, usable.join(versions, "version_id", "left_semi"), depth)
        own = usable.join(versions, "version_id", "left_semi").select("slide_id").distinct()
        return nearest_pages(queries, usable, depth).join(own, "slide_id", "left_semi").select("query_id", "slide_id", "distance", "rank")
    scope = pages.select("slide_id")
    if filter_first:
        return nearest_pages(queries, usable.join(scope, "slide_id", "left_semi"), depth)
    return nearest_pages(queries, usable, depth).join(scope, "slide_id", "left_semi").select(
        "query_id", "slide_id", "distance", "rank"
    )


def element_vector_recall(
    queries: DataFrame, vectors: DataFrame, pages: DataFrame, filter_first: bool = True, depth: int = LIST_DEPTH
) -> DataFrame:
    """As ``vector_recall``; a page's distance is that of its nearest element."""
    return vector_recall(queries, vectors, pages, filter_first, depth)
