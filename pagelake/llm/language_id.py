"""Language of web pages by Bayesian fusion of text, declared language, address suffix and host.

Text likelihoods come from hashed trigrams of bytes, counted over a bounded sample of documents of known
language (``FIT_DOCS`` documents). A first pass gives each page its text posterior; grouped
aggregation over all pages turns these into expected language counts per host, site, suffix and declared
language. A second pass multiplies: text likelihood (tempered, as trigrams overlap), likelihood of the
declaration and of the suffix (two or three letters; longer ones say nothing), and the host's prior, which is smoothed by its site's, that by all
pages'. Each page's own share is taken out of the counts that judge it.

Nulls: a page without html, text or address has no such evidence; what is left decides, at last the
share of languages over all pages. Repeated rows count as often as they stand. Ties go to the language
first in the alphabet. Without a known language the result has null languages; empty tables give empty results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.llm.words import ODD, mix, text_blocks
from pagelake.session import cut

FIT_DOCS = 4_000
CELLS = 1 << 16
#: Trigrams of a page that count in full; the log-likelihood of more is scaled down to so many.
EVIDENCE = 60
#: Pages of the wider group that a group's own counts are blended with.
BLEND = 5.0
NOISE = re.compile(rb"<!--.*?-->|<(script|style|nav)\b.*?</\1\s*>|<[^>]*>|&[a-zA-Z#0-9]{1,10};", re.S | re.I)
DECLARED = r"(?i)<html[^>]*?\slang\s*=\s*[\"']?\s*([a-z]{2,3})"


def _trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell of each trigram of letters, its row); A-Z lower-cased, other ASCII a single blank."""
    low = data.copy()
    low[(data >= 65) & (data <= 90)] += 32
    low[(data < 128) & ~((low >= 97) & (low <= 122))] = 32
    n = len(low) - 2
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b, c = low[:n], low[1 : n + 1], low[2:]
    row = np.searchsorted(offsets, np.arange(len(low)), side="right") - 1
    good = (row[:n] == row[2:]) & (b != 32)
    code = a[good].astype(np.uint64) << np.uint64(16) | b[good].astype(np.uint64) << np.uint64(8) | c[good].astype(np.uint64)
    return (mix(code * ODD) % np.uint64(CELLS)).astype(np.int64), row[:n][good]


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", fit_docs: int = FIT_DOCS) -> tuple[list[str], np.ndarray]:
    """(languages, log-likelihood of each cell per language) of a bounded sample of labelled documents."""
    named = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    named = named.filter("_id is not null and lang is not null")
    ids = named.select("_id", "lang").distinct().orderBy(F.xxhash64("_id"), "_id", "lang").limit(fit_docs)
    sample = named.join(F.broadcast(ids), ["_id", "lang"]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for block in text_blocks(batch.column(1)):
                cell, row = _trigrams(block.data, block.offsets)
                edges = np.searchsorted(row, np.arange(block.rows + 1))
                for r in range(block.rows):
                    own = sums.setdefault(langs[block.row + r], np.zeros(CELLS, np.int64))
                    own += np.bincount(cell[edges[r] : edges[r + 1]], minlength=CELLS)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["lang", "counts"])

    total: dict[str, np.ndarray] = {}
    for r in sample.mapInArrow(count, "lang string, counts binary").toLocalIterator():
        total[r["lang"]] = total.get(r["lang"], 0) + np.frombuffer(r["counts"], np.int64)
    langs = sorted(total)
    table = np.array([total[x] for x in langs], dtype=float).reshape(len(langs), CELLS) + 0.5
    return langs, np.log(table / table.sum(1, keepdims=True))


def _softmax(x: Column) -> Column:
    top = F.array_max(x)
    e = F.transform(x, lambda v: F.exp(v - top))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def _plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def identify(pages: DataFrame, langs: list[str], table: np.ndarray, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: page_id, host, suffix, declared, n_trigrams, text_lang, lang, probability."""
    k = len(langs)
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    host = F.lower(F.regexp_extract(F.col(url_col).cast("string"), r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))
    declared = F.lower(F.regexp_extract(html, DECLARED, 1))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [NOISE.sub(b" ", (x or "").encode()) for x in batch.column(3).to_pylist()]
            score, n = np.zeros((len(raw), k)), np.zeros(len(raw), np.int64)
            for block in text_blocks(pa.array([x.decode("utf-8", "ignore") for x in raw], pa.string())):
                cell, row = _trigrams(block.data, block.offsets)
                n[block.row : block.row + block.rows] = np.bincount(row, minlength=block.rows)
                for i in range(k):
                    score[block.row : block.row + block.rows, i] = np.bincount(row, weights=table[i][cell], minlength=block.rows)
            score *= np.minimum(1, EVIDENCE / np.maximum(n, 1))[:, None]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(n), pa.array(list(score), pa.list_(pa.float64()))], ["page_id", "host", "declared", "n_trigrams", "text"]
            )

    scored = cut(
        pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.coalesce(host, F.lit("")).alias("host"), declared.alias("declared"), html.alias("html"))
        .mapInArrow(work, "page_id bigint, host string, declared string, n_trigrams bigint, text array<double>")
        .withColumns({"suffix": F.regexp_extract("host", r"\.([a-z]{2,3})$", 1), "site": F.regexp_extract("host", r"([^.]+\.[^.]+(?:\.[^.]+)?)$", 1), "post": _softmax(F.col("text"))})
    )
    if not k:
        return scored.select("page_id", "host", "suffix", "declared", "n_trigrams", F.lit(None).cast("string").alias("text_lang"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("probability"))

    def counts(key: str, out: str) -> DataFrame:
        sums = F.array(*[F.sum(F.col("post")[i]) for i in range(k)])
        return scored.groupBy(key).agg(sums.alias(out))

    everything = scored.agg(*[F.sum(F.col("post")[i]) for i in range(k)]).first()
    if everything[0] is None:
        return scored.select("page_id", "host", "suffix", "declared", "n_trigrams", F.lit(None).cast("string").alias("text_lang"), F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("probability"))
    world = F.array(*[F.lit(float((x + 1) / (sum(everything) + k))) for x in everything])

    def minus_own(col: str) -> Column:
        return F.zip_with(F.col(col), F.col("post"), lambda a, b: F.greatest(a - b, F.lit(0.0)))

    def blended(own: Column, wide: Column) -> Column:
        n = F.aggregate(own, F.lit(0.0), lambda s, y: s + y)
        return F.zip_with(own, wide, lambda a, w: (a + F.lit(BLEND) * w) / (n + F.lit(BLEND)))

    def ratio(own: Column) -> Column:
        """log P(evidence | language) up to a constant: the group's language share against all pages'."""
        return F.when(F.size(own) > 0, F.zip_with(blended(own, world), world, lambda a, w: F.log(a / w)))

    # Suffixes and declarations are two or three letters by their patterns, so these tables have a bounded number of rows.
    marked = scored.join(F.broadcast(counts("suffix", "by_suffix")), "suffix").join(F.broadcast(counts("declared", "by_declared")), "declared")
    marked = marked.join(counts("host", "by_host"), "host").join(counts("site", "by_site"), "site")
    prior = blended(minus_own("by_host"), blended(minus_own("by_site"), world))
    none = F.array(*[F.lit(0.0)] * k)
    fused = _plus(
        _plus(F.col("text"), F.transform(F.when(F.col("host") == "", world).otherwise(prior), lambda p: F.log(p))),
        _plus(F.when(F.col("declared") == "", none).otherwise(ratio(minus_own("by_declared"))), F.when(F.col("suffix") == "", none).otherwise(ratio(minus_own("by_suffix")))),
    )
    names = F.array(*[F.lit(x) for x in langs])
    best = lambda p: F.element_at(names, F.array_position(p, F.array_max(p)).cast("int"))
    return marked.withColumn("p", _softmax(fused)).select(
        "page_id", "host", "suffix", "declared", "n_trigrams", F.when(F.col("n_trigrams") > 0, best(F.col("post"))).alias("text_lang"),
        best(F.col("p")).alias("lang"), F.round(F.array_max("p"), 6).alias("probability"),
    )
