"""One inverted index behind all text searches: postings in token buckets, block maxima, counts and totals per version.

Documents (pages or elements) are dealt into blocks of about ``DOCS`` of like length. A row of the index holds the postings of a token
in one block and, in columns of their own, the greatest frequency and the least length, which bound every score in the block for any
scope; they are read without the postings. Kept beside are, per version, document counts of tokens and totals, so that a scope's
statistics need no posting.

A search reads the buckets and tokens of its batch only. Blocks that hold all words of a query are ordered by their
bound; the first ones are scored, which gives each query a threshold, the score of its last wanted page. Of the
other blocks those whose bound stays below it are skipped. Results are exact.

An index lies in segments below one folder, written by batches. A version belongs to the parse run that delivered it
last, whatever number of segments that run took; older runs are dead and are left out when the index is read. ``compact``
rewrites what lives as one segment. A segment counts once its versions are listed, which is written last.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from pagelake.functions.text import tokens
from pagelake.operators import postings
from pagelake.operators.ranks import top_k
from pagelake.session import discard, stored
from pagelake.sources.tables import bucket as bucket_of

# BM25 parameters
K1 = 1.2
B = 0.75

BUCKETS = 16
# Documents of a block, about.
DOCS = 512
# Blocks of a query that are scored before it has a threshold.
FIRST = 4
# Words of a batch that reach the scan by name; batches of more words are read by bucket.
NAMED = 1000
# Tokens that a task of a build groups and writes, about.
TASK_TOKENS = 1 << 20
# Segment numbers of a stream's batch: its own, and room for compactions and tombstones before the next one.
STEP = 1024
# Scores are compared rounded, bounds are not.
SLACK = 1e-5


@dataclass(frozen=True)
class SearchIndex:
    """lists: segment, bucket, token, block, max_tf, min_tokens, docs (array<struct<<keys>, version_id, run_id, n_tokens, tf>>,
    without run_id where no posting is dead).
    live: version_id, run_id, since. counts: bucket, token, version_id, df, of each segment, to be summed. totals: version_id, n_docs, n_tokens."""

    lists: DataFrame
    live: DataFrame
    counts: DataFrame
    totals: DataFrame
    keys: tuple[str, ...]

    @property
    def maxima(self) -> DataFrame:
        """bucket, token, block, max_tf, min_tokens. Dead rows count; they bound too much, never too little."""
        return self.lists.select("bucket", "token", "block", "max_tf", "min_tokens")

    def flat(self, lists: DataFrame) -> DataFrame:
        """The living postings of some rows of ``lists``: <columns of lists but docs>, <keys>, version_id, n_tokens, tf."""
        rows = _unpacked(lists.drop("max_tf", "min_tokens"))
        return _alive(rows, self.live) if "run_id" in rows.columns else rows.drop("segment")

    @property
    def postings(self) -> DataFrame:
        """bucket, token, block, <keys>, version_id, n_tokens, tf."""
        return self.flat(self.lists)


def _unpacked(lists: DataFrame) -> DataFrame:
    return lists.select(*[name for name in lists.columns if name != "docs"], F.inline("docs"))


def _alive(rows: DataFrame, live: DataFrame) -> DataFrame:
    """Rows of runs that live; ``live`` is small and stored, so that Spark knows its size and moves no row to meet it."""
    return rows.join(live, ["version_id", "run_id"]).filter(F.col("segment") >= F.col("since")).drop("since", "run_id", "segment")


def _blocks(docs: DataFrame, keys: tuple[str, ...], segment: int) -> DataFrame:
    """Adds ``block``: documents of one segment and about one length, dealt by their keys."""
    length = F.floor(2 * F.log2(F.col("n_tokens") + F.lit(1.0))).cast("bigint")
    classed = docs.withColumn("_class", length)
    sizes = classed.groupBy("_class").agg(F.ceil(F.count(F.lit(1)) / F.lit(DOCS)).alias("_parts"))
    part = F.pmod(F.xxhash64(*keys), F.col("_parts"))
    # some sixty lengths at most: the documents stay where they lie
    return classed.join(F.broadcast(sizes), "_class").withColumn("block", F.lit(segment << 31) + F.col("_class") * F.lit(1 << 24) + part).drop("_class", "_parts")


def _counted(words: Column) -> Column:
    """array<struct<bucket, token, tf>> of a document's distinct words, in order; null where there are none."""

    @F.arrow_udf("array<struct<bucket: int, token: string, tf: int>>")
    def count(lists: pa.Array) -> pa.Array:
        tally = postings.tally(*postings.flat(lists))
        order = np.lexsort((postings.ranks(tally.words)[tally.code], tally.row))
        code, tf = tally.code[order], tally.times[order]
        own = pa.StructArray.from_arrays(
            [pa.array(postings.buckets(tally.words, BUCKETS)[code], pa.int32()), tally.words.take(pa.array(code)), pa.array(tf, pa.int32())], ["bucket", "token", "tf"]
        )
        at = np.searchsorted(tally.row, np.arange(len(lists) + 1))
        return pa.ListArray.from_arrays(pa.array(at, pa.int32()), own, mask=pa.array(at[1:] == at[:-1]))

    return count(words)


def _append(df: DataFrame, path: str, parts: list[str]) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def _write_segment(
    rows: DataFrame, n_tokens: int | None, totals: DataFrame, delivered: DataFrame, path: str, keys: tuple[str, ...], segment: int, compacted: bool
) -> None:
    """Documents or single postings (block, keys, version_id, run_id, n_tokens, lines, times) as one segment, with what belongs beside them;
    ``lines`` holds words one a line, each of which counts ``times``. ``delivered`` names the versions and runs that it holds.

    Words are counted and dealt in Arrow batches. A share is a bucket's part of the blocks, of about ``TASK_TOKENS``, and a task of its own:
    it groups and sorts in memory and leaves one file. A block lies in one share, so a list holds a block's documents at most. The first
    list of a word also says how many of the share's documents hold it (``held``, by version and run).
    """
    spark = rows.sparkSession
    parts = max(-(-(n_tokens or 0) // (TASK_TOKENS * BUCKETS)), 1)
    kept = rows.select("block", *keys, "version_id", "run_id", "n_tokens")
    schema = postings.shared_schema(kept.limit(0).toArrow().schema)
    asked = rows.select(*kept.columns, F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int").alias("part"), "times", "lines").filter(F.col("lines").isNotNull())
    dealt = asked.mapInArrow(postings.dealing(BUCKETS, parts, schema), "share int, payload binary").repartitionById(BUCKETS * parts, F.col("share"))
    fields = {f.name: f.dataType.simpleString() for f in kept.schema.fields}
    doc = ", ".join(f"`{name}`: {fields[name]}" for name in fields if name != "block")
    lists = dealt.mapInArrow(
        postings.packing(parts, schema, not compacted),
        f"bucket int, token string, block bigint, max_tf int, min_tokens {fields['n_tokens']}, docs array<struct<{doc}, tf: int>>, "
        f"held array<struct<version_id: {fields['version_id']}, run_id: string, df: bigint>>",
    )
    marked = lists.withColumn("segment", F.lit(segment).cast("bigint"))
    # by token within a file, so that the scan of some words passes over the rest
    _append(marked.sortWithinPartitions("segment", "bucket", "token", "block"), f"{path}/postings", ["segment", "bucket"])
    own = spark.read.schema(marked.schema).parquet(f"{path}/postings").filter(F.col("segment") == segment)
    counts = own.filter(F.col("held").isNotNull()).select("segment", "bucket", "token", F.inline("held"))
    _append(counts.sortWithinPartitions("segment", "bucket", "token"), f"{path}/counts", ["segment", "bucket"])
    _append(totals.withColumn("segment", F.lit(segment).cast("bigint")).coalesce(1), f"{path}/totals", ["segment"])
    listed = delivered.select("version_id", "run_id", F.lit(compacted).alias("compacted"), F.lit(segment).cast("bigint").alias("segment"))
    _append(listed.coalesce(1), f"{path}/versions", ["segment"])


def append_segment(docs: DataFrame, path: str, keys: Iterable[str], segment: int = 0, delivered: DataFrame | None = None) -> None:
    """Indexes documents (keys, version_id, tokens, n_tokens, optionally run_id) as one segment; a repeated segment replaces itself.

    A run may come in many segments, each document once; rows of a repeated document are one document. Without ``run_id`` a segment is
    a run of its own. ``delivered`` (version_id, run_id) names the versions of the segment where ``docs`` need not have a row of each.
    """
    keys = tuple(keys)
    run = F.col("run_id").cast("string") if "run_id" in docs.columns else F.lit(f"segment {segment}")
    # no word holds a line break
    lines = F.when(F.size("tokens") > 0, F.array_join("tokens", "\n"))
    docs = stored(docs.withColumn("run_id", run).select(*keys, "version_id", "run_id", "n_tokens", lines.alias("lines")), "documents-to-index")
    totals = docs.groupBy("version_id", "run_id").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    held = totals if delivered is None else delivered.select("version_id", F.col("run_id").cast("string").alias("run_id"))
    rows = _blocks(docs, keys, segment).withColumn("times", F.lit(1))
    _write_segment(rows, docs.agg(F.sum("n_tokens")).first()[0], totals, held.select("version_id", "run_id").distinct(), path, keys, segment, False)
    discard(docs, free=False)


def next_segment(spark: SparkSession, path: str) -> int:
    """The number behind the last segment's."""
    return spark.read.parquet(f"{path}/versions").agg(F.max("segment")).first()[0] + 1


def drop_versions(versions: DataFrame, path: str) -> None:
    """Takes versions out of the index: tombstones, runs without a document."""
    segment = next_segment(versions.sparkSession, path)
    listed = versions.select("version_id", F.lit(f"dropped {segment}").alias("run_id"), F.lit(False).alias("compacted"), F.lit(segment).cast("bigint").alias("segment"))
    _append(listed.distinct().coalesce(1), f"{path}/versions", ["segment"])


def live_versions(spark: SparkSession, path: str) -> DataFrame:
    """(version_id, run_id, since): the run that delivered a version last, and the segment from which on its rows count."""
    listed = spark.read.parquet(f"{path}/versions")
    last = listed.groupBy("version_id").agg(F.max_by("run_id", "segment").alias("run_id"))
    since = listed.groupBy("version_id", "run_id").agg(F.coalesce(F.max(F.when(F.col("compacted"), F.col("segment"))), F.lit(-1)).alias("since"))
    return since.join(last, ["version_id", "run_id"], "left_semi")


def _all_alive(listed: DataFrame, live: DataFrame, postings: DataFrame) -> bool:
    """Whether every posting of the folder belongs to a run that lives: nothing listed is dead and no segment lies there unlisted."""
    dead = listed.join(live, ["version_id", "run_id"], "left").filter(F.col("since").isNull() | (F.col("segment") < F.col("since")))
    if not dead.isEmpty():
        return False
    named = {f"segment={r[0]}" for r in listed.select("segment").distinct().collect()}
    return all(named.intersection(file.split("/")) for file in postings.inputFiles())


def read_index(spark: SparkSession, path: str, keys: Iterable[str]) -> SearchIndex:
    """The index as last delivered. Where no run is dead its postings are read without their runs."""
    live = stored(live_versions(spark, path), "live-versions")
    counts = spark.read.parquet(f"{path}/counts")
    totals = _alive(spark.read.parquet(f"{path}/totals"), live).groupBy("version_id").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    lists = spark.read.parquet(f"{path}/postings").drop("held")
    if not _all_alive(spark.read.parquet(f"{path}/versions"), live, lists):
        return SearchIndex(lists, live, _alive(counts, live), totals, tuple(keys))
    doc = StructType([f for f in lists.schema["docs"].dataType.elementType.fields if f.name != "run_id"])
    fields = [StructField("docs", ArrayType(doc)) if f.name == "docs" else f for f in lists.schema.fields]
    lists = spark.read.schema(StructType(fields)).parquet(f"{path}/postings")
    return SearchIndex(lists, live, counts.drop("run_id", "segment"), totals, tuple(keys))


def compact(spark: SparkSession, path: str, keys: Iterable[str]) -> int:
    """Rewrites what lives as one segment, then deletes the older ones; gives the segment's number.

    Broken off before the versions are listed, the old segments stand; after that they are dead already.
    """
    keys = tuple(keys)
    segments = [r[0] for r in spark.read.parquet(f"{path}/versions").select("segment").distinct().collect()]
    segment = next_segment(spark, path)
    live = stored(live_versions(spark, path), "live-versions")
    held = lambda rows: rows.join(live, ["version_id", "run_id"]).filter(F.col("segment") >= F.col("since"))
    flat = held(_unpacked(spark.read.parquet(f"{path}/postings").drop("max_tf", "min_tokens", "held"))).select("bucket", "token", *keys, "version_id", "run_id", "n_tokens", "tf")
    docs = _blocks(flat.select(*keys, "n_tokens").distinct(), keys, segment).select(*keys, "block")
    totals = held(spark.read.parquet(f"{path}/totals")).groupBy("version_id", "run_id").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    totals = stored(totals, "live-totals")
    rows = flat.join(docs, list(keys)).withColumnsRenamed({"token": "lines", "tf": "times"})
    _write_segment(rows, totals.agg(F.sum("n_tokens")).first()[0], totals, live, path, keys, segment, True)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name in ("postings", "counts", "totals"):
        for old in segments:
            folder = jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/segment={old}")
            folder.getFileSystem(conf).delete(folder, True)
    return segment


def build_index(docs: DataFrame, path: str, keys: Iterable[str]) -> SearchIndex:
    """A whole index in one segment, read back."""
    append_segment(docs, path, keys)
    return read_index(docs.sparkSession, path, keys)


# --- search ---------------------------------------------------------------------------------


def scope_totals(index: SearchIndex, scope: DataFrame) -> DataFrame:
    """One row (n_docs, avg_tokens) of the versions in scope."""
    own = index.totals.join(scope.select("version_id"), "version_id", "left_semi")
    return own.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n_docs"), (F.sum("n_tokens") / F.sum("n_docs")).alias("avg_tokens"))


def _part(idf: Column, tf: Column, n_tokens: Column, avg: Column) -> Column:
    return idf * tf * (K1 + 1.0) / (tf + K1 * (1.0 - B + B * n_tokens / avg))


@dataclass(frozen=True)
class Search:
    """Scored documents of a batch and the blocks it looked at: query_id, block, bound, round (null: skipped)."""

    scored: DataFrame
    blocks: DataFrame


def search(queries: DataFrame, index: SearchIndex, scope: DataFrame, depth: int, words: Iterable[str] | None = None) -> Search:
    """Best pages (query_id, slide_id, score) that hold all words of a query; at least the ``depth`` first are among them.

    A page of several documents (elements) counts by its best one.
    """
    # written first: Spark knows the size of what postings meet, and moves none of them where that is small
    versions = stored(scope.select("version_id").distinct(), "scope")
    terms = F.array_distinct(tokens(F.col("query"), words))
    asked = queries.select("query_id", terms.alias("terms")).filter(F.size("terms") > 0)
    asked = asked.select("query_id", F.size("terms").alias("n_terms"), F.explode("terms").alias("token")).withColumn("bucket", bucket_of(F.col("token"), BUCKETS))
    asked = stored(asked, "query-words")
    wanted = asked.select("bucket", "token").distinct()
    some = wanted.limit(NAMED + 1).collect()
    named = [r["token"] for r in some]
    buckets = sorted({r["bucket"] for r in some} if len(some) <= NAMED else {r[0] for r in wanted.select("bucket").distinct().collect()})  # BUCKETS numbers at most

    def scanned(table: DataFrame) -> DataFrame:
        own = table.filter(F.col("bucket").isin(buckets))
        return own.filter(F.col("token").isin(named)) if len(named) <= NAMED else own

    def held(table: DataFrame) -> DataFrame:
        return scanned(table).join(wanted, ["bucket", "token"], "left_semi")

    totals = scope_totals(index, versions)
    n_docs = totals.select(F.col("n_docs").cast("double")).scalar()
    avg = totals.select("avg_tokens").scalar()
    df = held(index.counts).join(versions, "version_id", "left_semi").groupBy("token").agg(F.sum("df").cast("double").alias("df"))
    # written, as the counts would else be read once for each of its uses
    known = stored(asked.join(df, "token"), "counted-words")
    whole = known.groupBy("query_id", "n_terms").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == F.col("n_terms")).select("query_id")
    idf = F.log(1.0 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    known = stored(known.join(whole, "query_id", "left_semi").select("query_id", "n_terms", "bucket", "token", idf.alias("idf"), avg.alias("avg")), "known-words")

    bound = F.sum(_part(F.col("idf"), F.col("max_tf"), F.col("min_tokens"), F.col("avg")))
    met = held(index.maxima).drop("bucket").join(known, "token").groupBy("query_id", "block").agg(
        F.count(F.lit(1)).alias("n"), F.first("n_terms").alias("n_terms"), bound.alias("bound")
    )
    blocks = stored(met.filter(F.col("n") == F.col("n_terms")).select("query_id", "block", "bound"), "query-blocks")

    def exact(chosen: DataFrame) -> DataFrame:
        looked = stored(chosen.select("query_id", "block").join(known, "query_id"), "looked-at")
        places = looked.select("bucket", "token", "block").distinct()
        postings = index.flat(scanned(index.lists).join(places, ["bucket", "token", "block"], "left_semi"))
        hits = looked.join(postings.join(versions, "version_id", "left_semi").drop("bucket"), ["token", "block"])
        part = _part(F.col("idf"), F.col("tf"), F.col("n_tokens"), F.col("avg"))
        scored = hits.groupBy("query_id", *index.keys).agg(F.count(F.lit(1)).alias("n"), F.first("n_terms").alias("n_terms"), F.round(F.sum(part), 6).alias("score"))
        found = scored.filter(F.col("n") == F.col("n_terms"))
        return found.groupBy("query_id", "slide_id").agg(F.max("score").alias("score")) if len(index.keys) > 1 else found.select("query_id", "slide_id", "score")

    first = top_k(blocks, ["query_id"], [F.col("bound").desc(), F.col("block")], FIRST, "at").drop("at")
    found = stored(exact(first), "first-hits")
    last = top_k(found, ["query_id"], [F.col("score").desc(), F.col("slide_id")], depth, "at").filter(F.col("at") == depth)
    threshold = last.select("query_id", F.col("score").alias("threshold"))
    rest = blocks.join(first.select("query_id", "block"), ["query_id", "block"], "left_anti").join(threshold, "query_id", "left")
    open_blocks = rest.filter(F.col("threshold").isNull() | (F.col("bound") + F.lit(SLACK) >= F.col("threshold")))
    every = found.unionByName(exact(open_blocks))
    if len(index.keys) > 1:
        every = every.groupBy("query_id", "slide_id").agg(F.max("score").alias("score"))
    rounds = first.select("query_id", "block", F.lit(1).alias("round")).unionByName(open_blocks.select("query_id", "block", F.lit(2).alias("round")))
    return Search(every, blocks.join(rounds, ["query_id", "block"], "left"))


def index_recall(queries: DataFrame, index: SearchIndex, scope: DataFrame, depth: int, words: Iterable[str] | None = None) -> DataFrame:
    """(query_id, slide_id, score, rank): pages that hold all words of a query, best BM25 of the scope first, ties by page id."""
    return top_k(search(queries, index, scope, depth, words).scored, ["query_id"], [F.col("score").desc(), F.col("slide_id")], depth)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether an index lies in the folder."""
    try:
        spark.read.parquet(f"{path}/versions")
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return False
    return True


def forget_index(index: SearchIndex) -> None:
    """Deletes the files of an index that was kept for one job."""
    for table in (index.lists, index.live, index.counts, index.totals):
        discard(table, free=False)
