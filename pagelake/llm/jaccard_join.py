"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

A document is its set of distinct word shingles. Equal sets become one node first. All shingles are
ordered by how often they occur (a sketch of counts over all documents, then the shingle's hash), rare ones first; two
sets that reach the threshold share a shingle among their first n - ceil(t * n) + 1. Documents meet on these prefix
shingles. A meeting stands if lengths allow the threshold (length filter) and so do the shingles left behind both
places (positional filter); each pair's sets are then bounded by how they fall on 64 fixed ranges of hashes (suffix filter),
and what is left is counted exactly, once per pair.

No group is expanded into all its pairs. First each document meets one leader of each of its prefix shingles, the set
that shares most with others, and is verified against the two with the most in common; that links groups of copies. Then only members of different components meet, component against component, and every such pair that
passes the filters is verified. So components are exact and no pair that could join two of them is left out.
Pairs inside a component are met by ``links`` only, which counts the links of each distinct set.

Nulls and texts without words have an empty set and no links; with fewer words than a shingle the whole
sequence is the one shingle. Rows of one doc_id count as one node where each is the smallest of its equal
sets; rows without doc_id have no component. Empty tables give empty results; columns of any name pass through
``keep_first``. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagelake.llm.words import FOLDED, ODD, Block, forget, hashes, mix, text_blocks, windows, words
from pagelake.operators.components import components
from pagelake.session import discard, release, stored

SHINGLE = 5
PERCENT = 80
#: Cells of the sketch of shingle counts and of one slice of it. Its size changes the order's quality, never the result.
CELLS = 1 << 20
SLICE = 1 << 14
#: Ranges of hashes of the suffix filter.
RANGES = 64
#: Leaders a document is verified against before components are known.
LEADERS = 2
#: Nodes of one shingle that meet in one block of ``links``, about.
MEETING_ROWS = 1024


def shingle_sets(block: Block, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes, row of each), by row and hash."""
    found = words(block)
    h = hashes(block, found, FOLDED)
    row, n = found.rows(), np.diff(found.first)
    parts, owners = [], []
    if len(h) >= width:
        at = np.flatnonzero(row[: len(h) - width + 1] == row[width - 1 :])
        parts.append(windows(h, width)[at])
        owners.append(row[at])
    for few in range(1, width):
        short = np.flatnonzero(n == few)
        if len(short):
            parts.append(mix(windows(h, few)[found.first[short]] + np.uint64(few)))
            owners.append(short)
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    v, r = np.concatenate(parts), np.concatenate(owners)
    order = np.lexsort((v, r))
    v, r = v[order], r[order]
    new = np.ones(len(v), dtype=bool)
    new[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    return v[new], r[new]


def _cells(v: np.ndarray) -> np.ndarray:
    return (v & np.uint64(CELLS - 1)).astype(np.int64)


def _figures(texts: DataFrame) -> DataFrame:
    """Per document its set's size, two sums that tell sets apart and its counts by range; besides, slices of each task's shingle counts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        names = ["doc_id", "n", "s1", "s2", "spread", "slice", "cells", "counts"]
        counts = np.zeros(CELLS, np.int32)
        for batch in batches:
            cols: list[list] = [[], [], [], []]
            for block in text_blocks(batch.column(1)):
                v, row = shingle_sets(block)
                counts += np.bincount(_cells(v), minlength=CELLS).astype(np.int32)
                edges = np.searchsorted(row, np.arange(block.rows + 1))
                for out, salt in zip(cols[1:3], (np.uint64(1), ODD), strict=True):
                    total = np.zeros(len(v) + 1, np.uint64)
                    np.cumsum(mix(v ^ salt), dtype=np.uint64, out=total[1:])
                    out.append((total[edges[1:]] - total[edges[:-1]]).view(np.int64))
                cols[0].append(np.diff(edges))
                spread = np.bincount(row * RANGES + (v >> np.uint64(58)).astype(np.int64), minlength=block.rows * RANGES).astype("<u4").reshape(-1, RANGES)
                cols[3] += [x.tobytes() for x in spread]
            m = batch.num_rows
            none = [pa.nulls(m, t) for t in (pa.int32(), pa.binary(), pa.binary())]
            figures = [pa.array(np.concatenate(c).astype(np.int64) if c else np.zeros(0, np.int64)) for c in cols[:3]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *figures, pa.array(cols[3], pa.binary()), *none], names)
        for s in range(CELLS // SLICE):
            own = counts[s * SLICE : (s + 1) * SLICE]
            some = np.flatnonzero(own)
            if len(some):
                none = [pa.nulls(1, t) for t in (pa.int64(),) * 4 + (pa.binary(),)]
                yield pa.RecordBatch.from_arrays(
                    [*none, pa.array([s], pa.int32()), pa.array([some.astype(np.uint16).tobytes()], pa.binary()), pa.array([own[some].tobytes()], pa.binary())], names
                )

    return texts.mapInArrow(work, "doc_id bigint, n bigint, s1 bigint, s2 bigint, spread binary, slice int, cells binary, counts binary")


def _sketch(figures: DataFrame) -> np.ndarray:
    """Rarity class of each cell, from the counts of all documents: a byte, in eighths of a power of two."""

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(SLICE, np.int64)
        for c, n in zip(table.column("cells").to_pylist(), table.column("counts").to_pylist(), strict=True):
            total[np.frombuffer(c, np.uint16)] += np.frombuffer(n, np.int32)
        return pa.table({"slice": table.column("slice")[:1], "counts": pa.array([np.round(8 * np.log2(total + 1)).clip(0, 255).astype(np.uint8).tobytes()], pa.binary())})

    out = np.zeros(CELLS, np.uint8)
    summed = figures.filter("slice is not null").select("slice", "cells", "counts").groupBy("slice").applyInArrow(add, "slice int, counts binary")
    for r in summed.collect():  # CELLS bytes
        out[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = np.frombuffer(r["counts"], np.uint8)
    return out


def _prefixes(texts: DataFrame, rarity: np.ndarray, percent: int) -> DataFrame:
    """(doc_id, n, prefix): each set's first shingles, rare ones first."""
    shared = texts.sparkSession.sparkContext.broadcast(rarity)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        classes = shared.value
        for batch in batches:
            sizes, prefixes = [], []
            for block in text_blocks(batch.column(1)):
                v, row = shingle_sets(block)
                order = np.lexsort((v, classes[_cells(v)], row))
                v = v[order].view(np.int64)
                edges = np.searchsorted(row, np.arange(block.rows + 1)).tolist()
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    n = b - a
                    sizes.append(n)
                    prefixes.append(v[a : a + n - -(-percent * n // 100) + 1] if n else v[:0])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), pa.array(prefixes, pa.list_(pa.int64()))], ["doc_id", "n", "prefix"])

    return texts.mapInArrow(work, "doc_id bigint, n int, prefix array<bigint>")


def _possible(na: Column, pa_: Column, nb: Column, pb: Column, percent: int) -> Column:
    """Length filter and positional filter of a meeting at places ``pa_`` and ``pb`` (from 0)."""
    lengths = F.least(na, nb) * 100 >= F.greatest(na, nb) * percent
    room = F.least(na - pa_, nb - pb)
    return lengths & (room * (100 + percent) >= (na + nb) * percent)


def _verified(pairs: DataFrame, sets_of: DataFrame, spreads: DataFrame, percent: int) -> DataFrame:
    """(u, v) of the pairs (a, b) whose sets reach the threshold: suffix filter, then an exact count."""

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u4").reshape(-1, RANGES).astype(np.int64) for i in (2, 3))
            keep = np.minimum(x, y).sum(1) * (100 + percent) >= (x.sum(1) + y.sum(1)) * percent
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            out = []
            for block in text_blocks(batch.column(1)):
                v, row = shingle_sets(block)
                edges = np.searchsorted(row, np.arange(block.rows + 1)).tolist()
                out += [v[p:q].tobytes() for p, q in zip(edges[:-1], edges[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "own"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                v, w = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate([v, w])
                both.sort()
                same = int((both[1:] == both[:-1]).sum())
                keep.append(100 * same >= percent * (len(both) - same))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    side = lambda df, key, value, out: df.select(F.col("doc_id").alias(key), F.col(value).alias(out))
    met = pairs.join(side(spreads, "a", "spread", "x"), "a").join(side(spreads, "b", "spread", "y"), "b")
    left = stored(met.select("a", "b", "x", "y").mapInArrow(bounded, "a bigint, b bigint"), "bounded-pairs")
    release(pairs.sparkSession)
    needed = left.select(F.col("a").alias("doc_id")).unionByName(left.select(F.col("b").alias("doc_id"))).distinct()
    own = stored(sets_of.join(needed, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(sets, "doc_id bigint, own binary"), "sets")
    release(pairs.sparkSession)
    both = left.join(side(own, "a", "own", "x"), "a").join(side(own, "b", "own", "y"), "b")
    edges = stored(both.select("a", "b", "x", "y").mapInArrow(count, "u bigint, v bigint"), "links")
    discard(left, free=False)
    discard(own)
    return edges


def _met(docs: DataFrame, id_col: str, text_col: str, percent: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Texts; figures per row; (n, s1, s2, node) per set, its node the least doc_id; counts by range per node; nodes by prefix shingle that several have."""
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    figures = stored(_figures(texts), "shingle-figures")
    facts = figures.filter("slice is null").select("doc_id", "n", "s1", "s2", "spread")
    equal = facts.filter("doc_id is not null and n > 0").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("node"))
    equal = stored(equal, "equal-sets")
    nodes = stored(equal.select(F.col("node").alias("doc_id"), F.col("n").cast("int").alias("n")).distinct(), "nodes")
    spreads = facts.join(nodes, ["doc_id", "n"], "left_semi").select("doc_id", "spread").distinct()
    prefixes = _prefixes(texts.filter("doc_id is not null"), _sketch(figures), percent)
    prefixes = stored(prefixes.join(nodes, ["doc_id", "n"], "left_semi").dropDuplicates(["doc_id", "n"]), "prefixes")
    postings = prefixes.select("doc_id", "n", F.posexplode("prefix").alias("at", "token"))
    often = postings.groupBy("token").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("token")
    meetings = stored(postings.join(often, "token"), "meetings")
    discard(prefixes)
    return texts, facts, equal, spreads, meetings


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """Per distinct set: doc_id (the least that has it), n_links, the other distinct sets that reach the threshold with it.

    Every pair of sets that the filters leave is verified, also within a component, so this costs as much as there are
    such pairs. Nodes of one shingle meet in blocks of ``MEETING_ROWS``, block with block, so no task holds a long list.
    """
    texts, _, equal, spreads, meetings = _met(docs, id_col, text_col, percent)
    sizes = meetings.groupBy("token").agg(F.ceil(F.count(F.lit(1)) / F.lit(MEETING_ROWS)).cast("int").alias("blocks"))
    dealt = meetings.join(sizes, "token").withColumn("block", F.pmod(F.xxhash64("doc_id", "n"), F.col("blocks")).cast("int"))
    tile = lambda lo, hi, s: dealt.select(
        "token", F.explode(F.sequence(lo, hi)).alias("other"), "block", *[F.col(c).alias(f"{c}_{s}") for c in ("doc_id", "n", "at")]
    )
    left = tile(F.col("block"), F.col("blocks") - 1, "a").withColumnsRenamed({"block": "i", "other": "j"})
    right = tile(F.lit(0), F.col("block"), "b").withColumnsRenamed({"other": "i", "block": "j"})
    pairs = left.join(right, ["token", "i", "j"]).filter("doc_id_a < doc_id_b or (i < j and doc_id_a > doc_id_b)").filter(
        _possible(F.col("n_a"), F.col("at_a"), F.col("n_b"), F.col("at_b"), percent)
    )
    pairs = stored(pairs.select(F.least("doc_id_a", "doc_id_b").alias("a"), F.greatest("doc_id_a", "doc_id_b").alias("b")).distinct(), "pairs")
    edges = _verified(pairs, texts, spreads, percent).distinct()
    ends = edges.select(F.explode(F.array("u", "v")).alias("doc_id")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_links"))
    sets = equal.select(F.col("node").alias("doc_id")).distinct()
    return sets.join(ends, "doc_id", "left").select("doc_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, the least doc_id that links reach (itself included)."""
    texts, facts, equal, spreads, meetings = _met(docs, id_col, text_col, percent)

    # A text that others were edited from shares most of its prefix with many; edited ones have rare shingles of their own.
    lists = meetings.groupBy("token").agg(F.log2(F.count(F.lit(1)).cast("double")).alias("size"))
    central = meetings.join(lists, "token").groupBy("doc_id").agg(F.round(F.sum("size"), 3).alias("central"))
    leaders = meetings.join(central, "doc_id").groupBy("token").agg(F.max_by(F.struct("n", "doc_id", "at"), F.struct("central", -F.col("doc_id"))).alias("lead"))
    led = meetings.join(leaders, "token").filter(F.col("doc_id") != F.col("lead.doc_id")).filter(
        _possible(F.col("n"), F.col("at"), F.col("lead.n"), F.col("lead.at"), percent)
    )
    tally = led.groupBy("doc_id", F.col("lead.doc_id").alias("lead")).agg(F.count(F.lit(1)).alias("common"))
    best = tally.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("common"), "lead"))).filter(F.col("rank") <= LEADERS)
    first = stored(best.select(F.least("doc_id", "lead").alias("a"), F.greatest("doc_id", "lead").alias("b")).distinct(), "first-pairs")
    release(docs.sparkSession)
    edges = _verified(first, texts, spreads, percent)

    comp = components(edges)
    release(docs.sparkSession)
    marked = stored(
        meetings.join(comp, F.col("doc_id") == F.col("node"), "left").select("token", "doc_id", "n", "at", F.coalesce("component", "doc_id").alias("comp")),
        "marked-meetings",
    )
    discard(meetings, free=False)
    groups = marked.groupBy("token", "comp").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max(F.col("n") - F.col("at")).alias("room"))
    several = groups.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("token")
    groups = groups.join(several, "token")
    left, right = (groups.select("token", *[F.col(c).alias(f"{c}_{s}") for c in ("comp", "least", "most", "room")]) for s in "ab")
    apart = left.join(right, "token").filter("comp_a < comp_b").filter(
        (F.col("most_a") * 100 >= F.col("least_b") * percent) & (F.col("most_b") * 100 >= F.col("least_a") * percent)
        & (F.least("room_a", "room_b") * (100 + percent) >= (F.col("least_a") + F.col("least_b")) * percent)
    ).select("token", "comp_a", "comp_b")
    members = lambda s: marked.select("token", F.col("comp").alias(f"comp_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in ("doc_id", "n", "at")])
    rest = apart.join(members("a"), ["token", "comp_a"]).join(members("b"), ["token", "comp_b"]).filter(
        _possible(F.col("n_a"), F.col("at_a"), F.col("n_b"), F.col("at_b"), percent)
    )
    rest = stored(
        rest.select(F.least("doc_id_a", "doc_id_b").alias("a"), F.greatest("doc_id_a", "doc_id_b").alias("b")).distinct().join(first, ["a", "b"], "left_anti"), "later-pairs"
    )
    discard(marked)
    comp = components(edges.unionByName(_verified(rest, texts, spreads, percent)))
    named = equal.join(comp, "node", "left").select("n", "s1", "s2", F.coalesce("component", "node").alias("component_id"))
    return facts.join(named, ["n", "s1", "s2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row of each component of ``docs``, that of its least doc_id, with its own columns; rows without an id stay."""
    kept = linked(docs, id_col, text_col, percent).filter("doc_id = component_id").select(F.col("doc_id").alias("_kept")).distinct()
    joined = docs.join(kept, docs[id_col].cast("bigint") == F.col("_kept"), "left_semi")
    return joined.unionByName(docs.filter(docs[id_col].isNull()))
