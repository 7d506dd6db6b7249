"""Hard-negative mining by threshold joins over a partial inverted index, after L2AP.

Vectors are lists of integers, a score is their inner product. Anchors meet the rows in blocks: a task holds one block of
at most about ``BLOCK`` rows and lets all anchors stream by, ``STRIP`` at a time. For a threshold a block is indexed by dimension, the
one of greatest energy first: a row's last dimensions stay out of the index as long as their norm times the greatest norm of
the anchors' same dimensions stays below the threshold (suffix-norm bound); a row without an indexed dimension is no
candidate. Partial scores are accumulated over the postings, a dimension's rows being a prefix of the block sorted by how
many dimensions they index. Candidates whose partial score and remaining norms stay below the anchor's threshold
are pruned, the others are scored exactly. Thresholds start below the windows' upper ends and are lowered, with a larger
index, until every window of the strip is full or its lower end is reached; anchors that are done leave the strip.

First each anchor's best rows of its own label (positives) are found, then for each positive the best rows of other
labels in its window; a block gives what it could contribute at most, ``top_k`` merges blocks by window group limits. All
results are exact: bounds are floats with slack, scores integers.

Rows with a null id, label or vector, an empty vector or any null or non-finite component take no part. Shorter vectors count as filled up with
zeros. Identical rows count once; rows that share an id are never each other's positive or negative. Ties go to the smaller
id. Empty tables, or none of another label, give empty results; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.operators.ranks import top_k
from pagelake.session import stored

#: Rows of a block, about, and anchors that are looked at together.
BLOCK = 32768
STRIP = 64
#: Smaller inputs are cut into as many blocks as run at once, of at least so many rows.
LEAST = 2048
#: First threshold as a share of the greatest score a strip can want, and how it is lowered.
START, LOWER = 0.85, 0.6
LEVELS = 6
SLACK = 1e-9

FOUND = "anchor_id bigint, row_id bigint, window bigint, score bigint"


def integer_vectors(rows: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, label, vector array<bigint>) of the rows that take part: floor(scale * x) of each component x as a double."""
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0)
    x = F.transform("embedding", lambda c: c.cast("double"))
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return (
        rows.filter(usable).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), x.alias("x")).filter(~bad)
        .select("vec_id", "label", F.transform("x", lambda c: F.floor(F.lit(float(scale)) * c)).alias("vector")).distinct()
    )


def _matrix(vectors: list[list[int]], dims: int, kind: type) -> np.ndarray:
    out = np.zeros((len(vectors), dims), dtype=kind)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _dense(column: pa.Array) -> np.ndarray:
    """A list column as a matrix, short rows filled up with zeros; Python numbers where doubles would not be exact."""
    column = column.cast(pa.large_list(pa.int64()))
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    dims = int(sizes.max(initial=0))
    if len(flat) and max(int(flat.max()), -int(flat.min())) ** 2 * dims >= 1 << 52:
        return _matrix(column.to_pylist(), dims, object)
    if (sizes == dims).all():
        return flat.reshape(len(sizes), dims).astype(np.float64)
    return _matrix(column.to_pylist(), dims, np.float64)


def _suffix_norms(m: np.ndarray) -> np.ndarray:
    """Column p: norm of the components from p on; the last column is 0."""
    squares = np.square(m.astype(np.float64))
    out = np.zeros((m.shape[0], m.shape[1] + 1))
    out[:, :-1] = np.sqrt(np.cumsum(squares[:, ::-1], axis=1)[:, ::-1])
    return out


class Block:
    """Rows of one block, their dimensions by falling energy, and the index for a threshold."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, matrix: np.ndarray) -> None:
        self.order = np.argsort(-np.square(matrix.astype(np.float64)).sum(axis=0), kind="stable")
        self.ids, self.labels, self.matrix = ids, labels, matrix[:, self.order]
        self.norms = _suffix_norms(self.matrix)

    def turned(self, anchors: np.ndarray) -> np.ndarray:
        """Anchors with the block's dimensions, in its order."""
        dims = self.matrix.shape[1]
        if anchors.shape[1] < dims:
            anchors = np.concatenate([anchors, np.zeros((len(anchors), dims - anchors.shape[1]), anchors.dtype)], axis=1)
        return anchors[:, self.order]

    def candidates(self, anchors: np.ndarray, norms: np.ndarray, threshold: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor places, row places, scores): all pairs whose score reaches the anchor's threshold, exactly scored."""
        n, dims = self.matrix.shape
        low = threshold.min()
        if low > 0:
            covered = self.norms * norms.max(axis=0)[None, :] * (1 + SLACK) < low
            # covered suffixes end the row, so the first covered place is the number of indexed dimensions
            indexed = np.argmax(covered, axis=1)
        else:
            indexed = np.full(n, dims)
        by_size = np.argsort(-indexed, kind="stable")
        sizes = indexed[by_size]
        holding = np.searchsorted(-sizes, -np.arange(1, dims + 1), side="right")  # rows with a posting in each dimension
        some = int(holding[0]) if dims else 0
        if not some:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        postings = self.matrix[by_size[:some]]
        partial = np.zeros((len(anchors), some), dtype=np.result_type(anchors.dtype, postings.dtype))
        d = 0
        while d < dims and holding[d]:
            to = d + 1  # dimensions that the same rows index go together
            while to < dims and holding[to] == holding[d]:
                to += 1
            partial[:, : holding[d]] += anchors[:, d:to] @ postings[: holding[d], d:to].T
            d = to
        rest = norms[:, sizes[:some]] * self.norms[by_size[:some], sizes[:some]][None, :]
        reach = partial.astype(np.float64) + rest * (1 + SLACK) + SLACK * np.abs(partial.astype(np.float64)) + SLACK
        a, r = np.nonzero(reach >= threshold[:, None])
        score = partial[a, r]
        left = sizes[r] < dims
        if left.any():
            # the omitted dimensions of what is left, summed exactly
            keep = np.arange(dims)[None, :] >= sizes[:some][:, None]
            outside = np.where(keep, postings, 0)
            for at in range(0, len(a), 1 << 16):
                part = slice(at, at + (1 << 16))
                score[part] = score[part] + (anchors[a[part]] * outside[r[part]]).sum(axis=1)
        exact = np.array([min(max(int(s), -(1 << 63)), (1 << 63) - 1) for s in score], np.int64) if score.dtype == object else score.astype(np.int64)
        stands = exact >= threshold[a]
        return a[stands], by_size[r[stands]], exact[stands]


def _lowered(highest: np.ndarray, floor: np.ndarray) -> Iterator[np.ndarray]:
    """Falling thresholds between what an anchor wants at most and the least it may take; the last is that least."""
    level = START
    for _ in range(LEVELS):
        now = np.where(highest > 0, highest * level, floor)
        yield np.maximum(now, floor)
        level *= LOWER
    yield floor


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest scores, ties by id."""
    if len(scores) > 4 * k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= kth)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))[:k]]


def positives_in(block: Block, ids: np.ndarray, labels: np.ndarray, anchors: np.ndarray, k: int) -> Iterator[tuple[int, int, int, int]]:
    """(anchor, row, 0, score): each anchor's k best other rows of its label in the block."""
    turned = block.turned(anchors)
    norms = _suffix_norms(turned)
    waiting = np.arange(len(ids))
    highest = norms[:, 0] * block.norms[:, 0].max(initial=0.0)
    for now in _lowered(highest, np.full(len(ids), -np.inf)):
        a, r, score = block.candidates(turned[waiting], norms[waiting], now[waiting])
        own = waiting[a]
        fits = (labels[own] == block.labels[r]) & (ids[own] != block.ids[r])
        a, r, score = a[fits], r[fits], score[fits]
        edges = np.searchsorted(a, np.arange(len(waiting) + 1))
        last = np.isneginf(now[waiting])
        done = (np.diff(edges) >= k) | last
        for i in np.flatnonzero(done):
            mine = slice(edges[i], edges[i + 1])
            for j in _best(block.ids[r[mine]], score[mine], k):
                yield int(ids[waiting[i]]), int(block.ids[r[mine][j]]), 0, int(score[mine][j])
        waiting = waiting[~done]
        if not len(waiting):
            return


def negatives_in(
    block: Block, ids: np.ndarray, labels: np.ndarray, anchors: np.ndarray, windows: list[list[tuple[int, int, int]]], k: int
) -> Iterator[tuple[int, int, int, int]]:
    """(anchor, row, window, score): for each window (name, low, high) of each anchor its k best rows of other labels in the block."""
    turned = block.turned(anchors)
    norms = _suffix_norms(turned)
    waiting = np.arange(len(ids))
    highest = np.array([float(max(w[2] for w in own)) for own in windows])
    floor = np.array([float(min(w[1] for w in own)) for own in windows])
    for now in _lowered(highest, floor):
        a, r, score = block.candidates(turned[waiting], norms[waiting], now[waiting])
        own = waiting[a]
        fits = (labels[own] != block.labels[r]) & (ids[own] != block.ids[r])
        a, r, score = a[fits], r[fits], score[fits]
        edges = np.searchsorted(a, np.arange(len(waiting) + 1))
        done = np.zeros(len(waiting), dtype=bool)
        for i, w in enumerate(waiting):
            mine = slice(edges[i], edges[i + 1])
            s, found = score[mine], block.ids[r[mine]]
            inside = [np.flatnonzero((s >= lo) & (s <= hi)) for _, lo, hi in windows[w]]
            done[i] = all(len(x) >= k or now[w] <= lo for x, (_, lo, _) in zip(inside, windows[w], strict=True))
            if done[i]:
                for x, (name, _, _) in zip(inside, windows[w], strict=True):
                    for j in x[_best(found[x], s[x], k)]:
                        yield int(ids[w]), int(found[j]), name, int(s[j])
        waiting = waiting[~done]
        if not len(waiting):
            return


def _joined(items: DataFrame, anchors: DataFrame, blocks: int, find: Callable, rows_schema: str) -> DataFrame:
    """Every anchor row with every block of ``items``; ``find(block, anchor columns)`` gives what a block contributes.

    A block's rows come before its anchors in a sorted stream, so a task holds one block and one strip of anchors.
    """
    none = [F.lit(None).cast(t).alias(n) for n, t in (("windows", "array<struct<name:bigint,low:bigint,high:bigint>>"),)]
    block_rows = items.select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("kind"), "vec_id", "label", "vector", *none)
    asked = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), "vec_id", "label", "vector", "windows")
    both = block_rows.unionByName(asked).repartition("block").sortWithinPartitions("block", "kind")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        strip: list[pa.Table] = []
        block: Block | None = None
        names = ["anchor_id", "row_id", "window", "score"]

        def ask() -> pa.RecordBatch:
            t = pa.concat_tables(strip).combine_chunks()
            strip.clear()
            vectors = _dense(t.column("vector").combine_chunks())
            out = list(find(block, t.column("vec_id").to_numpy(), t.column("label").to_numpy(), vectors, t.column("windows").to_pylist()))
            cols = list(zip(*out, strict=True)) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)

        own = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            keys = np.stack([table.column(c).to_numpy() for c in ("block", "kind")], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    continue
                number, kind = keys[lo]
                part = table.slice(lo, hi - lo)
                if number != own:
                    if strip:
                        yield ask()
                    held, block, own = [], None, number
                if kind == 0:
                    held.append(part)
                    continue
                if block is None and held:
                    t = pa.concat_tables(held).combine_chunks()
                    block = Block(t.column("vec_id").to_numpy(), t.column("label").to_numpy(), _dense(t.column("vector").combine_chunks()))
                    held = []
                if block is None:
                    continue
                for at in range(0, part.num_rows, STRIP):
                    strip.append(part.slice(at, STRIP))
                    if sum(p.num_rows for p in strip) >= STRIP:
                        yield ask()
        if strip:
            yield ask()

    return both.mapInArrow(work, rows_schema)


def mine(items: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, block: int = BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from (vec_id, label, vector).

    A negative's score lies between ``low`` and ``high`` hundredths of the positive's.
    """
    items = stored(items.select("vec_id", "label", "vector"), "vectors")
    n = items.count()
    blocks = max(1, -(-n // block), min(items.sparkSession.sparkContext.defaultParallelism, -(-n // LEAST)))
    no_windows = F.lit(None).cast("array<struct<name:bigint,low:bigint,high:bigint>>")
    anchors = items.filter(is_anchor)

    def find_positives(b: Block, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, _: list) -> Iterator[tuple]:
        return positives_in(b, ids, labels, vectors, positives)

    def find_negatives(b: Block, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, windows: list) -> Iterator[tuple]:
        return negatives_in(b, ids, labels, vectors, [[(w["name"], w["low"], w["high"]) for w in own] for own in windows], negatives)

    order = [F.col("score").desc(), F.col("row_id")]
    near = top_k(_joined(items, anchors.withColumn("windows", no_windows), blocks, find_positives, FOUND), ["anchor_id"], order, positives)
    # a window of no positive score is empty or holds score 0 alone
    chosen = stored(near.filter("score >= 0").select("anchor_id", F.col("row_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    windows = chosen.groupBy("anchor_id").agg(
        F.collect_list(  # at most ``positives`` of an anchor
            F.struct(
                F.col("positive_id").alias("name"),
                F.expr(f"(positive_score * {low} + 99) div 100").alias("low"),
                F.expr(f"positive_score * {high} div 100").alias("high"),
            )
        ).alias("windows")
    )
    asked = anchors.join(windows, F.col("vec_id") == F.col("anchor_id")).select("vec_id", "label", "vector", "windows")
    found = top_k(_joined(items, asked, blocks, find_negatives, FOUND), ["anchor_id", "window"], order, negatives)
    return found.join(chosen, (found["anchor_id"] == chosen["anchor_id"]) & (found["window"] == chosen["positive_id"])).select(
        found["anchor_id"], "positive_id", "rank", F.col("row_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def mine_embeddings(embeddings: DataFrame) -> DataFrame:
    """Hard negatives of a table (vec_id, embedding, label): every hundredth id is an anchor, every seventh has the next label of ten."""
    rows = integer_vectors(embeddings)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)
