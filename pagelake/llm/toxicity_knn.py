"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Examples are a bounded sample of labelled documents (``EXAMPLES`` rows, ``EXAMPLE_BYTES`` of text). Their vectors hold all
their words, weighted by TF-IDF times the word's correlation with the label, of length one; words that do not go with
label 1 keep the share ``FLOOR`` of their TF-IDF, since with plain weights a few insults in a page drown in its topic.
The index keeps postings by word, cut into blocks of example numbers, and the largest weight of each word in each block it
occurs in. A text's blocks are visited by falling bound and left once none can reach the k-th best cosine,
so the neighbours are exact. Votes weigh by closeness; a logistic map fitted on examples (each judged without itself)
makes votes probabilities. The index is fitted by one task on that bounded sample. It travels packed (words, and by posting
the example and the count) through the driver to all tasks as one value, bounded by the two parameters; a worker
makes weights, cells and maxima of it once. Documents are scored where they lie, by all of their words that an example has.

Nulls and empty texts, and texts without a word of any example, get the share of toxic ones among such examples.
Repeated texts get equal scores; of several rows of a labelled doc_id the greatest text is the example. Texts over
``LONGEST`` bytes are scored whole but are no examples. Without labels, or with labels of one kind only, every score is that kind's share. Ties
between neighbours go to the smaller doc_id. Columns of any name pass through ``keep_clean`` untouched.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pagelake.llm.words import FOLDED, NOT_ALNUM, Block, forget, hashes, text_blocks, words
from pagelake.session import cut

#: Labelled documents that serve as examples, bytes of their texts together, and of one of them.
EXAMPLES = 5_000
EXAMPLE_BYTES = 32 << 20
LONGEST = 1 << 20
#: Examples that the map from votes to probabilities is fitted on.
CALIBRATION = 2_000
#: Part of a word's TF-IDF that it keeps without any correlation with the label.
FLOOR = 0.01
NEIGHBOURS = 15
BLOCK = 128
FIRST_BLOCKS = 2
FOLDS = 5


def _runs(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The numbers lo..hi-1 of all pairs, one after the other."""
    n = hi - lo
    return np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())


@dataclass
class Index:
    """Postings in block order and block maxima over unit vectors of the examples."""

    keys: np.ndarray  # sorted word hashes
    idf: np.ndarray  # weight of each word
    labels: np.ndarray
    ids: np.ndarray
    empty_share: float
    first: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))  # first posting of each word
    owner: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # example of each posting, and how often it has the word
    count: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    norm: np.ndarray = field(default_factory=lambda: np.zeros(0))  # of each example's vector before it gets length one
    slope: float = 1.0
    shift: float = 0.0
    made: tuple[np.ndarray, ...] | None = None  # what ``postings`` makes of the others; does not travel

    def __getstate__(self) -> dict:
        return vars(self) | {"made": None}

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        w = (1 + np.log(counts)) * self.idf[terms]
        return w / np.sqrt((w * w).sum())

    def build(self, examples: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """examples: (terms, counts) in the order of ``ids``; the closer like ones lie, the tighter the bounds."""
        term = np.concatenate([t for t, _ in examples]) if examples else np.zeros(0, np.int64)
        count = np.concatenate([c for _, c in examples]) if examples else np.zeros(0, np.int64)
        own = np.repeat(np.arange(len(examples)), [len(t) for t, _ in examples])
        weights = [(1 + np.log(c)) * self.idf[t] for t, c in examples]
        self.norm = np.sqrt([(w * w).sum() for w in weights])
        order = np.lexsort((own, term))
        self.first = np.searchsorted(term[order], np.arange(len(self.keys) + 1))
        self.owner = own[order].astype(np.min_scalar_type(len(examples)))
        self.count = count[order].astype(np.min_scalar_type(int(count.max(initial=0))))
        self.made = None

    def postings(self) -> tuple[np.ndarray, ...]:
        """Example and weight of each posting; of each word the first cell (a word in a block); of each cell first posting, block and largest weight."""
        if self.made is None:
            blocks = -(-max(len(self.ids), 1) // BLOCK)
            owner, term = self.owner.astype(np.int64), np.repeat(np.arange(len(self.keys)), np.diff(self.first))
            weight = (1 + np.log(self.count.astype(np.int64))) * self.idf[term] / self.norm[owner]
            at = term * blocks + owner // BLOCK
            start = np.flatnonzero(np.diff(at, prepend=-1))
            cell = at[start]
            top = np.maximum.reduceat(weight, start) if len(start) else np.zeros(0)
            self.made = owner, weight, np.searchsorted(cell // blocks, np.arange(len(self.keys) + 1)), np.append(start, len(at)), cell % blocks, top
        return self.made

    def nearest(self, terms: np.ndarray, vector: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of highest cosine above 0 and their cosines."""
        owner, weight, cell, start, block, top = self.postings()
        lo, hi = cell[terms], cell[terms + 1]
        cells, q = _runs(lo, hi), np.repeat(vector, hi - lo)
        own = block[cells]
        bound = np.bincount(own, q * top[cells])
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        near, cosine, step = np.zeros(0, np.int64), np.zeros(0), FIRST_BLOCKS
        while len(order):
            # Blocks by falling bound until there are k neighbours; all that these cannot rule out then follow together.
            now = order[:step] if len(cosine) < k else order[bound[order] >= cosine[-1] - 1e-12]
            if not len(now):
                break
            wanted = np.zeros(len(bound), dtype=bool)
            wanted[now] = True
            use = np.flatnonzero(wanted[own])
            asked = cells[use]
            first, last = start[asked], start[asked + 1]
            at = _runs(first, last)
            scores = np.bincount(owner[at], np.repeat(q[use], last - first) * weight[at]).round(12)
            if len(scores) > 4 * k:
                hit = np.flatnonzero(scores >= max(np.partition(scores, -k)[-k], 1e-12))
            else:
                hit = np.flatnonzero(scores > 0)
            near, cosine = np.concatenate([near, hit]), np.concatenate([cosine, scores[hit]])
            best = np.lexsort((self.ids[near], -cosine))[:k]
            near, cosine = near[best], cosine[best]
            order, step = order[len(now) :], 2 * step
        return near, cosine

    def vote(self, near: np.ndarray, cosine: np.ndarray) -> float:
        """Share of label 1 among the neighbours, each weighing by its closeness; one vote for the examples' own share."""
        w = 1 / (1.05 - cosine)
        prior = self.labels.mean() if len(self.labels) else 0.0
        return float((w @ self.labels[near] + prior) / (w.sum() + 1))

    def score(self, vote: float) -> float:
        v = min(max(vote, 1e-6), 1 - 1e-6)
        return float(1 / (1 + np.exp(-np.clip(self.slope * np.log(v / (1 - v)) + self.shift, -30, 30))))

    def calibrate(self, examples: list[tuple[np.ndarray, np.ndarray]], k: int) -> None:
        """Logistic map from votes to labels; each example votes without itself."""
        x, y = [], []
        chosen = np.argsort(self.ids * np.int64(0x9E3779B97F4A7C1), kind="stable")[:CALIBRATION]
        for i in chosen.tolist():
            t, c = examples[i]
            near, cosine = self.nearest(t, self.vector(t, c), k + 1)
            other = near != i
            v = min(max(self.vote(near[other][:k], cosine[other][:k]), 1e-6), 1 - 1e-6)
            x.append(np.log(v / (1 - v)))
            y.append(self.labels[i])
        if len(set(y)) < 2:
            return
        a, b = np.array([x, np.ones(len(x))]).T, np.array(y, dtype=float)
        w = np.array([1.0, 0.0])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            w = w + np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 0.1 * np.eye(2), a.T @ (b - p) - 0.1 * (w - [1, 0]))
        if w[0] > 0:
            self.slope, self.shift = float(w[0]), float(w[1])


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, limit: int) -> DataFrame:
    """(_id, toxic, text) of the sample: ids by hash, then their texts by a join with that bounded list."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("_id"), F.col("toxic").cast("int").alias("toxic")).filter("_id is not null and toxic in (0, 1)")
    known = known.filter(F.crc32(F.col("_id").cast("string")) % FOLDS != 0).groupBy("_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    short = texts.filter(F.octet_length("text") <= LONGEST)
    ids = short.select("_id").distinct().join(known, "_id").orderBy(F.xxhash64("_id"), "_id").limit(limit)
    found = cut(short.join(F.broadcast(ids), "_id").groupBy("_id", "toxic").agg(F.max("text").alias("text")))
    so_far = F.sum(F.octet_length("text")).over(Window.orderBy(F.xxhash64("_id"), "_id"))
    within = found.select("_id", so_far.alias("bytes")).filter(F.col("bytes") <= EXAMPLE_BYTES).select("_id")
    return found.join(F.broadcast(within), "_id")


def _counted(block: Block, keys: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct word hashes of each row (places in ``keys``, where given, of the words found there) and their counts."""
    found = words(block, NOT_ALNUM)
    h, edges = hashes(block, found, FOLDED), found.first
    if keys is not None:
        at = np.searchsorted(keys, h)
        hit = np.flatnonzero(keys[np.minimum(at, len(keys) - 1)] == h) if len(keys) else np.zeros(0, np.int64)
        h, edges = at[hit], np.searchsorted(hit, edges)
    for r in range(block.rows):
        yield np.unique(h[edges[r] : edges[r + 1]], return_counts=True)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", examples: int = EXAMPLES, neighbours: int = NEIGHBOURS) -> Index:
    """Index over at most ``examples`` labelled documents that are not held out (labels: doc_id, toxic)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            made = [x for block in text_blocks(batch.column(2)) for x in _counted(block)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([h.tobytes() for h, _ in made], pa.binary()), pa.array([n.astype(np.int32).tobytes() for _, n in made], pa.binary())],
                ["_id", "toxic", "words", "counts"],
            )

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        rows = sorted(row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(_fitted(rows, neighbours), protocol=5)], pa.binary())], ["index"])

    sample = _sample(docs, labels, id_col, text_col, examples).select("_id", "toxic", "text")
    counted = sample.mapInArrow(count, "_id bigint, toxic int, words binary, counts binary")
    # One task takes what is a bounded sample; the driver, whose memory all stages share, gets the packed index only.
    made = counted.repartition(1).mapInArrow(fit, "index binary").collect()
    return pickle.loads(made[0]["index"]) if made else _fitted([], neighbours)


def _fitted(rows: list[tuple[int, int, bytes, bytes]], neighbours: int) -> Index:
    """Index over the examples: (id, toxic, word hashes, counts) by id."""
    n, n1 = len(rows), sum(r[1] for r in rows)
    if not n or n1 in (0, n):
        return Index(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0), np.zeros(0, np.int64), float(n1 / n) if n else 0.0)
    bare = [r[1] for r in rows if not r[2]]
    rows = [r for r in rows if r[2]]
    labels_of = np.array([r[1] for r in rows], dtype=float)
    lengths = np.array([len(r[2]) // 8 for r in rows])
    keys, term, df = np.unique(np.frombuffer(b"".join(r[2] for r in rows), np.uint64), return_inverse=True, return_counts=True)
    df = df.astype(float)
    with_1 = np.bincount(term, np.repeat(labels_of, lengths), len(keys))
    spread = df * (n - df) * n1 * (n - n1)
    speaks = np.divide(with_1 * (n - df - n1 + with_1) - (df - with_1) * (n1 - with_1), np.sqrt(spread), out=np.zeros(len(keys)), where=spread > 0)
    weight = (np.log((1 + n) / (1 + df)) + 1) * (FLOOR + np.maximum(speaks, 0))
    vectors = list(zip(np.split(term, np.cumsum(lengths)[:-1]), [np.frombuffer(r[3], np.int32) for r in rows], strict=True))
    # Examples with the same heaviest words lie together, so that block bounds are tight.
    heavy = [t[np.argsort(-(1 + np.log(c)) * weight[t], kind="stable")[:4]].tolist() for t, c in vectors]
    order = sorted(range(len(rows)), key=lambda i: (heavy[i], rows[i][0]))
    vectors = [vectors[i] for i in order]
    index = Index(keys, weight, labels_of[order], np.array([rows[i][0] for i in order], dtype=np.int64), (sum(bare) + n1 / n) / (len(bare) + 1))
    index.build(vectors)
    index.calibrate(vectors, neighbours)
    return index


def _scored(rows: DataFrame, index: Index, k: int) -> DataFrame:
    """rows: (row, text); adds score, predicted and the nearest examples as evidence."""
    shared = rows.sparkSession.sparkContext.broadcast(index)

    def block_scores(index: Index, block: Block) -> Iterator[tuple[float, str]]:
        for own, counts in _counted(block, index.keys):
            if not len(own):
                yield index.empty_share, ""
                continue
            near, cosine = index.nearest(own, index.vector(own, counts), k)
            yield index.score(index.vote(near, cosine)), ",".join(f"{index.ids[i]}:{s:.3f}" for i, s in zip(near[:3].tolist(), cosine[:3].tolist(), strict=True))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        index = shared.value
        for batch in batches:
            made = [x for block in text_blocks(batch.column(1)) for x in block_scores(index, block)]
            score = np.array([s for s, _ in made], dtype=float)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array([e for _, e in made], pa.string())],
                ["row", "score", "predicted", "evidence"],
            )

    return rows.mapInArrow(work, StructType([rows.schema["row"], *StructType.fromDDL("score double, predicted int, evidence string").fields]))


def score_documents(docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text", neighbours: int = NEIGHBOURS) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted, evidence (nearest examples as id:cosine)."""
    rows = docs.select(F.struct(F.col(id_col).cast("bigint").alias("doc_id")).alias("row"), F.col(text_col).cast("string").alias("text"))
    held = F.coalesce(F.crc32(F.col("row.doc_id").cast("string")) % FOLDS == 0, F.lit(False))
    return _scored(rows, index, neighbours).select("row.doc_id", held.alias("held_out"), "score", "predicted", "evidence")


def keep_clean(docs: DataFrame, index: Index, text_col: str = "text", neighbours: int = NEIGHBOURS) -> DataFrame:
    """The rows of ``docs`` whose score is below one half, with their own columns."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col(text_col).cast("string").alias("text"))
    return _scored(rows, index, neighbours).filter("predicted = 0").select("row.*")
