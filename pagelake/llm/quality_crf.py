"""Quality rules by line labelling: a linear-chain CRF marks lines as content or boilerplate.

Lines with a word are the observations, line figures (length, symbols, capitals, digits, repeats) the
features. Weights come from a bounded sample of labelled documents (``FIT_DOCS``): lines of good
documents count as content, lines of bad ones as boilerplate unless a first, chainless fit takes them
for content; then the chain is fitted by its likelihood. Viterbi decoding labels the lines of every
document; the share of words in content lines decides, after two plain rules (too few words, too many repeated words).

Nulls are texts without words: they fail the plain rules. Documents without labels of both kinds in the
corpus leave the plain rules alone to decide. Repeated rows are judged alike; ties of a decoding go to content.
Empty tables give empty results. Columns of any name pass through ``keep_good`` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pagelake.llm.words import BLANKS, Block, Spans, byte_set, forget, hashes, mix, text_blocks, windows, words

#: Labelled documents the weights are fitted on, at most; chosen by the hash of their id.
FIT_DOCS = 3_000
#: Lines of one training chain; longer documents train as several chains, all lines count.
FIT_LINES = 64
CONTENT_SHARE = 0.5
MIN_WORDS = 50
REPEAT_PERCENT = 50

SYMBOLS = byte_set(b"#*$%&|<>")
UPPER = byte_set(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")
LOWER = byte_set(b"abcdefghijklmnopqrstuvwxyz")
DIGITS = byte_set(b"0123456789")
CALLS = byte_set(b"!?")
CLOSERS = byte_set(b".!?:;\"')")
BASE = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"
FEATURES = 13


def _sums(flags: np.ndarray, edges: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[edges])


def _between(flags: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=total[1:])
    return total[end] - total[start]


@dataclass
class Facts:
    """Figures of a block: per row, and per line that has a word (``first``: lines of each row)."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    first: np.ndarray
    line_words: np.ndarray
    features: np.ndarray


def _lines(block: Block) -> Spans:
    """\\n-split lines; the empty one behind a last line break is left out."""
    breaks = np.flatnonzero(block.data == 10)
    full = np.flatnonzero(np.diff(block.offsets) > 0)
    ends = block.offsets[full + 1]
    start = np.sort(np.concatenate([block.offsets[full], np.setdiff1d(breaks + 1, ends)]))
    end = np.sort(np.concatenate([ends[block.data[ends - 1] != 10], breaks]))
    return Spans(start, end, np.searchsorted(start, block.offsets))


def facts(block: Block) -> Facts:
    data, n = block.data, block.rows
    found = words(block, BLANKS)
    h = hashes(block, found)
    row = found.rows()
    n_words = np.diff(found.first)
    chars = ~BLANKS[data] & ((data & 0xC0) != 0x80)
    repeat = np.zeros(len(h), dtype=bool)
    if len(h) >= 3:
        tri = windows(h, 3)[:-2]
        inside = row[:-2] == row[2:]
        keys = mix(tri + row[:-2].astype(np.uint64))[inside]
        _, which, times = np.unique(keys, return_inverse=True, return_counts=True)
        at = np.flatnonzero(inside)[times[which] > 1]
        for k in range(3):
            repeat[at + k] = True
    lines = _lines(block)
    of_line = np.searchsorted(lines.start, found.start, side="right") - 1
    per_line = np.bincount(of_line, minlength=len(lines.start)) if len(h) else np.zeros(len(lines.start), np.int64)
    some = per_line > 0
    start, end = lines.start[some], lines.end[some]
    line_row = lines.rows()[some]
    line_words = per_line[some]
    keys = mix(hashes(block, Spans(start, end, lines.first)) + mix(line_row.astype(np.uint64)))
    _, earliest, which = np.unique(keys, return_index=True, return_inverse=True)
    repeated = earliest[which] != np.arange(len(keys))
    nth = of_line[:, None].ravel() if len(h) else of_line
    distinct = np.zeros(len(lines.start), dtype=np.int64)
    if len(h):
        pairs = np.unique(mix(h + mix(nth.astype(np.uint64))), return_index=True)[1]
        distinct = np.bincount(nth[pairs], minlength=len(lines.start))
    w = np.maximum(line_words, 1).astype(float)
    size = np.maximum(_between(chars, start, end), 1).astype(float)
    upper, lower = _between(UPPER[data], start, end), _between(LOWER[data], start, end)
    last = np.zeros(len(lines.start), dtype=np.int64)
    np.maximum.at(last, of_line, found.end)
    first = np.searchsorted(line_row, np.arange(n + 1))
    here = np.arange(len(line_row)) - first[line_row]
    features = np.column_stack(
        [
            np.ones(len(w)), np.log1p(w) / 4, w < 3, np.minimum(_between(SYMBOLS[data], start, end) / w, 2), upper / np.maximum(upper + lower, 1),
            _between(DIGITS[data], start, end) / size, np.minimum(_between(CALLS[data], start, end) / w, 2), repeated,
            CLOSERS[data[np.maximum(last[some] - 1, 0)]] if len(w) else np.zeros(0), size / w / 10, distinct[some] / w, here == 0,
            here == np.diff(first)[line_row] - 1,
        ]
    ).astype(np.float64)
    return Facts(
        n_words, _sums(chars, block.offsets), _sums(SYMBOLS[data], block.offsets), np.bincount(line_row[repeated], minlength=n),
        np.bincount(row[repeat], minlength=n), first, line_words, features,
    )


@dataclass
class Chain:
    """Weights of the features for boilerplate against content, and of the four transitions."""

    weights: np.ndarray
    moves: np.ndarray

    def boilerplate(self, scores: list[float]) -> list[int]:
        """Viterbi: the best labels (1 boilerplate) of lines with such scores for boilerplate."""
        (a, b), (c, d) = self.moves.tolist()
        if not scores:
            return []
        x, y, back = 0.0, scores[0], []
        for s in scores[1:]:
            from_x, from_y = y + c > x + a, y + d > x + b
            back.append((from_x, from_y))
            x, y = (y + c if from_x else x + a), (y + d if from_y else x + b) + s
        state = int(y > x)
        out = [state]
        for step in reversed(back):
            state = int(step[state])
            out.append(state)
        return out[::-1]


def _fit_lines(x: np.ndarray, y: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Ridge logistic weights by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(min(rounds, 25)):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (y - p) - 0.5 * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(len(w))
        w = w + np.linalg.solve(hess, g)
    return w


def fit_chain(docs: list[tuple[np.ndarray, int]], rounds: int = 120) -> Chain:
    """Chain of (line features, 1 for a good document) pairs; all of one kind: every line is content."""
    docs = [(f, q) for f, q in docs if len(f)]
    if len({q for _, q in docs}) < 2:
        return Chain(np.zeros(FEATURES), np.zeros((2, 2)))
    x = np.concatenate([f for f, _ in docs])
    y = np.concatenate([np.full(len(f), float(not q)) for f, q in docs])
    w = _fit_lines(x, y)
    seqs = [(f[i : i + FIT_LINES], (f[i : i + FIT_LINES] @ w > 0) & (not q)) for f, q in docs for i in range(0, len(f), FIT_LINES)]
    size = np.array([len(f) for f, _ in seqs])
    t = int(size.max())
    obs, lab, there = np.zeros((len(seqs), t, FEATURES)), np.zeros((len(seqs), t), dtype=int), np.arange(t)[None, :] < size[:, None]
    for i, (f, labels) in enumerate(seqs):
        obs[i, : len(f)], lab[i, : len(f)] = f, labels
    moves, m, v = np.zeros((2, 2)), 0.0, 0.0
    theta = np.concatenate([w, moves.ravel()])
    ends = there.sum(1) - 1
    for r in range(1, rounds + 1):
        w, moves = theta[:FEATURES], theta[FEATURES:].reshape(2, 2)
        e = np.stack([np.zeros(obs.shape[:2]), obs @ w], axis=2)
        fwd, bwd = np.zeros_like(e), np.zeros_like(e)
        fwd[:, 0] = e[:, 0]
        for k in range(1, t):
            step = fwd[:, k - 1, :, None] + moves
            fwd[:, k] = np.where(there[:, k, None], np.logaddexp(step[:, 0], step[:, 1]) + e[:, k], fwd[:, k - 1])
        for k in range(t - 2, -1, -1):
            step = moves + (e[:, k + 1] + bwd[:, k + 1])[:, None, :]
            bwd[:, k] = np.where(there[:, k + 1, None], np.logaddexp(step[:, :, 0], step[:, :, 1]), 0)
        z = np.logaddexp(fwd[:, -1, 0], fwd[:, -1, 1])
        p = np.where(there, np.exp(fwd[:, :, 1] + bwd[:, :, 1] - z[:, None]), 0)
        g_w = np.einsum("st,stf->f", np.where(there, lab - p, 0), obs) - 0.5 * w
        g_m = -20.0 * moves  # short chains of one kind say little on changes of label
        both = there[:, 1:]
        for a in range(2):
            for b in range(2):
                q = np.exp(fwd[:, :-1, a] + moves[a, b] + e[:, 1:, b] + bwd[:, 1:, b] - z[:, None])
                g_m[a, b] += (((lab[:, :-1] == a) & (lab[:, 1:] == b) & both) - np.where(both, q, 0)).sum()
        g = np.concatenate([g_w, g_m.ravel()]) / len(seqs)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta + 0.1 * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
    del ends
    return Chain(theta[:FEATURES], theta[FEATURES:].reshape(2, 2))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_docs: int = FIT_DOCS) -> Chain:
    """Chain of at most ``fit_docs`` labelled documents (labels: doc_id, quality)."""
    order = [F.xxhash64("_id"), F.col("_id"), F.col("quality")]
    known = labels.select(F.col("doc_id").cast("bigint").alias("_id"), F.col("quality").cast("int").alias("quality")).filter("_id is not null and quality in (0, 1)")
    texts = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).cast("string").alias("text"))
    # Ids first, so that only the sample's texts move; three times as many as needed, for labelled ids the corpus lacks.
    ids = texts.select("_id").join(known, "_id").orderBy(*order).limit(fit_docs)
    sample = texts.join(F.broadcast(ids), "_id")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            own, flat = [], []
            for block in text_blocks(batch.column(1)):
                f = facts(block)
                for r in range(block.rows):
                    own.append(block.row + r)
                    flat.append(f.features[f.first[r] : f.first[r + 1]].astype("<f4").tobytes())
            taken = pa.array(own, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(taken), batch.column(2).take(taken), pa.array(flat, pa.binary())], ["_id", "quality", "features"])

    rows = sample.select("_id", "text", "quality").mapInArrow(work, "_id bigint, quality int, features binary").collect()
    rows.sort(key=lambda r: (r["_id"], bytes(r["features"])))
    return fit_chain([(np.frombuffer(r["features"], "<f4").reshape(-1, FEATURES).astype(float), r["quality"]) for r in rows])


def judged(
    docs: DataFrame, chain: Chain, text_col: str = "text", share: float = CONTENT_SHARE, min_words: int = MIN_WORDS, repeat_percent: int = REPEAT_PERCENT
) -> DataFrame:
    """``docs`` (columns of any name) as one struct ``row`` with the base figures, content_words, base_failed and kept."""
    outer = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col(text_col).cast("string").alias("text"))
    return _figures(outer, chain, share, min_words, repeat_percent)


def _figures(rows: DataFrame, chain: Chain, share: float, min_words: int, repeat_percent: int) -> DataFrame:
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            base: list[list[np.ndarray]] = [[] for _ in names]
            content: list[int] = []
            for block in text_blocks(batch.column(1)):
                f = facts(block)
                for out, name in zip(base, names, strict=True):
                    out.append(getattr(f, name))
                scores, sizes, first = (f.features @ chain.weights).tolist(), f.line_words.tolist(), f.first.tolist()
                for a, b in zip(first[:-1], first[1:], strict=True):
                    marks = chain.boilerplate(scores[a:b])
                    content.append(sum(n for n, m in zip(sizes[a:b], marks, strict=True) if not m))
            cols = [np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in base]
            failed = (cols[0] < min_words) | (100 * cols[4] > repeat_percent * cols[0])
            kept = ~failed & (np.array(content, dtype=np.int64) >= share * cols[0])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c) for c in cols), pa.array(content, pa.int64()), pa.array(failed), pa.array(kept)],
                ["row", *names, "content_words", "base_failed", "kept"],
            )

    made = StructType.fromDDL(f"{BASE}, content_words bigint, base_failed boolean, kept boolean")
    return rows.mapInArrow(work, StructType([rows.schema["row"], *made.fields]))


def judge_documents(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, the base figures, content_words, base_failed, kept. No shuffle."""
    narrow = docs.select(F.struct(F.col(id_col).cast("bigint").alias("doc_id")).alias("row"), F.col(text_col).cast("string").alias("text"))
    return _figures(narrow, chain, CONTENT_SHARE, MIN_WORDS, REPEAT_PERCENT).select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "content_words", "base_failed", "kept")


def keep_good(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns."""
    return judged(docs, chain, text_col).filter("kept").select("row.*")
