"""Byte-level cuts of Arrow string batches: word places and 64-bit word hashes with numpy, no per-word Python.

Texts are UTF-8. Separators are ASCII, so cuts at bytes are cuts at characters. A batch is worked
through in blocks of about a megabyte; a longer text is a block of its own, never shortened.
Nulls are empty texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
ODD = np.uint64(0x9E3779B97F4A7C15)
MIX_A = np.uint64(0xBF58476D1CE4E5B9)
MIX_B = np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


def byte_set(spec: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(spec)] = True
    return table


#: Separators of ``[^\x20\x09-\x0D]+``.
BLANKS = byte_set(b" \t\n\x0b\x0c\r")
#: Separators of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` once A-Z are lower-cased.
NOT_ALNUM = byte_set(bytes(b for b in range(128) if not chr(b).isalnum()))
#: Values of the bytes in a hash, as they stand and with A-Z lower-cased.
EXACT = mix(np.arange(1, 257, dtype=np.uint64) * ODD)
FOLDED = EXACT.copy()
FOLDED[ord("A") : ord("Z") + 1] = EXACT[ord("a") : ord("z") + 1]

_POWERS = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64 and of its inverse, kept for the next block."""
    if len(_POWERS[0]) < n:
        base = 0x5851F42D4C957F2D
        for i, b in enumerate((base, pow(base, -1, 1 << 64))):
            steps = np.full(n, b, dtype=np.uint64)
            steps[0] = 1
            _POWERS[i] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


@dataclass
class Block:
    """Consecutive rows of a batch: row r has the bytes ``data[offsets[r]:offsets[r + 1]]``."""

    row: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1

    def text(self, r: int) -> bytes:
        return self.data[self.offsets[r] : self.offsets[r + 1]].tobytes()


def text_blocks(column: pa.Array | pa.ChunkedArray, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    row = 0
    for part in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        part = pc.fill_null(part.cast(pa.large_string()), "") if part.null_count else part.cast(pa.large_string())
        if not len(part):
            continue
        _, at, data = part.buffers()
        offsets = np.frombuffer(at, np.int64)[part.offset : part.offset + len(part) + 1]
        whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        first = 0
        while first < len(part):
            last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
            last = min(max(last, first + 1), len(part))
            lo, hi = offsets[first], offsets[last]
            yield Block(row + first, whole[lo:hi], offsets[first : last + 1] - lo)
            first = last
        row += len(part)


def _after(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """flags of the byte before, true at the start of a row."""
    before = np.empty(len(flags), dtype=bool)
    before[:1] = True
    before[1:] = flags[:-1]
    before[offsets[:-1][offsets[:-1] < len(flags)]] = True
    return before


@dataclass
class Spans:
    """Words of a block in order; row r has those from ``first[r]`` to ``first[r + 1]``."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(block: Block, separators: np.ndarray = BLANKS) -> Spans:
    """Maximal runs of bytes that are no separators."""
    gap = separators[block.data]
    start = np.flatnonzero(~gap & _after(gap, block.offsets))
    following = np.empty(len(gap), dtype=bool)
    following[-1:] = True
    following[:-1] = gap[1:]
    following[block.offsets[1:][block.offsets[1:] > 0] - 1] = True
    end = np.flatnonzero(~gap & following) + 1
    return Spans(start, end, np.searchsorted(start, block.offsets))


def chunks(block: Block, separators: np.ndarray, whole: np.ndarray | None = None) -> Spans:
    """Runs of separators with the word behind them: every byte lies in one chunk.

    Rows marked in ``whole`` are one chunk each.
    """
    gap = separators[block.data]
    begins = gap & ~_after(gap, block.offsets)
    if whole is not None:
        for r in np.flatnonzero(whole):
            begins[block.offsets[r] : block.offsets[r + 1]] = False
    begins[block.offsets[:-1][block.offsets[:-1] < len(gap)]] = True
    start = np.flatnonzero(begins)
    return Spans(start, np.append(start[1:], len(gap)), np.searchsorted(start, block.offsets))


def hashes(block: Block, spans: Spans, values: np.ndarray = EXACT) -> np.ndarray:
    """64-bit hashes of the spans' bytes, each by differences of one running sum over the block."""
    n = len(block.data)
    power, inverse = _powers(max(n, 1))
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values[block.data] * power[:n], dtype=np.uint64, out=total[1:])
    own = (total[spans.end] - total[spans.start]) * inverse[spans.start]
    return mix(own + (spans.end - spans.start).astype(np.uint64) * ODD)


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of ``width`` consecutive words: position i stands for words i to i + width - 1.

    By doubling, so ten numpy passes do for 50 words. Positions in the last ``width - 1`` reach over the end and mean nothing.
    """
    done, have, step, size = None, 0, h, 1
    left = width
    while left:
        if left & 1:
            if done is None:
                done, have = step, size
            else:
                done, have = mix(done * ODD + np.roll(step, -have) + np.uint64(have)), have + size
        left >>= 1
        if left:
            step = mix(step * ODD + np.roll(step, -size) + np.uint64(size))
            size *= 2
    return done


_HELD: list = []


def hold(cache) -> None:
    """From now on ``forget`` empties this cache too (by its ``clear``)."""
    _HELD.append(cache)


def forget() -> None:
    """Empties all chunk caches of this worker: tasks of operators without one start with it, as workers serve many."""
    for cache in _HELD:
        cache.clear()
    pa.default_memory_pool().release_unused()


class ChunkCache:
    """Values of text chunks by hash, filled by ``make`` (list of chunk texts to list of values).

    Bounded: two generations of ``limit`` values. Values asked for lately stay when the younger one is full and
    takes the place of the older one; what is held changes speed only.
    """

    def __init__(self, make: Callable[[list[bytes]], list], limit: int = 300_000) -> None:
        self.make, self.limit, self.known, self.older = make, limit, {}, {}
        hold(self)

    def clear(self) -> None:
        self.known, self.older = {}, {}

    def values(self, block: Block, spans: Spans, keys: np.ndarray) -> tuple[list, np.ndarray]:
        """(values of the distinct chunks, the place of each chunk's value among them)."""
        distinct, place, which = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.known) > self.limit:
            self.known, self.older = {}, self.known
        known, older, own = self.known, self.older, distinct.tolist()
        out = [known.get(k) for k in own]
        missing = []
        for i, v in enumerate(out):
            if v is None:
                v = out[i] = older.get(own[i])
                if v is None:
                    missing.append(i)
                else:
                    known[own[i]] = v
        if missing:
            data = block.data.tobytes()
            at = place[missing]
            texts = [data[a:b] for a, b in zip(spans.start[at].tolist(), spans.end[at].tolist(), strict=True)]
            for i, v in zip(missing, self.make(texts), strict=True):
                out[i] = known[own[i]] = v
        return out, which


class WordCache:
    """Values of words, made one by one; bounded by two generations of ``limit`` values as ``ChunkCache``."""

    def __init__(self, make: Callable[[str], tuple], limit: int) -> None:
        self.make, self.limit, self.known, self.older = make, limit, {}, {}
        hold(self)

    def clear(self) -> None:
        self.known, self.older = {}, {}

    def values(self, words: list[str]) -> list[tuple]:
        """The value of each word."""
        if len(self.known) > self.limit:
            self.known, self.older = {}, self.known
        known, older, make = self.known, self.older, self.make
        for w in set(words).difference(known):
            v = older.get(w)
            known[w] = make(w) if v is None else v
        return [known[w] for w in words]
