"""Best-fit packing of token sequences by bin completion with branch and bound.

Documents become pieces (only longer ones are cut; the remainder comes first). Pieces of one length
are alike to the packing, so the search works on the histogram of lengths, at most ``capacity`` rows
whatever the corpus: around the largest length left it enumerates fillings, drops dominated ones,
prunes by the waste that may still be lost, and keeps a best-fit filling as incumbent. A filling is
used as often as its lengths last, so the plan has a bounded number of lines. Spark does all that
grows: tokens, the histogram, ranks of pieces within a length (counted in blocks, so one length may
hold any share of the rows) and the join of ranks to the plan.

Nulls are empty texts: a piece that holds the end id alone. Repeated rows are packed each. An empty
table gives an empty result. Ties of equal length go by doc_id and piece. Further columns are not read.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelake.llm.words import BLANKS, Block, Spans, chunks, hashes, hold, text_blocks
from pagelake.session import cut

if TYPE_CHECKING:
    from tokenizers import Tokenizer

CAPACITY = 1024
END_ID = 2
#: Rows of one length that a task numbers at most, about.
RANK_ROWS = 16_384
#: Steps of one search for a filling of the first incumbent; beyond it the best filling found stands.
NODES = 20_000
#: Branches of the search for a plan; beyond it the best plan found stands.
STEPS = 60_000
#: Unicode blanks outside ASCII: a text with one is tokenized as a whole, as its blank runs may go over chunk borders.
WIDE_BLANKS = rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80"
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"

#: Chunks of one generation of a worker's cache, and new chunks that the library gets as one text.
CACHED = 500_000
JOINED = 1_000

_CACHES: dict[str, IdCache] = {}


class IdCache:
    """Ids of text chunks by hash, held as arrays in the order of the hashes and filled by ``make`` (chunk texts to their ids in a row and their counts).

    Bounded: two generations of ``limit`` chunks. Chunks asked for lately stay when the younger one is full and
    takes the place of the older one; what is held changes speed only.
    """

    def __init__(self, make: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], limit: int) -> None:
        self.make, self.limit = make, limit
        self.clear()
        hold(self)

    def clear(self) -> None:
        """A generation: hashes, place of the first id, count of ids, and the ids."""
        self.known = self.older = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, "<u4"))

    def _add(self, keys: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        """Puts new sorted keys into the younger generation."""
        held, first, n, all_ids = self.known
        at = np.searchsorted(held, keys)
        place = len(all_ids) + np.cumsum(counts) - counts
        self.known = np.insert(held, at, keys), np.insert(first, at, place), np.insert(n, at, counts), np.concatenate([all_ids, ids])

    def values(self, block: Block, spans: Spans, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the block's chunks one after the other, and where those of each row begin."""
        distinct, place, which = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.known[0]) > self.limit:
            self.older = self.known
            self.known = tuple(x[:0] for x in self.older)
        missing = np.flatnonzero(~_held(self.known[0], distinct))
        old = missing[_held(self.older[0], distinct[missing])]
        if len(old):
            held, first, n, ids = self.older
            at = np.searchsorted(held, distinct[old])
            self._add(distinct[old], n[at], ids[_runs(first[at], n[at])])
            missing = np.setdiff1d(missing, old, assume_unique=True)
        if len(missing):
            data, at = block.data.tobytes(), place[missing]
            ids, counts = self.make([data[a:b] for a, b in zip(spans.start[at].tolist(), spans.end[at].tolist(), strict=True)])
            self._add(distinct[missing], counts, ids)
        held, first, n, ids = self.known
        at = np.searchsorted(held, distinct)[which]
        own = n[at]
        return ids[_runs(first[at], own)], np.concatenate([[0], np.cumsum(own)])[spans.first]


def _held(keys: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Whether sorted ``keys`` have each of ``asked``."""
    return keys[np.minimum(np.searchsorted(keys, asked), len(keys) - 1)] == asked if len(keys) else np.zeros(len(asked), dtype=bool)


def _runs(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The n numbers from ``first`` on of all pairs, one after the other."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _cache(path: str) -> IdCache:
    if path not in _CACHES:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        sizes = _sizes(tokenizer)
        _CACHES[path] = IdCache(lambda texts: _encoded(tokenizer, sizes, texts), CACHED)
    return _CACHES[path]


def _sizes(tokenizer: Tokenizer) -> np.ndarray:
    """Bytes of each token: a character of a byte-level token is a byte of the text."""
    known, added = tokenizer.get_vocab(), {t.content: len(t.content.encode()) for t in tokenizer.get_added_tokens_decoder().values()}
    sizes = np.zeros(1 + max(known.values(), default=0), np.int64)
    for token, i in known.items():
        sizes[i] = added.get(token, len(token))
    return sizes


def _encoded(tokenizer: Tokenizer, sizes: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all chunks one after the other, and their counts.

    Chunks that begin with a blank and end without one go to the tokenizer many at a time as one text, in which they have
    the ids they have alone; the bytes of each token tell where a chunk ends. Others, and texts in which that
    fails, are encoded each.
    """
    joins = [i for i, t in enumerate(texts) if t and BLANKS[t[0]] and not BLANKS[t[-1]] and (t[-1] < 128 or not re.search(WIDE_BLANKS, t))]
    groups = [joins[i : i + JOINED] for i in range(0, len(joins), JOINED)]
    found: list[np.ndarray | None] = [None] * len(texts)
    for own, e in zip(groups, tokenizer.encode_batch_fast([b"".join([texts[i] for i in own]).decode() for own in groups], add_special_tokens=False), strict=True):
        ids = np.array(e.ids, dtype="<u4")
        ends, wanted = np.cumsum(sizes[ids]), np.cumsum([len(texts[i]) for i in own])
        at = np.searchsorted(ends, wanted)
        if len(ids) and ends[-1] == wanted[-1] and (ends[at] == wanted).all():
            for i, x in zip(own, np.split(ids, at[:-1] + 1), strict=True):
                found[i] = x
    alone = [i for i, x in enumerate(found) if x is None]
    for i, e in zip(alone, tokenizer.encode_batch_fast([texts[i].decode() for i in alone], add_special_tokens=False), strict=True):
        found[i] = np.array(e.ids, dtype="<u4")
    return np.concatenate(found), np.array([len(x) for x in found], dtype=np.int32)


def token_bytes(column: pa.Array, path: str) -> Iterator[bytes]:
    """Ids of each text as little-endian unsigned 32-bit numbers.

    The tokenizer splits no text within a run of other characters than blanks, so chunks (a blank run
    and what follows it) have the ids they have in the whole text.
    """
    cache = _cache(path)
    for block in text_blocks(column):
        marks = np.array([m.start() for m in re.finditer(WIDE_BLANKS, block.data.tobytes())], dtype=np.int64)
        whole = np.zeros(block.rows, dtype=bool)
        whole[np.searchsorted(block.offsets, marks, side="right") - 1] = True
        spans = chunks(block, BLANKS, whole if len(marks) else None)
        ids, edges = cache.values(block, spans, hashes(block, spans))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            yield ids[a:b].tobytes()


def token_pieces(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): documents as ids with the end id, cut where they are too long."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, piece, start, length, crc = [], [], [], [], []
            for r, ids in enumerate(token_bytes(batch.column(1), tokenizer)):
                ids += end
                n = len(ids) // 4
                edges = [0, *range(n % capacity or min(capacity, n), n + 1, capacity)]
                for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                    owner.append(r)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[4 * a : 4 * b]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.selectExpr(f"cast({id_col} as bigint) doc_id", f"cast({text_col} as string) text").mapInArrow(work, PIECES)


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences that are needed whatever the packing: total size, and large items that share with small ones only."""
    by_size = np.zeros(capacity + 1, dtype=np.int64)
    for s, n in counts.items():
        by_size[s] += n
    return _bound(by_size)


def _bound(by_size: np.ndarray) -> int:
    """``lower_bound`` of the counts by size, for all sizes at once that may be the least of the small items."""
    capacity = len(by_size) - 1
    rows = np.concatenate([[0], np.cumsum(by_size)])
    sizes = np.concatenate([[0], np.cumsum(by_size * np.arange(capacity + 1))])
    half, small = capacity // 2, np.arange(capacity // 2 + 1)
    top = capacity + 1 - small
    paired = rows[top] - rows[half + 1]
    over = (sizes[half + 1] - sizes[small]) - (capacity * paired - (sizes[top] - sizes[half + 1]))
    return int(max(-(-sizes[-1] // capacity), (rows[-1] - rows[top] + paired + np.maximum(0, -(-over // capacity))).max()))


def _filling(room: int, left: dict[int, int], rank: int) -> list[int]:
    """A filling of ``room`` of little waste, large items first, for the first incumbent; ``rank`` asks for the next best one."""
    sizes = sorted((s for s in left if s <= room), reverse=True)
    kept: list[tuple[int, int, list[int]]] = []
    nodes = 0

    def bound() -> int:
        return kept[-1][0] if len(kept) > rank else room + 1

    def put(waste: int, own: list[int]) -> None:
        if any(k[2] == own for k in kept):
            return
        kept.append((waste, len(own), own))
        kept.sort(key=lambda k: k[:2])
        del kept[rank + 1 :]

    def walk(i: int, room: int, own: list[int]) -> None:
        nonlocal nodes
        nodes += 1
        if nodes > NODES or bound() == 0:
            return
        fits = False
        for j in range(i, len(sizes)):
            s = sizes[j]
            if s > room or left[s] <= own.count(s):
                continue
            fits = True
            walk(j, room - s, [*own, s])
            if bound() == 0 or nodes > NODES:
                return
            if len(own) >= 3 and s < room:
                break  # deep levels: best fit only
        if not fits and room < bound():
            put(room, own)

    best: list[int] = []
    rest = room
    for s in sizes:
        while s <= rest and left[s] > best.count(s):
            best.append(s)
            rest -= s
    put(rest, best)
    walk(0, room, [])
    return kept[min(rank, len(kept) - 1)][2]


def _incumbent(counts: dict[int, int], capacity: int, tries: int) -> list[tuple[list[int], int]]:
    """The best of a few greedy plans; each one after the first takes some second best fillings."""
    least = lower_bound(counts, capacity)
    total = sum(s * n for s, n in counts.items())
    best: list[tuple[list[int], int]] = []
    fewest = sum(counts.values()) + 1
    for attempt in range(tries):
        left, plan, used, wasted, step = dict(counts), [], 0, 0, 0
        while left:
            first = max(left)
            _take(left, [first], 1)
            filling = [first, *_filling(capacity - first, left, int(attempt > 0 and step % (attempt + 1) == attempt))]
            left[first] = left.get(first, 0) + 1
            times = min(left[s] // filling.count(s) for s in filling)
            _take(left, filling, times)
            plan.append((filling, times))
            used, wasted, step = used + times, wasted + times * (capacity - sum(filling)), step + 1
            if best and wasted > (fewest - 1) * capacity - total:
                break
        else:
            if used < fewest:
                best, fewest = plan, used
        if fewest <= least:
            break
    return best


def _take(left: dict[int, int], filling: list[int], times: int) -> None:
    for s in filling:
        left[s] -= times
        if not left[s]:
            del left[s]


def _dominated(filling: list[int], left: dict[int, int], room: int, waste: int) -> bool:
    """Whether one item left outside could take the place of items inside, or of the waste, at no loss.

    That is an item as long as several items inside, or longer than some (or none) of them by the waste at most.
    """
    one, more = 1, 0  # sums of none or one item, and of several
    for s in filling:
        more |= (more | one & ~1) << s
        one |= 1 << s
    outside = 0
    for s, n in left.items():
        if s <= room and n > filling.count(s):
            outside |= 1 << s
    return bool(more & outside or any((one | more) << w & outside for w in range(1, waste + 1)))


def _fillings(room: int, left: dict[int, int], spare: Callable[[], int], mixed: bool) -> Iterator[tuple[int, list[int] | None]]:
    """(waste, filling) for every undominated filling of ``room``, least waste first, up to the waste ``spare()`` at that time.

    The sums that the sizes up to each one can make are bits of a number, so the walk meets no dead end.
    Of equal waste those with the longest item come first; for each dominated one None comes instead, for the
    count of steps. If ``mixed``, those whose longest takes most of four fifths of the room come first, and
    dominated ones too: they lose nothing, and leave long items for later levels.
    """
    sizes = sorted(s for s in left if s <= room)
    full, sums = (1 << room + 1) - 1, [1]
    for s in sizes:
        now, n, k = sums[-1], min(left[s], room // s), 1
        while n > 0:
            k = min(k, n)
            now |= now << k * s & full
            n, k = n - k, 2 * k
        sums.append(now)

    def walk(end: int, rest: int, own: list[int]) -> Iterator[list[int]]:
        if not rest:
            yield own
            return
        end = bisect_right(sizes, rest, 0, end)
        turn = bisect_right(sizes, rest * 4 // 5, 0, end) if mixed else end
        for j in (*range(turn - 1, -1, -1), *range(turn, end)):
            s = sizes[j]
            for n in range(min(left[s], rest // s), 0, -1):
                if sums[j] >> rest - n * s & 1:
                    yield from walk(j, rest - n * s, own + [s] * n)

    for waste in range(room + 1):
        if waste > spare():
            return
        if sums[-1] >> room - waste & 1:
            for own in walk(len(sizes), room - waste, []):
                yield waste, None if not mixed and _dominated(own, left, room, waste) else own


class _Search:
    """Depth-first branch and bound; a level is one length that is the largest left, its branches (filling, times).

    The best plan so far gives the waste all sequences together may have in a better one. A branch whose waste
    goes beyond, or whose rest has a lower bound that makes it no better, is left. Branches of one filling go from
    as many times as its lengths last down to once, and the filling is not taken again below for the same length.
    """

    def __init__(self, counts: dict[int, int], capacity: int, best: list[tuple[list[int], int]]) -> None:
        self.counts, self.capacity, self.best = counts, capacity, best
        self.total = sum(s * n for s, n in counts.items())
        self.least = lower_bound(counts, capacity)
        self.fewest = sum(n for _, n in best)

    def allowed(self) -> int:
        return (self.fewest - 1) * self.capacity - self.total

    def run(self, steps: int, mixed: Callable[[int], bool] = lambda level: False) -> bool:
        """Searches ``steps`` branches; whether that was all of them. ``mixed`` gives the order of fillings at a level."""
        left, by_size = dict(self.counts), np.zeros(self.capacity + 1, dtype=np.int64)
        for s, n in left.items():
            by_size[s] = n
        plan: list[tuple[list[int], int]] = []
        used = wasted = 0

        def branches(gone: frozenset[tuple[int, ...]]) -> Iterator[tuple[int, list[int], int, frozenset[tuple[int, ...]]] | None]:
            first = max(left)
            rest = dict(left)
            _take(rest, [first], 1)
            before = wasted
            for waste, own in _fillings(self.capacity - first, rest, lambda: self.allowed() - before, mixed(len(plan))):
                if own is None or (key := tuple(own)) in gone:
                    yield None
                    continue
                filling = [first, *own]
                gone |= {key}
                most = min(left[s] // filling.count(s) for s in own + [first])
                for times in range(most, 0, -1):
                    if before + waste * times <= self.allowed():
                        yield waste, filling, times, gone

        levels = [branches(frozenset())]
        while levels:
            if self.fewest <= self.least:
                return True
            if steps <= 0:
                return False
            steps -= 1
            found = next(levels[-1], ())
            if found == ():
                levels.pop()
                if plan:
                    filling, times = plan.pop()
                    for s in filling:
                        left[s] = left.get(s, 0) + times
                        by_size[s] += times
                    used, wasted = used - times, wasted - times * (self.capacity - sum(filling))
                continue
            if found is None:
                continue
            waste, filling, times, gone = found
            _take(left, filling, times)
            for s in filling:
                by_size[s] -= times
            plan.append((filling, times))
            used, wasted = used + times, wasted + times * waste
            if not left and used < self.fewest:
                self.best, self.fewest = list(plan), used
            better = bool(left) and used + _bound(by_size) < self.fewest
            levels.append(branches(gone if filling[0] in left else frozenset()) if better else iter(()))
        return True


def completion_plan(counts: dict[int, int], capacity: int = CAPACITY, tries: int = 8) -> list[tuple[list[int], int]]:
    """(lengths of one sequence, how many such sequences) by bin completion with branch and bound.

    The search ends at the lower bound, with the last branch (the plan is optimal then) or after ``STEPS``
    branches. A third of them go to the plain order of fillings. As going back from the ends of a long plan
    seldom comes near its first levels, the rest is shared by searches in other orders.
    """
    if not counts:
        return []
    search = _Search(counts, capacity, _incumbent(counts, capacity, tries))
    depth = len(search.best)
    orders = [lambda level, q=q, r=r: level % q == r for q in (2, 3, 4) for r in range(q)]
    orders += [lambda level, q=q: level % q != 0 for q in (3, 4)]
    orders += [lambda level, k=k: 16 * level >= k * depth for k in (15, 14, 13, 12, 10, 8, 4, 0)]
    if search.run(STEPS // 3):
        return search.best
    for order in orders:
        if search.run(STEPS * 2 // 3 // len(orders), order):
            break
    return search.best


def _ranked(pieces: DataFrame, rows: int) -> DataFrame:
    """Adds ``rank`` from 0 within each length, numbered in blocks of ids so that no length meets in one task."""
    blocks = max(1, -(-rows // RANK_ROWS))
    marked = pieces.withColumn("_blk", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(blocks)))
    before = Window.partitionBy("length").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        marked.groupBy("length", "_blk").agg(F.count(F.lit(1)).alias("_n"))
        .select("length", "_blk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    own = Window.partitionBy("length", "_blk").orderBy("doc_id", "piece", "start")
    return (
        marked.withColumn("_rn", F.row_number().over(own) - 1).join(offsets, ["length", "_blk"])
        .withColumn("rank", F.col("_rn") + F.col("_before")).drop("_rn", "_blk", "_before")
    )


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (doc_id, piece, start, length, ...; length 1 to ``capacity``) with sequence_id and offset."""
    pieces = cut(pieces)
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    lines, base, taken = [], 0, dict.fromkeys(counts, 0)
    for filling, times in completion_plan(counts, capacity):
        at = 0
        for s in dict.fromkeys(filling):
            n = filling.count(s)
            lines.append((s, taken[s], taken[s] + n * times, base, n, at))
            taken[s] += n * times
            at += n * s
        base += times
    plan = spark.createDataFrame(lines, "length bigint, lo bigint, hi bigint, base bigint, each bigint, at bigint")
    ranked = _ranked(pieces, sum(counts.values()))
    # The plan has a few lines per length, not per piece: its size is bounded by the capacity.
    joined = ranked.join(F.broadcast(plan), (ranked["length"] == plan["length"]) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))).drop(plan["length"])
    nth = F.col("rank") - F.col("lo")
    return joined.withColumns(
        {
            "sequence_id": F.col("base") + F.floor(nth / F.col("each")),
            "offset": F.col("at") + F.pmod(nth, F.col("each")) * F.col("length"),
        }
    ).drop("rank", "lo", "hi", "base", "each", "at")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenizes, cuts and packs documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(token_pieces(docs, tokenizer, capacity, end_id, id_col, text_col), capacity).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )
