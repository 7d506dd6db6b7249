"""Postings in Arrow batches: words counted, dealt to shares and packed into lists by numpy, without a row for each posting in the JVM.

A share is a bucket of words and a part of the documents' blocks. A batch of documents sends each share one payload: a record batch
of the documents that have words of it, those words and how often they occur.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes of words that are counted together, about.
CHUNK = 8 << 20
# Lists of a batch that goes back to Spark.
LISTS = 8192

_P1, _P2, _P3, _P4, _P5 = map(np.uint64, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
SEED = np.uint64(42)
_LANES = np.array([SEED, SEED, SEED, SEED]) + np.array([_P1, _P2, np.uint64(0), np.uint64(0)]) + np.array([_P2, 0, 0, 0], np.uint64) - np.array([0, 0, 0, _P1], np.uint64)


def _turned(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def _round(acc: np.ndarray, value: np.ndarray) -> np.ndarray:
    return _turned(acc + value * _P2, 31) * _P1


def hashes(words: pa.Array) -> np.ndarray:
    """Spark's ``xxhash64`` of the words, as signed numbers; step by step over all words that are long enough."""
    words = words.cast(pa.large_string())
    if not len(words):
        return np.zeros(0, np.int64)
    _, at, data = words.buffers()
    offsets = np.frombuffer(at, np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(8, np.uint8)]) if data is not None else np.zeros(8, np.uint8)
    start, size = offsets[:-1], np.diff(offsets)
    read = lambda at, n, kind: data[at[:, None] + np.arange(n)].view(kind)[:, 0].astype(np.uint64)
    out = np.full(len(words), SEED + _P5)
    long = np.flatnonzero(size >= 32)
    if len(long):
        lanes = [np.full(len(long), lane) for lane in _LANES]
        for step in range(int(size.max()) // 32):
            some = np.flatnonzero(size[long] >= 32 * (step + 1))
            for i, lane in enumerate(lanes):
                lane[some] = _round(lane[some], read(start[long[some]] + 32 * step + 8 * i, 8, "<u8"))
        mixed = _turned(lanes[0], 1) + _turned(lanes[1], 7) + _turned(lanes[2], 12) + _turned(lanes[3], 18)
        for lane in lanes:
            mixed = (mixed ^ _round(np.zeros_like(lane), lane)) * _P1 + _P4
        out[long] = mixed
    out += size.astype(np.uint64)
    done = size // 32 * 32
    while len(some := np.flatnonzero(size - done >= 8)):
        out[some] = _turned(out[some] ^ _round(np.zeros(len(some), np.uint64), read(start[some] + done[some], 8, "<u8")), 27) * _P1 + _P4
        done[some] += 8
    some = np.flatnonzero(size - done >= 4)
    out[some] = _turned(out[some] ^ (read(start[some] + done[some], 4, "<u4") * _P1), 23) * _P2 + _P3
    done[some] += 4
    while len(some := np.flatnonzero(size > done)):
        out[some] = _turned(out[some] ^ (data[start[some] + done[some]].astype(np.uint64) * _P5), 11) * _P1
        done[some] += 1
    out = (out ^ (out >> np.uint64(33))) * _P2
    out = (out ^ (out >> np.uint64(29))) * _P3
    return (out ^ (out >> np.uint64(32))).view(np.int64)


def buckets(words: pa.Array, n: int) -> np.ndarray:
    """The bucket of each word, as ``sources.tables.bucket`` gives it."""
    return hashes(words) % n


def ranks(words: pa.Array) -> np.ndarray:
    """The place of each word in their order."""
    order = pc.array_sort_indices(words).to_numpy()
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    return rank


def flat(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of lists and the row of each; null lists and null words are left out."""
    words, row = lists.flatten(), np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
    if words.null_count:
        valid = words.is_valid()
        words, row = words.filter(valid), row[valid.to_numpy(zero_copy_only=False)]
    return words, row


def _codes(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    encoded = column.dictionary_encode(null_encoding="encode")
    return encoded.indices.to_numpy().astype(np.int64), encoded.dictionary


def _cuts(key: np.ndarray) -> np.ndarray:
    """Where a sorted key changes, the first place included."""
    return np.flatnonzero(np.concatenate([np.ones(min(len(key), 1), bool), key[1:] != key[:-1]]))


@dataclass
class Tally:
    """Distinct words of each (group, row), in this order: ``words[code]`` occurs ``times`` in ``row``."""

    words: pa.Array
    group: np.ndarray
    row: np.ndarray
    code: np.ndarray
    times: np.ndarray


def tally(words: pa.Array, row: np.ndarray, group: Callable[[pa.Array, np.ndarray, np.ndarray], np.ndarray] | None = None) -> Tally:
    """Counts the words of each row; ``group(distinct words, code, row)`` orders above the row."""
    code, distinct = _codes(words)
    n, rows = max(len(distinct), 1), int(row.max(initial=0)) + 1
    key = row * n + code
    if group is not None:
        key += group(distinct, code, row) * (rows * n)
    key.sort()
    at = _cuts(key)
    times, key = np.diff(np.append(at, len(key))), key[at]
    return Tally(distinct, key // (rows * n), key // n % rows, key % n, times)


def shared_schema(kept: pa.Schema) -> pa.Schema:
    """Of a payload: a document's columns, its words of the share, one a line, and how often each occurs."""
    return kept.append(pa.field("lines", pa.string())).append(pa.field("tfs", pa.list_(pa.int32())))


def _payloads(rows: pa.Table, n_buckets: int, parts: int, schema: pa.Schema) -> pa.RecordBatch:
    column = lambda name: rows.column(name).combine_chunks()
    words, row = flat(pc.split_pattern(column("lines"), "\n"))
    part, times = column("part").to_numpy().astype(np.int64), column("times").to_numpy()
    found = tally(words, row, lambda distinct, code, row: buckets(distinct, n_buckets)[code] * parts + part[row])
    first = np.flatnonzero(np.concatenate([np.ones(min(len(found.row), 1), bool), (found.row[1:] != found.row[:-1]) | (found.group[1:] != found.group[:-1])]))
    at = pa.array(np.append(first, len(found.row)), pa.int32())
    lines = pc.binary_join(pa.ListArray.from_arrays(at, found.words.take(pa.array(found.code))), "\n")
    tfs = pa.ListArray.from_arrays(at, pa.array(found.times * times[found.row], pa.int32()))
    own = pa.array(found.row[first])
    kept = [column(name).take(own) for name in schema.names[:-2]]
    sent = pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*kept, lines, tfs], schema, strict=True)], schema=schema)
    share = found.group[first]
    cuts = _cuts(share)
    payloads = [sent.slice(lo, hi - lo).serialize().to_pybytes() for lo, hi in zip(cuts, np.append(cuts[1:], len(share)), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(share[cuts], pa.int32()), pa.array(payloads, pa.binary())], ["share", "payload"])


def dealing(n_buckets: int, parts: int, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(share, payload) of documents (their columns, part, times, lines); some megabytes of words are counted together."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            total = np.cumsum(pc.binary_length(batch.column("lines")).to_numpy().astype(np.int64) + 1)
            at, before = 0, 0
            while at < batch.num_rows:
                to = max(int(np.searchsorted(total, before + CHUNK - size, side="right")), at + 1)
                held.append(batch.slice(at, to - at))
                size += int(total[to - 1]) - before
                at, before = to, int(total[to - 1])
                if size >= CHUNK or at < batch.num_rows:
                    yield _payloads(pa.Table.from_batches(held), n_buckets, parts, schema)
                    held, size = [], 0
        if held:
            yield _payloads(pa.Table.from_batches(held), n_buckets, parts, schema)

    return work


def _lists(rows: pa.Table, bucket: int, merged: bool) -> pa.RecordBatch:
    column = lambda name: rows.column(name).combine_chunks()
    words, row = flat(pc.split_pattern(column("lines"), "\n"))
    tf = column("tfs").flatten().to_numpy()
    code, distinct = _codes(words)
    block, blocks = _codes(column("block"))
    key = ranks(distinct)[code] * len(blocks) + block[row]
    kept = [name for name in rows.column_names if name not in ("block", "lines", "tfs")]
    if merged:
        # rows of a repeated document count as one
        same = block
        for name in kept:
            code_of, values = _codes(column(name))
            same = np.unique(same * max(len(values), 1) + code_of, return_inverse=True)[1]
        order = np.lexsort((same[row], key))
        key, row, tf = key[order], row[order], tf[order]
        at = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (same[row[1:]] != same[row[:-1]])]))
        key, row, tf = key[at], row[at], np.add.reduceat(tf, at)
    else:
        order = np.argsort(key, kind="stable")
        key, row, tf = key[order], row[order], tf[order]
    at = _cuts(key)
    own = pa.array(row)
    docs = pa.StructArray.from_arrays([*[column(name).take(own) for name in kept], pa.array(tf, pa.int32())], [*kept, "tf"])
    n_tokens = column("n_tokens")
    size = np.take(n_tokens.to_numpy(), row)
    token = key[at] // len(blocks)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(at), bucket), pa.int32()),
            distinct.take(pc.array_sort_indices(distinct)).take(pa.array(token)),
            blocks.take(pa.array(key[at] % len(blocks))),
            pa.array(np.maximum.reduceat(tf, at), pa.int32()),
            pa.array(np.minimum.reduceat(size, at), n_tokens.type),
            pa.ListArray.from_arrays(pa.array(np.append(at, len(key)), pa.int32()), docs),
            _held(key // len(blocks), token, column("version_id").take(own), column("run_id").take(own)),
        ],
        ["bucket", "token", "block", "max_tf", "min_tokens", "docs", "held"],
    )


def _held(word: np.ndarray, listed: np.ndarray, version: pa.Array, run: pa.Array) -> pa.ListArray:
    """Postings of each word by version and run, in the first of the word's lists; null in the others."""
    (own, versions), (ran, runs) = _codes(version), _codes(run)
    key, df = np.unique((word * len(versions) + own) * len(runs) + ran, return_counts=True)
    of = key // (len(versions) * len(runs))
    counts = pa.StructArray.from_arrays(
        [versions.take(pa.array(key // len(runs) % len(versions))), runs.take(pa.array(key % len(runs))), pa.array(df, pa.int64())], ["version_id", "run_id", "df"]
    )
    first = np.concatenate([[True], listed[1:] != listed[:-1]])
    size = np.zeros(len(listed), np.int64)
    size[first] = np.bincount(of, minlength=int(word.max()) + 1)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), counts, mask=pa.array(~first))


def packing(parts: int, schema: pa.Schema, merged: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Lists (bucket, token, block, max_tf, min_tokens, docs, held) of one share's payloads; with ``merged`` rows of one document are added up."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shares: dict[int, list[pa.RecordBatch]] = {}
        for batch in batches:
            for share, payload in zip(batch.column("share").to_pylist(), batch.column("payload"), strict=True):
                shares.setdefault(share, []).append(pa.ipc.read_record_batch(payload.as_buffer(), schema))
        while shares:
            share, own = shares.popitem()
            lists = _lists(pa.Table.from_batches(own), share // parts, merged)
            for at in range(0, lists.num_rows, LISTS):
                yield lists.slice(at, LISTS)

    return work
