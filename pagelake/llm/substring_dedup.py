"""Substring dedup by prefix-partitioned suffix trees over words.

A suffix starts at each word of a document; only its first ``WIDTH`` words matter. Suffixes that cannot
branch deep in the tree are left out first: each run of ``WIDTH`` words has one smallest hash among its short
grams, equal runs have the same one, so a suffix whose smallest gram no other document has is a lone leaf.
The others travel as fingerprints of their prefixes at growing depths and are dealt to groups by their
shortest prefix; a group above the memory bound is divided by the next longer prefix, and so on. Within a
task equal suffixes are joined before they travel (the smallest document stays, the others are decided), so a
passage that any share of the documents has sends one suffix per task. Each group's suffixes, sorted,
are a subtree: equal fingerprints of neighbours are its internal nodes, and those of depth ``WIDTH``
with leaves of several documents are repeats. Runs of adjacent repeats are the maximal ones.

A word goes if a window over it starts also in a document of smaller doc_id; windows are judged on the
input. Nulls and texts under ``WIDTH`` words lose nothing. Rows without doc_id neither take nor lose words. Rows
of one doc_id are one document to each other: none takes words from another. Empty tables give empty results;
columns of any name pass through ``without_repeats``. Windows count as equal when 96 bits of fingerprints agree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from pagelake.llm.words import ODD, forget, hashes, mix, text_blocks, windows, words
from pagelake.session import cut, discard, release, stored

WIDTH = 50
GRAM = 8
#: Depth of the prefix that divides groups too large for the first one, in words.
MIDDLE = 24
#: Bytes of suffixes in a group: planned, and at most.
GROUP_BYTES = 8 << 20
MOST_BYTES = 64 << 20
SUFFIX_BYTES = 24
RESULT = "doc_id bigint, k bigint, starts binary"


def _smallest(h: np.ndarray, width: int, gram: int) -> np.ndarray:
    """Least hash among the grams within each window of ``width`` words."""
    m = windows(h, gram)
    span, have = width - gram + 1, 1
    while 2 * have <= span:
        m = np.minimum(m, np.roll(m, -have))
        have *= 2
    return np.minimum(m, np.roll(m, have - span)) if have < span else m


def _starts(row: np.ndarray, width: int) -> np.ndarray:
    """Word places at which a window of one row begins."""
    n = len(row) - width + 1
    return np.flatnonzero(row[:n] == row[width - 1 :]) if n > 0 else np.zeros(0, np.int64)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("k"), text.alias("text"))


def shared_grams(keyed: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, k, grams): of each document the smallest grams of its windows that other documents have too."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            grams = []
            for block in text_blocks(batch.column(2)):
                found = words(block)
                row = found.rows()
                at = _starts(row, width)
                least = _smallest(hashes(block, found), width, GRAM)[at] if len(at) else np.zeros(0, np.uint64)
                new = np.ones(len(at), dtype=bool)
                new[1:] = (least[1:] != least[:-1]) | (row[at][1:] != row[at][:-1])
                least, owner = least[new].view(np.int64), row[at][new]
                edges = np.searchsorted(owner, np.arange(block.rows + 1))
                grams += [np.unique(least[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(grams, pa.list_(pa.int64()))], ["doc_id", "k", "grams"])

    own = cut(keyed.filter("doc_id is not null").mapInArrow(work, "doc_id bigint, k bigint, grams array<bigint>").filter("size(grams) > 0"))
    flat = own.select("doc_id", "k", F.explode("grams").alias("gram"))
    repeated = flat.groupBy("gram").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("gram")
    # A document has a bounded number of grams, its own; a gram of a third of all documents is one row on the right.
    return flat.join(repeated, "gram").groupBy("doc_id", "k").agg(F.collect_set("gram").alias("grams"))


def _packed(owner: np.ndarray, pos: np.ndarray, mid: np.ndarray, full: np.ndarray, ids: np.ndarray, ks: np.ndarray) -> bytes:
    """One value for suffixes of a task in a group, by document and place."""
    docs, owner = np.unique(owner, return_inverse=True)
    head = np.array([len(docs), len(owner)], dtype=np.int64)
    return b"".join(x.tobytes() for x in (head, ids[docs], ks[docs], owner.astype(np.int32), pos.astype(np.int32), mid, full))


def _unpacked(raw: bytes) -> tuple[np.ndarray, ...]:
    d, n = np.frombuffer(raw, np.int64, 2).tolist()
    out, at = [], 16
    for kind, count in ((np.int64, d), (np.int64, d), (np.int32, n), (np.int32, n), (np.uint32, n), (np.uint64, n)):
        out.append(np.frombuffer(raw, kind, count, at))
        at += out[-1].nbytes
    return tuple(out)


def suffix_groups(keyed: DataFrame, grams: DataFrame, groups: int, width: int = WIDTH) -> DataFrame:
    """(part, doc_id, k, payload): suffixes of a task by group ``part``; part -1: window starts that are decided already."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        names = ["part", "doc_id", "k", "payload"]
        for batch in batches:
            ids, ks = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            pieces = []
            flat = batch.column(3)
            shared = np.unique(flat.flatten().to_numpy(zero_copy_only=False)).view(np.uint64)
            for block in text_blocks(batch.column(2)):
                found = words(block)
                h = hashes(block, found)
                row = found.rows()
                at = _starts(row, width)
                if not len(at):
                    continue
                at = at[np.isin(_smallest(h, width, GRAM)[at], shared)]
                own = row[at]
                pieces.append(
                    (own + block.row, at - found.first[own], (windows(h, GRAM)[at] >> np.uint64(20)) % np.uint64(groups), windows(h, MIDDLE)[at].astype(np.uint32), windows(h, width)[at])
                )
            if not pieces:
                continue
            owner, pos, part, mid, full = (np.concatenate(x) for x in zip(*pieces, strict=True))
            by_id = np.argsort(ids[owner], kind="stable")
            order = by_id[np.argsort(full[by_id], kind="stable")]
            f, m, d = full[order], mid[order], ids[owner[order]]
            new = np.ones(len(f), dtype=bool)
            new[1:] = (f[1:] != f[:-1]) | (m[1:] != m[:-1])
            least = d[np.flatnonzero(new)][np.cumsum(new) - 1]
            stays = np.zeros(len(f), dtype=bool)
            stays[order] = d == least
            gone, left = np.flatnonzero(~stays), np.flatnonzero(stays)
            left = left[np.argsort(part[left], kind="stable")]
            edges = np.flatnonzero(np.diff(part[left])) + 1
            out: list[list] = [[], [], [], []]
            for own in np.split(left, edges) if len(left) else []:
                for col, v in zip(out, (int(part[own[0]]), None, None, _packed(owner[own], pos[own], mid[own], full[own], ids, ks)), strict=True):
                    col.append(v)
            for own in np.split(gone, np.flatnonzero(np.diff(owner[gone])) + 1) if len(gone) else []:
                r = int(owner[own[0]])
                for col, v in zip(out, (-1, int(ids[r]), int(ks[r]), pos[own].astype(np.int32).tobytes()), strict=True):
                    col.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names)

    return keyed.join(grams, ["doc_id", "k"]).select("doc_id", "k", "text", "grams").mapInArrow(work, "part bigint, doc_id bigint, k bigint, payload binary")


def _divided(groups: DataFrame, parts: dict[int, tuple[int, int]], deep: bool) -> DataFrame:
    """Groups dealt to several by their suffixes' next longer prefix; parts: group -> (first new group, how many)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for part, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids, ks, owner, pos, mid, full = _unpacked(raw)
                base, n = parts[part]
                to = (full if deep else mid).astype(np.uint64) % np.uint64(n)
                rows = [(base + int(t), _packed(owner[w], pos[w], mid[w], full[w], ids, ks)) for t in np.unique(to) for w in [np.flatnonzero(to == t)]]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["part", "payload"])

    return groups.mapInArrow(work, "part bigint, payload binary")


def subtree_repeats(table: pa.Table) -> pa.Table:
    """Window starts of one group that repeat a smaller document, by parts of the documents.

    The sorted suffixes are the subtree's leaves; neighbours that agree at depth MIDDLE and at full depth
    hang below one node of that depth, whose first leaf has the smallest document.
    """
    parts = [_unpacked(raw) for raw in table.column("payload").to_pylist()]
    ids = np.concatenate([p[0][p[2]] for p in parts])
    ks = np.concatenate([p[1][p[2]] for p in parts])
    pos, mid, full = (np.concatenate([p[i] for p in parts]) for i in (3, 4, 5))
    order = np.lexsort((pos, ks, ids, full, mid))
    ids, ks, pos, mid, full = ids[order], ks[order], pos[order], mid[order], full[order]
    node = np.ones(len(ids), dtype=bool)
    node[1:] = (mid[1:] != mid[:-1]) | (full[1:] != full[:-1])
    least = ids[np.flatnonzero(node)][np.cumsum(node) - 1]
    hit = np.flatnonzero(ids > least)
    to = _doc_part(ids[hit], ks[hit], table.column("parts")[0].as_py())
    order = np.argsort(to, kind="stable")
    own = np.split(hit[order], np.flatnonzero(np.diff(to[order])) + 1) if len(hit) else []
    return pa.table(
        {
            "to": pa.array(np.unique(to), pa.int64()),
            "payload": pa.array([_listed(ids[w], ks[w], pos[w]) for w in own], pa.binary()),
        }
    )


def _listed(ids: np.ndarray, ks: np.ndarray, pos: np.ndarray) -> bytes:
    """One value for starts: the documents once, then each start's document and place, in that order."""
    docs, owner = np.unique(np.stack([ids, ks], axis=1), axis=0, return_inverse=True)
    owner = owner.reshape(-1)
    order = np.lexsort((pos, owner))
    head = np.array([len(docs), len(pos)], dtype=np.int64)
    return b"".join(x.tobytes() for x in (head, docs, owner[order].astype(np.int32), pos[order].astype(np.int32)))


def _starts_of(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    d, n = np.frombuffer(raw, np.int64, 2).tolist()
    docs = np.frombuffer(raw, np.int64, 2 * d, 16).reshape(d, 2)
    owner = np.frombuffer(raw, np.int32, n, 16 + 16 * d)
    return docs[owner, 0], docs[owner, 1], np.frombuffer(raw, np.int32, n, 16 + 16 * d + 4 * n)


def _doc_part(ids: np.ndarray, ks: np.ndarray, parts: int) -> np.ndarray:
    """Part of the documents that one belongs to when starts are brought together."""
    return (mix(ids.view(np.uint64) * ODD + ks.view(np.uint64)) % np.uint64(parts)).astype(np.int64)


def document_starts(table: pa.Table) -> pa.Table:
    """Starts that the groups found in one part of the documents, per document."""
    ids, ks, pos = (np.concatenate(x) for x in zip(*map(_starts_of, table.column("payload").to_pylist()), strict=True))
    order = np.lexsort((pos, ks, ids))
    ids, ks, pos = ids[order], ks[order], pos[order]
    first = np.ones(len(ids), dtype=bool)
    first[1:] = (ids[1:] != ids[:-1]) | (ks[1:] != ks[:-1])
    at = np.flatnonzero(first)
    return pa.table(
        {
            "doc_id": pa.array(ids[at], pa.int64()), "k": pa.array(ks[at], pa.int64()),
            "starts": pa.array([w.tobytes() for w in np.split(pos, at[1:])], pa.binary()),
        }
    )


def repeat_starts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(doc_id, k, starts): first words (32-bit numbers) of the windows that a document of smaller id has too; k: hash of the text."""
    keyed = _keyed(docs, id_col, text_col)
    spark = docs.sparkSession
    grams = cut(shared_grams(keyed, width))
    n = grams.agg(F.sum(F.size("grams"))).first()[0] or 0
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n * (width - GRAM + 1) // 2 * SUFFIX_BYTES // GROUP_BYTES))
    dealt = stored(suffix_groups(keyed, grams, groups, width), "suffixes")
    release(spark)
    decided = dealt.filter("part < 0").select("doc_id", "k", F.col("payload").alias("starts"))
    left = dealt.filter("part >= 0").select("part", "payload")
    for deep in (False, True):
        sizes = left.groupBy("part").agg(F.sum(F.octet_length("payload")).alias("bytes")).filter(F.col("bytes") > MOST_BYTES).collect()
        if not sizes:
            break
        top = left.agg(F.max("part")).first()[0] + 1
        parts = {}
        for r in sorted(sizes):
            count = -(-2 * r["bytes"] // GROUP_BYTES)
            parts[r["part"]] = top, count
            top += count
        large = F.col("part").isin(list(parts))
        left = stored(left.filter(~large).unionByName(_divided(left.filter(large), parts, deep)), "suffixes")
    found = left.withColumn("parts", F.lit(groups)).groupBy("part").applyInArrow(subtree_repeats, "to bigint, payload binary")
    starts = stored(decided.unionByName(found.groupBy("to").applyInArrow(document_starts, RESULT)), "starts")
    discard(dealt)
    return starts


def _covered(n: int, starts: list[bytes], width: int) -> np.ndarray:
    at = np.concatenate([np.frombuffer(s, np.int32) for s in starts])
    steps = np.zeros(n + 1, dtype=np.int64)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + width, -1)
    return np.cumsum(steps[:n]) > 0


def _cut_rows(batch: pa.RecordBatch, text: int, starts: int, width: int) -> Iterator[tuple[list[bytes], int]]:
    """(words kept, how many there were) of each row."""
    for t, s in zip(batch.column(text).to_pylist(), batch.column(starts).to_pylist(), strict=True):
        own = (t or "").encode().split()
        kept = [w for w, gone in zip(own, _covered(len(own), s, width).tolist(), strict=True) if not gone] if s else own
        yield kept, len(own)


def _with_starts(rows: DataFrame, starts: DataFrame) -> DataFrame:
    gathered = starts.groupBy("doc_id", "k").agg(F.collect_list("starts").alias("starts"))
    return rows.join(gathered.withColumnsRenamed({"doc_id": "_d", "k": "_k"}), (F.col("doc_id") == F.col("_d")) & (F.col("k") == F.col("_k")), "left")


def digest_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256 of the kept words joined by one blank."""
    keyed = _keyed(docs, id_col, text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            rows = [(n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()) for kept, n in _cut_rows(batch, 1, 2, width)]
            n, gone, sha = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"]
            )

    joined = _with_starts(keyed, repeat_starts(docs, id_col, text_col, width)).select("doc_id", "text", "starts")
    return joined.mapInArrow(work, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """``docs`` with their own columns; texts that lose words become the kept words joined by one blank."""
    names = docs.columns
    outer = docs.select(
        F.struct(*[docs[c] for c in names]).alias("row"), docs[id_col].cast("bigint").alias("doc_id"), F.xxhash64(docs[text_col].cast("string")).alias("k")
    )
    joined = _with_starts(outer, repeat_starts(docs, id_col, text_col, width)).select("row", F.col(f"row.`{text_col}`").cast("string").alias("text"), "starts")
    schema = StructType([joined.schema["row"], StructField("new", StringType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            new = [b" ".join(kept).decode() if len(kept) < n else None for kept, n in _cut_rows(batch, 1, 2, width)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(new, pa.string())], ["row", "new"])

    made = joined.mapInArrow(work, schema)
    return made.select(*[F.coalesce("new", F.col(f"row.`{c}`")).alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in names])
