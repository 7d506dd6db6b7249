"""Page signatures, duplicate groups and similar pages."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.constants import NEAR_DISTANCE, SIMILAR_DEPTH
from pagelake.functions.scalar import bit_distance, bits_to_hex
from pagelake.functions.text import bound, tokens
from pagelake.operators.components import components
from pagelake.operators.hamming import near_links, near_pairs
from pagelake.operators.ranks import top_k
from pagelake.operators.scope import text_bearing
from pagelake.session import cut, stored

SHINGLE = 3
# Shingles whose votes, and whose digests, are held together.
VOTE_ROWS = 65536
MD5_ROWS = 8192
# Bytes of tokens that are worked on together, about.
HELD_BYTES = 4 << 20


_K = np.floor(np.abs(np.sin(np.arange(1, 65))) * 2.0**32).astype(np.uint32)
# Row n: 1 for the first n bytes of a block.
_BEFORE = (np.arange(64) < np.arange(56)[:, None]).astype(np.uint8)
# The bits of a byte, the highest first, as bytes of a number.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64)[:, 0]
_TURNS = np.array([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]], dtype=np.uint32)


def _md5_heads(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The leading 8 bytes of the MD5 (RFC 1321) of ``data[at : at + size]``, one row each; those of one block together."""
    out = np.empty((len(at), 8), dtype=np.uint8)
    padded = np.concatenate([data, np.zeros(64, np.uint8)])
    short = np.flatnonzero(size <= 55)
    for some in np.array_split(short, -(-len(short) // MD5_ROWS)) if len(short) else []:
        n = size[some]
        width = max(int(n.max()), 1)
        block = np.zeros((len(some), 64), dtype=np.uint8)
        block[:, :width] = np.lib.stride_tricks.sliding_window_view(padded, width)[at[some]]
        block *= _BEFORE[n]
        block[np.arange(len(some)), n] = 0x80
        words = np.ascontiguousarray(block.view("<u4").T)
        words[14] = n * 8
        start = [np.full(len(some), v, dtype=np.uint32) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
        a, b, c, d = start
        for i in range(64):
            turn = _TURNS[i // 16, i % 4]
            if i < 16:
                f, g = d ^ (b & (c ^ d)), i
            elif i < 32:
                f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
            elif i < 48:
                f, g = b ^ c ^ d, (3 * i + 5) % 16
            else:
                f, g = c ^ (b | ~d), 7 * i % 16
            f += a
            f += _K[i]
            f += words[g]
            a, d, c, b = d, c, b, b + ((f << turn) | (f >> (np.uint32(32) - turn)))
        out[some] = np.stack([a + start[0], b + start[1]], axis=1).astype("<u4").view(np.uint8)
    for i in np.flatnonzero(size > 55):
        out[i] = np.frombuffer(hashlib.md5(data[at[i] : at[i] + size[i]].tobytes()).digest()[:8], dtype=np.uint8)
    return out


def _signatures(texts: pa.Array) -> np.ndarray:
    """Bitwise majority over the digests of each text's shingles, as signed numbers; words are parted by a blank, no text is empty."""
    texts = texts.cast(pa.large_string())
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data, offsets = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]
    blanks = np.flatnonzero(data == 32)
    start, end = np.sort(np.concatenate([offsets[:-1], blanks + 1])), np.sort(np.concatenate([blanks, offsets[1:]]))
    first = np.searchsorted(start, offsets)
    shingles = np.maximum(np.diff(first) - (SHINGLE - 1), 1)
    begin = np.cumsum(shingles) - shingles
    word = np.arange(int(shingles.sum())) + np.repeat(first[:-1] - begin, shingles)
    last = np.minimum(word + SHINGLE - 1, np.repeat(first[1:] - 1, shingles))
    votes = np.zeros((len(texts), 64), dtype=np.int64)
    owner = np.repeat(np.arange(len(texts)), shingles)
    for lo in range(0, len(word), VOTE_ROWS):
        own = owner[lo : lo + VOTE_ROWS]
        heads = _md5_heads(data, start[word[lo : lo + VOTE_ROWS]], (end[last] - start[word])[lo : lo + VOTE_ROWS])
        # bits are added up as bytes, eight to a number, 255 shingles at most
        cuts = np.union1d(np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])), np.arange(0, len(own), 255))
        np.add.at(votes, own[cuts], np.add.reduceat(_SPREAD[heads], cuts, axis=0).view(np.uint8))
    return np.packbits(votes * 2 > shingles[:, None], axis=1).view(">i8")[:, 0].astype(np.int64)


def signature64(df: DataFrame, key: str = "slide_id", text: str = "native_text") -> DataFrame:
    """(key, sig, signature): 64-bit similarity hash of the page's token shingles (Charikar 2002).

    Every shingle votes on 64 bits with the leading half of its MD5. A page is signed where it
    lies: tokens in the JVM, digests and the vote in numpy, some megabytes of tokens at a time; nothing is
    shuffled. Pages without tokens have no row.
    """

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column(1).is_valid())
            ends = np.cumsum(pc.binary_length(batch.column(1)).to_numpy().astype(np.int64))
            at = 0
            while at < batch.num_rows:
                to = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + HELD_BYTES, side="right")), at + 1)
                some = batch.slice(at, to - at)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(_signatures(some.column(1)))], [key, "sig"])
                at = to

    joined = bound(tokens(F.col(text)), lambda t: F.when(F.size(t) > 0, F.array_join(t, " ")))
    worded = df.select(F.col(key).cast("bigint").alias(key), joined.alias("words"))
    signed = worded.mapInArrow(vote, f"{key} bigint, sig bigint")
    return signed.withColumn("signature", bits_to_hex(F.col("sig")))


def collapsed(signed: DataFrame) -> DataFrame:
    """One row per signature: its least page and its number of pages."""
    return signed.filter(F.col("sig").isNotNull()).groupBy("sig").agg(
        F.min("slide_id").alias("slide_id"), F.count(F.lit(1)).alias("copies")
    )


def fingerprinted(slides: DataFrame) -> DataFrame:
    """(slide_id, fingerprint) of text-bearing pages, written: a fingerprint reads the whole text, and a filter on one that is not written
    would be moved below the scope and read the text of every page."""
    written = stored(text_bearing(slides).select("slide_id", "fingerprint"), "fingerprints")
    return written.filter(F.coalesce("fingerprint", F.lit("")) != "")


def _shared(pages: DataFrame) -> DataFrame:
    return pages.groupBy("fingerprint").agg(F.min("slide_id").alias("group_id"), F.count(F.lit(1)).alias("group_size")).filter(F.col("group_size") >= 2)


def exact_groups(slides: DataFrame) -> DataFrame:
    """(fingerprint, group_id, group_size) of fingerprints shared by at least two text-bearing pages."""
    return _shared(fingerprinted(slides))


def similar_signature_pairs(signed: DataFrame, distance: int = NEAR_DISTANCE) -> DataFrame:
    """Distinct signatures within ``distance`` bits, each shown by its least page and its copies."""
    reps = cut(collapsed(signed))
    pairs = near_pairs(reps, distance=distance)
    left = reps.select(F.col("sig").alias("sig_a"), F.col("slide_id").alias("slide_a"), F.col("copies").alias("copies_a"))
    right = reps.select(F.col("sig").alias("sig_b"), F.col("slide_id").alias("slide_b"), F.col("copies").alias("copies_b"))
    return pairs.join(left, "sig_a").join(right, "sig_b")


def similar_clusters(signed: DataFrame, distance: int = NEAR_DISTANCE) -> DataFrame:
    """(slide_id, cluster_id, cluster_size, distance): chains of near signatures with at least two pages.

    Works on distinct signatures and on links that join what their pairs join; pages join back at the end. The cluster's id and
    representative is its least page, ``distance`` is each page's distance to it.
    """
    reps = cut(collapsed(signed))
    links = near_links(reps, distance=distance)
    first = reps.select(F.col("sig").alias("sig_a"), F.col("slide_id").alias("u"))
    second = reps.select(F.col("sig").alias("sig_b"), F.col("slide_id").alias("v"))
    edges = links.join(first, "sig_a").join(second, "sig_b").select("u", "v")
    found = components(edges)
    labelled = reps.join(found, reps.slide_id == found.node, "left").select(
        "sig", "slide_id", "copies", F.coalesce("component", "slide_id").alias("cluster_id")
    )
    sizes = labelled.groupBy("cluster_id").agg(F.sum("copies").alias("cluster_size")).filter(F.col("cluster_size") >= 2)
    heads = reps.select(F.col("slide_id").alias("cluster_id"), F.col("sig").alias("head_sig"))
    table = labelled.select("sig", "cluster_id").join(sizes, "cluster_id").join(heads, "cluster_id")
    return signed.select("slide_id", "sig").join(table, "sig").select(
        "slide_id", "cluster_id", "cluster_size", bit_distance(F.col("sig"), F.col("head_sig")).alias("distance")
    )


def duplicate_groups(slides: DataFrame, signed: DataFrame, distance: int = NEAR_DISTANCE) -> DataFrame:
    """Members of exact and similar groups of the scoped pages, one row per member.

    Listing order: exact before similar, larger groups first, then by file title and page inside
    exact groups and by distance and page inside similar ones. Use ``listing_order``.
    """
    shown = slides.select("slide_id", "fingerprint", "page_no", "title", "presentation_id", "presentation_title")
    pages = fingerprinted(slides)
    exact = pages.join(_shared(pages), "fingerprint").select(
        "slide_id", F.lit("exact").alias("kind"), "group_id", "group_size", F.lit(None).cast("int").alias("distance")
    )
    similar = similar_clusters(signed, distance).select(
        "slide_id", F.lit("similar").alias("kind"), F.col("cluster_id").alias("group_id"),
        F.col("cluster_size").alias("group_size"), "distance",
    )
    return exact.unionByName(similar).join(shown.drop("fingerprint"), "slide_id")


def listing_order():
    by_kind = F.when(F.col("kind") == "exact", 0).otherwise(1)
    inside = F.when(F.col("kind") == "exact", F.coalesce("presentation_title", F.lit("")))
    return [by_kind, F.col("group_size").desc(), F.col("group_id"), F.col("distance"), inside, F.col("page_no"), F.col("slide_id")]


def duplicate_summary(groups: DataFrame) -> DataFrame:
    """Groups and pages per kind."""
    return groups.groupBy("kind").agg(F.countDistinct("group_id").alias("groups"), F.count(F.lit(1)).alias("pages"))


def similar_slides(
    probes: DataFrame, slides: DataFrame, signed: DataFrame, distance: int = NEAR_DISTANCE, topn: int = SIMILAR_DEPTH
) -> DataFrame:
    """(slide_id, other_id, distance, rank): the nearest other pages of every probe page.

    Equal fingerprints count as distance 0. ``probes`` needs slide_id. Copies never meet copies:
    a group of equal fingerprints or signatures offers only its first ``topn + 1`` pages, which is
    all a probe inside or outside the group can use.
    """
    offered = topn + 1
    pages = fingerprinted(slides)
    sigs = signed.filter(F.col("sig").isNotNull()).select("slide_id", "sig")

    same_text = top_k(pages, ["fingerprint"], [F.col("slide_id")], offered).select(
        "fingerprint", F.col("slide_id").alias("other_id"), F.lit(0).alias("distance")
    )
    reps = cut(collapsed(sigs)).select("sig")
    pairs = near_pairs(reps, distance=distance)
    both_ways = (
        pairs.select(F.col("sig_a").alias("sig"), F.col("sig_b").alias("near"), "distance")
        .unionByName(pairs.select(F.col("sig_b").alias("sig"), F.col("sig_a").alias("near"), "distance"))
        .unionByName(reps.select("sig", F.col("sig").alias("near"), F.lit(0).alias("distance")))
    )
    members = top_k(sigs, ["sig"], [F.col("slide_id")], offered).select(
        F.col("sig").alias("near"), F.col("slide_id").alias("other_id")
    )
    per_sig = top_k(
        both_ways.join(members, "near"), ["sig"], [F.col("distance"), F.col("other_id")], offered
    ).select("sig", "other_id", "distance")

    wanted = probes.select("slide_id")
    by_text = wanted.join(pages, "slide_id").join(same_text, "fingerprint").select("slide_id", "other_id", "distance")
    by_sig = wanted.join(sigs, "slide_id").join(per_sig, "sig").select("slide_id", "other_id", "distance")
    nearest = (
        by_text.unionByName(by_sig)
        .filter(F.col("slide_id") != F.col("other_id"))
        .repartition("slide_id")  # both sides may be dealt by page, yet into partitions of different numbers
        .groupBy("slide_id", "other_id")
        .agg(F.min("distance").alias("distance"))
    )
    return top_k(nearest, ["slide_id"], [F.col("distance"), F.col("other_id")], topn)
