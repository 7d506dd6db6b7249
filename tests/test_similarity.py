"""Similarity join, components and duplicate groups against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelake.operators import dedup
from pagelake.operators.components import components
from pagelake.operators.dedup import similar_clusters, similar_slides
from pagelake.operators.hamming import Blocking, choose_blocking, near_links, near_pairs


def apart(a, b):
    return bin((a ^ b) & (2**64 - 1)).count("1")


def signed(value):
    return value - (1 << 64) if value >= 1 << 63 else value


def planted(seed, n):
    rng = random.Random(seed)
    out = set()
    while len(out) < n:
        base = rng.getrandbits(64)
        out.add(signed(base))
        for _ in range(3):
            near = base
            for bit in rng.sample(range(64), rng.randint(1, 10)):
                near ^= 1 << bit
            out.add(signed(near))
    return sorted(out)


@pytest.mark.parametrize("extra", [1, 2, 3])
def test_pairs_are_complete_and_single(table, extra):
    sigs = planted(extra, 400)
    df = table([(s,) for s in sigs], "sig bigint")
    got = [(r.sig_a, r.sig_b, r.distance) for r in near_pairs(df, blocking=Blocking(8, extra)).collect()]
    want = {(a, b, apart(a, b)) for i, a in enumerate(sigs) for b in sigs[i + 1 :] if apart(a, b) <= 8}
    assert len(got) == len(set(got)) and set(got) == want and want


def test_two_sided_pairs_stay_within_keys(table):
    rng = random.Random(5)
    sigs = planted(9, 200)
    left = {(rng.randrange(3), s) for s in sigs}
    right = {(rng.randrange(3), s) for s in sigs}
    got = near_pairs(table(list(left), "k int, l bigint"), table(list(right), "k int, r bigint"), on=["k"], left_sig="l", right_sig="r")
    want = {(k, a, b) for k, a in left for j, b in right if j == k and apart(a, b) <= 8}
    assert {(r.k, r.sig_a, r.sig_b) for r in got.collect()} == want


def union_find(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in list(parent)}


def test_components(table):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]
    edges += [(1000 + i, 1001 + i) for i in range(60)]  # a chain
    edges += [(2000, 2001 + i) for i in range(80)]  # a star
    edges = [(a, b) for a, b in edges if a != b]
    got = {r.node: r.component for r in components(table(edges, "u bigint, v bigint")).collect()}
    assert got == union_find(edges)


def pages(table):
    rng = random.Random(11)
    rows = []
    for n in range(1, 161):
        sig = rng.choice([0, 0b11, 0b1111 << 20, (1 << 40) - 1, 1 << 63]) ^ (rng.getrandbits(3) << rng.randrange(50))
        text = rng.choice(["x", "x", "y", " "])
        rows.append((n, text, f"fp{rng.randrange(60)}", None if n % 37 == 0 else signed(sig)))
    return rows, table(rows, "slide_id bigint, native_text string, fingerprint string, sig bigint")


def test_similar_slides_equal_all_pairs(table):
    rows, df = pages(table)
    got = {}
    for r in similar_slides(df, df, df).collect():
        got.setdefault(r.slide_id, []).append((r["rank"], r.distance, r.other_id))
    for a in rows:
        found = []
        for b in rows:
            if a[0] == b[0]:
                continue
            if a[1].strip() and b[1].strip() and a[2] == b[2]:
                found.append((0, b[0]))
            elif a[3] is not None and b[3] is not None and apart(a[3], b[3]) <= 8:
                found.append((apart(a[3], b[3]), b[0]))
        want = [(i + 1, *x) for i, x in enumerate(sorted(found)[:10])]
        assert sorted(got.get(a[0], [])) == want, a


def test_clusters_equal_union_find(table):
    rows, df = pages(table)
    known = {r[0]: r[3] for r in rows if r[3] is not None}
    ids = sorted(known)
    edges = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if apart(known[a], known[b]) <= 8]
    want = union_find(edges)
    got = {r.slide_id: (r.cluster_id, r.distance) for r in similar_clusters(df.select("slide_id", "sig")).collect()}
    assert got == {n: (c, apart(known[n], known[c])) for n, c in want.items()}
    assert df.filter(F.col("sig").isNull()).count() > 0


@pytest.mark.parametrize("tile", [30, 75])
def test_tiles_lose_no_pair_and_links_join_the_same(table, tile):
    """Half of the signatures share all bits but the last twelve: their buckets are far above a tile."""
    rng = random.Random(tile)
    sigs = sorted({signed((0xABCDEF << 40) | rng.getrandbits(12)) for _ in range(150)} | set(planted(3, 150)))
    df = table([(s,) for s in sigs], "sig bigint")
    want = {(a, b, apart(a, b)) for i, a in enumerate(sigs) for b in sigs[i + 1 :] if apart(a, b) <= 4}
    got = [tuple(r) for r in near_pairs(df, distance=4, tile=tile).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    links = [tuple(r) for r in near_links(df, distance=4, tile=tile).collect()]
    assert union_find(links) == union_find([(a, b) for a, b, _ in want])
    keyed = table([(k, s) for k in (1, 2) for s in sigs], "k int, sig bigint")
    both = [(r.k, r.sig_a, r.sig_b) for r in near_pairs(keyed, keyed, on=["k"], distance=4, tile=tile).collect()]
    near = {(a, b) for a, b, _ in want} | {(b, a) for a, b, _ in want} | {(s, s) for s in sigs}
    assert len(both) == len(set(both)) and set(both) == {(k, a, b) for k in (1, 2) for a, b in near}


def test_a_bucket_of_20000_signatures_gives_few_links(spark):
    """All agree on the first block, 147,652,912 pairs of them are near; 10 tiles meet in 55 groups."""
    sigs = spark.range(20_000).select(F.shiftleft("id", 7).alias("sig"))
    edges = near_links(sigs, distance=8, blocking=Blocking(8, 1)).collect()
    assert len(edges) <= 55 * 2 * 2300
    assert set(union_find([tuple(r) for r in edges]).values()) == {0}


def test_blocking_follows_the_number_of_signatures(spark):
    few, many = (spark.range(n).select(F.col("id").alias("sig")) for n in (1_000, 200_000))
    assert len(choose_blocking([few], [], 8).blocks) == 9
    assert len(choose_blocking([many], [], 8).blocks) == 11


def test_rows_of_block_choices_are_not_broadcast(spark, table, tmp_path):
    rnd = random.Random(4)
    sigs = [rnd.getrandbits(63) for _ in range(300)]
    table([(s,) for s in sigs] + [(s ^ 5,) for s in sigs], "sig bigint").distinct().write.parquet(str(tmp_path / "sigs"))
    stored = spark.read.parquet(str(tmp_path / "sigs"))
    for near in (near_pairs(stored), near_pairs(stored, stored), near_links(stored), near_pairs(stored, tile=2)):
        plan = near._jdf.queryExecution().executedPlan().toString()
        left, right = (i for i in (plan.find("SortMergeJoin [choice"), plan.find("BroadcastHashJoin [choice")))
        assert left >= 0 and (right < 0 or left < right)
    assert {(r.sig_a, r.sig_b) for r in near_pairs(stored).collect()} >= {(min(s, s ^ 5), max(s, s ^ 5)) for s in sigs}


def test_signatures_are_votes_over_md5_of_shingles(table, monkeypatch):
    monkeypatch.setattr(dedup, "VOTE_ROWS", 700)
    monkeypatch.setattr(dedup, "MD5_ROWS", 64)
    monkeypatch.setattr(dedup, "HELD_BYTES", 2000)
    rnd = random.Random(6)
    texts = [" ".join("".join(rnd.choice("abé0") for _ in range(rnd.choice([1, 4, 9, 19, 60]))) for _ in range(n)) for n in (1, 2, 3, 4, 40, 900)]
    rows = [(i, t) for i, t in enumerate([*texts, "", None, "漢字 x", "x" * 200])]

    def by_hand(words):
        shingles = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))]
        heads = [int.from_bytes(hashlib.md5(s.encode()).digest()[:8], "big") for s in shingles]
        return f"{sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in heads) > len(heads)):016x}"

    got = {r.slide_id: r.signature for r in dedup.signature64(table(rows, "slide_id bigint, native_text string")).collect()}
    want = {i: by_hand(t.split()) for i, t in rows[:6]} | {8: by_hand(["漢", "字", "x"]), 9: by_hand(["x" * 200])}
    assert got == want
    found = dedup._md5_heads(np.frombuffer(b"-abc" * 40, np.uint8), np.array([1, 1, 0]), np.array([3, 0, 100]))
    assert [bytes(f) for f in found] == [hashlib.md5(t).digest()[:8] for t in (b"abc", b"", b"-abc" * 25)]


def test_fingerprints_are_read_once(spark, table, monkeypatch):
    """Groups meet written fingerprints: no expression over the text is left in the plan that groups and joins them."""
    written = []
    monkeypatch.setattr(dedup, "stored", lambda df, name, real=dedup.stored: (written.append(name), real(df, name))[1])
    rows = [(1, "a b c"), (2, "A  b c"), (3, "d"), (4, " ")]
    pages = table(rows, "slide_id bigint, native_text string").withColumn("fingerprint", F.sha2(F.lower(F.regexp_replace("native_text", " ", "")), 256))
    groups = dedup.exact_groups(pages)
    assert written == ["fingerprints"] and "sha2" not in groups._jdf.queryExecution().toString()
    assert [(r.group_id, r.group_size) for r in groups.collect()] == [(1, 2)]
