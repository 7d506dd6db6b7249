"""Page matching against a plain walk in page order."""

import random

from pyspark.sql import functions as F

from pagelake.operators.versions import assign_versions, jaccard, match_versions, suggest_versions

SLIDES = "slide_id bigint, version_id int, page_no bigint, fingerprint string, sig bigint"


def walk(old, new):
    """Greedy matching of one version pair, page by page."""
    first = lambda side: {fp: s for s in sorted(side, key=lambda s: -s[2]) if (fp := s[3])}
    old_fp, new_fp = first(old), first(new)
    rows, used_old, used_new = [], set(), set()
    for fp, n in new_fp.items():
        if fp in old_fp:
            o = old_fp[fp]
            rows.append((o[0], n[0], "unchanged" if o[2] == n[2] else "rearranged", 1.0))
            used_old.add(o[0])
            used_new.add(n[0])
    free = [o for o in sorted(old, key=lambda s: s[2]) if o[0] not in used_old]
    for n in sorted(new, key=lambda s: s[2]):
        if n[0] in used_new:
            continue
        best = None
        for o in free:
            if n[4] is None or o[4] is None:
                continue
            d = bin((n[4] ^ o[4]) & (2**64 - 1)).count("1")
            if best is None or d < best[0]:
                best = (d, o)
        if best and best[0] <= 8:
            rows.append((best[1][0], n[0], "modified", 1 - best[0] / 64))
            free.remove(best[1])
        else:
            rows.append((None, n[0], "added", 0.0))
    rows += [(o[0], None, "deleted", 0.0) for o in free]
    return rows


def cases(seed, n_pairs):
    """Pairs with many copies, near copies and ties: few base signatures, few flipped bits."""
    rng = random.Random(seed)
    slides, pairs, next_id = [], [], 1
    for p in range(n_pairs):
        bases = [rng.getrandbits(64) for _ in range(rng.choice([1, 2, 3]))]
        width = rng.choice([2, 4, 9])
        for side in (0, 1):
            for page in range(1, rng.randint(1, 14)):
                sig = rng.choice(bases)
                for _ in range(rng.randint(0, 3)):
                    sig ^= 1 << rng.randrange(width)
                if sig >= 1 << 63:
                    sig -= 1 << 64
                fp = rng.choice(["", f"f{rng.randrange(6)}", f"u{next_id}", f"u{next_id}"])
                slides.append((next_id, 2 * p + side, page, fp, None if rng.random() < 0.08 else sig))
                next_id += 1
        pairs.append((2 * p, 2 * p + 1))
    return slides, pairs


def test_matches_equal_the_walk(table):
    slides, pairs = cases(7, 120)
    got = match_versions(table(pairs, "from_version_id int, to_version_id int"), table(slides, SLIDES)).collect()
    by_pair = {}
    for r in got:
        by_pair.setdefault((r.from_version_id, r.to_version_id), []).append((r.from_slide_id, r.to_slide_id, r.match_type, r.score))
    key = lambda r: tuple(str(x) for x in r)
    kinds = set()
    for old_v, new_v in pairs:
        expected = walk([s for s in slides if s[1] == old_v], [s for s in slides if s[1] == new_v])
        kinds |= {r[2] for r in expected}
        assert sorted(by_pair.get((old_v, new_v), []), key=key) == sorted(expected, key=key), (old_v, new_v)
    assert kinds == {"unchanged", "rearranged", "modified", "added", "deleted"}


def test_many_copies_take_pages_in_order(table):
    """300 copies on both sides: settled by seats, not by all pairs."""
    old = [(i, 0, i, f"o{i}", 5) for i in range(1, 301)]
    new = [(1000 + i, 1, i, f"n{i}", 5) for i in range(1, 311)]
    got = match_versions(table([(0, 1)], "from_version_id int, to_version_id int"), table(old + new, SLIDES)).collect()
    near = {(r.from_slide_id, r.to_slide_id) for r in got if r.match_type == "modified"}
    assert near == {(i, 1000 + i) for i in range(1, 301)}
    assert sum(r.match_type == "added" for r in got) == 10


def test_suggestions_equal_all_pairs(table):
    rng = random.Random(3)
    rows, n = [], 0
    for v in range(1, 31):
        pool = [f"{v % 6}-{i}" for i in range(12)] + ["boiler"] * 4
        for page in range(1, rng.randint(2, 14)):
            n += 1
            rows.append((n, v, page, rng.choice(pool), None))
    slides = table(rows, SLIDES)
    pres = table([(v, f"deck {v}", v, None if v % 7 else "2024-01-01") for v in range(1, 31)],
                 "presentation_id int, title string, current_version_id int, deleted_at string")
    got = {(r.version_id, r.presentation_id, r.similarity, r.page_count) for r in suggest_versions(slides, slides, pres).collect()}
    sets = {v: {r[3] for r in rows if r[1] == v} for v in range(1, 31)}
    size = {v: sum(r[1] == v for r in rows) for v in range(1, 31)}
    want = set()
    for a in sets:
        for b in sets:
            if b % 7 and sets[a] and sets[b]:
                j = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
                if j >= 0.5:
                    want.add((a, b, round(j, 3), size[b]))
    assert got == want


def test_jaccard_of_empty_sets_is_zero(table):
    sets = table([(1, "a")], "version_id int, fingerprint string")
    out = jaccard(sets, sets, table([(1, 1), (2, 3), (1, 2)], "left_id int, right_id int")).collect()
    assert {(r.left_id, r.right_id): r.jaccard for r in out} == {(1, 1): 1.0, (2, 3): 0.0, (1, 2): 0.0}


def test_assign_versions(table):
    files = table([(1, 10), (2, 10), (3, None), (4, 11), (5, 12), (6, 99)], "file_id bigint, parent_presentation_id int")
    versions = table([(10, 1), (10, 4)], "presentation_id int, version_no int")
    pres = table([(10, None), (11, None), (12, "x")], "presentation_id int, deleted_at string").withColumn("title", F.lit("t"))
    got = {r.file_id: (r.version_no, r.is_current, r.error) for r in assign_versions(files, versions, pres).collect()}
    assert got == {1: (5, False, None), 2: (6, True, None), 3: (1, True, None), 4: (1, True, None),
                   5: (None, False, "INVALID_PARENT"), 6: (None, False, "INVALID_PARENT")}


def test_many_equidistant_pages_settle(table):
    """Every new page is two bits from every old one: one line of seats, filled in page order."""
    n = 30
    old = [(i + 1, 1, i, f"o{i}", 1 << i) for i in range(n)]
    new = [(1000 + i, 2, i, f"n{i}", 1 << (i + n)) for i in range(n)]
    got = match_versions(table([(1, 2)], "from_version_id int, to_version_id int"), table(old + new, SLIDES)).collect()
    assert {(r.from_slide_id, r.to_slide_id, r.match_type) for r in got} == {(i + 1, 1000 + i, "modified") for i in range(n)}


def test_threshold_just_met_is_suggested(table):
    """Sets of Jaccard exactly 0.55, whose product with the size lands above a whole number."""
    shared, one, two = [f"s{i}" for i in range(55)], [f"a{i}" for i in range(22)], [f"b{i}" for i in range(23)]
    pages = lambda version, fps: [(version * 1000 + i, version, i, fp, 0) for i, fp in enumerate(fps)]
    files = table([(5, "deck", 2, None)], "presentation_id int, title string, current_version_id int, deleted_at timestamp")
    got = suggest_versions(table(pages(1, shared + one), SLIDES), table(pages(2, shared + two), SLIDES), files, threshold=0.55).collect()
    assert [(r.presentation_id, r.similarity) for r in got] == [(5, 0.55)]
