"""Substring dedup, Jaccard join, fingerprints and sharding against brute force."""

import hashlib
import random
import zlib

from pagelake.llm import jaccard_join, sharding, simhash, substring_dedup

SCHEMA = "doc_id bigint, text string, k string, grams string, n int"


def corpus(seed, n=70, width=50):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = [rnd.choice(vocabulary) for _ in range(width + 15)]
    rows = []
    for i in range(n):
        words = [rnd.choice(vocabulary) for _ in range(rnd.choice([0, 1, 4, 20, 60, 200]))]
        kind = rnd.random()
        if kind < 0.3 and rows:
            words = list((rnd.choice(rows)[1] or "").split())
            for _ in range(rnd.choice([0, 1, 3])):
                if words:
                    words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
        elif kind < 0.5:
            words[len(words) // 2 : len(words) // 2] = passage[: rnd.choice([49, 50, 51, 65])]
        elif kind < 0.6:
            words = ["a"] * rnd.choice([49, 50, 120])
        rows.append((i * 3 + 1, rnd.choice([" ", "\n", "\t "]).join(words), "x", "y", 0))
    rows += [(5000, None, "x", "y", 0), (rows[3][0], rows[3][1], "x", "y", 0)]
    return rows


def cleaned(rows, width=50):
    seen = {}
    for i, text, *_ in sorted(rows, key=lambda r: r[0]):
        w = (text or "").split()
        for k in range(len(w) - width + 1):
            seen.setdefault(tuple(w[k : k + width]), i)
    out = set()
    for i, text, *_ in rows:
        w = (text or "").split()
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if seen[tuple(w[k : k + width])] < i:
                gone[k : k + width] = [True] * width
        out.add((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def test_substring_dedup_equals_brute_force(spark, table):
    for seed in (1, 2):
        rows = corpus(seed)
        docs = table(rows, SCHEMA)
        expected = {(i, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, n, gone, kept in cleaned(rows)}
        got = substring_dedup.digest_documents(docs).collect()
        assert len(got) == len(rows) and {tuple(r) for r in got} == expected


def test_substring_dedup_divides_large_groups(spark, table, monkeypatch):
    monkeypatch.setattr(substring_dedup, "MOST_BYTES", 200)
    monkeypatch.setattr(substring_dedup, "GROUP_BYTES", 200)
    rows = corpus(4)
    got = {(r["doc_id"], r["n_removed"]) for r in substring_dedup.digest_documents(table(rows, SCHEMA)).collect()}
    assert got == {(i, gone) for i, _, gone, _ in cleaned(rows)}


def test_substring_dedup_keeps_columns(table):
    rows = corpus(3, 30)
    docs = table(rows, SCHEMA)
    out = substring_dedup.without_repeats(docs)
    assert out.columns == docs.columns and out.count() == len(rows)
    changed = {(i, kept) for i, _, gone, kept in cleaned(rows) if gone}
    assert changed <= {(r["doc_id"], r["text"]) for r in out.collect()}
    assert substring_dedup.digest_documents(table([(None, "a b", "", "", 0)], SCHEMA)).first()["n_removed"] == 0
    assert substring_dedup.digest_documents(table([], SCHEMA)).count() == 0


def shingles(text, width=5):
    w = [x.lower() for x in (text or "").split()]
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def grouped(rows):
    sets = {i: shingles(t) for i, t, *_ in rows if i is not None}
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    own = sorted(sets)
    for x, a in enumerate(own):
        for b in own[:x]:
            same = len(sets[a] & sets[b])
            if same and 100 * same >= 80 * (len(sets[a]) + len(sets[b]) - same):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {(i, len(sets[i]), find(i)) for i in sets}


def test_jaccard_components_equal_brute_force(spark, table):
    for seed in (11, 12):
        rows = corpus(seed, 90)
        got = jaccard_join.linked(table(rows, SCHEMA)).collect()
        assert len(got) == len(rows) and {tuple(r) for r in got} == grouped(rows)


def test_jaccard_border_and_rows(spark, table):
    base = [f"t{i}" for i in range(13)]  # nine shingles
    other = [*base, "u"]  # ten: 9 of 10
    far = base[:9] + ["v", "w", "x", "y"]  # five in common with base: 5 of 13
    rows = [(9, " ".join(base), "", "", 0), (4, " ".join(other).upper(), "", "", 0), (2, " ".join(far), "", "", 0), (7, "", "", "", 0), (None, " ".join(base), "", "", 0)]
    got = {(r["doc_id"], r["component_id"]) for r in jaccard_join.linked(table(rows, SCHEMA)).collect()}
    assert got == {(9, 4), (4, 4), (2, 2), (7, 7), (None, None)}
    kept = jaccard_join.keep_first(table(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "k", "grams", "n"] and {r["doc_id"] for r in kept.collect()} == {4, 2, 7, None}
    assert jaccard_join.linked(table([], SCHEMA)).count() == 0


def test_chain_of_near_copies_is_one_component(spark, table):
    words = [f"t{i}" for i in range(100)]
    rows = []
    for i in range(30):
        words = list(words)
        words[(7 * i) % 100] = f"n{i}"
        rows.append((i, " ".join(words), "", "", 0))
    assert {r["component_id"] for r in jaccard_join.linked(table(rows, SCHEMA)).collect()} == {r[2] for r in grouped(rows)}


def test_links_of_distinct_sets_equal_brute_force(spark, table, monkeypatch):
    monkeypatch.setattr(jaccard_join, "MEETING_ROWS", 4)
    words = [f"t{i}" for i in range(120)]
    rows = [r for r in corpus(13, 60) if r[0] != 5000]
    rows += [(1000 + i, " ".join([*words[: 4 * i], f"n{i}", *words[4 * i + 1 :]]), "", "", 0) for i in range(12)]
    rows += [(2000, rows[-1][1], "", "", 0), (None, rows[-1][1], "", "", 0)]
    least = {}
    for doc, text, *_ in rows:
        own = text.lower().split()
        grams = frozenset(tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))) if own else None
        if grams and doc is not None:
            least[grams] = min(doc, least.get(grams, doc))
    expected = {d: sum(a != b and 100 * len(a & b) >= 80 * len(a | b) for b in least) for a, d in least.items()}
    got = jaccard_join.links(table(rows, SCHEMA)).collect()
    assert len(got) == len(expected) and {r["doc_id"]: r["n_links"] for r in got} == expected
    assert max(expected.values()) >= 11 and min(expected.values()) == 0
    assert jaccard_join.links(table([], SCHEMA)).count() == 0


def test_simhash_rows(spark, table):
    rows = [(30, "d e f g h", 1), (10, "a b c d e f g", 1), (20, None, 1), (10, "a b c d e f g", 1), (None, "é a b", 1), (50, "a b c d e f g", 2), (100, "a b c d e f", 3)]
    docs = table(rows, "doc_id bigint, text string, fp bigint")
    got = simhash.fingerprint_documents(docs).collect()
    assert len(got) == len(rows)
    order = sorted({(-1 if i is None else i, t or "") for i, t, _ in rows})
    for k, (i, t) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        edited = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        own = [r for r in got if (-1 if r["doc_id"] is None else r["doc_id"]) == i]
        assert {r["edited_sha256"] for r in own} == {hashlib.sha256(edited.encode()).hexdigest()} and {r["n_chars"] for r in own} == {len(t)}
    same = {r["fingerprint"] for r in got if r["doc_id"] in (10, 50)}
    assert len(same) == 1 and {r["fingerprint"] for r in got if r["doc_id"] == 20} == {"0" * 16}
    assert {r["n_near"] for r in got if r["doc_id"] in (10, 20)} == {None} and all(r["n_near"] >= 1 for r in got if r["doc_id"] in (50, 100))
    assert simhash.fingerprint_documents(docs.limit(0)).count() == 0


def test_near_fingerprints_find_all(spark, table):
    rnd = random.Random(2)
    base = [rnd.getrandbits(64) for _ in range(40)]
    for b in list(base):
        for flips in (1, 2, 3, 4):
            x = b
            for bit in rnd.sample(range(64), flips):
                x ^= 1 << bit
            base.append(x)
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in base]
    df = table(signed, "fp bigint")
    got = {tuple(r) for r in simhash.near_fingerprints(df, df).collect()}
    expected = {(a, b) for (a,) in signed for (b,) in signed if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3}
    assert got == expected and len(simhash.near_fingerprints(df, df).collect()) == len(got)


def test_shards(spark, table):
    rnd = random.Random(8)
    texts = ["".join(rnd.choice("abcé ") for _ in range(rnd.randint(0, 90))) for _ in range(1500)]
    rows = [(i, t, 0) for i, t in enumerate(texts)] + [(i + 5000, "hot " * 10, 0) for i in range(700)] + [(9000, None, 0), (3, texts[3], 0)]
    got = sharding.shard_documents(table(rows, "doc_id bigint, text string, shard int")).collect()
    assert len(got) == len(rows)
    size = {}
    for r in got:
        size[r["shard"]] = size.get(r["shard"], 0) + r["size"]
    assert set(size) == set(range(8)) and max(size.values()) <= 1.02 * min(size.values())
    for s in size:
        own = [r for r in got if r["shard"] == s]
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    by_id = {r["doc_id"]: r for r in got}
    for i, t, _ in rows:
        raw = (t or "").encode()
        assert by_id[i]["size"] == len(raw) + 1 and by_id[i]["text_crc32"] == zlib.crc32(raw)
    copies = {}
    for i, t, _ in rows[:1500]:
        copies.setdefault(t, set()).add(by_id[i]["shard"])
    assert all(len(v) == 1 for v in copies.values())
    assert sharding.shard_documents(table([], "doc_id bigint, text string")).count() == 0
