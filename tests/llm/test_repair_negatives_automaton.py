"""Hard negatives, BPE automaton and conversation repair against brute force and the library."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pagelake.llm import bpe_automaton as bpe
from pagelake.llm import conversation_repair as repair
from pagelake.llm import hard_negatives as negatives
from pagelake.llm.oracle import oracle

BYTES = public_tokenizers.path("byte_bpe_50k.json")
EMBEDDINGS = "vec_id bigint, embedding array<float>, label int, anchor_id int"
TURNS = "conv_id bigint, turn bigint, role string, text string, conversation string"


# --- BPE ------------------------------------------------------------------------------------


def merged(word, ranks):
    """Merging as it is defined: the most urgent pair first, the leftmost among equals."""
    parts = [bytes([b]) for b in word]
    while True:
        best = min(((ranks[a, b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (a, b) in ranks), default=None)
        if best is None:
            return parts
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@pytest.mark.parametrize("seed", range(40))
def test_automaton_of_random_merges(seed):
    rnd = random.Random(seed)
    letters = [bytes([b]) for b in b"abc"[: rnd.randint(1, 3)]]
    known, merges, made = list(letters), [], set(letters)
    for _ in range(rnd.randint(1, 25)):
        a, b = rnd.choice(known), rnd.choice(known)
        if a + b not in made and len(a + b) < 12:
            made.add(a + b)
            known.append(a + b)
            merges.append((a, b))
    ids = {bytes([b]): b for b in range(256)} | {a + b: 256 + i for i, (a, b) in enumerate(merges)}
    own = bpe.Automaton(merges, ids)
    ranks = {pair: i for i, pair in enumerate(merges)}
    for _ in range(120):
        word = b"".join(rnd.choice(letters) for _ in range(rnd.randint(0, 18)))
        path = own.path(word)
        assert [own.labels[t] for t in path] == merged(word, ranks)
        assert own.emit(path) == word


def test_encoding_equals_the_library():
    library, own = Tokenizer.from_file(BYTES), bpe.tokenizer(BYTES)
    rnd = random.Random(5)
    odd = ["", "<|endoftext|>", " <|endoftext|>x<|endoftext|><|endoftext|>\n", " " * 999, "don't WE'LL 's", "日本語 한국어", "՘a₏1", "\x00\x1c\x85b\xa0c  ", "a" * 777]
    alphabet = [chr(c) for c in [*range(9, 14), *range(32, 127), *range(160, 1500), 0x3000, 0x1F600, 0x10940, 0x1C89, 0x13460]]
    odd += ["".join(rnd.choice(alphabet[: rnd.choice([100, 400, 1500])]) for _ in range(rnd.randint(0, 70))) for _ in range(1500)]
    odd += ["".join(rnd.choice("abehint ") for _ in range(60)) for _ in range(300)]
    for text in odd:
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False) == text
    some = [rnd.randrange(50257) for _ in range(500)]
    assert own.decode(some) == library.decode(some, skip_special_tokens=False)


def test_letters_of_every_unicode_block():
    library, own = Tokenizer.from_file(BYTES), bpe.tokenizer(BYTES)
    every = [chr(c) for c in range(0, 0x33500, 7) if not 0xD800 <= c < 0xE000]
    text = "".join(f"a{c}b 1{c}2 !{c}? {c} " for c in every)
    assert own.words(text) == [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)]


def test_a_text_of_over_a_megabyte_without_blanks():
    rnd = random.Random(2)
    text = "".join(rnd.choice("abcdefgh") for _ in range(1_200_000))
    own = bpe.tokenizer(BYTES)
    ids = own.encode(text)
    assert own.decode(ids) == text
    assert ids[:20_000] == Tokenizer.from_file(BYTES).encode(text, add_special_tokens=False).ids[:20_000]


def test_encoded_rows(table):
    docs = table([(1, "the cat<|endoftext|>", "x"), (None, None, "y"), (1, "the cat<|endoftext|>", "x"), (2, "", "z")], "doc_id bigint, text string, ids string")
    rows = bpe.encode_documents(docs, BYTES).collect()
    ids = Tokenizer.from_file(BYTES).encode("the cat<|endoftext|>", add_special_tokens=False).ids
    expected = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(b"the cat<|endoftext|>").hexdigest())
    empty = (0, hashlib.sha256(b"").hexdigest(), hashlib.sha256(b"").hexdigest())
    assert sorted([tuple(r)[1:] for r in rows]) == sorted([expected, expected, empty, empty])
    lists = bpe.id_lists(docs, BYTES)
    assert {r["doc_id"]: r["text"] for r in bpe.decode_lists(lists, BYTES).collect()} == {1: "the cat<|endoftext|>", None: "", 2: ""}
    assert bpe.encode_documents(docs.limit(0), BYTES).count() == 0


# --- conversations --------------------------------------------------------------------------


def cheapest(pattern, start, ends):
    """All edits, one row at a time, keeping the best of each state."""
    best = {start: (0, "")}
    for at in range(0, len(pattern) + 1, 2):
        for _ in range(4):
            for s, (c, a) in list(best.items()):
                best[repair.NEXT[s]] = min(best.get(repair.NEXT[s], (1 << 30, "")), (c + 2, a + "I"))
        if at == len(pattern):
            break
        initial, fault = pattern[at], pattern[at + 1]
        after = {}
        for s, (c, a) in best.items():
            ways = [(s, c + 3, a + "D")]
            if fault != "d":
                ways.append((repair.NEXT[s], c + 2 + (fault == "t"), a + "R"))
                if initial in repair.KEEP[s]:
                    ways.append((repair.KEEP[s][initial], c + (fault == "t"), a + "K"))
            for to, cost, audit in ways:
                after[to] = min(after.get(to, (1 << 30, "")), (cost, audit))
        best = after
    return min((best[e] for e in ends if e in best), default=None)


def test_search_equals_brute_force():
    rnd = random.Random(0)
    for _ in range(1500):
        pattern = "".join(rnd.choice("suax") + rnd.choice("dt---") for _ in range(rnd.randint(0, 9)))
        assert repair.search(pattern, 0, (0, 3)) == cheapest(pattern, 0, (0, 3))
        start, end = rnd.randrange(4), rnd.randrange(4)
        assert repair.search(pattern, start, (end,)) == cheapest(pattern, start, (end,))


def plain_repair(rows):
    """One conversation's result from its rows (turn, role, text) in order."""
    seen, pattern, counts, turns = set(), "", dict.fromkeys("bdt", 0), [t for t, _, _ in rows if t is not None]
    for _, role, text in rows:
        body = text.strip(repair.BLANKS)
        fault = "b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else "-"
        seen.add((role, text))
        if fault != "-":
            counts[fault] += 1
        pattern += (role[:1] if role[:1] in tuple("sua") else "x") + {"b": "d"}.get(fault, fault)
    cost, audit = cheapest(pattern, 0, (0, 3))
    lines, _ = repair.repaired([r[1:] for r in rows], audit, 0)
    text = "\n".join(lines)
    illegal = sum(a[1][:1] + b[1][:1] not in repair.LEGAL for a, b in zip(rows, rows[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *counts.values(), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest(), text)


def random_rows(rnd, n):
    texts = ["Yes.", "No", " ", "", "Why?", "ok \n", "Go! \t", "x" * 50 + "."]
    return [(c, rnd.choice([None, *range(12)]), rnd.choice(["user", "assistant", "system", "tool", ""]), rnd.choice(texts)) for c in [rnd.choice([1, 1, 1, 2, 3, None]) for _ in range(n)]]


@pytest.mark.parametrize("segment", [3, 128])
def test_repair_equals_brute_force(table, monkeypatch, segment):
    monkeypatch.setattr(repair, "SEGMENT", segment)
    rows = random_rows(random.Random(segment), 150)
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.repair(table([(*r, "x") for r in rows], TURNS)).collect()}
    own = {}
    for c, *row in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3])):
        own.setdefault(c, []).append(tuple(row))
    assert got == {c: plain_repair(r) for c, r in own.items()}


def test_damage_and_whole_result(table):
    rnd = random.Random(9)
    rows = [(c, t, rnd.choice(["user", "assistant", "system", None]), rnd.choice(["A b.", "C", None, "D!", "e? f"])) for c in range(40) for t in range(rnd.randint(1, 7))]
    rows += [(None, 0, "user", "Hi."), (None, None, None, None)]
    own = {}
    for c, t, role, text in rows:
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        kept = own.setdefault(c, [])
        if h == 1:
            text = ""
        elif h == 2:
            text = text.translate({ord(x): None for x in ".!?"})
        elif h == 4:
            role = "user"
        kept += [(t, role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.repair(repair.damage(table([(*r, "x") for r in rows], TURNS))).collect()}
    assert got == {c: plain_repair(sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))) for c, r in own.items()}
    empty = repair.repair(repair.damage(table([], TURNS)), texts=False)
    assert empty.count() == 0 and empty.columns[-1] == "repaired_sha256"


def test_one_conversation_over_many_ranges(table):
    rnd = random.Random(4)
    rows = [(7, t, "ua"[t % 2] + "x" if rnd.random() < 0.9 else "user", f"Text {t if rnd.random() < 0.9 else 5}.") for t in range(900)]
    got = repair.repair(table([(*r, "x") for r in rows], TURNS)).collect()
    assert len(got) == 1 and tuple(got[0])[1:] == plain_repair([r[1:] for r in rows])


def test_long_texts(table):
    rows = [(1, 0, "user", "word " * 300_000 + "end."), (1, 1, "assistant", "x" * 1_500_000)]
    got = repair.repair(table([(*r, "x") for r in rows], TURNS)).collect()
    assert [tuple(r)[1:] for r in got] == [plain_repair([r[1:] for r in rows])]


# --- hard negatives -------------------------------------------------------------------------


def mined(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[], label INT, anchor_id INT)")
    con.executemany("INSERT INTO embeddings VALUES (?, ?, ?, ?)", rows)
    return sorted(con.execute(oracle()["op11_hard_negatives"]).fetchall())


def vectors(rnd, n, dims, spread):
    centres = [[rnd.gauss(0, 1) for _ in range(dims)] for _ in range(4)]
    out = []
    for i in range(n):
        c = rnd.choice(centres)
        out.append((i, [float(np.float32(x + rnd.gauss(0, spread))) for x in c], rnd.randrange(10), 0))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_mining_equals_brute_force(table, monkeypatch, seed):
    monkeypatch.setattr(negatives, "LEAST", 100)
    monkeypatch.setattr(negatives, "STRIP", 2)
    rnd = random.Random(seed)
    rows = vectors(rnd, 500, [2, 8, 33, 5][seed], [0.3, 1.0, 2.0, 0.0][seed])
    rows += [(600 + i, rows[0][1], 3, 0) for i in range(150)]  # one common vector
    rows += [(800, None, 1, 0), (900, [1.0, None], 1, 0), (901, [float("nan")] * 2, 1, 0), (902, [float("inf"), 1.0], 2, 0), (903, [1.0, 2.0], None, 0)]
    rows += [rows[3], rows[100]]
    got = sorted(tuple(r) for r in negatives.mine_embeddings(table(rows, EMBEDDINGS)).collect())
    assert len(got) > 50
    assert got == mined([r for r in rows if len(r[1] or []) == len(rows[0][1]) or r[1] is None])


def test_few_rows_and_odd_vectors(table):
    none = negatives.mine_embeddings(table([], EMBEDDINGS))
    assert none.collect() == [] and none.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    short = [(100, [1.0, 1.0], 1, 0), (1, [1.0], 1, 0), (2, [0.5], 2, 0), (3, [-1.0, 0.0], 2, 0), (4, [], 2, 0)]
    assert [tuple(r) for r in negatives.mine_embeddings(table(short, EMBEDDINGS)).collect()] == [(100, 1, 1, 2, 256 * 256, 256 * 128)]
    large = [(100, [3e5, 1.0], 1, 0), (1, [3e5, 2.0], 1, 0), (2, [2e5, 1.0], 2, 0)]
    x, y, z = (256 * 300_000, 256 * 300_000, 256 * 200_000)
    assert [tuple(r) for r in negatives.mine_embeddings(table(large, EMBEDDINGS)).collect()] == [(100, 1, 1, 2, x * y + 256 * 512, x * z + 256 * 256)]


def test_candidates_lose_no_pair_at_any_threshold():
    rnd = np.random.default_rng(1)
    m = np.floor(rnd.normal(0, 60, (700, 24)) * np.linspace(3, 0.2, 24))
    block = negatives.Block(np.arange(700), np.zeros(700, np.int64), m)
    anchors = block.turned(m[:30])
    scores = m[:30] @ m.T
    for share in (0.9, 0.5, 0.2, 0.0, -1.0):
        threshold = scores.max(axis=1) * share
        a, r, s = block.candidates(anchors, negatives._suffix_norms(anchors), threshold)
        assert set(zip(a.tolist(), r.tolist(), s.tolist())) == {(i, j, int(scores[i, j])) for i, j in zip(*np.nonzero(scores >= threshold[:, None]))}
