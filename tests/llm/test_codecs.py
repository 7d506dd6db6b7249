"""Tokenizing operators against the libraries, and packing against its own laws."""

import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from pagelake.llm import best_fit_packing as packing
from pagelake.llm import sentencepiece_bpe as spm

MODEL = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", None, " ", "  ", " a", "a ", "\n a", "▁", "a▁ b", "a ▁", "<s></s><0x0A>", "a" * 40, "ing" * 50, "a  b　c", "x <|endoftext|>  y", "l'été  d'un \t\n fin  ."]


def texts():
    rnd = random.Random(3)
    alphabet = "ab aA ▁\n\t é中😀<s>0x \x00 the 'll 12 .,!"
    return ODD + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 80))) for _ in range(1500)]


def test_sentencepiece_equals_the_library():
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    own = texts()
    for text, (ids, n, decoded) in zip(own, spm.encoded_rows(pa.array(own, pa.string()), MODEL), strict=True):
        expected = library.encode(text or "", add_eos=True)
        assert [int(x) for t in ids for x in t.split()] == expected
        assert n == len(expected)
        assert decoded.decode() == library.decode(expected)


def test_sentencepiece_rows(table):
    docs = table([(1, "the cat", "x"), (None, None, "y"), (1, "the cat", "x")], "doc_id bigint, text string, ids string")
    rows = spm.encode_documents(docs, MODEL).collect()
    assert len(rows) == 3 and {r["n_tokens"] for r in rows if r["doc_id"] is None} == {1}
    lists = spm.id_lists(docs, MODEL).collect()
    assert {tuple(r["ids"]) for r in lists if r["doc_id"] is None} == {(2,)}
    assert spm.encode_documents(docs.limit(0), MODEL).count() == 0


def test_byte_tokens_equal_the_library():
    library = Tokenizer.from_file(BYTES)
    own = texts()
    for text, raw in zip(own, packing.token_bytes(pa.array(own, pa.string()), BYTES), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == library.encode(text or "", add_special_tokens=False).ids


class Counting:
    """A tokenizer that counts the texts it is given."""

    def __init__(self):
        self.inner, self.given = Tokenizer.from_file(BYTES), 0

    def encode_batch_fast(self, texts, **options):
        self.given += len(texts)
        return self.inner.encode_batch_fast(texts, **options)


@pytest.mark.parametrize("known", [True, False])
def test_new_chunks_are_encoded_together_as_they_are_alone(known):
    rnd, library = random.Random(5), Counting()
    sizes = packing._sizes(library.inner) if known else np.ones(50257, np.int64)
    own = [(rnd.choice([" ", "\n", "\t \n"]) + "".join(rnd.choice("abé中'0.<|") for _ in range(rnd.randint(1, 12)))).encode() for _ in range(5000)]
    odd = [b"", b"the", b"  ", b" a\xc2\xa0", b" a \n", b" <|endoftext|>", b" b"]
    ids, counts = packing._encoded(library, sizes, own + odd)
    alone = [library.inner.encode(t.decode(), add_special_tokens=False).ids for t in own + odd]
    assert counts.tolist() == [len(x) for x in alone] and ids.tolist() == sum(alone, [])
    if known:
        assert library.given < 20


def test_tokens_do_not_depend_on_what_a_worker_remembers():
    own = texts()
    made, cache = [], packing._cache(BYTES)
    for limit in (0, 50, packing.CACHED):
        cache.clear()
        cache.limit = limit
        made.append([raw for _ in range(3) for a in range(0, len(own), 100) for raw in packing.token_bytes(pa.array(own[a : a + 100], pa.string()), BYTES)])
    assert made[0] == made[1] == made[2]


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_complete_and_near_the_bound(seed):
    rnd = random.Random(seed)
    counts = {}
    for _ in range(rnd.choice([1, 40, 900])):
        s = rnd.choice([rnd.randint(1, 1024), rnd.randint(1, 200), 512, 1024])
        counts[s] = counts.get(s, 0) + 1
    plan = packing.completion_plan(counts)
    used = {}
    for filling, times in plan:
        assert times > 0 and sum(filling) <= 1024
        for s in filling:
            used[s] = used.get(s, 0) + times
    assert used == counts
    sequences, bound = sum(n for _, n in plan), packing.lower_bound(counts, 1024)
    assert bound <= sequences <= bound + max(2, bound // 50)


def test_plan_finds_the_exact_packing():
    assert sum(n for _, n in packing.completion_plan({6: 2, 4: 2, 3: 1, 7: 1}, 10)) == 3
    assert packing.completion_plan({}, 10) == []


def test_plan_goes_back_over_fillings():
    """Triples that fill every sequence; greedy choices alone waste room."""
    perfect = [
        (100, 8, {27: 2, 38: 2, 35: 3, 37: 3, 24: 1, 39: 3, 31: 1, 30: 1, 40: 2, 25: 1, 22: 1, 20: 1, 41: 1, 28: 1, 36: 1}),
        (100, 12, {32: 2, 44: 2, 24: 4, 33: 3, 21: 1, 46: 1, 28: 2, 36: 4, 35: 3, 45: 1, 29: 2, 26: 2, 31: 1, 34: 1, 38: 1, 40: 1, 47: 1, 23: 1, 37: 2, 39: 1}),
    ]
    for capacity, sequences, counts in perfect:
        assert packing.lower_bound(counts, capacity) == sequences
        assert sum(n for _, n in packing.completion_plan(counts, capacity)) == sequences


def test_dominated_fillings():
    assert packing._dominated([3, 4], {3: 1, 4: 1, 7: 1}, 7, 0)  # one item as long as two
    assert packing._dominated([5], {5: 1, 6: 1}, 7, 2)  # a longer one fits in the place
    assert packing._dominated([5], {5: 1, 2: 1}, 7, 2)  # not full
    assert not packing._dominated([3, 4], {3: 2, 4: 2, 5: 1}, 7, 0)


def test_packed_documents(table):
    library = Tokenizer.from_file(BYTES)
    rnd = random.Random(5)
    rows = [(i, " ".join(rnd.choice(["alpha", "be", "gamma,", "x9"]) for _ in range(rnd.choice([0, 3, 40, 700, 2500]))), i) for i in range(60)]
    rows += [(60, None, 0), (7, rows[7][1], 7), (None, "free", 1)]
    got = packing.pack_documents(table(rows, "doc_id bigint, text string, length bigint"), BYTES).collect()
    by_doc = {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
    for doc, text, _ in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        own = sorted(by_doc[doc], key=lambda r: (r["start"], r["sequence_id"]))
        times = len(rows) and sum(d == doc for d, _, _ in rows)
        assert sum(r["length"] for r in own) == times * len(ids)
        for r in own:
            part = np.array(ids[r["start"] : r["start"] + r["length"]], dtype="<u4")
            assert zlib.crc32(part.tobytes()) == r["ids_crc32"]
            assert r["piece"] == 0 or r["length"] == 1024
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack_documents(table([], "doc_id bigint, text string"), BYTES).count() == 0
