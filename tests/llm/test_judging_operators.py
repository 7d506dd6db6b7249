"""Quality, toxicity, licences and language: exact figures, and held-out accuracy on the given tables."""

import collections
import pickle
import random
import re
import zlib

import numpy as np
import pytest

from pagelake.llm import language_id, license_scan, quality_crf, toxicity_knn
from pagelake.llm.license_templates import TEMPLATES

DATA = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOL = re.compile(r"[#*$%&|<>]")


def figures(text):
    w = WORD.findall(text or "")
    tri = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    covered = {k + j for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(SYMBOL.findall(text or "")), dup, len(covered)


def noisy(seed):
    rnd = random.Random(seed)
    alphabet = ["a", "b c", "é", "\n", "\n\n", " ", "#|", "\t", "x y z", "😀", "\r"]
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(300)]


def test_quality_figures_equal_brute_force(table):
    rows = [(i, t, 1) for i, t in enumerate([None, "", "\n", "a\na\na", *noisy(4), "w " * 200])]
    chain = quality_crf.Chain(np.zeros(quality_crf.FEATURES), np.zeros((2, 2)))
    got = {r["doc_id"]: r for r in quality_crf.judge_documents(table(rows, "doc_id bigint, text string, kept int"), chain).collect()}
    for i, t, _ in rows:
        r, e = got[i], figures(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == e
        assert r["base_failed"] == (e[0] < 50 or 100 * e[4] > 50 * e[0]) and r["kept"] == (not r["base_failed"])


def test_viterbi_equals_enumeration():
    rnd = np.random.default_rng(1)
    for n in range(1, 8):
        scores, moves = rnd.normal(size=n), rnd.normal(size=(2, 2))
        chain = quality_crf.Chain(np.zeros(1), moves)

        def value(y, scores=scores, moves=moves):
            return sum(s for s, m in zip(scores, y, strict=True) if m) + sum(moves[a, b] for a, b in zip(y, y[1:], strict=False))

        best = max(([int(b) for b in np.binary_repr(x, n)] for x in range(1 << n)), key=value)
        assert chain.boilerplate(scores.tolist()) == best


def test_quality_keeps_good_documents(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    held = labels.filter("doc_id % 3 = 0")
    chain = quality_crf.train(docs, labels.filter("doc_id % 3 <> 0"))
    rows = quality_crf.judge_documents(docs, chain).join(held, "doc_id").filter("not base_failed").collect()
    assert sum(r["kept"] == bool(r["quality"]) for r in rows) >= 0.97 * len(rows)
    assert quality_crf.keep_good(docs, chain).columns == docs.columns


def test_quality_without_labels(spark, table):
    docs = table([(1, "one two " * 60, "x")], "doc_id bigint, text string, row string")
    chain = quality_crf.train(docs, table([], "doc_id bigint, quality int"))
    assert quality_crf.judge_documents(docs, chain).first()["kept"] is False  # repeats itself
    assert quality_crf.keep_good(docs.limit(0), chain).count() == 0


def test_block_max_search_is_exact():
    rnd = np.random.default_rng(7)
    terms, n = 40, 900
    vectors = []
    for _ in range(n):
        t = np.sort(rnd.choice(terms, rnd.integers(1, 6), replace=False))
        vectors.append((t, rnd.integers(1, 4, len(t))))
    index = toxicity_knn.Index(np.arange(terms, dtype=np.uint64), rnd.uniform(1, 5, terms), rnd.integers(0, 2, n).astype(float), np.arange(n), 0.1)
    index.build(vectors)
    dense = np.zeros((n, terms))
    for i, (t, c) in enumerate(vectors):
        dense[i, t] = index.vector(t, c)
    for i in range(60):
        t, c = vectors[i]
        near, cosine = index.nearest(t, index.vector(t, c), 10)
        all_of = np.round(dense @ dense[i], 12)
        order = np.lexsort((np.arange(n), -all_of))[:10]
        order = order[all_of[order] > 0]
        assert np.allclose(cosine, all_of[order]) and np.allclose(all_of[near], all_of[order])


def test_toxicity_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{DATA.replace('0.01', '0.1')}/{t}.parquet") for t in ("documents", "labels"))
    index = toxicity_knn.train(docs, labels)
    rows = toxicity_knn.score_documents(docs, index).join(labels, "doc_id").filter("held_out").collect()
    wrong = sum(r["predicted"] != r["toxic"] for r in rows)
    assert wrong <= 0.02 * len(rows) and all(0 <= r["score"] <= 1 for r in rows)
    assert sum(r["predicted"] for r in rows if r["toxic"]) >= 0.9 * sum(r["toxic"] for r in rows)


def test_toxicity_scores_equal_whole_vectors(table):
    """Every word of every example counts: scores and evidence against dense cosines, with one text over a megabyte."""
    rnd = random.Random(5)
    plain, rude = [f"w{i}" for i in range(300)], ["oaf", "lout", "churl"]
    texts = [" ".join(rnd.choice(plain) for _ in range(rnd.randint(1, 60))) + (" " + rnd.choice(rude).upper() if i % 4 == 0 else "") for i in range(500)]
    texts += [" ".join(rnd.choice(plain) for _ in range(250_000)) + " oaf", "nothing/known", texts[0], ""]
    docs = table(list(enumerate(texts)), "doc_id bigint, text string")
    index = toxicity_knn.train(docs, table([(i, int(i % 4 == 0)) for i in range(400)], "doc_id bigint, toxic int"))
    rows = {r["doc_id"]: r for r in toxicity_knn.score_documents(docs, index).collect()}
    find = lambda t: collections.Counter(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower()))
    known = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5]
    assert sorted(index.ids.tolist()) == known
    label = np.array([float(i % 4 == 0) for i in known])
    vocabulary = {w: k for k, w in enumerate(sorted({w for i in known for w in find(texts[i])}))}
    there = np.array([[w in find(texts[i]) for w in vocabulary] for i in known], dtype=float)
    speaks = np.nan_to_num([np.corrcoef(column, label)[0, 1] if column.any() and not column.all() else 0.0 for column in there.T])
    weight = (np.log((1 + len(known)) / (1 + there.sum(0))) + 1) * (0.01 + np.maximum(speaks, 0))

    def unit(t):
        v = np.array([(1 + np.log(c)) if (c := find(t)[w]) else 0.0 for w in vocabulary]) * weight
        return v / max(np.sqrt(v @ v), 1e-300)

    examples = np.array([unit(texts[i]) for i in known])
    for i, t in enumerate(texts):
        if i == 501 or not t:
            assert rows[i]["evidence"] == "" and rows[i]["score"] == index.empty_share
            continue
        cosine = np.round(examples @ unit(t), 12)
        near = [j for j in np.lexsort((known, -np.round(cosine, 9)))[:15] if cosine[j] > 0]
        w = 1 / (1.05 - cosine[near])
        vote = (w @ label[near] + label.mean()) / (w.sum() + 1)
        assert rows[i]["score"] == pytest.approx(index.score(vote), abs=1e-6)
        assert [f"{s:.3f}" for s in cosine[near[:3]]] == [e.split(":")[1] for e in rows[i]["evidence"].split(",")]
    assert rows[502]["score"] == rows[0]["score"]


def test_toxicity_is_not_fitted_by_the_driver(table, monkeypatch):
    rnd = random.Random(6)
    docs = table([(i, " ".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=30)) + " oaf" * (i % 3 == 0)) for i in range(300)], "doc_id bigint, text string")

    def fails(*_):
        raise AssertionError("in the driver")

    with monkeypatch.context() as m:
        for step in ("build", "calibrate", "nearest"):
            m.setattr(toxicity_knn.Index, step, fails)
        index = toxicity_knn.train(docs, table([(i, int(i % 3 == 0)) for i in range(300)], "doc_id bigint, toxic int"))
    assert len(index.ids) and index.made is None
    size = len(pickle.dumps(index))
    near, cosine = index.nearest(np.arange(3), index.vector(np.arange(3), np.array([1, 300, 2])), 5)
    assert len(near) == 5 and len(pickle.dumps(index)) == size < sum(x.nbytes for x in index.made)
    again = pickle.loads(pickle.dumps(index)).nearest(np.arange(3), index.vector(np.arange(3), np.array([1, 300, 2])), 5)
    assert near.tolist() == again[0].tolist() and cosine.tolist() == again[1].tolist()


def test_toxicity_odd_rows(table):
    docs = table([(1, None, "x"), (None, "a b", "y"), (2, "", "z"), (2, "", "z")], "doc_id bigint, text string, score string")
    index = toxicity_knn.train(docs, table([(1, 0, None)], "doc_id bigint, toxic int, quality int"))
    rows = toxicity_knn.score_documents(docs, index).collect()
    assert len(rows) == 4 and {r["predicted"] for r in rows} == {0} and {r["held_out"] for r in rows if r["doc_id"] is None} == {False}
    assert toxicity_knn.keep_clean(docs, index).columns == docs.columns
    assert toxicity_knn.score_documents(docs.limit(0), index).count() == 0


def filled(markup):
    """A template's shortest text: optional regions left out, a word or as many as must be for replaceable ones."""
    markup = re.sub(r"<<var;[^>]*match=\.\{(\d+),\d+\}>>", lambda m: "someone " * int(m[1]), markup)
    markup = re.sub(r"<<var;[^>]*match=([^|>]*)[^>]*>>", r"\1", markup)
    while "<<beginOptional>>" in markup:
        markup = re.sub(r"<<beginOptional>>((?!<<beginOptional>>).)*?<<endOptional>>", " ", markup, flags=re.S)
    return markup


def test_licences_are_read_to_their_end(table):
    parts = {"mit": "mit-grant", "isc": "isc-grant", "bsd": "bsd-conditions", "zlib": "zlib-disclaimer"}
    texts, expected = [], []
    for whole, part in parts.items():
        own = filled(TEMPLATES[whole]).split()
        start = len(filled(TEMPLATES[part]).split())
        texts.append("Copyright 2020. " + " ".join(own) + " The end")
        expected.append({whole, part})
        texts.append(" ".join(own[:start]))
        expected.append({part})
        for at in (start + 1, (start + len(own)) // 2, len(own) - 1):  # one mandatory word behind the first part is another one
            texts.append(" ".join([*own[:at], "banana", *own[at + 1 :]]))
            expected.append({part})
        texts.append(" ".join(own[:start]) + " THE AUTHOR ACCEPTS ALL LIABILITY")
        expected.append({part})
    rows = license_scan.scan_documents(table(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    for r in rows:
        assert set(r["labels"].split(",")) == expected[r["doc_id"]], texts[r["doc_id"]][:80]


def test_licence_base_equals_brute_force(table):
    texts = [None, "", "CC-BY cc by", "xcc by", "general, Public\nLICENSE all rights  reserved", "é cc by"] + noisy(9)
    rnd = random.Random(1)
    texts += [" ".join(rnd.choice(["cc", "by", "all", "rights", "reserved.", "general public license", "MIT", "under the", "Released"]) for _ in range(30)) for _ in range(200)]
    got = {r["doc_id"]: r for r in license_scan.scan_documents(table([(i, t, 0) for i, t in enumerate(texts)], "doc_id bigint, text string, labels int")).collect()}
    for i, t in enumerate(texts):
        w = license_scan.fold(t or "")
        places = [(k, label) for p, label in license_scan.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r, at = got[i], [k for k, _ in places]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(at), min(at, default=None), max(at, default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places})) and set(r["base_labels"].split(",")) <= set(r["labels"].split(","))


@pytest.mark.parametrize("name", sorted(TEMPLATES))
def test_template_takes_its_wording_only(name):
    markup = TEMPLATES[name]
    automaton = license_scan.compile_template(markup)
    filled = re.sub(r"<<var;name=\w+;match=(.*?)>>", lambda m: m[1].split("|")[0] if "{" not in m[1] else "Some One", markup)
    long = license_scan.word_keys(license_scan.fold(license_scan.MARKUP.sub(" ", filled)))
    assert automaton.run(long, 0, len(long)) == (len(long), 1.0)
    while re.search(r"<<beginOptional>>(?:(?!<<beginOptional>>).)*?<<endOptional>>", filled, re.S):
        filled = re.sub(r"<<beginOptional>>(?:(?!<<beginOptional>>).)*?<<endOptional>>", " ", filled, flags=re.S)
    short = license_scan.word_keys(license_scan.fold(filled))
    assert automaton.run(short, 0, len(short))[0] == len(short)
    assert automaton.run([*short[:-1], 1], 0, len(short))[0] == -1


def test_language_of_pages(spark):
    langs, table_of = language_id.train(spark.read.parquet(f"{DATA}/documents.parquet"))
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    rows = language_id.identify(pages, langs, table_of).collect()
    truth = {r["page_id"]: re.search(r"//[^/]*/(..)/", r["url"])[1] for r in pages.select("page_id", "url").collect()}
    assert len(rows) == len(truth) and sum(r["lang"] == truth[r["page_id"]] for r in rows) >= 0.98 * len(rows)


def test_language_odd_pages(spark, table):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    langs, table_of = language_id.train(docs)
    pages = table([(1, None, None, "x"), (1, None, None, "x"), (2, "http://h.example.fr/", "", "y"), (None, "::", "<html lang=de>" + "x" * 10, "z")], "page_id bigint, url string, html string, host string")
    rows = language_id.identify(pages, langs, table_of).collect()
    assert len(rows) == 4 and all(r["lang"] in langs for r in rows) and {r["text_lang"] for r in rows if r["page_id"] == 1} == {None}
    assert language_id.identify(pages.limit(0), langs, table_of).count() == 0
    none, empty = language_id.train(docs.limit(0))
    assert {r["lang"] for r in language_id.identify(pages, none, empty).collect()} == {None}
