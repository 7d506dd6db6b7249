"""The inverted index against plain scores, segmentation against all cuts, block joins against plain distances."""

import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagelake.functions import segment
from pagelake.operators import postings, recall, search_index
from pagelake.operators.block_join import block_join
from pagelake.sources.tables import bucket, read_dictionary

DOCS = "slide_id bigint, version_id int, tokens array<string>, n_tokens int"


def documents(rnd, n):
    rows = []
    for i in range(n):
        size = rnd.choice([3, 8, 40, 150])
        tokens = ["common"] * rnd.randint(0, 3) + [f"w{int(rnd.expovariate(0.15))}" for _ in range(size)]
        rows.append((i, rnd.randint(1, 4), tokens, len(tokens)))
    return rows


def plain_scores(rows, versions, terms):
    """BM25 of the pages in scope that hold all terms."""
    scope = [r for r in rows if r[1] in versions]
    avg = sum(r[3] for r in scope) / len(scope)
    df = {t: sum(t in r[2] for r in scope) for t in terms}
    out = {}
    for page, _, tokens, n in scope:
        if all(t in tokens for t in terms):
            parts = (math.log(1 + (len(scope) - df[t] + 0.5) / (df[t] + 0.5)) * (tf := tokens.count(t)) * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / avg)) for t in terms)
            out[page] = round(sum(parts), 6)
    return out


def test_index_search_equals_plain_scores_and_skips_blocks(spark, table, tmp_path, monkeypatch):
    monkeypatch.setattr(search_index, "DOCS", 8)
    rows = documents(random.Random(1), 1200)
    index = search_index.build_index(table(rows, DOCS), str(tmp_path / "index"), ["slide_id"])
    asked = {1: "common", 2: "common w1", 3: "w0 w1 w2", 4: "w30", 5: "absent common", 6: "  ", 7: "W3 w3 common"}
    queries = table(list(asked.items()), "query_id bigint, query string")
    for versions in ({1, 2, 3, 4}, {2, 3}):
        scope = table([(v,) for v in versions], "version_id int")
        found = {}
        for r in search_index.index_recall(queries, index, scope, 5).collect():
            found.setdefault(r.query_id, []).append((r.slide_id, r.score))
        for q, text in asked.items():
            terms = set(text.lower().split())
            best = sorted(plain_scores(rows, versions, terms).items(), key=lambda x: (-x[1], x[0]))[:5] if terms else []
            assert [p for p, _ in found.get(q, [])] == [p for p, _ in best]
            assert np.allclose([s for _, s in found.get(q, [])], [s for _, s in best], atol=2e-6)
    seen = search_index.search(queries, index, scope, 5).blocks.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.count("round").alias("scored")).collect()
    assert any(r.scored < r.n / 2 for r in seen if r.query_id == 1)


def test_search_reads_the_words_of_its_batch(spark, table, tmp_path):
    index = search_index.build_index(table(documents(random.Random(2), 50), DOCS), str(tmp_path / "index"), ["slide_id"])
    queries, scope = table([(1, "w1 common")], "query_id bigint, query string"), table([(1,), (2,)], "version_id int")
    plan = search_index.index_recall(queries, index, scope, 5)._jdf.queryExecution().toString()
    assert "explode(tokens" not in plan and "In(token, [" in plan and "PartitionFilters: [bucket" in plan


def test_empty_index_and_scope(table, tmp_path):
    docs = table([(1, 1, ["a"], 1)], DOCS)
    index = search_index.build_index(docs, str(tmp_path / "index"), ["slide_id"])
    queries = table([(1, "a"), (2, None)], "query_id bigint, query string")
    assert search_index.index_recall(queries, index, table([], "version_id int"), 5).collect() == []
    assert search_index.index_recall(queries.limit(0), index, table([(1,)], "version_id int"), 5).collect() == []
    assert [tuple(r)[:2] for r in search_index.index_recall(queries, index, table([(1,)], "version_id int"), 5).collect()] == [(1, 1)]


def test_words_are_counted_in_the_row_and_repeated_documents_meet(spark, table, tmp_path, monkeypatch):
    monkeypatch.setattr(search_index, "TASK_TOKENS", 2)
    rows = [(1, 1, ["b", "a", "b"], 3), (1, 1, ["b", "a", "b"], 3), (2, 1, [], 0), (3, 2, ["c"] * 40, 40), (4, 2, None, -1)]
    docs = table(rows, DOCS)
    words = {r.slide_id: r.w for r in docs.select("slide_id", search_index._counted(F.col("tokens")).alias("w")).collect()}
    assert [(w.token, w.tf) for w in words[1]] == [("a", 1), ("b", 2)] and [w.tf for w in words[3]] == [40] and not words[2] and not words[4]
    index = search_index.build_index(docs, str(tmp_path / "index"), ["slide_id"])
    held = sorted((r.token, r.slide_id, r.version_id, r.n_tokens, r.tf) for r in index.postings.collect())
    assert held == [("a", 1, 1, 3, 2), ("b", 1, 1, 3, 4), ("c", 3, 2, 40, 40)]
    assert sorted(map(tuple, index.totals.collect())) == [(1, 3, 6), (2, 2, 39)]
    plan = search_index._blocks(docs, ("slide_id",), 0)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_postings_stay_where_they_lie(spark, table, tmp_path, monkeypatch):
    """One row per token and block with its maxima, written without a second pass; a search moves none of them to meet words, scope or live runs."""
    monkeypatch.setattr(search_index, "DOCS", 4)
    monkeypatch.setattr(search_index, "TASK_TOKENS", 16)
    path, rows = str(tmp_path / "index"), documents(random.Random(3), 80)
    index = search_index.build_index(table(rows, DOCS), path, ["slide_id"])
    assert not (tmp_path / "index" / "maxima").exists()
    held = {}
    for r in index.postings.collect():
        held.setdefault((r.bucket, r.token, r.block), []).append((r.tf, r.n_tokens))
    maxima = sorted(tuple(r) for r in index.maxima.collect())
    assert maxima == sorted((*k, max(tf for tf, _ in v), min(n for _, n in v)) for k, v in held.items())
    assert sum(map(len, held.values())) == sum(len(set(r[2])) for r in rows)
    queries, scope = table([(1, "w1 common"), (2, "w2")], "query_id bigint, query string"), table([(1,), (2,)], "version_id int")
    plan = search_index.search(queries, index, scope, 3).scored._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [version_id" in plan and "SortMergeJoin [version_id" not in plan


def test_words_are_hashed_as_spark_hashes_them(table):
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abcé漢0") for _ in range(n)) for n in [*range(70), 200, 8, 32, 33]]
    spark_buckets = table([(i, w) for i, w in enumerate(words)], "i int, w string").select("i", bucket(F.col("w"), 16).alias("b")).orderBy("i").collect()
    assert postings.buckets(pa.array(["x", *words]).slice(1), 16).tolist() == [r.b for r in spark_buckets]
    assert len(postings.hashes(pa.array([], pa.string()))) == 0


def test_a_build_deals_packed_words_and_packs_lists_in_arrow(spark, table, tmp_path, monkeypatch):
    """No row for a posting in the JVM: batches send one payload to each share, small chunks and parts give what large ones give."""
    rows = [(i, i % 3 or None, f"run {i % 2}", t, n) for i, _, t, n in documents(random.Random(5), 60)] + [(99, 1, "run 1", ["w1"], 1), (99, 1, "run 1", ["w1"], 1)]
    docs = table(rows, "slide_id bigint, version_id int, run_id string, tokens array<string>, n_tokens int")
    plans = []
    monkeypatch.setattr(search_index, "_append", lambda df, path, parts, real=search_index._append: (plans.append(df._jdf.queryExecution().toString()), real(df, path, parts)))
    found = []
    for chunk, task in ((postings.CHUNK, search_index.TASK_TOKENS), (64, 128)):
        monkeypatch.setattr(postings, "CHUNK", chunk)
        monkeypatch.setattr(search_index, "TASK_TOKENS", task)
        path = str(tmp_path / f"index-{chunk}")
        search_index.append_segment(docs, path, ["slide_id"])
        held = search_index._unpacked(spark.read.parquet(f"{path}/postings").drop("held"))
        found.append(sorted(((r.bucket, r.token, r.slide_id, r.version_id or 0, r.run_id, r.n_tokens, r.tf) for r in held.collect())))
        counts = spark.read.parquet(f"{path}/counts").groupBy("bucket", "token", "version_id", "run_id").agg(F.sum("df").alias("df")).collect()
        by_hand = {}
        for b, token, _, version, run, *_ in found[-1]:
            by_hand[b, token, version, run] = by_hand.get((b, token, version, run), 0) + 1
        assert {(r.bucket, r.token, r.version_id or 0, r.run_id): r.df for r in counts} == by_hand
    assert found[0] == found[1] and len({b for b, *_ in found[0]}) > 4
    assert sorted((t, s, tf) for _, t, s, _, _, _, tf in found[0]) == sorted(
        (t, i, 2 if i == 99 else tokens.count(t)) for i, tokens in {r[0]: r[3] for r in rows}.items() for t in set(tokens)
    )
    assert "MapInArrow" in plans[0] and "Generate" not in plans[0] and "HashAggregate [_part" not in plans[0]


def test_runs_are_read_only_where_some_are_dead(spark, table, tmp_path):
    schema = "slide_id bigint, version_id int, run_id string, tokens array<string>, n_tokens int"
    path, scope = str(tmp_path / "index"), table([(1,), (2,)], "version_id int")
    queries = table([(1, "w1"), (2, "w1 w2")], "query_id bigint, query string")
    search_index.append_segment(table([(1, 1, "a", ["w1", "w2"], 2), (2, 2, "a", ["w1"], 1)], schema), path, ["slide_id"])
    pages = lambda index: sorted((r.query_id, r.slide_id) for r in search_index.index_recall(queries, index, scope, 9).collect())
    index = search_index.read_index(spark, path, ["slide_id"])
    plan = search_index.search(queries, index, scope, 9).scored._jdf.queryExecution().toString()
    assert "run_id" not in plan and index.counts.columns == ["token", "version_id", "df", "bucket"]
    assert pages(index) == [(1, 1), (1, 2), (2, 1)]
    # postings of a segment that is not listed yet do not count
    unsaid = F.transform("docs", lambda d: d.withField("run_id", F.lit("b")).withField("slide_id", d["slide_id"] + 50))
    search_index._append(spark.read.parquet(f"{path}/postings").withColumns({"docs": unsaid, "block": F.col("block") + (7 << 31), "segment": F.lit(7).cast("bigint")}), f"{path}/postings", ["segment", "bucket"])
    unlisted = search_index.read_index(spark, path, ["slide_id"])
    assert "run_id" in unlisted.lists.schema["docs"].dataType.elementType.names and pages(unlisted) == [(1, 1), (1, 2), (2, 1)]
    search_index.append_segment(table([(3, 1, "c", ["w1"], 1)], schema), path, ["slide_id"], 8)
    assert pages(search_index.read_index(spark, path, ["slide_id"])) == [(1, 2), (1, 3)]


# --- segmentation ---------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(30))
def test_best_path_of_all_cuts(seed):
    rnd = random.Random(seed)
    letters = "天地人你我"
    words = {"".join(rnd.choice(letters) for _ in range(rnd.randint(1, 4))): rnd.randint(1, 50) for _ in range(rnd.randint(0, 12))}
    own = segment.Segmenter(words)
    for _ in range(20):
        run = "".join(rnd.choice(letters) for _ in range(rnd.randint(1, 9)))
        best = None
        for borders in itertools.product([False, True], repeat=len(run) - 1):
            places = [0, *(i + 1 for i, b in enumerate(borders) if b), len(run)]
            parts = [run[a:b] for a, b in zip(places, places[1:])]
            if all(len(p) == 1 or p in words for p in parts):
                likely = sum(math.log(words.get(p, 1)) - math.log(sum(words.values()) or 1) for p in parts)
                key = round(likely, 6), [len(p) for p in parts]
                best = max(best, (key, parts)) if best else (key, parts)
        assert own.cut(run) == best[1]


def test_dictionary_words_and_other_letters(spark, table, tmp_path):
    (tmp_path / "words.txt").write_text("# domain\n研究生 5 n\n研究 50\n生命 60 n\n起源\n\n")
    known = segment.frequencies(read_dictionary(spark, str(tmp_path / "words.txt")))
    assert known == {"研究生": 5, "研究": 50, "生命": 60, "起源": 1}
    rows = table([(1, "研究生命起源 ABC12研究生 x"), (2, None), (3, "Plain words 7"), (4, "")], "id int, t string")
    got = {r.id: r.w for r in rows.select("id", segment.best_path_tokens(F.col("t"), known).alias("w")).collect()}
    assert got == {1: ["研究", "生命", "起源", "abc12", "研究生", "x"], 2: [], 3: ["plain", "words", "7"], 4: []}


# --- block join -----------------------------------------------------------------------------


def test_thousands_of_query_vectors(spark, table, monkeypatch):
    monkeypatch.setattr(recall, "ITEM_TILE", 64)
    rnd = np.random.default_rng(0)
    items, asked = np.round(rnd.normal(size=(600, 4)), 2), np.round(rnd.normal(size=(5000, 4)), 2)
    items[7] = 0.0
    vectors = table([(i // 2, v.tolist()) for i, v in enumerate(items)], "slide_id bigint, embedding array<float>")
    queries = table([(i, v.tolist()) for i, v in enumerate(asked)], "query_id bigint, embedding array<float>")
    near = recall.nearest_pages(queries, vectors, 3)
    assert len(near._jdf.queryExecution().optimizedPlan().toString()) < 20_000
    got = {}
    for r in near.collect():
        got.setdefault(r.query_id, []).append(r.slide_id)
    unit = lambda m: (m32 := m.astype(np.float32).astype(np.float64)) / np.linalg.norm(m32, axis=1, keepdims=True)
    with np.errstate(invalid="ignore"):
        d = np.round(1 - unit(asked) @ unit(items).T, 6)
    d = np.where(np.isnan(d), np.inf, d).reshape(5000, 300, 2).min(axis=2)
    for i in range(0, 5000, 37):
        assert got[i] == np.lexsort((np.arange(300), d[i]))[:3].tolist()


def test_every_query_meets_every_block(spark, table):
    items, queries = table([(i, 1) for i in range(100)], "id int, x int"), table([(i, 0) for i in range(700)], "id int, x int")
    import pyarrow as pa

    count = lambda held, strip: pa.table({"id": strip.column("id"), "n": pa.array([held] * strip.num_rows, pa.int64())})
    got = block_join(items, queries, F.col("id"), 9, lambda t: t.num_rows, count, "id int, n bigint").groupBy("id").sum("n").collect()
    assert len(got) == 700 and {r[1] for r in got} == {100}
