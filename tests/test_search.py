import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from pagelake import constants as c
from pagelake.operators import block_join, enrich, fusion, quality, recall
from pagelake.operators.enrich import hashed_bag, merge_ai_tags, merge_embeddings, merge_ocr_text, normalize_analyses, build_embeddings
from pagelake.operators.indexing import clustered_postings, index_totals, token_index
from pagelake.operators.ranks import top_k
from pagelake.operators.scope import scoped_slides

PAGES = [
    (1, 2, 1, "Alpha", "alpha beta beta"),
    (2, 2, 2, "Beta notes", "beta gamma"),
    (3, 4, 1, "Other", "alpha beta gamma delta"),
    (4, 6, 1, "Secret", "alpha beta"),
    (5, 8, 1, "Gone", "alpha beta"),
    (6, 1, 1, "Old alpha", "alpha beta"),
]


def corpus(table):
    pages = table(PAGES, "slide_id bigint, version_id int, page_no bigint, title string, body string").withColumn(
        "created_at", F.timestamp_seconds(F.col("slide_id"))
    )
    index = token_index(pages, "body")
    elements = index.select("slide_id", "version_id", F.lit(0).alias("element_index"), "tokens", "n_tokens")
    vectors = table([(i, "m", "success" if i != 3 else "failed", [float(i), 1.0]) for i in range(1, 7)],
                    "slide_id bigint, model string, status string, embedding array<float>")
    pres = table(
        [(1, "alpha deck", 0, "team", None, 2), (2, "two", 0, "team", None, 4), (3, "three", 1, "private", None, 6), (4, "four", 0, "team", "2024-01-01", 8)],
        "presentation_id int, title string, owner_id bigint, visibility string, deleted_at string, current_version_id int",
    )
    versions = table([(1, 1), (2, 1), (4, 2), (6, 3), (8, 4)], "version_id int, presentation_id int")
    tags = table([(1, "t1", "manual"), (1, "t2", "ai"), (2, "t2", "ai"), (3, "t9", "manual")], "slide_id bigint, tag_id string, origin string")
    favs = table([(0, 2)], "user_id bigint, slide_id bigint")
    return fusion.Corpus(index, elements, vectors, vectors.select("slide_id", "embedding"), pres, versions, tags, favs)


def asked(table, *texts):
    rows = [(i, t, [1.0, 1.0]) for i, t in enumerate(texts)]
    return table(rows, "query_id bigint, query string, embedding array<float>")


def test_text_recall_needs_all_tokens_and_scope(table):
    got = recall.text_recall(asked(table, "alpha beta", "gamma beta", "zeta beta"), (k := corpus(table)).index, k.scope(0)).collect()
    assert {(r.query_id, r.slide_id) for r in got} == {(0, 1), (0, 3), (1, 2), (1, 3)}
    assert {r["rank"] for r in got if r.query_id == 0} == {1, 2}


def test_batches_score_as_single_queries(table):
    k, q = corpus(table), asked(table, "alpha", "beta", "gamma delta", "alpha beta")
    whole = {tuple(r) for r in recall.text_recall(q, k.index, k.scope(0)).collect()}
    alone = {tuple(r) for i in range(4) for r in recall.text_recall(q.filter(F.col("query_id") == i), k.index, k.scope(0)).collect()}
    assert whole == alone


def test_postings_score_as_tokens(table):
    k, q = corpus(table), asked(table, "alpha", "beta beta gamma", "alpha beta")
    postings, totals = clustered_postings(k.index, ["slide_id", "version_id"]), index_totals(k.index.join(k.scope(0).select("version_id"), "version_id", "left_semi"))
    got = {tuple(r) for r in recall.text_recall(q, postings, k.scope(0), totals).collect()}
    assert got == {tuple(r) for r in recall.text_recall(q, k.index, k.scope(0)).collect()} and got


def test_nearest_pages_equal_brute_force_in_small_tiles(table, monkeypatch):
    monkeypatch.setattr(block_join, "STRIP", 4)
    monkeypatch.setattr(recall, "ITEM_TILE", 30)
    rows = [(i % 23, [float((i * 7) % 11) - 5, float((i * 3) % 5) - 2, 1.0]) for i in range(200)] + [(99, [0.0, 0.0, 0.0])]
    asked_rows = [(i, [1.0, float(i), -1.0]) for i in range(19)]
    got = recall.nearest_pages(table(asked_rows, "query_id bigint, embedding array<float>"), table(rows, "slide_id bigint, embedding array<float>"), 5).collect()
    unit = lambda x: np.array(x) / np.linalg.norm(x)
    expected = set()
    for q, v in asked_rows:
        best = {}
        for page, e in rows[:-1]:
            best[page] = min(best.get(page, 9.0), round(1 - float(unit(v) @ unit(e)), 6) + 0.0)
        expected |= {(q, page, d) for d, page in sorted((d, p) for p, d in best.items())[:5]}
    assert {(r.query_id, r.slide_id, r.distance) for r in got} == expected
    side = lambda x: pa.table({"id": pa.array([i for i, _ in x], pa.int64()), "embedding": pa.array([v for _, v in x], pa.list_(pa.float64()))})
    tiled = recall._nearest(recall._Items(side(rows)), side(asked_rows), 5).to_pylist()
    assert {(r["query_id"], r["slide_id"], r["distance"]) for r in tiled} == expected


def test_a_tile_of_distances_stays_within_its_bound():
    assert block_join.STRIP * recall.ITEM_TILE * 8 <= 16 << 20


def test_postfilter_keeps_rank_gaps(table):
    k, q = corpus(table), asked(table, "alpha")
    pages = k.pages(0)
    first = {r.slide_id: r["rank"] for r in recall.vector_recall(q, k.embeddings, pages).collect()}
    after = {r.slide_id: r["rank"] for r in recall.vector_recall(q, k.embeddings, pages, filter_first=False).collect()}
    assert first == {1: 1, 2: 2} and set(after) == {1, 2} and max(after.values()) <= 5


def hits(df):
    return {(r.query_id, r.slide_id): r for r in df.collect()}


def test_bonuses_and_reasons(table):
    k = corpus(table)
    got = hits(fusion.hybrid_search(asked(table, " Alpha "), k, user_id=0, tag_ids=["t1", "t2"], favorite_user_id=0))
    one, two = got[0, 1], got[0, 2]
    assert one.position == 1 and 3.0 + 2.0 + 2.5 + 1.0 < one.score < 8.6
    assert one.hit_reasons[-3:] == [c.REASON_TITLE_EXACT, c.REASON_FILE_TITLE, c.REASON_MANUAL_TAG]
    assert c.REASON_AI_TAG in two.hit_reasons and two.hit_reasons[-1] == c.REASON_FAVORITE
    kept = hits(fusion.hybrid_search(asked(table, "alpha"), k, user_id=0, tag_ids=["t1"], tag_mode="filter"))
    assert set(kept) == {(0, 1)}


def test_favorites_only_and_blank_queries(table):
    k = corpus(table)
    only = hits(fusion.hybrid_search(asked(table, "beta", ""), k, user_id=0, favorite_user_id=0, favorite_only=True))
    assert set(only) == {(0, 2), (1, 2)} and c.REASON_FAVORITE not in only[0, 2].hit_reasons
    recent = fusion.hybrid_search(asked(table, "  "), k, user_id=0, favorite_user_id=0, topn=2).orderBy("position").collect()
    assert [(r.slide_id, r.score, r.hit_reasons) for r in recent] == [(3, 0.0, []), (2, 0.0, [])]


def test_private_and_historical_scope(table):
    k = corpus(table)
    owner = k.pages(1).select("slide_id").collect()
    assert {r.slide_id for r in owner} == {1, 2, 3, 4}
    every = k.pages(superuser=True, include_historical=True).select("slide_id").collect()
    assert {r.slide_id for r in every} == {1, 2, 3, 4, 6}


def test_compose_keeps_unmatched_items(table):
    outline = table([(0, " ", "alpha"), (1, "B", " "), (2, "C", "nothing")], "item_no bigint, section string, query string")
    best = table([(0, 1, 9, "deck", 3, 0.123456, ["r"])],
                 "query_id bigint, position int, slide_id bigint, presentation_title string, page_no bigint, score double, hit_reasons array<string>")
    got = {r.item_no: r for r in fusion.compose_match(outline, best).collect()}
    assert (got[0].section, got[0].score, got[0].matched) == (c.UNNAMED_SECTION, 0.1235, True)
    assert (got[1].matched, got[2].score, got[2].hit_reasons) == (False, 0.0, [])
    assert fusion.compose_totals(fusion.compose_match(outline, best)).first().asDict() == {"page_count": 3, "matched_count": 1}


def test_evaluation(table):
    shown = table([(1, 1, "x"), (1, 2, "a "), (1, 3, "a"), (2, 1, "q")], "query_id bigint, position int, title string")
    labels = table([(1, "a"), (1, "b"), (3, "z")], "query_id bigint, title string")
    got = {r.query_id: (r.recall, round(r.ndcg, 6)) for r in quality.evaluate_queries(shown, labels).collect()}
    assert got == {1: (0.5, round((1 / 2 + 1 / 3) / (1 + 1 / 2), 6)), 3: (0.0, 0.0)}


def test_ai_tags_never_touch_manual_ones(table):
    raw = '{"summary":"s","topics":["new","known"],"page_purpose":["new"],"content_types":[],"visual_styles":[],"use_cases":["kept"]}'
    analyses = normalize_analyses(table([(1, raw), (2, "bad")], "slide_id bigint, raw string"))
    tags = table([("k", "known", "x", "manual", "active"), ("tag-kept", "kept", "x", "ai", "active")],
                 "tag_id string, name string, category string, source string, status string")
    on = table([(1, "k", "manual", None, True), (1, "old", "ai", 0.1, False), (1, "tag-kept", "ai", 0.2, True), (2, "old", "ai", 0.1, False)],
               "slide_id bigint, tag_id string, origin string, confidence double, is_confirmed boolean")
    all_tags, merged = merge_ai_tags(analyses, tags, on)
    assert {(r.slide_id, r.tag_id, r.origin) for r in merged.collect()} == {
        (1, "k", "manual"), (1, "tag-kept", "ai"), (1, "tag-new", "ai"), (2, "old", "ai")}
    assert {r.name: r.category for r in all_tags.collect()}["new"] == "主题"


def test_vectors_only_for_changed_text(table):
    pages = table([(1, "same"), (2, "new"), (3, " ")], "slide_id bigint, index_text string")
    old = table([(1, "m"), (2, "m")], "slide_id bigint, model string").select(
        "slide_id", "model", F.sha2(F.lit("same"), 256).alias("source_hash"), F.lit("success").alias("status"), F.array(F.lit(1.0).cast("float")).alias("embedding"))
    made = build_embeddings(pages, old, "m", hashed_bag(8))
    assert {(r.slide_id, r.status) for r in made.collect()} == {(2, "success"), (3, "EMPTY_TEXT")}
    assert {r.slide_id: len(r.embedding) for r in merge_embeddings(old, made).collect()} == {1: 1, 2: 8}


def test_the_bag_hashes_many_texts_at_once(monkeypatch):
    texts = ["", None, "  ", "a A b", *(f"word{i} other word{i % 7}" for i in range(300)), "long " * 50]

    def alone(text, dim):
        vec = np.zeros(dim)
        for h in pd.util.hash_array(np.array(text.lower().split(), dtype=object)) if text else ():
            vec[int(h % dim)] += 1.0 if (int(h) >> 32) & 1 else -1.0
        return np.round(vec / max(np.linalg.norm(vec), 1e-12), 7).tolist()

    want, calls, plain = [alone(t, 16) for t in texts], [], pd.util.hash_array
    monkeypatch.setattr(pd.util, "hash_array", lambda words: calls.append(len(words)) or plain(words))
    assert hashed_bag(16)(pd.Series(texts)).tolist() == want and len(calls) == 1
    monkeypatch.setattr(enrich, "BAG_WORDS", 40)
    monkeypatch.setattr(enrich, "BAG_TEXTS", 5)
    calls.clear()
    assert hashed_bag(16)(pd.Series(texts)).tolist() == want and max(calls) == 50 and sorted(calls)[-2] <= 40
    assert hashed_bag(16)(pd.Series([None, " "])).tolist() == [[0.0] * 16] * 2 and len(hashed_bag(16)(pd.Series([], dtype=object))) == 0


def test_ocr_leaves_native_text_and_old_markdown(table):
    pages = table([(1, "n", None), (2, "n", "old"), (3, "n", "old")], "slide_id bigint, native_text string, mineru_markdown string")
    replies = table([(1, '{"md":"read"}'), (2, '{"md":" "}')], "slide_id bigint, raw string")
    got = {r.slide_id: (r.native_text, r.mineru_markdown) for r in merge_ocr_text(pages, replies).collect()}
    assert got == {1: ("n", "read"), 2: ("n", "old"), 3: ("n", "old")}


def test_fused_lists_are_dealt_together(table):
    rows = [(q, p, p) for q in range(30) for p in range(1, 6)]
    ranked = top_k(table(rows, "query_id bigint, slide_id bigint, x int"), ["query_id"], [F.col("x")], 5).select("query_id", "slide_id", "rank")
    fused = fusion.rrf_fuse({"text": ranked, "vector": ranked})
    plan = fused._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("Union")]
    assert "hashpartitioning(query_id" in above and "slide_id" in above[above.index("hashpartitioning(query_id") :]
    queries = table([(q, "x") for q in range(30)], "query_id bigint, query string").repartition(16, "query_id")
    got = fused.join(queries, "query_id").groupBy("query_id").count().collect()
    assert len(got) == 30 and {r["count"] for r in got} == {5}


def test_scope_is_known_before_pages_are_planned(table):
    decks = table([(1, "a", 1, "team", None, 2, 5), (2, "b", 1, "team", None, 4, 5)], "presentation_id int, title string, owner_id bigint, visibility string, deleted_at timestamp, current_version_id int, n int")
    decks = decks.groupBy(*[x for x in decks.columns if x != "n"]).agg(F.sum("n").alias("n"))
    pages = table([(1, 2), (2, 4), (3, 3)], "slide_id bigint, version_id int")
    found = scoped_slides(pages, decks, table([], "version_id int, presentation_id int"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
    assert sorted(r.slide_id for r in found.collect()) == [1, 2]
