import pytest
from pyspark.sql import functions as F

from pagelake.operators import enrich, jobs, library, packages, quality
from pagelake.operators.ranks import blocked_rank, in_ranges, ranged_rank, running_total
from pagelake.operators.versions import file_dedup
from pagelake.sources import snapshots


def pres(table):
    rows = [(1, "a", 0, "team", None, 10, 5), (2, "b", 1, "private", None, 20, 5), (3, "c", 0, "team", "2024-01-01", 30, None)]
    df = table(rows, "presentation_id int, title string, owner_id bigint, visibility string, d string, current_version_id int, folder_id int")
    return df.withColumn("deleted_at", F.col("d").cast("timestamp")).drop("d")


def test_blocked_rank_counts_across_blocks(table):
    rows = [("k" if i % 3 else "j", i * 7) for i in range(300)]
    got = blocked_rank(table(rows, "k string, o bigint"), ["k"], "o", width=50).collect()
    for key in "kj":
        own = sorted((r.o, r.rn) for r in got if r.k == key)
        assert [rn for _, rn in own] == list(range(1, len(own) + 1))


def test_deletes_and_restores_respect_rights(table):
    p = pres(table)
    want = table([(1,), (2,), (3,)], "presentation_id int")
    gone = lambda df: {r.presentation_id for r in df.filter("deleted_at is not null").collect()}
    assert gone(library.soft_delete(p, want, "2024-05-01", user_id=0)) == {1, 3}
    assert library.deleted_count(p, want, user_id=0).first()[0] == 1
    assert gone(library.restore(p, want, user_id=1)) == {3} and gone(library.restore(p, want, superuser=True)) == set()


def test_empty_trash_cascades(table):
    out = library.empty_trash(
        {
            "presentations": pres(table),
            "versions": table([(10, 1), (30, 3)], "version_id int, presentation_id int"),
            "slides": table([(100, 10), (300, 30)], "slide_id bigint, version_id int"),
            "favorites": table([(0, 100), (0, 300)], "user_id bigint, slide_id bigint"),
            "matches": table([(100, None), (300, 100), (None, 300)], "from_slide_id bigint, to_slide_id bigint"),
            "jobs": table([(1, "version", 10), (2, "version", 30)], "job_id bigint, target_type string, target_id int"),
        },
        user_id=0,
    )
    assert {name: df.count() for name, df in out.items()} == {"presentations": 2, "versions": 1, "slides": 1, "favorites": 1, "matches": 1, "jobs": 1}


def test_folder_and_current_and_patches(table):
    p = pres(table)
    folders, files = library.folder_delete(table([(5, "f"), (6, "g")], "folder_id int, name string"), p, table([(5,)], "folder_id int"))
    assert [r.folder_id for r in folders.collect()] == [6] and all(r.folder_id is None for r in files.collect())
    versions = table([(11, 1), (20, 2)], "version_id int, presentation_id int")
    wanted = table([(1, 11), (2, 11)], "presentation_id int, version_id int")
    now = library.set_current(p, versions, wanted, superuser=True).collect()
    assert {r.presentation_id: r.current_version_id for r in now} == {1: 11, 2: 20, 3: 30}
    changes = table([(1, "new", "odd"), (2, "mine", "team"), (3, "x", "private")], "presentation_id int, title string, visibility string")
    got = {r.presentation_id: (r.title, r.visibility) for r in library.patch_presentations(p, changes, user_id=0).collect()}
    assert got == {1: ("a", "team"), 2: ("b", "private"), 3: ("x", "private")}


def test_insert_absent_keeps_origin(table):
    on = table([(1, "t", "ai", 0.5, False)], "slide_id bigint, tag_id string, origin string, confidence double, is_confirmed boolean")
    got = library.batch_tags(on, table([(1,), (2,), (2,)], "slide_id bigint"), "t").collect()
    assert {(r.slide_id, r.origin, r.is_confirmed) for r in got} == {(1, "ai", False), (2, "manual", True)} and len(got) == 2


def test_job_events_collapse(table):
    rows = [("a", "start", 1, 1, None), ("a", "failure", 2, 2, "E"), ("a", "start", 3, 3, None), ("b", "failure", 1, 1, "E"), ("b", "success", 2, 2, None),
            ("b", "start", 3, 3, None), ("c", "start", 1, 1, None), ("c", "failure", 1, 2, "X")]
    df = table(rows, "idempotency_key string, event string, s bigint, seq bigint, error_code string").withColumn("at", F.timestamp_seconds("s"))
    got = {r.idempotency_key: (r.status, r.progress, r.error_code) for r in jobs.collapse_events(df).collect()}
    assert got == {"a": ("running", 0, "E"), "b": ("success", 100, None), "c": ("failed", 0, "X")}


def test_upsert_is_idempotent(table):
    none = table([], "job_type string, target_type string, target_id bigint, stage string, idempotency_key string, status string, progress int")
    ask = table([("parse", "version", 1, "P", "x"), ("parse", "version", 1, "P", "x"), ("parse", "version", 1, "P", "y")],
                "job_type string, target_type string, target_id bigint, stage string, input_data string")
    once = jobs.upsert_requests(none, ask)
    assert once.count() == 2 and jobs.upsert_requests(once, ask).count() == 2


def test_promotion_guards(table):
    v = table([(1, "PARSED"), (2, "READY"), (3, "BASIC_READY"), (4, "ENRICHED")], "version_id int, status string")
    ready = table([(1, 2, 1, 2), (4, 2, 2, 2)], "version_id int, pages bigint, embedded bigint, analysed bigint")
    some = table([(1,), (2,)], "version_id int")
    got = {r.version_id: r.status for r in enrich.promote_status(v, ready, rendered=some, enriched=table([(3,)], "version_id int")).collect()}
    assert got == {1: "BASIC_READY", 2: "READY", 3: "ENRICHED", 4: "READY"}


def test_readiness_counts_pages_not_runs(table):
    slides = table([(1, 9), (2, 9)], "slide_id bigint, version_id int")
    runs = table([(1, "success"), (1, "success"), (2, "failed")], "slide_id bigint, status string")
    assert enrich.readiness(slides, runs, runs).first().asDict() == {"version_id": 9, "pages": 2, "embedded": 1, "analysed": 1}


def test_newest_live_copy_wins(table):
    known = table([(1, 1, "h", 5), (2, 1, "h", 9), (3, 3, "h", 99), (4, 3, "g", 1)], "version_id bigint, presentation_id int, sha256 string, created_at bigint")
    got = file_dedup(table([(7, "h"), (8, "g")], "file_id bigint, sha256 string"), known, pres(table))
    assert {r.file_id: (r.is_duplicate, r.existing_version_id) for r in got.collect()} == {7: (True, 2), 8: (False, None)}


def test_a_retry_sets_the_start_again(table):
    rows = [("a", "start", 1, 1), ("a", "failure", 2, 2), ("a", "start", 3, 3), ("a", "start", 4, 4), ("a", "success", 9, 5), ("b", "start", 1, 1), ("b", "failure", 2, 2), ("b", "start", 5, 3)]
    df = table(rows, "idempotency_key string, event string, s bigint, seq bigint").withColumn("at", F.timestamp_seconds("s")).withColumn("error_code", F.lit(None).cast("string"))
    got = {r.k: r.s for r in jobs.collapse_events(df).selectExpr("idempotency_key k", "unix_seconds(started_at) s").collect()}
    assert got == {"a": 3, "b": 5}


def test_targets_of_other_kinds_keep_their_jobs(table):
    tables = {
        "presentations": table([(1,), (2,)], "presentation_id int"), "versions": table([(8, 1), (9, 2)], "version_id int, presentation_id int"),
        "slides": table([(80, 8), (8, 9)], "slide_id bigint, version_id int"),
        "jobs": table([(1, "version", 8), (2, "slide", 8), (3, "version", 9)], "job_id bigint, target_type string, target_id bigint"),
    }
    left = library.hard_delete(tables, table([(1,)], "presentation_id int"))
    assert {r.job_id for r in left["jobs"].collect()} == {2, 3}


def test_repeated_changes_give_one_row(table):
    pages = table([(1, 7, "old", "x"), (2, 7, "stay", "y"), (3, 8, "other", "z")], "slide_id bigint, version_id int, title string, user_note string")
    changes = table([(1, "b", 2, None), (1, "a", 1, None), (2, None, 1, ["user_note"]), (3, "no", 1, None)], "slide_id bigint, title string, at int, set_null array<string>")
    files, versions = table([(1, 0), (2, 5)], "presentation_id int, owner_id int"), table([(7, 1), (8, 2)], "version_id int, presentation_id int")
    got = [tuple(r) for r in library.patch_slides(pages, changes, files, versions, user_id=0).collect()]
    assert sorted(got, key=str) == [(1, 7, "b", "x"), (2, 7, "stay", None), (3, 8, "other", "z")]


def test_repeated_replies_give_one_row(table):
    slides = table([(1, "old", "none"), (2, "keep", "none")], "slide_id bigint, ai_summary string, ai_status string")
    runs = table([(1, "first", "success", 1), (1, "second", "success", 2), (2, None, "failed", 1)], "slide_id bigint, summary string, status string, at int")
    assert sorted(tuple(r) for r in enrich.apply_summaries(slides, runs).collect()) == [(1, "second", "success"), (2, "keep", "failed")]
    elements = table([(1, 0, "picture", None, ["x"]), (1, 1, "textbox", "t", ["t"])], "slide_id bigint, element_index int, element_type string, text string, tokens array<string>")
    replies = table([(1, 0, '{"md": "old"}', 1), (1, 0, '{"md": "new words"}', 2)], "slide_id bigint, element_index int, raw string, at int")
    got = {r.element_index: (r.text, r.tokens) for r in enrich.merge_element_ocr(elements, replies).collect()}
    assert got == {0: ("new words", ["new", "words"]), 1: ("t", ["t"])}


def test_a_long_relationship_chain_is_followed(table):
    n = 12
    parts = table([(1, f"p/{i}.xml") for i in range(n)], "file_id bigint, part string")
    rels = table([(1, f"p/{i}.xml", f"{(i + 1) % n}.xml", "Internal") for i in range(n)], "file_id bigint, part string, target string, target_mode string")
    got = packages.part_closure(table([(1, "p/0.xml")], "file_id bigint, part string"), rels, parts)
    assert got.count() == n


def test_patches_of_different_columns_add_up(table):
    pages = table([(1, "old", "a"), (2, "old", "b")], "slide_id bigint, title string, user_note string")
    changes = table(
        [(1, "new", None, None, 1), (1, None, "noted", None, 2), (1, "newer", None, None, 3), (1, None, None, ["user_note"], 4), (2, None, "c", None, 1), (2, None, None, ["title"], 0)],
        "slide_id bigint, title string, user_note string, set_null array<string>, at int",
    )
    got = {r.slide_id: (r.title, r.user_note) for r in library.patch(pages, changes, "slide_id", ["title", "user_note"]).collect()}
    assert got == {1: ("newer", None), 2: (None, "c")}


def test_last_tagging_run_counts(table):
    analysis = "struct<summary:string,topics:array<string>,page_purpose:array<string>,content_types:array<string>,visual_styles:array<string>,use_cases:array<string>,confidence:double>"
    run = lambda at, topic, status="success": (1, ("s", [topic], [], [], [], [], 0.5), status, at)
    analyses = table([run(1, "first"), run(2, "second"), run(3, "third", "failed")], f"slide_id bigint, analysis {analysis}, status string, at int")
    tags = table([], "tag_id string, name string, category string, source string, status string")
    none = table([], "slide_id bigint, tag_id string, origin string, confidence double, is_confirmed boolean")
    _, merged = enrich.merge_ai_tags(analyses, tags, none)
    assert [r.tag_id for r in merged.collect()] == ["tag-second"]


def test_texts_without_a_vector_fail_and_are_tried_again(table):
    pages = table([(1, "good"), (2, "bad"), (3, " ")], "slide_id bigint, index_text string")
    none = table([], "slide_id bigint, model string, source_hash string, status string, embedding array<float>")

    def embed(texts):
        import pandas as pd

        return pd.Series([[1.0] if t == "good" else None for t in texts], dtype=object)

    made = enrich.build_embeddings(pages, none, "m", embed)
    assert {r.slide_id: r.status for r in made.collect()} == {1: "success", 2: "failed", 3: "EMPTY_TEXT"}
    assert {r.slide_id for r in enrich.embedding_work(pages, made, "m").collect()} == {2, 3}


def test_sparse_ids_share_sampled_ranges(table):
    rows = [("k" if i % 3 else "j", i * 1_000_003) for i in range(2_000)]
    sparse = table(rows, "k string, o bigint")
    assert in_ranges(sparse, ["o"], width=100).select("range").distinct().count() <= 20
    got = ranged_rank(sparse, ["k"], ["o"], width=100).collect()
    for key in "kj":
        own = sorted((r.o, r.rn) for r in got if r.k == key)
        assert [rn for _, rn in own] == list(range(1, len(own) + 1))
    summed = running_total(sparse, [], [F.col("o").desc()], F.lit(2), "total", width=64).collect()
    assert [r.total for r in sorted(summed, key=lambda r: -r.o)] == [2 * (i + 1) for i in range(2_000)]
    assert ranged_rank(sparse.limit(0), [], ["o"]).count() == 0


def test_screens_of_a_directory_equal_slices_of_all_pages(table):
    pages = [(1000 * v + p, v, p * 7) for v in range(1, 6) for p in range([1, 50, 3, 200, 17][v - 1])]
    slides = table(pages, "slide_id bigint, version_id int, page_no bigint")
    files = table(
        [(i, f"f{i}", 0, "private", None if i == 3 else f"2024-01-0{i % 2 + 1}", i, None) for i in range(1, 6)],
        "presentation_id int, title string, owner_id bigint, visibility string, c string, current_version_id int, d string",
    )
    files = files.withColumn("deleted_at", F.col("d").cast("timestamp")).withColumn("created_at", F.col("c").cast("timestamp")).drop("c", "d")
    versions = table([(i, i) for i in range(1, 6)], "version_id int, presentation_id int")
    directory = library.page_directory(slides, width=40)
    assert library.scoped_page_count(directory, files, versions, user_id=0) == len(pages)
    everything = sorted(pages, key=lambda r: (r[1] == 3, r[1] % 2 == 0, r[1], r[2]))  # odd days are later, no date comes last
    for page, size in ((1, 10), (2, 48), (6, 48), (28, 10), (9, 48)):
        got = [(r.position, r.slide_id) for r in library.browse_pages(directory, files, versions, user_id=0, page=page, page_size=size).collect()]
        assert got == [(i + 1, r[0]) for i, r in enumerate(everything)][(page - 1) * size : page * size]


def test_a_snapshot_is_seen_whole_or_not_at_all(spark, table, tmp_path, monkeypatch):
    path, schema = str(tmp_path / "t"), "version_id int, t string"
    state = lambda n=None: sorted((r.version_id, r.t) for r in snapshots.read_snapshot(spark, path, n).collect())
    with pytest.raises(FileNotFoundError):
        state()
    assert snapshots.merge_snapshot(table([(1, "a"), (1, "b"), (2, "c"), (None, "n")], schema), path, "version_id", buckets=2) == 1
    with monkeypatch.context() as broken:  # the write dies between its files and its manifest
        broken.setattr(snapshots, "_publish", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            snapshots.merge_snapshot(table([(1, "half")], schema), path, "version_id")
    first = [(1, "a"), (1, "b"), (2, "c"), (None, "n")]
    assert sorted(((r.version_id, r.t) for r in snapshots.read_snapshot(spark, path).collect()), key=str) == sorted(first, key=str)
    before = snapshots.read_snapshot(spark, path)
    assert snapshots.merge_snapshot(table([(1, "z", 5), (None, "m", 6), (7, "new", 7)], schema + ", extra int"), path, "version_id", start=1) == 2
    with pytest.raises(snapshots.WriteConflict):
        snapshots.merge_snapshot(table([(2, "late")], schema), path, "version_id", start=1)
    rows = {(r.version_id, r.t, r.extra) for r in snapshots.read_snapshot(spark, path).collect()}
    assert rows == {(1, "z", 5), (None, "m", 6), (7, "new", 7), (2, "c", None)}
    assert before.count() == 4 and snapshots.read_snapshot(spark, path, 1).count() == 4
    assert snapshots.merge_snapshot(table([], schema), path, "version_id") == 3 and snapshots.read_snapshot(spark, path).count() == 4
    snapshots.expire(spark, path, keep=1)
    assert snapshots.snapshots(spark, path) == [3] and snapshots.read_snapshot(spark, path).count() == 4
    with pytest.raises(FileNotFoundError):
        snapshots.read_snapshot(spark, path, 1)


def test_the_closure_writes_each_row_once(spark, table):
    n = 25
    parts = table([(1, f"p/{i}.xml") for i in range(n)], "file_id bigint, part string")
    rels = table([(1, f"p/{i}.xml", f"{(i + s) % n}.xml", "Internal") for i in range(n) for s in (1, 1)], "file_id bigint, part string, target string, target_mode string")
    got = packages.part_closure(table([(1, "p/0.xml"), (1, "p/20.xml"), (1, "p/20.xml")], "file_id bigint, part string"), rels, parts)
    assert got.count() == got.distinct().count() == 2 * n
    assert sum(spark.read.parquet(f).count() for f in got.inputFiles()) == 2 * n
