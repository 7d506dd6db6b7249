import io
import json
import zipfile

from pyspark.sql import functions as F

from pagelake.operators import packages, recall, search_index
from pagelake.plans import catalog
from pagelake.plans.views import Views, package_bytes
from pagelake.sources import files, tables
from pagelake.sources import packages as source
from pagelake.sources.bulk import bulk_pages
from pagelake.streaming import ingest, jobs, membership

TEXT = "\n".join(["First line", " second ", "a | b", "c | ", "", "x", "y", "z", "next page", "", "<&>"])


def packed(table):
    return table([(1, bytearray(package_bytes(TEXT, 1)))], "file_id bigint, content binary")


def test_packages_become_pages(table):
    rows = source.parse_packages(packed(table)).orderBy("page_no").collect()
    assert [r.page_no for r in rows] == [1, 2]
    one, two = rows
    assert (one.title, one.notes_text) == ("First line", "note 1")
    assert one.native_text == "First line\nsecond\nx\ny\nz\na\nb\nc"
    assert [list(map(list, t.rows)) for t in one.content.tables] == [[["a", "b"], ["c", ""]]]
    pic = one.content.pictures[0]
    assert (pic.rid, pic.target, pic.position.x, pic.position.cy) == ("rId2", "../media/image1.png", 10, 40)
    assert {r.target_mode for r in one.content.relationships} == {"Internal", "External"}
    assert (two.native_text, two.notes_text) == ("next page\n<&>", "")


def test_closure_follows_cycles_and_skips_external(table):
    parts = source.package_parts(packed(table))
    facts = source.part_facts(parts)
    rels = source.part_relationships(facts)
    order = source.slide_order(facts, rels)
    closure = packages.part_closure(order, rels, parts)
    got = {}
    for r in closure.collect():
        got.setdefault(r.root, set()).add(r.part)
    shared = {"ppt/slideLayouts/slideLayout1.xml", "ppt/slideMasters/slideMaster1.xml"}
    assert got["ppt/slides/slide2.xml"] == {"ppt/slides/slide2.xml"} | shared
    assert got["ppt/slides/slide1.xml"] == {"ppt/slides/slide1.xml", "ppt/media/image1.png", "ppt/notesSlides/notesSlide1.xml"} | shared
    kept = packages.kept_parts(order, rels, parts)
    assert packages.orphan_parts(kept, parts).count() == 0
    assert all(r.bytes > 0 for r in packages.page_weights(kept).collect())


def test_parts_leave_in_batches_of_many_archives():
    parts = [(f, *part) for f in range(40) for part in source._parts_of(package_bytes(TEXT, f))]
    together = list(source._packed(iter(parts), source._PARTS_TYPE, lambda row: len(row[3] or b""), 1 << 22))
    assert [b.num_rows for b in together] == [len(parts)] and len(set(together[0].column(0).to_pylist())) == 40
    small = list(source._packed(iter(parts), source._PARTS_TYPE, lambda row: len(row[3] or b""), 2000))
    xml = [sum(len(x or b"") for x in b.column(3).to_pylist()) for b in small]
    assert len(small) > 10 and all(n - len(b.column(3)[b.num_rows - 1].as_py() or b"") < 2000 for n, b in zip(xml, small))
    rows = lambda batches: [tuple(r.values()) for b in batches for r in b.to_pylist()]
    assert rows(together) == rows(small) == parts
    assert list(source._packed(iter([]), source._PARTS_TYPE, len, 1)) == []


def test_statements_go_to_arrow_field_by_field():
    facts = [[source._fact("picture", 0, name="r", place=[1, None, 3, 4]), source._fact("cell", 1, 2, text="x")], [], [source._fact("rel", 0, target="t")]]
    kind = source._FACTS_TYPE.field("facts").type
    names = ["kind", "n", "m", "name", "text", "target", "mode", "place"]
    made = source._column(tuple(facts), kind)
    made.validate(full=True)
    assert made.type == kind and made.to_pylist() == [[dict(zip(names, f)) for f in cell] for cell in facts]
    assert source._column(([], []), kind).to_pylist() == [[], []]


def test_packages_share_a_frame_and_differ_in_pages():
    read = lambda text, n: {p: xml for p, _, xml, damaged in source._parts_of(package_bytes(text, n)) if not damaged}
    one, two, other = read("a", 1), read(TEXT, 2), read("b", 300)
    assert set(one) == set(other) == set(two) - {"ppt/slides/slide2.xml", "ppt/slides/_rels/slide2.xml.rels"}
    assert {p for p in one if one[p] != other[p]} == {"ppt/slides/slide1.xml", "ppt/notesSlides/notesSlide1.xml"}
    with zipfile.ZipFile(io.BytesIO(package_bytes("b", 300))) as z:
        assert z.testzip() is None and len(z.namelist()) == len(set(z.namelist())) and z.read("ppt/media/image1.png")[4:] == (300).to_bytes(8, "big")


def test_structure_check(table):
    ids = table([(1,), (2,), (3,)], "file_id bigint")
    refs = table([(1, 1), (2, 1), (2, 2), (3, 1)], "file_id bigint, page_no int")
    declared = table([(1, "a.xml"), (3, "gone.xml")], "file_id bigint, part string")
    parts = table([(1, "a.xml", True), (1, "b.png", None), (2, "a.xml", True), (3, "a.xml", False)], "file_id bigint, part string, xml_ok boolean")
    got = {r.file_id: (r.n_slides, r.dangling, r.bad_xml, r.passed) for r in packages.structure_check(ids, refs, declared, parts).collect()}
    assert got == {1: (1, 0, 0, True), 2: (2, 0, 0, False), 3: (1, 1, 1, False)}


def archive(names, body=b"x"):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name in names:
            z.writestr(name, body)
    return out.getvalue()


def test_validation_first_rule_wins(table):
    need = ["ppt/presentation.xml", "[Content_Types].xml"]
    good = archive(need)
    locked = bytearray(good)
    at = locked.index(b"PK\x01\x02")
    locked[at + 8] |= 1
    broken = bytearray(archive(need, b"abcdefgh" * 50))
    broken[45 + len(need[0])] ^= 0xFF
    cases = [
        ("a.pptx", good, None), ("a.key", b"", "UNSUPPORTED_EXTENSION"), ("a.pptx", b"", "INVALID_ZIP"), ("a.pptx", b"hello", "UNSUPPORTED_FORMAT"),
        ("a.pptx", b"PK\x03\x04junk", "CORRUPT_ZIP"), ("a.pptx", archive(["x"]), "NOT_PPTX"), ("a.pptx", archive(need, b"0" * 400000), "ZIP_BOMB"),
        ("a.pptx", bytes(locked), "ENCRYPTED_FILE"), ("a.pptx", bytes(broken), "CORRUPT_ZIP"), ("b.pdf", b"%PDF-1 body", "INVALID_PDF"),
        ("b.pdf", b"%PDF-1 body %%EOF\n", None), ("c.ppt", bytes.fromhex("D0CF11E0A1B11AE1"), "INVALID_PPT"),
        ("c.ppt", bytes.fromhex("D0CF11E0A1B11AE1") + b"0" * 600, None), ("a.pptx", b"PK\x03\x04" + b"0" * 2_000_000, "FILE_TOO_LARGE"),
    ]
    df = table([(i, n, bytearray(b)) for i, (n, b, _) in enumerate(cases)], "file_id bigint, filename string, content binary")
    checked = files.validate_files(df, (".pptx", ".ppt", ".pdf"), max_bytes=1_900_000)
    assert {r.file_id: r.error for r in checked.collect()} == {i: e for i, (_, _, e) in enumerate(cases)}
    good_ones, bad_ones = files.split_valid(checked)
    assert (good_ones.count(), bad_ones.count()) == (3, 11)


def test_scan_by_key_layout(spark, tmp_path):
    place = tmp_path / "presentations/p1/versions/v2"
    place.mkdir(parents=True)
    (place / "source.pptx").write_bytes(b"PK\x03\x04")
    (place / "preview.pdf").write_bytes(b"%PDF")
    rows = files.scan_files(spark, str(tmp_path)).collect()
    assert [(r.presentation_id, r.version_id, r.extension, r.length) for r in rows] == [("p1", "v2", "pptx", 4)]
    key = spark.range(1).select(files.source_key(F.lit("p1"), F.lit("v2"), F.lit(".pdf"))).first()[0]
    assert key == "presentations/p1/versions/v2/source.pdf"


def test_small_inputs(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps([{"id": 1, "query": "q", "relevant_titles": ["a", "b"], "type": "keyword"}]))
    (tmp_path / "d.txt").write_text("# words\n无人系统 100 n\n\n单页\n")
    assert tables.labelled_titles(tables.read_query_set(spark, str(tmp_path / "q.json"))).count() == 2
    assert [tuple(r) for r in tables.read_dictionary(spark, str(tmp_path / "d.txt")).collect()] == [("无人系统", 100, "n"), ("单页", None, None)]


def test_replace_and_bucketed_write(spark, table, tmp_path):
    old = table([(1, 1, "a"), (2, 1, "b"), (3, 2, "c")], "slide_id bigint, version_id int, t string")
    new = table([(9, 1, "z")], "slide_id bigint, version_id int, t string")
    assert {(r.slide_id, r.t) for r in tables.replace_by_key(old, new, ["version_id"]).collect()} == {(9, "z"), (3, "c")}
    path = str(tmp_path / "t")
    tables.write_table(old, path, buckets=4)
    assert spark.read.parquet(path).count() == 3


def test_bulk_cycles_the_pool(table):
    made = bulk_pages(table([(5, "a"), (9, "b"), (12, "c")], "slide_id bigint, t string"), target=8)
    assert [(r.page_no, r.source_slide_id) for r in made.orderBy("page_no").collect()] == [(i + 1, [5, 9, 12][i % 3]) for i in range(8)]


def test_placeholders_only_for_bare_versions(table):
    out = files.placeholder_slides(table([(1, 2), (2, 3), (3, 0)], "version_id int, page_count int"), table([(2,)], "version_id int"))
    assert sorted((r.version_id, r.page_no) for r in out.collect()) == [(1, 1), (1, 2)]


RAW = ("slide_id bigint, version_id int, page_no bigint, title string, native_text string, notes_text string, ai_summary string, presentation_title string, "
       "content struct<shapes:array<struct<type:string,text:string>>,tables:array<struct<rows:array<array<string>>>>,"
       "pictures:array<struct<rid:string,target:string,position:struct<x:bigint,y:bigint,cx:bigint,cy:bigint>>>>")


def test_streamed_pages_replace_earlier_ones(spark, table, tmp_path):
    source_dir, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    page = lambda n, body, shapes: (n, 1, n, "t", body, None, None, "deck", ([("textbox", s) for s in shapes], [], []))

    def arrive(rows):
        table(rows, RAW).coalesce(1).write.mode("append").parquet(source_dir)
        ingest.stream_slides(spark.readStream.schema(RAW).parquet(source_dir), target, state)

    arrive([page(1, "old words", ["a", "b"]), page(2, "stay", ["c"])])
    arrive([page(1, "new", [])])
    got = {r.slide_id: r.native_text for r in ingest.read_slides(spark, target).collect()}
    assert got == {1: "new", 2: "stay"}
    assert {(r.slide_id, r.text) for r in ingest.read_elements(spark, target).collect()} == {(2, "c")}


def test_a_run_over_two_batches_replaces_the_former_run(spark, table, tmp_path):
    source_dir, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    page = lambda n, body, run, version=1: (n, version, n, "t", body, None, None, "deck", ([("textbox", body)], [], []), run)

    def arrive(rows):
        table(rows, RAW + ", run_id string").coalesce(1).write.mode("append").parquet(source_dir)
        ingest.stream_slides(spark.readStream.schema(RAW + ", run_id string").parquet(source_dir), target, state)

    def found(word):
        asked = table([(1, word)], "query_id bigint, query string")
        scope = table([(1,), (2,)], "version_id int")
        pages = recall.text_recall(asked, ingest.page_search(spark, target), scope)
        elements = recall.element_text_recall(asked, ingest.element_search(spark, target), scope)
        assert {r.slide_id for r in pages.collect()} == {r.slide_id for r in elements.collect()}
        return {r.slide_id: r.score for r in pages.collect()}

    arrive([page(1, "red apple", "a"), page(2, "red pear", "a"), page(9, "red", "x", 2)])
    arrive([page(3, "red plum", "a")])
    assert set(found("red")) == {1, 2, 3, 9}  # one run, two batches
    arrive([page(1, "blue apple", "b"), page(4, "blue", "b")])
    assert set(found("red")) == {9} and set(found("blue")) == {1, 4}
    before = {w: found(w) for w in ("red", "blue")}
    ingest.compact_indexes(spark, target)
    assert {w: found(w) for w in before} == before
    arrive([page(5, "blue sky", "b")])  # the compacted run goes on
    assert set(found("blue")) == {1, 4, 5}
    assert {r.slide_id for r in ingest.read_slides(spark, target).collect()} == {1, 4, 5, 9}
    assert {r.slide_id for r in ingest.read_elements(spark, target).collect()} == {1, 4, 5, 9}
    search_index.drop_versions(table([(1,)], "version_id int"), f"{target}/index/pages")
    search_index.drop_versions(table([(1,)], "version_id int"), f"{target}/index/elements")
    assert set(found("red")) == {9} and not found("blue")


def test_streamed_job_state_does_not_regress(spark, table, tmp_path):
    schema = "target_type string, target_id bigint, at timestamp, seq bigint, status string, progress int"
    source_dir, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def arrive(rows):
        df = table(rows, "target_type string, target_id bigint, s bigint, seq bigint, status string, progress int")
        df.select("target_type", "target_id", F.timestamp_seconds("s").alias("at"), "seq", "status", "progress").coalesce(1).write.mode("append").parquet(source_dir)
        jobs.stream_job_state(spark.readStream.schema(schema).parquet(source_dir), target, state)

    arrive([("v", 1, 10, 1, "running", 5), ("v", 1, 20, 2, "success", 100), ("v", 2, 5, 3, "running", 1), ("page", 1, 30, 8, "pending", 0)])
    arrive([("v", 1, 15, 9, "failed", 7), ("v", 2, 6, 4, "failed", 2)])
    got = {(r.target_type, r.target_id): r.status for r in jobs.read_job_state(spark, target).collect()}
    assert got == {("v", 1): "success", ("v", 2): "failed", ("page", 1): "pending"}


def test_streamed_files_land_once(spark, table, tmp_path):
    source_dir, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "sha256 string, arrived_at timestamp, n int"

    def arrive(rows):
        df = table(rows, "sha256 string, s bigint, n int")
        df.select("sha256", F.timestamp_seconds("s").alias("arrived_at"), "n").coalesce(1).write.mode("append").parquet(source_dir)
        ingest.land_new_files(spark.readStream.schema(schema).parquet(source_dir), table([("k",)], "sha256 string"), target, state)

    arrive([("a", 9, 1), ("a", 3, 2), ("k", 1, 3)])
    arrive([("a", 99_999_999, 4), ("b", 5, 5)])
    assert {(r.sha256, r.n) for r in spark.read.parquet(target).collect()} == {("a", 2), ("b", 5)}


def test_streams_share_what_has_landed(spark, table, tmp_path):
    """Streams of their own checkpoints number batches alike; neither loses nor repeats the other's files."""
    target = str(tmp_path / "files")
    schema = "sha256 string, arrived_at timestamp, n int"
    none = table([], "sha256 string")
    for run, ids in enumerate([range(0, 300), range(200, 500), [5, 499, 900]]):
        src = str(tmp_path / f"in{run}")
        table([(f"h{i}", i, run) for i in ids], "sha256 string, s bigint, n int").select("sha256", F.timestamp_seconds("s").alias("arrived_at"), "n").write.parquet(src)
        ingest.land_new_files(spark.readStream.schema(schema).parquet(src), none, target, str(tmp_path / f"state{run}"))
    got = sorted((int(r.sha256[1:]), r.n) for r in spark.read.parquet(target).collect())
    assert got == [(i, 0 if i < 300 else 1) for i in range(500)] + [(900, 2)]


def test_filters_leave_few_parts(spark, tmp_path):
    memory = str(tmp_path / "met")
    hashes = lambda lo, hi: spark.range(lo, hi).select(F.sha2(F.col("id").cast("string"), 256).alias("sha256"))
    assert membership.met_before(hashes(0, 9), memory, "a-0") is None
    membership.remember(hashes(0, 4000), memory, "a-0")
    membership.remember(hashes(4000, 5000), memory, "a-1")
    assert membership.may_be_met(hashes(5000, 9000), memory, "a-2").count() < 40
    met = membership.met_before(hashes(3990, 6000), memory, "a-2")
    want = {r.sha256 for r in hashes(3990, 5000).collect()}
    assert {r.sha256 for r in met.collect()} == want
    again = membership.met_before(hashes(3990, 5000), memory, "a-1")  # a retried delivery does not meet itself
    assert again.count() == 10


def test_write_table_keeps_other_keys_of_a_bucket(spark, table, tmp_path):
    path = str(tmp_path / "t")
    old = spark.range(400).selectExpr("cast(id % 200 as int) version_id", "cast(id as string) t")
    tables.write_table(old, path, buckets=4)
    tables.write_table(table([(7, "new")], "version_id int, t string"), path, buckets=4)
    got = [(r.version_id, r.t) for r in spark.read.parquet(path).collect()]
    assert len(got) == 399 and [t for v, t in got if v == 7] == ["new"]


def test_damaged_packages_become_failed_rows(spark, table):
    ns = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    slide = f'<p:sld {ns}><p:cSld><p:spTree><p:sp><a:p><a:r><a:t>Größe</a:t></a:r></a:p></p:sp><p:pic><a:blip r:embed="x"/><a:xfrm><a:off x="10.5" y="n"/></a:xfrm></p:pic></p:spTree></p:cSld></p:sld>'
    rel = '<Relationship Id="{}" Type="slide" Target="{}"/>'

    def deck(parts):
        raw = io.BytesIO()
        with zipfile.ZipFile(raw, "w") as z:
            z.writestr("ppt/presentation.xml", f'<p:presentation {ns}><p:sldIdLst><p:sldId r:id="r1"/><p:sldId r:id="r2"/></p:sldIdLst></p:presentation>')
            z.writestr("ppt/_rels/presentation.xml.rels", "<Relationships>" + rel.format("r1", "gone.xml") + rel.format("r1", "slides/s1.xml") + rel.format("r2", "slides/s2.xml") + "</Relationships>")
            for n, data in parts.items():
                z.writestr(n, data)
        return raw.getvalue()

    wide = ('<?xml version="1.0" encoding="UTF-16"?>' + slide).encode("utf-16")
    rows = [(1, bytearray(deck({"ppt/slides/s1.xml": wide, "ppt/slides/s2.xml": "<broken"}))), (2, bytearray(b"no archive"))]
    got = source.parse_packages(table(rows, "file_id bigint, content binary")).collect()
    assert {(r.file_id, r.page_no, r.native_text, r.parse_status) for r in got} == {(1, 1, "Größe", "success"), (1, 2, "", "failed"), (2, None, None, "failed")}
    place = next(r for r in got if r.page_no == 1).content.pictures[0].position
    assert (place.x, place.y) == (10, None)


def test_files_that_list_no_page_fail(table):
    other = io.BytesIO()
    with zipfile.ZipFile(other, "w") as z:
        z.writestr("ppt/slides/slide1.xml", "<a/>")
    empty = io.BytesIO()
    zipfile.ZipFile(empty, "w").close()
    rows = [(1, bytearray(package_bytes(TEXT, 1))), (2, bytearray(other.getvalue())), (3, bytearray(empty.getvalue())), (4, bytearray(b"PK")), (5, None)]
    got = source.parse_packages(table(rows, "file_id bigint, content binary")).select("file_id", "page_no", "parse_status").collect()
    assert {tuple(r) for r in got} == {(1, 1, "success"), (1, 2, "success"), (2, None, "failed"), (3, None, "failed"), (4, None, "failed"), (5, None, "failed")}


def test_a_table_in_many_files_arrives_as_a_stream(spark, table, tmp_path):
    rows = table([(i, f"text {i}") for i in range(40)], "doc_id bigint, text string")
    rows.repartition(3).write.parquet(str(tmp_path / "many" / "documents.parquet"))
    (tmp_path / "one").mkdir()
    rows.toPandas().to_parquet(tmp_path / "one" / "documents.parquet")
    for layout in ("many", "one"):
        seen = []
        stream = catalog._stream(Views(spark, str(tmp_path / layout)), "documents")
        ingest.run_available(stream, lambda batch, n: seen.extend(r.doc_id for r in batch.collect()), str(tmp_path / f"state-{layout}"))
        assert sorted(seen) == list(range(40))
