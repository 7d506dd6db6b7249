import hashlib
import json

from pyspark.sql import functions as F

from pagelake.functions import scalar, text
from pagelake.operators.enrich import normalize_analyses


def values(spark, rows, expr, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], schema).select(expr).collect()]


def test_tokens_keep_dictionary_words(spark):
    rows = ["河流地图 MAP-2 über", "蓝色河流图", "", None, "a1b_c"]
    got = values(spark, rows, text.segmented(F.col("x"), ["河流", "地图", "蓝色"]))
    assert got == ["河流 地图 map 2 über", "蓝色 河流 图", "", "", "a1b c"]
    assert values(spark, rows[:1], text.segmented(F.col("x"))) == ["河 流 地 图 map 2 über"]


def test_line_ends_lose_all_blanks(spark):
    got = values(spark, ["a \u3000\nb\u00a0\r\nc\x0bd\t ", "![x](y)e\u2028f"], text.strip_images(F.col("x")))
    assert got == ["a\nb\nc\nd", "e\nf"]


def test_fingerprint_ignores_space_and_case(spark):
    rows = ["A b 　C\x0b\n", "abc", "", None]
    want = [hashlib.sha256(s.encode()).hexdigest() for s in ("abc", "abc", "", "")]
    assert values(spark, rows, text.fingerprint(F.col("x"))) == want


def test_hamming(spark):
    pairs = [("0" * 16, "0" * 16, 0), ("8000000000000000", "0" * 16, 1), ("f" * 16, "0" * 16, 64), ("ff", "0", 8), ("zz", "0", None), (None, "0", None), ("", "1", None)]
    df = spark.createDataFrame([p[:2] for p in pairs], "a string, b string")
    assert [r[0] for r in df.select(scalar.hamming(F.col("a"), F.col("b"))).collect()] == [p[2] for p in pairs]


def test_bits_round_trip(spark):
    rows = ["8000000000000001", "00000000000000ff"]
    assert values(spark, rows, scalar.bits_to_hex(scalar.hex_to_bits(F.col("x")))) == rows


def test_titles_and_parts(spark):
    assert values(spark, ["a/b/Deck.v2.pptx", "plain", "x/.pptx"], text.title_from_path(F.col("x"))) == ["Deck.v2", "plain", ""]
    assert values(spark, ["../media/a.png", "b.png", "", None], scalar.image_part(F.col("x"))) == ["ppt/media/a.png", "ppt/slides/b.png", None, None]
    source = F.lit("ppt/slides/slide1.xml")
    rows = ["../media/a.png", "/ppt/x.xml", "./b/../c.xml", "../../../d.xml", "..\\e.xml"]
    assert values(spark, rows, scalar.resolved_part(F.col("x"), source)) == ["ppt/media/a.png", "ppt/x.xml", "ppt/slides/c.xml", "d.xml", "ppt/e.xml"]
    assert values(spark, ["http://x/relationships/slide", "http://x/slide/", ""], scalar.relation_name(F.col("x"))) == ["slide", "slide", ""]
    assert values(spark, ["ppt/slides/s.xml", "s.xml"], scalar.rels_part(F.col("x"))) == ["ppt/slides/_rels/s.xml.rels", "_rels/s.xml.rels"]


def test_idempotency_key(spark):
    df = spark.createDataFrame([("t", "7", "in"), ("t", "7", None), ("t", "7", "")], "a string, b string, c string")
    got = [r[0] for r in df.select(scalar.idempotency_key(F.col("a"), F.col("b"), F.col("c"))).collect()]
    digest = lambda s: "t:7:" + hashlib.sha256(s.encode()).hexdigest()[:16]
    assert got == [digest("t|7|in"), digest("t|7"), digest("t|7")]


def test_durations(spark):
    took = [0, 999, 1000, 1250, 6550, 9950, 9999, 10499, 59700, 60000, 125400, 179700, -5]
    want = ["0ms", "999ms", "1.0s", "1.3s", "6.5s", "9.9s", "10.0s", "10s", "60s", "1m", "2m 5s", "2m 60s", None]
    df = spark.createDataFrame([(ms,) for ms in took], "ms bigint")
    start = F.timestamp_millis(F.lit(1704067200000))
    end = F.timestamp_millis(F.lit(1704067200000) + F.col("ms"))
    assert [r[0] for r in df.select(scalar.duration_text(start, end)).collect()] == want


def test_markdown_shapes(spark):
    md = "![x](a.png)\n\n\n\nHead  \n\n\nbody\t\n"
    rows = [
        json.dumps({"md": " ", "markdown": md}),
        json.dumps({"results": {"p1": {"md": ""}, "p2": {"md_content": md}}}),
        json.dumps({"results": [{"other": 1}, "  ", {"md": md}]}),
        json.dumps({"results": ["plain"]}),
        json.dumps({"md": 5}),
        "not json",
        None,
    ]
    assert values(spark, rows, text.markdown_of(F.col("x"))) == ["Head\n\nbody"] * 3 + ["plain", "", "", ""]
    lists = [json.dumps({"content_list": [1, 2]}), json.dumps({"middle_json": {"content_list": [1]}}), "{}"]
    assert values(spark, lists, F.size(text.content_list_of(F.col("x")))) == [2, 1, 0]


def test_analyses(spark):
    good = {"summary": "s", "topics": ["a", "b"], "page_purpose": "p", "content_types": None, "visual_styles": 3, "use_cases": []}
    raws = [
        json.dumps({**good, "confidence": 0.7}),
        "```json\n" + json.dumps({**good, "confidence": "0.25"}) + "\n```",
        "Sure: " + json.dumps({**good, "confidence": "high"}) + " ok",
        json.dumps(good),
        json.dumps({k: v for k, v in good.items() if k != "use_cases"}),
        "[1]",
        "nothing",
        None,
    ]
    df = spark.createDataFrame(list(enumerate(raws)), "slide_id bigint, raw string")
    got = {r.slide_id: r for r in normalize_analyses(df).collect()}
    assert [got[i].status for i in range(8)] == ["success"] * 4 + ["failed"] * 4
    assert [got[i].analysis.confidence for i in range(4)] == [0.7, 0.25, 0.5, None]
    a = got[0].analysis
    assert (a.topics, a.page_purpose, a.content_types, a.visual_styles, a.use_cases, a.key_entities) == (["a", "b"], ["p"], [], [], [], [])


def test_status_groups(spark):
    rows = ["READY", "PARSED", "FAILED", "ENRICHED", None]
    assert values(spark, rows, scalar.status_group(F.col("x"))) == ["ready", "processing", "failed", "other", "other"]


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([3.0, 4.0], [3.0, 4.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    got = [r[0] for r in df.select(F.round(scalar.cosine_distance(F.col("a"), F.col("b")), 9)).collect()]
    assert got == [1.0, 0.0, None]
