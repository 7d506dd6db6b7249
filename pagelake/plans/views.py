"""The engine's tables as views over the driver's Parquet tables (see FIXTURES.md).

Pages are plain projections of ``documents``: no join, window or shuffle touches their text.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from functools import cached_property, lru_cache
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.functions.text import first_line, fingerprint
from pagelake.operators import search_index
from pagelake.operators.dedup import signature64
from pagelake.operators.fusion import Corpus
from pagelake.operators.indexing import ai_tag_text, extract_elements, index_text, token_index
from pagelake.operators.library import PageDirectory, page_directory
from pagelake.operators.scope import scoped_slides, scoped_versions
from pagelake.operators.search_index import SearchIndex
from pagelake.session import scratch_path, stored
from pagelake.sources.tables import spread

MOVED = 1_000_000_000_000
LINES_PER_PAGE = 8
#: Packages that leave a task together.
PACKAGES_HELD = 256
SOURCES = 20
_KEPT: dict[tuple[str, str, str], str] = {}


def minute(n):
    """The n-th minute of 2024, UTC."""
    return F.timestamp_seconds(F.lit(1704067200) + n.cast("bigint") * 60)


class Views:
    """Lazy views over one folder of driver tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def documents(self) -> DataFrame:
        return spread(self.table("documents"), "doc_id").withColumn("pid", F.expr("cast(substring(source, 4) as int)"))

    # --- pages ------------------------------------------------------------------------------

    def document_pages(self, documents: DataFrame) -> DataFrame:
        """The current page of every document and the old page of most: one scan gives both."""
        doc = F.col("doc_id")
        sides = F.when(doc % 7 == 0, F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))
        df = documents.withColumn("old", F.explode(sides))
        old = F.col("old") == 1
        moved = F.when(old & (doc % 11 == 2), F.lit(MOVED)).otherwise(F.lit(0))
        text = F.when(old & (doc % 9 == 1), F.concat("text", F.lit(" rev"))).otherwise(F.col("text"))
        return df.select(
            F.when(old, -(doc * 2 + 1)).otherwise(doc).alias("slide_id"),
            (F.col("pid") * 2 + 2 - F.col("old")).alias("version_id"),
            (doc + 1 + moved).alias("page_no"),
            doc.alias("doc_id"),
            text.alias("native_text"),
        )

    @cached_property
    def raw_slides(self) -> DataFrame:
        """Every page as it came: keys and text."""
        bench = self.table("benchmark")
        item = F.col("item_id")
        extra = bench.select(
            (-(item * 2 + 2)).alias("slide_id"),
            ((item % SOURCES) * 2 + 1).cast("int").alias("version_id"),
            (item + 2 * MOVED).alias("page_no"),
            item.alias("doc_id"),
            F.col("text").alias("native_text"),
        )
        return self.document_pages(self.documents).unionByName(extra)

    @cached_property
    def slides(self) -> DataFrame:
        return self.finished(self.raw_slides)

    def finished(self, pages: DataFrame, *kept: str) -> DataFrame:
        """Pages with all that follows from their texts, and the columns ``kept``."""
        text = F.col("native_text")
        lines = F.split(text, "\n")
        is_row = lambda line: F.contains(line, F.lit(" | "))
        rows = F.transform(F.filter(lines, is_row), lambda line: F.split(line, r" \| "))
        shapes = F.transform(
            F.filter(lines, lambda line: ~is_row(line)), lambda line: F.struct(F.lit("textbox").alias("type"), line.alias("text"))
        )
        tables = F.when(F.size(rows) > 0, F.array(F.struct(rows.alias("rows")))).otherwise(F.array())
        no_place = F.lit(None).cast("struct<x:bigint,y:bigint,cx:bigint,cy:bigint>")
        picture = F.struct(
            F.lit("rId9").alias("rid"),
            F.concat(F.lit("../media/image"), F.col("doc_id").cast("string"), F.lit(".png")).alias("target"),
            no_place.alias("position"),
        )
        pictures = F.when(F.col("doc_id") % 13 == 0, F.array(picture)).otherwise(F.array())
        return pages.select(
            "slide_id",
            "version_id",
            "page_no",
            first_line(text).alias("title"),
            "native_text",
            F.lit(None).cast("string").alias("notes_text"),
            F.lit(None).cast("string").alias("ai_summary"),
            F.lit(None).cast("string").alias("mineru_markdown"),
            F.struct(shapes.alias("shapes"), tables.alias("tables"), pictures.alias("pictures")).alias("content"),
            minute(F.col("doc_id")).alias("created_at"),
            fingerprint(text).alias("fingerprint"),
            *kept,
        )

    @cached_property
    def page_keys(self) -> DataFrame:
        """Stored key columns of all pages, as an ingest leaves them."""
        return stored(self.slides.select("slide_id", "version_id", "page_no", "fingerprint"), "page-keys")

    @cached_property
    def directory(self) -> PageDirectory:
        """The page directory as an ingest leaves it."""
        return page_directory(self.slides.select("slide_id", "version_id", "page_no"))

    @cached_property
    def signed_slides(self) -> DataFrame:
        """Stored key columns and signatures of all pages."""
        sigs = signature64(self.slides).select("slide_id", "sig")
        return stored(self.page_keys.join(sigs, "slide_id", "left"), "page-signatures")

    @cached_property
    def elements(self) -> DataFrame:
        return extract_elements(self.slides)

    # --- files ------------------------------------------------------------------------------

    @cached_property
    def presentations(self) -> DataFrame:
        per = self.documents.groupBy("pid").agg(F.count(F.lit(1)).alias("page_count"))
        pid = F.col("pid")
        return per.select(
            pid.alias("presentation_id"),
            F.concat(F.lit("deck "), pid.cast("string")).alias("title"),
            (pid % 3).cast("bigint").alias("owner_id"),
            F.when(pid % 4 == 3, "private").otherwise("team").alias("visibility"),
            F.when(pid % 10 == 9, F.lit("2024-02-01").cast("timestamp")).alias("deleted_at"),
            (pid * 2 + 2).alias("current_version_id"),
            F.when(pid % 3 < 2, pid % 3).alias("folder_id"),
            "page_count",
            minute(pid % 5 * 60).alias("created_at"),
        )

    @cached_property
    def versions(self) -> DataFrame:
        """Page counts and a content digest per version; the digest is a mergeable aggregate."""
        mixed = F.conv(F.substring("fingerprint", 1, 8), 16, 10).cast("bigint") * 65536 + F.col("page_no") % 65536
        per = self.slides.groupBy("version_id").agg(
            F.count(F.lit(1)).alias("page_count"), F.bit_xor(mixed).alias("digest"), F.max("created_at").alias("created_at")
        )
        v = F.col("version_id")
        return per.select(
            v,
            F.floor((v - 1) / 2).cast("int").alias("presentation_id"),
            F.when(v % 2 == 1, 1).otherwise(2).alias("version_no"),
            F.sha2(F.concat_ws(":", v.cast("string"), F.col("page_count").cast("string"), F.col("digest").cast("string")), 256).alias("sha256"),
            "page_count",
            F.element_at(F.array(*[F.lit(s) for s in STATUSES]), (v % len(STATUSES)) + 1).alias("status"),
            F.concat(F.lit("deck_"), v.cast("string"), F.lit(".pptx")).alias("original_filename"),
            "created_at",
        )

    @cached_property
    def files(self) -> DataFrame:
        """One upload per document."""
        return self.documents.select(
            F.col("doc_id").alias("file_id"),
            F.concat_ws("/", F.col("source"), F.concat(F.col("doc_id").cast("string"), F.lit(".pptx"))).alias("path"),
            F.sha2("text", 256).alias("sha256"),
            F.col("pid").alias("presentation_id"),
            minute(F.col("doc_id")).alias("arrived_at"),
        )

    # --- dimensions and bridges -------------------------------------------------------------

    @cached_property
    def users(self) -> DataFrame:
        uid = F.col("user_id")
        return self.presentations.select(F.col("owner_id").alias("user_id")).distinct().select(
            uid, F.concat(F.lit("user"), uid.cast("string")).alias("username"),
            F.when(uid < 2, F.concat(F.lit("User "), uid.cast("string"))).alias("display_name"),
        )

    @cached_property
    def folders(self) -> DataFrame:
        fid = F.col("folder_id")
        return self.presentations.select("folder_id").filter(fid.isNotNull()).distinct().select(
            fid, F.concat(F.lit("folder "), fid.cast("string")).alias("name")
        )

    @cached_property
    def tags(self) -> DataFrame:
        fixed = self.slide_tags.select("tag_id").distinct()
        name = F.substring_index("tag_id", "-", -1)
        return fixed.select(
            "tag_id", name.alias("name"),
            F.when(name.isin("quality", "toxic"), "review").otherwise("language").alias("category"),
            F.when(name == "quality", "manual").otherwise("ai").alias("source"), F.lit("active").alias("status"),
        )

    @cached_property
    def slide_tags(self) -> DataFrame:
        labels = self.table("labels")
        def row(df, tag, origin, confidence, confirmed):
            return df.select(
                F.col("doc_id").alias("slide_id"), tag.alias("tag_id"), F.lit(origin).alias("origin"),
                F.lit(confidence).cast("double").alias("confidence"), F.lit(confirmed).alias("is_confirmed"),
            )
        return (
            row(labels.filter("quality = 1"), F.lit("tag-quality"), "manual", None, True)
            .unionByName(row(labels.filter("toxic = 1"), F.lit("tag-toxic"), "ai", 0.8, False))
            .unionByName(row(self.documents, F.concat(F.lit("tag-"), F.col("lang")), "ai", 0.9, False))
        )

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events").withColumn("ts", F.col("ts").cast("timestamp"))

    @cached_property
    def favorites(self) -> DataFrame:
        clicks = self.events.filter(F.col("event_type") == "click")
        n_docs = self.documents.agg(F.count(F.lit(1))).scalar()
        return clicks.withColumn("slide_id", F.col("event_id") % n_docs).groupBy("user_id", "slide_id").agg(F.min("ts").alias("created_at"))

    def as_jobs(self, events: DataFrame) -> DataFrame:
        kind = F.col("event_type")
        status = (
            F.when(kind == "error", "failed").when(kind == "purchase", "success").when(kind == "view", "running").otherwise("pending")
        )
        return events.select(
            F.col("event_id").alias("job_id"),
            F.when(kind == "signup", "analyze_visual").otherwise("parse_openxml").alias("job_type"),
            F.when(kind == "signup", "slide").otherwise("version").alias("target_type"),
            F.when(kind == "signup", F.col("user_id")).otherwise(F.col("user_id") % 40 + 1).alias("target_id"),
            status.alias("status"),
            F.get_json_object("props", "$.k").cast("int").alias("progress"),
            F.when(kind == "view", "PARSING").alias("stage"),
            F.when(kind == "error", "PARSE_ERROR").alias("error_code"),
            F.col("ts").alias("created_at"),
            F.col("ts").alias("started_at"),
            F.timestamp_micros(F.unix_micros("ts") + F.round(F.col("value") * 1000).cast("bigint") * 1000).alias("finished_at"),
        )

    @cached_property
    def jobs(self) -> DataFrame:
        return self.as_jobs(self.events)

    # --- vectors ----------------------------------------------------------------------------

    @cached_property
    def slide_embeddings(self) -> DataFrame:
        return self._versioned(self.table("embeddings").select(
            F.col("vec_id").alias("slide_id"), F.lit("m1").alias("model"), F.lit("success").alias("status"), "embedding", "label"
        ))

    def _versioned(self, vectors: DataFrame) -> DataFrame:
        """Vectors with the version of their page, as a vector table keeps it; null for pages that are not there."""
        current = self.documents.select(F.col("doc_id").alias("slide_id"), (2 * F.col("pid") + 2).cast("int").alias("version_id"))
        return vectors.join(current, "slide_id", "left")

    @cached_property
    def element_embeddings(self) -> DataFrame:
        vec = F.col("vec_id")
        return self._versioned(self.table("embeddings").select((vec % 100).alias("slide_id"), F.floor(vec / 100).cast("int").alias("element_index"), "embedding"))

    # --- searches ---------------------------------------------------------------------------

    @cached_property
    def queries(self) -> DataFrame:
        """Every benchmark passage as it stands, with the vector of the same number, and its longest word (negative id)."""
        words = F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
        longest = F.array_max(F.transform(words, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
        vectors = self.table("embeddings").select(F.col("vec_id").alias("query_id"), "embedding", "label")
        passages = self.table("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
        single = self.table("benchmark").select((-F.col("item_id") - 1).alias("query_id"), F.coalesce(longest, F.lit("")).alias("query"))
        return passages.unionByName(single).join(vectors, "query_id", "left")

    def scoped(self, user_id=None, superuser=False, include_historical=False) -> DataFrame:
        """Pages in scope; what follows from a page's text is worked out behind the scope, for its pages only."""
        scoped = scoped_slides(self.raw_slides, self.presentations, self.versions, user_id, superuser, include_historical)
        return self.finished(scoped, "presentation_id", "presentation_title")

    def page_index(self, user_id=None, superuser=False, include_historical=False) -> DataFrame:
        """Token index of the pages in scope; what a deployment would keep as a table."""
        pages = self.scoped(user_id, superuser, include_historical)
        return token_index(index_text(pages, ai_tag_text(self.slide_tags, self.tags)))

    def scope(self, user_id=None, superuser=False, include_historical=False) -> DataFrame:
        return scoped_versions(self.presentations, self.versions, user_id, superuser, include_historical)

    def _kept(self, name: str) -> str:
        """A folder that all searches of one session over one corpus share, as a deployment keeps its indexes."""
        key = self.spark.sparkContext.applicationId, self.sf_dir, name
        if key not in _KEPT:
            _KEPT[key] = scratch_path(self.spark, name)
        return _KEPT[key]

    @cached_property
    def page_rows(self) -> DataFrame:
        """Pages of all versions without their texts."""
        pages = self.scoped(superuser=True, include_historical=True)
        return pages.select("slide_id", "version_id", "page_no", "title", "created_at")

    @cached_property
    def page_search(self) -> SearchIndex:
        """One index over the pages of all versions; a search brings its scope."""
        path, keys = self._kept("page-search"), ("slide_id",)
        if search_index.exists(self.spark, path):
            return search_index.read_index(self.spark, path, keys)
        index = self.page_index(superuser=True, include_historical=True).select("slide_id", "version_id", "tokens", "n_tokens")
        return search_index.build_index(index, path, keys)

    @cached_property
    def element_search(self) -> SearchIndex:
        path, keys = self._kept("element-search"), ("slide_id", "element_index")
        if search_index.exists(self.spark, path):
            return search_index.read_index(self.spark, path, keys)
        elements = extract_elements(self.scoped(superuser=True, include_historical=True))
        return search_index.build_index(token_index(elements, "text").select("slide_id", "element_index", "version_id", "tokens", "n_tokens"), path, keys)

    def corpus(self) -> Corpus:
        return Corpus(
            self.page_rows, self.element_search, self.slide_embeddings, self.element_embeddings,
            self.presentations, self.versions, self.slide_tags, self.favorites, self.page_search,
        )

    # --- packages ---------------------------------------------------------------------------

    @cached_property
    def packages(self) -> DataFrame:
        """(file_id, content): every document written out as a small presentation package."""

        schema = pa.schema([("file_id", pa.int64()), ("content", pa.binary())])

        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for first in range(0, batch.num_rows, PACKAGES_HELD):
                    some = batch.slice(first, PACKAGES_HELD)
                    ids, texts = (some.column(c).to_pylist() for c in (0, 1))
                    contents = [package_bytes(t, d) for d, t in zip(ids, texts)]
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(contents, pa.binary())], schema=schema)

        return self.documents.select("doc_id", "text").mapInArrow(write, "file_id bigint, content binary")


STATUSES = ("UPLOADING", "PARSING", "PARSED", "RENDERING", "BASIC_READY", "ENRICHED", "READY", "PARTIAL_FAILED")

_NS = (
    'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" '
    'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" '
    'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'
)
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/"


def _para(text: str) -> str:
    return f"<a:p><a:r><a:t>{escape(text)}</a:t></a:r></a:p>"


def _rels(rows: list[tuple[str, str, str]], external: str | None = None) -> str:
    body = "".join(f'<Relationship Id="{i}" Type="{_REL}{t}" Target={quoteattr(g)}/>' for i, t, g in rows)
    if external:
        body += f'<Relationship Id="rIdX" Type="{_REL}hyperlink" Target={quoteattr(external)} TargetMode="External"/>'
    return f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{body}</Relationships>'


def page_xml(lines: list[str], picture: bool = False) -> str:
    """One page: a shape per plain line, one table for the lines that hold cells."""
    plain = [s for s in lines if " | " not in s]
    rows = [s.split(" | ") for s in lines if " | " in s]
    shapes = "".join(f"<p:sp><p:nvSpPr><p:nvPr/></p:nvSpPr><p:txBody>{_para(s)}</p:txBody></p:sp>" for s in plain)
    cells = "".join(
        "<a:tr>" + "".join(f"<a:tc><a:txBody>{_para(c)}</a:txBody></a:tc>" for c in row) + "</a:tr>" for row in rows
    )
    table = f"<p:graphicFrame><a:tbl>{cells}</a:tbl></p:graphicFrame>" if rows else ""
    pic = '<p:pic><p:blipFill><a:blip r:embed="rId2"/></p:blipFill><p:spPr><a:off x="10" y="20"/><a:ext cx="30" cy="40"/></p:spPr></p:pic>'
    return f"<p:sld {_NS}><p:cSld><p:spTree>{shapes}{table}{pic if picture else ''}</p:spTree></p:cSld></p:sld>"


@lru_cache(256)
def _package_frame(pages: int) -> bytes:
    """A package with all parts that only follow from the number of its pages."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        ids = "".join(f'<p:sldId id="{256 + n}" r:id="rId{n}"/>' for n in range(1, pages + 1))
        overrides = "".join(f'<Override PartName="/ppt/slides/slide{n}.xml" ContentType="x"/>' for n in range(1, pages + 1))
        z.writestr("[Content_Types].xml", f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">{overrides}</Types>')
        z.writestr("_rels/.rels", _rels([("rId1", "officeDocument", "ppt/presentation.xml")]))
        z.writestr("ppt/presentation.xml", f"<p:presentation {_NS}><p:sldIdLst>{ids}</p:sldIdLst></p:presentation>")
        z.writestr("ppt/_rels/presentation.xml.rels", _rels([(f"rId{n}", "slide", f"slides/slide{n}.xml") for n in range(1, pages + 1)]))
        z.writestr("ppt/slideLayouts/slideLayout1.xml", f"<p:sldLayout {_NS}/>")
        z.writestr("ppt/slideLayouts/_rels/slideLayout1.xml.rels", _rels([("rId1", "slideMaster", "../slideMasters/slideMaster1.xml")]))
        z.writestr("ppt/slideMasters/slideMaster1.xml", f"<p:sldMaster {_NS}/>")
        z.writestr("ppt/slideMasters/_rels/slideMaster1.xml.rels", _rels([("rId1", "slideLayout", "../slideLayouts/slideLayout1.xml")]))
        for n in range(pages, 0, -1):
            rels = [("rId1", "slideLayout", "../slideLayouts/slideLayout1.xml")]
            if n == 1:
                rels += [("rId2", "image", "../media/image1.png"), ("rId3", "notesSlide", "../notesSlides/notesSlide1.xml")]
            z.writestr(f"ppt/slides/_rels/slide{n}.xml.rels", _rels(rels, "https://example.com/" if n == 1 else None))
        z.writestr("ppt/notesSlides/_rels/notesSlide1.xml.rels", _rels([("rId1", "slide", "../slides/slide1.xml")]))
    return out.getvalue()


def package_bytes(text: str, number: int) -> bytes:
    """A document as a package: pages of 8 lines, stored last page first, the first one with notes and a picture."""
    lines = text.split("\n")
    pages = [lines[i : i + LINES_PER_PAGE] for i in range(0, len(lines), LINES_PER_PAGE)]
    out = io.BytesIO(_package_frame(len(pages)))
    with zipfile.ZipFile(out, "a", zipfile.ZIP_DEFLATED) as z:
        for n in range(len(pages), 0, -1):
            z.writestr(f"ppt/slides/slide{n}.xml", page_xml(pages[n - 1], n == 1))
        z.writestr("ppt/media/image1.png", b"\x89PNG" + number.to_bytes(8, "big"))
        z.writestr("ppt/notesSlides/notesSlide1.xml", f"<p:notes {_NS}>{_para(f'note {number}')}</p:notes>")
    return out.getvalue()
