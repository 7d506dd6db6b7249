"""Presentation packages as tables: parts, facts found in their XML, and pages.

Python opens the archive and lists what each XML part states; order, titles, tables, pictures,
notes and relationships are put together by Spark.
"""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Callable, Iterable, Iterator
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.functions.scalar import relation_name
from pagelake.functions.text import fingerprint
from pagelake.session import stored

DRAWING = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
LINKS = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
DECK = "{http://schemas.openxmlformats.org/presentationml/2006/main}"

_PARTS = "file_id bigint, part string, bytes bigint, xml binary, damaged boolean"
_BROKEN = (zipfile.BadZipFile, zlib.error, OSError, EOFError, RuntimeError, NotImplementedError)
_FACTS = (
    "file_id bigint, part string, xml_ok boolean, "
    "facts array<struct<kind:string,n:int,m:int,name:string,text:string,target:string,mode:string,place:array<bigint>>>"
)


_PARTS_TYPE = pa.schema([("file_id", pa.int64()), ("part", pa.string()), ("bytes", pa.int64()), ("xml", pa.binary()), ("damaged", pa.bool_())])
_FACT_TYPE = pa.struct([
    ("kind", pa.string()), ("n", pa.int32()), ("m", pa.int32()), ("name", pa.string()), ("text", pa.string()), ("target", pa.string()),
    ("mode", pa.string()), ("place", pa.list_(pa.int64())),
])
_FACTS_TYPE = pa.schema([("file_id", pa.int64()), ("part", pa.string()), ("xml_ok", pa.bool_()), ("facts", pa.list_(_FACT_TYPE))])
#: Rows of a batch that leaves a task, and its size: bytes of XML, or statements.
BATCH_ROWS = 4096
BATCH_BYTES = 1 << 22
BATCH_FACTS = 1 << 14


def _cells(batch: pa.RecordBatch, *columns: int) -> Iterator[tuple]:
    """The batch's rows one by one, so that no second copy of it is held."""
    return zip(*((value.as_py() for value in batch.column(c)) for c in columns))


def _packed(rows: Iterable[tuple], schema: pa.Schema, size: Callable[[tuple], int], limit: int) -> Iterator[pa.RecordBatch]:
    """Rows as batches of at most ``BATCH_ROWS`` rows that end with the row that reaches ``limit``."""
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += size(row)
        if len(held) == BATCH_ROWS or total >= limit:
            yield _batch(held, schema)
            held, total = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([_column(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _column(cells: tuple, kind: pa.DataType) -> pa.Array:
    """An Arrow column; lists of structs come as lists of tuples, which go field by field."""
    if not (pa.types.is_list(kind) and pa.types.is_struct(kind.value_type)):
        return pa.array(cells, kind)
    entries, fields = [e for cell in cells for e in cell], list(kind.value_type)
    columns = zip(*entries) if entries else [()] * len(fields)
    offsets = np.concatenate([[0], np.cumsum([len(cell) for cell in cells])]).astype(np.int32)
    structs = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields)], fields=fields)
    return pa.ListArray.from_arrays(pa.array(offsets), structs, type=kind)


def _parts_of(content: bytes) -> Iterator[tuple[str | None, int | None, bytes | None, bool]]:
    """(part, size, XML bytes, whether it is damaged); an archive that cannot be opened, or has no presentation part,
    has a damaged part without a name."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
    except (*_BROKEN, TypeError):
        yield None, None, None, True
        return
    with archive:
        if "ppt/presentation.xml" not in archive.namelist():
            yield None, None, None, True
        for info in archive.infolist():
            if not info.filename.endswith((".xml", ".rels")):
                yield info.filename, info.file_size, None, False
                continue
            try:
                yield info.filename, info.file_size, archive.read(info), False
            except _BROKEN:
                yield info.filename, info.file_size, None, True


def package_parts(files: DataFrame) -> DataFrame:
    """(file_id, part, bytes, xml, damaged) of all parts. XML stays bytes: its own declaration names the encoding.

    Parts of many archives leave a task together, in batches bounded by rows and by bytes of XML.
    """

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = ((file_id, *part) for file_id, content in _cells(batch, 0, 1) for part in _parts_of(content))
            yield from _packed(rows, _PARTS_TYPE, lambda row: len(row[3] or b""), BATCH_BYTES)

    return files.select(F.col("file_id").cast("bigint"), F.col("content").cast("binary")).mapInArrow(unpack, _PARTS)


def _text(el) -> str:
    return "".join(t.text for t in el.iter(f"{DRAWING}t") if t.text)


def _fact(kind, n=None, m=None, name=None, text=None, target=None, mode=None, place=None) -> tuple:
    return kind, n, m, name, text, target, mode, place


def _whole(value: str) -> int | None:
    """A coordinate, without its fraction; None where it is no number."""
    try:
        return int(float(value))
    except (ValueError, OverflowError):
        return None


def _place(pic) -> list | None:
    off, ext = pic.find(f".//{DRAWING}off"), pic.find(f".//{DRAWING}ext")
    if off is None and ext is None:
        return None
    read = lambda el, keys: [None, None] if el is None else [_whole(el.get(k, "0")) for k in keys]
    return read(off, ("x", "y")) + read(ext, ("cx", "cy"))


def _facts(root) -> Iterator[tuple]:
    """What one XML part states, in document order."""
    found: dict[str, list] = {}
    for el in root.iter():
        found.setdefault(el.tag, []).append(el)
    every = lambda tag: enumerate(found.get(tag, ()))
    for n, el in every(f"{DRAWING}p"):
        yield _fact("para", n, text=_text(el).strip())
    titles = [(n, el) for n, el in every(f"{DECK}ph") if el.get("type", "body") in ("title", "ctrTitle")]
    parent = {child: el for el in root.iter() for child in el} if titles else {}
    for n, el in titles:
        near = parent.get(el)
        above = parent.get(near)
        holder = above if above is not None and above.tag == f"{DECK}sp" else near
        yield _fact("title", n, text=_text(holder).strip() if holder is not None else "")
    for n, el in every(f"{DECK}sp"):
        ph = el.find(f".//{DECK}ph") if f"{DECK}ph" in found else None
        kind = "textbox" if ph is None else "placeholder:" + ph.get("type", "body")
        yield _fact("shape", n, name=kind, text=_text(el).strip())
    for n, table in every(f"{DRAWING}tbl"):
        for m, row in enumerate(table.iter(f"{DRAWING}tr")):
            for cell in row.iter(f"{DRAWING}tc"):
                yield _fact("cell", n, m, text=_text(cell).strip())
    for n, el in every(f"{DECK}pic"):
        blip = el.find(f".//{DRAWING}blip")
        rid = None if blip is None else blip.get(f"{LINKS}embed") or blip.get(f"{LINKS}link")
        if rid:
            yield _fact("picture", n, name=rid, place=_place(el))
    for n, el in every(f"{DECK}sldId"):
        if el.get(f"{LINKS}id"):
            yield _fact("slide", n, name=el.get(f"{LINKS}id"))
    for n, el in enumerate(root):
        local = el.tag.rsplit("}", 1)[-1]
        if local == "Relationship":
            yield _fact("rel", n, name=el.get("Id", ""), text=el.get("Type", ""), target=el.get("Target", ""), mode=el.get("TargetMode", "Internal"))
        elif local == "Override":
            yield _fact("override", n, target=el.get("PartName", "").lstrip("/"))


def part_facts(parts: DataFrame) -> DataFrame:
    """(file_id, part, xml_ok, facts): the statements of every XML part. Unreadable and damaged parts state
    nothing and are not ok; so is an archive that could not be opened, whose part is null."""

    def statements(xml: bytes | None) -> tuple[bool, list]:
        if xml is not None:
            try:
                return True, list(_facts(ElementTree.fromstring(xml)))
            except (ElementTree.ParseError, ValueError, LookupError):  # not well-formed, or of an unknown encoding
                pass
        return False, []

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = ((file_id, part, *statements(xml)) for file_id, part, xml in _cells(batch, 0, 1, 2))
            yield from _packed(rows, _FACTS_TYPE, lambda row: len(row[3]), BATCH_FACTS)

    xml = parts.filter(F.col("xml").isNotNull() | F.col("damaged"))
    return xml.select(F.col("file_id").cast("bigint"), "part", "xml").mapInArrow(read, _FACTS)


def _of_kind(kind: str):
    return F.filter("facts", lambda f: f["kind"] == kind)


def _source_part(rels):
    """Part a relationship file belongs to."""
    return F.regexp_replace(F.regexp_replace(rels, r"(^|/)_rels/", "$1"), r"\.rels$", "")


def part_relationships(facts: DataFrame) -> DataFrame:
    """(file_id, part, n, rel_id, rel_type, target, target_mode) with ``part`` the relationship's source."""
    rels = facts.filter(F.col("part").endswith(".rels"))
    return rels.select("file_id", _source_part(F.col("part")).alias("part"), F.explode_outer(_of_kind("rel")).alias("r")).filter(F.col("r").isNotNull()).select(
        "file_id", "part", F.col("r.n").alias("n"), F.col("r.name").alias("rel_id"),
        relation_name(F.col("r.text")).alias("rel_type"), F.col("r.target").alias("target"), F.col("r.mode").alias("target_mode"),
    )


def slide_order(facts: DataFrame, rels: DataFrame) -> DataFrame:
    """(file_id, page_no, part): pages in the order the presentation lists them."""
    listed = facts.filter(F.col("part") == "ppt/presentation.xml").select("file_id", F.posexplode_outer(_of_kind("slide")).alias("i", "s")).filter(F.col("i").isNotNull())
    # Of a repeated relationship id the last one counts, so no page is listed twice by it.
    deck = rels.filter(F.col("part") == "ppt/presentation.xml").groupBy("file_id", "rel_id").agg(F.max_by("target", "n").alias("target"))
    ids = listed.select("file_id", (F.col("i") + 1).alias("page_no"), F.col("s.name").alias("rel_id"))
    target = F.coalesce("target", F.lit(""))
    part = F.when(target.startswith("ppt/"), target).otherwise(F.concat(F.lit("ppt/"), target))
    return ids.join(deck, ["file_id", "rel_id"], "left").select("file_id", "page_no", part.alias("part"))


def declared_parts(facts: DataFrame) -> DataFrame:
    types = facts.filter(F.col("part") == "[Content_Types].xml")
    return types.select("file_id", F.explode_outer(_of_kind("override")).alias("o")).select("file_id", F.col("o.target").alias("part")).filter("part <> ''")


def _texts(kind: str):
    return F.filter(F.transform(_of_kind(kind), lambda f: f["text"]), lambda t: t != "")


def _tables():
    """Cells to array<struct<rows:array<array<string>>>>, rows and tables in order."""
    cells = _of_kind("cell")
    numbers = F.array_distinct(F.transform(cells, lambda f: f["n"]))

    def table(n):
        own = F.filter("_cells", lambda f: f["n"] == n)
        rows = F.array_distinct(F.transform(own, lambda f: f["m"]))
        texts = lambda m: F.transform(F.filter(own, lambda f: f["m"] == m), lambda f: f["text"])
        return F.struct(F.transform(rows, texts).alias("rows"))

    return cells, F.transform(numbers, table)


def parse_packages(files: DataFrame) -> DataFrame:
    """One row per page: file_id, page_no, title, native_text, notes_text, fingerprint, content, part, parse_status.

    ``files``: file_id, content. A listed page whose part is absent comes out empty. parse_status is
    failed for a page whose part is damaged or no XML; a file that lists no page, for whatever reason, gives one failed row
    without a page. Archives are opened once; what they state is kept in the
    shared folder for the joins that follow.
    """
    facts = stored(part_facts(package_parts(files)), "part-facts")
    rels = part_relationships(facts)
    order = slide_order(facts, rels)
    own_rels = rels.groupBy("file_id", "part").agg(
        F.sort_array(F.collect_list(F.struct("n", F.col("rel_id").alias("id"), F.col("rel_type").alias("type"), "target", "target_mode"))).alias("_rels")
    )
    notes_target = F.try_element_at(F.filter("_rels", lambda r: r["type"] == "notesSlide"), F.lit(1))["target"]
    notes_part = F.regexp_replace(F.concat(F.lit("ppt/"), F.replace(notes_target, F.lit("../"), F.lit(""))), "ppt/ppt/", "ppt/")
    notes = facts.filter(F.col("part").startswith("ppt/notesSlides/")).select(
        "file_id", F.col("part").alias("_notes_part"), F.array_join(_texts("para"), "\n").alias("_notes")
    )
    cells, tables = _tables()
    title = F.coalesce(F.try_element_at(_texts("title"), F.lit(1)), F.try_element_at(_texts("para"), F.lit(1)))
    target_of = lambda rid: F.try_element_at(F.filter("_rels", lambda r: (r["id"] == rid) & (r["target"] != "")), F.lit(-1))["target"]
    spot = lambda f: F.when(
        f["place"].isNotNull(),
        F.struct(*[f["place"][i].alias(k) for i, k in enumerate(("x", "y", "cx", "cy"))]),
    )
    pages = (
        order.join(facts.select("file_id", "part", "facts", "xml_ok"), ["file_id", "part"], "left")
        .join(own_rels, ["file_id", "part"], "left")
        .withColumn("_notes_part", notes_part)
        .join(notes, ["file_id", "_notes_part"], "left")
        .withColumn("_cells", cells)
        .withColumn("native_text", F.coalesce(F.array_join(_texts("para"), "\n"), F.lit("")))
    )
    content = F.struct(
        F.transform(_of_kind("shape"), lambda f: F.struct(f["name"].alias("type"), f["text"].alias("text"))).alias("shapes"),
        tables.alias("tables"),
        F.transform(
            _of_kind("picture"),
            lambda f: F.struct(f["name"].alias("rid"), target_of(f["name"]).alias("target"), spot(f).alias("position")),
        ).alias("pictures"),
        F.transform(
            F.col("_rels"),
            lambda r: F.struct(r["id"].alias("id"), r["type"].alias("type"), r["target"].alias("target"), r["target_mode"].alias("target_mode")),
        ).alias("relationships"),
    )
    parsed = pages.select(
        "file_id", "page_no", "part", title.alias("title"), "native_text",
        F.coalesce("_notes", F.lit("")).alias("notes_text"),
        fingerprint(F.col("native_text")).alias("fingerprint"),
        content.alias("content"),
        F.when(F.coalesce("xml_ok", F.lit(True)), "success").otherwise("failed").alias("parse_status"),
    )
    # every archive states something, if only that it has no presentation part
    lost = facts.select("file_id").distinct().join(order.select("file_id"), "file_id", "left_anti")
    failed = lost.select(
        *[F.col("file_id") if f.name == "file_id" else F.lit("failed").alias(f.name) if f.name == "parse_status" else F.lit(None).cast(f.dataType).alias(f.name) for f in parsed.schema.fields]
    )
    return parsed.unionByName(failed)

