"""Source files: scan, format, validation, placeholder pages."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.constants import MAX_ZIP_RATIO, MIN_PPT_BYTES, OLE2_MAGIC, PDF_MAGIC, PPTX_MAGIC

KEY_LAYOUT = r"presentations/([^/]+)/versions/([^/]+)/source\.([A-Za-z0-9]+)$"


def scan_files(spark: SparkSession, root: str) -> DataFrame:
    """Source files below ``root`` laid out as presentations/{id}/versions/{id}/source.{ext}."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "source.*").load(root)
    return raw.select(
        F.regexp_extract("path", KEY_LAYOUT, 1).alias("presentation_id"),
        F.regexp_extract("path", KEY_LAYOUT, 2).alias("version_id"),
        F.regexp_extract("path", KEY_LAYOUT, 3).alias("extension"),
        "path",
        "length",
        "modificationTime",
        "content",
    )


def source_key(presentation_id: Column, version_id: Column, ext: Column) -> Column:
    clean = F.coalesce(F.nullif(F.regexp_replace(ext, r"^\.+", ""), F.lit("")), F.lit("pptx"))
    return F.concat(F.lit("presentations/"), presentation_id, F.lit("/versions/"), version_id, F.lit("/source."), clean)


def _starts(content: Column, magic: str) -> Column:
    return F.hex(F.substring(content, 1, len(magic) // 2)) == magic


def detect_format(content: Column) -> Column:
    """'pdf', 'ppt' or 'pptx' by leading bytes, else null."""
    return F.when(_starts(content, PDF_MAGIC), "pdf").when(_starts(content, OLE2_MAGIC), "ppt").when(_starts(content, PPTX_MAGIC), "pptx")


def _zip_error(content: bytes, max_ratio: float) -> str | None:
    """First failing archive rule of one file."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
        infos = archive.infolist()
        if any(i.flag_bits & 0x1 for i in infos):
            return "ENCRYPTED_FILE"
        if archive.testzip() is not None:
            return "CORRUPT_ZIP"
    except (zipfile.BadZipFile, zlib.error, OSError, EOFError, ValueError, NotImplementedError, RuntimeError):
        return "CORRUPT_ZIP"
    if sum(i.file_size for i in infos) > max_ratio * len(content):
        return "ZIP_BOMB"
    if not {"ppt/presentation.xml", "[Content_Types].xml"} <= set(archive.namelist()):
        return "NOT_PPTX"
    return None


def _zip_errors(files: DataFrame, max_ratio: float) -> DataFrame:
    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"file_id": pdf["file_id"], "zip_error": [_zip_error(c, max_ratio) for c in pdf["content"]]})

    return files.select("file_id", "content").mapInPandas(check, "file_id bigint, zip_error string")


def validate_files(
    files: DataFrame, extensions: tuple[str, ...] = (".pptx",), max_bytes: int = 200 << 20, max_ratio: float = MAX_ZIP_RATIO
) -> DataFrame:
    """(file_id, filename, format, error): the first rule each file breaks, null when it is fine.

    ``files``: file_id, filename, content. Only files that pass the column rules and look like an
    archive are opened; members are checked as a stream, never held unpacked.
    """
    size = F.length("content")
    named = F.lit(False)
    for ext in extensions:
        named = named | F.lower(F.col("filename")).endswith(ext)
    fmt = detect_format(F.col("content"))
    tail = F.decode(F.substring(F.col("content"), F.greatest(size - 1023, F.lit(1)), F.lit(1024)), "ISO-8859-1")
    rule = (
        F.when(~named, "UNSUPPORTED_EXTENSION")
        .when(size > max_bytes, "FILE_TOO_LARGE")
        .when(size == 0, "INVALID_ZIP")
        .when(fmt.isNull(), "UNSUPPORTED_FORMAT")
        .when((fmt == "pdf") & ~F.contains(tail, F.lit("%EOF")), "INVALID_PDF")
        .when((fmt == "ppt") & (size < MIN_PPT_BYTES), "INVALID_PPT")
    )
    checked = files.select("file_id", "filename", fmt.alias("format"), rule.alias("rule"))
    archives = files.filter(rule.isNull() & (fmt == "pptx"))
    return checked.join(_zip_errors(archives, max_ratio), "file_id", "left").select(
        "file_id", "filename", "format", F.coalesce("rule", "zip_error").alias("error")
    )


def split_valid(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantine)."""
    return validated.filter(F.col("error").isNull()), validated.filter(F.col("error").isNotNull())


def placeholder_slides(versions: DataFrame, slides: DataFrame) -> DataFrame:
    """One empty page per rendered page of versions (version_id, page_count) without pages of their own."""
    bare = versions.filter(F.col("page_count") > 0).join(slides.select("version_id"), "version_id", "left_anti")
    return bare.select(
        "version_id",
        F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("page_count").cast("bigint"))).alias("page_no"),
        F.lit(None).cast("string").alias("native_text"),
        F.lit(None).cast("string").alias("fingerprint"),
        F.lit("render_only").alias("parse_status"),
    )
