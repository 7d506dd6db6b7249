"""Text normalisation, tokens, titles, markdown and tolerant JSON."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelake.constants import ANALYSIS_LISTS, ANALYSIS_REQUIRED, DEFAULT_CONFIDENCE

# Whitespace as Unicode defines it, written so that Java and RE2 read it alike.
SPACES = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]+"

# Line breaks besides \n, and blanks that may stand before one.
LINE_BREAKS = r"\r\n|[\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
LINE_END_BLANKS = r"[\t \x1F\p{Zs}]+"

# The same set as characters, for trimming.
BLANKS = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(text: Column) -> Column:
    """Trim Unicode whitespace at both ends."""
    return F.btrim(text, F.lit(BLANKS))


def is_blank(text: Column) -> Column:
    return strip(F.coalesce(text, F.lit(""))) == ""


def squeeze(text: Column) -> Column:
    """Drop all whitespace and lower the rest: the form that fingerprints compare."""
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, ""))


def fingerprint(text: Column) -> Column:
    """SHA-256 of the squeezed text.

    Segmenting text that holds no spaces only inserts separators at places the text itself
    decides, so hashing the squeezed text splits pages into the same classes.
    """
    return F.sha2(squeeze(text), 256)


# One token of text without ideographs, and the characters that call for the full pattern.
WORD = r"[\p{L}\p{N}]+"
IDEOGRAPHIC = r"[\x{2E80}-\x{3FFFF}]"


def token_pattern(words: Iterable[str] = ()) -> str:
    """Regular expression for one token: a dictionary word, one ideograph, or a letter/digit run."""
    longest_first = sorted({w.lower() for w in words if re.search(r"[一-鿿]", w)}, key=lambda w: (-len(w), w))
    parts = [re.escape(w) for w in longest_first]
    return "|".join([*parts, r"\p{IsHan}", r"[[\p{L}\p{N}]&&[^\p{IsHan}]]+"])


_DEFAULT_PATTERN = token_pattern()


def tokens(text: Column, words: Iterable[str] | None = None) -> Column:
    """Lower-cased tokens in text order; the same rule and ``words`` (as ``read_dictionary`` loads them) serve pages and queries."""
    pattern = _DEFAULT_PATTERN if words is None else token_pattern(words)
    lowered = F.lower(F.coalesce(text, F.lit("")))
    found = lambda p: F.regexp_extract_all(lowered, F.lit(p), F.lit(0))
    return F.when(text.rlike(IDEOGRAPHIC), found(pattern)).otherwise(found(WORD))


def segmented(text: Column, words: Iterable[str] | None = None) -> Column:
    return F.array_join(tokens(text, words), " ")


def first_line(text: Column) -> Column:
    return F.split(text, "\n").getItem(0)


def title_from_path(path: Column) -> Column:
    """Last path segment without its last extension."""
    name = F.substring_index(path, "/", -1)
    return F.regexp_replace(name, r"\.[^.]*$", "")


def table_cells(tables: Column) -> Column:
    """All non-blank cells of array<struct<rows:array<array<string>>>>, trimmed, in reading order."""
    rows = F.flatten(F.transform(tables, lambda t: t["rows"]))
    trimmed = F.transform(F.flatten(rows), strip)
    return F.coalesce(F.filter(trimmed, lambda c: c.isNotNull() & (c != "")), F.array().cast("array<string>"))


def table_text(tables: Column) -> Column:
    return F.array_join(table_cells(tables), " ")


def joined_parts(*parts: Column) -> Column:
    """Non-empty parts, one per line."""
    return F.concat_ws("\n", *[F.nullif(p, F.lit("")) for p in parts])


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


# --- markdown -------------------------------------------------------------------------------


def strip_images(md: Column) -> Column:
    """Remove image links, squeeze blank runs, trim all Unicode blanks at line ends; every line break becomes a newline."""
    no_images = F.regexp_replace(md, r"!\[[^\]]*\]\([^)]*\)", "")
    squeezed = F.regexp_replace(no_images, r"\n{3,}", "\n\n")
    broken = F.regexp_replace(squeezed, LINE_BREAKS, "\n")
    lines = F.regexp_replace(broken, LINE_END_BLANKS + r"(?=\n|$)", "")
    return strip(lines)


def _text_of(item: Column) -> Column:
    """A variant's text when it is a non-blank string."""
    value = F.try_variant_get(item, "$", "string")
    return F.when((F.schema_of_variant(item) == "STRING") & ~is_blank(value), value)


def _first_text(doc: Column, keys: Iterable[str]) -> Column:
    return F.coalesce(*[_text_of(F.try_variant_get(doc, f"$.{key}", "variant")) for key in keys])


def _first_of(items: Column, pick: Callable[[Column], Column]) -> Column:
    texts = F.filter(F.transform(items, lambda item: pick(item)), lambda t: t.isNotNull())
    return F.try_element_at(texts, F.lit(1))


def markdown_of(raw: Column) -> Column:
    """Markdown text out of an OCR reply in any of its three shapes."""
    keys = ("md_content", "md", "markdown")

    def read(doc: Column) -> Column:
        top = _first_text(doc, ("md", "markdown", "md_content"))
        as_map = F.try_variant_get(doc, "$.results", "map<string,variant>")
        as_list = F.try_variant_get(doc, "$.results", "array<variant>")
        from_map = _first_of(F.map_values(as_map), lambda item: _first_text(item, keys))
        from_list = _first_of(as_list, lambda item: F.coalesce(_first_text(item, keys), _text_of(item)))
        return F.coalesce(top, from_map, from_list, F.lit(""))

    return strip_images(bound(F.try_parse_json(raw), read))


def content_list_of(raw: Column) -> Column:
    """Content list of an OCR reply as array<variant>; empty when there is none."""

    def read(doc: Column) -> Column:
        found = []
        for key in ("content_list", "content_list_v2", "middle_json"):
            found.append(F.try_variant_get(doc, f"$.{key}", "array<variant>"))
            found.append(F.try_variant_get(doc, f"$.{key}.content_list", "array<variant>"))
        return F.coalesce(*found, F.array().cast("array<variant>"))

    return bound(F.try_parse_json(raw), read)


# --- model analyses -------------------------------------------------------------------------


def unfenced(raw: Column) -> Column:
    """Drop a surrounding code fence."""

    def inner(text: Column) -> Column:
        after_line = F.regexp_replace(text, r"^[^\n]*\n", "")
        opened = F.when(F.instr(text, "\n") > 0, after_line).otherwise(F.substring(text, 4, 1 << 30))
        return F.when(text.startswith("```"), F.regexp_replace(opened, r"```$", "")).otherwise(text)

    return strip(bound(strip(raw), inner))


def tolerant_object(raw: Column) -> Column:
    """JSON object as variant: the whole text, else its outermost braces, else null."""

    def parse(text: Column) -> Column:
        block = F.nullif(F.regexp_extract(text, r"(\{[\s\S]*\})", 1), F.lit(""))
        return F.coalesce(F.try_parse_json(text), F.try_parse_json(block))

    is_object = lambda doc: F.schema_of_variant(doc).startswith("OBJECT")
    return bound(bound(unfenced(raw), parse), lambda doc: F.when(is_object(doc), doc))


def _listed(item: Column) -> Column:
    """A string as a one-element list, a list as it is, anything else as an empty list."""
    kind = F.schema_of_variant(item)
    empty = F.array().cast("array<string>")
    single = F.array(F.try_variant_get(item, "$", "string"))
    many = F.coalesce(F.try_variant_get(item, "$", "array<string>"), empty)
    return F.when(kind == "STRING", single).when(kind.startswith("ARRAY"), many).otherwise(empty)


def analysis_of(raw: Column) -> Column:
    """Validated analysis as a struct; null when the reply is no object or lacks a required field."""

    def read(doc: Column) -> Column:
        field = lambda key: F.try_variant_get(doc, f"$.{key}", "variant")
        keys = F.map_keys(F.try_variant_get(doc, "$", "map<string,variant>"))
        complete = F.size(F.array_intersect(keys, F.array(*map(F.lit, ANALYSIS_REQUIRED)))) == len(ANALYSIS_REQUIRED)
        confidence = F.when(
            F.array_contains(keys, "confidence"),
            F.coalesce(F.try_variant_get(doc, "$.confidence", "double"), F.lit(DEFAULT_CONFIDENCE)),
        )
        return F.when(
            complete,
            F.struct(
                F.try_variant_get(doc, "$.summary", "string").alias("summary"),
                *[bound(field(key), _listed).alias(key) for key in ANALYSIS_LISTS],
                confidence.alias("confidence"),
            ),
        )

    return bound(tolerant_object(raw), read)
