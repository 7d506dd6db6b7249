"""Hash, vector, status and path functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelake.constants import STATUS_FAILED, STATUS_READY, STATUS_RUNNING

# --- 64-bit signatures ----------------------------------------------------------------------


def hex_to_bits(sig: Column) -> Column:
    """Hex text of up to 64 bits as a signed long; null when missing or malformed."""
    padded = F.lpad(sig, 16, "0")
    high = F.conv(F.substring(padded, 1, 8), 16, 10).cast("bigint")
    low = F.conv(F.substring(padded, 9, 8), 16, 10).cast("bigint")
    return F.when(sig.rlike("^[0-9a-fA-F]{1,16}$"), F.shiftleft(high, 32).bitwiseOR(low))


def bits_to_hex(bits: Column) -> Column:
    return F.lower(F.lpad(F.hex(bits), 16, "0"))


def bit_distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)).cast("int")


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two hex signatures."""
    return bit_distance(hex_to_bits(a), hex_to_bits(b))


# --- vectors --------------------------------------------------------------------------------


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    norm = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when(norm > 0, 1.0 - _dot(a, b) / norm)


def quantised(vector: Column) -> Column:
    """Vector elements rounded to 7 decimals."""
    return F.transform(vector, lambda x: F.round(x.cast("double"), 7))


# --- keys, durations, statuses --------------------------------------------------------------


def idempotency_key(job_type: Column, target_id: Column, input_data: Column | None = None) -> Column:
    target = target_id.cast("string")
    parts = [job_type, target]
    if input_data is not None:
        parts.append(F.nullif(input_data, F.lit("")))
    digest = F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)
    return F.concat_ws(":", job_type, target, digest)


def duration_ms(started: Column, finished: Column) -> Column:
    ms = F.unix_millis(finished.cast("timestamp")) - F.unix_millis(started.cast("timestamp"))
    return F.when(ms >= 0, ms)


def _tenths(ms: Column) -> Column:
    """ms / 1000 to one decimal as text; a half counts by the double's own value, exact halves go up."""
    below = F.floor(ms / 100)
    scaled = ((ms / 1000.0) * float(1 << 52)).cast("decimal(20,0)") * 1000
    half_up = scaled >= ms.cast("decimal(20,0)") * F.lit(1 << 52).cast("decimal(20,0)")
    up = (ms % 100 > 50) | ((ms % 100 == 50) & half_up)
    n = below + F.when(up, 1).otherwise(0)
    return F.concat(F.floor(n / 10).cast("string"), F.lit("."), (n % 10).cast("string"))


def duration_text(started: Column, finished: Column) -> Column:
    """'250ms', '1.2s', '45s', '2m 10s' or '3m'; null when it cannot be told."""
    ms = duration_ms(started, finished)
    whole = F.floor((ms + 500) / 1000).cast("string")
    minutes = F.floor(ms / 60000).cast("string")
    rest = F.floor((ms % 60000 + 500) / 1000)
    long = F.when(rest > 0, F.concat(minutes, F.lit("m "), rest.cast("string"), F.lit("s"))).otherwise(F.concat(minutes, F.lit("m")))
    return (
        F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms")))
        .when(ms < 10000, F.concat(_tenths(ms), F.lit("s")))
        .when(ms < 60000, F.concat(whole, F.lit("s")))
        .when(ms.isNotNull(), long)
    )


def status_group(status: Column) -> Column:
    return (
        F.when(status.isin(*STATUS_READY), "ready")
        .when(status.isin(*STATUS_RUNNING), "processing")
        .when(status.isin(*STATUS_FAILED), "failed")
        .otherwise("other")
    )


def owner_label(display_name: Column, username: Column) -> Column:
    return F.coalesce(F.nullif(display_name, F.lit("")), username)


def percent(done: Column, total: Column) -> Column:
    return F.floor(done * 100 / total).cast("int")


# --- package paths --------------------------------------------------------------------------


def relation_name(type_uri: Column) -> Column:
    """Last segment of a relationship type address."""
    return F.substring_index(F.regexp_replace(F.coalesce(type_uri, F.lit("")), "/+$", ""), "/", -1)


def resolved_part(target: Column, source: Column) -> Column:
    """Part path a relationship points at, relative to the package root."""
    clean = F.replace(target, F.lit("\\"), F.lit("/"))
    folder = F.when(F.instr(source, "/") > 0, F.regexp_replace(source, "/[^/]*$", "")).otherwise("")
    steps = F.split(F.concat_ws("/", folder, clean), "/")
    stacked = F.aggregate(
        F.filter(steps, lambda s: (s != "") & (s != ".")),
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(
            F.concat(acc, F.array(s))
        ),
    )
    return F.when(clean.startswith("/"), F.substring(clean, 2, 1 << 30)).otherwise(F.array_join(stacked, "/"))


def image_part(target: Column) -> Column:
    """Package path of a picture referenced from a slide."""
    return F.when(
        F.nullif(target, F.lit("")).isNotNull(),
        F.when(target.startswith("../"), F.concat(F.lit("ppt/"), F.substring(target, 4, 1 << 30))).otherwise(
            F.concat(F.lit("ppt/slides/"), target)
        ),
    )


def rels_part(part: Column) -> Column:
    """Path of the relationship file that belongs to a part."""
    name = F.substring_index(part, "/", -1)
    folder = F.when(F.instr(part, "/") > 0, F.regexp_replace(part, "/[^/]*$", ""))
    return F.concat_ws("/", folder, F.lit("_rels"), F.concat(name, F.lit(".rels")))
