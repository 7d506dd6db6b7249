"""SimHash fingerprints, edited texts and the search within a Hamming radius, in DataFrame functions only.

Terms are the pairs of neighbouring words and the last word; each occurrence votes on 64 signed bits by the
term's hash, so a term weighs as often as it stands in the text. The votes of two bits share a 64-bit sum
(32 bits each, room for four billion votes, more than a text can hold), so a document is 32 sums of a plain
grouped aggregate.

Nulls are empty texts; a text without words has fingerprint 0. Equal texts have equal fingerprints.
Documents come in ascending doc_id; rows of one doc_id by the hash of their text, those without an id
first (the lowest 64-bit number stands for null). Repeated rows count once in this order and are all returned.
An empty table gives an empty result. Further columns are not read.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelake.session import cut

BITS = 64
RADIUS = 3
#: Tables of permuted blocks: 64 bits in BLOCKS blocks, of which RADIUS may differ; the others are the key.
BLOCKS = 6
#: Rows of a run of documents in which the next one is looked up.
RUN_ROWS = 262_144
BLANK = r"[\x20\x09-\x0D]+"
LANE = 0x0000000100000001


def _terms(text: Column) -> Column:
    """Hashes of pairs of neighbouring words, and of the last word alone; none for a text of blanks."""
    bare = F.trim(text, F.lit(" \t\n\x0b\x0c\r"))
    found = F.split(bare, BLANK)
    pairs = F.zip_with(found, F.slice(found, 2, F.size(found)), lambda a, b: F.when(b.isNull(), F.xxhash64(a)).otherwise(F.xxhash64(a, b)))
    return F.when(bare != "", pairs)


def fingerprints(texts: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """``keys`` and ``fp`` (64-bit number) of each row; ``keys`` name a row."""
    terms = texts.select(*keys, F.explode_outer(_terms(F.col(text_col))).alias("_t"))
    sums = [F.sum(F.shiftrightunsigned("_t", k).bitwiseAND(F.lit(LANE))).alias(f"_v{k}") for k in range(32)]
    votes = terms.groupBy(*keys).agg(F.count("_t").alias("_n"), *sums)
    low = 0xFFFFFFFF
    bits = [
        F.when(2 * lane > F.col("_n"), F.lit(1 << (k + 32 * half) if k + 32 * half < 63 else -(1 << 63))).otherwise(F.lit(0))
        for k in range(32)
        for half, lane in ((0, F.col(f"_v{k}").bitwiseAND(F.lit(low))), (1, F.shiftrightunsigned(f"_v{k}", 32)))
    ]
    fp = bits[0]
    for b in bits[1:]:
        fp = fp.bitwiseOR(b)
    return votes.select(*keys, F.coalesce(fp, F.lit(0)).cast("bigint").alias("fp"))


def likeness(a: Column, b: Column) -> Column:
    return F.lit(1.0) - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def next_documents(ids: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``_next``, a struct of ``order`` of the row behind (after the last: the first).

    Rows are dealt to ranges once and kept; rows look within their range, the last of each range
    meets the first of the next one that has rows in a table with one row per range.
    """
    spark = ids.sparkSession
    ids = cut(ids)
    parts = max(1, -(-ids.count() // RUN_ROWS), int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = cut(ids.repartitionByRange(parts, *order).withColumn("_run", F.spark_partition_id()))
    key = F.struct(*order)
    within = dealt.withColumn("_next", F.lead(key).over(Window.partitionBy("_run").orderBy(*order)))
    heads = cut(dealt.groupBy("_run").agg(F.min(key).alias("_head")))
    first = heads.agg(F.min("_head").alias("k")).first()["k"]
    if first is None:
        return within.drop("_run")
    # One row per range of rows, so a few for each million documents.
    heads = heads.select("_run", F.lead("_head").over(Window.orderBy("_run")).alias("_head"))
    start = F.struct(*[F.lit(first[c]).cast(dict(ids.dtypes)[c]).alias(c) for c in order])
    return within.join(heads, "_run").withColumn("_next", F.coalesce("_next", "_head", start)).drop("_run", "_head")


def near_fingerprints(queries: DataFrame, index: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(q, fp) of all distinct fingerprints ``fp`` of ``index`` within ``radius`` bits of those of ``queries``.

    Bits are cut into ``blocks`` blocks; two numbers that differ in at most ``radius`` bits agree in
    the other ``blocks - radius`` at least. For each choice of so many blocks a table is keyed by them, and
    a pair comes out of the first table in which it meets. Fingerprints are distinct before they are dealt out.
    """
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    masks = []
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        m = ((1 << hi) - 1) ^ ((1 << lo) - 1)
        masks.append(m - (1 << 64) if m >= 1 << 63 else m)
    tables = []
    for choice in combinations(range(blocks), blocks - radius):
        m = 0
        for c in choice:
            m |= masks[c]
        tables.append(m)

    def keyed(df: DataFrame, name: str) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(i).alias("t"), F.col(name).bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(tables)])
        return df.select(name, F.explode(cells).alias("c")).select(name, "c.t", "c.key")

    left = keyed(queries.select(F.col("fp").alias("q")).distinct(), "q")
    right = keyed(index.select("fp").distinct(), "fp")
    both = F.col("q").bitwiseXOR(F.col("fp"))
    earliest = F.lit(len(tables))
    for i in reversed(range(len(tables))):
        earliest = F.when(both.bitwiseAND(F.lit(tables[i])) == 0, F.lit(i)).otherwise(earliest)
    return left.join(right, ["t", "key"]).filter((F.bit_count(both) <= radius) & (earliest == F.col("t"))).select("q", "fp")


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """Fingerprints of texts and edited texts, their likeness, and what the search finds for every fiftieth doc_id.

    The edited text has its last floor(n_chars / 2) characters replaced by as many of the next document's
    first ones (or all it has). ``n_near``: documents, itself included, within ``radius`` bits; null for ids that are no queries.
    """
    lowest = F.lit(-(1 << 63))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    order = ["_id", "h", "n_chars"]
    base = docs.select(F.coalesce(F.col(id_col).cast("bigint"), lowest).alias("_id"), text.alias("text")).withColumns(
        {"h": F.xxhash64("text"), "n_chars": F.char_length("text").cast("bigint")}
    )
    ids = base.groupBy(*order).agg(F.count(F.lit(1)).alias("copies"))
    chained = cut(next_documents(ids, order))
    wanted = chained.select(
        *[F.col(f"_next.{c}").alias(c) for c in order], F.floor(F.col("n_chars") / 2).cast("int").alias("want"), F.struct(*order).alias("of"), "copies"
    )
    heads = base.join(wanted, order).dropDuplicates([*order, "of"]).select(
        *[F.col(f"of.{c}").alias(c) for c in order], F.expr("left(text, want)").alias("head"), F.struct(*order).alias("_next"), "copies"
    )
    kept = F.expr("left(text, cast(n_chars - floor(n_chars / 2) as int))")
    pairs = base.join(heads, order).withColumn("edited", F.concat(kept, "head"))
    facts = [*order, "_next", "copies", "edited_sha256"]
    both = pairs.withColumn("edited_sha256", F.sha2("edited", 256)).select(
        *facts, F.explode(F.array(F.struct(F.lit(0).alias("kind"), "text"), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("text")))).alias("x")
    )
    made = fingerprints(both.select(*facts, "x.kind", "x.text"), [*facts, "kind"])
    own = cut(
        made.groupBy(*facts).agg(F.max(F.when(F.col("kind") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("kind") == 1, F.col("fp"))).alias("edited_fp"))
    )
    following = own.select(F.struct(*order).alias("_next"), F.col("fp").alias("next_fp"))
    asked = own.filter((F.col("_id") % 50 == 0) & (F.col("_id") != lowest))
    weights = own.groupBy("fp").agg(F.sum("copies").alias("_w"))
    found = near_fingerprints(asked, weights, radius).join(weights, "fp").groupBy(F.col("q").alias("fp")).agg(F.sum("_w").alias("n_near"))
    is_query = (F.col("_id") % 50 == 0) & (F.col("_id") != lowest)
    return (
        own.join(following, "_next").join(found, "fp", "left")
        .select(
            F.when(F.col("_id") != lowest, F.col("_id")).alias("doc_id"), "n_chars", "edited_sha256",
            F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.lpad(F.lower(F.hex("edited_fp")), 16, "0").alias("edited_fingerprint"),
            likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
            F.when(is_query, F.col("n_near")).alias("n_near"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy"),
        )
        .drop("_copy")
    )
