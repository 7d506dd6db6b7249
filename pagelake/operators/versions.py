"""Version suggestion, page matching between versions, and version bookkeeping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.constants import NEAR_DISTANCE, SUGGEST_JACCARD
from pagelake.operators.hamming import near_pairs
from pagelake.operators.ranks import blocked_rank, ranged_rank
from pagelake.operators.scope import live
from pagelake.session import cut

#: Slack for products of a threshold and a size that land just above a whole number.
EPSILON = 1e-9


def version_fingerprints(slides: DataFrame) -> DataFrame:
    """Distinct (version_id, fingerprint), missing ones left out."""
    return (
        slides.filter(F.coalesce("fingerprint", F.lit("")) != "").select("version_id", "fingerprint").distinct()
    )


def jaccard(left: DataFrame, right: DataFrame, pairs: DataFrame) -> DataFrame:
    """Adds ``jaccard`` to pairs (left_id, right_id) of fingerprint sets; 0.0 when both are empty.

    Both sets hold distinct (version_id, fingerprint) rows.
    """
    a = left.select(F.col("version_id").alias("left_id"), "fingerprint")
    b = right.select(F.col("version_id").alias("right_id"), "fingerprint")
    common = (
        pairs.select("left_id", "right_id").distinct().join(a, "left_id").join(b, ["right_id", "fingerprint"])
        .groupBy("left_id", "right_id").agg(F.count(F.lit(1)).alias("n_common"))
    )
    n_a = a.groupBy("left_id").agg(F.count(F.lit(1)).alias("n_left"))
    n_b = b.groupBy("right_id").agg(F.count(F.lit(1)).alias("n_right"))
    sized = (
        pairs.join(common, ["left_id", "right_id"], "left").join(n_a, "left_id", "left").join(n_b, "right_id", "left")
        .fillna(0, ["n_common", "n_left", "n_right"])
    )
    union = F.col("n_left") + F.col("n_right") - F.col("n_common")
    return sized.withColumn("jaccard", F.when(union > 0, F.col("n_common") / union).otherwise(0.0))


def _rare_first(sets: DataFrame, weight: DataFrame, threshold: float) -> DataFrame:
    """The rarest fingerprints of each set, enough that two sets at the threshold share one of them.

    All sets use one order: frequency class, then fingerprint. A set of n keeps its first
    n - ceil(threshold * n) + 1, so boilerplate pages, last in the order, rarely make candidates.
    """
    sizes = sets.groupBy("version_id").agg(F.count(F.lit(1)).alias("n"))
    ordered = sets.join(weight, "fingerprint").withColumn("ord", F.struct("class", "fingerprint"))
    block = F.struct("class", F.substring("fingerprint", 1, 3).alias("p"))
    ranked = blocked_rank(ordered, ["version_id"], "ord", "rn", block)
    keep = F.col("n") - F.ceil(F.col("n") * threshold - EPSILON) + 1
    return ranked.join(sizes, "version_id").filter(F.col("rn") <= keep).select("version_id", "fingerprint", "n")


def suggest_versions(
    new_slides: DataFrame,
    slides: DataFrame,
    presentations: DataFrame,
    threshold: float = SUGGEST_JACCARD,
    exclude: DataFrame | None = None,
) -> DataFrame:
    """(version_id, presentation_id, title, similarity, page_count): likely parents of new versions.

    Compares each new version's fingerprint set with the current version of every live
    presentation. Candidates come from rare-first prefixes of the sets, then are counted exactly,
    so no fingerprint pairs up all versions that hold it. ``exclude``: (version_id,
    presentation_id) pairs not to suggest.
    """
    current = live(presentations).select("presentation_id", F.col("title"), F.col("current_version_id").alias("right_id"))
    incoming = version_fingerprints(new_slides)
    known_slides = slides.join(current.select(F.col("right_id").alias("version_id")), "version_id", "left_semi")
    known = version_fingerprints(known_slides)
    weight = (
        incoming.unionByName(known).groupBy("fingerprint")
        .agg(F.floor(F.log2(F.count(F.lit(1)).cast("double"))).cast("int").alias("class"))
    )
    a = _rare_first(incoming, weight, threshold).select(
        F.col("version_id").alias("left_id"), "fingerprint", F.col("n").alias("n_a")
    )
    b = _rare_first(known, weight, threshold).select(
        F.col("version_id").alias("right_id"), "fingerprint", F.col("n").alias("n_b")
    )
    pairs = (
        a.join(b, "fingerprint")
        .filter((F.col("n_a") >= threshold * F.col("n_b") - EPSILON) & (F.col("n_b") >= threshold * F.col("n_a") - EPSILON))
        .select("left_id", "right_id").distinct()
    )
    pages = known_slides.groupBy("version_id").agg(F.count(F.lit(1)).alias("page_count"))
    found = (
        jaccard(incoming, known, pairs)
        .filter(F.col("jaccard") >= threshold - EPSILON)
        .join(current, "right_id")
        .join(pages.withColumnRenamed("version_id", "right_id"), "right_id")
        .select(
            F.col("left_id").alias("version_id"), "presentation_id", "title",
            F.round("jaccard", 3).alias("similarity"), "page_count",
        )
    )
    return found if exclude is None else found.join(exclude, ["version_id", "presentation_id"], "left_anti")


def previous_versions(versions: DataFrame) -> DataFrame:
    """(presentation_id, from_version_id, to_version_id): each version after the first and the one before it.

    Versions are ranked in blocks and met by rank, so a file with very many uploads stays spread out.
    """
    ranked = blocked_rank(versions.select("presentation_id", "version_id", "version_no"), ["presentation_id"], "version_no", "nth")
    before = ranked.select("presentation_id", (F.col("nth") + 1).alias("nth"), F.col("version_id").alias("from_version_id"))
    return ranked.join(before, ["presentation_id", "nth"]).select(
        "presentation_id", "from_version_id", F.col("version_id").alias("to_version_id")
    )


# --- page matching --------------------------------------------------------------------------

_PAIR = ["from_version_id", "to_version_id"]


def _sides(pairs: DataFrame, slides: DataFrame) -> tuple[DataFrame, DataFrame]:
    cols = [c for c in ("slide_id", "page_no", "fingerprint", "sig") if c in slides.columns]
    pick = slides.select("version_id", *cols)
    old = pick.join(pairs.select(*_PAIR), F.col("version_id") == F.col("from_version_id")).select(*_PAIR, *cols)
    new = pick.join(pairs.select(*_PAIR), F.col("version_id") == F.col("to_version_id")).select(*_PAIR, *cols)
    return old, new


def _first_pages(side: DataFrame, name: str) -> DataFrame:
    """First page per fingerprint in page order."""
    return (
        side.filter(F.coalesce("fingerprint", F.lit("")) != "")
        .groupBy(*_PAIR, "fingerprint")
        .agg(F.min(F.struct("page_no", "slide_id")).alias("p"))
        .select(*_PAIR, "fingerprint", F.col("p.page_no").alias(f"{name}_page"), F.col("p.slide_id").alias(f"{name}_slide_id"))
    )


def match_exact(pairs: DataFrame, slides: DataFrame) -> DataFrame:
    """Pages with equal fingerprints: unchanged on the same page number, else rearranged."""
    old, new = _sides(pairs, slides)
    met = _first_pages(new, "to").join(_first_pages(old, "from"), [*_PAIR, "fingerprint"])
    kind = F.when(F.col("from_page") == F.col("to_page"), "unchanged").otherwise("rearranged")
    return met.select(
        *_PAIR, "from_slide_id", "to_slide_id", kind.alias("match_type"), F.lit(1.0).alias("score")
    )


def _colleges(old: DataFrame, prefs: DataFrame) -> DataFrame:
    """Places for new pages: old pages of one signature, (*pair, sig, run, first_page, capacity).

    New pages at equal distance from two signatures take the lower old page, so signatures in such
    a tie are cut into runs of pages that no other tied signature interrupts.
    """
    key = [*_PAIR, "sig"]
    tied = (
        prefs.groupBy(*_PAIR, "new_sig", "distance").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        .join(prefs, [*_PAIR, "new_sig", "distance"])
        .select(*_PAIR, F.col("old_sig").alias("sig")).distinct()
    )
    among = old.join(tied, key, "left_semi").select(*key, "page_no", "slide_id")
    overall = blocked_rank(among, _PAIR, "page_no", "r_all")
    within = blocked_rank(overall, key, "page_no", "r_own")
    runs = within.withColumn("run", F.col("r_all") - F.col("r_own"))
    single = old.join(tied, key, "left_anti").select(*key, "page_no", "slide_id", F.lit(0).cast("bigint").alias("run"))
    return runs.select(*key, "page_no", "slide_id", "run").unionByName(single)


def _match_near(old: DataFrame, new: DataFrame, distance: int) -> DataFrame:
    """One-to-one assignment of leftover new pages to leftover old pages.

    In page order each new page takes the nearest free old page within ``distance`` bits, lower
    pages first among equals. That outcome is the only stable one when every old page prefers
    lower new pages, so it is reached without walking the pages: all new pages aim at their best
    open place at once; a place aimed at by more pages than it has room for closes to all pages
    after its last seat; repeat until nothing closes. Old pages that are equally far from the same
    new signatures are one line with many seats in page order, so ties and copies settle at once.
    Every round closes a place, so the rounds end.
    """
    old = cut(old.filter(F.col("sig").isNotNull()))
    new = cut(new.filter(F.col("sig").isNotNull()))
    new_sigs = new.select(*_PAIR, F.col("sig").alias("new_sig")).distinct()
    old_sigs = old.select(*_PAIR, F.col("sig").alias("old_sig")).distinct()
    prefs = cut(
        near_pairs(new_sigs, old_sigs, on=_PAIR, left_sig="new_sig", right_sig="old_sig", distance=distance)
        .select(*_PAIR, F.col("sig_a").alias("new_sig"), F.col("sig_b").alias("old_sig"), "distance")
    )
    distances = F.xxhash64("new_sig", "distance")
    lines = prefs.groupBy(*_PAIR, "old_sig").agg(
        F.struct(F.count(F.lit(1)).alias("n"), F.bit_xor(distances).alias("a"), F.bit_xor(F.xxhash64("distance", "new_sig")).alias("b")).alias("line")
    )
    old = old.join(lines.withColumnRenamed("old_sig", "sig"), [*_PAIR, "sig"]).drop("sig").withColumnRenamed("line", "sig")
    prefs = cut(prefs.join(lines, [*_PAIR, "old_sig"]).drop("old_sig").withColumnRenamed("line", "old_sig").distinct())
    seats = cut(_colleges(old.join(prefs.select(*_PAIR, F.col("old_sig").alias("sig")).distinct(), [*_PAIR, "sig"], "left_semi"), prefs))
    place = [*_PAIR, "sig", "run"]
    places = seats.groupBy(*place).agg(F.min("page_no").alias("first_page"), F.count(F.lit(1)).alias("capacity"))
    options = cut(
        prefs.withColumnRenamed("old_sig", "sig").join(places, [*_PAIR, "sig"])
    )
    pages = new.select(*_PAIR, F.col("sig").alias("new_sig"), "page_no", "slide_id")
    choices = pages.join(options, [*_PAIR, "new_sig"])
    closed = None
    while True:
        open_choices = choices
        if closed is not None:
            open_choices = choices.join(closed, place, "left").filter(
                F.col("last_page").isNull() | (F.col("page_no") <= F.col("last_page"))
            ).drop("last_page")
        aim = cut(
            open_choices.groupBy(*_PAIR, "page_no", "slide_id")
            .agg(F.min(F.struct("distance", "first_page", "sig", "run", "capacity")).alias("b"))
            .select(*_PAIR, "page_no", "slide_id", "b.*")
        )
        crowded = aim.groupBy(*place).agg(F.count(F.lit(1)).alias("n"), F.first("capacity").alias("room")).filter("n > room")
        over = cut(
            blocked_rank(aim.join(crowded.select(*place), place, "left_semi"), place, "page_no", "seat")
            .filter(F.col("seat") == F.col("capacity"))
            .select(*place, F.col("page_no").alias("last_page"))
        )
        if over.isEmpty():
            break
        closed = over if closed is None else cut(closed.unionByName(over).groupBy(*place).agg(F.min("last_page").alias("last_page")))
    takers = blocked_rank(aim, place, "page_no", "seat").select(*place, "seat", F.col("slide_id").alias("to_slide_id"), "distance")
    taken = blocked_rank(seats, place, "page_no", "seat").select(*place, "seat", F.col("slide_id").alias("from_slide_id"))
    return takers.join(taken, [*place, "seat"]).select(
        *_PAIR, "from_slide_id", "to_slide_id", F.lit("modified").alias("match_type"),
        (1.0 - F.col("distance") / 64.0).alias("score"),
    )


def match_versions(pairs: DataFrame, slides: DataFrame, distance: int = NEAR_DISTANCE) -> DataFrame:
    """Page matches of version pairs: unchanged, rearranged, modified, added, deleted.

    ``pairs``: from_version_id, to_version_id. ``slides``: slide_id, version_id, page_no,
    fingerprint, sig. Every page of either side occurs exactly once.
    """
    old, new = _sides(pairs, slides)
    exact = cut(match_exact(pairs, slides))
    used_old = exact.select(*_PAIR, F.col("from_slide_id").alias("slide_id"))
    used_new = exact.select(*_PAIR, F.col("to_slide_id").alias("slide_id"))
    rest_old = cut(old.join(used_old, [*_PAIR, "slide_id"], "left_anti"))
    rest_new = cut(new.join(used_new, [*_PAIR, "slide_id"], "left_anti"))
    near = cut(_match_near(rest_old, rest_new, distance))
    none = F.lit(None).cast("bigint")
    added = rest_new.join(near.select(*_PAIR, F.col("to_slide_id").alias("slide_id")), [*_PAIR, "slide_id"], "left_anti").select(
        *_PAIR, none.alias("from_slide_id"), F.col("slide_id").alias("to_slide_id"), F.lit("added").alias("match_type"), F.lit(0.0).alias("score")
    )
    deleted = rest_old.join(near.select(*_PAIR, F.col("from_slide_id").alias("slide_id")), [*_PAIR, "slide_id"], "left_anti").select(
        *_PAIR, F.col("slide_id").alias("from_slide_id"), none.alias("to_slide_id"), F.lit("deleted").alias("match_type"), F.lit(0.0).alias("score")
    )
    return exact.unionByName(near).unionByName(added).unionByName(deleted)


def version_diff(matches: DataFrame) -> DataFrame:
    """Pages per match type and version pair."""
    return matches.groupBy(*_PAIR, "match_type").agg(F.count(F.lit(1)).alias("n"))


# --- uploads --------------------------------------------------------------------------------


def live_file_versions(versions: DataFrame, presentations: DataFrame) -> DataFrame:
    return versions.join(live(presentations).select("presentation_id", F.col("title").alias("presentation_title")), "presentation_id")


def file_dedup(files: DataFrame, versions: DataFrame, presentations: DataFrame) -> DataFrame:
    """Adds ``existing_version_id``, ``existing_presentation_id`` and ``is_duplicate`` to files with a sha256.

    The newest live version with the same content wins. Among the files themselves the one of
    least file_id holds the content (``first_file_id``) and later ones repeat it. Both sides are reduced
    to one row per hash before the join, so repeated uploads do not multiply.
    """
    newest = (
        live_file_versions(versions, presentations)
        .groupBy("sha256")
        .agg(F.max(F.struct("created_at", "version_id", "presentation_id")).alias("v"))
        .select("sha256", F.col("v.version_id").alias("existing_version_id"), F.col("v.presentation_id").alias("existing_presentation_id"))
    )
    first = files.groupBy("sha256").agg(F.min("file_id").alias("first_file_id"))
    repeats = F.col("existing_version_id").isNotNull() | (F.col("file_id") > F.col("first_file_id"))
    return files.join(newest, "sha256", "left").join(first, "sha256", "left").withColumn("is_duplicate", F.coalesce(repeats, F.lit(False)))


def sha_precheck(hashes: DataFrame, versions: DataFrame, presentations: DataFrame) -> DataFrame:
    """Adds ``exists``, ``presentation_id`` and ``presentation_title`` of a live version with that hash."""
    known = (
        live_file_versions(versions, presentations)
        .groupBy("sha256")
        .agg(F.min(F.struct("presentation_id", "presentation_title")).alias("p"))
        .select("sha256", "p.*")
    )
    return hashes.join(known, "sha256", "left").withColumn("exists", F.col("presentation_id").isNotNull())


def assign_versions(files: DataFrame, versions: DataFrame, presentations: DataFrame) -> DataFrame:
    """Version numbers for new files (file_id, parent_presentation_id) in file order.

    Next number of a live parent is its highest plus one; files without a parent start at 1;
    files whose parent is missing or deleted get the error INVALID_PARENT. ``is_current`` marks
    the last file of each parent.
    """
    alone = files.filter(F.col("parent_presentation_id").isNull())
    child = files.filter(F.col("parent_presentation_id").isNotNull())
    parents = live(presentations).select(F.col("presentation_id").alias("parent_presentation_id"))
    good = child.join(parents, "parent_presentation_id", "left_semi")
    bad = child.join(parents, "parent_presentation_id", "left_anti")
    highest = versions.groupBy(F.col("presentation_id").alias("parent_presentation_id")).agg(F.max("version_no").alias("last_no"))
    counts = good.groupBy("parent_presentation_id").agg(F.count(F.lit(1)).alias("n_files"))
    ranked = ranged_rank(good, ["parent_presentation_id"], ["file_id"], "nth")
    numbered = (
        ranked.join(highest, "parent_presentation_id", "left").join(counts, "parent_presentation_id")
        .withColumn("version_no", F.coalesce("last_no", F.lit(0)) + F.col("nth"))
        .withColumn("is_current", F.col("nth") == F.col("n_files"))
        .withColumn("error", F.lit(None).cast("string"))
    )
    cols = [*files.columns, "version_no", "is_current", "error"]
    first = alone.withColumn("version_no", F.lit(1).cast("bigint")).withColumn("is_current", F.lit(True)).withColumn("error", F.lit(None).cast("string"))
    failed = bad.withColumn("version_no", F.lit(None).cast("bigint")).withColumn("is_current", F.lit(False)).withColumn("error", F.lit("INVALID_PARENT"))
    return numbered.withColumn("version_no", F.col("version_no").cast("bigint")).select(*cols).unionByName(first.select(*cols)).unionByName(failed.select(*cols))
