"""Library lists and table maintenance: table plus changes gives table."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelake.constants import IN_PROGRESS
from pagelake.functions.scalar import owner_label, status_group
from pagelake.operators.changes import change_order, one_per_key
from pagelake.operators.ranks import BLOCK, in_ranges, running_total
from pagelake.operators.scope import live, modifiable_by, scoped_slides, scoped_versions, trashed, visible_to
from pagelake.session import stored

# --- lists ----------------------------------------------------------------------------------


def latest_jobs(jobs: DataFrame) -> DataFrame:
    """Newest job per target (kind and id), as an aggregate: no target's history meets in one task."""
    newest = F.max_by(F.struct("job_id", "job_type", "status", "progress", "stage"), F.struct("created_at", "job_id"))
    return jobs.groupBy("target_type", "target_id").agg(newest.alias("j")).select("target_type", "target_id", "j.*")


def library_list(
    presentations: DataFrame,
    versions: DataFrame,
    users: DataFrame,
    jobs: DataFrame,
    *,
    user_id=None,
    superuser: bool = False,
    include_deleted: bool = False,
    visibility: str | None = None,
    folder_id=None,
    mine: bool = False,
    title: str | None = None,
    status: str | None = None,
    sort: str = "created",
) -> DataFrame:
    """Files as listed: owner name, current status, and progress of the newest job while in progress."""
    df = presentations if include_deleted else live(presentations)
    df = df.filter(visible_to(user_id, superuser))
    if visibility:
        df = df.filter(F.col("visibility") == visibility)
    if folder_id is not None:
        df = df.filter(F.col("folder_id") == folder_id)
    if mine:
        df = df.filter(F.col("owner_id") == user_id)
    if title:
        df = df.filter(F.col("title").ilike(f"%{title}%"))
    current = versions.select(F.col("version_id").alias("current_version_id"), F.col("status").alias("current_status"))
    df = df.join(current, "current_version_id", "left")
    if status:
        df = df.filter(F.col("current_status") == status)
    owners = users.select(F.col("user_id").alias("owner_id"), owner_label(F.col("display_name"), F.col("username")).alias("owner_name"))
    news = latest_jobs(jobs.filter(F.col("target_type") == "version")).select(
        F.col("target_id").alias("current_version_id"), F.col("progress").alias("_progress"), F.col("stage").alias("_stage")
    )
    busy = F.col("current_status").isin(*IN_PROGRESS)
    df = (
        df.join(owners, "owner_id", "left").join(news, "current_version_id", "left")
        .withColumn("progress", F.when(busy, F.col("_progress")))
        .withColumn("stage", F.when(busy, F.col("_stage")))
        .withColumn("status_group", status_group(F.col("current_status")))
        .drop("_progress", "_stage")
    )
    order = {
        "created": F.col("created_at").desc(),
        "page_count": F.col("page_count").desc(),
        "title": F.col("title").asc(),
    }[sort]
    return df.orderBy(order, "presentation_id")


class PageDirectory(NamedTuple):
    """Pages in ranges of (version, page number), and how many pages of each version lie in each range."""

    pages: DataFrame
    counts: DataFrame


def page_directory(slides: DataFrame, width: int = BLOCK) -> PageDirectory:
    """Kept beside the pages; serves every scope, as it is sorted by version."""
    pages = in_ranges(slides, ["version_id", "page_no", "slide_id"], "page_range", width)
    counts = pages.groupBy("version_id", "page_range").agg(F.count(F.lit(1)).alias("n_pages"))
    return PageDirectory(pages, stored(counts, "page-counts"))


def browse_pages(directory: PageDirectory, presentations, versions, *, user_id=None, superuser=False, page: int = 1, page_size: int = 48) -> DataFrame:
    """One screen of all current pages: newest file first, then page number.

    Counts of the ranges give the place of each range in the caller's scope; only the ranges that the screen
    meets are read, however deep it lies. These are no more than the pages of a screen.
    """
    dated = presentations.select(F.col("presentation_id"), F.col("created_at").alias("presentation_created_at"))
    scope = scoped_versions(presentations, versions, user_id, superuser).join(dated, "presentation_id")
    order = [F.col("presentation_created_at").desc(), F.col("presentation_id"), F.col("page_range")]
    places = running_total(scope.join(directory.counts, "version_id"), [], order, F.col("n_pages"), "last")
    first, last = (page - 1) * page_size, page * page_size
    met = stored(places.withColumn("before", F.col("last") - F.col("n_pages")).filter((F.col("before") < last) & (F.col("last") > first)), "met-ranges")
    ranges = [r["page_range"] for r in met.select("page_range").distinct().collect()]
    of_range = Window.partitionBy("presentation_id", "page_range").orderBy("page_no", "slide_id")
    shown = directory.pages.filter(F.col("page_range").isin(ranges)).join(met.drop("n_pages", "last"), ["version_id", "page_range"])
    placed = shown.withColumn("position", F.col("before") + F.row_number().over(of_range))
    return placed.filter((F.col("position") > first) & (F.col("position") <= last)).drop("before", "page_range").orderBy("position")


def scoped_page_count(directory: PageDirectory, presentations, versions, *, user_id=None, superuser=False) -> int:
    """How many pages the caller can browse, from the directory's counts."""
    counted = scoped_versions(presentations, versions, user_id, superuser).join(directory.counts, "version_id")
    return counted.agg(F.sum("n_pages")).first()[0] or 0


def versions_nested(presentations: DataFrame, versions: DataFrame) -> DataFrame:
    """Versions as an ordered array per file; an upload history is short."""
    entry = F.struct("version_no", "version_id", "status", "page_count")
    nested = versions.groupBy("presentation_id").agg(F.sort_array(F.collect_list(entry)).alias("versions"))
    return presentations.join(nested, "presentation_id", "left")


def version_slides(slides: DataFrame, version_id) -> DataFrame:
    return slides.filter(F.col("version_id") == version_id).orderBy("page_no")


def active_tags(tags: DataFrame) -> DataFrame:
    return tags.filter(F.col("status") == "active").orderBy("name")


def slide_tag_list(slide_tags: DataFrame, tags: DataFrame) -> DataFrame:
    return slide_tags.join(tags.select("tag_id", "name", "category", "source", "status"), "tag_id")


def favorites_list(favorites: DataFrame, slides: DataFrame, user_id) -> DataFrame:
    """A user's favourite pages, newest first."""
    own = favorites.filter(F.col("user_id") == user_id).select("slide_id", F.col("created_at").alias("favorite_at"))
    return own.join(slides, "slide_id").orderBy(F.col("favorite_at").desc(), "slide_id")


def folder_list(folders: DataFrame) -> DataFrame:
    return folders.orderBy("created_at", "folder_id")


# --- changes --------------------------------------------------------------------------------


def insert_absent(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Adds rows whose key the table lacks; of equal new keys one is kept."""
    fresh = rows.join(table.select(*keys), keys, "left_anti").dropDuplicates(keys)
    return table.unionByName(fresh, allowMissingColumns=True)


def remove_keys(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(gone.select(*keys), keys, "left_anti")


def patch(table: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Sets the allowed columns where the change row holds a value; other columns of it are ignored.

    A column named in the change's array ``set_null``, where there is one, becomes null. Changes of one key add up: per
    column the last by ``at`` that sets or clears it counts, or the greatest row where they have no time.
    """
    named = [c for c in columns if c in changes.columns]
    cleared = F.coalesce(F.col("set_null"), F.array().cast("array<string>")) if "set_null" in changes.columns else F.array().cast("array<string>")
    order = change_order(changes, [key])

    def last(c: str) -> Column:
        value = F.col(c) if c in named else F.lit(None).cast(table.schema[c].dataType)
        clears = F.array_contains(cleared, c)
        own = F.struct(clears.alias("clears"), F.when(~clears, value).alias("value"))
        return F.max_by(own, F.when(clears | value.isNotNull(), order)).alias(f"_new_{c}")

    present = [c for c in columns if c in table.columns]
    df = table.join(changes.groupBy(key).agg(*[last(c) for c in present]), key, "left")
    for c in present:
        new = F.col(f"_new_{c}")
        df = df.withColumn(c, F.when(new.isNull(), F.col(c)).otherwise(new["value"]))
    return df.select(*table.columns)


def create_tags(tags: DataFrame, wanted: DataFrame) -> DataFrame:
    """Manual tags by name; a name that exists keeps its tag."""
    rows = wanted.select(
        F.concat(F.lit("tag-"), F.col("name")).alias("tag_id"), "name", "category",
        F.lit("manual").alias("source"), F.lit("active").alias("status"),
    )
    return insert_absent(tags, rows, ["name"])


def patch_tags(tags: DataFrame, changes: DataFrame) -> DataFrame:
    return patch(tags, changes, "tag_id", ["name", "category", "status"])


def batch_tags(slide_tags: DataFrame, pages: DataFrame, tag_id) -> DataFrame:
    """Tags pages by hand; pages that carry the tag already keep its origin."""
    rows = pages.select(
        "slide_id", F.lit(tag_id).alias("tag_id"), F.lit("manual").alias("origin"),
        F.lit(None).cast("double").alias("confidence"), F.lit(True).alias("is_confirmed"),
    )
    return insert_absent(slide_tags, rows, ["slide_id", "tag_id"])


def remove_slide_tags(slide_tags: DataFrame, gone: DataFrame) -> DataFrame:
    return remove_keys(slide_tags, gone, ["slide_id", "tag_id"])


def add_favorites(favorites: DataFrame, rows: DataFrame) -> DataFrame:
    return insert_absent(favorites, rows.select("user_id", "slide_id", "created_at"), ["user_id", "slide_id"])


def remove_favorites(favorites: DataFrame, gone: DataFrame) -> DataFrame:
    return remove_keys(favorites, gone, ["user_id", "slide_id"])


def soft_delete(presentations: DataFrame, wanted: DataFrame, at, *, user_id=None, superuser=False) -> DataFrame:
    """Moves permitted, still live files to the trash at time ``at``."""
    marked = wanted.select("presentation_id").distinct().withColumn("_del", F.lit(True))
    hit = F.coalesce(F.col("_del"), F.lit(False)) & modifiable_by(user_id, superuser) & F.col("deleted_at").isNull()
    return (
        presentations.join(marked, "presentation_id", "left")
        .withColumn("deleted_at", F.when(hit, F.lit(at).cast("timestamp")).otherwise(F.col("deleted_at")))
        .drop("_del")
    )


def deleted_count(presentations: DataFrame, wanted: DataFrame, *, user_id=None, superuser=False) -> DataFrame:
    """How many of the wanted files a soft delete moves."""
    hit = live(presentations).filter(modifiable_by(user_id, superuser)).join(wanted.select("presentation_id"), "presentation_id", "left_semi")
    return hit.agg(F.count(F.lit(1)).alias("processed"))


def restore(presentations: DataFrame, wanted: DataFrame, *, user_id=None, superuser=False) -> DataFrame:
    marked = wanted.select("presentation_id").distinct().withColumn("_back", F.lit(True))
    hit = F.coalesce(F.col("_back"), F.lit(False)) & modifiable_by(user_id, superuser)
    return (
        presentations.join(marked, "presentation_id", "left")
        .withColumn("deleted_at", F.when(hit, F.lit(None).cast("timestamp")).otherwise(F.col("deleted_at")))
        .drop("_back")
    )


def hard_delete(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Removes files and all that hangs on them.

    ``tables``: presentations, versions, slides and any of slide_tags, favorites, matches, jobs.
    """
    out = dict(tables)
    doomed = gone.select("presentation_id").distinct()
    dead_versions = tables["versions"].join(doomed, "presentation_id", "left_semi").select("version_id")
    dead_slides = tables["slides"].join(dead_versions, "version_id", "left_semi").select("slide_id")
    for name in ("slide_tags", "favorites"):
        if name in tables:
            out[name] = tables[name].join(dead_slides, "slide_id", "left_anti")
    if "matches" in tables:
        kept = tables["matches"]
        for end in ("from_slide_id", "to_slide_id"):
            kept = kept.join(dead_slides.select(F.col("slide_id").alias(end)), end, "left_anti")
        out["matches"] = kept.select(*tables["matches"].columns)
    out["slides"] = tables["slides"].join(dead_versions, "version_id", "left_anti")
    if "jobs" in tables:
        out["jobs"] = tables["jobs"].join(
            dead_versions.select(F.lit("version").alias("target_type"), F.col("version_id").alias("target_id")), ["target_type", "target_id"], "left_anti"
        )
    out["versions"] = tables["versions"].join(doomed, "presentation_id", "left_anti")
    out["presentations"] = tables["presentations"].join(doomed, "presentation_id", "left_anti")
    return out


def empty_trash(tables: dict[str, DataFrame], *, user_id=None, superuser=False) -> dict[str, DataFrame]:
    """Hard delete of the caller's trash; of everyone's for a superuser."""
    gone = trashed(tables["presentations"]).filter(modifiable_by(user_id, superuser))
    return hard_delete(tables, gone)


def folder_delete(folders: DataFrame, presentations: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(folders, presentations) without the folders; their files fall out of any folder."""
    marked = gone.select("folder_id").distinct()
    flagged = presentations.join(marked.withColumn("_gone", F.lit(True)), "folder_id", "left")
    freed = flagged.withColumn("folder_id", F.when(F.col("_gone").isNull(), F.col("folder_id")))
    return folders.join(marked, "folder_id", "left_anti"), freed.select(*presentations.columns)


def set_current(presentations: DataFrame, versions: DataFrame, wanted: DataFrame, *, user_id=None, superuser=False) -> DataFrame:
    """Switches the current version where it belongs to the file and the caller may change the file."""
    owned = wanted.join(versions.select("presentation_id", "version_id"), ["presentation_id", "version_id"], "left_semi")
    chosen = owned.groupBy("presentation_id").agg(F.max("version_id").alias("_chosen"))
    switch = F.col("_chosen").isNotNull() & modifiable_by(user_id, superuser)
    return (
        presentations.join(chosen, "presentation_id", "left")
        .withColumn("current_version_id", F.when(switch, F.col("_chosen")).otherwise(F.col("current_version_id")))
        .drop("_chosen")
    )


def patch_slides(slides: DataFrame, changes: DataFrame, presentations: DataFrame, versions: DataFrame, *, user_id=None, superuser=False) -> DataFrame:
    """Title and notes of pages whose file the caller may change."""
    files = presentations.filter(modifiable_by(user_id, superuser)).select("presentation_id")
    allowed = slides.select("slide_id", "version_id").join(
        versions.select("version_id", "presentation_id").join(files, "presentation_id", "left_semi"), "version_id", "left_semi"
    )
    return patch(slides, changes.join(allowed, "slide_id", "left_semi"), "slide_id", ["title", "manual_summary", "user_note"])


def patch_presentations(presentations: DataFrame, changes: DataFrame, *, user_id=None, superuser=False) -> DataFrame:
    """Title, folder and visibility of files the caller may change; an unknown visibility is refused."""
    valid = changes
    if "visibility" in changes.columns:
        valid = valid.filter(F.col("visibility").isNull() | F.col("visibility").isin("team", "private"))
    allowed = presentations.filter(modifiable_by(user_id, superuser)).select("presentation_id")
    return patch(presentations, valid.join(allowed, "presentation_id", "left_semi"), "presentation_id", ["title", "folder_id", "visibility"])
