"""Which pages a user searches, and the row predicates around it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.functions.text import is_blank
from pagelake.session import stored


def visible_to(user_id: int | str | None, superuser: bool = False) -> Column:
    """Shared files plus the user's own; everything for superusers and for system calls."""
    if superuser or user_id is None:
        return F.lit(True)
    return (F.col("visibility") == "team") | (F.col("owner_id") == user_id)


def modifiable_by(user_id: int | str | None, superuser: bool = False) -> Column:
    return F.lit(True) if superuser else F.coalesce(F.col("owner_id") == user_id, F.lit(False))


def live(presentations: DataFrame) -> DataFrame:
    return presentations.filter(F.col("deleted_at").isNull())


def trashed(presentations: DataFrame) -> DataFrame:
    return presentations.filter(F.col("deleted_at").isNotNull())


def scoped_versions(
    presentations: DataFrame,
    versions: DataFrame,
    user_id: int | str | None = None,
    superuser: bool = False,
    include_historical: bool = False,
) -> DataFrame:
    """(version_id, presentation_id, presentation_title) the caller may see."""
    allowed = live(presentations).filter(visible_to(user_id, superuser)).select(
        "presentation_id", F.col("title").alias("presentation_title"), "current_version_id"
    )
    if include_historical:
        return versions.select("version_id", "presentation_id").join(allowed, "presentation_id").drop("current_version_id")
    return allowed.withColumnRenamed("current_version_id", "version_id")


def scoped_slides(
    slides: DataFrame,
    presentations: DataFrame,
    versions: DataFrame,
    user_id: int | str | None = None,
    superuser: bool = False,
    include_historical: bool = False,
) -> DataFrame:
    """Pages of live, visible presentations, current versions only unless told otherwise.

    The version side is left unhinted, but written first: Spark then knows its size before it plans the join, and broadcasts
    it when that allows, so that no page is shuffled to find out.
    """
    scope = stored(scoped_versions(presentations, versions, user_id, superuser, include_historical), "scope")
    return slides.join(scope, "version_id")


def any_tag(slides: DataFrame, slide_tags: DataFrame, tag_ids: list) -> DataFrame:
    """Pages carrying at least one of the tags; all pages when none is asked for."""
    if not tag_ids:
        return slides
    wanted = slide_tags.filter(F.col("tag_id").isin(*tag_ids)).select("slide_id")
    return slides.join(wanted, "slide_id", "left_semi")


def favorites_of(favorites: DataFrame, user_id: int | str) -> DataFrame:
    return favorites.filter(F.col("user_id") == user_id).select("slide_id").distinct()


def text_bearing(slides: DataFrame) -> DataFrame:
    return slides.filter(~is_blank(F.col("native_text")))
