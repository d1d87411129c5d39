"""The registry of distinct files: building it, adding to it, searching it.

Searches return whole results, sorted. ``preview`` is the one report with a row limit.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinfold.fixed_values import PREVIEW_ROWS
from twinfold.functions.hashing import is_text
from twinfold.functions.matching import contains_like, date_range
from twinfold.functions.text import extracted_text
from twinfold.operators.exact import with_original
from twinfold.operators.skew import largest_of, lookup_join
from twinfold.session import stage

_LIST = ["file_name", "file_type", "downloaded_by", "download_time", "file_path"]
_FOUND = ["file_name", "file_path", "downloaded_by", "download_time"]
_SIZED = ["file_name", "file_type", "file_size", "downloaded_by", "download_time", "file_path"]


# ---- building and adding -----------------------------------------------------------------------


def describe_text(observations: DataFrame, content: str = "content", max_chars: int | None = None) -> DataFrame:
    """Replace ``content`` by ``extracted_text``: cleaned, for text types only, null when blank."""
    text = F.when(is_text(F.col("file_type")), extracted_text(F.col(content), max_chars))
    return observations.withColumn("extracted_text", text).drop(content)


def first_sightings(observations: DataFrame) -> DataFrame:
    """The earliest observation of each digest.

    Digests, times and ids are staged, so contents are hashed once for them. What is left out, the later copies, is the smaller
    part; the wide rows are only met by its ids.
    """
    seen = stage(observations.select("file_hash", "download_time", "id"), "seen")
    table = seen.groupBy("file_hash").agg(F.min(F.struct("download_time", "id"))["id"].alias("head"), F.count(F.lit(1)).alias("n"))
    several = stage(table.where("n > 1"), "several")
    later = lookup_join(seen, several, "file_hash", "n", "id", largest_of(several, "n")).where("id <> head").select("id")
    return observations.join(stage(later, "later"), "id", "left_anti")


def insert_new(new: DataFrame, registry: DataFrame) -> DataFrame:
    """``new`` with ``accepted``: true for the first sighting of a digest the registry does not hold."""
    return new.join(with_original(new, registry).select("id", "accepted"), "id")


def corpus_scan(registry: DataFrame) -> DataFrame:
    """(id, arrived, extracted_text) of the files that have text."""
    return registry.where("extracted_text IS NOT NULL AND extracted_text <> ''").select(
        "id", F.col("download_time").alias("arrived"), "extracted_text"
    )


# ---- searches ----------------------------------------------------------------------------------


def _newest_first(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select("id", *columns).orderBy(F.desc("download_time"), F.desc("id"))


def list_all(registry: DataFrame) -> DataFrame:
    return _newest_first(registry, _LIST)


def search_keyword(registry: DataFrame, keyword: str) -> DataFrame:
    """Files with the keyword in their name or their text."""
    found = contains_like(F.col("file_name"), keyword) | contains_like(F.col("extracted_text"), keyword)
    return _newest_first(registry.where(found), _FOUND)


def search_type(registry: DataFrame, file_type: str) -> DataFrame:
    """Files whose type contains the given one, so ``doc`` finds ``docx`` too."""
    return _newest_first(registry.where(contains_like(F.col("file_type"), file_type)), _LIST)


def search_user(registry: DataFrame, user: str) -> DataFrame:
    return _newest_first(registry.where(contains_like(F.col("downloaded_by"), user)), _LIST)


def search_dates(registry: DataFrame, start: str | Column, end: str | Column) -> DataFrame:
    """Files with download_time in [start, end)."""
    as_time = lambda v: F.lit(v).cast("timestamp_ntz") if isinstance(v, str) else v
    time = F.col("download_time")
    return _newest_first(registry.where((time >= as_time(start)) & (time < as_time(end))), _LIST)


def search_preset(registry: DataFrame, preset: str, as_of: dt.date | str) -> DataFrame:
    return search_dates(registry, *date_range(preset, as_of))


def search_size(registry: DataFrame, min_bytes: int = 0, max_bytes: int = -1) -> DataFrame:
    """Files of at least ``min_bytes``, and at most ``max_bytes`` unless that is negative; biggest first."""
    size = F.col("file_size")
    kept = registry.where(size >= min_bytes)
    if max_bytes >= 0:
        kept = kept.where(size <= max_bytes)
    return kept.select("id", *_SIZED).orderBy(F.desc("file_size"), F.desc("id"))


def preview(result: DataFrame, *order: Column, rows: int = PREVIEW_ROWS) -> DataFrame:
    """The first rows of a result, each with ``more``: how many follow after them."""
    total = result.agg(F.count(F.lit(1))).scalar()
    more = F.greatest(total - rows, F.lit(0)).cast("bigint")
    return result.orderBy(*order).limit(rows).withColumn("more", more)
