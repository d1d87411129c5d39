"""Exact duplicates: equal content digests.

Sightings are rows (id, file_hash, file_name, file_path, file_size, downloaded_by, download_time). Arrival
order is (download_time, id). The few columns needed are staged first, so that contents are read and hashed
once. A digest that a large share of the rows carries is reduced by partial
aggregates before any shuffle, and looked up by ``lookup_join``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinfold.functions.matching import contains_like
from twinfold.operators.skew import largest_of, lookup_join
from twinfold.session import Keep, stage

_FILE = ["id", "file_name", "file_path", "downloaded_by", "download_time"]


def find_by_hash(registry: DataFrame, digest: str | Column) -> DataFrame:
    """The registry row with this digest, or none; digests are unique in a registry."""
    return registry.where(F.col("file_hash") == (F.lit(digest) if isinstance(digest, str) else digest))


def originals(new: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """(file_hash, original, sightings) for every digest in ``new``.

    ``original`` is the registry row where there is one, else the earliest new row; ``original.known`` is 0 for
    a registry row. ``sightings`` counts the new rows.
    """
    # the order of the fields is the order of comparison
    row = lambda known: F.struct(F.lit(known).alias("known"), "download_time", "id", "file_name", "file_path", "downloaded_by")
    found = new.select("file_hash", row(1).alias("row"), F.lit(1).alias("n"))
    if registry is not None:
        registry = registry.join(new.select("file_hash").distinct(), "file_hash", "left_semi")  # new files are the few
        found = found.union(registry.select("file_hash", row(0).alias("row"), F.lit(0).alias("n")))
    groups = found.groupBy("file_hash").agg(F.min("row").alias("original"), F.sum("n").alias("sightings"))
    return groups.where("sightings > 0") if registry is not None else groups


def with_original(new: DataFrame, registry: DataFrame | None = None, keep: Keep = stage) -> DataFrame:
    """The rows of ``new`` with ``original`` and ``accepted``: true for the one row that enters the registry."""
    new = keep(new.select("file_hash", *_FILE), "sightings")
    table = keep(originals(new, registry), "originals")
    found = lookup_join(new, table, "file_hash", "sightings", "id", largest_of(table, "sightings"))
    first = (F.col("original.known") == 1) & (F.col("original.id") == F.col("id"))
    return found.withColumn("accepted", first)


def exact_dup_alerts(new: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """One alert row per new file whose content is known already, with the provenance of the original."""
    return exact_alerts(with_original(new, registry))


def exact_alerts(verdicts: DataFrame) -> DataFrame:
    """Alert rows from the result of ``with_original``."""
    seen = verdicts.where("NOT accepted")
    return seen.select(
        F.col("id").alias("new_id"),
        F.col("downloaded_by").alias("alert_for"),
        F.lit("exact").alias("duplicate_type"),
        F.lit(1.0).alias("similarity"),
        F.col("file_name").alias("new_file_name"),
        F.col("file_path").alias("new_file_path"),
        F.col("original.file_name").alias("original_file"),
        F.col("original.file_path").alias("original_path"),
        F.coalesce("original.downloaded_by", F.lit("")).alias("original_user"),
        F.col("original.download_time").alias("original_time"),
        F.col("original.id").alias("original_id"),
        F.col("download_time").alias("created_time"),
    )


# ---- copies held by different users ------------------------------------------------------------


def _holders(sightings: DataFrame, user1: str, user2: str) -> DataFrame:
    """(file_hash, downloaded_by, n, is_1, is_2): the known users of each digest, their copies, and whom they match."""
    like = lambda user: contains_like(F.col("downloaded_by"), user) if user else F.lit(True)
    held = sightings.where("downloaded_by IS NOT NULL").groupBy("file_hash", "downloaded_by")
    return held.agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("download_time", "id")).alias("first")).withColumns(
        {"is_1": like(user1), "is_2": like(user2)}
    )


def cross_user_members(sightings: DataFrame, user1: str = "", user2: str = "") -> DataFrame:
    """Every file that is one of a pair of copies held by different users; the pairs follow from these rows.

    With ``user1`` one of the pair must match it; with both names one must match the first and the other the second. A digest
    with n copies gives at most n rows, though it may have n * (n - 1) / 2 pairs, which ``cross_user_totals`` counts.
    ``users``, ``copies_by_others`` and ``first_id`` (the earliest of all) are of the whole digest. A file of an unknown user is
    in no pair.
    """
    rows = stage(sightings.select("file_hash", "id", "file_name", "downloaded_by", "download_time"), "sightings")
    holders = stage(_holders(rows, user1, user2), "holders")
    count = lambda condition: F.count_if(F.expr(condition))
    digests = holders.groupBy("file_hash").agg(
        F.count(F.lit(1)).alias("users"), F.sum("n").alias("copies"), F.min("first")["id"].alias("first_id"),
        count("is_1").alias("users_1"), count("is_2").alias("users_2"),
    )
    known = stage(digests.where("users > 1").withColumn("held", F.col("users")), "digests")
    shared = lookup_join(holders, known, "file_hash", "held", "downloaded_by", largest_of(known, "held"))
    one = lambda flag: F.col(flag).cast("int")
    if user1 and user2:
        paired = (F.col("is_1") & (F.col("users_2") > one("is_2"))) | (F.col("is_2") & (F.col("users_1") > one("is_1")))
    else:
        paired = F.col("is_1") | (F.col("users_1") > 0)
    holder = F.struct("file_hash", "downloaded_by").alias("holder")
    found = stage(
        shared.where(paired).select(holder, "users", (F.col("copies") - F.col("n")).alias("copies_by_others"), "first_id", "n"), "members"
    )
    met = lookup_join(rows.withColumn("holder", holder), found, "holder", "n", "id", largest_of(found, "n"))
    return met.drop("holder")


def cross_user_totals(sightings: DataFrame, user1: str = "", user2: str = "") -> DataFrame:
    """(file_hash, users, copies, pairs): how many pairs of copies by different users each digest has.

    The names restrict the pairs as in ``cross_user_members``; ``users`` and ``copies`` are of the whole digest.
    """
    total = lambda condition: F.sum(F.when(F.expr(condition), F.col("n")).otherwise(0))
    among = lambda condition: (  # pairs of copies by different users, both users meeting the condition
        (total(condition) * total(condition) - F.sum(F.when(F.expr(condition), F.col("n") * F.col("n")).otherwise(0))) / 2
    )
    if user1 and user2:
        only_1, only_2, both = "is_1 AND NOT is_2", "is_2 AND NOT is_1", "is_1 AND is_2"
        pairs = total(only_1) * total(only_2) + (total(only_1) + total(only_2)) * total(both) + among(both)
    else:
        pairs = among("true") - among("NOT is_1")
    groups = _holders(sightings, user1, user2).groupBy("file_hash")
    counted = groups.agg(F.count(F.lit(1)).alias("users"), F.sum("n").alias("copies"), pairs.cast("bigint").alias("pairs"))
    return counted.where("pairs > 0")


# ---- group report ------------------------------------------------------------------------------


def duplicate_groups(sightings: DataFrame) -> DataFrame:
    """One row per content held more than once: files, users, first and last seen, bytes that copies waste."""
    per_user = sightings.groupBy("file_hash", "downloaded_by").agg(
        F.count(F.lit(1)).alias("n"), F.sum("file_size").alias("bytes"), F.min("file_size").alias("one"),
        F.min("download_time").alias("first_seen"), F.max("download_time").alias("last_seen"),
    )
    return (
        per_user.groupBy("file_hash")
        .agg(
            F.sum("n").alias("files"), F.count("downloaded_by").alias("users"),
            F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
            (F.sum("bytes") - F.min("one")).alias("wasted_bytes"),
        )
        .where("files > 1")
    )


def duplicate_report(sightings: DataFrame) -> DataFrame:
    """One row: duplicate groups, files in them, surplus files, wasted bytes, largest group."""
    return duplicate_groups(sightings).agg(
        F.count(F.lit(1)).alias("duplicate_groups"),
        F.coalesce(F.sum("files"), F.lit(0)).alias("files_in_groups"),
        F.coalesce(F.sum(F.col("files") - 1), F.lit(0)).alias("total_duplicates"),
        F.coalesce(F.sum("wasted_bytes"), F.lit(0)).alias("wasted_bytes"),
        F.max("files").alias("largest_group"),
    )
