"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws an exponential key whose rate is its quality weight: -ln(u) / weight, with u from a digest of its
doc_id, so that reruns agree. Sorted by key within a source, a prefix of the documents is a weighted sample without replacement, and
the prefix sum of sizes says where the token budget ends. A target above its source's size is met by complete epochs first;
the remainder is a prefix.

Targets: sources in code-point order, null last, weigh ``SOURCE_WEIGHTS`` in turn and share ``SHARE`` of all sizes by weight.
No target exceeds ``MOST`` times its source's size; what is above goes to the others by weight, until none is above.

Prefix sums run over range partitions (``running.py``), so a source may hold any share of the rows. The only window
over one partition has one row per source.

Defined results: a null or empty text has size 0 and is never in the way of others (taken 0). Documents of equal key
and id are taken in order of size; repeated rows are separate documents. All rows come out, taken or not. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from twinfold.llm.common import WORD
from twinfold.llm.running import sums_before
from twinfold.session import stage

SOURCE_WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SYMBOLS = "#*$%&|<>"


def word_count(text: Column) -> Column:
    return F.coalesce(F.length(F.regexp_replace(text, WORD, "x")) - F.length(F.regexp_replace(text, WORD, "")), F.lit(0)).cast("bigint")


def quality_weight(text: Column, size: Column) -> Column:
    """Words per word and symbol character: 1 for plain prose, small for symbol junk."""
    symbols = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), f"[^{SYMBOLS}]+", ""))
    return F.when(size == 0, F.lit(1.0)).otherwise(size.cast("double") / (size + symbols))


def sampling_key(doc_id: Column, weight: Column) -> Column:
    digest = F.md5(F.concat(F.lit("mix:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") + 0.5) / float(1 << 52)
    return -F.log(u) / weight


def source_targets(rows: DataFrame, weights: tuple[int, ...] = SOURCE_WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from rows with source and size; one row per source."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    weighed = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(most))
    # Sources that reach their cap come first by cap / weight. level: what a unit of weight gets if exactly those before are at
    # their cap. It rises while the next one is capped and falls afterwards, so its maximum is the final level.
    by_ratio = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    free = F.sum("source_size").over(everything) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    levels = weighed.withColumn("level", free / left)
    level = F.max("level").over(everything)
    return levels.select("source", "source_size", F.least(F.col("cap"), F.col("weight") * level).alias("target"))


def mix(
    rows: DataFrame, weights: tuple[int, ...] = SOURCE_WEIGHTS, share: float = SHARE, most: int = MOST, extra: tuple[str, ...] = ()
) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) from rows with doc_id, source, size and a positive weight.

    Columns named in ``extra`` are handed through.
    """
    keyed = rows.select(
        "doc_id", "source", "size", *extra, sampling_key(F.col("doc_id"), F.col("weight")).alias("key"),
        F.monotonically_increasing_id().alias("row"),
    )
    keyed = stage(keyed, "keyed")
    placed = sums_before(keyed, "source", ["key", "doc_id", "size", "row"], "size", "before")
    targets = source_targets(keyed, weights, share, most).withColumnRenamed("source", "_source")
    met = placed.join(targets, F.col("source").eqNullSafe(F.col("_source")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    budget = F.col("target") - F.col("epochs") * F.col("source_size")
    chosen = (F.col("budget") > 0) & (2 * F.col("before") + F.col("size") <= 2 * F.col("budget"))
    counted = met.withColumn("epochs", epochs.cast("bigint")).withColumn("budget", budget)
    return counted.select(
        "doc_id", "size", "source_size", "target",
        (F.col("size") * (F.col("epochs") + chosen.cast("bigint"))).cast("bigint").alias("taken"),
        (F.col("epochs") + chosen.cast("bigint")).alias("copies"), *extra,
    )


def mixture(docs: DataFrame, weights: tuple[int, ...] = SOURCE_WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``mix`` over documents (doc_id, source, text), weighed by ``quality_weight``."""
    size = F.col("size")
    sized = docs.select("doc_id", "source", "text", word_count(F.col("text")).alias("size"))
    return mix(sized.select("doc_id", "source", "size", quality_weight(F.col("text"), size).alias("weight")), weights, share, most)
