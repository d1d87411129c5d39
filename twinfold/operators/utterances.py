"""Labelling a log of user questions: intent, parameters, and the query each would run.

Input is (id, text). Everything is one projection: no shuffle, no Python in the tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinfold.fixed_values import (
    DEFAULT_INTENT,
    INTENT_PATTERNS,
    KEYWORD_STOP_WORDS,
    KEYWORD_TOKENS,
    KNOWN_FILE_TYPES,
    NOT_USER_NAMES,
    SIZE_PATTERN,
    SIZE_UNITS,
    SPACE_CHARS,
    TWO_USER_PATTERNS,
    USER_PATTERNS,
    WORD_CHARS,
)

# the patterns mean word characters, digits and spaces of any script
_ANY_SCRIPT = "(?U)"
_TOO_LARGE = 2.0**63  # the least number of bytes that is no BIGINT


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{SPACE_CHARS}]+|[{SPACE_CHARS}]+$", "")


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), f"[^{WORD_CHARS}]+"), lambda w: w != "")


def _group(text: Column, pattern: str, group: int) -> Column:
    """A capture group of the first match, null without a match."""
    found = F.regexp_extract(text, _ANY_SCRIPT + pattern, group)
    return F.when(text.rlike(_ANY_SCRIPT + pattern), found)


def intent(text: Column) -> Column:
    """The first pattern found decides; null for a blank text."""
    low = F.lower(_trimmed(text))
    cases = F.when(low == "", F.lit(None).cast("string"))
    for pattern, label in INTENT_PATTERNS:
        cases = cases.when(low.rlike(_ANY_SCRIPT + pattern), label)
    return cases.otherwise(DEFAULT_INTENT)


def size_bytes(text: Column) -> Column:
    """'500 kb' as a number of bytes, cut off to a whole number; null without a size, or with one beyond BIGINT."""
    low = F.lower(text)
    unit = _group(low, SIZE_PATTERN, 2)
    factor = reduce(lambda c, u: c.when(unit == u, SIZE_UNITS[u]), SIZE_UNITS, F.when(F.lit(False), 0))
    number = _group(low, SIZE_PATTERN, 1).try_cast("double")
    return F.when(number * factor < _TOO_LARGE, (number * factor).cast("bigint"))


def file_type(text: Column) -> Column:
    """The first word that is a known type, a plural ``s`` taken off."""
    one = lambda w: F.when(w.isin(KNOWN_FILE_TYPES), w).when(
        w.endswith("s") & F.regexp_replace(w, "s$", "").isin(KNOWN_FILE_TYPES), F.regexp_replace(w, "s$", "")
    )
    return F.get(F.filter(F.transform(_words(text), one), lambda w: w.isNotNull()), 0)


def user_name(text: Column, patterns: Sequence[str] = USER_PATTERNS) -> Column:
    """The first pattern whose match is not an everyday word."""
    low = F.lower(text)
    names = [_group(low, p, 1) for p in patterns]
    return F.coalesce(*[F.when(~n.isin(NOT_USER_NAMES), n) for n in names])


def two_users(text: Column) -> tuple[Column, Column]:
    low = F.lower(text)
    return tuple(F.coalesce(*[_group(low, p, g) for p in TWO_USER_PATTERNS]) for g in (1, 2))


def keyword(text: Column) -> Column:
    """Up to five words that are not stop words; the trimmed text if none are left."""
    kept = F.filter(_words(text), lambda w: ~w.isin(KEYWORD_STOP_WORDS))
    return F.when(F.size(kept) > 0, F.array_join(F.slice(kept, 1, KEYWORD_TOKENS), " ")).otherwise(_trimmed(text))


def utterance_intents(log: DataFrame) -> DataFrame:
    return log.select("id", "text", intent(F.col("text")).alias("intent"))


def intent_counts(log: DataFrame) -> DataFrame:
    return utterance_intents(log).groupBy("intent").agg(F.count(F.lit(1)).alias("n"))


def utterance_parameters(log: DataFrame) -> DataFrame:
    """(id, text, intent, min_bytes, file_type, user_name, user1, user2, keyword)."""
    text = F.col("text")
    user1, user2 = two_users(text)
    return log.select(
        "id", "text", intent(text).alias("intent"), size_bytes(text).alias("min_bytes"),
        file_type(text).alias("file_type"), user_name(text).alias("user_name"),
        user1.alias("user1"), user2.alias("user2"), keyword(text).alias("keyword"),
    )


def utterance_routed(log: DataFrame) -> DataFrame:
    """(id, intent, resolved, param1, param2): the query that answers each text, with its parameters.

    An intent whose parameter is missing becomes a keyword search. Questions about copies of two users fall
    back to one user, then to all.
    """
    needs = {"by_type": "file_type", "by_user": "user_name", "by_size_gt": "min_bytes"}
    missing = reduce(
        lambda a, b: a | b, [(F.col("intent") == i) & F.col(p).isNull() for i, p in needs.items()]
    )
    rows = utterance_parameters(log).withColumn(
        "resolved", F.when(F.col("intent").isNull(), F.col("intent")).when(missing, DEFAULT_INTENT).otherwise(F.col("intent"))
    )
    is_ = lambda name: F.col("resolved") == name
    both = F.col("user1").isNotNull() & F.col("user2").isNotNull()
    param1 = (
        F.when(is_("by_type"), F.col("file_type"))
        .when(is_("by_user"), F.col("user_name"))
        .when(is_("by_size_gt"), F.col("min_bytes").cast("string"))
        .when(is_("cross_user_dups"), F.when(both, F.col("user1")).otherwise(F.col("user_name")))
        .when(is_("search"), F.col("keyword"))
    )
    return rows.select(
        "id", "intent", "resolved", param1.alias("param1"),
        F.when(is_("cross_user_dups") & both, F.col("user2")).alias("param2"),
    )
