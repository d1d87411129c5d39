"""Small tables with the odd rows that every operator has to take."""

from __future__ import annotations

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that operators use for columns of their own.
CLASHING = (
    "score string, size string, words string, n_words string, kept string, taken string, key string, row string, node string, spans string, "
    "label string, rejected string, features string, items string, before string, target string, copies string, _hash string"
)


_LETTERS = str.maketrans("0123456789", "abcdefghij")


def plain_text(seed: int, words: int = 60) -> str:
    numbers = ((seed * 7919 + i * i * 31 + i) % 9973 for i in range(words))
    return " ".join(f"w{n}x{seed % 13}" for n in numbers).translate(_LETTERS)


def odd_rows() -> list[tuple]:
    long = " ".join(f"long{i % 7001}y{i % 13}" for i in range(60_000))
    rows = [(i, plain_text(i), "en", f"s{i % 3}", 10) for i in range(12)]
    rows += [
        (12, None, "en", "s0", None),
        (13, "", None, None, 0),
        (14, " \t\n ", "de", "s1", 4),
        (15, long, "fr", "s1", len(long)),
        (16, plain_text(3), "en", "s2", 10),  # a copy of 3
        (16, plain_text(3), "en", "s2", 10),  # and the row again
        (None, plain_text(77), None, None, None),
        (None, None, None, None, None),
        (17, "one", "es", "s0", 3),
    ]
    return rows


def with_clashes(df):
    """``df`` with extra columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    names = [part.split()[0] for part in CLASHING.split(", ")]
    return df.select("*", *[F.lit(f"x-{n}").alias(n) for n in names if n not in df.columns])
