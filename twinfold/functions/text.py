"""Text cleaning and tokenising, as expressions that stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from twinfold.fixed_values import ENGLISH_STOP_WORDS, SPACE_CHARS, WORD_CHARS


def decode_utf8(content: Column) -> Column:
    """Binary to text, leaving out bytes that are not UTF-8.

    A replacement character that is really in the file becomes a space, which is what cleaning would make
    of it; after that every replacement character left was put there for a bad byte.
    """
    raw = F.replace(content.cast("string"), F.lit("�"), F.lit(" "))
    return F.replace(F.make_valid_utf8(raw), F.lit("�"), F.lit(""))


def clean(text: Column) -> Column:
    """Lower case; anything but word characters and white space becomes a space."""
    return F.regexp_replace(F.lower(text), f"[^{WORD_CHARS}{SPACE_CHARS}]", " ")


def has_text(text: Column) -> Column:
    """Whether ``extracted_text`` of it is a text, without cleaning it."""
    return text.rlike(f"[^{SPACE_CHARS}]")


def extracted_text(text: Column, max_chars: int | None = None) -> Column:
    """Cleaned text of a file, null when it is blank. The whole text counts unless a cap is asked for."""
    raw = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    if max_chars is not None:
        raw = F.substring(raw, 1, max_chars)
    return F.when(has_text(raw), clean(raw))


def all_tokens(text: Column) -> Column:
    """Runs of two or more word characters, in order, repeats kept."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"[{WORD_CHARS}]{{2,}}"), F.lit(0))


def tokens(text: Column, stop_words: Sequence[str] = ENGLISH_STOP_WORDS) -> Column:
    words = all_tokens(text)
    if not stop_words:
        return words
    return F.filter(words, lambda w: ~w.isin(list(stop_words)))
