"""Name matching, and the date ranges users ask for."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_NO_ESCAPE = "\x01"


def contains_like(value: Column, text: str) -> Column:
    """``value LIKE '%text%'`` folding ASCII case only; ``%`` and ``_`` in ``text`` stay wildcards."""
    fold = lambda c: F.translate(c, _UPPER, _UPPER.lower())
    pattern = "".join(ch.lower() if ch in _UPPER else ch for ch in f"%{text}%")
    return F.call_function("like", fold(value), F.lit(pattern), F.lit(_NO_ESCAPE))


def date_range(preset: str, as_of: dt.date | str) -> tuple[Column, Column]:
    """Half-open (start, end) of ``today``, ``yesterday``, ``week``, ``month`` or ``last_month``.

    ``week`` starts on Monday; ``week`` and ``month`` end with the day ``as_of``.
    """
    day = F.lit(as_of).cast("date")
    first = F.trunc(day, "month")
    ranges = {
        "today": (day, F.date_add(day, 1)),
        "yesterday": (F.date_sub(day, 1), day),
        "week": (F.trunc(day, "week"), F.date_add(day, 1)),
        "month": (first, F.date_add(day, 1)),
        "last_month": (F.add_months(first, -1), first),
    }
    start, end = ranges[preset]
    return start.cast("timestamp_ntz"), end.cast("timestamp_ntz")
