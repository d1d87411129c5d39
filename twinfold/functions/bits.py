"""64-bit fingerprints held in a BIGINT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def median_bits(values: Column, length: int = 64) -> Column:
    """Bit i is set where item i exceeds the median; the first item is the highest bit."""
    doubles = F.transform(values, lambda x: x.cast("double"))
    ordered = F.sort_array(doubles)
    median = (F.get(ordered, length // 2 - 1) + F.get(ordered, length // 2)) / 2
    fold = lambda acc, x: F.shiftleft(acc, 1).bitwiseOR(F.when(x > median, F.lit(1)).otherwise(F.lit(0)).cast("bigint"))
    bits = F.aggregate(doubles, F.lit(0).cast("bigint"), fold)
    return F.when(F.size(values) == length, bits)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def to_hex(bits: Column) -> Column:
    """16 lower-case hex digits."""
    return F.lpad(F.lower(F.hex(bits)), 16, "0")


def from_hex(digits: Column) -> Column:
    return F.conv(digits, 16, -10).cast("bigint")


def field(bits: Column, offset: int, width: int) -> Column:
    """``width`` bits from ``offset``, counted from the lowest."""
    shifted = F.shiftrightunsigned(bits, offset) if offset else bits
    return shifted if width == 64 else shifted.bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))
