"""Packing of two 32-bit numbers into one 64-bit number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_LOW = 0xFFFFFFFF


def pack(high: Column, low: Column) -> Column:
    """The high number in the upper half, the low 32 bits of the other in the lower."""
    return F.shiftleft(high.cast("long"), 32).bitwiseOR(low.cast("long").bitwiseAND(F.lit(_LOW)))


def high(packed: Column) -> Column:
    """Upper half, signed."""
    return F.shiftright(packed, 32)


def low(packed: Column) -> Column:
    """Lower half, unsigned."""
    return packed.bitwiseAND(F.lit(_LOW))
