"""Integers and floats as the binary format stores them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def from_sign_magnitude(x: Column, bits: int) -> Column:
    """The value of an unsigned integer whose highest bit is a sign and whose other bits are a magnitude."""
    top = 1 << (bits - 1)
    return F.when(x >= top, top - x).otherwise(x)


def to_sign_magnitude(x: Column, bits: int) -> Column:
    """The unsigned integer that stores x by sign and magnitude; zero has no sign."""
    return F.when(x < 0, (1 << (bits - 1)) - x).otherwise(x)


def take_bits(x: Column, width: int, high: int, low: int) -> Column:
    """Bits ``high`` to ``low`` (counted from the most significant of ``width``, 0 first, ``low`` not included)."""
    return F.shiftright(x, width - low).bitwiseAND((1 << (low - high)) - 1)


def unsigned(content: Column, position: int | Column, octets: int) -> Column:
    """The big-endian unsigned integer of some octets of a binary, position counted from 1; null beyond its end."""
    return F.conv(F.hex(F.substring(content, position, octets) if isinstance(position, int) else content.substr(position, F.lit(octets))), 16, 10).cast("long")


def ieee_single(word: Column) -> Column:
    """The value of the 32 bits of a single-precision float; exact, as a double. Infinities and NaN come out as such."""
    sign = F.when(F.shiftright(word, 31).bitwiseAND(1) == 1, -1.0).otherwise(1.0)
    exponent, fraction = F.shiftright(word, 23).bitwiseAND(0xFF), word.bitwiseAND(0x7FFFFF).cast("double")
    normal = (1 + fraction / float(1 << 23)) * F.pow(F.lit(2.0), exponent - 127)
    return sign * F.when(exponent == 255, F.when(fraction == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))).when(exponent == 0, fraction * F.pow(F.lit(2.0), F.lit(-149))).otherwise(normal)
