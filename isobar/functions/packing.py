"""Simple packing as column expressions: Y = (R + X 2^E) 10^-D.

An encoder sets D to 0, R to the greatest single-precision number that is not above the least value, and E to the least power by which the range fits the bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def single_at_or_below(v: Column) -> Column:
    """The greatest single-precision number at or below a double. One step down is taken off where rounding went up: slightly more than half a step, rounded again (exact for normal numbers)."""
    f = v.cast("float")
    down = (f.cast("double") - F.abs(f.cast("double")) * F.lit(2.0**-24 * (1 + 2.0**-20))).cast("float")
    return F.when(f.cast("double") > v, down).otherwise(f)


def binary_scale(span: Column, most: int) -> Column:
    """The least E such that round(span 2^-E) is at most ``most``; the logarithm's guess is set right by one either way."""
    guess = F.ceil(F.log2(span) - F.log2(F.lit(float(most)))).cast("int")
    fits = lambda e: F.round(span * F.pow(F.lit(2.0), -e)) <= float(most)
    up = F.when(fits(guess), guess).otherwise(F.when(fits(guess + 1), guess + 1).otherwise(guess + 2))
    return F.when(fits(up - 1), F.when(fits(up - 2), up - 2).otherwise(up - 1)).otherwise(up)


def pack(v: Column, reference: Column, scale: Column, bits: int) -> Column:
    x = F.round((v - reference.cast("double")) * F.pow(F.lit(2.0), -scale))
    return F.greatest(F.lit(0.0), F.least(x, F.lit(float((1 << bits) - 1)))).cast("long")


def unpack(x: Column, reference: Column, scale: Column, decimal: Column | int = 0, bits: Column | int = 1) -> Column:
    """The value of a packed integer. A field of no bits holds its reference, to which D does not apply."""
    d = F.lit(decimal) if isinstance(decimal, int) else decimal
    b = F.lit(bits) if isinstance(bits, int) else bits
    r = reference.cast("double")
    return F.when(b == 0, r).otherwise((r + x * F.pow(F.lit(2.0), scale)) * F.pow(F.lit(10.0), -d))


def field_scales(points: DataFrame, field: list[str], value: str, bits: int) -> DataFrame:
    """One row per field with ``reference``, ``scale`` and ``width`` (0 for a constant field); nulls are missing points. One aggregation, summed up before its shuffle."""
    own = points.groupBy(*field).agg(F.min(value).alias("least"), F.max(value).alias("greatest"), F.count(value).alias("n"))
    r = single_at_or_below(F.col("least"))
    constant = F.col("least") == F.col("greatest")
    span = F.col("greatest") - r.cast("double")
    return own.select(*field, "n", r.alias("reference"), F.when(constant, 0).otherwise(binary_scale(F.when(~constant, span), (1 << bits) - 1)).alias("scale"), F.when(constant, 0).otherwise(bits).alias("width"))


def rank_in_field(field: list[str], order: list[str]):
    return Window.partitionBy(*field).orderBy(*order)
