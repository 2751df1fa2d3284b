"""Decoding and encoding steps on points: rows of (field key, index, value), one partition of a window per field.

A null value is a missing point. Every window is partitioned by the field, so fields are the unit of parallelism and no step needs all rows in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isobar.functions.packing import field_scales, pack, unpack


def simple_roundtrip(points: DataFrame, field: list[str], index: list[str], value: str, bits: int) -> DataFrame:
    """Packs every point of each field with its own scale and unpacks it again: adds ``reference``, ``scale``, ``width``, ``packed`` and ``unpacked``."""
    scaled = points.join(field_scales(points, field, value, bits), field)
    packed = F.when(F.col("width") == 0, F.lit(0).cast("long")).otherwise(pack(F.col(value), F.col("reference"), F.col("scale"), bits))
    return scaled.withColumn("packed", packed).withColumn("unpacked", unpack(F.col("packed"), F.col("reference"), F.col("scale"), bits=F.col("width")))


def spatial_difference(points: DataFrame, field: list[str], index: str, value: str, order: int) -> DataFrame:
    """Differences of the first or second order over the points that aren't missing; the first one or two keep their value. Adds ``diff``, null for missing points, and ``nth``, the rank among the others from 0."""
    w = Window.partitionBy(*field, F.col(value).isNull()).orderBy(index)
    v, one, two = F.col(value), F.lag(value, 1).over(w), F.lag(value, 2).over(w)
    d = v - one if order == 1 else v - 2 * one + two
    nth = F.row_number().over(w) - 1
    return points.withColumn("nth", F.when(v.isNotNull(), nth)).withColumn("diff", F.when(v.isNull(), None).when(F.col("nth") < order, v).otherwise(d))


def spatial_integrate(points: DataFrame, field: list[str], index: str, diff: str, order: int) -> DataFrame:
    """The inverse of ``spatial_difference``: one running sum per order over the points that aren't missing. Adds ``value``."""
    w = Window.partitionBy(*field, F.col(diff).isNull()).orderBy(index)
    d = F.col(diff)
    if order == 1:
        return points.withColumn("value", F.when(d.isNotNull(), F.sum(diff).over(w)))
    # With two first values a and b, the first differences are b - a, then that plus the running sum of the second ones.
    nth = F.row_number().over(w) - 1
    first = F.first(diff).over(w)
    step = F.when(nth == 0, F.lit(0)).when(nth == 1, d - first).otherwise(d)
    once = points.withColumn("step", F.when(d.isNotNull(), step)).withColumn("start", first)
    once = once.withColumn("slope", F.sum("step").over(w))
    return once.withColumn("value", F.when(d.isNotNull(), F.col("start") + F.sum("slope").over(w))).drop("step", "start", "slope")


def expand_bitmap(points: DataFrame, packed: DataFrame, field: list[str], index: str, bit: str, rank: str, value: str) -> DataFrame:
    """The value of each grid point whose bit is set, null elsewhere: the k-th set bit has the packed value of rank k (from 1). ``packed`` has the field's keys, ``rank`` and ``value``."""
    w = Window.partitionBy(*field).orderBy(index)
    ranked = points.withColumn("_rank", F.when(F.col(bit) == 1, F.sum(bit).over(w)))
    keys = [F.col(f"p.{k}") == F.col(f"v.{k}") for k in field]
    return ranked.alias("p").join(packed.alias("v"), [*keys, F.col("p._rank") == F.col(f"v.{rank}")], "left").select("p.*", F.col(f"v.{value}").alias(value)).drop("_rank")


def canonical_index(source: Column, mode: int, ni: int, nj: int) -> Column:
    """Where the point at a place in data order belongs in rows from north to south, columns from west to east. Rows that alternate are turned before the axes are."""
    along, across = (nj, ni) if mode & 0x20 else (ni, nj)
    outer, inner = F.floor(source / along).cast("long"), source % along
    if mode & 0x10:
        inner = F.when(outer % 2 == 1, along - 1 - inner).otherwise(inner)
    row, col = (inner, outer) if mode & 0x20 else (outer, inner)
    if mode & 0x80:
        col = ni - 1 - col
    if mode & 0x40:
        row = nj - 1 - row
    return row * ni + col


def run_length_decode(codes: DataFrame, field: list[str], index: str, code: str, bits: int, max_level: int) -> DataFrame:
    """Points (field, ``idx``, ``level``; null for missing) of run-length codes: a code up to ``max_level`` starts a run, those after it are digits of its length less one, the least first, in base ``2^bits - 1 - max_level``."""
    base = (1 << bits) - 1 - max_level
    w = Window.partitionBy(*field).orderBy(index)
    is_level = F.col(code) <= max_level
    runs = codes.withColumn("run", F.sum(is_level.cast("long")).over(w)).withColumn("k", F.row_number().over(Window.partitionBy(*field, "run").orderBy(index)) - 2)
    digit = F.when(is_level, F.lit(0)).otherwise(((F.col(code) - max_level - 1) * F.pow(F.lit(float(base)), F.col("k"))).cast("long"))
    one = runs.groupBy(*field, "run").agg(F.max(F.when(is_level, F.col(code))).alias("level"), (1 + F.sum(digit)).alias("length"))
    placed = one.withColumn("start", F.sum("length").over(Window.partitionBy(*field).orderBy("run")) - F.col("length"))
    return placed.select(*field, F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("idx"), F.when(F.col("level") > 0, F.col("level")).alias("level"))


def run_length_encode(points: DataFrame, field: list[str], index: str, level: str, bits: int, max_level: int) -> DataFrame:
    """The inverse: rows (field, ``run``, ``level``, ``length``, ``codes``), codes in order; null levels are coded 0."""
    base = (1 << bits) - 1 - max_level
    w = Window.partitionBy(*field).orderBy(index)
    v = points.withColumn("_level", F.coalesce(level, F.lit(0)).cast("long"))
    changed = F.coalesce(F.lag("_level").over(w) != F.col("_level"), F.lit(True))
    runs = v.withColumn("_new", changed.cast("long")).withColumn("run", F.sum("_new").over(w)).groupBy(*field, "run").agg(F.max("_level").alias("level"), F.count("*").alias("length"))
    # The digits of length - 1: eight are enough for any field.
    rest = F.col("length") - 1
    digits = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.struct(F.floor(rest / F.pow(F.lit(float(base)), k)).alias("up"), k.alias("k")))
    digits = F.transform(F.filter(digits, lambda d: d["up"] > 0), lambda d: d["up"] % base + max_level + 1)
    return runs.withColumn("codes", F.concat(F.array("level"), digits))


def missing_kind(packed: Column, group_reference: Column, width: Column, bits: int, management: int) -> Column:
    """1 for a primary and 2 for a secondary missing value of complex packing, else 0. In a group of some width all ones is primary and, under management 2, one less secondary; in a group of none its reference tells."""
    own = F.when(width > 0, packed).otherwise(group_reference)
    ones = F.when(width > 0, F.call_function("shiftleft", F.lit(1).cast("long"), width.cast("int")) - 1).otherwise(F.lit((1 << bits) - 1))
    kind = F.when(own == ones, 1)
    if management == 2:
        kind = kind.when(own == ones - 1, 2)
    return kind.otherwise(0) if management else F.lit(0)


def fingerprint(points: DataFrame, field: list[str], index: str, value: str, reference: str, scale: str, decimal: str) -> DataFrame:
    """A SHA-256 of each field's packed integers, recovered from its values, in order; missing points are blank. The integers of a field meet in one row."""
    x = F.round((F.col(value) * F.pow(F.lit(10.0), F.col(decimal)) - F.col(reference).cast("double")) * F.pow(F.lit(2.0), -F.col(scale))).cast("long")
    rows = points.withColumn("_x", F.struct(F.col(index), F.coalesce(x.cast("string"), F.lit("")).alias("x")))
    return rows.groupBy(*field).agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list("_x")), lambda s: s["x"]), ","), 256).alias("fingerprint"), F.count("*").alias("n"), F.count(value).alias("n_present"))


def statistics(points: DataFrame, field: list[str], value: str) -> DataFrame:
    """Per field: points ``n``, those that aren't missing ``n_present``, ``least``, ``greatest`` and ``mean``."""
    return points.groupBy(*field).agg(F.count("*").alias("n"), F.count(value).alias("n_present"), F.min(value).alias("least"), F.max(value).alias("greatest"), F.avg(value).alias("mean"))


def bitmap_fits(points: DataFrame, field: list[str], bit: str, packed: DataFrame) -> DataFrame:
    """Per field whether its bit map has as many bits set as there are packed values (field, n_values), as it must: adds ``n_points``, ``n_values`` and ``fits``."""
    set_bits = points.groupBy(*field).agg(F.count("*").alias("n_points"), F.sum(F.col(bit).cast("long")).alias("n_bits"))
    met = set_bits.join(packed, field, "left").withColumn("n_values", F.coalesce("n_values", F.lit(0).cast("long")))
    return met.select(*field, "n_points", "n_values", (F.col("n_bits") == F.col("n_values")).alias("fits"))


def strongest(points: DataFrame, k: int, value: str, order: list[str]) -> DataFrame:
    """The k greatest values of all fields, ties in the order of the other columns; each task passes on k rows at most."""
    return points.where(F.col(value).isNotNull()).orderBy(F.desc(value), *order).limit(k)
