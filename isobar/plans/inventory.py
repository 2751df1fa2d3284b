"""What a collection of fields holds: descriptions, counts, pairs, gaps. Nothing here decodes a value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isobar.functions import names
from isobar.plans.grids import same_grid
from isobar.sources.gridded import number

#: What identifies a field beside its data.
KEYS = ("centre", "discipline", "category", "number", "reference_time", "forecast_time", "surface_type", "surface_level", "grid_key")


def inventory(fields: DataFrame) -> DataFrame:
    """Fields as read, with plain columns: ``KEYS`` and ``surface_level_hpa``. Fields of products without a template have null there; messages that could not be read are left out."""
    n = number
    parts = [n("identification", p).cast("int") for p in ("year", "month", "day", "hour", "minute", "second")]
    level = n("product", "surface1"), n("product", "surface1_scale"), n("product", "surface1_value")
    return fields.where("error is null").withColumns({
        "centre": n("identification", "centre").cast("int"), "category": n("product", "category").cast("int"), "number": n("product", "number").cast("int"), "reference_time": names.reference_time(*parts), "forecast_time": n("product", "forecast_time"),
        "surface_type": level[0].cast("int"), "surface_level": names.surface_value(*level[1:]), "surface_level_hpa": names.surface_value_hpa(*level), "grid_key": same_grid(),
    })


def describe(fields: DataFrame) -> DataFrame:
    """The fields with a line of text for each of their sections 0, 1, 3, 4 and 5: ``section0_text`` and so on. The parameter is named for the message's discipline and centre."""
    inv = inventory(fields).withColumns({"status": number("identification", "status").cast("int"), "data_type": number("identification", "data_type").cast("int")})
    for code, table, out in (("discipline", "discipline", "t0"), ("centre", "centre", "t1"), ("status", "production status", "t2"), ("data_type", "data type", "t3"), ("grid_template", "grid definition template", "t4"),
                             ("product_template", "product definition template", "t5"), ("surface_type", "surface type", "t6"), ("packing_template", "data representation template", "t7")):
        inv = names.with_name(inv, code, table, out)
    inv = names.with_parameter(inv)
    product = F.when(F.col("category").isNotNull(), F.format_string(", Parameter: %s [%s], Surface: %s", "parameter", "unit", "t6")).otherwise("")
    return inv.withColumns({
        "section0_text": F.format_string("Section0{Discipline: %d (%s), Edition: 2, TotalLength: %d}", "discipline", "t0", "total_length"),
        "section1_text": F.format_string("Section1{Centre: %d (%s), RefTime: %s, Status: %s, Type: %s}", "centre", "t1", F.date_format("reference_time", "yyyy-MM-dd'T'HH:mm:ss'Z'"), "t2", "t3"),
        "section3_text": F.format_string("Section3{Template: %d (%s), DataPoints: %d}", "grid_template", "t4", "n_points"),
        "section4_text": F.concat(F.format_string("Section4{Template: %d (%s)", "product_template", "t5"), product, F.lit("}")),
        "section5_text": F.format_string("Section5{Template: %d (%s), Values: %d}", "packing_template", "t7", "n_values"),
    }).drop("status", "data_type", *[f"t{k}" for k in range(8)])


def counts(inv: DataFrame, *by: str) -> DataFrame:
    """Fields and points by each prefix of ``by``, with totals: a rollup of an inventory."""
    return inv.rollup(*by).agg(F.count("*").alias("fields"), F.sum("n_points").alias("points"))


def pair(inv: DataFrame, first: tuple[int, int], second: tuple[int, int], keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """Two parameters (category, number) of the same centre, time, level and grid, such as the components of wind: one row per pair, ``keep`` of both with the suffixes ``_1`` and ``_2``."""
    same = [k for k in KEYS if k not in ("category", "number")]
    of = lambda c, k: inv.where((F.col("category") == c[0]) & (F.col("number") == c[1])).select(*[F.col(x).alias(f"{x}_{k}") for x in (*same, *keep)])
    met = [F.col(f"{x}_1").eqNullSafe(F.col(f"{x}_2")) for x in same]
    return of(first, 1).join(of(second, 2), met).select(*[F.col(f"{x}_1").alias(x) for x in same], *[f"{x}_{k}" for x in keep for k in (1, 2)])


def missing(expected: DataFrame, inv: DataFrame, on: list[str]) -> DataFrame:
    """What of the expected is not in an inventory, whatever else it holds."""
    return expected.join(inv.select(*on).distinct(), on, "left_anti")


def compare(one: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """(on, held): the distinct keys of two inventories, and whether ``both`` hold them or only the ``first`` or the ``second``."""
    a, b = one.select(*on).distinct(), other.select(*on).distinct()
    held = lambda df, text: df.withColumn("held", F.lit(text))
    return held(a.intersect(b), "both").unionByName(held(a.exceptAll(b), "first")).unionByName(held(b.exceptAll(a), "second"))


def same_grid_pairs(inv: DataFrame) -> DataFrame:
    """(grid_key, points, fields, pairs): how many pairs of fields lie on the same grid, by counting, not by listing them."""
    n = F.count("*")
    return inv.groupBy("grid_key").agg(F.max("n_points").alias("points"), n.alias("fields"), F.floor(n * (n - 1) / 2).cast("long").alias("pairs"))
