"""Reduced grids: rows of different lengths, given by a list of points per row."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isobar.functions.geometry import angle_unit, gaussian_latitudes, into_circle


def points_per_row(data: bytes, octets: int, rows: int) -> list[int]:
    """The list of a grid section; no octets mean two."""
    octets = octets or 2
    found = [int.from_bytes(data[k : k + octets], "big") for k in range(0, len(data) - octets + 1, octets)][:rows]
    if len(found) != rows:
        raise ValueError(f"{len(found)} of {rows} rows have a number of points")
    return found


def rational(v: int, basic: int, parts: int) -> Fraction:
    """An angle in degrees, exactly."""
    return Fraction(v, 1_000_000) if angle_unit(basic, parts) == 1e-6 else Fraction(v * basic, parts)


def _placed(spark: SparkSession, rows: list[tuple[int, float, int, float, float]]) -> DataFrame:
    """(idx, row, col, lat, lon) from (points before, latitude, points, first longitude, step); rows are few, points are made in parallel."""
    table = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "row long, before long, lat double, n long, first double, step double").where("n > 0")
    points = table.select("row", "before", "lat", "first", "step", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("col"))
    return points.select((F.col("before") + F.col("col")).alias("idx"), "row", "col", "lat", into_circle(F.col("first") + F.col("col") * F.col("step")).alias("lon"))


def reduced_latlon(spark: SparkSession, pl: list[int], lat1: float, lon1: float, lat2: float, lon2: float) -> DataFrame:
    """Points of a reduced latitude/longitude grid. Rows that leave less than two columns of the circle go all the way round."""
    if lat1 < lat2 or not any(pl):
        raise ValueError("a reduced grid runs from north to south and has points")
    nj, round_the_world = len(pl), 360 - abs(lon2 - lon1) < 720 / max(pl)
    span = 360.0 if round_the_world else (lon2 - lon1) + (360 if lon2 < lon1 else 0)
    rows, before = [], 0
    for j, n in enumerate(pl):
        lat = lat2 if j == nj - 1 else lat1 - j * (lat1 - lat2) / (nj - 1)
        rows.append((before, float(lat), n, float(lon1), span / max(n if round_the_world else n - 1, 1)))
        before += n
    return _placed(spark, rows)


def reduced_gaussian(spark: SparkSession, n: int, pl: list[int], lat1: float, lat2: float, first: Fraction, last: Fraction, unit: float = 1e-6, points: int | None = None) -> DataFrame:
    """Points of a reduced Gaussian grid. Of an area, a row has the points of the full circle's row whose longitudes, as exact fractions, lie between the first and the last."""
    lats = gaussian_latitudes(n)
    start = min(range(len(lats)), key=lambda k: abs(lats[k] - lat1))
    if abs(lats[start] - lat1) >= 1e-3 or start + len(pl) > len(lats):
        raise ValueError("the first latitude is not Gaussian, or there are too many rows")
    first, last = first % 360 if first < 0 else first, last % 360 if last < 0 else last
    spacing, delta = abs(lats[0] - lats[1]), 360.0 / max(pl)
    whole = abs(lat1 - lats[0]) < spacing and abs(lat2 + lats[0]) < spacing and first == 0 and abs(float(last) - (360 - delta)) - delta <= unit
    circle = [(p, 0, p) for p in pl]
    area = []
    for p in pl:
        if not p:
            area.append((0, 0, 1))
            continue
        step = Fraction(360, p)
        east = last if last >= first else last + 360
        lo, hi = -(-first // step), east // step
        area.append((min(int(hi - lo + 1), p), int(lo), p))
    chosen = circle if whole and points in (None, sum(pl)) else area
    if points is not None and sum(c for c, _, _ in chosen) != points:
        raise ValueError("the rows do not make up the grid's points")
    rows, before = [], 0
    for j, (count, lo, p) in enumerate(chosen):
        step = 360.0 / p if p else 0.0
        rows.append((before, float(lats[start + j]), count, lo * step, step))
        before += count
    return _placed(spark, rows)
