"""Point queries: which grid points lie near given positions, and what a field says there."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isobar.functions.geometry import ProjectedGrid, RegularGrid, haversine, interpolate

#: Distances are compared to so many decimals (of a radian: micrometres), so that ties go by index on any machine.
DECIMALS = 12
#: The most cells that a search makes of its points, whose centres every task holds.
MOST_CELLS = 4096
#: Points of a grid that take at most so many bytes go to every task of a search; others are shuffled to it.
POINT_BYTES = 64 << 20


def grid_points(spark, grid: RegularGrid | ProjectedGrid, unrotated=None) -> DataFrame:
    """(idx, row, col, lat, lon) of every grid point, made in parallel. ``unrotated`` turns rotated coordinates into true ones."""
    ni, nj = (grid.ni, grid.nj) if isinstance(grid, RegularGrid) else (grid.nx, grid.ny)
    cells = spark.range(ni * nj).select(F.col("id").alias("idx"), F.floor(F.col("id") / ni).cast("long").alias("row"), (F.col("id") % ni).alias("col"))
    row, col = F.col("row"), F.col("col")
    lat, lon = (grid.latitude(row), grid.longitude(col)) if isinstance(grid, RegularGrid) else grid.coordinates(row, col)
    if unrotated:
        lat, lon = unrotated(lat, lon)
    return cells.withColumns({"lat": lat, "lon": lon})


def _unit(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    p, l = np.radians(lat), np.radians(lon)  # noqa: E741
    return np.stack([np.cos(p) * np.cos(l), np.cos(p) * np.sin(l), np.sin(p)], axis=-1)


def _cell_of(side: float) -> Column:
    """The cube of that side in which a point of the unit sphere lies."""
    p, l = F.radians("lat"), F.radians("lon")  # noqa: E741
    return F.concat_ws(" ", *[F.floor(x / side).cast("string") for x in (F.cos(p) * F.cos(l), F.cos(p) * F.sin(l), F.sin(p))])


def nearest_by_cells(queries: DataFrame, points: DataFrame, key: list[str]) -> DataFrame:
    """For each query (key, q_lat, q_lon) the nearest of all points (idx, lat, lon), the lowest index of equals; exact, for any points and positions.

    Points lie in cubic cells, about as many as the root of their number, each with a centre and a reach. A query is compared with all cells first: the least of (distance to the centre + reach) bounds its distance, and only cells that may hold
    something as near are searched. So a query costs some roots of the number of points, and what every task holds is bounded: cells never exceed ``MOST_CELLS``. Adds ``idx``, ``lat``, ``lon`` and ``distance`` in radians.
    """
    spark = queries.sparkSession
    points = points.select("idx", "lat", "lon").where("lat is not null and lon is not null")
    x = [F.cos(F.radians("lat")) * F.cos(F.radians("lon")), F.cos(F.radians("lat")) * F.sin(F.radians("lon")), F.sin(F.radians("lat"))]
    found = points.agg(F.count("*"), *[F.max(v) - F.min(v) for v in x]).first()
    total, extent = found[0], max([v or 0 for v in found[1:]])
    # A surface fills some 6 r^2 of the cubes of a side 1/r of its extent.
    side = max(extent / max(1.0, min(total, MOST_CELLS**2) ** 0.25), 1e-9) * 1.5
    placed = points.withColumn("cell", _cell_of(side))
    centres = placed.groupBy("cell").agg(*[F.avg(v).alias(f"x{k}") for k, v in enumerate(x)])
    centres = centres.select("cell", F.degrees(F.atan2("x2", F.sqrt(F.col("x0") * F.col("x0") + F.col("x1") * F.col("x1")))).alias("c_lat"), F.degrees(F.atan2("x1", "x0")).alias("c_lon"))
    away = haversine(F.col("lat"), F.col("lon"), F.col("c_lat"), F.col("c_lon"))
    celled = placed.join(F.broadcast(centres), "cell").groupBy("cell", "c_lat", "c_lon").agg(F.max(away).alias("reach"))
    heads = celled.select("cell", "c_lat", "c_lon", "reach").toPandas().sort_values("cell")
    cells, centres, reaches = heads["cell"].tolist(), _unit(heads["c_lat"].to_numpy(), heads["c_lon"].to_numpy()).reshape(-1, 3), heads["reach"].to_numpy()
    shared = spark.sparkContext.broadcast((cells, centres, reaches))
    source = queries.select(*key, F.col("q_lat").cast("double").alias("q_lat"), F.col("q_lon").cast("double").alias("q_lon"))
    schema = T.StructType([*source.schema.fields, T.StructField("cell", T.StringType())])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, centre, reach = shared.value
        names = pa.array(names, pa.string())
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                q = _unit(part.column(len(key)).to_numpy(zero_copy_only=False), part.column(len(key) + 1).to_numpy(zero_copy_only=False))
                away = 2 * np.arcsin(np.minimum(np.sqrt(np.maximum(2 - 2 * (q @ centre.T), 0)) / 2, 1))
                # Room for rounding, which is large for small angles.
                row, col = np.nonzero(away - reach <= (away + reach).min(axis=1, initial=np.inf)[:, None] + 1e-6)
                yield pa.RecordBatch.from_arrays([*[c.take(pa.array(row)) for c in part.columns], names.take(pa.array(col))], names=schema.fieldNames())

    tries = source.where("q_lat is not null and q_lon is not null").mapInArrow(choose, schema)
    joined = tries.join(F.broadcast(placed) if total * 40 <= POINT_BYTES else placed, "cell")
    d = F.round(haversine(F.col("q_lat"), F.col("q_lon"), F.col("lat"), F.col("lon")), DECIMALS)
    best = joined.groupBy(*key).agg(F.min(F.struct(d.alias("distance"), "idx", "lat", "lon")).alias("near"))
    return best.select(*key, "near.idx", "near.lat", "near.lon", "near.distance")


def nearest_direct(queries: DataFrame, grid: RegularGrid | ProjectedGrid) -> DataFrame:
    """Adds ``near`` (with idx, lat, lon) for positions inside the grid, by the four points around each; null outside, where the edge must be searched."""
    lat, lon = F.col("q_lat"), F.col("q_lon")
    if isinstance(grid, RegularGrid):
        return queries.withColumn("near", F.when(grid.inside(lat, lon), grid.nearest(lat, lon)))
    fi, fj = grid.position(lat, lon)
    inside = (fi >= 0) & (fj >= 0) & (fi <= grid.nx - 1) & (fj <= grid.ny - 1)
    return queries.withColumn("near", F.when(inside, grid.nearest(lat, lon)))


def nearest_outside(spark, queries: DataFrame, grid: RegularGrid, key: list[str]) -> DataFrame:
    """For positions outside the grid the nearest point of its edge."""
    edge = grid_points(spark, grid).where((F.col("row") == 0) | (F.col("row") == grid.nj - 1) | (F.col("col") == 0) | (F.col("col") == grid.ni - 1))
    outside = queries.where(~grid.inside(F.col("q_lat"), F.col("q_lon")))
    return nearest_by_cells(outside, edge, key)


def bilinear(queries: DataFrame, fields: DataFrame, grid: RegularGrid | ProjectedGrid, on: list[str]) -> DataFrame:
    """The fields' values at the queries' positions. Weights are computed once per position, before the join, and serve every field."""
    weighed = queries.withColumn("w", grid.weights(F.col("q_lat"), F.col("q_lon")))
    return weighed.join(fields, on).withColumn("value", interpolate(F.col("values"), F.col("w"))).drop("w", "values")


def row_between(queries: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """A range join: for each q_lat the row k of (k, lat, below) with lat > q_lat >= below, and the fraction of the way down. Rows are those of one grid, which its format bounds; the planner broadcasts them."""
    hit = queries.join(F.broadcast(rows), (F.col("lat") > F.col("q_lat")) & (F.col("q_lat") >= F.col("below")))
    return hit.select(*key, "k", ((F.col("lat") - F.col("q_lat")) / (F.col("lat") - F.col("below"))).alias("fraction"))
