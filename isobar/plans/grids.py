"""From grid definitions to geometry, and point queries on fields of any mix of grids.

Definitions are few however many the fields, so the driver looks at the distinct ones and plans each: expressions where the geometry is regular, else a search of all points, ``lookup.nearest_by_cells``. What a position needs of a field,
its stencil, is worked out once per grid; fields are decoded where they lie, and only the values asked for leave the task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isobar.functions import geometry as geo
from isobar.functions import reduced
from isobar.operators import lookup
from isobar.sources import gridded, messages

#: Positions whose stencils meet a field in one row.
BLOCK = 50_000
#: Stencils that take at most so many bytes, by the number of positions and grids, are broadcast to the fields.
STENCIL_BYTES = 32 << 20


class Geometry:
    """A grid with what is needed to look points up: the plane or sphere it is regular on, and the way there from true coordinates."""

    def __init__(self, grid, turn=None, back=None, north=None):
        self.grid, self.turn, self.back, self.north = grid, turn, back, north

    def local(self, lat: Column, lon: Column) -> tuple[Column, Column]:
        return self.turn(lat, lon) if self.turn else (lat, lon)

    def weights(self, lat: Column, lon: Column) -> Column:
        return self.grid.weights(*self.local(lat, lon))


def geometry_of(template: int, g: dict) -> Geometry:
    """The geometry of a grid definition's numbers. Raises for grids that are not regular or not supported."""
    axes = lambda: geo.earth_axes(int(g["shape"]), (int(g["radius_scale"]), int(g["radius"])), (int(g["major_scale"]), int(g["major"])), (int(g["minor_scale"]), int(g["minor"])))
    ni, nj, scan = int(g["ni"]), int(g["nj"]), int(g["scan"])
    if template in (0, 1, 40):
        if ni == geo.MISSING_WORD:
            raise ValueError("a reduced grid is not regular")
        u = geo.angle_unit(int(g["basic_angle"]), int(g["subdivisions"]))
        di = 0.0 if int(g["di"]) in (0, geo.MISSING_WORD) else g["di"] * u
        grid = geo.RegularGrid.of(ni, nj, g["lat1"] * u, g["lon1"] * u, g["lat2"] * u, g["lon2"] * u, di, scan, int(g["gaussian"]) if template == 40 else 0)
        if template != 1:
            return Geometry(grid, north=lambda lat, lon: geo.lit(0))
        pole = dict(pole_lat=g["pole_lat"] * u, pole_lon=g["pole_lon"] * u, angle=float(g["angle"]))
        return Geometry(grid, lambda lat, lon: geo.rotate(lat, lon, **pole), lambda lat, lon: geo.unrotate(lat, lon, **pole), lambda lat, lon: geo.rotated_north(lat, lon, **pole))
    d = lambda k: g[k] * 1e-6
    sides = dict(dx=g["di"] * 1e-3, dy=g["dj"] * 1e-3, scan=scan, axes=axes()) if template != 90 else {}
    if sides and (sides["dx"] <= 0 or sides["dy"] <= 0 or ni <= 0 or nj <= 0):
        raise ValueError("the grid has no size")
    if template == 10:
        p = geo.mercator(ni, nj, d("lat1"), d("lon1"), d("lad"), orientation=d("orientation"), **sides)
    elif template == 20:
        p = geo.polar_stereographic(ni, nj, d("lat1"), d("lon1"), d("orientation"), d("lad"), south=bool(int(g["centre"]) & 0x80), **sides)
    elif template == 30:
        p = geo.lambert(ni, nj, d("lat1"), d("lon1"), d("lov"), d("lad"), d("latin1"), d("latin2"), **sides)
    else:
        raise ValueError(f"no geometry for grid template {template}")
    return Geometry(p, north=p.grid_north)


def grid_id() -> Column:
    """Fields on the same grid have the same id."""
    return F.xxhash64(F.col("section3"))


def same_grid() -> Column:
    """Fields whose grid templates are alike have the same value, whatever their lists of points per row."""
    return F.when(F.col("grid").isNull(), F.xxhash64("grid_template", "section3")).otherwise(F.xxhash64("grid_template", F.array_sort(F.map_entries("grid"))))


def definitions(fields: DataFrame) -> dict[int, tuple[int, dict | None, int, bytes]]:
    """The distinct grids of some fields: id to template, numbers, points and the list of points per row."""
    rows = fields.where("error is null").select(grid_id().alias("grid_id"), "section3").groupBy("grid_id").agg(F.first("section3").alias("section3")).collect()
    out = {}
    for r in rows:
        body = bytes(r["section3"])
        points, template, numbers, tail = messages.grid_of(body)
        out[r["grid_id"]] = (template, numbers and {**numbers, "row_octets": body[5]}, points, tail)
    return out


def coordinates(spark, template: int, g: dict, row_points: bytes = b"", points: int | None = None) -> DataFrame:
    """(idx, row, col, lat, lon) of all points of a grid of any known template. Reduced grids have the octets of their list of points per row in ``row_points``."""
    if template == 90:
        ni, nj = int(g["ni"]), int(g["nj"])
        cells = spark.range(ni * nj).select(F.col("id").alias("idx"), F.floor(F.col("id") / ni).cast("long").alias("row"), (F.col("id") % ni).alias("col"))
        axes = geo.earth_axes(int(g["shape"]), (int(g["radius_scale"]), int(g["radius"])), (int(g["major_scale"]), int(g["major"])), (int(g["minor_scale"]), int(g["minor"])))
        if g["lat1"] or int(g["nr"]) == geo.MISSING_WORD:
            raise ValueError("space view: the camera must be above the equator at a known height")
        lat, lon, on = geo.space_view(F.col("row"), F.col("col"), ni, nj, g["di"], g["dj"], g["xp"] * 1e-3, g["yp"] * 1e-3, g["nr"] * 1e-6, g["lon1"] * 1e-6, int(g["scan"]), int(g["xo"]), int(g["yo"]), axes)
        return cells.withColumns({"lat": lat, "lon": lon, "on_disc": on})
    if template in (0, 40) and int(g["ni"]) == geo.MISSING_WORD:
        pl = reduced.points_per_row(row_points, int(g.get("row_octets", 0)), int(g["nj"]))
        basic, parts = int(g["basic_angle"]), int(g["subdivisions"])
        u = geo.angle_unit(basic, parts)
        if template == 0:
            return reduced.reduced_latlon(spark, pl, g["lat1"] * u, g["lon1"] * u, g["lat2"] * u, g["lon2"] * u)
        first, last = (reduced.rational(int(g[k]), basic, parts) for k in ("lon1", "lon2"))
        return reduced.reduced_gaussian(spark, int(g["gaussian"]), pl, g["lat1"] * u, g["lat2"] * u, first, last, u, points)
    geometry = geometry_of(template, g)
    back = geometry.back and (lambda lat, lon: (lambda a, b: (a, geo.into_circle(b)))(*geometry.back(lat, lon)))
    return lookup.grid_points(spark, geometry.grid, back)


def _single_valued(spark, grid) -> bool:
    """Whether every place of a projected grid is another place on Earth: its edge, looked up again by its coordinates, comes back to itself."""
    if grid.period:
        return grid.nx <= grid.period + 1e-3
    edge = _edge(lookup.grid_points(spark, grid), grid.nx, grid.ny)
    fi, fj = grid.position(F.col("lat"), F.col("lon"))
    return edge.where(~F.coalesce((F.abs(fi - F.col("col")) < 0.5) & (F.abs(fj - F.col("row")) < 0.5), F.lit(False))).isEmpty()


def _edge(points: DataFrame, ni: int, nj: int) -> DataFrame:
    return points.where((F.col("row") == 0) | (F.col("row") == nj - 1) | (F.col("col") == 0) | (F.col("col") == ni - 1))


NEAR = "struct<idx:bigint,near_lat:double,near_lon:double,distance:double>"


def nearest_points(queries: DataFrame, template: int, g: dict, key: list[str], row_points: bytes = b"", points: int | None = None) -> DataFrame:
    """(key, near): for every position the nearest point of a grid of any template, inside or outside of it: ``idx``, ``near_lat``, ``near_lon`` and ``distance`` in radians. Of equals the first of the four around, or the lowest index.

    Inside a regular or conformal grid one of the four points around is the nearest; outside it is on the edge. Of other grids all points are searched.
    """
    spark = queries.sparkSession
    near = lambda df: df.select(*key, F.struct(F.col("idx").cast("long").alias("idx"), F.col("lat").alias("near_lat"), F.col("lon").alias("near_lon"), "distance").alias("near"))
    regular = template in (0, 1, 10, 20, 30, 40) and not (template in (0, 40) and int(g["ni"]) == geo.MISSING_WORD)
    geometry = geometry_of(template, g) if regular else None
    if geometry is None or (not isinstance(geometry.grid, geo.RegularGrid) and not _single_valued(spark, geometry.grid)):
        return near(lookup.nearest_by_cells(queries, coordinates(spark, template, g, row_points, points), key))
    grid, lat, lon = geometry.grid, F.col("q_lat"), F.col("q_lon")
    local = geometry.local(lat, lon)
    if isinstance(grid, geo.RegularGrid):
        inside, ni, nj = grid.inside(*local), grid.ni, grid.nj
    else:
        fi, fj = grid.position(*local)
        inside, ni, nj = F.coalesce((fi >= 0) & (fj >= 0) & (fi <= grid.nx - 1) & (fj <= grid.ny - 1), F.lit(False)), grid.nx, grid.ny
    marked = queries.withColumn("inside", inside)
    found = grid.nearest(lat, lon, local, geometry.back) if isinstance(grid, geo.RegularGrid) else grid.nearest(*local)
    here = marked.where("inside").withColumn("n", found).select(*key, F.struct(F.col("n.idx").cast("long").alias("idx"), F.col("n.lat").alias("near_lat"), F.col("n.lon").alias("near_lon"), F.col("n.d").alias("distance")).alias("near"))
    edge = _edge(coordinates(spark, template, g), ni, nj)
    return here.unionByName(near(lookup.nearest_by_cells(marked.where("not inside"), edge, key)))


def _sampled(fields: DataFrame, queries: DataFrame, on: tuple[str, ...], stencil_of, extra_type: str) -> DataFrame:
    """The value of every field at every position. ``stencil_of`` gives for a grid's definition (qid, w, extra): the four points and fractions to weigh them by, and what else to report; or it raises.

    Fields meet the stencils of their grid in blocks of positions; a task decodes a field, takes the points out and passes nothing else on.
    """
    spark = queries.sparkSession
    w_type = "struct<i00:bigint,i10:bigint,i01:bigint,i11:bigint,xf:double,yf:double>"
    names = queries.columns
    asked = queries.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("q"))
    # The same positions asked for twice are two rows, told apart by the number among equals.
    numbered = asked.groupBy("q").agg(F.count("*").alias("times")).select(F.xxhash64("q").alias("h"), F.sha2(F.to_json(F.struct("q")), 256).alias("qid"), "q", "times")
    numbered = numbered.withColumns({"q_lat": F.col("q.q_lat").cast("double"), "q_lon": F.col("q.q_lon").cast("double")})
    grids, n = definitions(fields), queries.count()
    blocks = max(1, -(-n // BLOCK))
    parts = []
    for gid, (template, numbers, points, tail) in grids.items():
        try:
            if numbers is None:
                raise ValueError(f"no geometry for grid template {template}")
            found, error = stencil_of(numbered, template, numbers, points, tail), None
            joined = numbered.join(found, "qid", "left")
        except ValueError as e:
            joined, error = numbered.withColumns({"w": F.lit(None).cast(w_type), "extra": F.lit(None).cast(extra_type)}), str(e)
        cell = F.struct("q", "times", F.col("w").cast(w_type).alias("w"), F.col("extra").cast(extra_type).alias("extra"))
        parts.append(joined.groupBy(F.pmod(F.col("h"), F.lit(blocks)).alias("block")).agg(F.collect_list(cell).alias("cells")).select(F.lit(gid).alias("grid_id"), "cells", F.lit(error).cast("string").alias("grid_error")))
    q_type, x_type = asked.schema["q"].dataType, T._parse_datatype_string(extra_type)
    schema = T.StructType([*[fields.schema[c] for c in on], T.StructField("q", q_type), T.StructField("extra", x_type), T.StructField("value", T.DoubleType()), T.StructField("error", T.StringType())])
    # Fields that could not be read have no grid, but a row for each position all the same.
    unread = fields.where("error is not null").select(*on, F.col("error").alias("e")).join(F.broadcast(asked) if n * 100 <= STENCIL_BYTES else asked, F.lit(True)).select(*on, "q", F.lit(None).cast(extra_type).alias("extra"), F.lit(None).cast("double").alias("value"), F.col("e").alias("error"))
    out = unread
    if parts:
        stencils = reduce(DataFrame.unionByName, parts)
        stencils = F.broadcast(stencils) if n * len(grids) * 200 <= STENCIL_BYTES else stencils
        met = fields.where("error is null").select(*on, *gridded.DECODED_FROM, grid_id().alias("grid_id")).join(stencils, "grid_id").select(*on, *gridded.DECODED_FROM, "cells", "grid_error")
        kept = len(on)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = {name: k for k, name in enumerate(batch.schema.names)}
                for k in range(batch.num_rows):
                    cells = batch.column(at["cells"])[k].values
                    error, values = batch.column(at["grid_error"])[k].as_py(), None
                    try:
                        values = gridded.field_values({c: batch.column(at[c])[k].as_py() for c in gridded.DECODED_FROM})
                    except ValueError as e:
                        error = str(e)
                    times = np.repeat(np.arange(len(cells)), cells.field("times").to_numpy(zero_copy_only=False))
                    value = np.full(len(cells), np.nan)
                    w = cells.field("w")
                    good = w.is_valid().to_numpy(zero_copy_only=False)
                    if values is not None and error is None and good.any():
                        idx = [np.nan_to_num(w.field(c).to_numpy(zero_copy_only=False)[good].astype(np.float64), nan=-1).astype(np.int64) for c in ("i00", "i10", "i01", "i11")]
                        x, y = (w.field(c).to_numpy(zero_copy_only=False)[good] for c in ("xf", "yf"))
                        take = [np.where((i >= 0) & (i < len(values)), values[np.clip(i, 0, max(len(values) - 1, 0))], np.nan) for i in idx] if len(values) else [np.full(len(x), np.nan)] * 4
                        # A point that is not asked for, at weight 0, may be missing only in a search of the nearest, whose four points are one.
                        same = (idx[0] == idx[1]) & (idx[0] == idx[2])
                        value[good] = np.where(same, take[0], take[0] * (1 - x) * (1 - y) + take[1] * x * (1 - y) + take[2] * (1 - x) * y + take[3] * x * y)
                    rows = pa.array(times)
                    value = value[times]
                    yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(k, 1).take(pa.array(np.zeros(len(times), np.int64))) for c in range(kept)], cells.field("q").take(rows), cells.field("extra").take(rows), pa.array(value, mask=np.isnan(value)), pa.array([error] * len(times), pa.string())], names=schema.fieldNames())

        out = met.mapInArrow(run, schema).unionByName(unread)
    more = [F.col(f"extra.{f.name}") for f in x_type.fields]
    return out.select(*on, *[F.col(f"q.`{c}`").alias(c) for c in names], "value", *more, "error")


def bilinear_values(fields: DataFrame, queries: DataFrame, on: tuple[str, ...] = ("path", "msg_no", "field_no")) -> DataFrame:
    """The bilinear value of every field at every query's position: ``fields`` as read, queries with ``q_lat`` and ``q_lon``, whose other columns come through. Adds ``value``, ``outside`` and ``error``.

    Where a field or its grid has no value the value is null and ``error`` says why; a missing point around makes it null without an error.
    """

    def stencil(asked: DataFrame, template: int, numbers: dict, points: int, tail: bytes) -> DataFrame:
        w = geometry_of(template, numbers).weights(F.col("q_lat"), F.col("q_lon"))
        return asked.select("qid", w.alias("all")).select("qid", F.struct(*[F.col(f"all.{c}").alias(c) for c in ("i00", "i10", "i01", "i11", "xf", "yf")]).alias("v"), F.struct(F.col("all.outside").alias("outside")).alias("extra")).select("qid", F.when(F.col("v.i00").isNotNull(), F.col("v")).alias("w"), "extra")

    return _sampled(fields, queries, on, stencil, "struct<outside:boolean>")


def nearest_values(fields: DataFrame, queries: DataFrame, on: tuple[str, ...] = ("path", "msg_no", "field_no")) -> DataFrame:
    """The value of every field at the point of its grid that is nearest to every query's position, on grids of any known template, inside or outside of them. Adds ``value`` (null where the point is missing), ``idx``, ``near_lat``, ``near_lon``, ``distance``
    in radians, and ``error``."""

    def stencil(asked: DataFrame, template: int, numbers: dict, points: int, tail: bytes) -> DataFrame:
        near = nearest_points(asked.select("qid", "q_lat", "q_lon"), template, numbers, ["qid"], tail, points)
        idx = F.col("near.idx")
        return near.select("qid", F.struct(idx.alias("i00"), idx.alias("i10"), idx.alias("i01"), idx.alias("i11"), F.lit(0.0).alias("xf"), F.lit(0.0).alias("yf")).alias("w"), F.col("near").alias("extra"))

    return _sampled(fields, queries, on, stencil, NEAR)


def wind_to_earth(points: DataFrame, template: int, g: dict, u: str = "u", v: str = "v") -> DataFrame:
    """Winds (u, v) at (lat, lon) turned to east and north, where the grid's flags say that they go by its axes."""
    if not int(g["flags"]) & 0x08:
        return points.withColumns({"east": F.col(u), "north": F.col(v)})
    north = geometry_of(template, g).north
    if north is None:
        raise ValueError("the grid has no north")
    east, up = geo.to_earth(F.col(u), F.col(v), north(F.col("lat"), F.col("lon")))
    return points.withColumns({"east": east, "north": up})
