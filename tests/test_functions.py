"""Column functions by known vectors, and relational forms against the codecs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from isobar.functions import bits, names
from isobar.functions import geometry as geo
from isobar.operators import fields, lookup


def value(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_surface_levels(spark):
    got = value(spark, *[names.surface_value(F.lit(s), F.lit(v)) for s, v in ((2, 850), (-2, 850), (-4, 2), (-3, 85), (1, 24), (0, 7), (-127, 7), (3, 0xFFFFFFFF))])
    assert got == (8.5, 85000.0, 20000.0, 85000.0, 2.4, 7.0, 7.0, None)


def test_earth_axes():
    assert geo.earth_axes(1, radius=(2, 637100000)) == (6371000.0, 6371000.0)
    assert geo.earth_axes(3, major=(0, 6378), minor=(1, 63567)) == (6378000.0, 6356700.0)
    for bad in (lambda: geo.earth_axes(10), lambda: geo.earth_axes(1), lambda: geo.earth_axes(7, major=(0, 5))):
        with pytest.raises(ValueError):
            bad()


@pytest.mark.parametrize("n,first", [(640, 89.892396), (1280, 89.946187), (2000, 89.965557)])
def test_gaussian_latitudes(n, first):
    lats = geo.gaussian_latitudes(n)
    assert lats[0] == pytest.approx(first, abs=1e-6) and len(lats) == 2 * n and lats[0] == -lats[-1]
    assert all(a > b for a, b in zip(lats, lats[1:]))


def test_gaussian_grid_rows(spark):
    lats = geo.gaussian_latitudes(32)
    g = geo.RegularGrid.of(128, 64, lats[0], 0.0, lats[-1], 357.1875, gaussian=32)
    assert g.round_the_world
    rows = value(spark, *[g.row_of(F.lit(x)) for x in (lats[0], lats[5], (lats[5] + lats[6]) / 2, lats[63], 89.9)])
    assert rows[:4] == pytest.approx((0, 5, 5.5, 63)) and rows[4] < 0
    with pytest.raises(ValueError):
        geo.RegularGrid.of(128, 63, lats[0], 0.0, lats[-1], 357.0, gaussian=32)
    with pytest.raises(ValueError):
        geo.RegularGrid.of(4, 4, 10.0, 0.0, 20.0, 3.0)


def test_ieee_single(spark):
    import struct

    numbers = [0.0, 1.0, -1.5, 3.4028234663852886e38, 1.401298464324817e-45, 273.15, -0.1]
    words = [struct.unpack(">I", struct.pack(">f", v))[0] for v in numbers]
    assert value(spark, *[bits.ieee_single(F.lit(w)) for w in words]) == tuple(float(np.float32(v)) for v in numbers)
    assert value(spark, bits.unsigned(F.unhex(F.lit("0001FF80")), 2, 2)) == (0x01FF,)


GRIDS = {
    "mercator": geo.mercator(60, 40, -20.0, 230.0, 20.0, 50000.0, 50000.0, axes=geo.EARTH_AXES[4]),
    "polar": geo.polar_stereographic(60, 50, 41.6, 185.1, 225.0, 60.0, 30000.0, 30000.0),
    "polar south": geo.polar_stereographic(60, 50, -50.0, 40.0, 0.0, -70.0, 30000.0, 30000.0, scan=0, south=True),
    "lambert": geo.lambert(60, 50, 21.1, 237.3, 262.5, 38.5, 38.5, 38.5, 30000.0, 30000.0),
    "lambert spheroid": geo.lambert(59, 50, 30.0, 250.0, 262.5, 40.0, 30.0, 50.0, 20000.0, 25000.0, scan=0x80, axes=geo.EARTH_AXES[5]),
    "lambert south": geo.lambert(20, 25, -20.0, 130.0, 140.0, -35.0, -30.0, -40.0, 40000.0, 40000.0, scan=0),
}


@pytest.mark.parametrize("name", GRIDS)
def test_projections_invert(spark, name):
    g = GRIDS[name]
    points = lookup.grid_points(spark, g)
    fi, fj = g.position(F.col("lat"), F.col("lon") + 360)
    worst = points.select(F.max(F.abs(fi - F.col("col"))), F.max(F.abs(fj - F.col("row"))), F.min("lon"), F.max("lon"), F.count("*")).first()
    assert worst[0] < 1e-6 and worst[1] < 1e-6 and worst[2] >= 0 and worst[3] < 360 and worst[4] == g.nx * g.ny
    near = lookup.nearest_direct(points.where("row > 0 and col > 0 and row < 20 and col < 15").select("idx", F.col("lat").alias("q_lat"), F.col("lon").alias("q_lon")), g)
    assert near.where("near is null or near.idx <> idx").count() == 0


@pytest.mark.parametrize("name", ["polar", "polar south", "lambert", "lambert south"])
def test_grid_north_is_the_direction_of_the_pole(spark, name):
    g = GRIDS[name]
    lat, lon = g.coordinates(F.lit(10), F.lit(8))
    # A small step to the north, seen on the plane.
    x0, y0 = g.forward(lat, lon)
    x1, y1 = g.forward(lat + 1e-4, lon)
    north, seen = value(spark, g.grid_north(lat, lon), F.atan2(-(x1 - x0), y1 - y0))
    assert math.remainder(north - seen, 2 * math.pi) == pytest.approx(0, abs=1e-5)


def test_wind_turns(spark):
    east, north = value(spark, *geo.to_earth(F.lit(0.0), F.lit(10.0), F.lit(math.pi / 2)))
    assert (east, north) == pytest.approx((10, 0))
    assert value(spark, geo.grid_relative(F.lit(0x38)), geo.grid_relative(F.lit(0x30))) == (True, False)


def test_rotation_is_undone(spark):
    for lat, lon in ((45.0, -93.0), (-30.0, 120.0), (89.0, 0.0)):
        back = value(spark, *geo.unrotate(*geo.rotate(F.lit(lat), F.lit(lon), -31.8, -92.4, 10.0), -31.8, -92.4, 0.0))
        assert back[0] == pytest.approx(lat, abs=2e-6)


def test_space_view_below_the_camera(spark):
    lat, lon, on = value(spark, *geo.space_view(F.lit(50), F.lit(50), 101, 101, 100.0, 100.0, 50.0, 50.0, 6.61, 350.0))
    assert on and lat == pytest.approx(0) and lon == pytest.approx(350)
    assert value(spark, *geo.space_view(F.lit(0), F.lit(0), 101, 101, 100.0, 100.0, 50.0, 50.0, 6.61, 350.0)) == (0.0, 0.0, False)


def test_nearest_inside_equals_brute_force(spark):
    grid = geo.RegularGrid.of(36, 19, -90.0, 0.0, 90.0, 350.0, scan=0x40)
    q = spark.createDataFrame([(i, float(a), float(o)) for i, (a, o) in enumerate([(89.2, 12), (-90, 77), (3.3, 355.1), (3.3, -4.9), (44.4, 179.9), (0, 5.001)])], "k int, q_lat double, q_lon double")
    brute = {r.k: r.distance for r in lookup.nearest_by_cells(q, lookup.grid_points(spark, grid), ["k"]).collect()}
    direct = {r.k: r.near.d for r in lookup.nearest_direct(q, grid).collect()}
    assert direct == pytest.approx(brute, abs=1e-9)


def test_nearest_by_cells_equals_a_plain_search(spark, monkeypatch):
    """Positions near and far, poles, seams and ties, on the whole Earth, a small area, one point and none."""
    rng = np.random.default_rng(6)
    places = [(89.2, 12.0), (-90.0, 77.0), (3.3, 355.0), (5.0, 5.0), (0.0, 45.0), (0.0, 180.0), *zip(rng.uniform(-90, 90, 40).tolist(), rng.uniform(-180, 360, 40).tolist())]
    q = spark.createDataFrame([(k, k % 3, *map(float, p)) for k, p in enumerate(places)] + [(99, 0, None, 1.0)], "k int, j int, q_lat double, q_lon double")
    whole = [(lat, lon) for lat in range(90, -91, -10) for lon in range(0, 360, 10)]
    area = [(40 + i / 50, 10 + j / 50) for i in range(30) for j in range(40)]
    for points in (whole, area, rng.uniform(-1, 1, (300, 2)).tolist(), [(7.0, 8.0)], []):
        frame = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(points)], "idx long, lat double, lon double")
        for limit in (1 << 26, 0):
            monkeypatch.setattr(lookup, "POINT_BYTES", limit)
            got = {(r.k, r.j): (r.idx, r.distance) for r in lookup.nearest_by_cells(q, frame, ["k", "j"]).collect()}
            assert len(got) == (len(places) if points else 0)
            for k, (lat, lon) in enumerate(places if points else []):
                y, x = np.radians(np.array(points, float)).T
                a = np.sin((y - np.radians(lat)) / 2) ** 2 + np.cos(np.radians(lat)) * np.cos(y) * np.sin((x - np.radians(lon)) / 2) ** 2
                d = np.round(2 * np.arcsin(np.sqrt(np.minimum(a, 1))), 11)
                idx, distance = got[(k, k % 3)]
                assert distance == pytest.approx(d.min(), abs=1e-10) and d[idx] == d.min()


def test_missing_corners_give_null(spark):
    grid = geo.RegularGrid.of(2, 2, 1.0, 0.0, 0.0, 1.0)
    q = spark.createDataFrame([(0.25, 0.5)], "q_lat double, q_lon double").withColumn("g", F.lit(1))
    f = spark.createDataFrame([(1, "a", [1.0, 2.0, 3.0, 4.0]), (1, "b", [1.0, None, 3.0, 4.0]), (1, "c", [1.0])], "g int, name string, values array<double>")
    assert {r.name: r.value for r in lookup.bilinear(q, f, grid, ["g"]).collect()} == {"a": pytest.approx(3.0), "b": None, "c": None}


def test_names(spark, tmp_path):
    (tmp_path / "4.2.0.0.table").write_text("# comment\n0 0 Temperature (K)\n5 x Strange (or not) thing (W m-2)\n9 9 No unit\n")
    p = names.wmo_parameters(spark, str(tmp_path))
    assert {(r.number, r.name, r.unit) for r in p.collect()} == {(0, "Temperature", "K"), (5, "Strange (or not) thing", "W m-2"), (9, "No unit", "")}
    df = spark.createDataFrame([(7, 0, 16, 196), (98, 0, 16, 196), (7, 0, 0, 0)], "centre int, discipline int, category int, number int")
    assert [r.parameter for r in names.with_parameter(df).orderBy("category", "centre").collect()] == ["Temperature", "Composite reflectivity", "Unknown parameter (0, 16, 196)"]


def test_relational_run_lengths_equal_the_codec(spark):
    from isobar.codecs.bitio import packed, put
    from isobar.codecs.packings import unpack_run_length

    rng = np.random.default_rng(2)
    levels = np.repeat(rng.integers(0, 4, 30), rng.integers(1, 400, 30))
    points = spark.createDataFrame([(1, i, int(v) or None) for i, v in enumerate(levels)], "f int, idx long, level long")
    coded = [c for r in fields.run_length_encode(points, ["f"], "idx", "level", 4, 3).orderBy("run").collect() for c in r.codes]
    t = {"bits": 4, "max_level": 3, "decimal_scale": 0, "levels": [1, 2, 3]}
    if len(coded) % 2:
        coded.append(0)
        levels = np.append(levels, 0)
    got = np.nan_to_num(unpack_run_length(packed(put(np.array(coded), 4)), t, len(levels)))
    assert (got == levels).all()
