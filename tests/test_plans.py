"""Point queries on fields as read, reduced grids, and streams."""

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from isobar.functions import reduced
from isobar.functions.geometry import gaussian_latitudes
from isobar.plans import grids
from isobar.sources import encode, gridded, layout, messages
from isobar.streaming.fields import arrivals, each_once

PLANE = {k: 0 for k, _ in [*layout.GRIDS[30], *layout.GRIDS[20], *layout.GRIDS[1], *layout.GRIDS[90], *layout.GRIDS[10]]} | encode.EARTH


def test_values_at_places(spark, tmp_path):
    flat = encode.latlon(5, 4, 40_000_000, 10_000_000, 10_000_000, 50_000_000)
    lat = np.repeat([40.0, 30, 20, 10], 5)
    cone = {**PLANE, "ni": 30, "nj": 20, "lat1": 30_000_000, "lon1": 5_000_000, "flags": 8, "lad": 40_000_000, "lov": 15_000_000, "di": 100_000_000, "dj": 100_000_000, "scan": 0x40, "latin1": 30_000_000, "latin2": 50_000_000}
    turned = {**flat, "pole_lat": -30_000_000, "pole_lon": 10_000_000, "angle": 0.0}
    (tmp_path / "x.grb").write_bytes(
        encode.message(lat, flat, "ieee", 64) + encode.message(lat, {**flat, "lat1": flat["lat2"], "lat2": flat["lat1"], "scan": 0x40}, "ieee", 64) + encode.message(np.full(600, 7.0), cone, grid_template=30) + encode.message(lat, turned, "ieee", 64, grid_template=1)
    )
    fields = gridded.read_fields(spark, str(tmp_path))
    q = spark.createDataFrame([(1, 33.0, 22.0), (2, 40.0, 10.0)], "q int, q_lat double, q_lon double")
    got = {(r.msg_no, r.q): r.value for r in grids.bilinear_values(fields, q).collect()}
    assert got[(0, 1)] == pytest.approx(33) and got[(0, 2)] == pytest.approx(40) and got[(1, 1)] == pytest.approx(17) and got[(2, 1)] == pytest.approx(7) and len(got) == 8
    for template, numbers, _, _ in grids.definitions(fields).values():
        points = grids.coordinates(spark, template, numbers)
        assert points.count() == numbers["ni"] * numbers["nj"] and points.where("lon < 0 or lon >= 360 or abs(lat) > 90").count() == 0
    winds = spark.createDataFrame([(3.0, 4.0, 40.0, 15.0)], "u double, v double, lat double, lon double")
    assert grids.wind_to_earth(winds, 30, cone).select("east", "north").first() == (pytest.approx(3), pytest.approx(4))
    assert grids.wind_to_earth(winds, 0, flat).select("east", "north").first() == (3.0, 4.0)


def test_fields_without_geometry_keep_their_rows(spark, tmp_path):
    flat = encode.latlon(5, 4, 40_000_000, 10_000_000, 10_000_000, 50_000_000)
    view = {**PLANE, "ni": 5, "nj": 4, "lon1": 9_000_000, "di": 20, "dj": 10, "xp": 2_000, "yp": 2_000, "scan": 0x40, "nr": 6_610_700}
    data = np.arange(20.0)
    (tmp_path / "x.grb").write_bytes(encode.message(data, flat, "ieee", 64) + encode.message(data, view, "ieee", 64, grid_template=90))
    (tmp_path / "y.grb").write_bytes(encode.message(data, view, "ieee", 64, grid_template=90))
    q = spark.createDataFrame([(1, 33.0, 22.0), (2, 40.0, 10.0)], "q int, q_lat double, q_lon double")
    fields = gridded.read_fields(spark, str(tmp_path))
    got = grids.bilinear_values(fields, q).collect()
    assert len(got) == 6 and sum(r.value is None and "90" in r.error for r in got) == 4 and sum(r.value is not None and r.error is None for r in got) == 2
    torn = fields.withColumn("error", F.when(F.col("msg_no") == 0, F.lit("torn")))
    kept = grids.bilinear_values(torn, q).collect()
    assert len(kept) == 6 and sum(r.error == "torn" for r in kept) == 4


def test_nearest_values_on_every_grid(spark, tmp_path):
    """Inside, outside, at poles and seams, against a plain search of all points; missing points have a null value."""
    rng = np.random.default_rng(8)
    flat = encode.latlon(5, 4, 40_000_000, 10_000_000, 10_000_000, 50_000_000)
    world = encode.latlon(36, 19, 90_000_000, 0, -90_000_000, 350_000_000)
    lats = gaussian_latitudes(4)
    gauss = {**encode.latlon(16, 8, round(lats[0] * 1e6), 0, round(lats[7] * 1e6), 337_500_000), "gaussian": 4}
    cone = {**PLANE, "ni": 30, "nj": 20, "lat1": 30_000_000, "lon1": 5_000_000, "flags": 8, "lad": 40_000_000, "lov": 15_000_000, "di": 100_000_000, "dj": 100_000_000, "scan": 0x40, "latin1": 30_000_000, "latin2": 50_000_000}
    polar = {**PLANE, "ni": 12, "nj": 10, "lat1": 50_000_000, "lon1": -60_000_000, "lad": 60_000_000, "orientation": 0, "di": 500_000_000, "dj": 500_000_000, "scan": 0x40}
    merc = {**PLANE, "ni": 20, "nj": 10, "lat1": -20_000_000, "lon1": 100_000_000, "lad": 20_000_000, "lat2": 20_000_000, "lon2": 140_000_000, "di": 200_000_000, "dj": 200_000_000, "scan": 0x40, "orientation": 0}
    view = {**PLANE, "ni": 12, "nj": 8, "lon1": 9_000_000, "di": 12, "dj": 8, "xp": 6_000, "yp": 4_000, "scan": 0x40, "nr": 6_610_700}
    turned = {**flat, "pole_lat": -30_000_000, "pole_lon": 10_000_000, "angle": 0.0}
    rows = {**flat, "ni": 0xFFFFFFFF, "nj": 3, "lat1": 60_000_000, "lat2": -60_000_000, "lon1": 0, "lon2": 330_000_000, "di": 0xFFFFFFFF}
    pl = b"".join(k.to_bytes(2, "big") for k in (6, 12, 6))
    few = {**gauss, "ni": 0xFFFFFFFF, "di": 0xFFFFFFFF, "lon2": 330_000_000}
    few_pl = b"".join(k.to_bytes(2, "big") for k in (4, 8, 12, 12, 12, 12, 8, 4))
    made = [(0, flat, 20, b""), (0, world, 684, b""), (1, turned, 20, b""), (10, merc, 200, b""), (20, polar, 120, b""), (30, cone, 600, b""), (40, gauss, 128, b""), (90, view, 96, b""), (0, rows, 24, pl), (40, few, 72, few_pl)]
    content = b""
    for number, g, n, tail in made:
        v = np.where(np.arange(n) % 7 == 3, np.nan, np.arange(n) * 1.5)
        five, six, seven = encode.packed_sections(v, "ieee", 64)
        f = messages.FieldSections(None, messages.grid_section(number, g, n, tail, 2 if tail else 0), messages.product_section(0, encode.POINT), five, six[0], six[1:], seven)
        content += messages.build(messages.Message(0, layout.write(layout.SECTION1, encode.IDENTIFICATION), fields=[f]))
    (tmp_path / "x.grb").write_bytes(content)
    places = [(33.0, 22.0), (90.0, 0.0), (-90.0, 7.0), (0.0, 359.9), (-45.0, -170.0), (41.0, 9.0), *zip(rng.uniform(-89, 89, 14).tolist(), rng.uniform(0, 360, 14).tolist()), (33.0, 22.0)]
    q = spark.createDataFrame([(min(k, 20) % 20, *map(float, p)) for k, p in enumerate(places)], "q int, q_lat double, q_lon double")
    fields = gridded.read_fields(spark, str(tmp_path))
    got = grids.nearest_values(fields, q).collect()
    assert len(got) == len(made) * len(places) and not any(r.error for r in got)
    for k, (number, g, n, tail) in enumerate(made):
        points = {r.idx: (r.lat, r.lon) for r in grids.coordinates(spark, number, {**g, "row_octets": 2}, tail, n).collect()}
        assert sorted(points) == list(range(n))
        v = np.where(np.arange(n) % 7 == 3, -1, np.arange(n) * 1.5)
        v = v if tail else gridded.canonical(v, g["scan"], g["ni"], g["nj"])
        lat, lon = np.radians([points[i] for i in range(n)]).T
        for r in [r for r in got if r.msg_no == k]:
            p, o = np.radians([r.q_lat, r.q_lon])
            a = np.sin((lat - p) / 2) ** 2 + np.cos(p) * np.cos(lat) * np.sin((lon - o) / 2) ** 2
            d = 2 * np.arcsin(np.sqrt(np.minimum(a, 1)))
            assert r.distance == pytest.approx(d.min(), abs=5e-8) and d[r.idx] == pytest.approx(d.min(), abs=5e-8), (number, r)
            assert (r.near_lat, r.near_lon) == pytest.approx(points[r.idx], abs=1e-5) and r.value == (None if v[r.idx] < 0 else v[r.idx])


def test_space_view_coordinates(spark):
    g = {**PLANE, "ni": 21, "nj": 11, "lat1": 0, "lon1": 9_000_000, "di": 20, "dj": 10, "xp": 10_000, "yp": 5_000, "scan": 0x40, "nr": 6_610_700}
    c = grids.coordinates(spark, 90, g).where("on_disc")
    assert 0 < c.count() < 231 and c.where("row = 5 and col = 10").select("lon").first()[0] == pytest.approx(9)
    with pytest.raises(ValueError):
        grids.coordinates(spark, 90, {**g, "nr": 0xFFFFFFFF})
    for bad in ((90, g), (12, g), (0, {**g, "ni": 0xFFFFFFFF, "basic_angle": 0, "subdivisions": 0})):
        with pytest.raises(ValueError):
            grids.geometry_of(*bad)


def test_reduced_grids(spark):
    assert reduced.points_per_row(b"\x00\x05\x00\x06", 2, 2) == [5, 6] and reduced.points_per_row(b"\x03", 1, 1) == [3]
    with pytest.raises(ValueError):
        reduced.points_per_row(b"\x00", 2, 1)
    p = reduced.reduced_latlon(spark, [4, 8], 10.0, 0.0, -10.0, 315.0)
    assert [tuple(r) for r in p.orderBy("idx").select("idx", "lat", "lon").collect()][:6] == [(0, 10, 0), (1, 10, 90), (2, 10, 180), (3, 10, 270), (4, -10, 0), (5, -10, 45)]
    lats = gaussian_latitudes(2)
    g = reduced.reduced_gaussian(spark, 2, [4, 8, 8, 4], lats[0], lats[3], Fraction(0), Fraction(315), points=24)
    assert g.count() == 24 and g.agg(F.max("lon")).first()[0] == 315
    part = reduced.reduced_gaussian(spark, 2, [4, 8], lats[0], lats[1], Fraction(-45), Fraction(90), points=6)
    assert sorted(tuple(r) for r in part.select("row", "lon").collect()) == [(0, 0), (0, 90), (1, 0), (1, 45), (1, 90), (1, 315)]


def test_streams(spark, tmp_path):
    flat = encode.latlon(2, 2, 1_000_000, 0, 0, 1_000_000)
    (tmp_path / "a").write_bytes(encode.message(np.arange(4.0), flat) * 3 + encode.message(np.arange(4.0) + 1, flat))
    q = each_once(gridded.stream_fields(spark, str(tmp_path))).select("msg_no").writeStream.format("memory").queryName("once").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("once").count() == 2
    assert [r.fields for r in arrivals(gridded.read_fields(spark, str(tmp_path))).collect()] == [4]
    assert messages.grid_of(messages.parse(encode.message(np.arange(4.0), flat)).fields[0].grid)[0] == 4
