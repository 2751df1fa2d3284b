"""Messages by round trips, framing, the format gridded and streams."""

import os

import numpy as np
import pytest

from isobar.sources import encode, gridded, layout, messages

RNG = np.random.default_rng(4)
GRID = encode.latlon(6, 4, 60_000_000, -10_000_000, 30_000_000, 40_000_000)


def one(packing="simple", bits=12, values=None, **more):
    return encode.message(RNG.normal(280, 9, 24) if values is None else values, GRID, packing, bits, **more)


def several():
    """Fields that go on from a product, a grid, a local section; bit maps of their own, of before, none."""
    sections = [encode.packed_sections(RNG.normal(0, 1, 24), "simple", 8) for _ in range(4)]
    v = np.where(np.arange(24) % 3, 1.5, np.nan)
    with_map = encode.packed_sections(v, "ieee", 64)
    grid, other = messages.grid_section(0, GRID, 24), messages.grid_section(0, {**GRID, "scan": 0x40, "lat1": 30_000_000, "lat2": 60_000_000}, 24)
    product = messages.product_section(0, {**encode.POINT, "forecast_time": -3}, b"\x3f\x80\x00\x00")
    f = [
        messages.FieldSections(None, grid, product, with_map[0], 0, with_map[1][1:], with_map[2]),
        messages.FieldSections(None, grid, product, with_map[0], 254, b"", with_map[2], shares_grid=True),
        messages.FieldSections(None, other, product, sections[1][0], 255, b"", sections[1][2]),
        messages.FieldSections(b"local", grid, product, sections[2][0], 255, b"", sections[2][2], own_local=True),
    ]
    return messages.build(messages.Message(0, layout.write(layout.SECTION1, encode.IDENTIFICATION) + b"tail", local=b"first", fields=f))


def test_octets_come_back():
    for content in (one(), one("complex2"), one("ccsds"), one("png"), several(), one(values=np.full(24, 3.0))):
        assert messages.build(messages.parse(content)) == content
    m = messages.parse(several())
    assert [f.shares_grid for f in m.fields] == [False, True, False, False] and m.fields[1].effective == m.fields[0].bitmap
    assert messages.product_of(m.fields[0].product)[1]["forecast_time"] == -3 and messages.product_of(m.fields[0].product)[2] == b"\x3f\x80\x00\x00"


@pytest.mark.parametrize("number", layout.GRIDS)
def test_grid_layouts(number):
    body = bytes(RNG.integers(0, 256, layout.size(layout.GRIDS[number]), dtype=np.uint8) & 0x7F)
    assert layout.write(layout.GRIDS[number], layout.read(layout.GRIDS[number], body)) == body
    with pytest.raises(ValueError):
        layout.read(layout.GRIDS[number], body[:-1])


def test_layout_sizes():
    assert {k: layout.size(v) for k, v in layout.GRIDS.items()} == {0: 58, 1: 70, 10: 58, 20: 51, 30: 67, 40: 58, 90: 66}
    assert {k: layout.size(v) for k, v in layout.PRODUCTS.items()} == {0: 25, 1: 28, 2: 27, 8: 37, 11: 40, 12: 39}
    assert {k: layout.size(v) for k, v in layout.PACKINGS.items()} == {0: 10, 2: 36, 3: 38, 4: 1, 40: 12, 41: 10, 42: 14, 200: 6}


def test_products_with_ranges():
    ranges = [dict(process=k, increment_kind=2, range_unit=1, range=6, increment_unit=255, increment=0) for k in range(3)]
    more = dict(ensemble=1, perturbation=2, members=3, derived=4, end_year=2025, end_month=1, end_day=2, end_hour=3, end_minute=4, end_second=5, ranges=3, missing=0, time_ranges=ranges)
    for number in layout.PRODUCTS:
        given = {**encode.POINT, **more}
        back = layout.read_product(number, layout.write_product(number, given if number >= 8 else {**given, "time_ranges": []}))
        assert all(given[k] == v for k, v in back.items())
    with pytest.raises(ValueError):
        layout.read_product(8, layout.write_product(8, {**encode.POINT, **more})[:-1])


def test_sign_and_magnitude():
    for n, kind in ((1, "s8"), (2, "s16"), (4, "s32")):
        top = (1 << (8 * n - 1)) - 1
        for v in (0, 1, -1, top, -top):
            assert layout.read([("x", kind)], layout.write([("x", kind)], {"x": v}))["x"] == v
    assert layout.read([("x", "s16")], b"\x80\x01")["x"] == -1


def test_framing():
    good = one()
    rows = list(gridded.field_rows("p", b"junkGRI" + good + b"xx" + b"GRIB\x00\x00\x0c\x01abcd" + several() + b"trailing"))
    assert [(r["msg_no"], r.get("field_no"), r["error"] is None) for r in rows] == [(0, 0, True), (1, None, False), (2, 0, True), (2, 1, True), (2, 2, True), (2, 3, True)]
    assert "edition 1" in rows[1]["error"]
    cut = list(gridded.field_rows("p", good[:-6]))
    assert len(cut) == 1 and "cut short" in cut[0]["error"]
    wrong = good[:8] + (len(good) - 1).to_bytes(8, "big") + good[16:]
    found = list(gridded.field_rows("p", wrong + good))
    assert "end mark" in found[0]["error"] and found[-1]["error"] is None
    damaged = bytearray(good)
    damaged[16 + 4] = 9
    assert list(gridded.field_rows("p", bytes(damaged)))[0]["error"]
    assert list(gridded.field_rows("p", bytes(damaged), "DROPMALFORMED")) == []
    with pytest.raises(messages.MessageError):
        list(gridded.field_rows("p", bytes(damaged), "FAILFAST"))
    assert list(gridded.field_rows("p", b"")) == list(gridded.field_rows("p", b"nothing")) == []


def test_unknown_templates_pass_through():
    m = messages.parse(one())
    m.fields[0].grid = m.fields[0].grid[:7] + (12_345).to_bytes(2, "big") + b"any octets"
    m.fields[0].packing = m.fields[0].packing[:4] + (61).to_bytes(2, "big") + b"zz"
    content = messages.build(m)
    rows = list(gridded.field_rows("p", content))
    assert rows[0]["grid"] is None and rows[0]["packing"] is None and rows[0]["error"] is None and gridded.message_of(rows) == content
    with pytest.raises(ValueError):
        gridded.field_values(rows[0])


def test_scanning_modes():
    v = np.arange(6.0)
    want = {0x00: [0, 1, 2, 3, 4, 5], 0x80: [2, 1, 0, 5, 4, 3], 0x40: [3, 4, 5, 0, 1, 2], 0x20: [0, 2, 4, 1, 3, 5], 0x10: [0, 1, 2, 5, 4, 3], 0xC0: [5, 4, 3, 2, 1, 0], 0x50: [5, 4, 3, 0, 1, 2], 0x30: [0, 3, 4, 1, 2, 5]}
    for mode, order in want.items():
        assert gridded.canonical(v, mode, 3, 2).tolist() == order, hex(mode)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("files")
    (d / "a.grb").write_bytes(one() + several())
    (d / "b.grb").write_bytes(one("complex1") + b"GRIB\x00\x00\x08\x01" + one("ieee", 32))
    return str(d)


def test_read_decode_write(spark, folder, tmp_path):
    fields = gridded.read_fields(spark, folder)
    rows = fields.collect()
    assert len(rows) == 8 and sum(r.error is not None for r in rows) == 1
    decoded = {(os.path.basename(r.path), r.msg_no, r.field_no): r for r in gridded.decode_fields(fields.where("error is null")).collect()}
    assert all(r.decode_error is None and len(r["values"]) == 24 for r in decoded.values())
    assert decoded[("a.grb", 1, 1)]["values"][:4] == [None, 1.5, 1.5, None]
    assert gridded.points_of(gridded.decode_fields(fields)).where("value is not null").count() == 7 * 24 - 16
    back = {(os.path.basename(r.path), r.msg_no): bytes(r.content) for r in gridded.to_messages(fields).collect()}
    whole = open(f"{folder}/a.grb", "rb").read()
    assert back[("a.grb", 0)] + back[("a.grb", 1)] == whole
    gridded.register(spark)
    gridded.to_messages(fields).write.format("wmo-grib").mode("append").save(str(tmp_path / "out"))
    again = spark.read.format("wmo-grib").load(str(tmp_path / "out"))
    assert again.count() == 7 and sorted(again.columns) == sorted(fields.columns)
    assert sorted(bytes(r.content) for r in gridded.to_messages(again).collect()) == sorted(back.values())
    assert spark.read.format("wmo-grib").option("includeData", "false").load(folder).where("section7 is not null").count() == 0


def test_overwrite_replaces_files(spark, folder, tmp_path):
    gridded.register(spark)
    out = str(tmp_path / "out")
    content = gridded.to_messages(gridded.read_fields(spark, folder))
    for _ in range(2):
        content.write.format("wmo-grib").mode("overwrite").save(out)
    assert spark.read.format("wmo-grib").load(out).count() == 7
    content.write.format("wmo-grib").mode("append").save(out)
    assert spark.read.format("wmo-grib").load(out).count() == 14


def test_ranges_read_only_what_is_asked_for(tmp_path):
    big = encode.message(RNG.normal(0, 1, 200_000), encode.latlon(200_000, 1, 0, 0, 0, 1_000_000), "ieee", 64)
    small = one()
    content = b"junkGRI" + big + b"GRIB\x00\x00\x0c\x01abcd" + small + big + b"trailing GRIB"
    (tmp_path / "x").write_bytes(content)

    def rows(data, wanted=None, first=False):
        with open(tmp_path / "x", "rb") as f:
            source = messages.Ranges(f, len(content))
            return list(gridded.field_rows("p", source, "PERMISSIVE", data, wanted, first)), source.octets_read

    whole = list(gridded.field_rows("p", content))
    assert rows(True)[0] == whole and len(whole) == 5
    found, octets = rows(False)
    assert found == [{**r, "section7": None} if r["error"] is None else r for r in whole] and octets < 80_000 < len(content)
    some, octets = rows(True, lambda r: r.get("n_points") == 24)
    assert some == [whole[2]] and octets < 80_000
    assert rows(True, first=True)[0] == whole[:1]


def test_filters_are_pushed(spark, folder):
    gridded.register(spark)
    read = spark.read.format("wmo-grib").load(folder)
    some = read.where("packing_template = 3 and n_points > 3 and byte_offset % 1 = 0")
    assert [r.packing_template for r in some.collect()] == [3] and read.where("error is not null").count() == 1
    assert read.where("path like '%a.grb'").count() == 5
    reader = gridded._Reader({"path": folder})
    from pyspark.sql.datasource import EqualTo, IsNull

    kept = list(reader.pushFilters([EqualTo(("path",), f"{folder}/b.grb"), IsNull(("error",)), EqualTo(("grid", "ni"), 1)]))
    assert len(kept) == 2 and [p.path for p in reader.partitions()] == [f"{folder}/b.grb"]
    assert spark.read.format("wmo-grib").option("firstOnly", "true").load(folder).count() == 2


def test_table_function(spark, folder):
    gridded.register(spark)
    spark.read.format("binaryFile").load(folder).createOrReplaceTempView("files")
    rows = spark.sql("select m.* from files, lateral messages(path, content) m where m.error is null").collect()
    assert len(rows) == 7 and {r.n_points for r in rows} == {24}


def test_fields_that_differ_in_any_section_are_two(spark, tmp_path):
    from isobar.streaming.fields import each_once

    v = np.arange(24.0)
    mapped = np.where(v == 3, np.nan, v)
    content = [one(values=v, packing="ieee"), one(values=v, packing="ieee", discipline=10), one(values=v, packing="ieee", identification={**encode.IDENTIFICATION, "centre": 7}), one(values=mapped, packing="ieee"), one(values=np.where(v == 4, np.nan, np.where(v == 3, 4, mapped)), packing="ieee"), one(values=v, packing="ieee")]
    (tmp_path / "a").write_bytes(b"".join(content))
    q = each_once(gridded.stream_fields(spark, str(tmp_path))).select("msg_no").writeStream.format("memory").queryName("every_section").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("every_section").count() == 5


def test_stream(spark, folder, tmp_path):
    stream = gridded.stream_fields(spark, folder)
    q = stream.groupBy("packing_template").count().writeStream.outputMode("complete").format("memory").queryName("field_stream").start()
    q.processAllAvailable()
    q.stop()
    assert sum(r["count"] for r in spark.table("field_stream").collect()) == 8
