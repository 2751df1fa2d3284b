"""Queries of whole messages, of grids of every template and of inventories, and their oracles in SQL. Importing this module registers them beside the others."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isobar.functions import geometry as geo
from isobar.functions import names, reduced
from isobar.operators import fields
from isobar.plans import grids, inventory
from isobar.queries import (
    CELLS, FIELD_SQL, FRACTIONS, HAVERSINE, LAMBERT_SQL, MERCATOR_SQL, NEAREST_SQL, PLACES, POLAR_SQL, REGULAR_SQL, VALUES, digits, places, query, supplier_arrays, table,
)
from isobar.sources import encode, gridded, layout

# ---- templates: numbers written to messages and read again

#: For each kind of number in a layout: how many values the queries use, and the least.
RANGES = {"u8": (200, 0), "u16": (60_000, 0), "u32": (1_000_000_000, 0), "s8": (100, -50), "s16": (1000, -500), "s32": (180_000_000, -90_000_000), "f32": (1000, 0)}


def _template_query(part: str, number: int):
    own = [(name, k, *RANGES[kind]) for k, (name, kind) in enumerate(layout.GRIDS[number] if part == "grid" else layout.PRODUCTS[number]) if name != "ranges"]

    def f(spark, sf_dir):
        key = F.col("s_suppkey").cast("long")
        numbers = F.map_from_arrays(F.array(*[F.lit(n) for n, *_ in own]), F.array(*[((key * (7 + 13 * k) + 31 * k) % m + least).cast("double") for _, k, m, least in own]))
        if part == "product":
            numbers = F.map_concat(numbers, F.create_map(F.lit("ranges"), F.lit(0.0)) if any(n == "ranges" for n, _ in layout.PRODUCTS[number]) else F.create_map().cast("map<string,double>"))
        rows = table(spark, sf_dir, "supplier").select(key.alias("path"), F.array(F.lit(1.0), F.lit(2.0)).alias("values"), F.lit(number).alias(f"{part}_template"), numbers.alias(part))
        found = gridded.parse_files(encode.encode_fields(rows, "simple", 8), "FAILFAST", data=False)
        return found.select(F.col("path").cast("long").alias("s_suppkey"), F.col(f"{part}_template").alias("template"), F.explode(F.map_entries(part)).alias("e")).select("s_suppkey", "template", F.col("e.key").alias("name"), F.col("e.value").alias("value")).where("name != 'ranges'")

    f.__name__ = f"{part}_template_{number}"
    given = ", ".join(f"('{n}', {k}, {m}, {least})" for n, k, m, least in own)
    query(f"select s_suppkey, {number} as template, name, cast((s_suppkey * (7 + 13 * k) + 31 * k) % m + least as double) as value from supplier, (values {given}) t(name, k, m, least)")(f)


for _n in layout.GRIDS:
    _template_query("grid", _n)
for _n in layout.PRODUCTS:
    _template_query("product", _n)


# ---- framing, groups of fields, the sink


@query("select l_suppkey, count(distinct l_suppkey) * 2 as n_good, 1 as n_bad, 16 as first_offset, 'edition 1, not 2' as error from lineitem group by l_suppkey")
def messages_in_junk(spark, sf_dir):
    """Octets that belong to no message are passed over, a message of the first edition is a row with an error."""
    files = encode.encode_rows(supplier_arrays(spark, sf_dir), "l_suppkey", "simple", 8)
    old = F.lit(b"GRIB\x00\x00\x0c\x01abcd")
    rows = gridded.parse_files(files.select("path", F.concat(F.lit(b"junk"), old, "content", F.lit(b"GRI"), "content", F.lit(b"trailing GRI")).alias("content")), data=False)
    good = F.col("error").isNull()
    found = rows.groupBy(F.col("path").cast("long").alias("l_suppkey")).agg(F.sum(good.cast("long")).alias("n_good"), F.sum((~good).cast("long")).alias("n_bad"), F.min(F.when(good, F.col("byte_offset"))).alias("first_offset"), F.max("error").alias("error"))
    return found.withColumns({"n_bad": F.col("n_bad").cast("int"), "first_offset": F.col("first_offset").cast("int")})


def grouped_fields(spark, sf_dir) -> DataFrame:
    """Messages of three fields: one with its own bit map, one that shares its grid and bit map, one after a local section."""
    one = gridded.parse_files(encode.encode_rows(supplier_arrays(spark, sf_dir), "l_suppkey", "ieee", 64), "FAILFAST")
    shared = one.withColumns({"field_no": F.lit(1), "shares_grid": F.lit(True), "bitmap_indicator": F.when(F.col("bitmap_indicator") == 0, 254).otherwise(255), "bitmap": F.lit(b"")})
    local = one.withColumns({"field_no": F.lit(2), "own_local": F.lit(True), "section2": F.lit(b"of its own")})
    return one.unionByName(shared).unionByName(local)


@query("""select l_suppkey, k as field_no, k = 1 as shares_grid, case when k = 2 then 'of its own' end as local, case when k = 1 and gaps then 254 when gaps then 0 else 255 end as indicator, cast(idx as integer) as idx, value
from {V}, (values (0), (1), (2)) t(k), (select l_suppkey as s, bool_or(l_quantity >= 48) as gaps from lineitem group by all) where s = l_suppkey""", V=VALUES)
def message_field_groups(spark, sf_dir):
    """Fields that go on within a message from a product, a grid or a local section; a bit map may be that of the field before."""
    again = gridded.parse_files(gridded.to_messages(grouped_fields(spark, sf_dir)).select("path", "content"), "FAILFAST")
    decoded = gridded.decode_fields(again, ("path", "field_no", "shares_grid", "section2", "bitmap_indicator"))
    return gridded.points_of(decoded).select(F.col("path").cast("long").alias("l_suppkey"), "field_no", "shares_grid", F.col("section2").cast("string").alias("local"), F.col("bitmap_indicator").alias("indicator"), "idx", "value")


@query("select l_suppkey, 3 as n_fields, true as same from lineitem group by l_suppkey")
def message_sink_octets(spark, sf_dir):
    """What was read is written alike, octet by octet."""
    files = gridded.to_messages(grouped_fields(spark, sf_dir)).select("path", "content")
    rows = gridded.parse_files(files, "FAILFAST")
    back = gridded.to_messages(rows).select("path", F.col("content").alias("again"))
    n = rows.groupBy("path").agg(F.count("*").cast("int").alias("n_fields"))
    return files.join(back, "path").join(n, "path").select(F.col("path").cast("long").alias("l_suppkey"), "n_fields", (F.col("content") == F.col("again")).alias("same"))


@query("select l_suppkey, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_quantity) - 1 as idx, cast(case when l_quantity < 48 then floor(l_quantity / 5) end as double) as value from lineitem")
def message_runlength_roundtrip(spark, sf_dir):
    """Levels in runs, level 0 for missing points."""
    key = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", F.when(F.col("l_quantity") < 48, F.floor(F.col("l_quantity") / 5).cast("double")).alias("v"))
    levels = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.transform(F.array_sort(F.collect_list(key)), lambda s: s["v"]).alias("values"))
    decoded = gridded.decode_fields(gridded.parse_files(encode.encode_rows(levels, "l_suppkey", "runlength", 8), "FAILFAST"), ("path",))
    return gridded.points_of(decoded).select(F.col("path").cast("long").alias("l_suppkey"), F.col("idx").cast("long").alias("idx"), "value")


@query("select l_suppkey, count(*) as n, count(*) filter (value is null) as n_missing, true as within from {V} group by l_suppkey", V=VALUES)
def message_substitutes(spark, sf_dir):
    """Missing points of complex packing as the value that the message declares to stand for them."""
    arrays = supplier_arrays(spark, sf_dir)
    decoded = gridded.decode_fields(gridded.parse_files(encode.encode_rows(arrays, "l_suppkey", "complex1", 16, substitute=-9999.0), "FAILFAST"), ("path",), substitute=True)
    both = decoded.select(F.col("path").cast("long").alias("l_suppkey"), F.col("values").alias("got")).join(arrays, "l_suppkey")
    errors = F.zip_with("values", "got", lambda a, b: F.when(a.isNull(), F.abs(b + 9999.0)).otherwise(F.abs(a - b)))
    return both.select("l_suppkey", F.size("got").cast("long").alias("n"), F.size(F.filter("got", lambda x: x == -9999.0)).cast("long").alias("n_missing"), (F.array_max(errors) <= 2.0).alias("within"))


@query("select l_suppkey, 0 as msg_no, count(*) as n_points, 4 as packing_template from lineitem group by l_suppkey")
def messages_table_function(spark, sf_dir):
    """The fields of octets in SQL, by a table function."""
    gridded.register(spark)
    encode.encode_rows(supplier_arrays(spark, sf_dir), "l_suppkey", "ieee", 32).createOrReplaceTempView("message_files")
    return spark.sql("select cast(path as bigint) as l_suppkey, m.msg_no, m.n_points, m.packing_template from message_files, lateral messages(path, content) m where m.error is null")


# ---- inventories


def supplier_fields(spark, sf_dir) -> DataFrame:
    """A message for every supplier: discipline, parameter, level and grid go by its key and nation."""
    key, nation = F.col("s_suppkey").cast("long"), F.col("s_nationkey").cast("long")
    product = {"category": key % 3, "number": key % 5, "forecast_time": key % 11, "surface1": F.when(key % 2 == 0, 100).otherwise(103), "surface1_scale": F.when(key % 2 == 0, -2).otherwise(0), "surface1_value": 500 + nation}
    numbers = F.map_from_arrays(F.array(*map(F.lit, product)), F.array(*[v.cast("double") for v in product.values()]))
    centre = F.create_map(F.lit("centre"), F.when(key % 2 == 0, 7.0).otherwise(98.0))
    rows = table(spark, sf_dir, "supplier").select(key.alias("path"), F.when(key % 4 == 0, 10).otherwise(0).alias("discipline"), centre.alias("identification"), numbers.alias("product"), F.array_repeat("s_acctbal", (nation + 1).cast("int")).alias("values"))
    return gridded.parse_files(encode.encode_fields(rows, "ieee", 32), "FAILFAST", data=False)


SUPPLIERS = "(select *, case when s_suppkey % 4 = 0 then 10 else 0 end as discipline, cast(s_suppkey % 3 as integer) as category, cast(s_suppkey % 5 as integer) as number, cast(s_nationkey as bigint) + 1 as n from supplier)"


def _pairs(text: str, width: int) -> str:
    rows = [line.split(" ", width) for line in text.strip().splitlines()]
    return "(values " + ", ".join("(" + ", ".join([*r[:width], "'" + r[width].replace("'", "''") + "'"]) + ")" for r in rows) + ")"


_PARAMETERS = "(values " + ", ".join("({}, {}, {}, '{}', '{}')".format(*line.split(" ", 3)[:3], *line.split(" ", 3)[3].split("|")) for line in names.PARAMETERS.strip().splitlines()) + ")"


@query("""select s_suppkey, 'Section0{Discipline: ' || discipline || ' (' || case discipline when 0 then 'Meteorological products' else 'Oceanographic products' end || '), Edition: 2, TotalLength: ' || (170 + 4 * n) || '}' as section0,
'Section1{Centre: ' || case when s_suppkey % 2 = 0 then '7 (US National Weather Service - NCEP)' else '98 (European Centre for Medium-Range Weather Forecasts (ECMWF))' end || ', RefTime: 2024-02-29T12:00:00Z, Status: Operational products, Type: Forecast products}' as section1,
'Section3{Template: 0 (Latitude/longitude (equidistant cylindrical, or Plate Carree)), DataPoints: ' || n || '}' as section3,
'Section4{Template: 0 (Analysis or forecast at a horizontal level or in a horizontal layer at a point in time), Parameter: ' || coalesce(p.name, 'Unknown parameter (' || discipline || ', ' || category || ', ' || number || ')') || ' [' || coalesce(p.unit, 'unknown') || '], Surface: ' || case when s_suppkey % 2 = 0 then 'Isobaric surface' else 'Specified height level above ground' end || '}' as section4,
'Section5{Template: 4 (Grid point data - IEEE floating point data), Values: ' || n || '}' as section5
from {S} s left join {P} p(d, c, k, name, unit) on s.discipline = p.d and s.category = p.c and s.number = p.k""", S=SUPPLIERS, P=_PARAMETERS)
def field_descriptions(spark, sf_dir):
    d = inventory.describe(supplier_fields(spark, sf_dir))
    return d.select(F.col("path").cast("long").alias("s_suppkey"), *[F.col(f"section{k}_text").alias(f"section{k}") for k in (0, 1, 3, 4, 5)])


@query("select s_suppkey, case when s_suppkey % 2 = 0 then 100 else 103 end as surface_type, case when s_suppkey % 2 = 0 then (500e0 + s_nationkey) * 100 else 500e0 + s_nationkey end as level, 500e0 + s_nationkey as level_hpa from supplier")
def surface_levels(spark, sf_dir):
    """Levels of fields as read; those of isobaric surfaces in pascals and hectopascals."""
    return inventory.inventory(supplier_fields(spark, sf_dir)).select(F.col("path").cast("long").alias("s_suppkey"), "surface_type", F.col("surface_level").alias("level"), F.col("surface_level_hpa").alias("level_hpa"))


@query("select p_partkey, coalesce(n.name, 'Unknown parameter category (' || discipline || ', ' || category || ')') as category_name from (select p_partkey, cast(case when p_size % 3 = 0 then 10 else p_size % 3 - 1 end as integer) as discipline, cast(p_partkey % 22 as integer) as category from part) c left join {N} n(d, k, name) on c.discipline = n.d and c.category = n.k", N=_pairs(names.CATEGORIES, 2))
def parameter_category_names(spark, sf_dir):
    s = F.col("p_size")
    p = table(spark, sf_dir, "part").select("p_partkey", F.when(s % 3 == 0, 10).otherwise(s % 3 - 1).cast("int").alias("discipline"), (F.col("p_partkey") % 22).cast("int").alias("category"))
    return names.with_category(p).select("p_partkey", "category_name")


@query("""select p_partkey, coalesce(g.name, 'Unknown grid definition template (' || code || ')') as grid, coalesce(t.name, 'Unknown product definition template (' || code || ')') as product, coalesce(d.name, 'Unknown data representation template (' || code || ')') as data
from (select p_partkey, cast(p_partkey % 95 as integer) as code from part) c left join {G} g(c, name) on g.c = code left join {T} t(c, name) on t.c = code left join {D} d(c, name) on d.c = code""",
       G=_pairs(names.TABLES["grid definition template"], 1), T=_pairs(names.TABLES["product definition template"], 1), D=_pairs(names.TABLES["data representation template"], 1))
def template_names(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 95).cast("int").alias("code"))
    for kind, out in (("grid definition template", "grid"), ("product definition template", "product"), ("data representation template", "data")):
        p = names.with_name(p, "code", kind, out)
    return p.drop("code")


@query("select discipline, category, count(*) as fields, cast(sum(n) as bigint) as points from {S} group by rollup (discipline, category)", S=SUPPLIERS)
def inventory_rollup(spark, sf_dir):
    return inventory.counts(inventory.inventory(supplier_fields(spark, sf_dir)), "discipline", "category")


@query("select n - 1 as grid, count(*) as fields, cast(floor(count(*) * (count(*) - 1) / 2) as bigint) as pairs from {S} group by n", S=SUPPLIERS)
def grid_match_join(spark, sf_dir):
    """Fields on the same grid, told by its template: pairs by counting, not by listing them."""
    return inventory.same_grid_pairs(inventory.inventory(supplier_fields(spark, sf_dir))).select((F.col("points") - 1).alias("grid"), "fields", "pairs")


@query("select c_custkey % 7 as category, c_custkey % 11 as number from customer where not exists (select 1 from {S} where category = c_custkey % 7 and number = c_custkey % 11)", S=SUPPLIERS)
def missing_anti_join(spark, sf_dir):
    """Parameters that are expected, one for each customer, but that no message has."""
    c = F.col("c_custkey")
    return inventory.missing(table(spark, sf_dir, "customer").select((c % 7).alias("category"), (c % 11).alias("number")), inventory.inventory(supplier_fields(spark, sf_dir)), ["category", "number"])


@query("""with a as (select distinct category, number from {S} where s_suppkey % 7 < 3), b as (select distinct category, number from {S} where s_suppkey % 7 > 1)
select *, 'both' as held from (select * from a intersect select * from b) union all select *, 'first' from (select * from a except select * from b) union all select *, 'second' from (select * from b except select * from a)""", S=SUPPLIERS)
def inventory_compare(spark, sf_dir):
    """Which parameters two collections hold: both, or one only."""
    inv = inventory.inventory(supplier_fields(spark, sf_dir))
    key = F.col("path").cast("long") % 7
    return inventory.compare(inv.where(key < 3), inv.where(key > 1), ["category", "number"])


@query("select s_suppkey, round(2 * sqrt(s_acctbal * s_acctbal + s_nationkey * s_nationkey), 6) as speed from supplier")
def u_v_pair_join(spark, sf_dir):
    """Components of wind meet on centre, time, level and grid; their values make speeds."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("k"), F.col("s_acctbal").cast("double").alias("a"), F.col("s_nationkey").cast("double").alias("n"))
    of = lambda number, x, y: s.select(F.concat_ws("-", "k", F.lit(number)).alias("path"), F.array(x, y).alias("values"), F.map_from_arrays(F.array(*map(F.lit, ("category", "number", "forecast_time"))), F.array(F.lit(2.0), F.lit(float(number)), F.col("k").cast("double"))).alias("product"))
    parsed = gridded.parse_files(encode.encode_fields(of(2, "a", "n").unionByName(of(3, "n", "a"))), "FAILFAST")
    values = gridded.decode_fields(parsed, ("path",)).select("path", "values")
    pairs = inventory.pair(inventory.inventory(parsed), (2, 2), (2, 3)).select("forecast_time", "path_1", "path_2")
    met = pairs.join(values.toDF("path_1", "u"), "path_1").join(values.toDF("path_2", "v"), "path_2")
    speed = F.aggregate(F.zip_with("u", "v", lambda a, b: F.sqrt(a * a + b * b)), F.lit(0.0), lambda t, x: t + x)
    return met.select(F.col("forecast_time").alias("s_suppkey"), F.round(speed, 6).alias("speed"))


@query("select l_suppkey, cast(idx as integer) as idx, value from {V} where value is not null order by value desc, l_suppkey, idx limit 25", V=VALUES)
def strongest_points(spark, sf_dir):
    """The greatest values of all fields: a top-k report."""
    decoded = gridded.decode_fields(gridded.parse_files(encode.encode_rows(supplier_arrays(spark, sf_dir), "l_suppkey", "ieee", 64), "FAILFAST"), ("path",))
    points = gridded.points_of(decoded).select(F.col("path").cast("long").alias("l_suppkey"), "idx", "value")
    return fields.strongest(points, 25, "value", ["l_suppkey", "idx"])


# ---- values at positions, on grids of every template

SHIFTED = f"(select event_id, q_lat + 0.00123e0 as q_lat, q_lon + 0.00457e0 as q_lon from {PLACES})"
_EARTH = {**encode.EARTH, "flags": 0, "ni": 25, "nj": 25}
_FLAT = encode.latlon(25, 25, 60_000_000, 350_000_000, 12_000_000, 38_000_000)
_GAUSS = geo.gaussian_latitudes(8)
_LATITUDES = ", ".join(f"{float(y)!r}e0" for y in _GAUSS)
_CELL = "row * 25 + col as idx"
_TURNED = "radians(60e0 - row * 2e0) as p, radians((col * 2e0 + 350e0) % 360e0) as l, radians(-(90e0 - 31.758312e0)) as t, radians(92.402969e0) as o"
_DISC = """with k as (select 6378.137e0 as a, 6356.752314e0 as b, 6.6107e0 as nr), g as (select *, nr * a as h, 2 * asin(1 / nr) as size, power(a / b, 2) as q from k),
c as (select {CELL}, (col - 12e0) * size / 24 as x, ((24 - row) - 12e0) * (b / a) * size / 24 as y, g.* from {CELLS}, g),
d as (select *, sqrt(1 - power(sin(x), 2)) * sqrt(1 - power(sin(y), 2)) as cc, 1 + (q - 1) * power(sin(y), 2) as st from c), e as (select *, power(h * cc, 2) - st * (h * h - a * a) as sight from d),
f as (select *, case when sight > 0 then (h * cc - sqrt(sight)) / st end as sn from e)
select idx, coalesce(degrees(atan(q * sn * sin(y) / sqrt(power(h - sn * cc, 2) + power(sn * sin(x) * sqrt(1 - power(sin(y), 2)), 2)))), 0e0) as lat, coalesce(degrees(atan(sn * sin(x) * sqrt(1 - power(sin(y), 2)) / (h - sn * cc))) + 75e0, 0e0) as lon from f"""
_ROWS = [8 + 4 * (k % 5) for k in range(25)]
#: Name: template, numbers, list of points per row, points, and the points in SQL.
GRIDS = {
    "regular": (0, _FLAT, [], 625, f"select idx, lat, lon from {REGULAR_SQL}"),
    "rotated": (1, {**_FLAT, "pole_lat": -31_758_312, "pole_lon": -92_402_969, "angle": 0}, [], 625, f"""with c as (select {_CELL}, {_TURNED} from {CELLS}), v as (select *, cos(l) * cos(p) as x, sin(l) * cos(p) as y, sin(p) as z from c)
        select idx, round(degrees(asin(-sin(t) * x + cos(t) * z)), 6) as lat, (round(degrees(atan2(-cos(t) * sin(o) * x + cos(o) * y - sin(t) * sin(o) * z, cos(t) * cos(o) * x + sin(o) * y + sin(t) * cos(o) * z)), 6) + 360e0) % 360e0 as lon from v"""),
    "gaussian": (40, {**encode.latlon(25, 16, round(_GAUSS[0] * 1e6), 350_000_000, round(_GAUSS[15] * 1e6), 38_000_000), "gaussian": 8}, [], 400, f"select {_CELL}, ([{_LATITUDES}])[row + 1] as lat, (350e0 + col * 2e0) % 360e0 as lon from {CELLS} where row < 16"),
    "mercator": (10, {**_EARTH, "lat1": -20_000_000, "lon1": 230_000_000, "lad": 20_000_000, "lat2": 20_000_000, "lon2": 280_000_000, "scan": 0x40, "orientation": 0, "di": 200_000_000, "dj": 200_000_000}, [], 625,
                 f"with {MERCATOR_SQL} select {_CELL}, 90e0 - 2 * degrees(atan(exp(-((24 - row) * 200000e0 + y0) / u))) as lat, (230e0 + degrees(col * 200000e0 / u)) % 360e0 as lon from {CELLS}, o"),
    "polar": (20, {**_EARTH, "lat1": 41_612_949, "lon1": 185_117_126, "lad": 60_000_000, "orientation": 225_000_000, "di": 200_000_000, "dj": 200_000_000, "centre": 0, "scan": 0x40}, [], 625,
              f"with {POLAR_SQL}, c as (select {_CELL}, x0 + col * 200000e0 as px, y0 + (24 - row) * 200000e0 as py, s from {CELLS}, o) select idx, 90e0 - 2 * degrees(atan(sqrt(px * px + py * py) / s)) as lat, (degrees(atan2(px, -py)) + 225e0 + 360e0) % 360e0 as lon from c"),
    "lambert": (30, {**_EARTH, "lat1": 21_138_123, "lon1": 237_280_472, "lad": 38_500_000, "lov": 262_500_000, "di": 200_000_000, "dj": 200_000_000, "centre": 0, "scan": 0x40, "latin1": 38_500_000, "latin2": 38_500_000, "pole_lat": -90_000_000, "pole_lon": 0}, [], 625,
                f"with {LAMBERT_SQL}, c as (select {_CELL}, x0 + col * 200000e0 as px, mid - y0 - (24 - row) * 200000e0 as py, n, size from {CELLS}, o) select idx, 90e0 - 2 * degrees(atan(power(sqrt(px * px + py * py) / size, 1 / n))) as lat, (degrees(atan2(px, py) / n) + 262.5e0) % 360e0 as lon from c"),
    "space_view": (90, {**_EARTH, "shape": 4, "lat1": 0, "lon1": 75_000_000, "di": 24, "dj": 24, "xp": 12_000, "yp": 12_000, "scan": 0x40, "orientation": 0, "nr": 6_610_700, "xo": 0, "yo": 0}, [], 625, _DISC.replace("{CELL}", _CELL).replace("{CELLS}", CELLS)),
    "reduced": (0, {**encode.latlon(25, 25, 60_000_000, 0, -60_000_000, 345_000_000), "ni": 0xFFFFFFFF, "di": 0xFFFFFFFF}, _ROWS, sum(_ROWS),
                f"with r as (select k - 1 as row, ({_ROWS})[k] as n, list_sum(({_ROWS})[1:k]) - ({_ROWS})[k] as since from range(1, 26) t(k)) select cast(since + col as bigint) as idx, 60e0 - row * 5e0 as lat, col * 360e0 / n as lon from (select *, unnest(range(n)) as col from r)"),
}


def grid_field(spark, name: str) -> DataFrame:
    """One field on a grid of ``GRIDS``, whose value at a point goes by its index."""
    template, numbers, rows, n, _ = GRIDS[name]
    v = [(k * 7919 % 1000) / 8 for k in range(n)]
    if numbers["scan"] & 0x40:
        v = [v[(numbers["nj"] - 1 - k // numbers["ni"]) * numbers["ni"] + k % numbers["ni"]] for k in range(n)]
    row = (name, template, {k: float(x) for k, x in numbers.items()}, rows, v)
    made = spark.createDataFrame([row], "path string, grid_template int, grid map<string,double>, row_points array<int>, values array<double>")
    return gridded.parse_files(encode.encode_fields(made), "FAILFAST")


def shifted(spark, sf_dir) -> DataFrame:
    return places(spark, sf_dir).select("event_id", (F.col("q_lat") + 0.00123).alias("q_lat"), (F.col("q_lon") + 0.00457).alias("q_lon"))


def _nearest_query(name: str):
    def f(spark, sf_dir):
        found = grids.nearest_values(grid_field(spark, name), shifted(spark, sf_dir), ("path",))
        # Cut between any two numbers of twelve decimals, to which distances are rounded, so that no tie is left to rounding.
        return found.select("event_id", "idx", "value", (F.floor(F.col("distance") * 1e8 + 0.30005) / 1e8).alias("distance"), "error")

    f.__name__ = f"nearest_value_{name}"
    near = NEAREST_SQL.replace("round(min(d), 9)", "floor(min(d) * 1e8 + 0.30005e0) / 1e8").replace("{H}", HAVERSINE).replace("{P}", SHIFTED).replace("{G}", f"({GRIDS[name][4]})").replace("{W}", "true")
    query(f"select event_id, idx, (idx * 7919 % 1000) / 8e0 as value, distance, cast(null as varchar) as error from ({near})")(f)


for _name in GRIDS:
    _nearest_query(_name)


@query("with " + FRACTIONS + ", " + FIELD_SQL.replace("case when idx % 97 <> 0 then (idx * 7919 % 1000) / 8e0 end", "(idx * 7919 % 1000) / 8e0") + """ select event_id, round(a.v * (1 - xf) * (1 - yf) + b.v * xf * (1 - yf) + c.v * (1 - xf) * yf + d.v * xf * yf, 6) as value, outside from w
join g a on a.idx = j0 * 25 + i0 join g b on b.idx = j0 * 25 + i0 + 1 join g c on c.idx = j0 * 25 + 25 + i0 join g d on d.idx = j0 * 25 + 26 + i0""", P=PLACES, CELLS=CELLS)
def bilinear_value_of_messages(spark, sf_dir):
    found = grids.bilinear_values(grid_field(spark, "regular"), places(spark, sf_dir).drop("value"), ("path",))
    return found.select("event_id", digits(F.col("value"), 6).alias("value"), "outside")


# ---- the oblate Earth, Gaussian and reduced grids

OBLATE = geo.EARTH_AXES[4]
MERCATOR_OBLATE = geo.mercator(200, 150, -20.0, 230.0, 20.0, 50000.0, 50000.0, axes=OBLATE)
LAMBERT_OBLATE = geo.lambert(1799, 1059, 21.138123, 237.280472, 262.5, 38.5, 30.0, 60.0, 3000.0, 3000.0, axes=OBLATE)
_T = "(tan(pi() / 4 - radians({x}) / 2) / power((1 - e * sin(radians({x}))) / (1 + e * sin(radians({x}))), e / 2))"


@query("""with k as (select 6378137e0 as a, sqrt(1 - power(6356752.314e0 / 6378137e0, 2)) as e), m as (select *, a * cos(radians(20e0)) / sqrt(1 - power(e * sin(radians(20e0)), 2)) as u from k), o as (select *, -u * ln({T1}) as y0 from m),
c as (select event_id, u, 2 * pi() * u as turn, 199 * 50000e0 / 2 as mid, u * radians(q_lon - 230e0) as x, -u * ln({T2}) - y0 as y from {P} p, o)
select event_id, round((x - turn * round_even((x - mid) / turn, 0)) / 50000e0, 6) as col, round(149 - y / 50000e0, 6) as row from c""", T1=_T.replace("{x}", "-20e0"), T2=_T.replace("{x}", "q_lat"), P=PLACES)
def mercator_oblate(spark, sf_dir):
    fi, fj = MERCATOR_OBLATE.position(F.col("q_lat"), F.col("q_lon"))
    return places(spark, sf_dir).select("event_id", digits(fi, 6).alias("col"), digits(fj, 6).alias("row"))


@query("select event_id, round(q_lat, 6) as lat, round(q_lon, 6) as lon from {P}", P=PLACES)
def lambert_oblate_there_and_back(spark, sf_dir):
    """Positions on a cone about the spheroid and back: the latitude of t by iteration."""
    fi, fj = LAMBERT_OBLATE.position(F.col("q_lat"), F.col("q_lon"))
    at = places(spark, sf_dir).select("event_id", fi.alias("fi"), fj.alias("fj"))
    lat, lon = LAMBERT_OBLATE.coordinates(F.col("fj"), F.col("fi"))
    return at.select("event_id", digits(lat, 6).alias("lat"), digits(geo.into_circle(F.round(lon, 6)), 6).alias("lon"))


@query("select event_id, round(q_lat, 6) as lat, round(q_lon, 6) as lon from {P}", P=PLACES)
def mercator_oblate_there_and_back(spark, sf_dir):
    fi, fj = MERCATOR_OBLATE.position(F.col("q_lat"), F.col("q_lon"))
    at = places(spark, sf_dir).select("event_id", fi.alias("fi"), fj.alias("fj"))
    lat, lon = MERCATOR_OBLATE.coordinates(F.col("fj"), F.col("fi"))
    return at.select("event_id", digits(lat, 6).alias("lat"), digits(geo.into_circle(F.round(lon, 6)), 6).alias("lon"))


@query("select * from (values (640, 89.892396e0, true), (1280, 89.946187e0, true), (2000, 89.965557e0, true)) t(n, first, falling)")
def gaussian_first_latitudes(spark, sf_dir):
    """The first latitude of known grids, cut to millionths; latitudes fall from pole to pole."""
    found = [(n, float(lat[0]), all(a > b for a, b in zip(lat, lat[1:], strict=False)) and len(lat) == 2 * n) for n in (640, 1280, 2000) for lat in [geo.gaussian_latitudes(n)]]
    return spark.createDataFrame(found, "n int, first double, falling boolean").withColumn("first", F.floor(F.col("first") * 1_000_000) / 1_000_000)


@query("""with pl as (select row_number() over (order by p_brand) - 1 as row, count(*) as n from part group by p_brand), b as (select *, sum(n) over (order by row) - n as since, count(*) over () as rows from pl)
select cast(since + i as bigint) as idx, row, round(60e0 - row * 120e0 / (rows - 1), 7) as lat, round(i * 360e0 / n, 7) as lon from (select *, unnest(range(n)) as i from b)""")
def reduced_row_points(spark, sf_dir):
    """A reduced grid whose rows, as many as there are brands, have a point for each part of the brand."""
    pl = [r["n"] for r in table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n")).orderBy("p_brand").collect()]
    points = reduced.reduced_latlon(spark, pl, 60.0, 0.0, -60.0, 360 - 360 / max(pl))
    return points.select("idx", "row", digits(F.col("lat")).alias("lat"), digits(F.col("lon")).alias("lon"))


def _reduced_gaussian(name: str, west: int, east: int, first: Fraction, last: Fraction):
    pl = [16 + 4 * min(k, 15 - k) for k in range(16)]

    def f(spark, sf_dir):
        points = reduced.reduced_gaussian(spark, 8, pl, _GAUSS[0], _GAUSS[15], first, last)
        return points.select("idx", "row", digits(F.col("lat")).alias("lat"), digits(F.col("lon")).alias("lon"))

    f.__name__ = name
    query(f"""with r as (select k - 1 as row, ({pl})[k] as p, ([{_LATITUDES}])[k] as lat from range(1, 17) t(k)), c as (select *, ({west} * p + 359) // 360 as lo, ({east} * p) // 360 as hi from r),
d as (select *, least(hi - lo + 1, p) as n from c), b as (select *, sum(n) over (order by row) - n as since from d)
select cast(since + i as bigint) as idx, row, round(lat, 7) as lat, round(((lo + i) * 360e0 / p) % 360e0, 7) as lon from (select *, unnest(range(n)) as i from b)""")(f)


_reduced_gaussian("reduced_gaussian_circle", 0, 352, Fraction(0), Fraction(360 * 43, 44))
_reduced_gaussian("reduced_gaussian_area", 315, 450, Fraction(-45), Fraction(90))


# ---- values with and without missing points


@query("select user_id, count(*) as n, count(v) as n_present, min(v) as least, max(v) as greatest, round(avg(v), 6) as mean from (select user_id, case when event_type <> 'error' then cast(round(value * 100) as bigint) end as v from events) group by user_id")
def field_stats(spark, sf_dir):
    from isobar.queries import event_fields

    return fields.statistics(event_fields(spark, sf_dir), ["user_id"], "v").withColumn("mean", F.round("mean", 6))


@query("select l_suppkey, count(*) as n_points, count(*) filter (l_quantity > 25) as n_values, count(*) filter (l_quantity > 25) = sum(case when l_quantity > 25 then 1 else 0 end) as fits from lineitem group by l_suppkey")
def bitmap_popcount_check(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_quantity") > 25).cast("int").alias("bit"))
    return fields.bitmap_fits(lines, ["l_suppkey"], "bit", lines.where("bit = 1").groupBy("l_suppkey").agg(F.count("*").alias("n_values")))


@query("select p_partkey, p_partkey * (case when p_size % 2 = 0 then 1e0 else 100e0 end) as level from part")
def surface_level_hpa(spark, sf_dir):
    """Levels of isobaric surfaces (type 100) in hectopascals, others as they are."""
    kind = F.when(F.col("p_size") % 2 == 0, 100).otherwise(103)
    return table(spark, sf_dir, "part").select("p_partkey", names.surface_value_hpa(kind, F.lit(-2), F.col("p_partkey")).alias("level"))

