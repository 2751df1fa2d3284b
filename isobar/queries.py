"""Queries of the gridded-data operators over the driver's tables, and their oracles in SQL.

The tables hold no fields, so fields are derived from them: a supplier's prices, a user's events, a grid of nations by nations.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isobar.functions import bits, names
from isobar.functions import geometry as geo
from isobar.operators import fields, lookup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str = "", **values):
    """Registers a query under its function's name, with its oracle."""

    def put(f):
        QUERIES[f.__name__] = f
        if oracle:
            text = oracle
            for k, v in values.items():
                text = text.replace("{" + k + "}", str(v))
            ORACLES[f.__name__] = text
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A position for every event."""
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", ((e * 7919) % 17800 / 100.0 - 89).alias("q_lat"), ((e * 104729) % 36000 / 100.0).alias("q_lon"), "value")


PLACES = "(select event_id, ((event_id * 7919) % 17800) / 100e0 - 89 as q_lat, ((event_id * 104729) % 36000) / 100e0 as q_lon, value from events)"


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid of 25 by 25 points from the nations, row and column from 0."""
    n = table(spark, sf_dir, "nation").select("n_nationkey")
    a, b = n.select(F.col("n_nationkey").cast("long").alias("row")), n.select(F.col("n_nationkey").cast("long").alias("col"))
    return a.join(F.broadcast(b), F.lit(True))


CELLS = "(select cast(a.n_nationkey as bigint) as row, cast(b.n_nationkey as bigint) as col from nation a cross join nation b)"


def digits(x: Column, n: int = 7) -> Column:
    """Rounded for comparison; -0 is 0."""
    return F.round(x, n) + F.lit(0.0)


# ---- simple packing

SCALES = """
own as (select l_suppkey, min(l_extendedprice) as lo, max(l_extendedprice) as hi, count(*) as n from lineitem group by l_suppkey),
ref as (select *, case when cast(cast(lo as real) as double) > lo then nextafter(cast(lo as real), cast('-infinity' as real)) else cast(lo as real) end as r from own),
scale as (select *, case when lo = hi then 0 else (select min(e) from range(-60, 61) t(e) where round((hi - cast(r as double)) * power(2e0, -e)) <= 65535) end as e, case when lo = hi then 0 else 16 end as w from ref)
"""


@query("with " + SCALES + "select l_suppkey, n, cast(r as double) as reference, cast(e as bigint) as scale, cast(w as bigint) as width from scale")
def simple_pack_scale(spark, sf_dir):
    from isobar.functions.packing import field_scales

    s = field_scales(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_extendedprice", 16)
    return s.select("l_suppkey", "n", F.col("reference").cast("double").alias("reference"), F.col("scale").cast("long").alias("scale"), F.col("width").cast("long").alias("width"))


@query("with " + SCALES + """, p as (select l.l_suppkey, l_extendedprice as v, r, e, w, greatest(0, least(65535, round((l_extendedprice - cast(r as double)) * power(2e0, -e)))) as x from lineitem l join scale using (l_suppkey)),
u as (select *, case when w = 0 then cast(r as double) else cast(r as double) + x * power(2e0, e) end as y from p)
select l_suppkey, count(*) as n, cast(sum(cast(case when w = 0 then 0 else x end as bigint)) as bigint) as sum_packed, max(abs(y - v)) as max_error, max(abs(y - v)) <= 0.5e0 * power(2e0, max(e)) as within from u group by l_suppkey""")
def simple_pack_roundtrip(spark, sf_dir):
    """The flagship: every supplier's prices packed at 16 bits and unpacked; no error exceeds half a step."""
    p = fields.simple_roundtrip(table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice"), ["l_suppkey"], ["l_orderkey", "l_linenumber"], "l_extendedprice", 16)
    error = F.abs(F.col("unpacked") - F.col("l_extendedprice"))
    return p.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.sum("packed").alias("sum_packed"), F.max(error).alias("max_error"), (F.max(error) <= 0.5 * F.pow(F.lit(2.0), F.max("scale"))).alias("within"))


@query("select l_returnflag, count(*) as n, 0 as width, max(3.5e0) as value from lineitem group by l_returnflag")
def simple_pack_constant(spark, sf_dir):
    """A constant field takes no bits and decodes to its reference."""
    p = table(spark, sf_dir, "lineitem").select("l_returnflag", F.lit(3.5).alias("v"), "l_orderkey")
    r = fields.simple_roundtrip(p, ["l_returnflag"], ["l_orderkey"], "v", 12)
    return r.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.max("width").alias("width"), F.max("unpacked").alias("value"))


# ---- differences, bitmaps, scanning, run lengths, missing values


def event_fields(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("user_id", "event_id", F.when(F.col("event_type") != "error", F.round(F.col("value") * 100).cast("long")).alias("v"))


EVENTS = "(select user_id, event_id, case when event_type <> 'error' then cast(round(value * 100) as bigint) end as v from events)"
DIFF = """with f as (select * from {EVENTS}), p as (select *, row_number() over (partition by user_id order by event_id) - 1 as k, v - lag(v) over (partition by user_id order by event_id) as d1,
 v - 2 * lag(v) over (partition by user_id order by event_id) + lag(v, 2) over (partition by user_id order by event_id) as d2 from f where v is not null)
select f.user_id, f.event_id, f.v, case when k < {order} then p.v else d{order} end as diff from f left join p using (user_id, event_id)"""


@query(DIFF, EVENTS=EVENTS, order=1)
def spatial_diff_encode1(spark, sf_dir):
    return fields.spatial_difference(event_fields(spark, sf_dir), ["user_id"], "event_id", "v", 1).drop("nth")


@query(DIFF, EVENTS=EVENTS, order=2)
def spatial_diff_encode2(spark, sf_dir):
    return fields.spatial_difference(event_fields(spark, sf_dir), ["user_id"], "event_id", "v", 2).drop("nth")


@query("select user_id, event_id, v as value from {EVENTS}", EVENTS=EVENTS)
def spatial_diff_decode1(spark, sf_dir):
    d = fields.spatial_difference(event_fields(spark, sf_dir), ["user_id"], "event_id", "v", 1).drop("nth")
    return fields.spatial_integrate(d, ["user_id"], "event_id", "diff", 1).select("user_id", "event_id", "value")


@query("select user_id, event_id, v as value from {EVENTS}", EVENTS=EVENTS)
def spatial_diff_decode2(spark, sf_dir):
    d = fields.spatial_difference(event_fields(spark, sf_dir), ["user_id"], "event_id", "v", 2).drop("nth")
    return fields.spatial_integrate(d, ["user_id"], "event_id", "diff", 2).select("user_id", "event_id", "value")


@query("select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as idx, case when l_quantity > 25 then l_extendedprice end as value from lineitem")
def bitmap_expand(spark, sf_dir):
    """An order's lines as a field whose bitmap marks quantities over 25; the packed values are those of marked lines."""
    from isobar.functions.packing import rank_in_field

    idx = F.row_number().over(rank_in_field(["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"])).cast("long")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", idx.alias("idx"), (F.col("l_quantity") > 25).cast("long").alias("bit"), "l_extendedprice")
    packed = lines.where("bit = 1").select("l_orderkey", F.row_number().over(rank_in_field(["l_orderkey"], ["idx"])).alias("rank"), F.col("l_extendedprice").alias("value"))
    return fields.expand_bitmap(lines.drop("l_extendedprice"), packed, ["l_orderkey"], "idx", "bit", "rank", "value").drop("bit")


def _scan_query(mode: int):
    # The oracle walks the grid in data order: axes turned first, then every other line.
    col = "24 - col" if mode & 0x80 else "col"
    row = "24 - row" if mode & 0x40 else "row"
    turned = f"(select row, col, {row} as srow, {col} as scol from {CELLS})"
    line, step = (("scol", "srow") if mode & 0x20 else ("srow", "scol"))
    place = f"{line} * 25 + " + (f"case when {line} % 2 = 1 then 24 - {step} else {step} end" if mode & 0x10 else step)

    def scan(spark, sf_dir):
        c = cells(spark, sf_dir).select((F.col("row") * 25 + F.col("col")).alias("source"))
        return c.select("source", fields.canonical_index(F.col("source"), mode, 25, 25).alias("idx"))

    scan.__name__ = f"scan_reorder_0x{mode:02x}"
    query(f"select {place} as source, row * 25 + col as idx from {turned}")(scan)


for _mode in range(0, 256, 16):
    _scan_query(_mode)

LEVELS = "(select l_suppkey, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_quantity) - 1 as idx, nullif(cast(floor(l_quantity / 25) as bigint), 0) as level from lineitem)"


def level_fields(spark, sf_dir) -> DataFrame:
    from isobar.functions.packing import rank_in_field

    idx = F.row_number().over(rank_in_field(["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"])) - 1
    level = F.floor(F.col("l_quantity") / 25).cast("long")
    return table(spark, sf_dir, "lineitem").select("l_suppkey", idx.cast("long").alias("idx"), F.when(level > 0, level).alias("level"))


@query("""with f as (select * from {LEVELS}), g as (select *, idx - row_number() over (partition by l_suppkey, coalesce(level, 0) order by idx) as island from f)
select l_suppkey, min(idx) as start, coalesce(level, 0) as level, count(*) as length from g group by l_suppkey, coalesce(level, 0), island""", LEVELS=LEVELS)
def run_length_encode(spark, sf_dir):
    r = fields.run_length_encode(level_fields(spark, sf_dir), ["l_suppkey"], "idx", "level", 4, 3)
    w = fields.Window.partitionBy("l_suppkey").orderBy("run")
    return r.select("l_suppkey", (F.sum("length").over(w) - F.col("length")).alias("start"), "level", "length")


@query("select l_suppkey, cast(idx as bigint) as idx, level from {LEVELS}", LEVELS=LEVELS)
def run_length_decode(spark, sf_dir):
    r = fields.run_length_encode(level_fields(spark, sf_dir), ["l_suppkey"], "idx", "level", 4, 3)
    codes = r.select("l_suppkey", "run", F.posexplode("codes").alias("k", "code")).withColumn("i", F.col("run") * 100 + F.col("k"))
    return fields.run_length_decode(codes, ["l_suppkey"], "i", "code", 4, 3)


KINDS = "select l_orderkey, l_linenumber, case when {test} end as kind from (select *, l_orderkey % 3 as w, cast(l_linenumber as bigint) % 4 as x, 252 + l_partkey % 4 as g from lineitem)"


def _kinds(spark, sf_dir, management):
    w, x, g = F.col("l_orderkey") % 3, F.col("l_linenumber").cast("long") % 4, 252 + F.col("l_partkey") % 4
    packed = F.when(w > 0, x % F.call_function("shiftleft", F.lit(1).cast("long"), w.cast("int")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", fields.missing_kind(packed, g, w, 8, management).alias("kind"))


@query(KINDS, test="(w = 0 and g = 255) or (w = 1 and x % 2 = 1) or (w = 2 and x = 3) then 1 else 0")
def missing_management_1(spark, sf_dir):
    return _kinds(spark, sf_dir, 1)


@query(KINDS, test="(w = 0 and g = 255) or (w = 1 and x % 2 = 1) or (w = 2 and x = 3) then 1 when (w = 0 and g = 254) or (w = 1 and x % 2 = 0) or (w = 2 and x = 2) then 2 else 0")
def missing_management_2(spark, sf_dir):
    return _kinds(spark, sf_dir, 2)


def _sign_query(width):
    def f(spark, sf_dir):
        x = (F.col("o_orderkey") * 7919 + F.col("o_custkey")) % (1 << width)
        v = bits.from_sign_magnitude(x, width)
        return table(spark, sf_dir, "orders").select("o_orderkey", v.alias("value"), bits.to_sign_magnitude(v, width).alias("stored"))

    f.__name__ = f"sign_magnitude_{width}"
    top = 1 << (width - 1)
    query(f"with x as (select o_orderkey, (o_orderkey * 7919 + o_custkey) % {1 << width} as x from orders) select o_orderkey, case when x >= {top} then {top} - x else x end as value, case when x = {top} then 0 else x end as stored from x")(f)


for _w in (8, 16, 32):
    _sign_query(_w)


@query("select p_partkey, (p_partkey >> 12) & 15 as a, (p_partkey >> 4) & 255 as b, p_partkey & 65535 as c from part")
def bit_extract(spark, sf_dir):
    x = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", bits.take_bits(x, 16, 0, 4).alias("a"), bits.take_bits(x, 16, 4, 12).alias("b"), bits.take_bits(x, 16, 0, 16).alias("c"))


@query("select p_partkey, p_retailprice as want, cast(cast(p_retailprice as real) as double) as value from part")
def ieee_single(spark, sf_dir):
    """Single-precision numbers put together from their 32 bits: exponent by logarithm, fraction by what is left."""
    v = F.col("p_retailprice").cast("float").cast("double")
    e = F.floor(F.log2(v))
    word = (e + 127) * (1 << 23) + ((v / F.pow(F.lit(2.0), e) - 1) * (1 << 23)).cast("long")
    return table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("want"), bits.ieee_single(word).alias("value"))


# ---- geometry

REGULAR = geo.RegularGrid.of(25, 25, 60.0, -10.0, 12.0, 38.0, 2.0)
SEAM = geo.RegularGrid.of(36, 25, 60.0, 0.0, -60.0, 350.0, 10.0)
REGULAR_SQL = "(select row * 25 + col as idx, 60e0 - row * 2e0 as lat, (col * 2e0 + 350e0) % 360e0 as lon from {CELLS})".replace("{CELLS}", CELLS)


@query("select idx, round(lat, 7) as lat, round(lon, 7) as lon from {G}", G=REGULAR_SQL)
def grid_coords_regular(spark, sf_dir):
    c = cells(spark, sf_dir)
    return c.select((F.col("row") * 25 + F.col("col")).alias("idx"), digits(REGULAR.latitude(F.col("row"))).alias("lat"), digits(REGULAR.longitude(F.col("col"))).alias("lon"))


@query("select event_id, cast(floor(q_lon / 10e0) as bigint) % 36 as west, (cast(floor(q_lon / 10e0) as bigint) + 1) % 36 as east, round(q_lon / 10e0 - floor(q_lon / 10e0), 7) as xf, q_lat > 60 or q_lat < -60 as outside from {P}", P=PLACES)
def grid_global_seam(spark, sf_dir):
    """Columns of a grid that goes round the world: the last neighbours the first."""
    w = SEAM.weights(F.col("q_lat"), F.col("q_lon"))
    p = places(spark, sf_dir).withColumn("w", w)
    return p.select("event_id", (F.col("w.i00") % 36).alias("west"), (F.col("w.i10") % 36).alias("east"), digits(F.col("w.xf")).alias("xf"), F.col("w.outside").alias("outside"))


ROTATED = dict(pole_lat=-31.758312, pole_lon=-92.402969)
UNROTATE_SQL = """with c as (select row * 25 + col as idx, radians(60e0 - row * 2e0) as p, radians(col * 2e0 - 10e0) as l, radians(-(90e0 - 31.758312e0)) as t, radians(92.402969e0) as o from {CELLS}),
v as (select *, cos(l) * cos(p) as x, sin(l) * cos(p) as y, sin(p) as z from c)
select idx, round(degrees(asin(-sin(t) * x + cos(t) * z)), 6) as lat, round(degrees(atan2(-cos(t) * sin(o) * x + cos(o) * y - sin(t) * sin(o) * z, cos(t) * cos(o) * x + sin(o) * y + sin(t) * cos(o) * z)), 6) as lon from v"""


@query(UNROTATE_SQL, CELLS=CELLS)
def rotated_coords(spark, sf_dir):
    lat, lon = geo.unrotate(60.0 - F.col("row") * 2.0, F.col("col") * 2.0 - 10.0, **ROTATED)
    return cells(spark, sf_dir).select((F.col("row") * 25 + F.col("col")).alias("idx"), digits(lat, 6).alias("lat"), digits(lon, 6).alias("lon"))


@query("select event_id, round(q_lat, 4) as lat, round(q_lon, 4) as lon from {P}", P=PLACES)
def unrotate_roundtrip(spark, sf_dir):
    """Every position, with poles and date line, there and back. Longitudes lie within [0, 360), as 180 and -180 are the same."""
    lat, lon = geo.unrotate(*geo.rotate(F.col("q_lat"), F.col("q_lon"), **ROTATED), **ROTATED)
    return places(spark, sf_dir).select("event_id", digits(lat, 4).alias("lat"), digits(geo.into_circle(F.round(lon, 4)), 4).alias("lon"))


LAMBERT = geo.lambert(1799, 1059, 21.138123, 237.280472, 262.5, 38.5, 38.5, 38.5, 3000.0, 3000.0)
POLAR = geo.polar_stereographic(1299, 919, 41.612949, 185.117126, 225.0, 60.0, 3000.0, 3000.0)
MERCATOR = geo.mercator(200, 150, -20.0, 230.0, 20.0, 50000.0, 50000.0)
LAMBERT_SQL = """k as (select 6371229e0 as r, sin(radians(38.5e0)) as n),
s as (select *, r * cos(radians(38.5e0)) / (n * power(tan(radians((90e0 - 38.5e0) / 2)), n)) as size from k),
m as (select *, size * power(tan(radians((90e0 - 38.5e0) / 2)), n) as mid, size * power(tan(radians((90e0 - 21.138123e0) / 2)), n) as r1, n * radians(237.280472e0 - 262.5e0) as a1 from s),
o as (select *, r1 * sin(a1) as x0, mid - r1 * cos(a1) as y0 from m)"""


#: What is left of a longitude's distance from the meridian {M} after the nearest number of turns.
TURNED_SQL = "(q_lon - {M} - 360e0 * round_even((q_lon - {M}) / 360e0, 0))"


@query("with " + LAMBERT_SQL + """ select event_id, round((size * power(tan(radians((90e0 - q_lat) / 2)), n) * sin(n * radians({T})) - x0) / 3000e0, 6) as col,
round(1058 - (mid - size * power(tan(radians((90e0 - q_lat) / 2)), n) * cos(n * radians({T})) - y0) / 3000e0, 6) as row from {P} p, o""", T=TURNED_SQL.replace("{M}", "262.5e0"), P=PLACES)
def lambert_forward(spark, sf_dir):
    """Every position, beyond the seam of the cone and in the other hemisphere too."""
    fi, fj = LAMBERT.position(F.col("q_lat"), F.col("q_lon"))
    return places(spark, sf_dir).select("event_id", digits(fi, 6).alias("col"), digits(fj, 6).alias("row"))


@query("with " + LAMBERT_SQL + """, c as (select row * 25 + col as idx, x0 + col * 3000e0 * 70 as px, mid - y0 - (1058 - row * 40) * 3000e0 as py, n, size from {CELLS}, o)
select idx, round(90e0 - 2 * degrees(atan(power(sqrt(px * px + py * py) / size, 1 / n))), 7) as lat, round((degrees(atan2(px, py) / n) + 262.5e0) % 360e0, 7) as lon from c""", CELLS=CELLS)
def lambert_inverse(spark, sf_dir):
    lat, lon = LAMBERT.coordinates(F.col("row") * 40, F.col("col") * 70)
    return cells(spark, sf_dir).select((F.col("row") * 25 + F.col("col")).alias("idx"), digits(lat).alias("lat"), digits(lon).alias("lon"))


POLAR_SQL = """k as (select 6371229e0 * (1 + sin(radians(60e0))) as s), o as (select s, s * tan(radians((90e0 - 41.612949e0) / 2)) * sin(radians(185.117126e0 - 225e0)) as x0, -s * tan(radians((90e0 - 41.612949e0) / 2)) * cos(radians(185.117126e0 - 225e0)) as y0 from k)"""


@query("with " + POLAR_SQL + """ select event_id, round((s * tan(radians((90e0 - q_lat) / 2)) * sin(radians({T})) - x0) / 3000e0, 5) as col,
round(918 - (-s * tan(radians((90e0 - q_lat) / 2)) * cos(radians({T})) - y0) / 3000e0, 5) as row from {P} p, o""", T=TURNED_SQL.replace("{M}", "225e0"), P=PLACES)
def polar_forward(spark, sf_dir):
    """Every position; only the other pole itself has no place."""
    fi, fj = POLAR.position(F.col("q_lat"), F.col("q_lon"))
    return places(spark, sf_dir).select("event_id", digits(fi, 5).alias("col"), digits(fj, 5).alias("row"))


@query("with " + POLAR_SQL + """, c as (select row * 25 + col as idx, x0 + col * 50 * 3000e0 as px, y0 + (918 - row * 37) * 3000e0 as py, s from {CELLS}, o)
select idx, round(90e0 - 2 * degrees(atan(sqrt(px * px + py * py) / s)), 7) as lat, round((degrees(atan2(px, -py)) + 225e0 + 360e0) % 360e0, 7) as lon from c""", CELLS=CELLS)
def polar_inverse(spark, sf_dir):
    lat, lon = POLAR.coordinates(F.col("row") * 37, F.col("col") * 50)
    return cells(spark, sf_dir).select((F.col("row") * 25 + F.col("col")).alias("idx"), digits(lat).alias("lat"), digits(lon).alias("lon"))


MERCATOR_SQL = "k as (select 6371229e0 * cos(radians(20e0)) as u), o as (select u, -u * ln(tan(radians((90e0 + 20e0) / 2))) as y0 from k)"


@query("with " + MERCATOR_SQL + """, c as (select event_id, q_lat, u, y0, u * radians(q_lon - 230e0) as x, 199 * 50000e0 / 2 as mid, 2 * pi() * u as turn from {P} p, o)
select event_id, round((x - turn * round_even((x - mid) / turn, 0)) / 50000e0, 6) as col, round(149 - (-u * ln(tan(radians((90e0 - q_lat) / 2))) - y0) / 50000e0, 6) as row from c""", P=PLACES)
def mercator_forward(spark, sf_dir):
    """Every position, at the place of its meridian that is nearest to the middle of the grid."""
    fi, fj = MERCATOR.position(F.col("q_lat"), F.col("q_lon"))
    return places(spark, sf_dir).select("event_id", digits(fi, 6).alias("col"), digits(fj, 6).alias("row"))


@query("with " + MERCATOR_SQL + """ select row * 25 + col as idx, round(90e0 - 2 * degrees(atan(exp(-((149 - row * 6) * 50000e0 + y0) / u))), 7) as lat, round((230e0 + degrees(col * 8 * 50000e0 / u)) % 360e0, 7) as lon from {CELLS}, o""", CELLS=CELLS)
def mercator_inverse(spark, sf_dir):
    lat, lon = MERCATOR.coordinates(F.col("row") * 6, F.col("col") * 8)
    return cells(spark, sf_dir).select((F.col("row") * 25 + F.col("col")).alias("idx"), digits(lat).alias("lat"), digits(lon).alias("lon"))


@query("""with k as (select 6378.137e0 as a, 6356.752314e0 as b, 6.6107e0 as nr), g as (select *, nr * a as h, 2 * asin(1 / nr) as size, power(a / b, 2) as q from k),
c as (select row * 25 + col as idx, (col - 12e0) * size / 24 as x, ((24 - row) - 12e0) * (b / a) * size / 24 as y, g.* from {CELLS}, g),
d as (select *, sqrt(1 - power(sin(x), 2)) * sqrt(1 - power(sin(y), 2)) as cc, 1 + (q - 1) * power(sin(y), 2) as st from c),
e as (select *, power(h * cc, 2) - st * (h * h - a * a) as sight from d),
f as (select *, case when sight > 0 then (h * cc - sqrt(sight)) / st end as sn from e)
select idx, sight > 0 as on_disc, round(coalesce(degrees(atan(q * sn * sin(y) / sqrt(power(h - sn * cc, 2) + power(sn * sin(x) * sqrt(1 - power(sin(y), 2)), 2)))), 0), 7) + 0e0 as lat,
round(coalesce((degrees(atan(sn * sin(x) * sqrt(1 - power(sin(y), 2)) / (h - sn * cc))) + 75e0), 0), 7) as lon from f""", CELLS=CELLS)
def space_view(spark, sf_dir):
    lat, lon, on = geo.space_view(F.col("row"), F.col("col"), 25, 25, 24.0, 24.0, 12.0, 12.0, 6.6107, 75.0, scan=0x40, axes=geo.EARTH_AXES[4])
    return cells(spark, sf_dir).select((F.col("row") * 25 + F.col("col")).alias("idx"), on.alias("on_disc"), digits(lat).alias("lat"), digits(lon).alias("lon"))


@query("select * from (values (0, 6367470e0, 6367470e0), (1, 6371000e0, 6371000e0), (2, 6378160e0, 6356775e0), (3, 6378169e0, 6356583.8e0), (4, 6378137e0, 6356752.314e0), (5, 6378137e0, 6356752.314e0), (6, 6371229e0, 6371229e0), (7, 6378388e0, 6356911.9e0), (8, 6371200e0, 6371200e0), (9, 6377563.396e0, 6356256.909e0)) t(shape, major, minor)")
def earth_axes(spark, sf_dir):
    given = {1: dict(radius=(0, 6371000)), 3: dict(major=(3, 6378169), minor=(4, 63565838)), 7: dict(major=(0, 6378388), minor=(1, 63569119))}
    return spark.createDataFrame([(s, *map(float, geo.earth_axes(s, **given.get(s, {})))) for s in range(10)], "shape int, major double, minor double").select("shape", F.round("major", 3).alias("major"), F.round("minor", 3).alias("minor"))


# ---- point queries

HAVERSINE = "round(2 * asin(sqrt(power(sin(radians(lat - q_lat) / 2), 2) + cos(radians(q_lat)) * cos(radians(lat)) * power(sin(radians(lon - q_lon) / 2), 2))), 12)"
NEAREST_SQL = "select event_id, arg_min(idx, (d, idx)) as idx, round(min(d), 9) as distance from (select event_id, idx, {H} as d from {P} p, {G} g where {W}) group by event_id"


@query(NEAREST_SQL, H=HAVERSINE, P=PLACES, G=REGULAR_SQL, W="true")
def nearest_brute(spark, sf_dir):
    points = lookup.grid_points(spark, REGULAR)
    near = lookup.nearest_by_cells(places(spark, sf_dir), points, ["event_id"])
    return near.select("event_id", "idx", digits(F.col("distance"), 9).alias("distance"))


FRACTIONS = """f as (select event_id, (60e0 - q_lat) / 2 as fj, case when (q_lon + 10) % 360 / 2 > 24 and (360 - (q_lon + 10) % 360) / 2 < (q_lon + 10) % 360 / 2 - 24 then -(360 - (q_lon + 10) % 360) / 2 else (q_lon + 10) % 360 / 2 end as fi from {P}),
w as (select event_id, greatest(0, least(cast(floor(fi) as bigint), 23)) as i0, greatest(0, least(cast(floor(fj) as bigint), 23)) as j0, case when floor(fi) < 0 then 0e0 when floor(fi) >= 24 then 1e0 else fi - floor(fi) end as xf,
 case when floor(fj) < 0 then 0e0 when floor(fj) >= 24 then 1e0 else fj - floor(fj) end as yf, fi < 0 or fj < 0 or fi > 24 or fj > 24 as outside from f)"""
FIELD_SQL = "g as (select idx, case when idx % 97 <> 0 then (idx * 7919 % 1000) / 8e0 end as v from (select row * 25 + col as idx from {CELLS}))"


def field_values(spark, sf_dir) -> DataFrame:
    """One field on the regular grid, as an array with a few missing points."""
    idx = F.col("row") * 25 + F.col("col")
    v = F.when(idx % 97 != 0, (idx * 7919 % 1000) / 8.0)
    return cells(spark, sf_dir).agg(F.transform(F.array_sort(F.collect_list(F.struct(idx.alias("i"), v.alias("v")))), lambda s: s["v"]).alias("values")).withColumn("grid_id", F.lit(1))


@query("with " + FRACTIONS + ", " + FIELD_SQL + """ select event_id, round(a.v * (1 - xf) * (1 - yf) + b.v * xf * (1 - yf) + c.v * (1 - xf) * yf + d.v * xf * yf, 7) as value from w
join g a on a.idx = j0 * 25 + i0 join g b on b.idx = j0 * 25 + i0 + 1 join g c on c.idx = j0 * 25 + 25 + i0 join g d on d.idx = j0 * 25 + 26 + i0""", P=PLACES, CELLS=CELLS)
def bilinear(spark, sf_dir):
    q = places(spark, sf_dir).drop("value").withColumn("grid_id", F.lit(1))
    return lookup.bilinear(q, F.broadcast(field_values(spark, sf_dir)), REGULAR, ["grid_id"]).select("event_id", digits(F.col("value")).alias("value"))


@query("with " + FRACTIONS + " select event_id, case when round((1 - xf) * (1 - yf), 9) >= round(greatest(xf * (1 - yf), (1 - xf) * yf, xf * yf), 9) then j0 * 25 + i0 when round(xf * (1 - yf), 9) >= round(greatest((1 - xf) * yf, xf * yf), 9) then j0 * 25 + i0 + 1 when round((1 - xf) * yf, 9) >= round(xf * yf, 9) then j0 * 25 + 25 + i0 else j0 * 25 + 26 + i0 end as idx from w", P=PLACES)
def nearest_corner(spark, sf_dir):
    """Every position: of equal weights the first counts."""
    w = places(spark, sf_dir).select("event_id", REGULAR.weights(F.col("q_lat"), F.col("q_lon")).alias("w"))
    return w.select("event_id", geo.nearest_corner(F.col("w")).alias("idx"))


@query("with " + FRACTIONS + " select event_id, j0 * 25 + i0 as i00, round(xf, 7) as xf, round(yf, 7) as yf, outside from w", P=PLACES)
def weights_outside(spark, sf_dir):
    w = places(spark, sf_dir).select("event_id", REGULAR.weights(F.col("q_lat"), F.col("q_lon")).alias("w"))
    return w.select("event_id", "w.i00", digits(F.col("w.xf")).alias("xf"), digits(F.col("w.yf")).alias("yf"), "w.outside")


@query("select event_id, cast(floor((60e0 - q_lat) / 2) as bigint) as k, round((60e0 - q_lat) / 2 - floor((60e0 - q_lat) / 2), 7) as fraction from {P} where q_lat < 60 and q_lat >= 12", P=PLACES)
def row_range_join(spark, sf_dir):
    """Between which rows a position lies, as a join on a range of latitudes."""
    rows = spark.range(24).select(F.col("id").alias("k"), (60.0 - F.col("id") * 2.0).alias("lat"), (58.0 - F.col("id") * 2.0).alias("below"))
    hit = lookup.row_between(places(spark, sf_dir), rows, ["event_id"])
    # A position on a row belongs to the cell above it here, to the one below in floor().
    on_row = F.round("fraction", 9) == 1
    return hit.select("event_id", F.when(on_row, F.col("k") + 1).otherwise(F.col("k")).alias("k"), digits(F.when(on_row, F.lit(0.0)).otherwise(F.col("fraction"))).alias("fraction"))


# ---- wind


@query("select event_id, round(sin(radians(38.5e0)) * radians({T}), 9) as north from {P}", T=TURNED_SQL.replace("{M}", "262.5e0"), P=PLACES)
def grid_north_lambert(spark, sf_dir):
    """At every position, by the nearest turn to the cone's meridian."""
    return places(spark, sf_dir).select("event_id", digits(LAMBERT.grid_north(F.col("q_lat"), F.col("q_lon")), 9).alias("north"))


ROTATED_NORTH = "atan2(sin(radians(87.597031e0) - radians(q_lon)) * cos(radians(31.758312e0)), cos(radians(q_lat)) * sin(radians(31.758312e0)) - sin(radians(q_lat)) * cos(radians(31.758312e0)) * cos(radians(87.597031e0) - radians(q_lon)))"


@query("select event_id, round({N}, 9) as north from {P}", N=ROTATED_NORTH, P=PLACES)
def grid_north_rotated(spark, sf_dir):
    return places(spark, sf_dir).select("event_id", digits(geo.rotated_north(F.col("q_lat"), F.col("q_lon"), **ROTATED), 9).alias("north"))


@query("select event_id, round(case when event_id % 2 = 0 then value else value * cos(a) + value / 2 * sin(a) end, 6) as east, round(case when event_id % 2 = 0 then value / 2 else value / 2 * cos(a) - value * sin(a) end, 6) as north from (select *, {N} as a from {P})", N=ROTATED_NORTH, P=PLACES)
def wind_to_earth(spark, sf_dir):
    """Winds along the grid, where their flags say so, turned to east and north."""
    flags = F.when(F.col("event_id") % 2 == 0, 0).otherwise(0x08)
    u, v = F.col("value"), F.col("value") / 2
    east, north = geo.to_earth(u, v, geo.rotated_north(F.col("q_lat"), F.col("q_lon"), **ROTATED))
    own = geo.grid_relative(flags)
    return places(spark, sf_dir).select("event_id", digits(F.when(own, east).otherwise(u), 6).alias("east"), digits(F.when(own, north).otherwise(v), 6).alias("north"))


# ---- metadata


@query("select p_partkey, case when p_size % 10 = 9 then null when p_size % 10 = 0 then p_partkey * 1e0 when p_size % 10 < 5 then p_partkey / power(10e0, p_size % 10) else p_partkey * power(10e0, p_size % 10 - 4) end as level from part")
def surface_level(spark, sf_dir):
    s = F.col("p_size") % 10
    scale = F.when(s < 5, s).otherwise(4 - s)
    value = F.when(s == 9, F.lit(0xFFFFFFFF)).otherwise(F.col("p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey", names.surface_value(scale, value).alias("level"))


CODES = "(select p_partkey, case when p_size % 2 = 0 then 7 else 98 end as centre, 0 as discipline, cast(p_partkey % 4 as integer) as category, cast(case when p_size % 3 = 0 then 192 + p_partkey % 8 else p_partkey % 10 end as integer) as number from part)"


def codes(spark, sf_dir) -> DataFrame:
    p, s = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", F.when(s % 2 == 0, 7).otherwise(98).alias("centre"), F.lit(0).alias("discipline"), (p % 4).cast("int").alias("category"), F.when(s % 3 == 0, 192 + p % 8).otherwise(p % 10).cast("int").alias("number"))


def _values(text: str) -> str:
    rows = []
    for line in text.strip().splitlines():
        d, c, n, rest = line.split(" ", 3)
        rows.append(f"({d}, {c}, {n}, '" + "', '".join(rest.split("|")) + "')")
    return "(values " + ", ".join(rows) + ")"


@query("""select p_partkey, coalesce(l.name, w.name, 'Unknown parameter (' || c.discipline || ', ' || c.category || ', ' || c.number || ')') as parameter, coalesce(l.unit, w.unit, 'unknown') as unit
from {C} c left join {W} w(d, k, n, name, unit) on c.discipline = w.d and c.category = w.k and c.number = w.n left join {L} l(d, k, n, name, unit) on c.centre = 7 and c.discipline = l.d and c.category = l.k and c.number = l.n and c.number >= 192""", C=CODES, W=_values(names.PARAMETERS), L=_values(names.LOCAL_PARAMETERS))
def parameter_name_for(spark, sf_dir):
    return names.with_parameter(codes(spark, sf_dir)).select("p_partkey", "parameter", "unit")


@query("""select p_partkey, coalesce(s.name, 'Unknown surface type (' || code || ')') as surface, coalesce(t.name, 'Unknown data type (' || kind || ')') as data_type from (select p_partkey, cast(p_partkey % 256 as integer) as code, cast(p_size % 12 as integer) as kind from part)
left join {S} s(c, name) on s.c = code left join {T} t(c, name) on t.c = kind""", **{k: "(values " + ", ".join(f"({c}, '{n}')" for c, n in (x.split(" ", 1) for x in names.TABLES[t].strip().splitlines())) + ")" for k, t in (("S", "surface type"), ("T", "data type"))})
def code_names_unknown(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 256).cast("int").alias("code"), (F.col("p_size") % 12).cast("int").alias("kind"))
    return names.with_name(names.with_name(p, "code", "surface type", "surface"), "kind", "data type", "data_type").select("p_partkey", "surface", "data_type")


TIMES = "(select o_orderkey, 2000 + cast(o_custkey % 30 as integer) as y, 1 + cast(o_orderkey % 13 as integer) as mo, 1 + cast(o_custkey % 31 as integer) as d, cast(o_orderkey % 25 as integer) as h from orders)"


@query("""select o_orderkey, case when mo <= 12 and h <= 23 and d <= day(last_day(make_date(y, least(mo, 12), 1))) then make_timestamp(y, mo, d, h, 0, 0) end as valid_time,
make_timestamp(y, 1, 1, 0, 0, 0) + to_months(mo - 1) + to_days(d - 1) + to_hours(h) as normal_time from {T}""", T=TIMES)
def reference_time_valid(spark, sf_dir):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    parts = (2000 + c % 30).cast("int"), (1 + o % 13).cast("int"), (1 + c % 31).cast("int"), (o % 25).cast("int"), F.lit(0), F.lit(0)
    return table(spark, sf_dir, "orders").select("o_orderkey", names.valid_time(*parts).alias("valid_time"), names.reference_time(*parts).alias("normal_time"))


# ---- whole messages: written, read and decoded again

VALUES = "(select l_suppkey, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_quantity) - 1 as idx, case when l_quantity < 48 then l_extendedprice end as value from lineitem)"


def supplier_arrays(spark, sf_dir) -> DataFrame:
    """Each supplier's prices in order as one field, with missing points."""
    key = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", F.when(F.col("l_quantity") < 48, F.col("l_extendedprice")).alias("v"))
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.transform(F.array_sort(F.collect_list(key)), lambda s: s["v"]).alias("values"))


def _through_messages(spark, sf_dir, packing, bits_):
    from isobar.sources import encode, gridded

    files = encode.encode_rows(supplier_arrays(spark, sf_dir), "l_suppkey", packing, bits_)
    decoded = gridded.decode_fields(gridded.parse_files(files, "FAILFAST"), ("path", "packing_template"))
    return decoded


@query("select l_suppkey, cast(idx as integer) as idx, value from {V}", V=VALUES)
def message_ieee_roundtrip(spark, sf_dir):
    """Messages that keep values whole, with a bit map: every point comes back as it was."""
    from isobar.sources.gridded import points_of

    return points_of(_through_messages(spark, sf_dir, "ieee", 64)).select(F.col("path").cast("long").alias("l_suppkey"), "idx", "value")


def _message_query(packing: str, template: int, bits_: int, reach: int):
    def f(spark, sf_dir):
        d = _through_messages(spark, sf_dir, packing, bits_).select(F.col("path").cast("long").alias("l_suppkey"), "packing_template", F.col("values").alias("got"))
        both = d.join(supplier_arrays(spark, sf_dir), "l_suppkey")
        errors = F.zip_with("values", "got", lambda a, b: F.abs(a - b))
        here = F.size(F.filter("got", lambda x: x.isNotNull()))
        return both.select("l_suppkey", F.col("packing_template").alias("template"), F.size("got").cast("long").alias("n"), here.cast("long").alias("n_present"), (F.array_max(errors) <= float(reach)).alias("within"))

    f.__name__ = f"message_{packing}_roundtrip"
    query("select l_suppkey, {T} as template, count(*) as n, count(value) as n_present, true as within from {V} group by l_suppkey", T=template, V=VALUES)(f)


for _args in (("simple", 0, 16, 2), ("png", 41, 16, 2), ("ccsds", 42, 16, 2), ("jpeg2000", 40, 16, 2), ("complex", 2, 16, 2), ("complex1", 3, 16, 2), ("complex2", 3, 16, 2)):
    _message_query(*_args)


@query("select l_suppkey, 98 as centre, 'European Centre for Medium-Range Weather Forecasts (ECMWF)' as centre_name, 'Temperature' as parameter, 'K' as unit, 2e0 as level, count(*) as n_points from lineitem group by l_suppkey")
def message_inventory(spark, sf_dir):
    """What messages are about, without decoding any value."""
    from isobar.sources import encode, gridded

    f = gridded.parse_files(encode.encode_rows(supplier_arrays(spark, sf_dir), "l_suppkey", "simple", 12), data=False)
    n = gridded.number
    named = f.select(F.col("path").cast("long").alias("l_suppkey"), n("identification", "centre").cast("int").alias("centre"), "discipline", n("product", "category").cast("int").alias("category"), n("product", "number").cast("int").alias("number"), names.surface_value(n("product", "surface1_scale"), n("product", "surface1_value")).alias("level"), "n_points")
    return names.with_parameter(names.with_name(named, "centre", "centre", "centre_name")).select("l_suppkey", "centre", "centre_name", "parameter", "unit", "level", "n_points")


# ---- statistics and the relational surface


@query("select user_id, sha256(string_agg(coalesce(cast(cast(round(v * 10e0 * 0.5e0) as bigint) as varchar), ''), ',' order by event_id)) as fingerprint, count(*) as n, count(v) as n_present from {E} group by user_id", E=EVENTS)
def fingerprint(spark, sf_dir):
    p = event_fields(spark, sf_dir).withColumns({"r": F.lit(0.0), "e": F.lit(1), "d": F.lit(1)})
    return fields.fingerprint(p, ["user_id"], "event_id", "v", "r", "e", "d")


from isobar import message_queries  # noqa: E402, F401  registers its queries
