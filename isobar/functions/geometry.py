"""Grid geometry as column expressions.

A grid is described by a few numbers that the driver knows; its methods turn columns (row and column, or latitude and longitude) into columns, so Catalyst sees plain arithmetic.
Rows run from north to south and columns from west to east, whatever the order of the data.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

RAD = math.pi / 180
#: The axes in metres of the shapes of the Earth that need no further numbers.
EARTH_AXES = {
    0: (6367470.0, 6367470.0), 2: (6378160.0, 6356775.0), 4: (6378137.0, 6356752.314), 5: (6378137.0, 6356752.314),
    6: (6371229.0, 6371229.0), 8: (6371200.0, 6371200.0), 9: (6377563.396, 6356256.909),
}
MISSING_OCTET, MISSING_WORD = 0xFF, 0xFFFFFFFF


def lit(x: float) -> Column:
    return F.lit(float(x))


def earth_axes(shape: int, radius=(255, MISSING_WORD), major=(255, MISSING_WORD), minor=(255, MISSING_WORD)) -> tuple[float, float]:
    """Major and minor axis in metres. A pair is a decimal scale and a value; only the shapes 1, 3 and 7 use them, 3 in kilometres."""
    if shape in EARTH_AXES:
        return EARTH_AXES[shape]
    if shape not in (1, 3, 7):
        raise ValueError(f"unknown shape of the Earth: {shape}")
    found = []
    for scale, value in (radius, radius) if shape == 1 else (major, minor):
        if scale == MISSING_OCTET or value == MISSING_WORD or value <= 0:
            raise ValueError(f"shape of the Earth {shape} lacks an axis")
        found.append(value / 10.0**scale * (1000 if shape == 3 else 1))
    return found[0], found[1]


def angle_unit(basic: int, parts: int) -> float:
    """Degrees per unit of an angle: a millionth, unless a basic angle and its parts are given."""
    return 1e-6 if {basic, parts} & {0, MISSING_WORD} else basic / parts


def into_circle(lon: Column) -> Column:
    """The longitude within [0, 360)."""
    turned = F.pmod(lon, lit(360))
    return F.when(turned >= 360, lit(0)).otherwise(turned)


def nearest_turn(x: Column, turn: float) -> Column:
    """What is left of x after the nearest number of turns, as by IEEE remainder."""
    return x - turn * F.rint(x / turn)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """The angle in radians between two points in degrees."""
    a = F.pow(F.sin((lat2 - lat1) * lit(RAD) / 2), 2) + F.cos(lat1 * lit(RAD)) * F.cos(lat2 * lit(RAD)) * F.pow(F.sin((lon2 - lon1) * lit(RAD) / 2), 2)
    return 2 * F.asin(F.sqrt(F.least(a, lit(1))))


def let(x: Column, body) -> Column:
    """The body of x, with x worked out once however often the body uses it."""
    return F.element_at(F.transform(F.array(x), body), 1)


def position(fi: Column, fj: Column) -> Column:
    return F.struct(fi.alias("i"), fj.alias("j"))


def nearest_of_four(at: Column, clamp_row, clamp_column, coordinates, columns: int, lat: Column, lon: Column, key: tuple[str, ...]) -> Column:
    """Of the four points around a position the nearest, as the least of structs that begin with the distance and ``key``."""
    steps = [(0, 0), (0, 1), (1, 0), (1, 1)]
    cells = let(at, lambda f: F.array(*[F.struct(F.lit(k).alias("k"), clamp_row(F.floor(f["j"]).cast("long") + dj).alias("j"), clamp_column(F.floor(f["i"]).cast("long") + di).alias("i")) for k, (dj, di) in enumerate(steps)]))

    def placed(c: Column) -> Column:
        y, x = coordinates(c["j"], c["i"])
        return F.struct(c["k"].alias("k"), (c["j"] * columns + c["i"]).alias("idx"), y.alias("lat"), x.alias("lon"))

    def measured(p: Column) -> Column:
        others = [n for n in ("idx", "lat", "lon") if n not in key]
        return F.struct(haversine(lat, lon, p["lat"], p["lon"]).alias("d"), *[p[n].alias(n) for n in (*key, *others)])

    return F.array_min(F.transform(F.transform(cells, placed), measured))


def corner_weights(fi: Column, fj: Column, ni: int, nj: int, round_the_world: bool = False) -> Column:
    """The four points around a fractional position, with the fractions to weigh them by. Beyond the edge the fraction is 0 or 1; a grid that goes round the world has no edge east or west."""
    j0 = F.floor(fj).cast("long")
    yf = F.when(j0 < 0, 0.0).when(j0 >= nj - 1, 1.0).otherwise(fj - F.floor(fj))
    j0 = F.greatest(F.lit(0), F.least(j0, F.lit(nj - 2)))
    i0 = F.floor(fi).cast("long")
    outside = (fj < 0) | (fj > nj - 1)
    if round_the_world:
        xf = fi - F.floor(fi)
        i0 = F.pmod(i0, F.lit(ni))
        i1 = F.pmod(i0 + 1, F.lit(ni))
    else:
        outside = outside | (fi < 0) | (fi > ni - 1)
        xf = F.when(i0 < 0, 0.0).when(i0 >= ni - 1, 1.0).otherwise(fi - F.floor(fi))
        i0 = F.greatest(F.lit(0), F.least(i0, F.lit(ni - 2)))
        i1 = i0 + 1
    return F.struct((j0 * ni + i0).alias("i00"), (j0 * ni + i1).alias("i10"), ((j0 + 1) * ni + i0).alias("i01"), ((j0 + 1) * ni + i1).alias("i11"), xf.alias("xf"), yf.alias("yf"), outside.alias("outside"))


def interpolate(values: Column, w: Column) -> Column:
    """The bilinear mean of an array's four values; null if one is missing or beyond the array."""
    at = lambda k: F.get(values, w[k].cast("int"))
    x, y = w["xf"], w["yf"]
    return at("i00") * (1 - x) * (1 - y) + at("i10") * x * (1 - y) + at("i01") * (1 - x) * y + at("i11") * x * y


def nearest_corner(w: Column) -> Column:
    """The point of the greatest weight, the first of equals."""
    x, y = w["xf"], w["yf"]
    weights = [(1 - x) * (1 - y), x * (1 - y), (1 - x) * y, x * y]
    return F.array_max(F.array(*[F.struct(v.alias("v"), F.lit(-k).alias("k"), w[c].alias("i")) for k, (v, c) in enumerate(zip(weights, ("i00", "i10", "i01", "i11"), strict=True))]))["i"]


@dataclass(frozen=True)
class RegularGrid:
    """A grid of whole rows and columns, even or Gaussian: ``rows`` are the latitudes of the latter."""

    ni: int
    nj: int
    north: float
    south: float
    west: float
    dlon: float
    rows: tuple[float, ...] = ()

    @classmethod
    def of(cls, ni: int, nj: int, lat1: float, lon1: float, lat2: float, lon2: float, di: float = 0.0, scan: int = 0, gaussian: int = 0) -> RegularGrid:
        """From the first and last point in data order, the column spacing (0: not given) and the scanning mode."""
        i_neg, j_pos = bool(scan & 0x80), bool(scan & 0x40)
        if ni <= 0 or nj <= 0 or (nj > 1 and (lat1 > lat2 if j_pos else lat1 < lat2)):
            raise ValueError("the first and last latitudes do not fit the scanning mode, or the grid is empty")
        north, south = (lat2, lat1) if j_pos else (lat1, lat2)
        if north > 90 + 1e-6 or south < -90 - 1e-6:
            raise ValueError("latitudes beyond the poles")
        west, east = (lon2, lon1) if i_neg else (lon1, lon2)
        # Equal first and last longitudes tell nothing; then the spacing counts, or else a full turn.
        span = (east - west) % 360
        if span < 1e-9:
            span = di * (ni - 1) if di > 0 else 360.0
        rows: tuple[float, ...] = ()
        if gaussian:
            every = gaussian_latitudes(gaussian)
            inside = [y for y in every if south - 1e-3 < y < north + 1e-3]
            if len(inside) != nj or abs(inside[0] - north) >= 1e-3 or abs(inside[-1] - south) >= 1e-3:
                raise ValueError("the latitudes are not Gaussian")
            rows = tuple(inside)
        return cls(ni, nj, north, south, west % 360, span / (ni - 1) if ni > 1 else 0.0, rows)

    @property
    def round_the_world(self) -> bool:
        return abs(self.ni * self.dlon - 360) < self.dlon * 1e-3

    def latitude(self, row: Column) -> Column:
        if self.rows:
            return F.get(F.array(*map(lit, self.rows)), row.cast("int"))
        if self.nj == 1:
            return lit(self.south)
        return F.when(row == self.nj - 1, lit(self.south)).otherwise(lit(self.north) - row.cast("double") * (self.north - self.south) / (self.nj - 1))

    def longitude(self, col: Column) -> Column:
        return into_circle(lit(self.west) + col.cast("double") * self.dlon)

    def row_of(self, lat: Column) -> Column:
        """The fractional row, carried on beyond the first and last."""
        if self.nj == 1:
            return lit(0)
        if not self.rows:
            return (lit(self.north) - lat) / ((self.north - self.south) / (self.nj - 1))
        rows = F.array(*map(lit, self.rows))
        k = F.greatest(F.lit(1), F.least(F.size(F.filter(rows, lambda y: y > lat)), F.lit(self.nj - 1)))
        above, below = F.get(rows, k - 1), F.get(rows, k)
        return (k - 1).cast("double") + (above - lat) / (above - below)

    def column_of(self, lon: Column) -> Column:
        """The fractional column; beyond the east end of a grid that does not go round the world, the nearer end counts."""
        if self.ni == 1 or self.dlon == 0:
            return lit(0)
        d = F.pmod(lon - self.west, lit(360))
        fi = d / self.dlon
        if self.round_the_world:
            return fi
        east, west = fi - (self.ni - 1), (360 - d) / self.dlon
        return F.when((east > 0) & (west < east), -west).otherwise(fi)

    def weights(self, lat: Column, lon: Column) -> Column:
        return let(position(self.column_of(lon), self.row_of(lat)), lambda p: corner_weights(p["i"], p["j"], self.ni, self.nj, self.round_the_world))

    def inside(self, lat: Column, lon: Column) -> Column:
        fi, fj = self.column_of(lon), self.row_of(lat)
        ok = (fj >= 0) & (fj <= self.nj - 1)
        return ok if self.round_the_world else ok & (fi >= 0) & (fi <= self.ni - 1)

    def nearest(self, lat: Column, lon: Column, local: tuple[Column, Column] | None = None, back=None) -> Column:
        """(d, k, idx, lat, lon) of the nearest of the four points around, the first of equals; for positions inside. On a rotated grid ``local`` is the position there, and ``back`` leads to true coordinates, which distances are taken between."""
        within = lambda n: lambda x: F.greatest(F.lit(0), F.least(x, F.lit(n - 1)))
        column = (lambda i: F.pmod(i, F.lit(self.ni))) if self.round_the_world else within(self.ni)
        y, x = local or (lat, lon)

        def place(j: Column, i: Column) -> tuple[Column, Column]:
            if back is None:
                return self.latitude(j), self.longitude(i)
            true_lat, true_lon = back(self.latitude(j), self.longitude(i))
            return true_lat, into_circle(true_lon)

        return nearest_of_four(position(self.column_of(x), self.row_of(y)), within(self.nj), column, place, self.ni, lat, lon, ("k",))


def rotate(lat: Column, lon: Column, pole_lat: float, pole_lon: float, angle: float = 0.0) -> tuple[Column, Column]:
    """From true to rotated latitude and longitude; the angle is added first."""
    t, o = -(90 + pole_lat) * RAD, -pole_lon * RAD
    phi, lam = lat * RAD, (lon + angle) * RAD
    x, y, z = F.cos(lam) * F.cos(phi), F.sin(lam) * F.cos(phi), F.sin(phi)
    xr = math.cos(t) * math.cos(o) * x - math.cos(t) * math.sin(o) * y - math.sin(t) * z
    yr = math.sin(o) * x + math.cos(o) * y
    zr = math.sin(t) * math.cos(o) * x - math.sin(t) * math.sin(o) * y + math.cos(t) * z
    return F.asin(F.greatest(lit(-1), F.least(zr, lit(1)))) / RAD, F.atan2(yr, xr) / RAD


def unrotate(lat: Column, lon: Column, pole_lat: float, pole_lon: float, angle: float = 0.0) -> tuple[Column, Column]:
    """From rotated to true latitude and longitude, rounded to a millionth of a degree before the angle is taken off."""
    t, o = -(90 + pole_lat) * RAD, -pole_lon * RAD
    phi, lam = lat * RAD, lon * RAD
    x, y, z = F.cos(lam) * F.cos(phi), F.sin(lam) * F.cos(phi), F.sin(phi)
    xt = math.cos(t) * math.cos(o) * x + math.sin(o) * y + math.sin(t) * math.cos(o) * z
    yt = -math.cos(t) * math.sin(o) * x + math.cos(o) * y - math.sin(t) * math.sin(o) * z
    zt = -math.sin(t) * x + math.cos(t) * z
    million = lambda v: F.round(v * 1e6) / 1e6
    return million(F.asin(F.greatest(lit(-1), F.least(zt, lit(1)))) / RAD), million(F.atan2(yt, xt) / RAD) - angle


def conformal_t(e: float, phi: Column | float) -> Column:
    """Snyder's t of a latitude in radians on a spheroid of eccentricity e."""
    phi = lit(phi) if isinstance(phi, float) else phi
    s = e * F.sin(phi)
    return F.tan(0.5 * (math.pi / 2 - phi)) / (F.pow((1 - s) / (1 + s), lit(e / 2)) if e else lit(1))


def conformal_t_of(e: float, phi: float) -> float:
    s = e * math.sin(phi)
    return math.tan(0.5 * (math.pi / 2 - phi)) / ((1 - s) / (1 + s)) ** (e / 2)


def conformal_phi(e: float, t: Column, steps: int = 8) -> Column:
    """The latitude of t by a fixed number of steps; each gains over two digits on any Earth."""
    start = math.pi / 2 - 2 * F.atan(t)
    if not e:
        return start
    again = lambda phi, _: math.pi / 2 - 2 * F.atan(t * F.pow((1 - e * F.sin(phi)) / (1 + e * F.sin(phi)), lit(e / 2)))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, again)


@dataclass(frozen=True)
class ProjectedGrid:
    """A grid of even lengths on a plane. Positions on it count from the first point in data order, at (0, 0) of the plane."""

    nx: int
    ny: int
    dx: float
    dy: float
    scan: int
    forward: object = field(repr=False)
    inverse: object = field(repr=False)
    #: The bearing of the plane's y axis, in radians clockwise from true north.
    grid_north: object = field(repr=False)
    #: Columns in a turn, if the plane repeats.
    period: float = 0.0

    def plane(self, row: Column, col: Column) -> tuple[Column, Column]:
        x = -1.0 * (self.nx - 1 - col) if self.scan & 0x80 else 1.0 * col
        y = 1.0 * (self.ny - 1 - row) if self.scan & 0x40 else -1.0 * row
        return x * self.dx, y * self.dy

    def coordinates(self, row: Column, col: Column) -> tuple[Column, Column]:
        lat, lon = self.inverse(*self.plane(row, col))
        return lat, into_circle(lon)

    @property
    def corner(self) -> tuple[float, float]:
        """The plane's place of row 0, column 0."""
        return -(self.nx - 1) * self.dx if self.scan & 0x80 else 0.0, (self.ny - 1) * self.dy if self.scan & 0x40 else 0.0

    def position(self, lat: Column, lon: Column) -> tuple[Column, Column]:
        """Fractional column and row; null where the projection has no place for the point."""
        x, y = self.forward(lat, lon)
        return (x - self.corner[0]) / self.dx, (self.corner[1] - y) / self.dy

    def weights(self, lat: Column, lon: Column) -> Column:
        fi, fj = self.position(lat, lon)
        around = 0 < self.period and abs(self.period - self.nx) < 1e-3
        near = lambda f, n: F.greatest(lit(-1), F.least(f, lit(n)))
        return let(position(fi, fj), lambda p: F.when(p["i"].isNotNull() & p["j"].isNotNull(), corner_weights(near(p["i"], self.nx), near(p["j"], self.ny), self.nx, self.ny, around)))

    def nearest(self, lat: Column, lon: Column) -> Column:
        """(d, idx, lat, lon) of the nearest of the four points around, the lowest index of equals; for positions inside."""
        within = lambda n: lambda x: F.greatest(F.lit(0), F.least(x, F.lit(n - 1)))
        return nearest_of_four(position(*self.position(lat, lon)), within(self.ny), within(self.nx), self.coordinates, self.nx, lat, lon, ("idx",))


def mercator(nx: int, ny: int, lat1: float, lon1: float, lad: float, dx: float, dy: float, scan: int = 0x40, orientation: float = 0.0, axes=EARTH_AXES[6]) -> ProjectedGrid:
    """Degrees and metres. The poles have no place; of the places of a meridian the one nearest to the middle of the grid counts."""
    if abs(lat1) >= 90 or abs(lad) >= 90:
        raise ValueError("Mercator: latitudes must lie between the poles")
    major, minor = axes
    e = math.sqrt(1 - (minor / major) ** 2)
    unit = major * math.cos(lad * RAD) / math.sqrt(1 - (e * math.sin(lad * RAD)) ** 2)
    turn = 2 * math.pi * unit
    x0 = unit * math.remainder((lon1 - orientation) * RAD, 2 * math.pi)
    y0 = -unit * math.log(conformal_t_of(e, lat1 * RAD))
    span = (nx - 1) * dx
    middle = -span / 2 if scan & 0x80 else span / 2

    def forward(lat: Column, lon: Column) -> tuple[Column, Column]:
        x = unit * nearest_turn((lon - orientation) * RAD, 2 * math.pi) - x0
        y = -unit * F.log(conformal_t(e, lat * RAD)) - y0
        ok = F.abs(lat) < 90 - 1e-9
        return F.when(ok, middle + nearest_turn(x - middle, turn)), F.when(ok, y)

    def inverse(x: Column, y: Column) -> tuple[Column, Column]:
        return conformal_phi(e, F.exp(-(y + y0) / unit)) / RAD, orientation + (x + x0) / unit / RAD

    return ProjectedGrid(nx, ny, dx, dy, scan, forward, inverse, lambda lat, lon: lit(0), turn / dx)


def polar_stereographic(nx: int, ny: int, lat1: float, lon1: float, orientation: float, lad: float, dx: float, dy: float, scan: int = 0x40, south: bool = False, axes=EARTH_AXES[6]) -> ProjectedGrid:
    """True to scale at ``lad``, on a sphere."""
    if axes[0] != axes[1]:
        raise ValueError("polar stereographic grids on an oblate Earth are not supported")
    s = -1.0 if south else 1.0
    scale = axes[0] * (1 + math.sin(abs(lad) * RAD))  # distance from the pole over tan of half the angle from it
    h1 = scale * math.tan((90 - s * lat1) * RAD / 2)
    a1 = s * (lon1 - orientation) * RAD
    x0, y0 = s * h1 * math.sin(a1), -s * h1 * math.cos(a1)

    def north(lat: Column, lon: Column) -> Column:
        return s * nearest_turn((lon - orientation) * RAD, 2 * math.pi)

    def forward(lat: Column, lon: Column) -> tuple[Column, Column]:
        h = scale * F.tan((90 - s * lat) * RAD / 2)
        a = north(lat, lon)
        ok = (F.abs(lat) <= 90) & (s * lat >= -90 + 1e-9)
        return F.when(ok, s * h * F.sin(a) - x0), F.when(ok, -s * h * F.cos(a) - y0)

    def inverse(x: Column, y: Column) -> tuple[Column, Column]:
        px, py = (x + x0) * s, (y + y0) * s
        h = F.sqrt(px * px + py * py)
        return s * (90 - 2 * F.atan(h / scale) / RAD), F.when(h == 0, lit(s * orientation)).otherwise(s * F.atan2(px, -py) / RAD + orientation)

    return ProjectedGrid(nx, ny, dx, dy, scan, forward, inverse, north)


def lambert(nx: int, ny: int, lat1: float, lon1: float, lov: float, lad: float, latin1: float, latin2: float, dx: float, dy: float, scan: int = 0x40, axes=EARTH_AXES[6]) -> ProjectedGrid:
    """A conformal cone through two parallels."""
    if abs(latin1 + latin2) * RAD < 1e-10:
        raise ValueError("Lambert: the parallels are as far north as south")
    major, minor = axes
    e = math.sqrt(1 - (minor / major) ** 2) if major != minor else 0.0
    m = lambda p: math.cos(p) / math.sqrt(1 - (e * math.sin(p)) ** 2)
    p1, p2 = latin1 * RAD, latin2 * RAD
    cone = math.log(m(p1) / m(p2)) / math.log(conformal_t_of(e, p1) / conformal_t_of(e, p2)) if abs(p1 - p2) > 1e-10 else math.sin(p1)
    size = major * m(p1) / (cone * conformal_t_of(e, p1) ** cone)
    middle = size * conformal_t_of(e, lad * RAD) ** cone
    r1 = size * conformal_t_of(e, lat1 * RAD) ** cone
    a1 = cone * math.remainder((lon1 - lov) * RAD, 2 * math.pi)
    x0, y0 = r1 * math.sin(a1), middle - r1 * math.cos(a1)

    def north(lat: Column, lon: Column) -> Column:
        return cone * nearest_turn((lon - lov) * RAD, 2 * math.pi)

    def forward(lat: Column, lon: Column) -> tuple[Column, Column]:
        pole = F.abs(F.abs(lat * RAD) - math.pi / 2) <= 1e-10
        r = F.when(pole, F.when(lat * cone > 0, lit(0))).otherwise(size * F.pow(conformal_t(e, lat * RAD), lit(cone)))
        r = F.when(F.abs(lat) <= 90, r)
        a = north(lat, lon)
        return r * F.sin(a) - x0, middle - r * F.cos(a) - y0

    def inverse(x: Column, y: Column) -> tuple[Column, Column]:
        px, py = x + x0, middle - (y + y0)
        sign = 1.0 if cone > 0 else -1.0
        r = sign * F.sqrt(px * px + py * py)
        a = F.when(r == 0, lit(0)).otherwise(F.atan2(sign * px, sign * py))
        lat = F.when(r == 0, lit(90 * sign)).otherwise(conformal_phi(e, F.pow(r / size, lit(1 / cone))) / RAD)
        return lat, nearest_turn(a / cone + lov * RAD, 2 * math.pi) / RAD

    return ProjectedGrid(nx, ny, dx, dy, scan, forward, inverse, north)


def rotated_north(lat: Column, lon: Column, pole_lat: float, pole_lon: float, angle: float = 0.0) -> Column:
    """The bearing of the rotated grid's north, in radians clockwise from true north: the direction of its north pole."""
    p, o = -pole_lat * RAD, (pole_lon + 180 - angle) * RAD
    phi, d = lat * RAD, o - lon * RAD
    return F.atan2(F.sin(d) * math.cos(p), F.cos(phi) * math.sin(p) - F.sin(phi) * math.cos(p) * F.cos(d))


def to_earth(u: Column, v: Column, bearing: Column) -> tuple[Column, Column]:
    """Wind along the grid's axes, turned to east and north."""
    return u * F.cos(bearing) + v * F.sin(bearing), v * F.cos(bearing) - u * F.sin(bearing)


def grid_relative(flags: Column) -> Column:
    """Whether the component flags say that winds go by the grid's axes."""
    return flags.bitwiseAND(0x08) != 0


def space_view(row: Column, col: Column, nx: int, ny: int, dx: float, dy: float, xp: float, yp: float, nr: float, lon0: float, scan: int = 0, xo: int = 0, yo: int = 0, axes=EARTH_AXES[6]) -> tuple[Column, Column, Column]:
    """Latitude, longitude and whether the point is on the disc; points beside it are at (0, 0). ``dx``, ``dy``: the Earth's apparent diameters in grid lengths; ``nr``: the camera's distance from the centre in radii."""
    if nr <= 1 or not dx or not dy:
        raise ValueError("space view: the camera must be above the ground and the disc have a size")
    eq, pol = axes[0] / 1000, axes[1] / 1000
    height, size = nr * eq, 2 * math.asin(1 / nr)
    x_at = (nx - 1 - (xp - xo)) if scan & 0x80 else xp - xo
    y_at = yp - yo if scan & 0x40 else ny - 1 - (yp - yo)
    x, y = (col - x_at) * (size / dx), ((ny - 1 - row) - y_at) * (pol / eq * size / dy)
    sin_x, sin_y = F.sin(x), F.sin(y)
    cos_xy = F.sqrt(1 - sin_x * sin_x) * F.sqrt(1 - sin_y * sin_y)
    squash = (eq / pol) ** 2
    stretch = 1 + (squash - 1) * sin_y * sin_y
    sight = F.pow(height * cos_xy, lit(2)) - stretch * (height * height - eq * eq)
    on = sight > 0
    far = (height * cos_xy - F.sqrt(F.when(on, sight))) / stretch
    a, b, c = height - far * cos_xy, far * sin_x * F.sqrt(1 - sin_y * sin_y), far * sin_y
    lat = F.atan(squash * c / F.sqrt(a * a + b * b)) / RAD
    lon = F.atan(b / a) / RAD + lon0
    turned = F.when(lon < 0, lon + 360).when(lon > 360, lon - 360).otherwise(lon)
    return F.coalesce(lat, lit(0)), F.coalesce(turned, lit(0)), on


@lru_cache(maxsize=64)
def gaussian_latitudes(n: int) -> tuple[float, ...]:
    """The 2n latitudes of a Gaussian grid from north to south: roots of the Legendre polynomial, by Newton's method on all at once."""
    if n <= 0:
        raise ValueError("a Gaussian grid needs a positive number of rows")
    degree = 2 * n
    x = np.cos(np.pi * (np.arange(1, n + 1) - 0.25) / (degree + 0.5))
    for _ in range(10):
        before, now = np.ones(n), x.copy()
        for k in range(2, degree + 1):
            before, now = now, ((2 * k - 1) * x * now - (k - 1) * before) / k
        step = now * (1 - x * x) / (degree * (before - x * now))
        x -= step
        if np.abs(step).max() < 1e-14:
            break
    north = np.degrees(np.arcsin(x))
    return tuple(north) + tuple(-north[::-1])
