"""Defined grids: where their points are, where a place is on them, and what a field has there.

A grid is a few numbers or two axes that the plan holds; a field is an array in a row, i fastest.  Everything is Column
arithmetic on the row that holds the field, so a set of fields of any size is read once and nothing is shuffled.

Kinds: A, B and G global or half of the globe (A without the poles and the repeated meridian, B with both, G on Gaussian
latitudes), L latitude and longitude, N and S polar stereographic, E rotated, Z uneven axes over a reference of kind L, E, N
or S, U two halves (Yin and Yang) of kind Z.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nephos.functions.columns import last_below, once
from nephos.functions.sphere import gaussian_latitudes, rotation, turned
from nephos.operators import grids

#: Parts of the globe in a descriptor's first number.
GLOBE, NORTH, SOUTH = 0, 1, 2
#: Degrees beyond which the core of a half of kind Z does not reach: longitudes and latitudes of its own frame.
CORE = (45.0, 315.0, -45.0, 45.0)
SAMPLES = ("nearest", "linear", "cubic")


@dataclass(frozen=True)
class Grid:
    """A grid's kind, size, descriptors and, for Z, the reference's kind (g then describes the reference) and axes."""

    kind: str
    ni: int
    nj: int
    g: tuple[int, int, int, int] = (0, 0, 0, 0)
    ref: str = ""
    ax: tuple[float, ...] = ()
    ay: tuple[float, ...] = ()
    halves: tuple["Grid", ...] = ()

    def __post_init__(self):
        if self.kind not in "ABGLNSEZU" or len(self.kind) != 1:
            raise ValueError(f"no grid of kind {self.kind}")
        if self.kind == "Z" and (len(self.ax) != self.ni or len(self.ay) != self.nj or self.ref not in "LENS" or not self.ref):
            raise ValueError("a grid of uneven axes has one place for each column and row and a reference of kind L, E, N or S")

    # What describes a grid.

    @property
    def base(self) -> str:
        return self.ref if self.kind == "Z" else self.kind

    @cached_property
    def numbers(self) -> tuple[float, float, float, float]:
        """The four real descriptors: south-west corner and steps; pole, spacing and angle; two points of the equator."""
        g, base = self.g, self.base
        if base == "L":
            return g[2] * 0.01 - 90.0, g[3] * 0.01, g[0] * 0.01, g[1] * 0.01
        if base in "NS":
            if g[3] >= 32768:
                raise ValueError("a polar grid whose pole is off it is described by its numbers, not by codes")
            return g[1] / 10.0, g[0] / 10.0, g[3] * 100.0, g[2] * 0.01
        if base == "E":
            first, second = g[0] << 2 | g[2] & 3, g[1] << 2 | g[3] & 3
            second, third = second - 7201 if second > 3600 else second, g[2] >> 2
            return (first - 3600) / 40.0, ((third + 16384 if third < 3559 else third) - 3600) / 40.0, second / 40.0, (g[3] >> 2) / 40.0
        part, rows = self.g[0], self.nj - (base == "B")
        dlat = (180.0 if part == GLOBE else 90.0) / rows
        south = 0.0 if part == NORTH else -90.0
        return south + (0.0 if base == "B" else dlat / 2), 0.0, dlat, 360.0 / (self.ni - (base == "B"))

    @cached_property
    def rows(self) -> tuple[int, int]:
        """First and last row when a half of the globe is mirrored to the other."""
        part = self.g[0] if self.kind in "ABG" else GLOBE
        more = self.nj - 1 if self.kind == "B" else self.nj
        return (1 - more if part == NORTH else 1), (self.nj + more if part == SOUTH else self.nj)

    @cached_property
    def axes(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of the columns and of all rows, mirrored ones too."""
        if self.kind == "Z":
            return np.array(self.ax, float), np.array(self.ay, float)
        low, high = self.rows
        if self.kind == "G":
            return np.arange(self.ni) * 360.0 / self.ni, np.array(gaussian_latitudes(high - low + 1))
        south, west, dlat, dlon = self.numbers
        return west + np.arange(self.ni) * dlon, south + np.arange(low - 1, high) * dlat

    @cached_property
    def extension(self) -> int:
        """0 for a grid that ends, 1 for one that repeats its first meridian as its last, 2 for one that goes round."""
        if self.kind in "AG":
            return 2
        if self.kind in "BE":
            return 1 if self.kind == "B" else 0
        if self.kind == "Z" and self.ref == "E":
            return int(self.ax[-1] - self.ax[0] >= 359.0)
        if self.base != "L":
            return 0
        x, y = self.axes
        first, last = y[1] - y[0], y[-1] - y[-2]
        if y[0] - first > -90 + 0.01 * first or y[-1] + last < 90 - 0.01 * last:
            return 0
        dlon = x[-1] - x[-2]
        if x[-1] - x[0] > 360 - 0.01 * dlon:
            return 1
        return 2 if x[-1] + dlon - x[0] > 360 - 0.01 * dlon else 0

    @property
    def open(self) -> bool:
        """Whether points beyond its ends are outside; else they lie between its ends or towards the poles."""
        if self.base in "NS":
            return True
        if self.kind == "Z":
            return self.ax[-1] - self.ax[0] < 358.0
        return self.kind == "L" and self.extension == 0

    @property
    def is_rotated(self) -> bool:
        return self.base == "E" and abs(self.numbers[0] - self.numbers[2]) >= 0.001

    def expanded_axes(self) -> tuple[list[float], list[float]]:
        """The axes with what goes round on either side: one column for a repeated meridian or more, two for one that goes
        round without; mirrored rows."""
        x, y = self.axes
        if self.extension == 1:
            x = np.concatenate([[x[-2] - 360], x, [x[1] + 360]])
        elif self.extension == 2:
            x = np.concatenate([[x[-1] - 360], x, [x[0] + 360, x[1] + 360]])
        return x.tolist(), y.tolist()

    # Places.

    @cached_property
    def _frame(self) -> np.ndarray:
        return rotation(*self.numbers)

    def place(self, x: Column, y: Column) -> tuple[Column, Column]:
        """Latitude and longitude (0 to 360) of fractional indices."""
        if self.kind == "U":
            first, second = self.halves
            below = y <= first.nj
            a, b = first.place(x, y), second.place(x, y - first.nj)
            return F.when(below, a[0]).otherwise(b[0]), F.when(below, a[1]).otherwise(b[1])
        if self.kind in "ZG":
            ax, ay = self.axes
            p, q = along(ax, x), along(ay, y - (self.rows[0] - 1))
            if self.kind == "G":
                return q, F.pmod(p, F.lit(360.0))
            return self._placed(p, q)
        return self._placed(x, y)

    def _placed(self, x: Column, y: Column) -> tuple[Column, Column]:
        n = self.numbers
        if self.base in "NS":
            return grids.polar_latlon(x, y, *n, south=self.base == "S")
        if self.base == "E":
            if self.kind == "E":
                dlat = 180.0 / self.nj
                x, y = (x - 1) * (360.0 / (self.ni - 1)), (y - 1) * dlat - 90.0 + dlat / 2
            return turned(y, x, self._frame.T)
        first = 0 if self.kind == "Z" else 1
        return (y - first) * n[2] + n[0], F.pmod((x - first) * n[3] + n[1], F.lit(360.0))

    def locate(self, lat: Column, lon: Column) -> tuple[Column, Column]:
        """Fractional indices of a latitude and longitude."""
        if self.kind == "U":
            first, second = self.halves
            a, b = first.locate(lat, lon), second.locate(lat, lon)
            inside = first.in_core(lat, lon)
            return F.when(inside, a[0]).otherwise(b[0]), F.when(inside, a[1]).otherwise(b[1] + first.nj)
        n = self.numbers if self.kind != "G" else None
        if self.kind == "G":
            ay = self.axes[1]
            return F.pmod(lon, F.lit(360.0)) / (360.0 / self.ni) + 1, position(ay, lat) + (self.rows[0] - 1)
        if self.base in "NS":
            x, y = grids.polar_xy(lat, lon, *n, south=self.base == "S")
        elif self.base == "E":
            y, x = turned(lat, lon, self._frame)
            if self.kind == "E":
                dlat = 180.0 / self.nj
                return x / (360.0 / (self.ni - 1)) + 1, (y + 90.0 - dlat / 2) / dlat + 1
        else:
            if self.kind == "Z":
                turn = F.when(lon > 180, lon - 360) if self.ax[0] < 0 else F.when(lon < 0, lon + 360)
            else:
                if self.kind == "L":
                    # To the east of the first column, then back by a turn from beyond the last.
                    lon = F.when(lon < n[1], lon + 360).otherwise(lon)
                    lon = F.when(lon > n[1] + self.ni * n[3], lon - 360).otherwise(lon)
                turn = F.when(lon < 0, lon + 360)
            first = 0 if self.kind == "Z" else 1
            x, y = (turn.otherwise(lon) - n[1]) / n[3] + first, (lat - n[0]) / n[2] + first
        if self.kind == "Z":
            return position(self.axes[0], x), position(self.axes[1], y)
        return x, y

    def in_core(self, lat: Column, lon: Column) -> Column:
        """Whether the nearest point of a half's core, the points within CORE, is that of a place, or it is outside of it."""
        ax, ay = (np.array(a) for a in (self.ax, self.ay))
        i, j = np.flatnonzero((ax >= CORE[0]) & (ax <= CORE[1])), np.flatnonzero((ay >= CORE[2]) & (ay <= CORE[3]))
        core = Grid("Z", len(i), len(j), self.g, self.ref, tuple(ax[i]), tuple(ay[j]))
        x, y = core.locate(lat, lon)
        return ~outside(x, y, core)

    def points(self, spark: SparkSession) -> DataFrame:
        """(i, j, lat, lon) of all points."""
        ni = self.ni
        rows = sum(h.nj for h in self.halves) if self.kind == "U" else self.nj
        ij = spark.range(ni * rows).select((F.col("id") % ni + 1).alias("i"), (F.floor(F.col("id") / ni) + 1).alias("j"))
        lat, lon = self.place(F.col("i").cast("double"), F.col("j").cast("double"))
        return ij.select("i", "j", lat.alias("lat"), lon.alias("lon"))


def _below(axis: np.ndarray, value: Column) -> Column:
    """1-based column or row that a value comes after, the first or the last but one beyond the ends."""
    place = last_below(F.lit(np.asarray(axis, np.float64)), value, False)
    return F.least(F.greatest(place, F.lit(1)), F.lit(len(axis) - 1))


def position(axis: np.ndarray, value: Column) -> Column:
    """1-based fractional place of a value on an ascending axis, linear beyond its ends."""
    held = F.lit(np.asarray(axis, np.float64))
    between = lambda k, v: k + (v - F.get(held, k - 1)) / (F.get(held, k) - F.get(held, k - 1))
    return once(value, lambda v: once(_below(axis, v), lambda k: between(k, v)))


def along(axis: np.ndarray, place: Column) -> Column:
    """What an axis has at a 1-based fractional place, linear beyond its ends."""
    held = F.lit(np.asarray(axis, np.float64))
    k = F.least(F.greatest(F.floor(place).cast("int"), F.lit(1)), F.lit(len(axis) - 1))
    return once(F.struct(place.cast("double").alias("p"), k.alias("k")), lambda s: F.get(held, s["k"] - 1) + (s["p"] - s["k"]) * (F.get(held, s["k"]) - F.get(held, s["k"] - 1)))


def outside(x: Column, y: Column, grid: Grid) -> Column:
    """Whether the nearest point of a place is none of the grid's."""
    i, j = (F.when(c + 0.5 < 0, F.ceil(c + 0.5)).otherwise(F.floor(c + 0.5)) for c in (x, y))
    return (i < 1) | (j < 1) | (i > grid.ni) | (j > grid.nj)


def _pole(z: Column, grid: Grid, north: bool) -> Column:
    """Mean of the last or first row; over uneven axes of a rotated reference by their steps."""
    row = F.slice(z, (grid.nj - 1) * grid.ni + 1 if north else 1, grid.ni)
    if grid.kind == "Z" and grid.ref == "E":
        steps = np.append(np.diff(grid.axes[0]), 0.0)
        parts = F.zip_with(row, F.lit(steps), lambda a, w: a.cast("double") * w)
        return F.aggregate(parts, F.lit(0.0), lambda a, b: a + b) / float(steps.sum() or 1.0)
    return F.aggregate(row, F.lit(0.0), lambda a, b: a + b.cast("double")) / grid.ni


class Field:
    """The points of a field on a grid, with what goes round, mirrored halves, and the poles as one more row at either end."""

    def __init__(self, z: Column, grid: Grid, sign: float = 1.0, poles: bool = False):
        self.z, self.grid, self.sign = z, grid, sign
        low, high = grid.rows
        self.low, self.high = low, high
        y = grid.axes[1] if grid.base not in "NSE" or grid.kind == "Z" else None
        full = poles and not grid.open and grid.kind != "E"
        self.south = full and not (grid.kind in "ZG" and y is not None and y[0] == -90.0)
        self.north = full and not (grid.kind in "ZG" and y is not None and y[-1] == 90.0)
        self.south_mean, self.north_mean = _pole(z, grid, False) if self.south else None, _pole(z, grid, True) if self.north else None

    def at(self, i: Column, j: Column) -> Column:
        ni, nj = self.grid.ni, self.grid.nj
        if self.grid.extension:
            period = ni if self.grid.extension == 2 else ni - 1
            i = F.pmod(i - 1, F.lit(period)) + 1
        row, sign = j, F.lit(1.0)
        if self.low < 1:
            row = F.when(j < 1, (2 if self.grid.kind == "B" else 1) - j).otherwise(j)
            sign = F.when(j < 1, self.sign).otherwise(1.0)
        elif self.high > nj:
            row = F.when(j > nj, 2 * nj + (0 if self.grid.kind == "B" else 1) - j).otherwise(j)
            sign = F.when(j > nj, self.sign).otherwise(1.0)
        value = F.get(self.z, ((row - 1) * ni + i - 1).cast("int")).cast("double") * sign
        if self.south:
            value = F.when(j < self.low, self.south_mean).otherwise(value)
        if self.north:
            value = F.when(j > self.high, self.north_mean).otherwise(value)
        return value

    def _column(self, i: Column) -> Column:
        """Where column i is on the axis, round the globe."""
        ax = self.grid.axes[0]
        held = F.lit(np.asarray(ax, np.float64))
        if not self.grid.extension:
            return F.get(held, (i - 1).cast("int"))
        period = len(ax) if self.grid.extension == 2 else len(ax) - 1
        return F.get(held, F.pmod(i - 1, F.lit(period)).cast("int")) + 360.0 * F.floor((i - 1) / period)

    def _row(self, j: Column) -> Column:
        y = self.grid.axes[1]
        held = F.lit(np.concatenate([[-90.0], y, [90.0]]))
        return F.get(held, (j - self.low + 1).cast("int"))

    def sample(self, x: Column, y: Column, degree: str) -> Column:
        low, high = self.low - int(self.south), self.high + int(self.north)
        wide = bool(self.grid.extension)
        ni = self.grid.ni
        if degree == "nearest":
            i, j = F.round(x), F.least(F.greatest(F.round(y), F.lit(low)), F.lit(high))
            return self.at(i if wide else F.least(F.greatest(i, F.lit(1)), F.lit(ni)), j)
        first, last = (0, 1) if degree == "linear" else (1, 2)
        i = F.floor(x) if wide else F.least(F.greatest(F.floor(x), F.lit(1 + first)), F.lit(ni - last))
        j = F.least(F.greatest(F.floor(y), F.lit(low + first)), F.lit(high - last))
        return once(F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), i.alias("i"), j.alias("j")), lambda s: self._stencil(s, degree))

    def _stencil(self, s: Column, degree: str) -> Column:
        dx, dy, i, j = s["x"] - s["i"], s["y"] - s["j"], s["i"], s["j"]
        if degree == "linear":
            row = lambda b: self.at(i, b) + (self.at(i + 1, b) - self.at(i, b)) * dx
            return row(j) + (row(j + 1) - row(j)) * dy
        if self.grid.kind in "ZG":
            xs, ys = [self._column(i + k) for k in range(-1, 3)], [self._row(j + k) for k in range(-1, 3)]
            wx, wy = _weights(xs, xs[1] + dx * (xs[2] - xs[1])), _weights(ys, ys[1] + dy * (ys[2] - ys[1]))
        else:
            wx, wy = grids._lagrange(dx), grids._lagrange(dy)
        lines = [sum((wx[a] * self.at(i + a - 1, j + b - 1) for a in range(1, 4)), wx[0] * self.at(i - 1, j + b - 1)) for b in range(4)]
        return sum((wy[b] * lines[b] for b in range(1, 4)), wy[0] * lines[0])


def _weights(points: list[Column], at: Column) -> list[Column]:
    out = []
    for k, p in enumerate(points):
        w = F.lit(1.0)
        for n, q in enumerate(points):
            if n != k:
                w = w * (at - q) / (p - q)
        out.append(w)
    return out


def value_at(z: Column, grid: Grid, x: Column, y: Column, degree: str = "cubic", extrapolation: str = "maximum", given: float = 0.0) -> Column:
    """What a field has at fractional indices.

    Outside a grid that ends: maximum and minimum are 5 % of the field's range beyond it, value is a given one, neutral goes on
    with the degree, a degree's name with that one, abort raises an error.  On grids round the globe, what lies towards a pole
    is sampled with the mean of the outermost row as one more row, and the pole itself has that mean.
    """
    if degree not in SAMPLES:
        raise ValueError(f"a field is sampled by {', '.join(SAMPLES)}")
    if grid.kind == "U":
        first, second = grid.halves
        size = first.ni * first.nj
        a = value_at(F.slice(z, 1, size), first, x, y, degree, extrapolation, given)
        b = value_at(F.slice(z, size + 1, second.ni * second.nj), second, x, y - first.nj, degree, extrapolation, given)
        return F.when(y <= first.nj, a).otherwise(b)
    field = Field(z, grid, poles=True)
    value = field.sample(x, y, degree)
    if grid.open:
        out = outside(x, y, grid)
        if extrapolation in SAMPLES:
            return F.when(out, field.sample(x, y, extrapolation)).otherwise(value)
        return grids.extrapolated(value, out, extrapolation, z, given)
    if grid.kind == "E":
        return value
    ends = [(_pole_row(grid, north), _pole(z, grid, north)) for north in (True, False)]
    for row, mean in ends:
        value = F.when(F.abs(y - row) < 1e-3, mean).otherwise(value)
    return value


def _pole_row(grid: Grid, north: bool) -> float:
    """Fractional row of a pole."""
    low, high = grid.rows
    if grid.kind == "Z" and grid.ref == "E":
        return high + 0.5 if north else low - 0.5
    y = grid.axes[1]
    if north:
        return low - 1 + len(y) - 1 + (90.0 - y[-2]) / (y[-1] - y[-2])
    return low + (-90.0 - y[0]) / (y[1] - y[0])


def value_over(z: Column, grid: Grid, lat: Column, lon: Column, degree: str = "cubic", **more) -> Column:
    """What a field has at a latitude and longitude."""
    place = F.struct(*[c.cast("double").alias(n) for c, n in zip(grid.locate(lat, lon), ("x", "y"), strict=True)])
    return once(place, lambda p: value_at(z, grid, p["x"], p["y"], degree, **more))


def targets(rows: DataFrame, grid: Grid) -> DataFrame:
    """Each row once for every point of a grid, with i, j, lat and lon."""
    height = sum(h.nj for h in grid.halves) if grid.kind == "U" else grid.nj
    k = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(grid.ni * height - 1))))
    k = k.withColumn("j", (F.floor(F.col("i") / grid.ni) + 1).cast("long")).withColumn("i", (F.col("i") % grid.ni + 1).cast("long"))
    lat, lon = grid.place(F.col("i").cast("double"), F.col("j").cast("double"))
    return k.withColumns({"lat": lat, "lon": lon})


def regridded(rows: DataFrame, field: str, source: Grid, target: Grid, degree: str = "cubic", into: str = "value", **more) -> DataFrame:
    """Each field at every point of another grid; a field on its own grid is copied."""
    points = targets(rows, target)
    if source == target:
        return points.withColumn(into, F.get(F.col(field), ((F.col("j") - 1) * source.ni + F.col("i") - 1).cast("int")).cast("double"))
    return points.withColumn(into, value_over(F.col(field), source, F.col("lat"), F.col("lon"), degree, **more))


# Winds.  Components on a grid are along its columns and rows.


def _turned_wind(u: Column, v: Column, lat: Column, lon: Column, frame: np.ndarray) -> tuple[Column, Column]:
    """Components east and north at a place, as those at the same place in the frame that the matrix leads to."""
    a, b = F.radians(lat), F.radians(lon)
    x = -u * F.sin(b) - v * F.sin(a) * F.cos(b)
    y = u * F.cos(b) - v * F.sin(a) * F.sin(b)
    z = v * F.cos(a)
    p = [sum((float(frame[r, k]) * c for k, c in ((1, y), (2, z))), float(frame[r, 0]) * x) for r in range(3)]
    to_lat, to_lon = (F.radians(c) for c in turned(lat, lon, frame))
    east = p[1] * F.cos(to_lon) - p[0] * F.sin(to_lon)
    north = p[2] * F.cos(to_lat) - (p[0] * F.cos(to_lon) + p[1] * F.sin(to_lon)) * F.sin(to_lat)
    return east, north


def speed_direction(grid: Grid, u: Column, v: Column, lat: Column, lon: Column) -> tuple[Column, Column]:
    """Speed and the direction that the wind comes from, of components on a grid; calm has direction 0."""
    if grid.kind == "U":
        raise ValueError("winds of a grid of two halves are turned on each half")
    if grid.base == "E":
        rlat, rlon = turned(lat, lon, grid._frame)
        u, v = _turned_wind(u, v, rlat, rlon, grid._frame.T)
    if grid.base in "NS":
        start = lon + grid.numbers[3] if grid.base == "N" else 180.0 - lon + grid.numbers[3]
    else:
        start = F.lit(270.0)
    calm = (u == 0) & (v == 0)
    return F.sqrt(u * u + v * v), F.when(calm, 0.0).otherwise(F.pmod(start - F.degrees(F.atan2(v, u)), F.lit(360.0)))


def components(grid: Grid, speed: Column, direction: Column, lat: Column, lon: Column) -> tuple[Column, Column]:
    """Components on a grid of a speed and a direction."""
    if grid.base in "NS":
        angle = lon + grid.numbers[3] - direction if grid.base == "N" else 180.0 - lon + grid.numbers[3] - direction
    else:
        angle = 270.0 - direction
    u, v = speed * F.cos(F.radians(angle)), speed * F.sin(F.radians(angle))
    return _turned_wind(u, v, lat, lon, grid._frame) if grid.base == "E" else (u, v)


def geographic(grid: Grid, u: Column, v: Column, lat: Column, lon: Column) -> tuple[Column, Column]:
    """Components to the east and north of components on a grid."""
    speed, direction = speed_direction(grid, u, v, lat, lon)
    return -speed * F.sin(F.radians(direction)), -speed * F.cos(F.radians(direction))


def wind_at(u: Column, v: Column, grid: Grid, x: Column, y: Column, degree: str = "cubic", extrapolation: str = "maximum") -> tuple[Column, Column]:
    """A wind's components on its grid, at fractional indices.  Mirrored rows of the second have the other sign; there is no row
    for a pole, and outside a grid that ends both are 0 unless a degree goes on."""
    place = F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))

    def component(z: Column, sign: float) -> Column:
        field = Field(z, grid, sign)

        def sampled(p: Column) -> Column:
            value = field.sample(p["x"], p["y"], degree)
            if not grid.open or extrapolation == "neutral":
                return value
            other = field.sample(p["x"], p["y"], extrapolation) if extrapolation in SAMPLES else F.lit(0.0)
            return F.when(outside(p["x"], p["y"], grid), other).otherwise(value)

        return once(place, sampled)

    return component(u, 1.0), component(v, -1.0)


def winds_regridded(rows: DataFrame, u: str, v: str, source: Grid, target: Grid, degree: str = "cubic", **more) -> DataFrame:
    """Winds at every point of another grid: components there (u_grid, v_grid), speed and direction."""
    points = targets(rows, target)
    lat, lon = F.col("lat"), F.col("lon")
    if source == target:
        at = ((F.col("j") - 1) * source.ni + F.col("i") - 1).cast("int")
        both = F.get(F.col(u), at).cast("double"), F.get(F.col(v), at).cast("double")
    else:
        both = wind_at(F.col(u), F.col(v), source, *source.locate(lat, lon), degree, **more)
    points = points.withColumns({"_u": both[0], "_v": both[1]})
    speed, direction = speed_direction(source, F.col("_u"), F.col("_v"), lat, lon)
    points = points.withColumns({"speed": speed, "direction": direction})
    gu, gv = components(target, F.col("speed"), F.col("direction"), lat, lon)
    return points.withColumns({"u_grid": gu, "v_grid": gv}).drop("_u", "_v")


# Options of interpolation, as names and values that may come from a file.

#: Other names of options and of their values.
OPTION_NAMES = {"correction_polaire": "polar_correction", "degre_interp": "interp_degree", "degre_extrap": "extrap_degree", "use_1sousgrille": "use_1subgrid"}
VALUE_NAMES = {"oui": "yes", "ouiouioui": "yesyesyes", "non": "no", "voisin": "nearest", "lineair": "linear", "lineaire": "linear", "cubique": "cubic", "neutre": "neutral", "valeur": "value"}
ALLOWED = {
    "interp_degree": ("nearest", "linear", "cubic", "average", "sph_average"), "extrap_degree": ("neutral", "nearest", "linear", "cubic", "maximum", "minimum", "value", "abort"),
    "polar_correction": ("yes", "no"), "use_1subgrid": ("yes", "no"), "verbose": ("yes", "yesyesyes", "no"), "cloud_interp_alg": ("linear", "distance"),
}
DEFAULTS = {
    "interp_degree": "cubic", "extrap_degree": "maximum", "polar_correction": "yes", "use_1subgrid": "no", "verbose": "no", "cloud_interp_alg": "distance",
    "extrap_value": 0.0, "missing_gridpt_distance": 0.5, "missing_distance_threshold": 3.0, "weight_number": 16, "missing_points_tolerance": 0, "subgridid": -1,
}


class Options:
    """Options by name, in either language and case; an unknown name or value is an error."""

    def __init__(self):
        self.values = dict(DEFAULTS)

    def set(self, name: str, value: str | float) -> "Options":
        name = OPTION_NAMES.get(name.lower(), name.lower())
        if name not in self.values:
            raise ValueError(f"no option {name}")
        if name in ALLOWED:
            value = VALUE_NAMES.get(str(value).lower(), str(value).lower())
            if value not in ALLOWED[name]:
                raise ValueError(f"{value} is no value of {name}")
        elif name == "weight_number" and not 1 <= int(value) <= 16:
            raise ValueError("a cloud's point has 1 to 16 neighbours")
        self.values[name] = type(DEFAULTS[name])(value)
        return self

    def get(self, name: str) -> str | float:
        return self.values[OPTION_NAMES.get(name.lower(), name.lower())]

    def regridded(self, rows: DataFrame, field: str, source: Grid, target: Grid, into: str = "value") -> DataFrame:
        """regridded() as the options say."""
        degree = self.get("interp_degree")
        return regridded(rows, field, source, target, degree if degree in SAMPLES else "linear", into, extrapolation=self.get("extrap_degree"), given=self.get("extrap_value"))


def stencil(i: Column, j: Column, ni: int, nj: int, part: int = GLOBE) -> Column:
    """The 4 by 4 points around (i, j) to (i + 1, j + 1) as structs of column, row and sign, rows first: columns go round, rows
    beyond a pole are met on its other side half a turn on, and on half of the globe those beyond the equator mirrored, with a
    sign of -1."""

    def row(dj: Column) -> Column:
        y = j + dj
        over = ((y < 1) & F.lit(part != NORTH)) | ((y > nj) & F.lit(part != SOUTH))
        beyond = F.when(y < 1, 1 - y).when(y > nj, 2 * nj + 1 - y).otherwise(y)
        sign = F.when((y < 1) & F.lit(part == NORTH), -1).when((y > nj) & F.lit(part == SOUTH), -1).otherwise(1)
        return F.transform(F.sequence(F.lit(-1), F.lit(2)), lambda di: F.struct((F.pmod(i + di - 1 + F.when(over, ni // 2).otherwise(0), F.lit(ni)) + 1).cast("int").alias("column"), beyond.cast("int").alias("row"), sign.alias("sign")))

    return F.flatten(F.transform(F.sequence(F.lit(-1), F.lit(2)), row))
