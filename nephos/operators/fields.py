"""Kernels on fields and series: containment, averages over boxes, filling by a predictor, splines with given slopes, derivatives
at the ends of uneven series, and blocks of 16-bit mantissas."""

from __future__ import annotations

import struct
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nephos.functions.columns import once

Point = tuple[Column, Column]


def in_triangle(p: Point, a: Point, b: Point, c: Point) -> Column:
    """Whether a point has all three barycentric coordinates between 0 and 1."""
    (x, y), (x1, y1), (x2, y2), (x3, y3) = p, a, b, c
    det = (x1 - x3) * (y2 - y3) - (x2 - x3) * (y1 - y3)
    u = ((y2 - y3) * (x - x3) - (x2 - x3) * (y - y3)) / F.nullif(det, F.lit(0.0))
    v = ((x1 - x3) * (y - y3) - (y1 - y3) * (x - x3)) / F.nullif(det, F.lit(0.0))
    return F.coalesce(u.between(0, 1) & v.between(0, 1) & (1 - u - v).between(0, 1), F.lit(False))


def in_quadrilateral(p: Point, a: Point, b: Point, c: Point, d: Point) -> Column:
    """Whether a point is in one of the triangles abc and acd."""
    return in_triangle(p, a, b, c) | in_triangle(p, a, c, d)


def in_cell(p: Point, a: Point, b: Point, c: Point, d: Point) -> Point:
    """Coordinates of a point in the projective map of the unit square on abcd, a at (0, 0), b at (1, 0), d at (0, 1); null where
    corners lie on a line.  Numbers less than 0.01 below zero, which rounding makes on a side, become positive."""
    (x, y), (xa, ya), (xb, yb), (xc, yc), (xd, yd) = p, a, b, c, d
    cross = lambda x1, y1, x2, y2: x1 * y2 - x2 * y1
    over = lambda value, by: value / F.nullif(by, F.lit(0.0))
    odd = (xa - xb + xc - xd, ya - yb + yc - yd)
    sides = cross(xb - xc, yb - yc, xd - xc, yd - yc)
    g, h = over(cross(*odd, xd - xc, yd - yc), sides), over(cross(xb - xc, yb - yc, *odd), sides)

    def solved(s: Column) -> Column:
        # Both equations of the map, linear in u and v.
        u1, v1, u2, v2 = (s[k] for k in ("u1", "v1", "u2", "v2"))
        det = cross(u1, u2, v1, v2)
        plus = lambda t: F.when(F.abs(t) < 0.01, F.abs(t)).otherwise(t)
        return F.struct(plus(over(cross(s["x"], s["y"], v1, v2), det)).alias("u"), plus(over(cross(u1, u2, s["x"], s["y"]), det)).alias("v"))

    def terms(t: Column) -> Column:
        by = lambda to, start, at, k: to - start + k * (to - at)
        parts = {"u1": by(xb, xa, x, t["g"]), "v1": by(xd, xa, x, t["h"]), "u2": by(yb, ya, y, t["g"]), "v2": by(yd, ya, y, t["h"]), "x": x - xa, "y": y - ya}
        return once(F.struct(*[v.alias(k) for k, v in parts.items()]), solved)

    found = once(F.struct(g.alias("g"), h.alias("h")), terms)
    return found["u"], found["v"]


def place_in_cloud(p: Point, xs: Column, ys: Column, i: Column, j: Column, ni: int, nj: int) -> Column:
    """Fractional indices (x, y) of a point on a grid whose nodes lie anywhere, xs and ys as arrays, by the node next to it: in
    the first of the four cells around that node (kept off the edges) which holds the point; null where none does."""
    i, j = F.least(F.greatest(i, F.lit(2)), F.lit(ni - 1)), F.least(F.greatest(j, F.lit(2)), F.lit(nj - 1))
    node = lambda i, j: (F.get(xs, ((j - 1) * ni + i - 1).cast("int")).cast("double"), F.get(ys, ((j - 1) * ni + i - 1).cast("int")).cast("double"))
    corners = lambda s: [(s[f"x{k}"], s[f"y{k}"]) for k in range(4)]

    def cell(west: Column, south: Column) -> Column:
        around = [node(west + di, south + dj) for di, dj in ((0, 0), (1, 0), (1, 1), (0, 1))]
        return F.struct(west.cast("double").alias("i"), south.cast("double").alias("j"), *[c.alias(f"{n}{k}") for k, at in enumerate(around) for n, c in zip("xy", at, strict=True)])

    cells = F.array(*[cell(i - 1 + di, j - 1 + dj) for dj in (0, 1) for di in (0, 1)])
    holding = F.get(F.filter(cells, lambda s: in_quadrilateral(p, *corners(s))), F.lit(0))

    def placed(s: Column) -> Column:
        u, v = in_cell(p, *corners(s))
        return F.when(s.isNotNull(), F.struct((s["i"] + u).alias("x"), (s["j"] + v).alias("y")))

    return once(holding, placed)


def box_average(z: Column, ni: int, nj: int, box: tuple[Column, Column, Column, Column], wrap: bool = False) -> Column:
    """Mean of a field, held as an array, over a box of fractional indices (west, east, south, north), each point standing for the
    unit cell around it; cells count by how much of them is in the box.  Rows end with the field; columns go round if wrap."""
    west, east, south, north = box

    def over(s: Column) -> Column:
        columns = F.sequence(F.floor(s["w"] + 0.5).cast("int"), F.ceil(s["e"] - 0.5).cast("int"))
        rows = F.sequence(F.floor(s["s"] + 0.5).cast("int"), F.ceil(s["n"] - 0.5).cast("int"))
        part = lambda k, lo, hi: F.greatest(F.least(k + 0.5, hi) - F.greatest(k - 0.5, lo), F.lit(0.0))

        def line(j: Column) -> Column:
            def one(i: Column) -> Column:
                column = F.pmod(i - 1, F.lit(ni)) if wrap else i - 1
                inside = F.lit(True) if wrap else i.between(1, ni)
                weight = F.when(inside & j.between(1, nj), part(i, s["w"], s["e"]) * part(j, s["s"], s["n"])).otherwise(0.0)
                value = F.coalesce(F.get(s["z"], F.when(weight > 0, (j - 1) * ni + column).otherwise(0).cast("int")).cast("double"), F.lit(0.0))
                return F.struct((value * weight).alias("v"), weight.alias("a"))

            return F.transform(columns, one)

        cells = F.flatten(F.transform(rows, line))
        sums = F.aggregate(cells, F.struct(F.lit(0.0).alias("v"), F.lit(0.0).alias("a")), lambda t, c: F.struct((t["v"] + c["v"]).alias("v"), (t["a"] + c["a"]).alias("a")))
        return once(sums, lambda t: t["v"] / F.nullif(t["a"], F.lit(0.0)))

    low, high = F.greatest(south, F.lit(0.5)), F.least(north, F.lit(nj + 0.5))
    return once(F.struct(z.alias("z"), west.cast("double").alias("w"), east.cast("double").alias("e"), low.cast("double").alias("s"), high.cast("double").alias("n")), over)


def widened(west: Column, east: Column, lat: Column) -> Column:
    """West and east ends of a box whose width grows with the parallels' shrinking, a struct of w and e."""
    mid, half = (west + east) / 2, (east - west) / 2 / F.cos(F.radians(lat))
    return F.struct((mid - half).alias("w"), (mid + half).alias("e"))


def predicted_fill(z: Column, mask: Column, ni: int) -> Column:
    """A field, held as an array, with masked points (0) of all but the first row and column replaced, in order, by left + below -
    diagonal, kept between the field's extremes."""

    def run(fields: pd.Series, masks: pd.Series) -> pd.Series:
        return pd.Series([filled(np.array(f, float), np.asarray(m)) for f, m in zip(fields, masks, strict=True)])

    def filled(f: np.ndarray, m: np.ndarray) -> list[float]:
        low, high = f.min(), f.max()
        f, m = f.reshape(-1, ni), m.reshape(-1, ni)
        for j, i in zip(*np.nonzero(m[1:, 1:] == 0), strict=True):
            f[j + 1, i + 1] = min(max(f[j + 1, i] + f[j, i + 1] - f[j, i], low), high)
        return f.ravel().tolist()

    run.__annotations__ = {"fields": pd.Series, "masks": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "array<double>")(z, mask)


def _cell(axis: list[float], at: Column) -> Column:
    """1-based cell of an axis that a place is in, the first that ends no earlier."""
    held = F.lit(np.asarray(axis, np.float64))
    return F.least(F.greatest(F.size(F.filter(held, lambda a: a < at)), F.lit(1)), F.lit(len(axis) - 1))


def hermite(axis: list[float], f: Column, slope: Column, at: Column) -> Column:
    """A cubic spline of given slopes at a place: arrays of values and slopes at the axis' points."""
    held = F.lit(np.asarray(axis, np.float64))

    def inside(s: Column) -> Column:
        k, get = s["k"], lambda c, n: F.get(c, n).cast("double")
        h = get(held, k) - get(held, k - 1)
        w = s["x"] - get(held, k - 1)
        t = w / h
        return (1 - t) * (1 - t) * w * get(slope, k - 1) - (1 - t) * w * t * get(slope, k) + (1 - t) * (1 - t) * (1 + 2 * t) * get(f, k - 1) + t * t * (3 - 2 * t) * get(f, k)

    return once(F.struct(at.cast("double").alias("x"), _cell(axis, at).alias("k")), inside)


def hermite_2d(ax: list[float], ay: list[float], f: Column, fx: Column, fy: Column, fxy: Column, x: Column, y: Column) -> Column:
    """A bicubic spline of given slopes at a place: arrays, i fastest, of values, slopes in x, in y and mixed ones."""
    ni = len(ax)
    xs, ys = F.lit(np.asarray(ax, np.float64)), F.lit(np.asarray(ay, np.float64))

    def inside(s: Column) -> Column:
        def weights(axis: Column, at: Column, k: Column) -> tuple[Column, Column, Column, Column]:
            h = F.get(axis, k) - F.get(axis, k - 1)
            w = at - F.get(axis, k - 1)
            t = w / h
            return (1 - t) * (1 - t) * w, -(1 - t) * w * t, (1 - t) * (1 - t) * (1 + 2 * t), t * t * (3 - 2 * t)

        a, b = weights(xs, s["x"], s["k"]), weights(ys, s["y"], s["l"])
        point = lambda c, di, dj: F.get(c, ((s["l"] - 1 + dj) * ni + s["k"] - 1 + di).cast("int")).cast("double")
        total = F.lit(0.0)
        for dj in (0, 1):
            slopes = reduce(lambda p, q: p + q, [a[di] * point(fxy, di, dj) + a[2 + di] * point(fy, di, dj) for di in (0, 1)])
            values = reduce(lambda p, q: p + q, [a[di] * point(fx, di, dj) + a[2 + di] * point(f, di, dj) for di in (0, 1)])
            total = total + b[dj] * slopes + b[2 + dj] * values
        return total

    place = F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), _cell(ax, x).alias("k"), _cell(ay, y).alias("l"))
    return once(place, inside)


def end_derivatives(rows: DataFrame, value: str, at: str, by: list[str]) -> DataFrame:
    """(by, first, last): derivatives at both ends of unevenly spaced series, of the cubic through the four points there; series of
    fewer points have none."""
    w = Window.partitionBy(*by).orderBy(at)
    near = [F.col(value), *[F.lead(value, k).over(w) for k in (1, 2, 3)]]
    places = [F.col(at), *[F.lead(at, k).over(w) for k in (1, 2, 3)]]
    n = F.count("*").over(Window.partitionBy(*by))
    held = rows.withColumns({f"_f{k}": c for k, c in enumerate(near)} | {f"_x{k}": c for k, c in enumerate(places)} | {"_k": F.row_number().over(w), "_n": n}).where("_n >= 4 AND (_k = 1 OR _k = _n - 3)")

    def slope(end: int) -> Column:
        order = (0, 1, 2, 3) if end == 0 else (3, 2, 1, 0)
        f, x = [F.col(f"_f{k}").cast("double") for k in order], [F.col(f"_x{k}").cast("double") for k in order]
        total = f[0] * sum((1 / (x[0] - x[k]) for k in (2, 3)), 1 / (x[0] - x[1]))
        for k in (1, 2, 3):
            a, b = (j for j in (1, 2, 3) if j != k)
            total = total + f[k] * (x[0] - x[a]) * (x[0] - x[b]) / ((x[k] - x[0]) * (x[k] - x[a]) * (x[k] - x[b]))
        return total

    first, last = F.max(F.when(F.col("_k") == 1, slope(0))), F.max(F.when(F.col("_k") == F.col("_n") - 3, slope(3)))
    return held.groupBy(*by).agg(first.alias("first"), last.alias("last"))


def squares(a: Column, b: Column, i: Column, j: Column, ni: int, nj: int, factors: tuple[float, float] = (1.0, 1.0), border: int = 0) -> Column:
    """A sum of two squares with factors, null in a border of so many columns and rows, a digit each for west, south, east, north."""
    west, south, east, north = (int(c) for c in f"{border:04d}")
    inside = i.between(1 + west, ni - east) & j.between(1 + south, nj - north)
    return F.when(inside, factors[0] * a * a + factors[1] * b * b)


def truncation(rows: DataFrame, m: Column, degree: Column, triangular: Column, half: Column) -> DataFrame:
    """rows with symmetric and antisymmetric: how many functions of wave m there are at a degree, on the globe or on half of it
    (where the symmetric and antisymmetric ones are counted apart)."""
    whole = F.when(triangular, degree - m + 1).otherwise(degree + 1)
    even = F.when(half, F.floor((whole - 1) / 2) + 1).otherwise(whole)
    odd = F.when(half, F.floor(whole / 2)).otherwise(whole)
    bad = triangular & (m > degree)
    return rows.withColumns({"symmetric": F.when(~bad, even).cast("long"), "antisymmetric": F.when(~bad, odd).cast("long")})


# Blocks of 16-bit mantissas: a header of two words, then two values a word.


def float_block(values: np.ndarray, bits: int = 16) -> bytes:
    """A block of 32-bit reals as mantissas of so many bits over the least one, brought to the greatest exponent: a word of
    exponent and shift, the least mantissa, then tokens of 16 bits, words high byte first."""
    v = np.asarray(values, np.float32)
    if not len(v):
        return b""
    top = int(max(_exponent(v.max()), _exponent(v.min())))
    ends = [_mantissas(np.array([x], np.float32), top)[0] if _exponent(x) >= 1 else 0 for x in (v.min(), v.max())]
    spread, shift, mask = ends[1] - ends[0], 0, (1 << bits) - 1
    while spread > mask:
        spread, shift = spread >> 1, shift + 1
    tokens = np.minimum((_mantissas(v, top) - ends[0] + ((1 << shift) >> 1)) >> shift, mask)
    tokens = np.append(tokens, 0) if len(tokens) % 2 else tokens
    return struct.pack(">Ii", top << 8 | shift, int(ends[0])) + tokens.astype(">u2").tobytes()


def float_unblock(block: bytes, count: int) -> np.ndarray:
    """The reals of a block."""
    if not count:
        return np.zeros(0, np.float32)
    head, least = struct.unpack(">Ii", block[:8])
    top, shift = head >> 8 & 0xFF, head & 0xFF
    if top == 0:
        return np.zeros(count, np.float32)
    tokens = np.frombuffer(block[8:], ">u2").astype(np.int64)[:count]
    m = (tokens << shift) + least
    size = np.minimum(np.abs(m), 0xFFFFFF)
    return (np.sign(m) * np.ldexp(size.astype(np.float64), top - 150)).astype(np.float32)


def _exponent(x: float) -> int:
    return int(np.float32(x).view(np.uint32) >> 23 & 0xFF)


def _mantissas(v: np.ndarray, top: int) -> np.ndarray:
    """Mantissas with the hidden bit, shifted to an exponent, with their signs."""
    word = v.view(np.uint32).astype(np.int64)
    m = (1 << 23 | word & 0x7FFFFF) >> np.minimum(top - (word >> 23 & 0xFF), 31)
    return np.where(word >> 31, -m, m)


def packed_floats(array: Column, bits: int = 16) -> Column:
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: float_block(np.asarray(x, np.float32), bits))

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "binary")(array)


def unpacked_floats(block: Column, count: Column) -> Column:
    def run(s: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([float_unblock(bytes(b), int(k)) for b, k in zip(s, n, strict=True)])

    run.__annotations__ = {"s": pd.Series, "n": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "array<float>")(block, count)
