"""Grid descriptors as four integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Fixed values of the code: radius of the earth, and the length that makes the projection true at 60 degrees.
RADIUS, TRUE_AT_60 = 6.371e6, 1.866025


def _n(c: Column) -> Column:
    return F.round(c).cast("int")


def _turned(c: Column, whole: int) -> Column:
    """A negative angle as the positive one."""
    return F.when(c < 0, F.pmod(c, F.lit(whole))).otherwise(c)


def _polar_latlon(x: Column, y: Column, d60: Column, dgrw: Column, south: bool) -> tuple[Column, Column]:
    r2, re2 = x * x + y * y, F.pow(TRUE_AT_60 * RADIUS / d60, F.lit(2.0))
    pole = (x == 0) & (y == 0)
    lon = F.degrees(F.atan2(y, x)) - dgrw
    lon = F.when(lon > 180, lon - 360).when(lon < -180, lon + 360).otherwise(lon)
    lat = F.degrees(F.asin((re2 - r2) / (re2 + r2)))
    sign = -1.0 if south else 1.0
    return sign * F.when(pole, 90.0).otherwise(lat), sign * F.when(pole, 0.0).otherwise(lon)


def _polar_xy(lat: Column, lon: Column, d60: Column, dgrw: Column, south: bool) -> tuple[Column, Column]:
    sign = -1.0 if south else 1.0
    sine, angle = F.sin(F.radians(sign * lat)), F.radians(sign * lon + dgrw)
    r = TRUE_AT_60 * RADIUS / d60 * F.sqrt((1.0 - sine) / (1.0 + sine))
    return r * F.cos(angle), r * F.sin(angle)


def _pack_polar(x1: Column, x2: Column, x3: Column, x4: Column, south: bool) -> tuple[Column, Column, Column, Column]:
    """Pole and spacing where they fit; else the latitude and longitude of the first point, the spacing and the angle."""
    plain = _n(x2 * 10.0), _n(x1 * 10.0), _turned(_n(x4 * 100.0), 36000), _n(x3 * 0.01)
    beyond = (plain[0] < 0) | (plain[1] < 0) | (plain[0] > 2047) | (plain[1] > 2047) | (plain[3] > 32000)
    far = x3 > 204700
    angle = _n(x4 * 10.0)
    turns = F.when(angle < 0, 1).otherwise(0) + F.when(F.abs(angle) > 1800, 1).otherwise(0)
    lat, lon = _polar_latlon(1.0 - x1, 1.0 - x2, x3, x4, south)
    lon = F.when(lon < 0, lon + 360).otherwise(lon)
    other = (
        F.when(far, _n(x3 * 0.001)).otherwise(_n(x3 * 0.01)),
        F.when(F.abs(angle) > 1800, F.abs(F.abs(angle) - 3600)).otherwise(F.abs(angle)),
        F.when(far, 32768).otherwise(0) + _n(lon * 32767.0 / 360.0),
        32768 + 16384 * turns + _n((90.0 - lat) * 16383.0 / 180.0),
    )
    return tuple(F.when(beyond, o).otherwise(p).cast("int") for o, p in zip(other, plain, strict=True))


def _unpack_polar(g1: Column, g2: Column, g3: Column, g4: Column, south: bool) -> tuple[Column, Column, Column, Column]:
    far, rest = g3 > 32767, g4 - 32768
    d60 = g1 * F.when(far, 1000.0).otherwise(100.0)
    below = rest > 16383
    angle = F.when(below, 360.0 - g2 * 0.1).otherwise(g2 * 0.1)
    lat = 90.0 - F.when(below, rest - 16384).otherwise(rest) * (180.0 / 16383.0)
    lon = F.when(far, g3 - 32768).otherwise(g3) * (360.0 / 32767.0)
    x, y = _polar_xy(lat, lon, d60, angle, south)
    old = g4 < 32768
    return tuple(F.when(old, a).otherwise(b) for a, b in ((g2 / 10.0, 1.0 - x), (g1 / 10.0, 1.0 - y), (g4 * 100.0, d60), (g3 * 0.01, angle)))


def pack(kind: str, x1: Column, x2: Column, x3: Column, x4: Column) -> tuple[Column, Column, Column, Column]:
    """The integers of a grid of this kind: N and S polar stereographic, A, B and G global, C and L latitude-longitude, H
    Lambert, E rotated by two points, + a point."""
    zero = F.lit(0)
    if kind in "NS":
        return _pack_polar(x1, x2, x3, x4, kind == "S")
    if kind in "ABG":
        return x1.cast("int"), x2.cast("int"), zero, zero
    if kind == "C":
        return _n(180.0 / x3), _n(360.0 / x4), _n((x1 + 90.0) * 100.0), _turned(_n(x2 * 100.0), 36000)
    if kind == "H":
        return _turned(_n(x4 * 5.0), 1800), _n(x3 * 0.002), _n(x1), _n((x2 + 90.0) * 100.0)
    if kind == "L":
        return _n(x3 * 100.0), _n(x4 * 100.0), _n((x1 + 90.0) * 100.0), _turned(_n(x2 * 100.0), 36000)
    if kind == "E":
        # Fortieths of a degree in 16 and 14 bits: the two low bits of a latitude stand with the other number.
        first, second = _n((x1 + 90.0) * 40.0), _n(x3 * 40.0)
        second = F.when(second < 0, second + 7201).otherwise(second)
        third, fourth = _n((_turned(x2, 360) + 90.0) * 40.0), _n(_turned(x4, 360) * 40.0)
        third = F.when(third >= 16384, third - 16384).otherwise(third)
        low = lambda c: c.bitwiseAND(F.lit(3))
        return F.shiftright(first, 2), F.shiftright(second, 2), F.shiftleft(third, 2).bitwiseOR(low(first)), F.shiftleft(fourth, 2).bitwiseOR(low(second))
    if kind == "+":
        # Hundredths, and what a hundred-thousandth is off them.
        lon = F.when(x2 < 0, x2 + 360.0).otherwise(x2)
        third, fourth = _n((x1 + 100.0) * 100.0), _n(lon * 100.0)
        return _n((x1 + 100.0) * 100000.0) - third * 1000 + 1000, _n(lon * 100000.0) - fourth * 1000 + 1000, third, fourth
    raise ValueError(f"no descriptor for a grid of kind {kind}")


def unpack(kind: str, g1: Column, g2: Column, g3: Column, g4: Column) -> tuple[Column, Column, Column, Column]:
    if kind in "NS":
        return _unpack_polar(g1, g2, g3, g4, kind == "S")
    if kind in "ABG":
        return g1 * 1.0, g2 * 1.0, F.lit(0.0), F.lit(0.0)
    if kind == "C":
        return g3 * 0.01 - 90.0, g4 * 0.01, 180.0 / g1, 360.0 / g2
    if kind == "H":
        return g3 * 1.0, g4 * 0.01 - 90.0, g2 * 500.0, g1 * 0.2
    if kind == "L":
        return g3 * 0.01 - 90.0, g4 * 0.01, g1 * 0.01, g2 * 0.01
    if kind == "E":
        low = lambda c: c.bitwiseAND(F.lit(3))
        first, second = F.shiftleft(g1, 2).bitwiseOR(low(g3)), F.shiftleft(g2, 2).bitwiseOR(low(g4))
        second = F.when(second > 3600, second - 7201).otherwise(second)
        third, fourth = F.shiftright(g3, 2), F.shiftright(g4, 2)
        third = F.when(third < 3559, third + 16384).otherwise(third)
        return (first - 3600) / 40.0, (third - 3600) / 40.0, second / 40.0, fourth / 40.0
    if kind == "+":
        more = lambda g: F.when(g != 0, (g - 1000) * 0.00001).otherwise(0.0)
        return g3 * 0.01 - 100.0 + more(g1), g4 * 0.01 + more(g2), F.lit(0.0), F.lit(0.0)
    raise ValueError(f"no descriptor for a grid of kind {kind}")


def printable(kind: str, g1: Column, g2: Column, g3: Column, g4: Column) -> tuple[Column, Column, Column, Column]:
    """The four numbers of a descriptor as text of fixed widths: what they mean for N, S, A, B, G and E, the integers for other
    kinds.  A number wider than its place is a row of stars; nulls stay null."""
    whole, km = "%{}d", "%{}.1fKm"
    forms = [whole] * 4
    x = [g.cast("long") for g in (g1, g2, g3, g4)]
    if kind in "NS":
        a, b, c, e = unpack(kind, g1, g2, g3, g4)
        x, forms = [a, b, c / 1000, e], ["%{}.1f", "%{}.1f", km, "%{}.3f"]
    elif kind in "ABG":
        x = [v.cast("long") for v in unpack(kind, g1, g2, g3, g4)]
    elif kind == "E":
        x, forms = list(unpack(kind, g1, g2, g3, g4)), ["%{}.2f", "%{}.2f", "%{}.3f", "%{}.3f"]

    def text(value: Column, form: str, width: int) -> Column:
        # The unit stands beside a number that is two places narrower.
        t = F.format_string(form.format(width - 2 if form == km else width), value)
        stars = "*" * (width - 2) + "Km" if form == km else "*" * width
        return F.when(value.isNull(), None).when(F.length(t) > width, stars).otherwise(t)

    return tuple(text(v, f, w) for v, f, w in zip(x, forms, (6, 6, 7, 7), strict=True))
