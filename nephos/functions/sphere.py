"""Geometry of the sphere and of map projections, as Column arithmetic."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from nephos.functions import levels

RADIUS = 6_370_997.0


def distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance by arc cosine."""
    a, b = F.radians(lat1), F.radians(lat2)
    c = F.sin(a) * F.sin(b) + F.cos(a) * F.cos(b) * F.cos(F.radians(lon2 - lon1))
    return RADIUS * F.acos(F.least(F.greatest(c, F.lit(-1.0)), F.lit(1.0)))


def box_area(south: Column, north: Column, west: Column, east: Column) -> Column:
    """Area between two parallels and two meridians."""
    return RADIUS * RADIUS * F.radians(east - west) * (F.sin(F.radians(north)) - F.sin(F.radians(south)))


def triangle_area(a: Column, b: Column, c: Column) -> Column:
    """Area of a spherical triangle by its sides, as lengths, by L'Huilier's theorem."""
    x, y, z = a / RADIUS, b / RADIUS, c / RADIUS
    s = (x + y + z) / 2
    t = F.tan(s / 2) * F.tan((s - x) / 2) * F.tan((s - y) / 2) * F.tan((s - z) / 2)
    return 4 * F.atan(F.sqrt(F.greatest(t, F.lit(0.0)))) * RADIUS * RADIUS


def cartesian(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    a, b = F.radians(lat), F.radians(lon)
    return F.cos(a) * F.cos(b), F.cos(a) * F.sin(b), F.sin(a)


def geographic(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    return F.degrees(F.asin(F.least(F.greatest(z, F.lit(-1.0)), F.lit(1.0)))), F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))


def rotation(lat1: float, lon1: float, lat2: float, lon2: float) -> np.ndarray:
    """The frame whose equator goes through both points, the first of them at its longitude 180."""

    def unit(lat: float, lon: float) -> np.ndarray:
        a, b = math.radians(lat), math.radians(lon)
        return np.array([math.cos(a) * math.cos(b), math.cos(a) * math.sin(b), math.sin(a)])

    p, q = unit(lat1, lon1), unit(lat2, lon2)
    second = q - (p @ q) * p
    second /= np.linalg.norm(second)
    return np.stack([-p, -second, np.cross(p, second)])


def turned(lat: Column, lon: Column, matrix: np.ndarray) -> tuple[Column, Column]:
    """Latitude and longitude in a rotated frame; the transposed matrix turns back."""
    c = cartesian(lat, lon)
    return geographic(*[sum((float(matrix[r, k]) * c[k] for k in range(1, 3)), float(matrix[r, 0]) * c[0]) for r in range(3)])


def latlon_index(lat: Column, lon: Column, lat0: float, lon0: float, dlat: float, dlon: float) -> tuple[Column, Column]:
    """1-based indices in a latitude-longitude grid."""
    return F.pmod(lon - lon0, F.lit(360.0)) / dlon + 1, (lat - lat0) / dlat + 1


def gaussian_latitudes(n: int) -> list[float]:
    """The n latitudes of a Gaussian grid from south to north, degrees."""
    return [math.degrees(math.asin(x)) for x in np.polynomial.legendre.leggauss(n)[0]]


def axis_position(axis: list[float], value: Column) -> Column:
    """1-based fractional place of a value on an ascending axis, linear beyond its ends."""
    steps = F
    for i in range(1, len(axis)):
        part = i + (value - axis[i - 1]) / (axis[i] - axis[i - 1])
        if i == len(axis) - 1:
            return steps.otherwise(part) if i > 1 else part
        steps = steps.when(value <= axis[i], part)
    raise ValueError("an axis has two points at least")


def lambert_xy(lat: Column, lon: Column, lat1: float, lat2: float, lat0: float, lon0: float) -> tuple[Column, Column]:
    """Metres in a Lambert conformal projection with two true parallels."""
    a, b, c = (math.radians(v) for v in (lat1, lat2, lat0))
    tan = lambda v: math.tan(math.pi / 4 + v / 2)
    n = math.sin(a) if lat1 == lat2 else math.log(math.cos(a) / math.cos(b)) / math.log(tan(b) / tan(a))
    f = math.cos(a) * tan(a) ** n / n
    rho0 = RADIUS * f / tan(c) ** n
    rho = RADIUS * f / F.pow(F.tan(math.pi / 4 + F.radians(lat) / 2), n)
    theta = n * F.radians(F.pmod(lon - lon0 + 180.0, F.lit(360.0)) - 180.0)
    return rho * F.sin(theta), rho0 - rho * F.cos(theta)


def lambert_grid_xy(lat: Column, lon: Column, corner: tuple[float, float], far_lat: float, lon0: float, lat1: float, lat2: float, dx: float, dy: float) -> tuple[Column, Column]:
    """Indices on a Lambert grid of dx by dy kilometres whose point (1, 1) is the corner; the origin lies half way up to far_lat."""
    lat0 = (corner[0] + far_lat) / 2
    x, y = lambert_xy(lat, lon, lat1, lat2, lat0, lon0)
    x1, y1 = lambert_xy(F.lit(corner[0]), F.lit(corner[1]), lat1, lat2, lat0, lon0)
    return 1 + (x - x1) / (dx * 1000), 1 + (y - y1) / (dy * 1000)


def lambert_grid_latlon(x: Column, y: Column, corner: tuple[float, float], far_lat: float, lon0: float, lat1: float, lat2: float, dx: float, dy: float) -> tuple[Column, Column]:
    """Latitude and longitude of indices on such a grid."""
    lat0 = (corner[0] + far_lat) / 2
    x1, y1 = lambert_xy(F.lit(corner[0]), F.lit(corner[1]), lat1, lat2, lat0, lon0)
    return lambert_latlon(x1 + dx * 1000 * (x - 1), y1 + dy * 1000 * (y - 1), lat1, lat2, lat0, lon0)


def map_scale(r2: Column, d60: float) -> Column:
    """Scale of a polar stereographic map at a squared distance in grid lengths from the pole."""
    re = 1.866025 * 6.371e6 / d60
    return (1.866025 / 2) * (r2 + re * re) / (re * re)


def coriolis(r2: Column, d60: float) -> Column:
    re2 = (1.866025 * 6.371e6 / d60) ** 2
    return 1.458e-4 * (re2 - r2) / (re2 + r2)


def hybrid_pressure(level: Column, top: float, reference: float, power: float, surface: Column) -> Column:
    b = F.pow(F.greatest((level - top / reference) / (1 - top / reference), F.lit(0.0)), power)
    return reference * (level - b) + b * surface


def eta_pressure(level: Column, top: float, surface: Column) -> Column:
    return top * (1 - level) + level * surface


def sigma_pressure(level: Column, surface: Column) -> Column:
    return level * surface


LAMBERT_RADIUS = 6_371_100.0


def _lambert_constants(phi1: float, phi2: float, delta: float) -> tuple[float, float]:
    c1, s1, s2, c2 = (f(math.radians(v)) for f, v in ((math.cos, phi1), (math.sin, phi1), (math.sin, phi2), (math.cos, phi2)))
    a, b = math.log(c1 / c2), math.log((1 + s2) / (1 + s1))
    alpha = a / (a + b)
    return alpha, LAMBERT_RADIUS * c1 * ((1 + s1) / c1) ** alpha / alpha / delta


def conformal_xy(lat: Column, lon: Column, phi1: float, phi2: float, lon0: float, delta: float) -> tuple[Column, Column]:
    """Grid lengths from the pole in a Lambert projection of two different true parallels; meridians are not drawn together."""
    alpha, r0 = _lambert_constants(phi1, phi2, delta)
    r = r0 * F.pow(F.cos(F.radians(lat)) / (1 + F.sin(F.radians(lat))), alpha)
    return r * F.sin(F.radians(lon - lon0)), -r * F.cos(F.radians(lon - lon0))


def conformal_latlon(x: Column, y: Column, phi1: float, phi2: float, lon0: float, delta: float) -> tuple[Column, Column]:
    """Latitude and longitude of grid lengths from the pole; meridians are drawn together by the cone."""
    alpha, r0 = _lambert_constants(phi1, phi2, delta)
    lon = F.when(x != 0, lon0 + F.degrees(F.atan2(x, -y)) / alpha).otherwise(lon0)
    return 90.0 - 2 * F.degrees(F.atan(F.pow(F.sqrt(x * x + y * y) / r0, 1 / alpha))), lon


def hybrid_code(power: Column, reference: Column) -> tuple[Column, Column]:
    """The two integers of a hybrid coordinate's exponent (1 to 2) and reference pressure (400 to 1050); null out of bounds."""
    good = reference.between(400, 1050) & power.between(1, 2)
    return F.when(good, reference.cast("int")), F.when(good, (power * 1000).cast("int"))


def hybrid_numbers(g1: Column, g2: Column, g3: Column, g4: Column) -> tuple[Column, Column]:
    """Exponent and reference pressure of a hybrid coordinate's integers; null if they are out of bounds or others are set."""
    good = g1.between(400, 1050) & (g2 / 1000).between(1, 2) & (g3 == 0) & (g4 == 0)
    return F.when(good, g2 / 1000), F.when(good, g1.cast("double"))


def level_pressure(kind: Column, level: Column, surface: Column, top: Column, top_level: Column, power: Column, reference: Column) -> Column:
    """Pressure of a level by its kind: 2 pressure itself in pascals; 1 sigma, or eta with a top, over a lid of its own with the
    level of that lid, or hybrid with a reference; 5 hybrid.  Others, and hybrid ones without what they need, have none."""
    raised = F.when(kind == 1, level + (1 - level) * top / reference).otherwise(level)
    b = F.pow(F.greatest((raised - top / reference) / (1 - top / reference), F.lit(0.0)), power)
    hybrid = reference * (raised - b) + b * surface
    lid = (level - top_level) / (1 - top_level)
    eta = F.when(top_level.isNull(), top * (1 - level) + level * surface).otherwise(lid * (surface - top) + top)
    sigma = F.when(top.isNotNull() & reference.isNull(), eta).when(reference.isNotNull(), hybrid).otherwise(level * surface)
    return F.when(kind == 2, level * 100).when(kind == 1, sigma).when(kind == 5, hybrid)


def local_xy(lat: Column, lon: Column, clat: float, clon: float, d60: float, ni: int, nj: int) -> tuple[Column, Column]:
    """Grid indices of a stereographic projection around a point, which is the grid's centre; d60 metres a grid length."""
    a, c, d = F.radians(lat), math.radians(clat), F.radians(lon - clon)
    k = 2.0 / (1.0 + math.sin(c) * F.sin(a) + math.cos(c) * F.cos(a) * F.cos(d))
    x = 6_371_000.0 * k * F.cos(a) * F.sin(d)
    y = 6_371_000.0 * k * (math.cos(c) * F.sin(a) - math.sin(c) * F.cos(a) * F.cos(d))
    return x / d60 + (ni + 1) * 0.5, y / d60 + (nj + 1) * 0.5


def local_latlon(x: Column, y: Column, clat: float, clon: float, d60: float, ni: int, nj: int) -> tuple[Column, Column]:
    px, py = (x - (ni + 1) * 0.5) * d60, (y - (nj + 1) * 0.5) * d60
    rho, c = F.sqrt(px * px + py * py), math.radians(clat)
    angle = 2.0 * F.atan(rho / (2.0 * 6_371_000.0))
    sine = F.cos(angle) * math.sin(c) + py * F.sin(angle) * math.cos(c) / rho
    lat = F.degrees(F.asin(F.least(F.greatest(sine, F.lit(-1.0)), F.lit(1.0))))
    lon = clon + F.degrees(F.atan2(px * F.sin(angle), rho * math.cos(c) * F.cos(angle) - py * math.sin(c) * F.sin(angle)))
    return F.when(rho == 0, clat).otherwise(lat), F.pmod(F.when(rho == 0, clon).otherwise(lon), F.lit(360.0))


def lambert_latlon(x: Column, y: Column, lat1: float, lat2: float, lat0: float, lon0: float) -> tuple[Column, Column]:
    """The inverse of lambert_xy."""
    a, b, c = (math.radians(v) for v in (lat1, lat2, lat0))
    tan = lambda v: math.tan(math.pi / 4 + v / 2)
    n = math.sin(a) if lat1 == lat2 else math.log(math.cos(a) / math.cos(b)) / math.log(tan(b) / tan(a))
    f = math.cos(a) * tan(a) ** n / n
    rho0 = RADIUS * f / tan(c) ** n
    rho = math.copysign(1.0, n) * F.sqrt(x * x + (rho0 - y) * (rho0 - y))
    theta = F.atan2(x, rho0 - y)
    lat = F.degrees(2 * F.atan(F.pow(RADIUS * f / rho, 1 / n)) - math.pi / 2)
    return lat, F.pmod(lon0 + F.degrees(theta) / n, F.lit(360.0))


def hybrid_record(top: Column, power: Column, reference: Column) -> Column:
    """Descriptors of a record that holds a hybrid coordinate's numbers: HY of type X, its top (0 to 1200) as a level code of
    pressure, exponent and reference in two integers; null out of bounds."""
    g1, g2 = hybrid_code(power, reference)
    fields = F.struct(F.lit("HY").alias("nomvar"), F.lit("X").alias("typvar"), levels.encode(top, 2).alias("ip1"), g1.alias("ig1"), g2.alias("ig2"), F.lit(0).alias("ig3"), F.lit(0).alias("ig4"))
    return F.when(top.between(0, 1200) & g1.isNotNull(), fields)


def hybrid_of_record(record: Column) -> tuple[Column, Column, Column]:
    """Top, exponent and reference of such descriptors; null for other records and for codes that are not of a pressure."""
    top, kind = levels.decode(record["ip1"])
    power, reference = hybrid_numbers(record["ig1"], record["ig2"], record["ig3"], record["ig4"])
    good = (record["nomvar"] == "HY") & (record["typvar"] == "X") & (kind == 2) & top.between(0, 1200) & power.isNotNull()
    return F.when(good, top), F.when(good, power), F.when(good, reference)
