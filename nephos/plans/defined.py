"""Queries of defined grids: places, fields and winds on grids of every kind, and from one grid to another."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from nephos.functions.sphere import gaussian_latitudes
from nephos.operators import gridset
from nephos.operators.gridset import Grid
from nephos.plans.base import r4, read

ROTATED = (1300, 100, 54400, 54400)  # the points 40 N 250 E and 10 N 340 E
AX, AY = (200.0, 204.0, 209.0, 215.0, 222.0, 230.0, 239.0, 249.0), (-20.0, -12.0, -5.0, 1.0, 6.0, 10.0, 19.0, 30.0)
YIN_X, YIN_Y = (30.0, 70.0, 110.0, 150.0, 190.0, 230.0, 290.0, 330.0), (-50.0, -20.0, 20.0, 50.0)
GRIDS = {
    "regional": Grid("L", 8, 8, (200, 300, 12000, 25000)),
    "a": Grid("A", 8, 8), "a_north": Grid("A", 8, 8, (1, 0, 0, 0)), "b": Grid("B", 8, 8), "b_south": Grid("B", 8, 8, (2, 0, 0, 0)),
    "gaussian": Grid("G", 8, 8), "polar_north": Grid("N", 8, 8, (50, 40, 2100, 10000)), "polar_south": Grid("S", 8, 8, (50, 40, 2100, 10000)),
    "rotated": Grid("E", 8, 8, ROTATED), "uneven": Grid("Z", 8, 8, (100, 100, 9000, 0), "L", AX, AY), "uneven_rotated": Grid("Z", 8, 8, ROTATED, "E", AX, AY),
}
HALVES = Grid("U", 8, 8, halves=(Grid("Z", 8, 4, ROTATED, "E", YIN_X, YIN_Y), Grid("Z", 8, 4, (1800, 0, 28800, 28800), "E", YIN_X, YIN_Y)))


def _places(spark, d):
    n = F.col("s_suppkey")
    return read(spark, d, "supplier").select(n, ((n * 37) % 177 - 88.3).alias("lat"), ((n * 91) % 360 + 0.4).alias("lon"))


def _fields(spark, d):
    """Each embedding as a field of 8 by 8, at five places."""
    e = read(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("z"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k"))
    n = F.col("vec_id") * 7 + F.col("k") * 13
    return e.select("vec_id", F.col("k").cast("long").alias("k"), "z", ((n * 37) % 177 - 88.3).alias("lat"), ((n * 91) % 360 + 0.4).alias("lon"), ((n * 17) % 30 + 27.3).alias("rlat"), ((n * 23) % 28 + 248.2).alias("rlon"))


def _each(grids, rows):
    out = None
    for name, grid in grids.items():
        one = rows(name, grid)
        out = one if out is None else out.unionByName(one)
    return out


def grid_points(spark, d):
    return _each(GRIDS | {"halves": HALVES}, lambda name, g: g.points(spark).select(F.lit(name).alias("grid"), "i", "j", F.round("lat", 3).alias("lat"), (F.round("lon", 3) % 360).alias("lon")))


def grid_locate(spark, d):
    def rows(name, g):
        x, y = g.locate(F.col("lat"), F.col("lon"))
        return _places(spark, d).select(F.lit(name).alias("grid"), "s_suppkey", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))

    return _each(GRIDS, rows)


def grid_describe(spark, d):
    """What descriptors say of each grid: size, first place, rows with mirrored ones, what goes round and whether it ends."""
    rows = []
    for name, g in GRIDS.items():
        ex, ey = g.expanded_axes() if g.base in "ABGLE" and g.kind != "E" else ([], [])
        rows.append((name, g.kind, g.ni, g.nj, g.rows[0], g.rows[1], g.extension, g.open, g.is_rotated, len(ex), len(ey)))
    return spark.createDataFrame(rows, "grid string, kind string, ni long, nj long, j1 long, j2 long, extension long, ends boolean, rotated boolean, n_ax long, n_ay long")


def _sampled(grid, degree, lat, lon, **more):
    def query(spark, d):
        v = gridset.value_over(F.col("z"), GRIDS[grid], F.col(lat), F.col(lon), degree, **more)
        return _fields(spark, d).select("vec_id", "k", F.round(v, 4).alias("value"))

    return query


def field_extrapolated(spark, d):
    f = _fields(spark, d)
    how = {h: gridset.value_over(F.col("z"), GRIDS["regional"], F.col("rlat"), F.col("rlon"), "linear", extrapolation=h, given=7.0) for h in ("minimum", "value", "nearest", "neutral")}
    return f.select("vec_id", "k", *[F.round(c, 4).alias(f"v_{h}") for h, c in how.items()])


def field_mirrored(spark, d):
    """Half of the globe mirrored to the other, by rows between whole ones; a wind's second component changes its sign."""
    f, x, y = _fields(spark, d), (F.col("lon") / 45.0) + 1, (F.col("lat") + 90) / 12.5 - 6.5
    north = gridset.value_at(F.col("z"), GRIDS["a_north"], x, y, "linear")
    wind = gridset.wind_at(F.col("z"), F.col("z"), GRIDS["a_north"], x, y, "linear")
    south = gridset.value_at(F.col("z"), GRIDS["b_south"], x, y + 7.25, "nearest")
    return f.select("vec_id", "k", F.round(north, 4).alias("north"), F.round(wind[0], 4).alias("u"), F.round(wind[1], 4).alias("v"), F.round(south, 4).alias("south"))


def field_regridded(spark, d):
    e = read(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("z"))
    out = gridset.regridded(e, "z", GRIDS["a"], GRIDS["polar_north"], "linear")
    return out.select("vec_id", "i", "j", F.round("value", 3).alias("value"))


def field_copied(spark, d):
    e = read(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("z"))
    return gridset.regridded(e, "z", GRIDS["b"], Grid("B", 8, 8)).select("vec_id", "i", "j", r4("value").alias("value"))


def field_of_halves(spark, d):
    """Values of two halves at places, each from the half whose core it is in."""
    v = gridset.value_over(F.col("z"), HALVES, F.col("lat"), F.col("lon"), "nearest")
    x, y = HALVES.locate(F.col("lat"), F.col("lon"))
    return _fields(spark, d).select("vec_id", "k", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"), F.round(v, 4).alias("value"))


def _winds(spark, d):
    n = F.col("s_suppkey")
    return _places(spark, d).withColumns({"u": (n % 41 - 20) * 1.0, "v": (n * 3 % 37 - 18) * 1.0})


def wind_speed_on_grids(spark, d):
    def rows(name, g):
        s, a = gridset.speed_direction(g, F.col("u"), F.col("v"), F.col("lat"), F.col("lon"))
        return _winds(spark, d).select(F.lit(name).alias("grid"), "s_suppkey", r4(s).alias("speed"), (F.round(a, 3) % 360).alias("direction"))

    return _each({k: GRIDS[k] for k in ("a", "polar_north", "polar_south", "rotated", "uneven_rotated")}, rows)


def wind_components_on_grids(spark, d):
    """A speed and a direction as components along the grid, and those as ones to the east and north."""

    def rows(name, g):
        speed, direction = F.abs(F.col("u")) + 1, F.pmod(F.col("v") * 19, F.lit(360.0))
        gu, gv = gridset.components(g, speed, direction, F.col("lat"), F.col("lon"))
        w = _winds(spark, d).select("s_suppkey", "lat", "lon", gu.alias("gu"), gv.alias("gv"))
        east, north = gridset.geographic(g, F.col("gu"), F.col("gv"), F.col("lat"), F.col("lon"))
        return w.select(F.lit(name).alias("grid"), "s_suppkey", F.round("gu", 3).alias("u"), F.round("gv", 3).alias("v"), F.round(east, 3).alias("east"), F.round(north, 3).alias("north"))

    return _each({k: GRIDS[k] for k in ("a", "polar_north", "polar_south", "rotated")}, rows)


def winds_regridded(spark, d):
    """Winds of a global grid at the points of a polar one: speed, direction and components along its columns and rows."""
    e = read(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("u"), F.reverse("embedding").alias("v"))
    out = gridset.winds_regridded(e, "u", "v", GRIDS["a"], GRIDS["polar_north"], "nearest")
    return out.select("vec_id", "i", "j", *[F.round(c, 3).alias(c) for c in ("speed", "u_grid", "v_grid")])


QUERIES = {
    f.__name__: f
    for f in (grid_points, grid_locate, grid_describe, field_extrapolated, field_mirrored, field_regridded, field_copied, field_of_halves, wind_speed_on_grids, wind_components_on_grids, winds_regridded)
} | {
    "field_regional_linear": _sampled("regional", "linear", "rlat", "rlon"),
    "field_regional_cubic": _sampled("regional", "cubic", "rlat", "rlon"),
    "field_global_nearest": _sampled("a", "nearest", "lat", "lon"),
    "field_global_linear": _sampled("a", "linear", "lat", "lon"),
    "field_global_cubic": _sampled("a", "cubic", "lat", "lon"),
    "field_gaussian_linear": _sampled("gaussian", "linear", "lat", "lon"),
    "field_uneven_cubic": _sampled("uneven", "cubic", "rlat", "rlon"),
}

# The same in SQL, from the formulas of each kind.
_S = "(SELECT s_suppkey, ((s_suppkey * 37) % 177 - 88.3)::DOUBLE AS lat, ((s_suppkey * 91) % 360 + 0.4)::DOUBLE AS lon, (s_suppkey % 41 - 20)::DOUBLE AS u, (s_suppkey * 3 % 37 - 18)::DOUBLE AS v FROM supplier)"
_F = """f AS (SELECT vec_id, k, embedding AS z, ((n * 37) % 177 - 88.3)::DOUBLE AS lat, ((n * 91) % 360 + 0.4)::DOUBLE AS lon, ((n * 17) % 30 + 27.3)::DOUBLE AS rlat, ((n * 23) % 28 + 248.2)::DOUBLE AS rlon
    FROM (SELECT *, vec_id * 7 + k * 13 AS n FROM embeddings, range(0, 5) r(k)))"""
_ROOTS = [repr(float(x)) for x in gaussian_latitudes(8)]
_IJ = "(SELECT q % 8 + 1 AS i, q // 8 + 1 AS j FROM range(0, 64) r(q))"


def _frame(lat1: float, lon1: float, lat2: float, lon2: float) -> str:
    """A row with the axes e, f and g of a frame: the first point's opposite, the equator's quarter and the pole."""
    p = [f"cos(radians({lat1})) * cos(radians({lon1}))", f"cos(radians({lat1})) * sin(radians({lon1}))", f"sin(radians({lat1}))"]
    q = [f"cos(radians({lat2})) * cos(radians({lon2}))", f"cos(radians({lat2})) * sin(radians({lon2}))", f"sin(radians({lat2}))"]
    return f"""(SELECT -p1 AS e1, -p2 AS e2, -p3 AS e3, (k * p1 - q1) / s AS f1, (k * p2 - q2) / s AS f2, (k * p3 - q3) / s AS f3, (p2 * q3 - q2 * p3) / s AS g1, (q1 * p3 - p1 * q3) / s AS g2, (p1 * q2 - q1 * p2) / s AS g3 FROM (
        SELECT *, p1 * q1 + p2 * q2 + p3 * q3 AS k, sqrt(1 - (p1 * q1 + p2 * q2 + p3 * q3) ** 2) AS s FROM (SELECT {', '.join(f'({v})::DOUBLE AS p{i}' for i, v in enumerate(p, 1))}, {', '.join(f'({v})::DOUBLE AS q{i}' for i, v in enumerate(q, 1))})))"""


_FRAME = _frame(40, 250, 10, 340)
_YANG = _frame(90, 90, 0, 180)


def _into(rows: str, frame: str) -> str:
    """rows with rla and rlo, latitude and longitude in a frame."""
    return f"""(SELECT *, degrees(asin(greatest(-1, least(1, cx * g1 + cy * g2 + cz * g3)))) AS rla, (degrees(atan2(cx * f1 + cy * f2 + cz * f3, cx * e1 + cy * e2 + cz * e3)) + 360) % 360 AS rlo FROM (
        SELECT *, cos(radians(lat)) * cos(radians(lon)) AS cx, cos(radians(lat)) * sin(radians(lon)) AS cy, sin(radians(lat)) AS cz FROM {rows}), {frame})"""


def _out_of(rows: str, frame: str) -> str:
    """rows with lat and lon of rla and rlo in a frame."""
    return f"""(SELECT *, degrees(asin(greatest(-1, least(1, a * e3 + b * f3 + c * g3)))) AS lat, (degrees(atan2(a * e2 + b * f2 + c * g2, a * e1 + b * f1 + c * g1)) + 360) % 360 AS lon FROM (
        SELECT *, cos(radians(rla)) * cos(radians(rlo)) AS a, cos(radians(rla)) * sin(radians(rlo)) AS b, sin(radians(rla)) AS c FROM {rows}), {frame})"""


def _axis(v: str, axis) -> str:
    """Fractional place on an axis."""
    n = len(axis)
    if n == 2:
        return f"(1 + ({v} - ({axis[0]})) / ({axis[1]} - ({axis[0]})))"
    parts = [f"WHEN {v} <= {axis[i]} THEN {i} + ({v} - ({axis[i - 1]})) / ({axis[i]} - ({axis[i - 1]}))" for i in range(1, n - 1)]
    return f"(CASE {' '.join(parts)} ELSE {n - 1} + ({v} - ({axis[n - 2]})) / ({axis[n - 1]} - ({axis[n - 2]})) END)"


_POLE = "(1.866025 * 6371220.0 / 1000000.0)"


def _points_sql() -> str:
    lin = lambda lat, lon: f"SELECT i, j, {lat} AS lat, {lon} AS lon FROM {_IJ}"
    ax, ay = [list(map(float, a)) for a in (AX, AY)]
    pick = lambda a, c: f"{[float(x) for x in a]}[{c}]"

    def polar(s: int) -> str:
        r2 = "((i - 4) ** 2 + (j - 5) ** 2)"
        return f"SELECT i, j, {s} * degrees(asin(({_POLE} ** 2 - {r2}) / ({_POLE} ** 2 + {r2}))) AS lat, (({s} * degrees(atan2(j - 5, i - 4)) - 21) % 360 + 360) % 360 AS lon FROM {_IJ}"

    def turned(rla: str, rlo: str, frame: str, rows: str = _IJ) -> str:
        inner = f"(SELECT i, j, {rla} AS rla, {rlo} AS rlo FROM {rows})"
        return f"SELECT i, j, lat, lon FROM {_out_of(inner, frame)}"

    yin = turned(pick(YIN_Y, "j"), pick(YIN_X, "i"), _FRAME, f"(SELECT * FROM {_IJ} WHERE j <= 4)")
    yang = turned(pick(YIN_Y, "j - 4"), pick(YIN_X, "i"), _YANG, f"(SELECT * FROM {_IJ} WHERE j > 4)")
    parts = {
        "regional": lin("30 + (j - 1) * 2.0", "250 + (i - 1) * 3.0"), "a": lin("-78.75 + (j - 1) * 22.5", "(i - 1) * 45.0"), "a_north": lin("5.625 + (j - 1) * 11.25", "(i - 1) * 45.0"),
        "b": lin("-90 + (j - 1) * 180 / 7.0", "((i - 1) * 360 / 7.0) % 360"), "b_south": lin("-90 + (j - 1) * 90 / 7.0", "((i - 1) * 360 / 7.0) % 360"), "gaussian": lin(f"[{', '.join(_ROOTS)}][j]", "(i - 1) * 45.0"),
        "polar_north": polar(1), "polar_south": polar(-1), "rotated": turned("-78.75 + (j - 1) * 22.5", "(i - 1) * 360 / 7.0", _FRAME),
        "uneven": lin(pick(ay, "j"), pick(ax, "i")), "uneven_rotated": turned(pick(ay, "j"), pick(ax, "i"), _FRAME), "halves": f"{yin} UNION ALL {yang}",
    }
    return " UNION ALL ".join(f"SELECT '{k}' AS grid, i, j, round(lat, 3)::DOUBLE AS lat, (round(lon, 3) % 360)::DOUBLE AS lon FROM ({v})" for k, v in parts.items())


def _locate_sql() -> str:
    lin = lambda x, y: f"SELECT s_suppkey, {x} AS x, {y} AS y FROM {_S}"

    def polar(s: int) -> str:
        r = f"({_POLE} * cos(radians(lat)) / (1 + {s} * sin(radians(lat))))"
        return f"SELECT s_suppkey, {r} * cos(radians({s} * (lon + 21))) + 4 AS x, {r} * sin(radians({s} * (lon + 21))) + 5 AS y FROM {_S}"

    into = _into(_S, _FRAME)
    parts = {
        "regional": lin("(lon - 250) / 3 + 1", "(lat - 30) / 2 + 1"), "a": lin("lon / 45 + 1", "(lat + 78.75) / 22.5 + 1"), "a_north": lin("lon / 45 + 1", "(lat - 5.625) / 11.25 + 1"),
        "b": lin("lon * 7 / 360 + 1", "(lat + 90) * 7 / 180 + 1"), "b_south": lin("lon * 7 / 360 + 1", "(lat + 90) * 7 / 90 + 1"), "gaussian": lin("lon / 45 + 1", _axis("lat", _ROOTS)),
        "polar_north": polar(1), "polar_south": polar(-1), "rotated": f"SELECT s_suppkey, rlo * 7 / 360 + 1 AS x, (rla + 78.75) / 22.5 + 1 AS y FROM {into}",
        "uneven": lin(_axis("lon", AX), _axis("lat", AY)), "uneven_rotated": f"SELECT s_suppkey, {_axis('rlo', AX)} AS x, {_axis('rla', AY)} AS y FROM {into}",
    }
    return " UNION ALL ".join(f"SELECT '{k}' AS grid, s_suppkey, round(x, 6)::DOUBLE AS x, round(y, 6)::DOUBLE AS y FROM ({v})" for k, v in parts.items())


_MEAN = {True: "list_sum(z[57:64]::DOUBLE[]) / 8", False: "list_sum(z[1:8]::DOUBLE[]) / 8"}


def _round(i: str, j: str) -> str:
    """A point of a field that goes round, with the poles' means as rows 0 and 9."""
    return f"(CASE WHEN {j} < 1 THEN south WHEN {j} > 8 THEN north ELSE z[(greatest(1, least(8, {j})) - 1) * 8 + (({i}) + 15) % 8 + 1]::DOUBLE END)"


def _flat(i: str, j: str) -> str:
    return f"z[({j} - 1) * 8 + {i}]::DOUBLE"


def _linear(at) -> str:
    row = lambda j: f"({at('i', j)} + ({at('i + 1', j)} - {at('i', j)}) * (x - i))"
    return f"({row('j')} + ({row('j + 1')} - {row('j')}) * (y - j))"


def _cubic(at) -> str:
    def w(d: str) -> list[str]:
        return [f"(-{d}*({d}-1)*({d}-2)/6)", f"(({d}+1)*({d}-1)*({d}-2)/2)", f"(-({d}+1)*{d}*({d}-2)/2)", f"(({d}+1)*{d}*({d}-1)/6)"]

    return "(" + " + ".join(f"{w('(y - j)')[b]} * {w('(x - i)')[a]} * {at(f'(i + {a - 1})', f'(j + {b - 1})')}" for b in range(4) for a in range(4)) + ")"


def _global_sql(x: str, y: str, low: int, high: int, value: str, top: str = "8 + 11.25 / 22.5", bottom: str = "1 - 11.25 / 22.5") -> str:
    """The pole's mean at the pole, else a stencil whose rows start between low and high."""
    return f"""WITH {_F}, p AS (SELECT *, {x} AS x, {y} AS y, {_MEAN[True]} AS north, {_MEAN[False]} AS south FROM f), c AS (SELECT *, floor(x)::BIGINT AS i, greatest({low}, least({high}, floor(y)))::BIGINT AS j FROM p)
        SELECT vec_id, k, round(CASE WHEN abs(y - ({top})) < 1e-3 THEN north WHEN abs(y - ({bottom})) < 1e-3 THEN south ELSE {value} END, 4) AS value FROM c"""


_REGION = """p AS (SELECT *, (rlon - 250) / 3 + 1 AS x, (rlat - 30) / 2 + 1 AS y FROM f),
    o AS (SELECT *, floor(x + 0.5) < 1 OR floor(y + 0.5) < 1 OR floor(x + 0.5) > 8 OR floor(y + 0.5) > 8 AS beyond, list_max(z)::DOUBLE AS top, list_min(z)::DOUBLE AS least FROM p)"""


def _regional_sql(first: int, last: int, value: str) -> str:
    return f"""WITH {_F}, {_REGION}, c AS (SELECT *, greatest({first}, least({last}, floor(x)))::BIGINT AS i, greatest({first}, least({last}, floor(y)))::BIGINT AS j FROM o)
        SELECT vec_id, k, round(CASE WHEN beyond THEN top + 0.05 * (top - least) ELSE {value} END, 4) AS value FROM c"""


def _uneven_sql() -> str:
    """Lagrange's cubic on the axes, on which a cell's line goes on beyond it; outside, the greatest value and a bit."""

    def w(axis, c: str, v: str) -> list[str]:
        p = [f"{[float(a) for a in axis]}[{c} + {k}]" for k in range(-1, 3)]
        v = f"({p[1]} + ({v} - {c}) * ({p[2]} - {p[1]}))"
        return [" * ".join(f"(({v} - {p[n]}) / ({p[k]} - {p[n]}))" for n in range(4) if n != k) for k in range(4)]

    wx, wy = w(AX, "i", "x"), w(AY, "j", "y")
    cubic = " + ".join(f"{wy[b]} * {wx[a]} * {_flat(f'(i + {a - 1})', f'(j + {b - 1})')}" for b in range(4) for a in range(4))
    return f"""WITH {_F}, p AS (SELECT *, {_axis('rlon', AX)} AS x, {_axis('rlat', AY)} AS y FROM f), o AS (SELECT *, floor(x + 0.5) < 1 OR floor(y + 0.5) < 1 OR floor(x + 0.5) > 8 OR floor(y + 0.5) > 8 AS beyond, list_max(z)::DOUBLE AS top, list_min(z)::DOUBLE AS least FROM p),
        c AS (SELECT *, greatest(2, least(6, floor(x)))::BIGINT AS i, greatest(2, least(6, floor(y)))::BIGINT AS j FROM o) SELECT vec_id, k, round(CASE WHEN beyond THEN top + 0.05 * (top - least) ELSE {cubic} END, 4) AS value FROM c"""


def _mirrored_sql() -> str:
    def north(i: str, j: str, sign: str = "1") -> str:
        row = f"(CASE WHEN {j} < 1 THEN 1 - ({j}) ELSE least(8, {j}) END)"
        return f"(z[({row} - 1) * 8 + (({i}) + 15) % 8 + 1]::DOUBLE * CASE WHEN {j} < 1 THEN {sign} ELSE 1 END)"

    def scalar(i: str, j: str) -> str:
        return f"(CASE WHEN {j} > 8 THEN north WHEN {j} < -7 THEN south ELSE {north(i, f'greatest(-7, {j})')} END)"

    wind = lambda sign: _linear(lambda i, j: north(i, j.replace("j", "jw"), sign)).replace("(y - j)", "(y - jw)")
    return f"""WITH {_F}, p AS (SELECT *, lon / 45 + 1 AS x, (lat + 90) / 12.5 - 6.5 AS y, {_MEAN[True]} AS north, {_MEAN[False]} AS south FROM f),
        c AS (SELECT *, floor(x)::BIGINT AS i, greatest(-8, least(8, floor(y)))::BIGINT AS j, greatest(-7, least(7, floor(y)))::BIGINT AS jw, greatest(1, least(15, round(y + 7.25)))::BIGINT AS js FROM p)
        SELECT vec_id, k, round(CASE WHEN abs(y - 8.5) < 1e-3 THEN north WHEN abs(y + 7.5) < 1e-3 THEN south ELSE {_linear(scalar)} END, 4) AS north, round({wind('1')}, 4) AS u, round({wind('-1')}, 4) AS v,
        round(CASE WHEN abs(y + 6.25) < 1e-3 THEN south WHEN abs(y - 7.75) < 1e-3 THEN north ELSE CASE WHEN round(y + 7.25) > 15 THEN north WHEN round(y + 7.25) < 1 THEN south ELSE z[(CASE WHEN js > 8 THEN 16 - js ELSE js END - 1) * 8 + (round(x)::BIGINT + 6) % 7 + 1]::DOUBLE END END, 4) AS south FROM c"""


def _halves_sql() -> str:
    """The core of the first half has the columns from 70 to 290 and the rows from -20 to 20 degrees."""
    first, second = _into("f", _FRAME), _into("f", _YANG)
    near = lambda v, n: f"greatest(1, least({n}, round({v})))"
    return f"""WITH {_F}, a AS (SELECT vec_id, k, z, rla, rlo, {_axis('rlo', YIN_X)} AS x, {_axis('rla', YIN_Y)} AS y FROM {first}), b AS (SELECT vec_id, k, {_axis('rlo', YIN_X)} AS x2, {_axis('rla', YIN_Y)} AS y2 FROM {second}),
        c AS (SELECT *, {_axis('rlo', YIN_X[1:7])} AS cx, {_axis('rla', YIN_Y[1:3])} AS cy FROM a JOIN b USING (vec_id, k)), s AS (SELECT *, floor(cx + 0.5) BETWEEN 1 AND 6 AND floor(cy + 0.5) BETWEEN 1 AND 2 AS inside FROM c),
        q AS (SELECT vec_id, k, z, inside, CASE WHEN inside THEN x ELSE x2 END AS x, CASE WHEN inside THEN y ELSE y2 + 4 END AS y FROM s), r AS (SELECT *, CASE WHEN y <= 4 THEN y ELSE y - 4 END AS w, CASE WHEN y <= 4 THEN z[1:32] ELSE z[33:64] END AS h FROM q),
        t AS (SELECT *, floor(x + 0.5) < 1 OR floor(x + 0.5) > 8 OR floor(w + 0.5) < 1 OR floor(w + 0.5) > 4 AS beyond, list_max(h)::DOUBLE AS top, list_min(h)::DOUBLE AS least FROM r)
        SELECT vec_id, k, round(x, 6) AS x, round(y, 6) AS y, round(CASE WHEN beyond THEN top + 0.05 * (top - least) ELSE h[(({near('w', 4)} - 1) * 8 + {near('x', 8)})::BIGINT]::DOUBLE END, 4) AS value FROM t"""


def _polar_target(value: str, extra: str = "") -> str:
    """The points of the polar grid with x and y on the global one."""
    r2 = "((pi - 4) ** 2 + (pj - 5) ** 2)"
    return f"""t AS (SELECT *, degrees(asin(({_POLE} ** 2 - {r2}) / ({_POLE} ** 2 + {r2}))) AS lat, ((degrees(atan2(pj - 5, pi - 4)) - 21) % 360 + 360) % 360 AS lon FROM (SELECT q % 8 + 1 AS pi, q // 8 + 1 AS pj FROM range(0, 64) r(q))),
        p AS (SELECT vec_id, pi, pj, lon, embedding AS z, lon / 45 + 1 AS x, (lat + 78.75) / 22.5 + 1 AS y, list_sum(embedding[57:64]::DOUBLE[]) / 8 AS north, list_sum(embedding[1:8]::DOUBLE[]) / 8 AS south FROM embeddings, t),
        c AS (SELECT *, floor(x)::BIGINT AS i, greatest(0, least(8, floor(y)))::BIGINT AS j{extra} FROM p) {value}"""


def _wind_sql(speed: bool) -> str:
    rotated = f"(SELECT *, {_ROT_U} AS gu, {_ROT_V} AS gv FROM {_into(_S, _FRAME)})"
    angle = lambda start, u, v: f"(({start} - degrees(atan2({v}, {u}))) % 360 + 360) % 360"
    if speed:
        rows = {"a": (_S, "270", "u", "v"), "polar_north": (_S, "lon + 21", "u", "v"), "polar_south": (_S, "180 - lon + 21", "u", "v"), "rotated": (rotated, "270", "gu", "gv"), "uneven_rotated": (rotated, "270", "gu", "gv")}
        return " UNION ALL ".join(f"SELECT '{k}' AS grid, s_suppkey, round(sqrt(u * u + v * v), 4) AS speed, CASE WHEN u = 0 AND v = 0 THEN 0 ELSE round({angle(s, a, b)}, 3) % 360 END AS direction FROM {r}" for k, (r, s, a, b) in rows.items())
    w = f"(SELECT *, abs(u) + 1 AS sp, (v * 19 % 360 + 360) % 360 AS di, -(abs(u) + 1) * sin(radians(v * 19)) AS east, -(abs(u) + 1) * cos(radians(v * 19)) AS north FROM {_S})"
    along = f"(SELECT *, {_INTO_U} AS gu, {_INTO_V} AS gv FROM {_into(w, _FRAME)})"
    rows = {"a": (w, "east", "north"), "rotated": (along, "gu", "gv")}
    rows |= {k: (w, f"sp * cos(radians({s} - di))", f"sp * sin(radians({s} - di))") for k, s in (("polar_north", "lon + 21"), ("polar_south", "180 - lon + 21"))}
    return " UNION ALL ".join(f"SELECT '{k}' AS grid, s_suppkey, round({a}, 3) + 0 AS u, round({b}, 3) + 0 AS v, round(east, 3) + 0 AS east, round(north, 3) + 0 AS north FROM {r}" for k, (r, a, b) in rows.items())


# A wind's vector along the frame's axes: east and north there of u and v, as one in space, along east and north here.
_VX = [f"(u * (-sin(radians(rlo)) * e{n} + cos(radians(rlo)) * f{n}) + v * (-sin(radians(rla)) * (cos(radians(rlo)) * e{n} + sin(radians(rlo)) * f{n}) + cos(radians(rla)) * g{n}))" for n in (1, 2, 3)]
_ROT_U = f"({_VX[1]} * cos(radians(lon)) - {_VX[0]} * sin(radians(lon)))"
_ROT_V = f"({_VX[2]} * cos(radians(lat)) - ({_VX[0]} * cos(radians(lon)) + {_VX[1]} * sin(radians(lon))) * sin(radians(lat)))"
_WX = ["(-east * sin(radians(lon)) - north * sin(radians(lat)) * cos(radians(lon)))", "(east * cos(radians(lon)) - north * sin(radians(lat)) * sin(radians(lon)))", "(north * cos(radians(lat)))"]
_ON = {a: "(" + " + ".join(f"{_WX[n - 1]} * {a}{n}" for n in (1, 2, 3)) + ")" for a in "efg"}
_INTO_U = f"({_ON['f']} * cos(radians(rlo)) - {_ON['e']} * sin(radians(rlo)))"
_INTO_V = f"({_ON['g']} * cos(radians(rla)) - ({_ON['e']} * cos(radians(rlo)) + {_ON['f']} * sin(radians(rlo))) * sin(radians(rla)))"

_DESCRIBED = {
    "regional": ("L", 1, 8, 0, True, False, 8, 8), "a": ("A", 1, 8, 2, False, False, 11, 8), "a_north": ("A", -7, 8, 2, False, False, 11, 16), "b": ("B", 1, 8, 1, False, False, 10, 8), "b_south": ("B", 1, 15, 1, False, False, 10, 15),
    "gaussian": ("G", 1, 8, 2, False, False, 11, 8), "polar_north": ("N", 1, 8, 0, True, False, 0, 0), "polar_south": ("S", 1, 8, 0, True, False, 0, 0), "rotated": ("E", 1, 8, 0, False, True, 0, 0),
    "uneven": ("Z", 1, 8, 0, True, False, 8, 8), "uneven_rotated": ("Z", 1, 8, 0, True, True, 8, 8),
}
_near = _round("(round(x)::BIGINT)", "(greatest(0, least(9, round(y)))::BIGINT)")
ORACLE_SQL = {
    "grid_points": _points_sql(),
    "grid_locate": _locate_sql(),
    "grid_describe": "SELECT grid, kind, " + ", ".join(f"{c}::BIGINT AS {c}" for c in ("ni", "nj", "j1", "j2", "extension", "n_ax", "n_ay")) + ", ends, rotated FROM (VALUES " + ", ".join(f"('{k}', '{v[0]}', 8, 8, {', '.join(str(x) for x in v[1:])})" for k, v in _DESCRIBED.items()) + ") t(grid, kind, ni, nj, j1, j2, extension, ends, rotated, n_ax, n_ay)",
    "field_regional_linear": _regional_sql(1, 7, _linear(_flat)),
    "field_regional_cubic": _regional_sql(2, 6, _cubic(_flat)),
    "field_extrapolated": f"""WITH {_F}, {_REGION}, c AS (SELECT *, greatest(1, least(7, floor(x)))::BIGINT AS i, greatest(1, least(7, floor(y)))::BIGINT AS j FROM o), v AS (SELECT *, {_linear(_flat)} AS v FROM c)
        SELECT vec_id, k, round(CASE WHEN beyond THEN least - 0.05 * (top - least) ELSE v END, 4) AS v_minimum, round(CASE WHEN beyond THEN 7 ELSE v END, 4) AS v_value,
        round(CASE WHEN beyond THEN z[((greatest(1, least(8, round(y))) - 1) * 8 + greatest(1, least(8, round(x))))::BIGINT]::DOUBLE ELSE v END, 4) AS v_nearest, round(v, 4) AS v_neutral FROM v""",
    "field_global_nearest": _global_sql("lon / 45 + 1", "(lat + 78.75) / 22.5 + 1", 0, 8, _near),
    "field_global_linear": _global_sql("lon / 45 + 1", "(lat + 78.75) / 22.5 + 1", 0, 8, _linear(_round)),
    "field_global_cubic": _global_sql("lon / 45 + 1", "(lat + 78.75) / 22.5 + 1", 1, 7, _cubic(_round)),
    "field_gaussian_linear": _global_sql("lon / 45 + 1", _axis("lat", _ROOTS), 0, 8, _linear(_round), _axis("90.0", _ROOTS), _axis("-90.0", _ROOTS)),
    "field_uneven_cubic": _uneven_sql(),
    "field_mirrored": _mirrored_sql(),
    "field_regridded": "WITH " + _polar_target(f"SELECT vec_id, pi AS i, pj AS j, round(CASE WHEN abs(y - 8.5) < 1e-3 THEN north ELSE {_linear(_round)} END, 3) AS value FROM c"),
    "field_copied": "SELECT vec_id, q % 8 + 1 AS i, q // 8 + 1 AS j, round(embedding[q + 1]::DOUBLE, 4) AS value FROM embeddings, range(0, 64) r(q)",
    "field_of_halves": _halves_sql(),
    "wind_speed_on_grids": _wind_sql(True),
    "wind_components_on_grids": _wind_sql(False),
    "winds_regridded": "WITH " + _polar_target(
        """, w AS (SELECT vec_id, pi, pj, lon, z[k]::DOUBLE AS u, z[65 - k]::DOUBLE AS v FROM c), s AS (SELECT *, lon + 21 - (270 - degrees(atan2(v, u))) AS psi, sqrt(u * u + v * v) AS speed FROM w)
        SELECT vec_id, pi AS i, pj AS j, round(speed, 3) + 0 AS speed, round(speed * cos(radians(psi)), 3) + 0 AS u_grid, round(speed * sin(radians(psi)), 3) + 0 AS v_grid FROM s""",
        ", ((greatest(1, least(8, round(y))) - 1) * 8 + (round(x)::BIGINT + 7) % 8 + 1)::BIGINT AS k",
    ),
}
