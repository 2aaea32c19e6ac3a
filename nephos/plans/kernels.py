"""Queries of kernels on fields and series, spectral tables, Lambert projections and pressures of levels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from nephos.functions import sphere
from nephos.operators import fields as ops
from nephos.operators import grids, spectral
from nephos.plans.base import GRID_SQL, grid, r4, read
from nephos.plans.grids import _points

AXIS = [0.0, 1.0, 2.5, 3.0, 5.0, 6.0, 8.0, 9.0]


def _p(n, a, b):
    return (n * a % 97 / 10.0, n * b % 89 / 10.0)


def point_in_cells(spark, d):
    n = F.col("p_partkey")
    x, y = _p(n, 7, 11)
    p, corners = (x + 0.037, y + 0.0191), [_p(n, 13, 17), _p(n, 19, 23), _p(n, 29, 31), _p(n, 37, 41)]
    return read(spark, d, "part").select("p_partkey", ops.in_triangle(p, *corners[:3]).alias("triangle"), ops.in_quadrilateral(p, *corners).alias("quadrilateral"))


def neighbours_masked(spark, d):
    """Nearest points of those that a mask keeps."""
    c, s = _points(spark, d)
    k = grids.nearest_points(c, s.where("s_suppkey % 3 <> 0"), "c_custkey", "s_suppkey", 3)
    return k.groupBy("c_custkey").agg(F.count("*").alias("n"), F.max("s_suppkey").alias("greatest"), r4(F.sum(F.col("weight") * F.col("d2"))).alias("d2"))


def _boxes(spark, d):
    n = F.col("vec_id")
    e = read(spark, d, "embeddings").select(n, F.col("embedding").alias("z"), (n * 7 % 50 / 10.0 + 0.7).alias("w"), (n * 11 % 40 / 10.0 + 0.7).alias("s"))
    return e.withColumns({"e": F.col("w") + n % 23 / 10.0 + 0.4, "n": F.col("s") + n % 29 / 10.0 + 0.3})


def average_box(spark, d):
    v = ops.box_average(F.col("z"), 8, 8, tuple(F.col(c) for c in "wesn"))
    return _boxes(spark, d).select("vec_id", r4(v).alias("mean"))


def average_spherical(spark, d):
    """Boxes round the globe, wider towards the poles."""
    b = _boxes(spark, d).withColumn("lat", (F.col("s") + F.col("n")) / 2 * 15 - 67.5)
    b = b.withColumn("x", ops.widened(F.col("w"), F.col("e"), F.col("lat")))
    v = ops.box_average(F.col("z"), 8, 8, (F.col("x.w"), F.col("x.e"), F.col("s"), F.col("n")), wrap=True)
    return b.select("vec_id", F.round("x.w", 4).alias("west"), r4(v).alias("mean"))


def predicted_fill(spark, d):
    """Two columns and two rows: what is masked depends on nothing that is masked before it."""
    z, m = F.slice("embedding", 1, 4), F.array(F.lit(1), F.lit(1), F.lit(1), F.col("vec_id") % 2)
    return read(spark, d, "embeddings").select("vec_id", F.posexplode(ops.predicted_fill(z, m, 2)).alias("k", "value")).select("vec_id", F.col("k").cast("long").alias("k"), r4("value").alias("value"))


def spline_slopes(spark, d):
    n = F.col("vec_id")
    x = n * 7 % 95 / 10.0 - 0.2
    v = ops.hermite(AXIS, F.slice("embedding", 1, 8), F.slice("embedding", 9, 8), x)
    return read(spark, d, "embeddings").select("vec_id", r4(v).alias("value"))


def spline_surface(spark, d):
    """A bicubic spline on four by four points: values and slopes are the quarters of each vector."""
    n = F.col("vec_id")
    parts = [F.slice("embedding", 16 * k + 1, 16) for k in range(4)]
    v = ops.hermite_2d(AXIS[:4], AXIS[2:6], *parts, n * 7 % 31 / 10.0, n * 11 % 36 / 10.0 + 2.4)
    return read(spark, d, "embeddings").select("vec_id", r4(v).alias("value"))


def end_derivatives(spark, d):
    e = read(spark, d, "events").withColumn("x", F.col("event_id").cast("double"))
    s = ops.end_derivatives(e, "value", "x", ["user_id"])
    return s.select("user_id", r4("first").alias("first"), r4("last").alias("last"))


def sum_of_squares(spark, d):
    g = grid(spark, d)
    rows = read(spark, d, "orders").agg(F.max("o_orderkey")).first()[0] or 0
    s = ops.squares(F.col("f"), F.col("v"), F.col("i"), F.col("j"), 7, rows, (2.0, 0.5), 1213)
    return g.select("i", "j", r4(s).alias("value"))


def truncation_rows(spark, d):
    n = F.col("p_partkey")
    t = ops.truncation(read(spark, d, "part").select(n, (n % 23).alias("m")), F.col("m"), n % 19 + 2, n % 2 == 0, n % 3 == 0)
    return t.select("p_partkey", "symmetric", "antisymmetric")


def legendre_slopes(spark, d):
    rows = [(i, m, n, float(v)) for i in range(9) for (m, n), v in spectral.legendre_derivatives(i / 10 - 0.4, 3).items()]
    table = spark.createDataFrame(rows, "place long, m long, n long, v double")
    halves = spectral.halves_order(table.withColumnRenamed("place", "spot"))
    return halves.select("spot", "m", "n", F.round("v", 6).alias("slope"), "part", "place")


def gaussian_roots(spark, d):
    """Latitudes and weights of Gaussian grids of two, three and four rows."""
    rows = [(n, j, float(lat), float(w)) for n in (2, 3, 4) for j, (lat, w) in enumerate(zip(sphere.gaussian_latitudes(n), np.polynomial.legendre.leggauss(n)[1], strict=True), 1)]
    return spark.createDataFrame(rows, "n long, j long, lat double, weight double").select("n", "j", F.round("lat", 6).alias("lat"), F.round("weight", 6).alias("weight"))


def lambert_two_parallels(spark, d):
    n = F.col("s_suppkey")
    x, y = sphere.conformal_xy(n * 7 % 60 + 15.0, n * 11 % 90 + 230.0, 30.0, 60.0, 270.0, 50_000.0)
    lat, lon = sphere.conformal_latlon(F.col("x"), F.col("y"), 30.0, 60.0, 270.0, 50_000.0)
    return read(spark, d, "supplier").select("s_suppkey", x.alias("x"), y.alias("y")).select("s_suppkey", r4("x").alias("x"), r4("y").alias("y"), F.round(lat, 3).alias("lat"), F.round(lon, 3).alias("lon"))


def hybrid_codes(spark, d):
    n = F.col("p_partkey")
    g = sphere.hybrid_code(n % 130 / 100.0 + 0.9, n * 7 % 800 + 350.5)
    p = read(spark, d, "part").select("p_partkey", g[0].alias("g1"), g[1].alias("g2"))
    power, reference = sphere.hybrid_numbers(F.col("g1"), F.col("g2"), F.when(F.col("p_partkey") % 5 == 0, 1).otherwise(0), F.lit(0))
    return p.select("p_partkey", F.col("g1").cast("long").alias("g1"), F.col("g2").cast("long").alias("g2"), r4(power).alias("power"), reference.alias("reference"))


def pressure_by_kind(spark, d):
    n, s = F.col("p_partkey"), F.col("p_size")
    kind = F.element_at(F.array(F.lit(1), F.lit(2), F.lit(5), F.lit(4)), (n % 4 + 1).cast("int"))
    level = F.when(kind == 2, s * 20.0).otherwise(s / 50.0)
    top, reference = F.when(n % 3 > 0, 10.0), F.when(n % 3 == 2, 800.0)
    v = sphere.level_pressure(kind, level, 900 + s * 2.0, top, F.when(n % 7 == 0, 0.05), F.lit(1.6), reference)
    return read(spark, d, "part").select("p_partkey", r4(v).alias("pressure"))


def packed_floats(spark, d):
    e = read(spark, d, "embeddings").select("vec_id", "embedding").withColumn("b", ops.packed_floats(F.col("embedding"), 12))
    back = e.select("vec_id", "b", F.posexplode(ops.unpacked_floats(F.col("b"), F.size("embedding"))).alias("k", "v"))
    return back.groupBy("vec_id").agg(F.first(F.octet_length("b")).cast("long").alias("n_bytes"), F.round(F.sum(F.col("v").cast("double") * (F.col("k") + 1)), 5).alias("total"))


def point_in_cloud(spark, d):
    """Points on an uneven grid, some of them off it, by the node that an even grid would name."""
    v, nodes = F.col("vec_id"), F.sequence(F.lit(0), F.lit(63))
    xs = F.transform(nodes, lambda k: k % 8 + 1 + k * 5 % 7 / 20.0 + F.floor(k / 8) / 10.0)
    ys = F.transform(nodes, lambda k: F.floor(k / 8) + 1 + k * 3 % 5 / 16.0 - k % 8 / 25.0)
    e = read(spark, d, "embeddings").select("vec_id", (v * 7 % 89 / 10.0 + 0.513).alias("px"), (v * 11 % 83 / 10.0 + 0.517).alias("py"))
    at = ops.place_in_cloud((F.col("px"), F.col("py")), xs, ys, F.round("px").cast("int"), F.round("py").cast("int"), 8, 8)
    return e.select("vec_id", at.alias("at")).select("vec_id", F.col("at").isNotNull().alias("inside"), r4("at.x").alias("x"), r4("at.y").alias("y"))


QUERIES = {
    f.__name__: f
    for f in (point_in_cells, point_in_cloud, neighbours_masked, average_box, average_spherical, predicted_fill, spline_slopes, spline_surface, end_derivatives, sum_of_squares, truncation_rows, legendre_slopes, gaussian_roots, lambert_two_parallels, hybrid_codes, pressure_by_kind, packed_floats)
}


def _in(corners: list[tuple[int, int]]) -> str:
    """By the signs of three cross products, which a point inside makes alike."""
    at = lambda c, m: f"(p_partkey * {c} % {m} / 10.0)"
    p = (f"({at(7, 97)} + 0.037)", f"({at(11, 89)} + 0.0191)")
    q = [(at(a, 97), at(b, 89)) for a, b in corners]
    cross = [f"(({q[(k + 1) % 3][0]} - {q[k][0]}) * ({p[1]} - {q[k][1]}) - ({q[(k + 1) % 3][1]} - {q[k][1]}) * ({p[0]} - {q[k][0]}))" for k in range(3)]
    flat = f"(({q[1][0]} - {q[0][0]}) * ({q[2][1]} - {q[0][1]}) - ({q[1][1]} - {q[0][1]}) * ({q[2][0]} - {q[0][0]})) <> 0"
    return f"({flat} AND (({' AND '.join(f'{c} >= 0' for c in cross)}) OR ({' AND '.join(f'{c} <= 0' for c in cross)})))"


_C = [(13, 17), (19, 23), (29, 31), (37, 41)]
_BOX = """b AS (SELECT vec_id, embedding AS z, vec_id * 7 % 50 / 10.0 + 0.7 AS w, vec_id * 11 % 40 / 10.0 + 0.7 AS s, w + vec_id % 23 / 10.0 + 0.4 AS e, s + vec_id % 29 / 10.0 + 0.3 AS n FROM embeddings)"""


def _average(west: str, east: str, columns: str, at: str) -> str:
    return f"""c AS (SELECT vec_id, z[((j - 1) * 8 + {at})::BIGINT]::DOUBLE AS v, greatest(0, least(i + 0.5, {east}) - greatest(i - 0.5, {west})) * greatest(0, least(j + 0.5, n) - greatest(j - 0.5, s)) AS a FROM b, range({columns}) p(i), range(1, 9) q(j))"""


def _spline_sql(x: str, axis: list[float], value, slope) -> str:
    """The cubic of each cell by its end values and slopes, in powers of the way into it."""
    cases = []
    for k in range(1, len(axis)):
        h, t = axis[k] - axis[k - 1], f"(({x} - {axis[k - 1]}) / {axis[k] - axis[k - 1]})"
        f0, f1, d0, d1 = value(k), value(k + 1), f"({h} * {slope(k)})", f"({h} * {slope(k + 1)})"
        cases.append((axis[k], f"({f0} + {t} * ({d0} + {t} * (3 * ({f1} - {f0}) - 2 * {d0} - {d1} + {t} * (2 * ({f0} - {f1}) + {d0} + {d1}))))"))
    return "(CASE " + " ".join(f"WHEN {x} <= {end} THEN {c}" for end, c in cases[:-1]) + f" ELSE {cases[-1][1]} END)"


def _surface_sql() -> str:
    """Splines along x in each row, of values and of slopes in y, then one along y."""
    e = lambda part, k, row: f"embedding[{16 * part + 4 * (row - 1) + k}]::DOUBLE"
    rows = [f"{_spline_sql('x', AXIS[:4], lambda k, r=r: e(0, k, r), lambda k, r=r: e(1, k, r))} AS f{r}, {_spline_sql('x', AXIS[:4], lambda k, r=r: e(2, k, r), lambda k, r=r: e(3, k, r))} AS d{r}" for r in (1, 2, 3, 4)]
    return f"""SELECT vec_id, round({_spline_sql('y', AXIS[2:6], lambda k: f'f{k}', lambda k: f'd{k}')}, 4) AS value FROM (SELECT vec_id, y, {', '.join(rows)} FROM (SELECT *, vec_id * 7 % 31 / 10.0::DOUBLE AS x, vec_id * 11 % 36 / 10.0 + 2.4::DOUBLE AS y FROM embeddings))"""


def _end(order: str) -> str:
    """Derivative at the first of four points of the cubic by divided differences."""
    return f"""SELECT user_id, d1 + (x0 - x1) * d2 + (x0 - x1) * (x0 - x2) * d3 AS slope FROM (SELECT *, (e3 - e2) / (x3 - x1) AS h3, (e2 - d1) / (x2 - x0) AS d2, ((e3 - e2) / (x3 - x1) - (e2 - d1) / (x2 - x0)) / (x3 - x0) AS d3 FROM (
        SELECT *, (f1 - f0) / (x1 - x0) AS d1, (f2 - f1) / (x2 - x1) AS e2, (f3 - f2) / (x3 - x2) AS e3 FROM (SELECT user_id, {', '.join(f'max(value) FILTER (n = {k + 1}) AS f{k}, max(event_id::DOUBLE) FILTER (n = {k + 1}) AS x{k}' for k in range(4))}
        FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id {order}) AS n FROM events) WHERE n <= 4 GROUP BY 1 HAVING count(*) = 4)))"""


_CLOSED = {
    (0, 0): "0", (0, 1): "sqrt(1.5)", (0, 2): "sqrt(2.5) * 3 * x", (0, 3): "sqrt(3.5) * (15 * x * x - 3) / 2", (1, 1): "-sqrt(0.75) * x / c", (1, 2): "sqrt(3.75) * (1 - 2 * x * x) / c",
    (1, 3): "sqrt(21.0 / 32) * (10 * x * c - x * (5 * x * x - 1) / c)", (2, 2): "-sqrt(15.0 / 16) * 2 * x", (2, 3): "sqrt(105.0 / 16) * (1 - 3 * x * x)", (3, 3): "-sqrt(35.0 / 32) * 3 * x * c",
}
_AL = "(ln(cos(radians(30)) / cos(radians(60))) / (ln(cos(radians(30)) / cos(radians(60))) + ln((1 + sin(radians(60))) / (1 + sin(radians(30))))))"
ORACLE_SQL = {
    "point_in_cells": f"SELECT p_partkey, {_in(_C[:3])} AS triangle, {_in(_C[:3])} OR {_in([_C[0], _C[2], _C[3]])} AS quadrilateral FROM part",
    "average_box": f"WITH {_BOX}, {_average('w', 'e', '1, 9', 'i')} SELECT vec_id, round(sum(v * a) / sum(a), 4) AS mean FROM c GROUP BY 1",
    "average_spherical": f"""WITH {_BOX.replace('b AS', 'b0 AS')}, b AS (SELECT vec_id, z, s, n, (w + e) / 2 - (e - w) / 2 / cos(radians((s + n) / 2 * 15 - 67.5)) AS xw, (w + e) / 2 + (e - w) / 2 / cos(radians((s + n) / 2 * 15 - 67.5)) AS xe FROM b0), {_average('xw', 'xe', '-30, 50', '(i + 79) % 8 + 1')}
        SELECT vec_id, round(any_value(xw), 4) AS west, round(sum(v * a) / sum(a), 4) AS mean FROM c JOIN b USING (vec_id) GROUP BY 1""",
    "predicted_fill": """SELECT vec_id, k, round(CASE WHEN k = 3 AND vec_id % 2 = 0 THEN greatest(list_min(embedding[1:4]), least(list_max(embedding[1:4]), embedding[3]::DOUBLE + embedding[2]::DOUBLE - embedding[1]::DOUBLE)) ELSE embedding[k + 1] END::DOUBLE, 4) AS value FROM embeddings, range(0, 4) r(k)""",
    "spline_slopes": f"SELECT vec_id, round({_spline_sql('x', AXIS, lambda k: f'embedding[{k}]::DOUBLE', lambda k: f'embedding[{k + 8}]::DOUBLE')}, 4) AS value FROM (SELECT *, vec_id * 7 % 95 / 10.0 - 0.2::DOUBLE AS x FROM embeddings)",
    "spline_surface": _surface_sql(),
    "end_derivatives": f"SELECT user_id, round(a.slope, 4) AS first, round(b.slope, 4) AS last FROM ({_end('')}) a JOIN ({_end('DESC')}) b USING (user_id)",
    "sum_of_squares": f"WITH {GRID_SQL} SELECT i, j, round(CASE WHEN i BETWEEN 2 AND 6 AND j BETWEEN 3 AND (SELECT max(o_orderkey) FROM orders) - 3 THEN 2 * f * f + 0.5 * v * v END, 4)::DOUBLE AS value FROM grid",
    "truncation_rows": """SELECT p_partkey, CASE WHEN half THEN len(list_filter(range(0, n), lambda k: k % 2 = 0)) ELSE n END::BIGINT AS symmetric, CASE WHEN half THEN len(list_filter(range(0, n), lambda k: k % 2 = 1)) ELSE n END::BIGINT AS antisymmetric FROM (
        SELECT p_partkey, p_partkey % 3 = 0 AS half, CASE WHEN p_partkey % 2 <> 0 THEN p_partkey % 19 + 3 WHEN p_partkey % 23 <= p_partkey % 19 + 2 THEN p_partkey % 19 + 2 - p_partkey % 23 + 1 END AS n FROM part)""",
    "legendre_slopes": "WITH x AS (SELECT a AS spot, (a / 10.0 - 0.4)::DOUBLE AS x, sqrt(1 - (a / 10.0 - 0.4) ** 2) AS c FROM range(0, 9) r(a)) "
    + " UNION ALL ".join(f"SELECT spot, {m}::BIGINT AS m, {n}::BIGINT AS n, round((1 - x * x) * ({f}), 6) + 0 AS slope, {(n - m) % 2}::BIGINT AS part, {(n - m) // 2 + 1}::BIGINT AS place FROM x" for (m, n), f in _CLOSED.items()),
    "gaussian_roots": """WITH r(n, j, x, weight) AS (VALUES (2, 1, -sqrt(1 / 3.0), 1.0::DOUBLE), (2, 2, sqrt(1 / 3.0), 1.0), (3, 1, -sqrt(0.6), 5 / 9.0), (3, 2, 0.0, 8 / 9.0), (3, 3, sqrt(0.6), 5 / 9.0), (4, 1, -sqrt(3 / 7.0 + 2 / 7.0 * sqrt(1.2)), (18 - sqrt(30)) / 36), (4, 2, -sqrt(3 / 7.0 - 2 / 7.0 * sqrt(1.2)), (18 + sqrt(30)) / 36),
        (4, 3, sqrt(3 / 7.0 - 2 / 7.0 * sqrt(1.2)), (18 + sqrt(30)) / 36), (4, 4, sqrt(3 / 7.0 + 2 / 7.0 * sqrt(1.2)), (18 - sqrt(30)) / 36)) SELECT n::BIGINT AS n, j::BIGINT AS j, round(degrees(asin(x)), 6) AS lat, round(weight, 6) AS weight FROM r""",
    "lambert_two_parallels": f"""SELECT s_suppkey, round(r * sin(radians(lon - 270)), 4) AS x, round(-r * cos(radians(lon - 270)), 4) AS y, round(lat, 3) AS lat, round(270 + (lon - 270) / {_AL}, 3) AS lon FROM (SELECT *, 6371100.0 * cos(radians(30)) * pow(1.5 / cos(radians(30)), {_AL}) / {_AL} / 50000 * pow(cos(radians(lat)) / (1 + sin(radians(lat))), {_AL}) AS r
        FROM (SELECT s_suppkey, s_suppkey * 7 % 60 + 15.0::DOUBLE AS lat, s_suppkey * 11 % 90 + 230.0::DOUBLE AS lon FROM supplier))""",
    "hybrid_codes": """SELECT p_partkey, g1, g2, CASE WHEN p_partkey % 5 <> 0 THEN round(g2 / 1000.0, 4) END AS power, CASE WHEN p_partkey % 5 <> 0 THEN g1::DOUBLE END AS reference FROM (SELECT p_partkey, CASE WHEN good THEN p_partkey * 7 % 800 + 350 END AS g1, CASE WHEN good THEN trunc((p_partkey % 130 / 100.0::DOUBLE + 0.9::DOUBLE) * 1000)::BIGINT END AS g2
        FROM (SELECT *, p_partkey * 7 % 800 BETWEEN 50 AND 699 AND p_partkey % 130 / 100.0::DOUBLE + 0.9::DOUBLE BETWEEN 1 AND 2 AS good FROM part))""",
    "pressure_by_kind": """WITH k AS (SELECT p_partkey, [1, 2, 5, 4][p_partkey % 4 + 1] AS kind, p_partkey % 3 AS q, p_partkey % 7 = 0 AS lid, p_size * 20.0::DOUBLE AS mb, p_size / 50.0::DOUBLE AS l, 900 + p_size * 2.0::DOUBLE AS ps FROM part),
        h AS (SELECT *, CASE WHEN kind = 1 THEN l + (1 - l) * 10 / 800.0 ELSE l END AS r FROM k), b AS (SELECT *, pow(greatest((r - 0.0125) / 0.9875, 0), 1.6) AS b FROM h)
        SELECT p_partkey, round(CASE WHEN kind = 2 THEN mb * 100 WHEN kind = 5 AND q = 2 THEN 800 * (r - b) + b * ps WHEN kind = 1 THEN CASE q WHEN 0 THEN l * ps WHEN 2 THEN 800 * (r - b) + b * ps ELSE CASE WHEN lid THEN 10 * (1 - (l - 0.05) / 0.95) + (l - 0.05) / 0.95 * ps ELSE 10 * (1 - l) + l * ps END END END, 4) AS pressure FROM b""",
    "packed_floats": """WITH m AS (SELECT vec_id, k, embedding[k + 1]::DOUBLE AS v, floor(log2(list_max(list_transform(embedding, lambda x: abs(x))))) AS e FROM embeddings, range(0, 64) r(k)), i AS (SELECT *, trunc(v * pow(2.0, 23 - e))::BIGINT AS m FROM m),
        s AS (SELECT *, min(m) OVER (PARTITION BY vec_id) AS lo, max(m) OVER (PARTITION BY vec_id) AS hi FROM i), h AS (SELECT *, greatest(0, floor(log2(hi - lo))::INTEGER + 1 - 12) AS sh FROM s),
        q AS (SELECT *, least(4095, (m - lo + ((1 << sh) >> 1)) >> sh) AS t FROM h) SELECT vec_id, 136::BIGINT AS n_bytes, round(sum(sign((t << sh) + lo) * least(abs((t << sh) + lo), 16777215) * pow(2.0, e - 23) * (k + 1)), 5) AS total FROM q GROUP BY 1""",
}
_KNN3 = """WITH s AS (SELECT s_suppkey, ((s_suppkey * 37) % 140 - 70)::DOUBLE AS lat, (s_suppkey * 91) % 359 + 0.5::DOUBLE AS lon FROM supplier WHERE s_suppkey % 3 <> 0), c AS (SELECT c_custkey, ((c_custkey * 13) % 150 - 75)::DOUBLE AS lat, (c_custkey * 29) % 359 + 0.25::DOUBLE AS lon FROM customer),
    e AS (SELECT min(lat) AS lat0, max(lat) AS lat1, min(lon) AS lon0, max(lon) AS lon1 FROM s),
    p AS (SELECT c_custkey, s_suppkey, abs(s.lat - c.lat) AS dy, least(abs(s.lon - c.lon), 360 - abs(s.lon - c.lon)) AS dx FROM c JOIN s ON abs(s.lat - c.lat) < 10 JOIN e ON c.lat BETWEEN lat0 AND lat1 AND c.lon BETWEEN lon0 AND lon1),
    k AS (SELECT *, dx * dx + dy * dy AS d2, row_number() OVER (PARTITION BY c_custkey ORDER BY dx * dx + dy * dy, s_suppkey) AS place FROM p WHERE dx < 10)"""
ORACLE_SQL["neighbours_masked"] = f"{_KNN3} SELECT c_custkey, count(*) AS n, max(s_suppkey) AS greatest, round(sum(d2 / greatest(d2, 1e-10)) / sum(1 / greatest(d2, 1e-10)), 4) AS d2 FROM k WHERE place <= 3 GROUP BY 1"


def _cloud_sql() -> str:
    """Cells by the signs of cross products; the map's matrix by its adjugate (Heckbert, 1989)."""
    n = lambda c, i, j: f"g.{c}[({j} - 1) * 8 + {i}]"
    corners = ", ".join(f"{n(c, f'(w + {a})', f'(s + {b})')} AS {c}{k}" for k, (a, b) in enumerate(((0, 0), (1, 0), (1, 1), (0, 1))) for c in "xy")
    side = lambda a, b: f"((x{b} - x{a}) * (py - y{a}) - (y{b} - y{a}) * (px - x{a}))"
    tri = lambda *t: "(" + " OR ".join("(" + " AND ".join(f"{side(t[k], t[(k + 1) % 3])} {sign} 0" for k in range(3)) + ")" for sign in (">=", "<=")) + ")"
    return f"""WITH g AS (SELECT list_transform(range(0, 64), lambda k: (k % 8 + 1 + k * 5 % 7 / 20.0 + k // 8 / 10.0)::DOUBLE) AS x, list_transform(range(0, 64), lambda k: (k // 8 + 1 + k * 3 % 5 / 16.0 - k % 8 / 25.0)::DOUBLE) AS y),
    p AS (SELECT vec_id, (vec_id * 7 % 89 / 10.0 + 0.513)::DOUBLE AS px, (vec_id * 11 % 83 / 10.0 + 0.517)::DOUBLE AS py FROM embeddings),
    c AS (SELECT p.*, o, greatest(2, least(7, round(px)))::BIGINT - 1 + o % 2 AS w, greatest(2, least(7, round(py)))::BIGINT - 1 + o // 2 AS s FROM p, range(0, 4) r(o)), q AS (SELECT c.*, {corners} FROM c, g),
    f AS (SELECT vec_id, arg_min(q, o) AS t FROM q WHERE {tri(0, 1, 2)} OR {tri(0, 2, 3)} GROUP BY 1), t AS (SELECT unnest(t) FROM f),
    k AS (SELECT *, (x1 - x2) * (y3 - y2) - (x3 - x2) * (y1 - y2) AS det, x0 - x1 + x2 - x3 AS sx, y0 - y1 + y2 - y3 AS sy FROM t), gh AS (SELECT *, (sx * (y3 - y2) - sy * (x3 - x2)) / det AS g, ((x1 - x2) * sy - sx * (y1 - y2)) / det AS h FROM k),
    m AS (SELECT *, x1 - x0 + g * x1 AS a, x3 - x0 + h * x3 AS b, y1 - y0 + g * y1 AS d, y3 - y0 + h * y3 AS e FROM gh), z AS (SELECT vec_id, w, s, (d * h - e * g) * px + (b * g - a * h) * py + a * e - b * d AS z,
    (e - y0 * h) * px + (x0 * h - b) * py + b * y0 - x0 * e AS u, (y0 * g - d) * px + (a - x0 * g) * py + x0 * d - a * y0 AS v FROM m)
    SELECT vec_id, w IS NOT NULL AS inside, round(w + abs(u / z), 4) AS x, round(s + abs(v / z), 4) AS y FROM embeddings LEFT JOIN z USING (vec_id)"""


ORACLE_SQL["point_in_cloud"] = _cloud_sql()
