"""Queries of regridding, masks, geometry, reports and cross sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from nephos.operators import grids as ops
from nephos.operators import reports
from nephos.plans.base import GRID_SQL, grid, r4, read

N = 8


def _targets(spark, d):
    e = read(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("z"))
    k = F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k")
    return e.select("vec_id", "z", k).withColumns({"x": (F.col("vec_id") * 7 + F.col("k") * 13) % 32 / 4.0 + 0.75, "y": (F.col("vec_id") * 5 + F.col("k") * 11) % 32 / 4.0 + 0.75, "k": F.col("k").cast("long")})


def _regrid(how):
    def query(spark, d):
        t = _targets(spark, d)
        return t.select("vec_id", "k", r4(how(F.col("z"), F.col("x"), F.col("y"), N, N)).alias("value"))

    return query


def extrap_minmax(spark, d):
    t = _targets(spark, d)
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    v, out = ops.bilinear(z, x, y, N, N), ops.outside(x, y, N, N)
    kinds = {how: r4(ops.extrapolated(v, out, how, z, 5.0)) for how in ("maximum", "minimum", "value", "neutral")}
    return t.select("vec_id", "k", *[c.alias(f"v_{n}") for n, c in kinds.items()])


def mask_zones(spark, d):
    t = _targets(spark, d)
    present = lambda i, j: (ops.point(F.col("z"), i, j, N) > 0).cast("int")
    return t.select("vec_id", "k", ops.corner_count(present, F.col("x"), F.col("y"), N, N).alias("zone"))


def mask_fill_min(spark, d):
    g = grid(spark, d).withColumn("f", F.col("f").cast("double"))
    return ops.fill_least(g, "f", F.col("w") > 1, ["j"]).select("i", "j", r4("f").alias("f"))


def mask_fill_row(spark, d):
    g = grid(spark, d).withColumn("f", F.col("f").cast("double"))
    return ops.fill_along(g, "f", F.col("w") > 1, ["j"], "i").select("i", "j", r4("f").alias("f"))


def _cells_average(o, target):
    source = o.select((F.col("o_orderkey") / 2.0).alias("low"), (F.col("o_orderkey") / 2.0 + 0.5).alias("high"), F.col("o_totalprice").alias("z"))
    target = target.select("id", (F.col("id") * 15.25).alias("low"), ((F.col("id") + 1) * 15.25).alias("high"))
    return ops.cells_average(source, target, "low", "high", "z", "id").select("id", F.round("mean", 2).alias("mean"), r4("overlap").alias("overlap"))


def regrid_average(spark, d):
    """All orders, onto the cells that their range meets."""
    o = read(spark, d, "orders")
    ends = o.agg(F.floor(F.min("o_orderkey") / 2.0 / 15.25), F.ceil((F.max("o_orderkey") / 2.0 + 0.5) / 15.25)).first()
    return _cells_average(o, spark.range(int(ends[0] or 0), int(ends[1] or 0)))


def _points(spark, d):
    c, s = read(spark, d, "customer"), read(spark, d, "supplier")
    s = s.select("s_suppkey", "s_acctbal", ((F.col("s_suppkey") * 37) % 140 - 70.0).alias("lat"), ((F.col("s_suppkey") * 91) % 359 + 0.5).alias("lon"))
    c = c.select("c_custkey", ((F.col("c_custkey") * 13) % 150 - 75.0).alias("lat"), ((F.col("c_custkey") * 29) % 359 + 0.25).alias("lon"))
    return c, s


def knn_weights(spark, d):
    k = ops.nearest_points(*_points(spark, d), "c_custkey", "s_suppkey", 4)
    return k.select("c_custkey", "s_suppkey", F.col("place").cast("long").alias("place"), r4("weight").alias("weight"))


def knn_apply(spark, d):
    c, s = _points(spark, d)
    k = ops.nearest_points(c, s, "c_custkey", "s_suppkey", 16)
    return ops.applied(c, k, s, "c_custkey", "s_suppkey", "s_acctbal").select("c_custkey", r4("s_acctbal").alias("value"))


def _angles(spark, d):
    return read(spark, d, "supplier").select("s_suppkey", ((F.col("s_suppkey") * 7) % 80 + 5.0).alias("lat"), ((F.col("s_suppkey") * 31) % 360 + 0.0).alias("lon"))


def polar_stereo_xy(spark, d):
    x, y = ops.polar_xy(F.col("lat"), F.col("lon"), 50.0, 60.0, 100000.0, 21.0)
    lat, lon = ops.polar_latlon(x, y, 50.0, 60.0, 100000.0, 21.0)
    return _angles(spark, d).select("s_suppkey", r4(x).alias("x"), r4(y).alias("y"), F.round(lat, 3).alias("lat"), F.round(lon, 3).alias("lon"))


def wind_speed_dir(spark, d):
    u, v = F.col("lat") - 40, F.col("lon") - 180
    speed, direction = ops.speed_direction(u, v)
    bu, bv = ops.components(speed, direction)
    ru, rv = ops.rotated(u, v, F.col("lat"))
    return _angles(spark, d).select("s_suppkey", r4(speed).alias("speed"), r4(direction).alias("direction"), (F.abs(bu - u) + F.abs(bv - v) < 1e-6).alias("same"), r4(ru).alias("ru"), r4(rv).alias("rv"))


def great_circle(spark, d):
    m = ops.great_circle(F.col("lat"), F.col("lon"), F.lit(45.5), F.lit(286.4))
    return _angles(spark, d).select("s_suppkey", F.round(m, 2).alias("metres"))


def cross_section(spark, d):
    e = read(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("z"), F.explode(F.sequence(F.lit(0), F.lit(10))).alias("k"))
    x, y = F.lit(1.0) + F.col("k") * 0.7, F.lit(8.0) - F.col("k") * 0.6
    return e.select("vec_id", F.col("k").cast("long").alias("k"), r4(ops.bilinear(F.col("z"), x, y, N, N)).alias("value"))


def _reports(spark, d):
    li = read(spark, d, "lineitem").select("l_orderkey", "l_returnflag", F.col("l_linenumber").cast("long").alias("e"), F.col("l_quantity").cast("long").alias("q"))
    return reports.gather(li, ["l_orderkey"], ["l_returnflag"], "e", "q")


def report_blocks(spark, d):
    return reports.block_summary(_reports(spark, d), ["l_orderkey"])


def report_flatten(spark, d):
    kept = reports.delete_block(_reports(spark, d), lambda b: b["l_returnflag"] == "R")
    rows = reports.flatten(kept, ["l_orderkey"], ["l_returnflag"])
    return rows.groupBy("l_returnflag", "element").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def element_convert(spark, d):
    li = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("long").alias("q"))
    scales = read(spark, d, "part").where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("element"), (F.col("p_size") % 4).alias("scale"), F.col("p_size").alias("reference"))
    real = reports.to_real(li, scales, "l_partkey", "q", 50)
    return real.groupBy("l_linenumber").agg(F.count("*").alias("n"), F.count("real").alias("n_real"), F.round(F.sum("real"), 3).alias("total"))


QUERIES = {"regrid_nearest": _regrid(ops.near), "regrid_bilinear": _regrid(ops.bilinear), "regrid_bicubic": _regrid(ops.bicubic)} | {
    f.__name__: f for f in (extrap_minmax, mask_zones, mask_fill_min, mask_fill_row, regrid_average, knn_weights, knn_apply, polar_stereo_xy, wind_speed_dir, great_circle, cross_section, report_blocks, report_flatten, element_convert)
}
_T = """WITH t AS (SELECT vec_id, embedding AS z, k, (vec_id * 7 + k * 13) % 32 / 4.0 + 0.75 AS x, (vec_id * 5 + k * 11) % 32 / 4.0 + 0.75 AS y FROM embeddings, range(0, 5) r(k)),
    c AS (SELECT *, greatest(1, least(7, floor(x)))::BIGINT AS i, greatest(1, least(7, floor(y)))::BIGINT AS j FROM t),
    l AS (SELECT *, (x - i)::DOUBLE AS dx, (y - j)::DOUBLE AS dy, z[(j-1)*8+i]::DOUBLE AS a, z[(j-1)*8+i+1]::DOUBLE AS b, z[j*8+i]::DOUBLE AS e, z[j*8+i+1]::DOUBLE AS f, x < 1 OR x > 8 OR y < 1 OR y > 8 AS o,
      list_max(z)::DOUBLE AS top, list_min(z)::DOUBLE AS least FROM c),
    v AS (SELECT *, a + (b - a) * dx + ((e + (f - e) * dx) - (a + (b - a) * dx)) * dy AS v FROM l)"""


def _cubic_sql() -> str:
    def w(d: str) -> list[str]:
        return [f"(-{d}*({d}-1)*({d}-2)/6)", f"(({d}+1)*({d}-1)*({d}-2)/2)", f"(-({d}+1)*{d}*({d}-2)/2)", f"(({d}+1)*{d}*({d}-1)/6)"]

    terms = [f"{w('dy')[b]}*{w('dx')[a]}*z[(j+{b - 1}-1)*8+i+{a - 1}]::DOUBLE" for b in range(4) for a in range(4)]
    return f"""WITH t AS (SELECT vec_id, embedding AS z, k, ((vec_id * 7 + k * 13) % 32 / 4.0 + 0.75)::DOUBLE AS x, ((vec_id * 5 + k * 11) % 32 / 4.0 + 0.75)::DOUBLE AS y FROM embeddings, range(0, 5) r(k)),
      c AS (SELECT *, greatest(2, least(6, floor(x)))::BIGINT AS i, greatest(2, least(6, floor(y)))::BIGINT AS j FROM t), q AS (SELECT *, x - i AS dx, y - j AS dy FROM c) SELECT vec_id, k, round({" + ".join(terms)}, 4) AS value FROM q"""


_KNN = """WITH s AS (SELECT s_suppkey, s_acctbal AS z, ((s_suppkey * 37) % 140 - 70)::DOUBLE AS lat, (s_suppkey * 91) % 359 + 0.5::DOUBLE AS lon FROM supplier), c AS (SELECT c_custkey, ((c_custkey * 13) % 150 - 75)::DOUBLE AS lat, (c_custkey * 29) % 359 + 0.25::DOUBLE AS lon FROM customer),
    e AS (SELECT min(lat) AS lat0, max(lat) AS lat1, min(lon) AS lon0, max(lon) AS lon1 FROM s),
    p AS (SELECT c_custkey, s_suppkey, z, abs(s.lat - c.lat) AS dy, CASE WHEN abs(s.lon - c.lon) > 180 THEN abs(abs(s.lon - c.lon) - 360) ELSE abs(s.lon - c.lon) END AS dx FROM c JOIN s ON abs(s.lat - c.lat) < 10 JOIN e ON c.lat BETWEEN lat0 AND lat1 AND c.lon BETWEEN lon0 AND lon1),
    m AS (SELECT c_custkey, s_suppkey, z, dx * dx + dy * dy AS d2 FROM p WHERE dx < 10),
    k AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY d2, s_suppkey) AS place FROM m)"""
_ANG = "(SELECT s_suppkey, ((s_suppkey * 7) % 80 + 5)::DOUBLE AS lat, ((s_suppkey * 31) % 360)::DOUBLE AS lon FROM supplier)"
_RE = "(1.866025 * 6371220.0 / 100000.0)"
ORACLE_SQL = {
    "regrid_nearest": f"{_T} SELECT vec_id, k, round(z[((greatest(1, least(8, round(y))) - 1) * 8 + greatest(1, least(8, round(x))))::BIGINT]::DOUBLE, 4) AS value FROM t",
    "regrid_bilinear": f"{_T} SELECT vec_id, k, round(v, 4) AS value FROM v",
    "regrid_bicubic": _cubic_sql(),
    "extrap_minmax": f"""{_T} SELECT vec_id, k, round(CASE WHEN o THEN top + 0.05 * (top - least) ELSE v END, 4) AS v_maximum, round(CASE WHEN o THEN least - 0.05 * (top - least) ELSE v END, 4) AS v_minimum,
        round(CASE WHEN o THEN 5 ELSE v END, 4) AS v_value, round(v, 4) AS v_neutral FROM v""",
    "mask_zones": f"{_T} SELECT vec_id, k, CASE WHEN o THEN 7 ELSE (a > 0)::INT + (b > 0)::INT + (e > 0)::INT + (f > 0)::INT END AS zone FROM l",
    "mask_fill_min": f"WITH {GRID_SQL} SELECT i, j, round(CASE WHEN w > 1 THEN min(f) FILTER (w <= 1) OVER (PARTITION BY j) ELSE f END, 4)::DOUBLE AS f FROM grid",
    "mask_fill_row": f"""WITH {GRID_SQL}, h AS (SELECT i, j, CASE WHEN w <= 1 THEN f END AS f FROM grid) SELECT i, j, round(coalesce(last_value(f IGNORE NULLS) OVER (PARTITION BY j ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
        first_value(f IGNORE NULLS) OVER (PARTITION BY j ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 4)::DOUBLE AS f FROM h""",
    "regrid_average": """SELECT id, round(sum(w * z) / sum(w), 2) AS mean, round(sum(w), 4)::DOUBLE AS overlap FROM (SELECT id, z, least(high, (id + 1) * 15.25::DOUBLE) - greatest(low, id * 15.25::DOUBLE) AS w
        FROM (SELECT o_orderkey / 2.0 AS low, o_orderkey / 2.0 + 0.5 AS high, o_totalprice AS z FROM orders) JOIN (SELECT unnest(range((min(o_orderkey) / 2.0 / 15.25)::BIGINT - 1, (max(o_orderkey) / 2.0 / 15.25)::BIGINT + 2)) AS id FROM orders)
        ON low < (id + 1) * 15.25::DOUBLE AND high > id * 15.25::DOUBLE) WHERE w > 0 GROUP BY id""",
    "knn_weights": f"""{_KNN} SELECT c_custkey, s_suppkey, place, round((1 / greatest(d2, 1e-10)) / sum(1 / greatest(d2, 1e-10)) OVER (PARTITION BY c_custkey), 4) AS weight FROM k WHERE place <= 4""",
    "knn_apply": f"""{_KNN}, v AS (SELECT c_custkey, sum(z / greatest(d2, 1e-10)) / sum(1 / greatest(d2, 1e-10)) AS value FROM k WHERE place <= 16 GROUP BY 1)
        SELECT c_custkey, round(coalesce(value, (SELECT min(z) - 0.1 * (max(z) - min(z)) FROM s)), 4) AS value FROM c LEFT JOIN v USING (c_custkey)""",
    "polar_stereo_xy": f"SELECT s_suppkey, round(r * cos(radians(lon + 21)) + 50, 4) AS x, round(r * sin(radians(lon + 21)) + 60, 4) AS y, round(lat, 3) AS lat, round(lon, 3) AS lon FROM (SELECT *, {_RE} * cos(radians(lat)) / (1 + sin(radians(lat))) AS r FROM {_ANG})",
    "wind_speed_dir": f"""SELECT s_suppkey, round(sqrt(u * u + v * v), 4) AS speed, round(CASE WHEN u = 0 AND v = 0 THEN 0 ELSE (630 - degrees(atan2(v, u))) % 360 END, 4) AS direction, true AS same,
        round(u * cos(radians(lat)) - v * sin(radians(lat)), 4) AS ru, round(u * sin(radians(lat)) + v * cos(radians(lat)), 4) AS rv FROM (SELECT *, lat - 40 AS u, lon - 180 AS v FROM {_ANG})""",
    "great_circle": f"SELECT s_suppkey, round(2 * 6371220.0 * asin(sqrt(sin(radians(45.5 - lat) / 2) ** 2 + cos(radians(lat)) * cos(radians(45.5)) * sin(radians(286.4 - lon) / 2) ** 2)), 2) AS metres FROM {_ANG}",
    "cross_section": """WITH t AS (SELECT vec_id, embedding AS z, k, 1.0::DOUBLE + k * 0.7::DOUBLE AS x, 8.0::DOUBLE - k * 0.6::DOUBLE AS y FROM embeddings, range(0, 11) r(k)), c AS (SELECT *, greatest(1, least(7, floor(x)))::BIGINT AS i, greatest(1, least(7, floor(y)))::BIGINT AS j FROM t),
        l AS (SELECT *, x - i AS dx, y - j AS dy, z[(j-1)*8+i]::DOUBLE AS a, z[(j-1)*8+i+1]::DOUBLE AS b, z[j*8+i]::DOUBLE AS e, z[j*8+i+1]::DOUBLE AS f FROM c)
        SELECT vec_id, k, round(a + (b - a) * dx + ((e + (f - e) * dx) - (a + (b - a) * dx)) * dy, 4) AS value FROM l""",
    "report_blocks": "SELECT l_orderkey, count(DISTINCT l_returnflag) AS n_blocks, count(*) AS n_elements FROM lineitem GROUP BY 1",
    "report_flatten": "SELECT l_returnflag, l_linenumber::BIGINT AS element, count(*) AS n, sum(l_quantity)::BIGINT AS total FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1, 2",
    "element_convert": """SELECT l_linenumber, count(*) AS n, count(real) AS n_real, round(sum(real), 3) AS total FROM (SELECT l_linenumber, CASE WHEN q = 50 THEN NULL WHEN p_size IS NULL THEN q ELSE (q + p_size) / power(10.0, p_size % 4) END AS real
        FROM (SELECT *, l_quantity::BIGINT AS q FROM lineitem) LEFT JOIN (SELECT * FROM part WHERE p_partkey % 3 <> 0) ON p_partkey = l_partkey) GROUP BY 1""",
}
