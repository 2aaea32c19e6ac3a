"""Queries of geometry, names, series and streams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from nephos.functions import names, sphere
from nephos.operators import series
from nephos.operators import vertical as levels
from nephos.plans.base import GRID_SQL, grid, r4, read
from nephos.plans.files import shared_folder
from nephos.streaming import channel


#: Places between the points 1, 4, 9, 16, 25 and 36 at which splines are taken.
SPLINE_AT = (1.5, 2.75, 6.0, 11.0, 15.5, 20.25, 24.0, 30.0, 35.5)


def _places(spark, d):
    return read(spark, d, "supplier").select("s_suppkey", ((F.col("s_suppkey") * 7) % 80 + 5.0).alias("lat"), ((F.col("s_suppkey") * 31) % 360 + 0.0).alias("lon"))


def sphere_distance_area(spark, d):
    lat, lon = F.col("lat"), F.col("lon")
    side = sphere.distance(lat, lon, F.lit(10.0), F.lit(20.0))
    return _places(spark, d).select("s_suppkey", F.round(side, 0).alias("metres"), F.round(sphere.box_area(lat, lat + 1, lon, lon + 2) / 1e6, 2).alias("km2"))


def rotated_frame(spark, d):
    m = sphere.rotation(40.0, 250.0, 10.0, 340.0)
    lat, lon = sphere.turned(F.col("lat"), F.col("lon"), m)
    back_lat, back_lon = sphere.turned(F.col("rlat"), F.col("rlon"), m.T)
    p = _places(spark, d).withColumns({"rlat": lat, "rlon": lon})
    return p.select("s_suppkey", F.round("rlat", 4).alias("rlat"), (F.round("rlon", 4) % 360).alias("rlon"), r4(back_lat).alias("lat"), (F.round(back_lon, 4) % 360).alias("lon"))


def latlon_gaussian_index(spark, d):
    x, y = sphere.latlon_index(F.col("lat"), F.col("lon"), -90.0, 10.0, 1.5, 2.5)
    g = sphere.axis_position([0.0, 10.0, 25.0, 60.0, 90.0], F.col("lat"))
    return _places(spark, d).select("s_suppkey", r4(x).alias("x"), r4(y).alias("y"), r4(g).alias("g"))


def lambert(spark, d):
    x, y = sphere.lambert_xy(F.col("lat"), F.col("lon"), 50.0, 50.0, 45.0, 270.0)
    return _places(spark, d).select("s_suppkey", F.round(x, 1).alias("x"), F.round(y, 1).alias("y"))


def pressure_levels(spark, d):
    p = read(spark, d, "part").select("p_partkey", (F.col("p_size") / 50.0).alias("l"), (900 + F.col("p_size") * 2.0).alias("ps"))
    ln, ps = F.col("l"), F.col("ps")
    return p.select("p_partkey", r4(sphere.hybrid_pressure(ln, 10.0, 800.0, 1.6, ps)).alias("hybrid"), r4(sphere.eta_pressure(ln, 10.0, ps)).alias("eta"), r4(sphere.sigma_pressure(ln, ps)).alias("sigma"))


def map_scale_coriolis(spark, d):
    r2 = F.col("p_size") * 37.0
    return read(spark, d, "part").select("p_partkey", F.round(sphere.map_scale(r2, 100000.0), 6).alias("scale"), F.round(sphere.coriolis(r2, 100000.0) * 1e4, 6).alias("coriolis"))


def base40_names(spark, d):
    code = names.to_base40(F.substring("n_name", 1, 8))
    return read(spark, d, "nation").select("n_nationkey", code.alias("code"), names.from_base40(code).alias("name"))


def element_codes(spark, d):
    dec = (F.col("p_partkey") % 4) * 100_000 + (F.col("p_partkey") % 64) * 1000 + F.col("p_partkey") % 256
    code = names.element_code(dec)
    a, b, c = names.block_parts(names.block_type(F.col("p_partkey") % 16, F.col("p_partkey") % 128, F.col("p_partkey") % 13))
    return read(spark, d, "part").select("p_partkey", code.alias("code"), names.element_decimal(code).alias("back"), a.cast("long").alias("nature"), b.cast("long").alias("kind"), c.cast("long").alias("step"))


def file_names(spark, d):
    name = names.file_name(F.lit("pp"), F.col("o_orderdate"), (F.col("o_orderkey") % 100).cast("int"))
    return read(spark, d, "orders").select("o_orderkey", name.alias("name"))


def edge_derivative(spark, d):
    s = series.first_derivative(read(spark, d, "events"), "value", "event_id", ["user_id"], 2.0)
    return s.select("user_id", F.round("derivative", 6).alias("derivative"))


def coarse_reversed(spark, d):
    g = series.reversed_rows(grid(spark, d), "i", 7)
    rows = read(spark, d, "orders").agg(F.max("o_orderkey")).first()[0] or 0
    return series.coarse(g, "i", "j", 7, rows, 3).select("i", "j", r4("f").alias("f"))


def _thousandths(array):
    """Whole thousandths of an array's values, multiplied in the values' own type as SQL does: a whole number would make floats doubles."""
    return F.transform(array, lambda x: F.floor(x * F.lit(1000.0).cast("float")).cast("long"))


def coarse_refined(spark, d):
    z = _thousandths("embedding")
    e = read(spark, d, "embeddings").select("vec_id", F.posexplode(series.refined(z, 8, 8)).alias("k", "value"))
    return e.select("vec_id", F.col("k").cast("long").alias("k"), "value")


def lorenzo_residual(spark, d):
    e = read(spark, d, "embeddings").select("vec_id", _thousandths("embedding").alias("z")).withColumn("res", series.residuals(F.col("z"), 8))
    back = e.withColumn("back", series.restored(F.col("res"), 8))
    return back.select("vec_id", F.aggregate("res", F.lit(0).cast("long"), lambda a, x: a + F.abs(x)).alias("size"), (F.col("back") == F.col("z")).alias("same"))


def fourier(spark, d):
    f = series.fourier(F.col("embedding"))
    e = read(spark, d, "embeddings").select("vec_id", f.alias("f"))
    parts = e.select("vec_id", F.posexplode(F.arrays_zip("f.re", "f.im")).alias("n", "c"))
    return parts.select("vec_id", F.col("n").cast("long").alias("n"), r4("c.re").alias("re"), r4("c.im").alias("im"))


def fourier_back(spark, d):
    """The transform, every other coefficient left out, turned back."""
    f = series.fourier(F.col("embedding"))
    half = lambda c: F.transform(c, lambda x, n: F.when(n % 2 == 0, x).otherwise(0.0))
    e = read(spark, d, "embeddings").select("vec_id", f.alias("f"))
    back = e.select("vec_id", F.posexplode(series.inverse_fourier(half(F.col("f.re")), half(F.col("f.im")), 64)).alias("k", "value"))
    return back.select("vec_id", F.col("k").cast("long").alias("k"), r4("value").alias("value"))


def matrix_product(spark, d):
    """All rows against all: the result is the square of the table."""
    e = read(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("k", "x"))
    a = e.select(F.col("vec_id").alias("i"), "k", F.col("x").cast("double").alias("v"))
    b = e.select(F.col("vec_id").alias("j"), "k", F.col("x").cast("double").alias("v"))
    return series.product(a, b).select("i", "j", r4("v").alias("v"))


def spline(spark, d):
    e = read(spark, d, "events").withColumn("lev", F.unix_seconds(F.col("ts").cast("timestamp")) / 86400.0)
    e = e.withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).where("n <= 6").withColumn("lev", F.col("n") * F.col("n") * 1.0)
    c = levels.columns_of(e, "user_id", "lev", "value").where(F.size("lev") == 6)
    at = F.array(*[F.lit(x) for x in SPLINE_AT])
    s = series.spline(c.withColumn("_x", at), F.col("_x"), "user_id")
    return s.select("user_id", F.posexplode("spline").alias("k", "value")).select("user_id", F.col("k").cast("long").alias("k"), r4("value").alias("value"))


def stream_zonal_means(spark, d):
    """Written through a stream that is drained, then read back with the windows that are still open."""
    top = shared_folder(spark, "stream")
    events = read(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    channel.send(events, f"{top}/in")
    sent = spark.read.parquet(f"{top}/in")
    asked = ("at", "value", F.col("event_type"), "1 day", "2 days")
    channel.drain(channel.zonal_means(channel.open_channel(spark, f"{top}/in", sent.schema), *asked), f"{top}/out", f"{top}/state")
    closed = spark.read.schema("start timestamp, zone string, n long, mean double").parquet(f"{top}/out")
    out = closed.union(channel.open_windows(sent, *asked))
    return out.select(F.unix_seconds("start").alias("start"), "zone", "n", F.round("mean", 6).alias("mean"))


def stream_channel(spark, d):
    """Typed elements sent in two goes over one channel and read once each, the whole numbers among them."""
    top = shared_folder(spark, "channel")
    n = F.col("event_id")
    kind = F.element_at(F.array(F.lit("C"), F.lit("I"), F.lit("R"), F.lit("D")), (n % 4 + 1).cast("int"))
    elements = read(spark, d, "events").select("event_id", kind.alias("kind"), F.when(kind == "C", F.col("event_type")).when(kind == "I", n.cast("string")).otherwise(F.col("value").cast("string")).alias("value"))
    for part in (0, 1):
        channel.send(elements.where(n % 2 == part), f"{top}/in")
        stream = channel.open_channel(spark, f"{top}/in", elements.schema)
        channel.drain(channel.of_type(stream, "I"), f"{top}/out", f"{top}/state")
    return spark.read.schema("event_id long, kind string, value int").parquet(f"{top}/out")


QUERIES = {
    f.__name__: f
    for f in (sphere_distance_area, rotated_frame, latlon_gaussian_index, lambert, pressure_levels, map_scale_coriolis, base40_names, element_codes, file_names, edge_derivative, coarse_reversed, coarse_refined, lorenzo_residual, fourier, fourier_back, matrix_product, spline, stream_zonal_means, stream_channel)
}
_P = "(SELECT s_suppkey, ((s_suppkey * 7) % 80 + 5)::DOUBLE AS lat, ((s_suppkey * 31) % 360)::DOUBLE AS lon FROM supplier)"
_CHARS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ/?: "
_E = "(SELECT vec_id, k, embedding[k+1]::DOUBLE AS v FROM embeddings, range(0, 64) r(k))"


def _spline_sql() -> str:
    """Bends at the inner points by the inverse of the tridiagonal matrix of the points 1, 4, 9, 16, 25 and 36."""
    at = [n * n for n in range(1, 7)]
    h = np.diff(at)
    m = np.diag(2.0 * (h[:-1] + h[1:])) + np.diag(h[1:-1], 1) + np.diag(h[1:-1], -1)
    inverse = np.linalg.inv(m)
    slopes = [f"6 * ((y{k + 1} - y{k}) / {h[k]}.0 - (y{k} - y{k - 1}) / {h[k - 1]}.0)" for k in range(1, 5)]
    bends = ["0.0", *["(" + " + ".join(f"{inverse[r, c]!r} * ({slopes[c]})" for c in range(4)) + ")" for r in range(4)], "0.0"]
    rows = []
    for i, x in enumerate(SPLINE_AT):
        k = max(q for q in range(5) if at[q] <= x)
        a, b = (at[k + 1] - x) / h[k], (x - at[k]) / h[k]
        bend = f"({(a**3 - a) * h[k] ** 2 / 6!r} * {bends[k]} + {(b**3 - b) * h[k] ** 2 / 6!r} * {bends[k + 1]})"
        rows.append(f"SELECT user_id, {i}::BIGINT AS k, round({a!r} * y{k} + {b!r} * y{k + 1} + {bend}, 4) AS value FROM w".replace("np.float64", ""))
    points = ", ".join(f"max(value) FILTER (n = {k + 1})::DOUBLE AS y{k}" for k in range(6))
    return f"""WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), w AS (SELECT user_id, {points} FROM r WHERE n <= 6 GROUP BY 1 HAVING count(*) = 6)
        {" UNION ALL ".join(rows)}"""


_RE2 = "((1.866025 * 6.371e6 / 100000.0) ** 2)"
ORACLE_SQL = {
    "sphere_distance_area": f"""SELECT s_suppkey, round(6370997.0 * acos(greatest(-1, least(1, sin(radians(lat)) * sin(radians(10)) + cos(radians(lat)) * cos(radians(10)) * cos(radians(20 - lon))))), 0) AS metres,
        round(6370997.0 * 6370997.0 * radians(2) * (sin(radians(lat + 1)) - sin(radians(lat))) / 1e6, 2) AS km2 FROM {_P}""",
    # Angles of the frame by spherical trigonometry: c and b are the points' distances, turned from the second to the place.
    "rotated_frame": f"""WITH u AS (SELECT s_suppkey, lat, lon, cos(radians(lat)) * cos(radians(lon)) AS x, cos(radians(lat)) * sin(radians(lon)) AS y, sin(radians(lat)) AS z FROM {_P}),
        p AS (SELECT cos(radians(40)) * cos(radians(250)) AS a1, cos(radians(40)) * sin(radians(250)) AS a2, sin(radians(40)) AS a3, cos(radians(10)) * cos(radians(340)) AS b1, cos(radians(10)) * sin(radians(340)) AS b2, sin(radians(10)) AS b3),
        q AS (SELECT *, a1 * b1 + a2 * b2 + a3 * b3 AS k, a2 * b3 - b2 * a3 AS n1, b1 * a3 - a1 * b3 AS n2, a1 * b2 - b1 * a2 AS n3 FROM p),
        r AS (SELECT u.*, -(x * a1 + y * a2 + z * a3) AS e, (x * (k * a1 - b1) + y * (k * a2 - b2) + z * (k * a3 - b3)) / sqrt(1 - k * k) AS f, (x * n1 + y * n2 + z * n3) / sqrt(n1 * n1 + n2 * n2 + n3 * n3) AS g FROM u, q)
        SELECT s_suppkey, round(degrees(asin(g)), 4) AS rlat, round((degrees(atan2(f, e)) + 360) % 360, 4) % 360 AS rlon, round(lat, 4) AS lat, round(lon, 4) % 360 AS lon FROM r""",
    "latlon_gaussian_index": f"""SELECT s_suppkey, round((lon + 350) % 360 / 2.5 + 1, 4)::DOUBLE AS x, round((lat + 90) / 1.5 + 1, 4)::DOUBLE AS y,
        round(CASE WHEN lat <= 10 THEN 1 + lat / 10 WHEN lat <= 25 THEN 2 + (lat - 10) / 15 WHEN lat <= 60 THEN 3 + (lat - 25) / 35 ELSE 4 + (lat - 60) / 30 END, 4) AS g FROM {_P}""",
    "lambert": f"""SELECT s_suppkey, round(r * sin(t), 1) AS x, round(r0 - r * cos(t), 1) AS y FROM (SELECT s_suppkey, n * radians((lon - 270 + 540) % 360 - 180) AS t,
        6370997.0 * f / pow(tan(pi() / 4 + radians(lat) / 2), n) AS r, 6370997.0 * f / pow(tan(pi() / 4 + radians(45) / 2), n) AS r0 FROM (SELECT *, sin(radians(50)) AS n, cos(radians(50)) * pow(tan(pi() / 4 + radians(25)), sin(radians(50))) / sin(radians(50)) AS f FROM {_P}))""",
    "pressure_levels": """SELECT p_partkey, round(800 * (l - b) + b * ps, 4) AS hybrid, round(10 * (1 - l) + l * ps, 4) AS eta, round(l * ps, 4) AS sigma FROM (
        SELECT *, pow(greatest((l - 0.0125::DOUBLE) / (1 - 0.0125::DOUBLE), 0), 1.6) AS b FROM (SELECT p_partkey, p_size / 50.0::DOUBLE AS l, 900 + p_size * 2.0::DOUBLE AS ps FROM part))""",
    "map_scale_coriolis": f"SELECT p_partkey, round(1.866025 / 2 * (p_size * 37.0::DOUBLE + {_RE2}) / {_RE2}, 6) AS scale, round(1.458 * ({_RE2} - p_size * 37.0::DOUBLE) / ({_RE2} + p_size * 37.0::DOUBLE), 6) AS coriolis FROM part",
    "base40_names": f"""SELECT n_nationkey, list_reduce(list_prepend(0::BIGINT, list_transform(range(1, 9), lambda i: CASE WHEN instr('{_CHARS}', substr(rpad(n_name, 8, ' '), i, 1)) > 0 THEN instr('{_CHARS}', substr(rpad(n_name, 8, ' '), i, 1)) - 1 ELSE 36 END)), lambda a, b: a * 40 + b)::BIGINT AS code,
        rtrim(replace(substr(n_name, 1, 8), '_', '/')) AS name FROM nation""",
    "element_codes": """SELECT p_partkey, (p_partkey % 4) * 16384 + (p_partkey % 64) * 256 + p_partkey % 256 AS code, (p_partkey % 4) * 100000 + (p_partkey % 64) * 1000 + p_partkey % 256 AS back,
        p_partkey % 16 AS nature, p_partkey % 128 AS kind, p_partkey % 13 AS step FROM part""",
    "file_names": "SELECT o_orderkey, 'pp' || strftime(o_orderdate, '%Y%m%d%H') || '_' || lpad((o_orderkey % 100)::VARCHAR, 3, '0') AS name FROM orders",
    "edge_derivative": """SELECT user_id, round((-21 * a + 13 * b + 17 * c - 9 * e) * 0.025, 6) AS derivative FROM (SELECT user_id, value AS a, lead(value) OVER w AS b, lead(value, 2) OVER w AS c, lead(value, 3) OVER w AS e, row_number() OVER w AS n
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE n = 1 AND e IS NOT NULL""",
    "coarse_reversed": f"WITH {GRID_SQL} SELECT i, j, round(f, 4) AS f FROM (SELECT 8 - i AS i, j, f FROM grid) WHERE ((i - 1) % 3 = 0 OR i = 7) AND ((j - 1) % 3 = 0 OR j = (SELECT max(o_orderkey) FROM orders))",
    "lorenzo_residual": """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x * 1000)::BIGINT) AS z FROM embeddings), p AS (SELECT vec_id, z, unnest(range(0, 64)) AS k FROM e)
        SELECT vec_id, sum(abs(z[k+1] - CASE WHEN k % 8 > 0 THEN z[k] ELSE 0 END - CASE WHEN k >= 8 THEN z[k-7] ELSE 0 END + CASE WHEN k % 8 > 0 AND k >= 8 THEN z[k-8] ELSE 0 END))::BIGINT AS size, true AS same FROM p GROUP BY 1""",
    "fourier": f"""SELECT vec_id, n, round(sum(v * cos(2 * pi() * n * k / 64)) / 64, 4) + 0 AS re, round(-sum(v * sin(2 * pi() * n * k / 64)) / 64, 4) + 0 AS im FROM {_E}, range(0, 33) s(n) GROUP BY 1, 2""",
    # Even coefficients are those of the mean of a row and itself half a turn on.
    "fourier_back": f"SELECT a.vec_id, a.k, round((a.v + b.v) / 2, 4) AS value FROM {_E} a JOIN {_E} b ON a.vec_id = b.vec_id AND b.k = (a.k + 32) % 64",
    "matrix_product": "SELECT a.vec_id AS i, b.vec_id AS j, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS v FROM embeddings a, embeddings b",
    "spline": _spline_sql(),
    "stream_zonal_means": "SELECT floor(epoch(ts) / 86400)::BIGINT * 86400 AS start, event_type AS zone, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2",
    "stream_channel": "SELECT event_id, 'I' AS kind, event_id::INTEGER AS value FROM events WHERE event_id % 4 = 1",
}


def _refined_sql() -> str:
    """Both lines of eight by powers of the way from the second node on; the last point stands for the fourth node."""
    cubic = lambda a, b, c, e, t: f"({b} + ({t} / 3.0) * ((6 * {c} - {e} - 3 * {b} - 2 * {a}) / 6.0 + ({t} / 3.0) * (({a} + {c} - 2 * {b}) / 2.0 + ({t} / 3.0) * ({e} - {a} + 3 * ({b} - {c})) / 6.0)))::DOUBLE"
    whole = lambda v: f"trunc({v} + sign({v}) * 0.5001)::BIGINT"
    line = lambda at: "[" + ", ".join(at(k) if k in (1, 4, 7, 8) else whole(cubic(at(1), at(4), at(7), at(8), k - 4)) for k in range(1, 9)) + "]"
    rows = ", ".join(f"{line(lambda i, j=j: f'z[{(j - 1) * 8 + i}]')} AS r{j}" for j in (1, 4, 7, 8))
    columns = ", ".join(f"{line(lambda j, i=i: f'r{j}[{i}]')} AS c{i}" for i in range(1, 9))
    pick = " ".join(f"WHEN {i - 1} THEN c{i}[k // 8 + 1]" for i in range(1, 9))
    return f"""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x * 1000)::BIGINT) AS z FROM embeddings), r AS (SELECT vec_id, {rows} FROM e), c AS (SELECT vec_id, {columns} FROM r)
        SELECT vec_id, k, CASE k % 8 {pick} END AS value FROM c, range(0, 64) s(k)"""


ORACLE_SQL["coarse_refined"] = _refined_sql()
