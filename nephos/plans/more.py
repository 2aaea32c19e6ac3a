"""Queries of wrapped, irregular and composite grids, spectral sums, stores and days."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from nephos.functions import dates, sphere
from nephos.operators import grids, spectral, store
from nephos.plans.base import r4, read
from nephos.plans.grids import _targets
from nephos.sources import recordstore

LATITUDES = [-75.0, -30.0, 0.0, 12.5, 60.0]
AX, AY = [0.0, 1.0, 2.5, 3.0, 5.0, 6.0, 8.0, 9.0], [0.0, 2.0, 3.0, 4.5, 5.0, 7.0, 7.5, 9.0]


def regrid_wrapped(spark, d):
    return _targets(spark, d).select("vec_id", "k", r4(grids.wrapped_bilinear(F.col("z"), F.col("x"), F.col("y"), 8, 8)).alias("value"))


def regrid_irregular(spark, d):
    v = grids.irregular_bilinear(F.col("z"), F.col("x"), F.col("y"), AX, AY)
    return _targets(spark, d).select("vec_id", "k", r4(v).alias("value"))


def pole_values(spark, d):
    z = F.transform("embedding", lambda x: x.cast("double"))
    return read(spark, d, "embeddings").select("vec_id", r4(grids.pole_value(z, 8, 8, True)).alias("north"), r4(grids.pole_value(z, 8, 8, False)).alias("south"))


def composite_merge(spark, d):
    t = _targets(spark, d)
    a, b = grids.near(F.col("z"), F.col("x"), F.col("y"), 8, 8), grids.bilinear(F.col("z"), F.col("x"), F.col("y"), 8, 8)
    return t.select("vec_id", "k", r4(grids.merged(a, b, F.col("k") % 2)).alias("value"))


def _round_trip(spark, e):
    """Spectral coefficients to Gaussian latitudes and back, which quadrature makes exact."""
    waves, n = 6, 8
    lats = sphere.gaussian_latitudes(n)
    table = spectral.legendre_table(spark, lats, waves)
    weights = spark.createDataFrame([(i + 1, float(w)) for i, w in enumerate(np.polynomial.legendre.leggauss(n)[1])], "lat int, w double")
    e = e.select("vec_id", F.posexplode("embedding").alias("k", "x"))
    s = e.select("vec_id", F.floor(F.col("k") / 8).cast("int").alias("m"), (F.col("k") % 8).cast("int").alias("n"), F.col("x").cast("double").alias("re")).where(f"m <= n AND n <= {waves}").withColumn("im", F.col("re") * F.col("m"))
    back = spectral.to_spectrum(spectral.to_latitudes(s, table, ["vec_id"]), table, weights, ["vec_id"])
    return back.select("vec_id", F.col("m").cast("long").alias("m"), F.col("n").cast("long").alias("n"), r4("re").alias("re"), r4("im").alias("im"))


def spectral_round_trip(spark, d):
    return _round_trip(spark, read(spark, d, "embeddings"))


def spectral_synthesis(spark, d):
    """Fourier coefficients at latitudes of spectral ones up to wave 3, whose functions have closed forms."""
    table = spectral.legendre_table(spark, LATITUDES, 3)
    e = read(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("k", "x"))
    s = e.select("vec_id", F.floor(F.col("k") / 8).cast("int").alias("m"), (F.col("k") % 8).cast("int").alias("n"), F.col("x").cast("double").alias("re")).where("m <= n AND n <= 3").withColumn("im", F.col("re") * 2)
    f = spectral.to_latitudes(s, table, ["vec_id"])
    return f.select("vec_id", F.col("lat").cast("long").alias("lat"), F.col("m").cast("long").alias("m"), r4("re").alias("re"), r4("im").alias("im"))


def julian_days(spark, d):
    n = dates.julian_day(F.year("o_orderdate"), F.month("o_orderdate"), F.dayofmonth("o_orderdate"))
    back = dates.from_julian_day(n)
    return read(spark, d, "orders").select("o_orderkey", n.alias("day"), (back == F.to_date("o_orderdate")).alias("same"))


def jar_elements(spark, d):
    put = store.jar_put(F.col("jar"), F.array(F.col("o_custkey"), F.lit(7).cast("long")), (F.col("o_orderkey") % 6 + 1).cast("int"))
    j = read(spark, d, "orders").select("o_orderkey", "o_custkey", F.array(*[F.col("o_orderkey") * k for k in (1, 2, 3)]).alias("jar")).select("o_orderkey", put.alias("jar"))
    got = store.jar_get(F.col("jar"), F.lit(2), F.lit(2))
    return j.select("o_orderkey", F.size("jar").cast("long").alias("n"), F.get(got, F.lit(0)).alias("a"), F.get(got, F.lit(1)).alias("b"))


def array_names(spark, d):
    n = read(spark, d, "region").select(F.col("r_name").alias("name"), "r_regionkey")
    turned = store.shuffled(n, [f"REGION_{i}" for i in range(3)])
    return store.rename(store.rename(turned, "REGION_0", "FREE"), "REGION_1", "REGION_2").select("name", "r_regionkey")


def payload_round_trip(spark, d):
    z = F.transform("embedding", lambda x: F.round(x.cast("double") * 1000))
    e = read(spark, d, "embeddings").select("vec_id", z.alias("z"))
    coded = e.select("vec_id", "z", *[recordstore.encoded(F.col("z"), k, b).alias(f"p{k}") for k, b in ((4, 16), (133, 64))])
    back = [recordstore.decoded(F.col(f"p{k}"), F.size("z"), F.lit(k), F.lit(b)) for k, b in ((4, 16), (133, 64))]
    return coded.select("vec_id", F.hex("p4").alias("bytes"), (back[0] == F.col("z")).alias("same_int"), (back[1] == F.col("z")).alias("same_real"))


QUERIES = {f.__name__: f for f in (regrid_wrapped, regrid_irregular, pole_values, composite_merge, spectral_round_trip, spectral_synthesis, julian_days, jar_elements, array_names, payload_round_trip)}
#: Normalised associated Legendre functions of sine x and cosine c, by wave numbers m and n.
CLOSED = {
    (0, 0): "sqrt(0.5)", (0, 1): "sqrt(1.5) * x", (0, 2): "sqrt(2.5) * (3 * x * x - 1) / 2", (0, 3): "sqrt(3.5) * (5 * x * x * x - 3 * x) / 2",
    (1, 1): "sqrt(0.75) * c", (1, 2): "sqrt(3.75) * c * x", (1, 3): "sqrt(21.0 / 32) * c * (5 * x * x - 1)",
    (2, 2): "sqrt(15.0 / 16) * c * c", (2, 3): "sqrt(105.0 / 16) * c * c * x", (3, 3): "sqrt(35.0 / 32) * c * c * c",
}


def _synthesis_sql() -> str:
    lats = " UNION ALL ".join(f"SELECT {i}::BIGINT AS lat, sin(radians({v})) AS x, cos(radians({v})) AS c" for i, v in enumerate(LATITUDES, 1))
    waves = " UNION ALL ".join(f"SELECT vec_id, lat, {m}::BIGINT AS m, embedding[{8 * m + n + 1}]::DOUBLE * {f} AS p FROM embeddings, l" for (m, n), f in CLOSED.items())
    return f"WITH l AS ({lats}), p AS ({waves}) SELECT vec_id, lat, m, round(sum(p), 4) AS re, round(2 * sum(p), 4) AS im FROM p GROUP BY 1, 2, 3"


_T = "t AS (SELECT vec_id, embedding AS z, k, ((vec_id * 7 + k * 13) % 32 / 4.0 + 0.75)::DOUBLE AS x, ((vec_id * 5 + k * 11) % 32 / 4.0 + 0.75)::DOUBLE AS y FROM embeddings, range(0, 5) r(k))"
_V = "a + (b - a) * dx + ((e + (f - e) * dx) - (a + (b - a) * dx)) * dy"


def _place(axis: list[float], v: str) -> str:
    parts = [f"WHEN {v} <= {axis[i]} THEN {i} + ({v} - {axis[i - 1]}) / ({axis[i]} - {axis[i - 1]})" for i in range(1, len(axis) - 1)]
    n = len(axis) - 1
    return f"CASE {' '.join(parts)} ELSE {n} + ({v} - {axis[n - 1]}) / ({axis[n]} - {axis[n - 1]}) END"


_LIN = f"""c AS (SELECT *, greatest(1, least(7, floor(x)))::BIGINT AS i, greatest(1, least(7, floor(y)))::BIGINT AS j FROM p),
    l AS (SELECT *, x - i AS dx, y - j AS dy, z[(j-1)*8+i]::DOUBLE AS a, z[(j-1)*8+i+1]::DOUBLE AS b, z[j*8+i]::DOUBLE AS e, z[j*8+i+1]::DOUBLE AS f FROM c), v AS (SELECT *, {_V} AS v FROM l)"""
ORACLE_SQL = {
    "payload_round_trip": """SELECT vec_id, string_agg(printf('%02X%02X', w >> 8, w & 255), '' ORDER BY k) AS bytes, true AS same_int, true AS same_real FROM (
        SELECT vec_id, k, (round(embedding[k+1]::DOUBLE * 1000)::BIGINT + 65536) & 65535 AS w FROM embeddings, range(0, 64) r(k)) GROUP BY 1""",
    "spectral_synthesis": _synthesis_sql(),
    "regrid_wrapped": f"""WITH {_T}, c AS (SELECT *, floor(x)::BIGINT AS i, greatest(1, least(7, floor(y)))::BIGINT AS j FROM t), n AS (SELECT *, (i + 7) % 8 + 1 AS w, i % 8 + 1 AS r FROM c),
        l AS (SELECT *, x - i AS dx, y - j AS dy, z[(j-1)*8+w]::DOUBLE AS a, z[(j-1)*8+r]::DOUBLE AS b, z[j*8+w]::DOUBLE AS e, z[j*8+r]::DOUBLE AS f FROM n) SELECT vec_id, k, round({_V}, 4) AS value FROM l""",
    "regrid_irregular": f"WITH {_T}, p AS (SELECT vec_id, k, z, ({_place(AX, 'x')})::DOUBLE AS x, ({_place(AY, 'y')})::DOUBLE AS y FROM t), {_LIN} SELECT vec_id, k, round(v, 4) AS value FROM v",
    "pole_values": "SELECT vec_id, round(list_sum(embedding[57:64]::DOUBLE[]) / 8, 4) AS north, round(list_sum(embedding[1:8]::DOUBLE[]) / 8, 4) AS south FROM embeddings",
    "composite_merge": f"WITH {_T}, p AS (SELECT * FROM t), {_LIN} SELECT vec_id, k, round(CASE WHEN k % 2 = 1 THEN v ELSE z[((greatest(1, least(8, round(y))) - 1) * 8 + greatest(1, least(8, round(x))))::BIGINT]::DOUBLE END, 4) AS value FROM v",
    "spectral_round_trip": "SELECT vec_id, q // 8 AS m, q % 8 AS n, round(embedding[q + 1]::DOUBLE, 4) AS re, round(embedding[q + 1]::DOUBLE * (q // 8), 4) AS im FROM embeddings, range(0, 64) r(q) WHERE q // 8 <= q % 8 AND q % 8 <= 6",
    "julian_days": "SELECT o_orderkey, julian(o_orderdate::DATE)::BIGINT AS day, true AS same FROM orders",
    "jar_elements": """SELECT o_orderkey, len(j) AS n, CASE WHEN len(j) >= 3 THEN j[2] END AS a, CASE WHEN len(j) >= 3 THEN j[3] END AS b FROM (SELECT o_orderkey, list_concat(list_concat([o_orderkey, o_orderkey * 2, o_orderkey * 3][1:least(3, o_orderkey % 6)],
        CASE o_orderkey % 6 WHEN 4 THEN [0] WHEN 5 THEN [0, 0] ELSE [] END), [o_custkey, 7]) AS j FROM orders)""",
    "array_names": "SELECT CASE r_name WHEN 'REGION_0' THEN 'REGION_1' WHEN 'REGION_1' THEN 'REGION_2' WHEN 'REGION_2' THEN 'FREE' ELSE r_name END AS name, r_regionkey FROM region",
}
