"""Queries of verification scores and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from nephos.operators import scores as ops
from nephos.plans.base import GRID_SQL, grid, r4, read


def bias_std(spark, d):
    li = read(spark, d, "lineitem").where(F.col("l_linenumber").between(1, 5))
    v = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    s = ops.bias_std(li, F.col("l_extendedprice"), v, F.col("l_quantity"), ["l_returnflag"])
    return s.select("l_returnflag", r4("bias").alias("bias"), r4("std").alias("std"))


def corr_weighted(spark, d):
    li = read(spark, d, "lineitem")
    s = ops.correlation(li, F.col("l_extendedprice"), F.col("l_quantity"), F.col("l_tax"), F.col("l_linenumber").cast("double"), ["l_returnflag", "l_linestatus"])
    return s.select("l_returnflag", "l_linestatus", r4("correlation").alias("correlation"))


def wind_rms(spark, d):
    li = read(spark, d, "lineitem")
    s = ops.wind_rms(li, F.col("l_quantity"), F.col("l_discount"), F.col("l_linenumber").cast("double"), F.col("l_tax"), F.col("l_quantity"), ["l_linestatus"])
    return s.select("l_linestatus", r4("rms").alias("rms"))


def gradient_score(spark, d):
    s = ops.gradient_score(grid(spark, d).withColumn("g", F.col("i") * 0), "i", "j", "f", "v", ["g"])
    return s.select("g", r4("s1").alias("s1"))


def gradient_score_window(spark, d):
    """Every second point of a window, by ship month; a field of zeros has no score."""
    g = grid(spark, d).withColumns({"g": F.col("j") % 3, "j": F.floor(F.col("j") / 3)})
    g = g.withColumns({"f": F.when(F.col("g") == 2, 0).otherwise(F.col("f")), "v": F.when(F.col("g") == 2, 0).otherwise(F.col("v"))})
    return ops.gradient_score(g, "i", "j", "f", "v", ["g"], (1, 6, 10, 400), 2).select("g", r4("s1").alias("s1"))


def corr_small(spark, d):
    """Variances far below 1e-12, as of specific humidity, have a correlation; none at all has not."""
    li = read(spark, d, "lineitem").withColumn("f", F.when(F.col("l_linenumber") == 1, 0.0).otherwise(F.col("l_extendedprice") * 1e-12))
    s = ops.correlation(li, F.col("f"), F.col("l_quantity") * 1e-8, F.lit(0.0), F.lit(1.0), ["l_linenumber"])
    return s.select("l_linenumber", r4("correlation").alias("correlation"))


def zonal_mean(spark, d):
    e = read(spark, d, "events").withColumn("hour", F.hour("ts").cast("long"))
    return ops.zonal_mean(e, F.col("value"), F.floor(F.col("value") / 50).cast("long"), ["hour"]).select("hour", "zone", "n", r4("mean").alias("mean"))


def minmax_missing(spark, d):
    c = read(spark, d, "customer")
    s = ops.least_greatest(c, F.col("c_acctbal"), F.col("c_acctbal") < 0, ["c_nationkey"])
    return s.select("c_nationkey", r4("least").alias("least"), r4("greatest").alias("greatest"), r4("mean").alias("mean"), "n_missing")


def entropy(spark, d):
    return ops.entropy(read(spark, d, "events").withColumn("g", F.col("user_id") % 10), "event_type", ["g"]).select("g", r4("bits").alias("bits"))


def pole_mean(spark, d):
    s = ops.pole_mean(read(spark, d, "events"), F.unix_seconds(F.col("ts").cast("timestamp")).cast("double"), "value", ["user_id"])
    return s.select("user_id", r4("pole").alias("pole"))


def block_mean(spark, d):
    g = grid(spark, d)
    return ops.block_mean(g, "i", "j", "f", 4, []).select("bi", "bj", r4("mean").alias("mean"), "n")


QUERIES = {f.__name__: f for f in (bias_std, corr_weighted, wind_rms, gradient_score, gradient_score_window, corr_small, zonal_mean, minmax_missing, entropy, pole_mean, block_mean)}
ORACLE_SQL = {
    "bias_std": """SELECT l_returnflag, round(coalesce(x / nullif(w, 0), 99999), 4) AS bias, round(coalesce(sqrt(greatest(0, y / nullif(w, 0) - (x / nullif(w, 0)) ** 2)), 99999), 4) AS std FROM (
        SELECT l_returnflag, sum(e * w) AS x, sum(e * e * w) AS y, sum(w) AS w FROM (SELECT l_returnflag, l_extendedprice - l_extendedprice * (1 - l_discount) AS e, l_quantity AS w FROM lineitem WHERE l_linenumber BETWEEN 1 AND 5) GROUP BY 1)""",
    "corr_weighted": """SELECT l_returnflag, l_linestatus, round((r1 - r4 * r5) / sqrt((r2 - r4 * r4) * (r3 - r5 * r5)), 4) AS correlation FROM (
        SELECT l_returnflag, l_linestatus, sum(w*a*f)/sum(w) AS r1, sum(w*f*f)/sum(w) AS r2, sum(w*a*a)/sum(w) AS r3, sum(w*f)/sum(w) AS r4, sum(w*a)/sum(w) AS r5 FROM (
        SELECT l_returnflag, l_linestatus, l_quantity - l_tax AS a, l_extendedprice - l_tax AS f, l_linenumber AS w FROM lineitem) GROUP BY 1, 2)""",
    "wind_rms": "SELECT l_linestatus, round(sqrt(sum(((l_quantity - l_discount) ** 2 + (l_linenumber - l_tax) ** 2) * l_quantity) / sum(l_quantity)), 4) AS rms FROM lineitem GROUP BY 1",
    "gradient_score": f"""WITH {GRID_SQL} SELECT 0::BIGINT AS g, round(100 * sum(abs(a.f - b.f - a.v + b.v) + abs(a.f - c.f - a.v + c.v)) / sum(greatest(abs(a.f - b.f), abs(a.v - b.v)) + greatest(abs(a.f - c.f), abs(a.v - c.v))), 4) AS s1
        FROM grid a JOIN grid b ON b.i = a.i + 1 AND b.j = a.j JOIN grid c ON c.i = a.i AND c.j = a.j + 1""",
    "zonal_mean": "SELECT hour(ts) AS hour, floor(value / 50)::BIGINT AS zone, count(*) AS n, round(avg(value), 4) AS mean FROM events GROUP BY 1, 2",
    "minmax_missing": """SELECT c_nationkey, round(min(c_acctbal) FILTER (c_acctbal >= 0), 4) AS least, round(max(c_acctbal) FILTER (c_acctbal >= 0), 4) AS greatest,
        round(avg(c_acctbal) FILTER (c_acctbal >= 0), 4) AS mean, count(*) FILTER (c_acctbal < 0) AS n_missing FROM customer GROUP BY 1""",
    "entropy": "SELECT user_id % 10 AS g, round(entropy(event_type), 4) AS bits FROM events GROUP BY 1",
    "pole_mean": """SELECT user_id, round(coalesce(sum(w * value), 0) / coalesce(nullif(max(x) - min(x), 0), 1), 4) AS pole FROM (SELECT user_id, value, floor(epoch(ts)) AS x, floor(epoch(lead(ts) OVER p)) - floor(epoch(ts)) AS w
        FROM events WINDOW p AS (PARTITION BY user_id ORDER BY ts)) GROUP BY 1""",
    "gradient_score_window": f"""WITH {GRID_SQL}, h AS (SELECT j % 3 AS g, i, j // 3 AS j, CASE WHEN j % 3 = 2 THEN 0 ELSE f END AS f, CASE WHEN j % 3 = 2 THEN 0 ELSE v END AS v FROM grid),
        s AS (SELECT a.g, 100 * sum(abs(a.f - b.f - a.v + b.v) + abs(a.f - c.f - a.v + c.v)) / nullif(sum(greatest(abs(a.f - b.f), abs(a.v - b.v)) + greatest(abs(a.f - c.f), abs(a.v - c.v))), 0) AS s1
        FROM h a JOIN h b ON b.g = a.g AND b.i = a.i + 1 AND b.j = a.j JOIN h c ON c.g = a.g AND c.i = a.i AND c.j = a.j + 1 WHERE a.i IN (1, 3) AND a.j IN (SELECT unnest(range(10, 399, 2))) GROUP BY 1)
        SELECT g, round(coalesce(s1, 99999), 4) AS s1 FROM (SELECT DISTINCT g FROM h) LEFT JOIN s USING (g)""",
    "corr_small": """SELECT l_linenumber, CASE WHEN l_linenumber = 1 THEN 99999 ELSE round(corr(l_extendedprice, l_quantity), 4) END AS correlation FROM lineitem GROUP BY 1""",
    "block_mean": f"WITH {GRID_SQL} SELECT floor((i - 1) / 4)::BIGINT AS bi, floor((j - 1) / 4)::BIGINT AS bj, round(avg(f), 4) AS mean, count(*) AS n FROM grid GROUP BY 1, 2",
}
