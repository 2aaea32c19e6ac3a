"""Queries of vertical interpolation: users as points, days as levels."""

from __future__ import annotations

from pyspark.sql import functions as F

from nephos.operators import vertical as ops
from nephos.plans.base import r4, read

STEP, TARGETS = 86_400.0, 31


def _joined(spark, d, slope=False):
    e = read(spark, d, "events").withColumn("lev", F.unix_seconds(F.col("ts").cast("timestamp")).cast("double")).withColumn("der", F.col("value") / 1e5)
    columns = ops.columns_of(e, "user_id", "lev", "value", "der" if slope else None)
    days = F.transform(F.sequence(F.lit(-1), F.lit(TARGETS)), lambda k: F.lit(1_704_067_200.0) + k * STEP)
    return ops.at_targets(columns, days).withColumn("k", (F.col("place") - 1).cast("long"))


def _out(rows, *names):
    return rows.select("user_id", "k", *[r4(n).alias(n) for n in names])


def vertical_pos(spark, d):
    return _joined(spark, d).select("user_id", "k", F.col("pos").cast("long").alias("pos"))


def vertical_nearest(spark, d):
    return _out(ops.nearest(_joined(spark, d)), "value")


def vertical_linear(spark, d):
    return _out(ops.linear(_joined(spark, d)), "value")


def vertical_linear_extrapolated(spark, d):
    return _out(ops.linear(_joined(spark, d), True, True), "value")


def vertical_lapse(spark, d):
    return _out(ops.lapse(ops.linear(_joined(spark, d)), 0.0004, -0.0005), "value")


def vertical_fixed(spark, d):
    return _out(ops.fixed(ops.linear(_joined(spark, d)), -1.0, -2.0), "value")


def vertical_cubic(spark, d):
    rows = ops.cubic(_joined(spark, d))
    return rows.select("user_id", "k", F.round("value", 2).alias("value"))


def vertical_cubic_slopes(spark, d):
    return _out(ops.cubic_with_slopes(_joined(spark, d, True)), "value")


QUERIES = {f.__name__: f for f in (vertical_pos, vertical_nearest, vertical_linear, vertical_linear_extrapolated, vertical_lapse, vertical_fixed, vertical_cubic, vertical_cubic_slopes)}
_BASE = f"""WITH e AS (SELECT user_id, floor(epoch(ts))::DOUBLE AS lev, min(value) AS s, min(value / 1e5) AS d FROM events GROUP BY 1, 2),
    c AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY lev) AS n, count(*) OVER (PARTITION BY user_id) AS m FROM e),
    t AS (SELECT user_id, k, 1704067200.0 + k * {STEP} AS t FROM (SELECT DISTINCT user_id FROM e), range(-1, {TARGETS + 1}) r(k)),
    p AS (SELECT t.user_id, k, t, greatest(1, least(count(*) FILTER (lev <= t), max(m) - 1)) AS pos, max(m) AS m, min(lev) AS lo, max(lev) AS hi, arg_min(s, lev) AS slo, arg_max(s, lev) AS shi FROM t JOIN c USING (user_id) GROUP BY 1, 2, 3 HAVING max(m) >= 2),
    j AS (SELECT p.*, a.lev AS l1, b.lev AS l2, a.s AS s1, b.s AS s2, a.d AS d1, b.d AS d2 FROM p JOIN c a ON a.user_id = p.user_id AND a.n = pos JOIN c b ON b.user_id = p.user_id AND b.n = pos + 1)"""
_LINE = "s1 + (s2 - s1) / (l2 - l1) * (t - l1)"


def _sql(value: str, clamp: bool = True) -> str:
    inside = f"CASE WHEN t < lo THEN slo WHEN t > hi THEN shi ELSE {value} END" if clamp else value
    return f"{_BASE} SELECT user_id, k, round({inside}, 4) AS value FROM j"


ORACLE_SQL = {
    "vertical_pos": f"{_BASE} SELECT user_id, k, pos::BIGINT AS pos FROM p",
    "vertical_nearest": _sql("CASE WHEN abs(l2 - t) < abs(t - l1) THEN s2 ELSE s1 END"),
    "vertical_linear": _sql(_LINE),
    "vertical_linear_extrapolated": _sql(_LINE, False),
    "vertical_lapse": _sql(f"CASE WHEN t < lo THEN slo + 0.0004 * (t - lo) WHEN t > hi THEN shi - 0.0005 * (t - hi) ELSE {_LINE} END", False),
    "vertical_fixed": _sql(f"CASE WHEN t < lo THEN -1 WHEN t > hi THEN -2 ELSE {_LINE} END", False),
    "vertical_cubic": f"""{_BASE}, q AS (SELECT p.*, greatest(least(pos - 1, m - 3), 1) AS f FROM p),
        x AS (SELECT q.user_id, k, t, lo, hi, slo, shi, q.m AS m, [a.lev, b.lev, g.lev, h.lev] AS l, [a.s, b.s, g.s, h.s] AS z FROM q JOIN c a ON a.user_id = q.user_id AND a.n = f LEFT JOIN c b ON b.user_id = q.user_id AND b.n = f + 1
          LEFT JOIN c g ON g.user_id = q.user_id AND g.n = f + 2 LEFT JOIN c h ON h.user_id = q.user_id AND h.n = f + 3)
        SELECT user_id, k, CASE WHEN m < 4 THEN NULL WHEN t < lo THEN round(slo, 2) WHEN t > hi THEN round(shi, 2) ELSE round(
          z[1] * (t-l[2])*(t-l[3])*(t-l[4]) / ((l[1]-l[2])*(l[1]-l[3])*(l[1]-l[4])) + z[2] * (t-l[1])*(t-l[3])*(t-l[4]) / ((l[2]-l[1])*(l[2]-l[3])*(l[2]-l[4]))
          + z[3] * (t-l[1])*(t-l[2])*(t-l[4]) / ((l[3]-l[1])*(l[3]-l[2])*(l[3]-l[4])) + z[4] * (t-l[1])*(t-l[2])*(t-l[3]) / ((l[4]-l[1])*(l[4]-l[2])*(l[4]-l[3])), 2) END AS value FROM x""",
    "vertical_cubic_slopes": _sql("(SELECT s1*(1+2*u)*(1-u)*(1-u) + d1*h*u*(1-u)*(1-u) + s2*u*u*(3-2*u) - d2*h*u*u*(1-u) FROM (SELECT l2 - l1 AS h, (t - l1) / (l2 - l1) AS u))"),
}
