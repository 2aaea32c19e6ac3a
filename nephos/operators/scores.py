"""Forecast verification scores and box statistics, each one aggregation with partial sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nephos.functions.columns import unused

#: Given where a score cannot be computed.
NO_SCORE = 99999.0


def in_window(i: Column, j: Column, window: tuple[int, int, int, int]) -> Column:
    i1, i2, j1, j2 = window
    return i.between(i1, i2) & j.between(j1, j2)


def _safe(value: Column, test: Column) -> Column:
    return F.when(test, value).otherwise(F.lit(NO_SCORE))


def bias_std(rows: DataFrame, forecast: Column, observed: Column, weight: Column, by: list[str]) -> DataFrame:
    """Weighted mean error and its standard deviation."""
    e = forecast - observed
    sums = rows.groupBy(*by).agg(F.sum(e * weight).alias("x"), F.sum(e * e * weight).alias("y"), F.sum(weight).alias("w"))
    w = F.nullif("w", F.lit(0.0))
    bias = F.col("x") / w
    return sums.select(
        *by,
        F.coalesce(bias, F.lit(NO_SCORE)).alias("bias"),
        F.coalesce(F.sqrt(F.greatest(F.lit(0.0), F.col("y") / w - bias * bias)), F.lit(NO_SCORE)).alias("std"),
    )


def correlation(rows: DataFrame, forecast: Column, observed: Column, normal: Column, weight: Column, by: list[str]) -> DataFrame:
    """Weighted correlation of departures from the normal."""
    da, df = observed - normal, forecast - normal
    parts = {"r1": weight * da * df, "r2": weight * df * df, "r3": weight * da * da, "r4": weight * df, "r5": weight * da, "w": weight}
    s = rows.groupBy(*by).agg(*[F.sum(v).alias(k) for k, v in parts.items()])
    w = F.nullif("w", F.lit(0.0))
    r = [F.col(f"r{i}") / w for i in range(1, 6)]
    a, b, c = r[0] - r[3] * r[4], r[1] - r[3] * r[3], r[2] - r[4] * r[4]
    # Only a field without any spread has no correlation; spreads of opposite sign come from rounding.
    good = F.coalesce((b != 0) & (c != 0) & (b * c > 0), F.lit(False))
    return s.select(*by, _safe(a / F.sqrt(F.when(good, b * c)), good).alias("correlation"))


def wind_rms(rows: DataFrame, fu: Column, ou: Column, fv: Column, ov: Column, weight: Column, by: list[str]) -> DataFrame:
    """Weighted root mean square of the vector wind error."""
    e = ((fu - ou) * (fu - ou) + (fv - ov) * (fv - ov)) * weight
    s = rows.groupBy(*by).agg(F.sum(e).alias("y"), F.sum(weight).alias("w"))
    return s.select(*by, F.coalesce(F.sqrt(F.col("y") / F.nullif("w", F.lit(0.0))), F.lit(NO_SCORE)).alias("rms"))


#: Rows of a field that are in a band.
BAND = 256


def gradient_score(cells: DataFrame, i: str, j: str, forecast: str, observed: str, by: list[str], window: tuple[int, int, int, int] | None = None, step: int = 1) -> DataFrame:
    """S1: 100 times the summed error of gradients to the next i and the next j over their summed size.

    cells has one row for each (by, i, j).  Gradients start at every step-th point of the window (i1, i2, j1, j2) up to a step
    before its far ends.  Without gradients, or where all are zero, and for a step that is not 1 or 2 or does not fit, the
    score is 99999.  Rows are dealt once, by bands of j with the first row of the next band, and both neighbours come from
    windows inside a band.
    """
    i_, j_, band, start, f, v = (unused(n, cells) for n in ("_i", "_j", "_band", "_start", "_f", "_v"))
    here = cells.select(*by, F.col(i).alias(i_), F.col(j).alias(j_), F.col(forecast).cast("double").alias(f), F.col(observed).cast("double").alias(v))
    of_j = F.floor(F.col(j_) / BAND).cast("long")
    # The first row of a band ends the gradients of the band before, but starts none there.
    sent = F.when(F.pmod(F.col(j_), F.lit(BAND)) == 0, F.array(of_j, of_j - 1)).otherwise(F.array(of_j))
    rows = here.select("*", F.explode(sent).alias(band)).withColumn(start, F.col(band) == of_j).repartition(*by, band)

    def next_along(order: str, fixed: str) -> list[Column]:
        w = Window.partitionBy(*by, band, fixed).orderBy(order)
        beside = F.lead(order).over(w) == F.col(order) + 1
        return [F.when(beside, F.lead(c).over(w)) for c in (f, v)]

    ends = {f"{c}{axis}": x for axis, at in (("i", (i_, j_)), ("j", (j_, i_))) for c, x in zip("fv", next_along(*at), strict=True)}
    ends = {unused(f"_{name}", cells): x for name, x in ends.items()}
    met = rows.withColumns(ends)
    good = F.col(start)
    if window is not None:
        i1, i2, j1, j2 = window
        good = good & F.col(i_).between(i1, i2 - step) & F.col(j_).between(j1, j2 - step) & ((F.col(i_) - i1) % step == 0) & ((F.col(j_) - j1) % step == 0)
        if step not in (1, 2) or i2 - i1 < step or j2 - j1 < step:
            good = F.lit(False)
    for c in (f, v, *ends):
        good = good & F.col(c).isNotNull()
    dfi, dvi, dfj, dvj = (F.col(c) - F.col(e) for c, e in zip((f, v, f, v), ends, strict=True))
    a = F.sum(F.when(good, F.abs(dfi - dvi) + F.abs(dfj - dvj)))
    b = F.sum(F.when(good, F.greatest(F.abs(dfi), F.abs(dvi)) + F.greatest(F.abs(dfj), F.abs(dvj))))
    s = met.groupBy(*by).agg(a.alias("_a"), b.alias("_b"))
    return s.select(*by, F.when(F.col("_b") != 0, F.col("_a") / F.col("_b") * 100).otherwise(F.lit(NO_SCORE)).alias("s1"))


def zonal_mean(rows: DataFrame, value: Column, zone: Column, by: list[str]) -> DataFrame:
    return rows.withColumn("zone", zone).groupBy(*by, "zone").agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def least_greatest(rows: DataFrame, value: Column, missing: Column, by: list[str]) -> DataFrame:
    """Extremes and mean of what is not missing, and how much is."""
    held = F.when(~missing, value)
    return rows.groupBy(*by).agg(F.min(held).alias("least"), F.max(held).alias("greatest"), F.avg(held).alias("mean"), F.sum(missing.cast("long")).alias("n_missing"))


def entropy(rows: DataFrame, token: str, by: list[str]) -> DataFrame:
    """Bits a token needs on average; two aggregations, the second over counts."""
    n = rows.groupBy(*by, token).agg(F.count("*").alias("n"))
    s = n.groupBy(*by).agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log2(F.col("n"))).alias("x"))
    return s.select(*by, (F.log2("t") - F.col("x") / F.col("t")).alias("bits"))


def pole_mean(rows: DataFrame, at: Column, value: str, by: list[str]) -> DataFrame:
    """Mean of a value over an uneven axis: each but the last counts by the way to the next; 0 where the axis has no length."""
    w = Window.partitionBy(*by).orderBy("_x")
    t = rows.withColumn("_x", at).withColumn("_w", F.lead("_x").over(w) - F.col("_x"))
    total = F.coalesce(F.sum(F.col("_w") * F.col(value)), F.lit(0.0))
    return t.groupBy(*by).agg((total / F.coalesce(F.nullif(F.sum("_w"), F.lit(0.0)), F.lit(1.0))).alias("pole"))


def pole_wind(rows: DataFrame, lon: Column, u: str, v: str, ring: str, by: list[str], calm: float = 0.0) -> DataFrame:
    """Speed of the wind at a pole and its angle to the first meridian (0 to 360), calm where there is no wind.

    The rows next to the pole (ring 1 and 2) are turned into the polar plane; 9/8 of the mean of the first less 1/8 of that of
    the second stands for the pole.
    """
    s, c = -F.sin(F.radians(lon)), F.cos(F.radians(lon))
    part = {"x": s * F.col(u) - c * F.col(v), "y": c * F.col(u) + s * F.col(v)}
    means = [F.avg(F.when(F.col(ring) == n, p)).alias(f"{k}{n}") for k, p in part.items() for n in (1, 2)]
    x, y = (F.col(f"{k}1") * 1.125 - F.col(f"{k}2") * 0.125 for k in part)
    t = rows.groupBy(*by).agg(*means).select(*by, x.alias("x"), y.alias("y")).withColumn("speed", F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")))
    angle = F.degrees(F.atan2("y", "x"))
    return t.select(*by, "speed", F.when(F.col("speed") == 0, calm).otherwise(F.when(angle < 0, angle + 360).otherwise(angle)).alias("angle"))


def block_mean(rows: DataFrame, i: str, j: str, value: str, size: int, by: list[str]) -> DataFrame:
    """Means over blocks of size by size points."""
    block = {"bi": F.floor((F.col(i) - 1) / size).cast("long"), "bj": F.floor((F.col(j) - 1) / size).cast("long")}
    return rows.withColumns(block).groupBy(*by, "bi", "bj").agg(F.avg(value).alias("mean"), F.count("*").alias("n"))
