"""Vertical interpolation and extrapolation of columns of points.

Sources are gathered into one sorted array for each point: a column has tens of levels, so arrays are small
and all targets of a point share them.  Positions and formulas are higher-order functions, inside codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nephos.functions.columns import last_below


def columns_of(source: DataFrame, point: str, level: str, state: str, slope: str | None = None) -> DataFrame:
    """(point, lev, sta[, der]): the levels of each point in ascending order, one of those that repeat a level."""
    fields = [F.col(level).cast("double").alias("l"), F.col(state).cast("double").alias("s")]
    fields += [F.col(slope).cast("double").alias("d")] if slope else []
    once = source.where(F.col(level).isNotNull()).groupBy(point, level).agg(*[F.min(c).alias(c) for c in (state, slope) if c])
    sorted_rows = once.groupBy(point).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("_a"))
    out = {"lev": F.transform("_a", lambda x: x["l"]), "sta": F.transform("_a", lambda x: x["s"])}
    if slope:
        out["der"] = F.transform("_a", lambda x: x["d"])
    return sorted_rows.select(point, *[v.alias(k) for k, v in out.items()])


def position(target: Column) -> Column:
    """Number from 1 of the source level just below the target, kept between 1 and the last but one."""
    return F.greatest(F.lit(1), F.least(last_below(F.col("lev"), target, True), F.size("lev") - 1))


def _at(array: str, n: Column) -> Column:
    return F.get(F.col(array), n - 1)


def _clamped(value: Column, target: Column, down: bool, up: bool, array: str = "sta") -> Column:
    low, high = _at("lev", F.lit(1)), _at("lev", F.size("lev"))
    out = F
    if not down:
        out = out.when(target < low, _at(array, F.lit(1)))
    if not up:
        out = out.when(target > high, _at(array, F.size("lev")))
    return value if out is F else out.otherwise(value)


def joined(columns: DataFrame, targets: DataFrame, point: str, level: str) -> DataFrame:
    t = F.col(level).cast("double")
    return targets.join(columns, point).where(F.size("lev") >= 2).withColumn("_t", t).withColumn("pos", position(F.col("_t")))


def at_targets(columns: DataFrame, targets: Column, into: str = "t") -> DataFrame:
    """Each column once for every target of an array, without a join: what joined() gives for targets of one's own row."""
    rows = columns.where(F.size("lev") >= 2).select("*", F.posexplode(targets).alias("place", into))
    return rows.withColumn("_t", F.col(into).cast("double")).withColumn("pos", position(F.col("_t")))


def linear(rows: DataFrame, down: bool = False, up: bool = False, into: str = "value") -> DataFrame:
    p, t = F.col("pos"), F.col("_t")
    l1, l2, s1, s2 = _at("lev", p), _at("lev", p + 1), _at("sta", p), _at("sta", p + 1)
    return rows.withColumn(into, _clamped((s2 - s1) / (l2 - l1) * (t - l1) + s1, t, down, up))


def nearest(rows: DataFrame, down: bool = False, up: bool = False, into: str = "value") -> DataFrame:
    """The state of the nearer of the two levels, the lower on ties."""
    p, t = F.col("pos"), F.col("_t")
    upper = F.abs(_at("lev", p + 1) - t) < F.abs(t - _at("lev", p))
    return rows.withColumn(into, _clamped(F.when(upper, _at("sta", p + 1)).otherwise(_at("sta", p)), t, down, up))


def cubic(rows: DataFrame, down: bool = False, up: bool = False, into: str = "value") -> DataFrame:
    """Newton's polynomial through the four levels around the target; points with fewer levels give null."""
    t = F.col("_t")
    first = F.greatest(F.least(F.col("pos") - 1, F.size("lev") - 3), F.lit(1))
    x = [_at("lev", first + i) for i in range(4)]
    table = [[_at("sta", first + i) for i in range(4)]]
    for order in range(1, 4):
        table.append([(table[-1][i + 1] - table[-1][i]) / (x[i + order] - x[i]) for i in range(4 - order)])
    value = table[3][0]
    for order in (2, 1, 0):
        value = table[order][0] + (t - x[order]) * value
    return rows.withColumn(into, F.when(F.size("lev") >= 4, _clamped(value, t, down, up)))


def cubic_with_slopes(rows: DataFrame, down: bool = False, up: bool = False, into: str = "value", into_slope: str = "slope") -> DataFrame:
    """The cubic that meets states and slopes at both levels, and its slope."""
    p, t = F.col("pos"), F.col("_t")
    l1, l2 = _at("lev", p), _at("lev", p + 1)
    h = l2 - l1
    u = (t - l1) / h
    s1, s2, d1, d2 = _at("sta", p), _at("sta", p + 1), _at("der", p) * h, _at("der", p + 1) * h
    a, b = 2 * (s1 - s2) + d1 + d2, 3 * (s2 - s1) - 2 * d1 - d2
    value = s1 + u * (d1 + u * (b + u * a))
    slope = (d1 + u * (2 * b + u * 3 * a)) / h
    return rows.withColumns({into: _clamped(value, t, down, up), into_slope: _clamped(slope, t, down, up, "der")})


def lapse(rows: DataFrame, below: float, above: float, into: str = "value") -> DataFrame:
    """Beyond the levels, the end's state and a lapse rate; within, what the column holds already."""
    t = F.col("_t")
    low, high = _at("lev", F.lit(1)), _at("lev", F.size("lev"))
    return rows.withColumn(
        into,
        F.when(t < low, _at("sta", F.lit(1)) + below * (t - low))
        .when(t > high, _at("sta", F.size("lev")) + above * (t - high))
        .otherwise(F.col(into)),
    )


def fixed(rows: DataFrame, below: float, above: float, into: str = "value") -> DataFrame:
    t = F.col("_t")
    return rows.withColumn(
        into, F.when(t < _at("lev", F.lit(1)), below).when(t > _at("lev", F.size("lev")), above).otherwise(F.col(into))
    )
