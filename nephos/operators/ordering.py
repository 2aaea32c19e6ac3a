"""Order: sorting permutations, top rows, skips and file marks, each within groups so that no task holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nephos.functions.columns import unused


def argsort(rows: DataFrame, value: str, tie: str, by: list[str]) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(value, tie)))


def top(rows: DataFrame, value: str, tie: str, k: int, by: list[str]) -> DataFrame:
    """The k rows of each group with the greatest values."""
    w = Window.partitionBy(*by).orderBy(F.col(value).desc(), F.col(tie))
    n = unused("_n", rows)
    return rows.withColumn(n, F.row_number().over(w)).where(F.col(n) <= k).drop(n)


#: Ranges of the position that rows are numbered in, each by itself.
RANGES = 200


def numbered(rows: DataFrame, position: str, into: str = "place") -> DataFrame:
    """Rows with their 1-based place in the whole table by a numeric position: its quantiles part the rows in ranges, which
    are counted, then numbered each by itself.  Rows of one position are one range; null positions come first."""
    share = [i / RANGES for i in range(1, RANGES)]
    edges = sorted(set(rows.agg(F.percentile_approx(position, share, 10_000)).first()[0] or []))
    inside = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e < F.col(position))) if edges else F.lit(0)
    held, own, first_of = unused("_range", rows), unused("_at", rows), unused("_before", rows)
    ranged = rows.withColumn(held, F.coalesce(F.when(F.col(position).isNotNull(), inside), F.lit(-1)))
    ends = ranged.groupBy(held).agg(F.count("*").alias("n"))
    # As many rows as there are ranges.
    before = F.coalesce(F.sum("n").over(Window.orderBy(held).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = F.broadcast(ends.select(held, before.alias(first_of)))
    at = F.row_number().over(Window.partitionBy(held).orderBy(position))
    return ranged.withColumn(own, at).join(first, held).withColumn(into, F.col(first_of) + F.col(own)).drop(held, own, first_of)


def skip(rows: DataFrame, position: str, n: int) -> DataFrame:
    """Rows after the first n of a sequential file."""
    place = unused("_place", rows)
    return numbered(rows, position, place).where(F.col(place) > n).drop(place)


def mark_level(rows: DataFrame, position: str, mark: Column, by: list[str]) -> DataFrame:
    """files: how many end-of-file marks have been met up to each row, itself included."""
    w = Window.partitionBy(*by).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("files", F.sum(F.when(mark, 1).otherwise(0)).over(w))


def median_of(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.percentile(value, F.lit(0.5)).alias("median"))
