"""Tables and number forms that the queries share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, each: int = 50_000) -> DataFrame:
    """Rows dealt to tasks by their number: a file of few bytes is read by one task, however much its rows cost."""
    parts = -(-rows.count() // each)
    return rows.repartition(parts) if parts > 1 else rows


def r4(c) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 4)


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as a field: one row for each (j = order, i = line)."""
    li = read(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_orderkey").alias("j"), F.col("l_linenumber").cast("long").alias("i")).agg(
        F.sum("l_quantity").alias("f"), F.sum(F.col("l_quantity") - F.col("l_linenumber")).alias("v"), F.count("*").alias("w")
    )


GRID_SQL = "grid AS (SELECT l_orderkey AS j, l_linenumber::BIGINT AS i, sum(l_quantity) AS f, sum(l_quantity - l_linenumber) AS v, count(*) AS w FROM lineitem GROUP BY ALL)"
