"""Connected components of a link table by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nephos.llm.common import cut, gathered


def _large_star(links: DataFrame) -> DataFrame:
    """links: (u, v) both ways.  Joins every larger neighbour of a node to the smallest of its neighbourhood."""
    least = links.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return links.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    """links: (u, v) with u > v.  Joins the smaller neighbours of a node, and the node, to the smallest of them."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    inner = links.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return inner.union(least.select("u", F.col("m").alias("v")))


def _sum_of(links: DataFrame) -> tuple:
    one = F.xxhash64("u", "v")
    r = links.agg(F.count("*"), F.bit_xor(one), F.sum(F.shiftright(one, 24))).first()
    return tuple(r)


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every node of links (u, v), long columns: component is the smallest id reachable.

    Repeated links and links of a node to itself do no harm; no links give no rows.
    """
    now = cut(gathered(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()))
    seen = None
    while (sums := _sum_of(now)) != seen and sums[0]:
        seen = sums
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _large_star(both).where("u <> v").distinct()
        now = cut(gathered(_small_star(large).distinct()))
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)
