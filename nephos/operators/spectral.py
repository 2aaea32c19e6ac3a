"""Spectral transforms: Legendre tables by latitude, sums over arrays of a wave."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def epsilon(n: int, m: int) -> float:
    return math.sqrt((n * n - m * m) / (4.0 * n * n - 1.0)) if n else 0.0


def legendre(sine: float, waves: int) -> dict[tuple[int, int], float]:
    """Normalised associated Legendre functions P(m, n) for m <= n <= waves, by the recurrence in n."""
    out = {}
    cosine2 = 1.0 - sine * sine
    for m in range(waves + 1):
        start = math.sqrt(0.5 * math.prod(1 + 1 / (2 * k) for k in range(1, m + 1)))
        below, now = 0.0, start * cosine2 ** (m / 2)
        for n in range(m, waves + 1):
            out[m, n] = now
            below, now = now, (sine * now - epsilon(n, m) * below) / epsilon(n + 1, m)
    return out


def legendre_table(spark: SparkSession, latitudes: list[float], waves: int) -> DataFrame:
    """(lat, m, n, p): a row for each latitude and pair of wave numbers, made where the latitudes are dealt."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i, degrees in zip(batch["lat"], batch["degrees"], strict=True):
                table = legendre(math.sin(math.radians(degrees)), waves)
                yield pd.DataFrame([(i, m, n, p) for (m, n), p in table.items()], columns=["lat", "m", "n", "p"])

    places = spark.createDataFrame(list(enumerate(map(float, latitudes), 1)), "lat int, degrees double")
    return places.repartition(max(1, min(len(latitudes), 200)), "lat").mapInPandas(made, "lat int, m int, n int, p double")


#: Rows of a table up to which every task is given all of it.
BROADCAST_ROWS = 1_000_000


def _summed(rows: DataFrame, by: list[str], over: str, table: DataFrame, into: str) -> DataFrame:
    """(by, into, m, re, im): rows (by, m, over, re, im) times a table (m, over, into, p), summed over one axis.

    A row's wave holds its axis as an array, so what is shuffled and kept are the rows, not each of them for each place of into.
    """
    places = table.groupBy("m", into).agg(F.map_from_entries(F.collect_list(F.struct(over, "p"))).alias("_p"))
    places = places.groupBy("m").agg(F.collect_list(F.struct(into, "_p")).alias("_t"))
    places = F.broadcast(places) if table.count() <= BROADCAST_ROWS else places
    lines = rows.groupBy(*by, "m").agg(F.collect_list(F.struct(F.col(over).cast(table.schema[over].dataType).alias("_o"), "re", "im")).alias("_x"))
    met = lines.join(places, "m").select(*by, "m", "_x", F.explode("_t").alias("_t"))
    met = met.select(*by, f"_t.{into}", "m", F.filter("_x", lambda x: F.col("_t._p")[x["_o"]].isNotNull()).alias("_x"), F.col("_t._p").alias("_p")).where(F.size("_x") > 0)

    def total(part: str):
        terms = F.filter(F.transform("_x", lambda x: x[part] * F.col("_p")[x["_o"]]), lambda t: t.isNotNull())
        return F.when(F.size(terms) > 0, F.aggregate(terms, F.lit(0.0), lambda a, t: a + t)).alias(part)

    return met.select(*by, into, "m", total("re"), total("im"))


def to_latitudes(spectrum: DataFrame, table: DataFrame, by: list[str]) -> DataFrame:
    """Fourier coefficients (by, lat, m, re, im) of spectral ones (by, m, n, re, im)."""
    return _summed(spectrum, by, "n", table, "lat")


def to_spectrum(fourier: DataFrame, table: DataFrame, weights: DataFrame, by: list[str]) -> DataFrame:
    """Spectral coefficients of Fourier ones by Gaussian quadrature; weights has (lat, w)."""
    weighted = table.join(weights, "lat").select("lat", "m", "n", (F.col("p") * F.col("w")).alias("p"))
    return _summed(fourier, by, "lat", weighted, "n").select(*by, "m", "n", "re", "im")


def east_derivative(spectrum: DataFrame, factor: float = 1.0) -> DataFrame:
    """Multiplies by i m factor."""
    k = F.col("m") * factor
    return spectrum.withColumns({"re": -F.col("im") * k, "im": F.col("re") * k})


def legendre_derivatives(sine: float, waves: int) -> dict[tuple[int, int], float]:
    """(1 - s^2) dP/ds of the normalised functions, of the functions themselves: (2n + 1) e(n) P(n - 1) - n s P(n)."""
    p = legendre(sine, waves)
    return {(m, n): (2 * n + 1) * epsilon(n, m) * p.get((m, n - 1), 0.0) - n * sine * v for (m, n), v in p.items()}


def halves_order(rows: DataFrame, m: str = "m", n: str = "n") -> DataFrame:
    """rows with part (0 where n - m is even, symmetric about the equator, 1 where it is odd) and their place within it by m and n:
    a count of the smaller ones, which the wave numbers give without a sort."""
    part = F.pmod(F.col(n) - F.col(m), F.lit(2))
    return rows.withColumns({"part": part.cast("long"), "place": (F.floor((F.col(n) - F.col(m)) / 2) + 1).cast("long")})
