"""Files of big-endian 32-bit words, and what a file is by its first bytes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The first bytes of file types, in hexadecimal.
MAGIC = {
    "grib": "47524942", "bufr": "42554652", "netcdf": "434446", "hdf5": "894844460D0A1A0A",
    "sqlite": "53514C69746520666F726D61742033", "gif": "47494638", "png": "89504E47", "jpeg": "FFD8FF",
    "gzip": "1F8B", "parquet": "50415231", "orc": "4F5243",
}


def file_type(content: Column) -> Column:
    """Type by first bytes; record files by their marks STDR and STDS at byte 12; text if all of the start is printable; else unknown."""
    head = F.hex(F.substring(content, 1, 64))
    chain = F.when(F.length(content) == 0, "empty")
    for name, mark in MAGIC.items():
        chain = chain.when(head.startswith(mark), name)
    label = F.decode(F.substring(content, 13, 4), "US-ASCII")
    chain = chain.when(label == "STDR", "records random").when(label == "STDS", "records sequential")
    first = F.conv(F.hex(F.substring(content, 1, 4)), 16, 10).cast("long")
    size = F.length(content).cast("long")
    last = F.conv(F.hex(F.substring(content, (first + 5).cast("int"), F.lit(4))), 16, 10).cast("long")
    chain = chain.when((first > 0) & (first + 8 <= size) & (first == last), "unformatted")
    return chain.when(head.rlike("^(09|0A|0D|[2-7][0-9A-F])+$"), "text").otherwise("unknown")


def files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


def sniffed(found: DataFrame) -> DataFrame:
    return found.select("path", "length", file_type(F.col("content")).alias("file_type"))


def words(found: DataFrame, offset: int = 1, count: int | None = None) -> DataFrame:
    """(path, words): count words from a 1-based offset; what lies beyond the end of the file is not there."""

    def cut(s: pd.Series) -> pd.Series:
        stop = None if count is None else offset - 1 + count
        return s.map(lambda b: np.frombuffer(b, ">u4", len(b) // 4)[offset - 1 : stop].astype(np.int64))

    cut.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return found.select("path", F.pandas_udf(cut, "array<long>")("content").alias("words"))


def sizes(found: DataFrame) -> DataFrame:
    """Words and kilobyte blocks of each file."""
    return found.select("path", F.floor(F.col("length") / 4).alias("n_words"), F.ceil(F.col("length") / 1024).alias("n_blocks"))


def ibm_to_float(word: Column) -> Column:
    """An IBM 370 single precision word as a double."""
    sign = F.when(F.shiftrightunsigned(word, 31).bitwiseAND(F.lit(1)) == 1, -1.0).otherwise(1.0)
    power = F.shiftrightunsigned(word, 24).bitwiseAND(F.lit(127)) - 70
    return sign * word.bitwiseAND(F.lit(0xFFFFFF)) * F.pow(F.lit(16.0), power)
