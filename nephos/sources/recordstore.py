"""A store of records: a directory of descriptors and encoded fields as Parquet, one row a record.

Searches read the descriptor columns only; a field is decoded where it is asked for.  Writing appends, a
rewrite marks what it replaces as deleted by a later version, and a read takes the last version of a handle.
"""

from __future__ import annotations

import time
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Numbers of the payload types; 64 more marks missing values and 128 more a compressed payload.
BINARY, QUANTISED, UNSIGNED, TEXT, SIGNED, IEEE = 0, 1, 2, 3, 4, 5
MISSING, COMPRESSED = 64, 128


def _packed(codes: np.ndarray, bits: int) -> bytes:
    """Codes of bits each, most significant bit first."""
    spread = (codes[:, None] >> np.arange(bits - 1, -1, -1, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(spread.astype(np.uint8).ravel()).tobytes()


def _unpacked(data: bytes, n: int, bits: int) -> np.ndarray:
    flat = np.unpackbits(np.frombuffer(data, np.uint8))[: n * bits].reshape(n, bits).astype(np.uint64)
    return (flat << np.arange(bits - 1, -1, -1, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def encode_values(values, kind: int, bits: int) -> bytes:
    """The payload of an array; null elements need the missing mark in the kind."""
    base = kind & ~(MISSING | COMPRESSED)
    x = np.array([np.nan if v is None else v for v in values], np.float64)
    gone = np.isnan(x)
    if gone.any() and not kind & MISSING:
        raise ValueError("a field with missing values needs the missing mark in its type")
    mask = np.packbits(gone).tobytes() if kind & MISSING else b""
    full = np.where(gone, 0.0, x)
    if base == IEEE:
        body = full.astype(">f4" if bits <= 32 else ">f8").tobytes()
    elif base == QUANTISED:
        held = x[~gone]
        low, high = (held.min(), held.max()) if len(held) else (0.0, 0.0)
        top = (1 << bits) - 1
        codes = np.rint((full - low) / (high - low) * top) if high > low else np.zeros(len(x))
        body = np.array([low, high], ">f8").tobytes() + _packed(np.clip(codes, 0, top).astype(np.uint64), bits)
    elif base in (UNSIGNED, SIGNED):
        whole = np.rint(full).astype(np.int64)
        low, high = (-(1 << (bits - 1)), (1 << (bits - 1)) - 1) if base == SIGNED else (0, (1 << bits) - 1)
        if len(whole) and (whole.min() < low or whole.max() > high):
            raise ValueError(f"a value does not fit in {bits} bits")
        body = _packed((whole & ((1 << bits) - 1)).astype(np.uint64), bits)
    else:
        raise ValueError(f"no encoding for type {kind}")
    data = mask + body
    return zlib.compress(data) if kind & COMPRESSED else data


def decode_values(data: bytes, n: int, kind: int, bits: int) -> list[float | None]:
    base = kind & ~(MISSING | COMPRESSED)
    data = zlib.decompress(data) if kind & COMPRESSED else data
    size = (n + 7) // 8 if kind & MISSING else 0
    gone, body = np.unpackbits(np.frombuffer(data[:size], np.uint8))[:n].astype(bool), data[size:]
    if base == IEEE:
        x = np.frombuffer(body, ">f4" if bits <= 32 else ">f8").astype(np.float64)
    elif base == QUANTISED:
        low, high = np.frombuffer(body[:16], ">f8")
        x = low + _unpacked(body[16:], n, bits) * (high - low) / ((1 << bits) - 1)
    else:
        codes = _unpacked(body, n, bits).astype(np.int64)
        x = np.where(codes >= 1 << (bits - 1), codes - (1 << bits), codes).astype(np.float64) if base == SIGNED else codes.astype(np.float64)
    return [None if m else float(v) for m, v in zip(gone, x, strict=True)] if size else x.tolist()


def encoded(field: Column, kind: int, bits: int) -> Column:
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else encode_values(v, kind, bits))

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "binary")(field)


def decoded(payload: Column, n: Column, kind: Column, bits: Column) -> Column:
    def run(p: pd.Series, n: pd.Series, k: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else decode_values(x, int(m), int(t), int(w)) for x, m, t, w in zip(p, n, k, b, strict=True)])

    run.__annotations__ = {"p": pd.Series, "n": pd.Series, "k": pd.Series, "b": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "array<double>")(payload, n, kind, bits)


def write(records: DataFrame, path: str, kind: int = IEEE, bits: int = 32, field: str = "field") -> None:
    """Append records (handle, descriptors, field); the version is the write's time in nanoseconds, later for a later write."""
    out = records.withColumns({"n": F.size(field), "datyp": F.lit(kind), "nbits": F.lit(bits), "version": F.lit(time.time_ns()), "payload": encoded(F.col(field), kind, bits)})
    out.drop(field).write.mode("append").parquet(path)


def append(spark: SparkSession, source: str, target: str) -> None:
    """Adds the live records of one store to another as its latest, if both have the same columns; else nothing is written."""
    kinds = [{f.name: f.dataType for f in spark.read.parquet(path).schema} for path in (source, target)]
    if kinds[0] != kinds[1]:
        raise ValueError(f"{source} and {target} have different columns")
    open_store(spark, source).withColumn("version", F.lit(time.time_ns())).write.mode("append").parquet(target)


def open_store(spark: SparkSession, path: str) -> DataFrame:
    """The directory of live records: the last version of each handle.  Handles and versions alone find it, not the payloads."""
    rows = spark.read.parquet(path)
    last = rows.groupBy("handle").agg(F.max("version").alias("version"))
    return rows.join(last, ["handle", "version"], "left_semi")


def fields(directory: DataFrame, into: str = "field") -> DataFrame:
    return directory.withColumn(into, decoded(F.col("payload"), F.col("n"), F.col("datyp"), F.col("nbits"))).drop("payload")


def valid_date(origin: Column, step_seconds: Column, steps: Column) -> Column:
    """Validity time of a record: its origin and as many steps."""
    return F.timestamp_seconds(F.unix_seconds(origin.cast("timestamp")) + step_seconds * steps)
