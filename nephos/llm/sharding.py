"""Sharding by jump consistent hashing (Lamping and Veach, 2014).

A row's stable key alone decides its sequence of jumps; its shard among n is the last jump below n.  So one
more shard only draws rows into itself, and no ring table exists.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nephos.llm.common import partitions

#: Multiplier of the generator in the published algorithm.
JUMP_MULTIPLIER = 2862933555777941757
#: Counts of blocks are broadcast up to this many, and joined by shuffle beyond it.
BROADCAST_BLOCKS = 1_000_000


def jump(keys: np.ndarray, counts: tuple[int, ...]) -> list[np.ndarray]:
    """The shard of every 64-bit key for each shard count."""
    state = keys.astype(np.uint64)
    shards = [np.zeros(len(state), np.int32) for _ in counts]
    at = np.zeros(len(state), np.float64)
    live = np.arange(len(state))
    while len(live):
        for n, shard in zip(counts, shards, strict=True):
            below = at[live] < n
            shard[live[below]] = at[live[below]].astype(np.int32)
        with np.errstate(over="ignore"):
            state[live] = state[live] * np.uint64(JUMP_MULTIPLIER) + np.uint64(1)
        draw = (state[live] >> np.uint64(33)).astype(np.float64) + 1.0
        at[live] = np.floor((at[live] + 1.0) * (2147483648.0 / draw))
        live = live[at[live] < max(counts)]
    return shards


def _hashable(rows: DataFrame) -> list[Column]:
    """The columns that a hash can take, for telling rows of one key apart."""
    return [F.col(f"`{f.name}`") for f in rows.schema if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]


def assign(rows: DataFrame, key: str = "doc_id", shards: int = 16) -> DataFrame:
    """Add shard, slot, a gapless number within the shard from 0, and grown_shard (with one shard more).

    The hash of the key column decides the shard.  Null keys share one shard.  Equal keys share a shard and
    get slots of their own.  No rows give no rows; the columns shard, grown_shard and slot are replaced, all others stay.
    Slots are dealt in blocks: rows are numbered inside (shard, block), and the blocks' counts, of which
    there are a fixed number, give the first slot of each, so that no task holds a whole shard.  A row's
    block comes from all its columns, so rows of one key, or of none, are dealt over the blocks as well.
    """
    blocks = partitions(rows.sparkSession)
    named = {"shard", "grown_shard", "slot"}
    rows = rows.select(*[F.col(f"`{c}`") for c in rows.columns if c.lower() not in named])

    def jumped(keys: pd.Series) -> pd.DataFrame:
        now, grown = jump(keys.to_numpy().view(np.uint64), (shards, shards + 1))
        return pd.DataFrame({"shard": now, "grown_shard": grown})

    to = F.pandas_udf(jumped, "shard int, grown_shard int")
    # The caller's columns travel as one, so none can clash with those made here.
    packed = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), F.col(f"`{key}`").alias("key"), F.xxhash64(*_hashable(rows)).alias("mark"))
    placed = packed.withColumn("to", to(F.xxhash64("key"))).select("row", "key", "mark", "to.shard", "to.grown_shard", F.pmod("mark", F.lit(blocks)).cast("int").alias("block"))
    counts = placed.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    if shards * blocks <= BROADCAST_BLOCKS:
        first = F.broadcast(first)
    inside = Window.partitionBy("shard", "block").orderBy("key", "mark")
    numbered = placed.withColumn("at", F.row_number().over(inside) - 1).join(first, ["shard", "block"])
    return numbered.select("row.*", "shard", "grown_shard", (F.col("first") + F.col("at")).alias("slot"))


def digest(documents: DataFrame, shards: int = 16) -> DataFrame:
    """The rows that op10 returns."""
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = documents.select(
        "doc_id",
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    return assign(sized, "doc_id", shards).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard"
    )
