"""A key-value store and a catalogue of named arrays, as tables of entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nephos.functions.columns import unused


def entries(rows: DataFrame) -> DataFrame:
    """Rows (name, value, ...) with the names' case folded."""
    return rows.withColumn("name", F.upper("name"))


def keys(store: DataFrame, head: str) -> DataFrame:
    """Entries whose name starts so, in either case."""
    return store.where(F.col("name").startswith(head.upper()))


def get(store: DataFrame, name: str) -> DataFrame:
    return store.where(F.col("name") == name.upper())


def last_written(writes: DataFrame, turn: str) -> DataFrame:
    """What stands after writes in order: the first of a name stays unless its entry is rewritable."""
    w = Window.partitionBy("name")
    folded = entries(writes)
    first = F.min(F.struct(turn, "rewritable")).over(w)["rewritable"]
    keep = F.when(first, F.max(turn).over(w)).otherwise(F.min(turn).over(w))
    k = unused("_k", folded)
    return folded.withColumn(k, keep).where(F.col(turn) == F.col(k)).drop(k)


def put(store: DataFrame, more: DataFrame) -> DataFrame:
    """Entries of more take the place of those with the same name."""
    more = entries(more)
    return store.join(more.select("name"), "name", "left_anti").unionByName(more)


def halo(low: Column, high: Column, width: Column) -> tuple[Column, Column]:
    """Bounds of an array dimension with its halo."""
    return low - width, high + width


def directives(lines: DataFrame, line: str = "line") -> DataFrame:
    """Directive lines NAME = value, value or NAME(value, ...) as name and arguments; comments and others go."""
    text = F.trim(F.regexp_replace(line, r"[!#].*$", ""))
    name = F.upper(F.regexp_extract(text, r"^([A-Za-z_]\w*)\s*[=(]", 1))
    body = F.regexp_extract(text, r"^[A-Za-z_]\w*\s*[=(]\s*(.*?)\)?\s*$", 1)
    args = F.filter(F.transform(F.split(body, ","), lambda x: F.trim(F.regexp_replace(F.trim(x), "^['\"]|['\"]$", ""))), lambda x: x != "")
    return lines.select(name.alias("name"), args.alias("args")).where("name <> ''")


def rename(arrays: DataFrame, old: str, new: str) -> DataFrame:
    """A named array under another name, if that is free."""
    taken = arrays.where(F.col("name") == new).agg(F.count("*") > 0).scalar()
    return arrays.withColumn("name", F.when((F.col("name") == old) & ~taken, new).otherwise(F.col("name")))


def shuffled(arrays: DataFrame, names: list[str]) -> DataFrame:
    """Names turned round: the array of each name takes the one after it, the last the first."""
    after = dict(zip(names, [*names[1:], names[0]], strict=True))
    chain = F
    for old, new in after.items():
        chain = chain.when(F.col("name") == old, new)
    return arrays.withColumn("name", chain.otherwise(F.col("name")) if names else F.col("name"))


def locked(store: DataFrame, head: str) -> DataFrame:
    """Entries under a head that were rewritable until locked are read-only from now on."""
    hit = F.col("name").startswith(head.upper()) & F.col("rewritable")
    return store.withColumn("rewritable", F.when(hit, False).otherwise(F.col("rewritable")))


def checkpoint(store: DataFrame, path: str) -> None:
    store.write.mode("overwrite").parquet(path)


def reload(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)


def jar_put(jar: Column, items: Column, at: Column) -> Column:
    """A jar of elements with items from a 1-based place: gaps are zeros and what was beyond is cut off."""
    have = F.size(jar)
    kept = F.slice(jar, F.lit(1), F.least(have, at - 1))
    gap = F.array_repeat(F.lit(0).cast("long"), F.greatest(at - 1 - have, F.lit(0)))
    return F.concat(kept, gap, items)


def jar_get(jar: Column, at: Column, count: Column) -> Column:
    """count elements from a place, null if the jar holds fewer."""
    return F.when(at + count - 1 <= F.size(jar), F.slice(jar, at, count))
