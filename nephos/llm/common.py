"""What every operator of this subpackage shares: reading, batch sizes, lineage cuts."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import uuid

import pyarrow
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a Python worker is handed at once, at most; a longer text comes alone.
BATCH_ROWS, BATCH_BYTES = 400, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Whole texts can be long, so hand Python workers few rows and few bytes at a time; a session's lower bounds stay."""
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
        if now <= 0 or now > most:
            spark.conf.set(name, str(most))


def unused(name: str, *frames: DataFrame) -> str:
    """A column name like this one that none of the frames has."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_fields(df: DataFrame, struct: Column, names: list[str]) -> DataFrame:
    """df with the struct's fields of these names as its last columns, in place of those that it has by those names."""
    kept = [c for c in df.columns if c.lower() not in {n.lower() for n in names}]
    made = unused("_made", df)
    return df.withColumn(made, struct).select(*[F.col(f"`{c}`") for c in kept], *[F.col(f"{made}.{n}") for n in names])


def local_rows(spark: SparkSession, rows: list[tuple], names: list[str], types: list[pyarrow.DataType]) -> DataFrame:
    """A small table of the driver's, sent as Arrow, so that no Python worker starts for it."""
    columns = [pyarrow.array([r[i] for r in rows], t) for i, t in enumerate(types)]
    return spark.createDataFrame(pyarrow.table(columns, names))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def gathered(df: DataFrame) -> DataFrame:
    """df with an eighth of the shuffle's partitions, but three for each core: a small table's many files cost more than its rows.

    Partitions are gone through one after the other, so a task holds no more at a time than before.
    """
    spark = df.sparkSession
    return df.coalesce(max(3 * spark.sparkContext.defaultParallelism, partitions(spark) // 8))


def cut(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared checkpoint folder and read it from there, so that a lost executor costs no lineage.

    The folder goes with the process that made it.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = context.getConf().get("spark.checkpoint.dir")
        if shared is None and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="nephos-checkpoint-"))
    path = f"{context.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, context, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(context, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended
        where = context._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def released(batches):
    """The batches, then the memory that making them left free goes back to the system: workers live on between stages."""
    yield from batches
    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # the C library has no trim everywhere
        ctypes.CDLL(None).malloc_trim(0)
