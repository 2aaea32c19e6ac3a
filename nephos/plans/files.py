"""Queries of record files: written, searched, checked and erased in a folder that executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import functions as F

from nephos.plans.base import r4, read
from nephos.sources import recordfile


def shared_folder(spark, name: str) -> str:
    """A new folder in the cluster's shared one, which goes with the process that made it."""
    context = spark.sparkContext
    shared = context.getConf().get("spark.checkpoint.dir")
    if shared is None and not context.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    top = f"{(shared or tempfile.gettempdir()).removeprefix('file://')}/nephos-{name}-{uuid.uuid4().hex}"
    atexit.register(shutil.rmtree, top, ignore_errors=True)
    return top


def _records(spark, d):
    """Embeddings as records of 8 by 8: 32-bit and 64-bit reals, and signed whole numbers of 13 bits."""
    n = F.col("vec_id")
    kind = n % 3
    field = F.transform("embedding", lambda x: F.when(kind == 2, F.round(x.cast("double") * 1000)).otherwise(x.cast("double")))
    return read(spark, d, "embeddings").select(
        F.element_at(F.array(F.lit("WAVE"), F.lit("tt"), F.lit("U?_1")), (kind + 1).cast("int")).alias("nomvar"), F.lit("P").alias("typvar"), F.concat(F.lit("label "), (n % 100).cast("string")).alias("etiket"), F.lit("X").alias("grtyp"),
        F.lit(8).alias("ni"), F.lit(8).alias("nj"), F.lit(1).alias("nk"), n.cast("int").alias("ip1"), (n * 3).cast("int").alias("ip2"), (n % 5).cast("int").alias("ip3"), (n * 70_001 % (1 << 24)).cast("int").alias("ig2"), (n % 9).cast("int").alias("ig4"),
        (F.lit(442_998_800) + n * 10).alias("date_stamp"), F.lit(300).alias("deet"), (n % 7).cast("int").alias("npas"), F.when(kind == 2, 4).otherwise(5).alias("datyp"), F.when(kind == 0, 32).when(kind == 1, 64).otherwise(13).alias("nbits"), field.alias("field"),
    )


def _written(spark, d):
    recordfile.register(spark)
    top = shared_folder(spark, "records")
    _records(spark, d).write.format("records").mode("append").save(top)
    return top


def record_file_read(spark, d):
    top = _written(spark, d)
    r = spark.read.format("records").load(top).where("nomvar IN ('WAVE', 'U?_1') AND ip3 <> 2")
    total = F.aggregate("field", F.lit(0.0), lambda a, x: a + x)
    return r.select("nomvar", "typvar", "etiket", "grtyp", "ip1", "ip2", "ip3", "ig2", "ig4", "date_stamp", "npas", "datyp", "nbits", "length", r4(total).alias("total"), r4(F.get("field", F.lit(9))).alias("tenth"))


def record_file_erase(spark, d):
    """Every seventh record erased where its file is, and the rest read by descriptors only."""
    top = _written(spark, d)
    rows = spark.read.format("records").option("fields", "false").load(top)
    erased = recordfile.erase_rows(rows.where("ip1 % 7 = 0"), top).agg(F.sum("n")).first()[0]
    left = spark.read.format("records").option("fields", "false").load(top).groupBy("erased").agg(F.count("*").alias("n"), F.sum("ip1").alias("ip1"))
    sound = recordfile.check(spark, top).agg(F.sum("records").alias("records"), F.sum("erasures").alias("erasures"), F.every("sound").alias("sound"))
    return left.crossJoin(F.broadcast(sound)).withColumn("done", F.lit(erased).cast("long"))  # sound is one row


def record_file_keys(spark, d):
    """The 18 words of each record's keys, less those of length and address."""

    def words(batches):
        for batch in batches:
            found = [recordfile.entry({k: None if v != v else v for k, v in r.items()}, 0, 0)[2:] for r in batch.drop(columns="field").to_dict("records")]
            batch = batch[["ip1"]].copy()
            batch["words"] = [",".join(map(str, w)) for w in found]
            yield batch

    return _records(spark, d).mapInPandas(words, "ip1 int, words string")


QUERIES = {f.__name__: f for f in (record_file_read, record_file_erase, record_file_keys)}


def _six(text: str, count: int, first: int = 1) -> str:
    """Letters of six bits each as a number."""
    letters = [f"((CASE WHEN ascii(substr(rpad(upper({text}), 12, ' '), {first + k}, 1)) > 0 THEN ascii(substr(rpad(upper({text}), 12, ' '), {first + k}, 1)) END - 32) & 63) * {64 ** (count - 1 - k)}::BIGINT" for k in range(count)]
    return "(" + " + ".join(letters) + ")"


_R = """r AS (SELECT vec_id AS n, vec_id % 3 AS k, ['WAVE', 'tt', 'U?_1'][vec_id % 3 + 1] AS nomvar, 'label ' || (vec_id % 100) AS etiket, vec_id * 70001 % 16777216 AS ig2, 442998800 + vec_id * 10 AS stamp, CASE vec_id % 3 WHEN 0 THEN 32 WHEN 1 THEN 64 ELSE 13 END AS nbits, CASE WHEN vec_id % 3 = 2 THEN 4 ELSE 5 END AS datyp,
    list_transform(embedding, lambda x: CASE WHEN vec_id % 3 = 2 THEN round(x::DOUBLE * 1000) ELSE x::DOUBLE END) AS field FROM embeddings)"""
_WORDS = [
    "300 * 256 + nbits", "8 * 256 + ascii('X')", "8 * 256 + datyp", "4096", "n % 7 * 64", "n % 9 * 256 + ig2 // 65536", "ig2 // 256 % 256", "ig2 % 256", f"{_six('etiket', 5)} * 4", f"{_six('etiket', 5, 6)} * 4",
    f"{_six('etiket', 2, 11)} * 1048576 + {_six("'P'", 2)} * 256", f"{_six('nomvar', 4)} * 256", "n * 16", "n * 48", "n % 5 * 16", "stamp // 10 * 8 + stamp % 10",
]
ORACLE_SQL = {
    "record_file_read": f"""WITH {_R} SELECT nomvar, 'P' AS typvar, upper(etiket) AS etiket, 'X' AS grtyp, n::INTEGER AS ip1, (n * 3)::INTEGER AS ip2, (n % 5)::INTEGER AS ip3, ig2::INTEGER AS ig2, (n % 9)::INTEGER AS ig4, stamp AS date_stamp, (n % 7)::INTEGER AS npas, datyp, nbits, (10 + (64 * nbits + 183) // 64)::BIGINT AS length,
        round(list_sum(field), 4) AS total, round(field[10], 4) AS tenth FROM r WHERE k <> 1 AND n % 5 <> 2""",
    "record_file_erase": """WITH e AS (SELECT vec_id % 7 = 0 AS erased, count(*) AS n, sum(vec_id)::BIGINT AS ip1 FROM embeddings GROUP BY 1) SELECT erased, n, ip1, (SELECT sum(n) FROM e WHERE NOT erased)::BIGINT AS records, (SELECT sum(n) FROM e WHERE erased)::BIGINT AS erasures, true AS sound, (SELECT sum(n) FROM e WHERE erased)::BIGINT AS done FROM e""",
    "record_file_keys": f"WITH {_R} SELECT n::INTEGER AS ip1, {" || ',' || ".join(f'({w})::BIGINT' for w in _WORDS)} AS words FROM r",
}
