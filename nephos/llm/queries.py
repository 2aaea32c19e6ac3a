"""Queries of this subpackage and the SQL that says the same, where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from nephos.llm import bpe, exact, language, lattice, minhash, mixing, secrets, sharding, toxicity, webpages
from nephos.llm.common import table


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


QUERIES = {
    "op1_mixing": lambda spark, d: mixing.digest(_documents(spark, d)),
    "op2_e8_lattice": lambda spark, d: lattice.digest(table(spark, d, "embeddings")),
    "op3_exact_digest": lambda spark, d: exact.digest(_documents(spark, d)),
    "op4_bpe": lambda spark, d: bpe.digest(_documents(spark, d)),
    "op5_language": lambda spark, d: language.digest(_documents(spark, d)),
    "op6_main_text": lambda spark, d: webpages.digest(table(spark, d, "pages")),
    "op7_toxicity": lambda spark, d: toxicity.digest(_documents(spark, d), table(spark, d, "labels")),
    "op8_secret_scan": lambda spark, d: secrets.digest(_documents(spark, d)),
    "op9_minhash": lambda spark, d: minhash.digest(_documents(spark, d)),
    "op10_jump_shards": lambda spark, d: sharding.digest(_documents(spark, d)),
}
ORACLE_SQL: dict[str, str] = {"op1_mixing": mixing.oracle()}
