"""The corpus pipeline: five stages from raw documents to token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nephos.llm import bpe, language, minhash, mixing, secrets
from nephos.llm.common import cut, unused


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go; lang becomes the predicted one.

    Null and empty texts and those without a letter have none.  Repeated rows stay or go together, columns of any name stay, no
    rows give no rows; so it is with each stage.
    """
    model = language.train(docs.where(~language.held_out()))
    name, score = unused("_lang", docs), unused("_score", docs)
    found = language.identify(docs, model, into=(name, score)).where(F.col(name) != language.UNDETERMINED)
    return found.withColumn("lang", F.col(name)).select(*[F.col(f"`{c}`") for c in docs.columns])


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the smallest key, on runs of five words.

    Texts without words are near nothing and stay, as do rows without a key; rows that repeat a kept key all stay.
    """
    return minhash.deduplicated(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets give way to a mark and n_chars follows; no document goes, and null texts stay null."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn so that half of the tokens stay and meet the targets of source, language and topic.

    Null margins are a name of their own; the key alone decides a row's draw, so rows that repeat it stay or go together.
    """
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text; null and empty texts have none, and no row goes."""
    return bpe.encode(docs).select("doc_id", "lang", "source", "n_chars", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language ID", identify_language),
    ("MinHash near-dedup", remove_near_duplicates),
    ("secret scans", redact_secrets),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode),
]
#: Automata, minhashes and byte-pair merges are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage.  What a stage returns is written and read again before the next, as each reads it more than once."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
