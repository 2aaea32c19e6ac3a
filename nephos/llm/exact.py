"""Canonical exact digests: texts are equal when their canonical forms are, byte for byte.

The canonical form is NFKC, case-folded, NFKC again, white space runs folded to one space and trimmed.  Its
128-bit xxh3 hash groups texts; where a hash value has several rows, the canonical bytes are compared, and
should two forms ever share a hash, the later in byte order gets a suffix of its own.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nephos.llm.common import cut, partitions, small_batches

#: Ids of rows with an equal hash are broadcast up to this many, and joined by shuffle beyond it.
BROADCAST_IDS = 2_000_000
LOWEST = -(2**63)


def canonical(text: str) -> str:
    if not text.isascii():
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    else:
        text = text.lower()
    return " ".join(text.split())


def digest_of(form: str) -> str:
    return xxhash.xxh3_128_hexdigest(form.encode("utf-8", "surrogatepass"))


def name_of(text: str, collided: dict[str, list[str]]) -> str:
    return name_of_form(canonical(text), collided)


def name_of_form(form: str, collided: dict[str, list[str]]) -> str:
    """Digest of a canonical form, with its place among those that share the digest, if not the first."""
    digest = digest_of(form)
    if digest in collided and (place := collided[digest].index(form) if form in collided[digest] else len(collided[digest])):
        return f"{digest}-{place}"
    return digest


def digest_column(text: str):
    return F.pandas_udf(lambda s: s.map(lambda x: digest_of(canonical(x or ""))), "string")(F.col(text))


def canonical_column(text: str):
    return F.pandas_udf(lambda s: s.map(lambda x: canonical(x or "")), "string")(F.col(text))


def collisions(docs: DataFrame, key: str = "doc_id", text: str = "text") -> dict[str, list[str]]:
    """Digests that stand for several canonical forms, with those forms in order; empty unless xxh3 collides.

    Bytes are compared by grouping on them: copies fold before the shuffle, so a hot digest moves one form
    from each task.
    """
    spark = docs.sparkSession
    small_batches(spark)
    digests = cut(docs.select(F.col(key).alias("_key"), digest_column(text).alias("digest")))
    # A hot digest is one row here; where the rows are few enough they go to its members, not its members to one task.
    repeated = cut(digests.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest"))
    few = repeated.count() <= BROADCAST_IDS
    members = cut(digests.join(F.broadcast(repeated) if few else repeated, "digest", "left_semi").select("_key").distinct())
    few = members.count() <= BROADCAST_IDS
    inside = docs.join(F.broadcast(members) if few else members, F.col(key).eqNullSafe(F.col("_key")), "left_semi")
    forms = (
        inside.select(digest_column(text).alias("digest"), canonical_column(text).alias("form"))
        .groupBy("digest", "form")
        .agg(F.count("*").alias("copies"))
    )
    several = forms.groupBy("digest").agg(F.count("*").alias("forms")).where("forms > 1").select("digest")
    found: dict[str, list[str]] = {}
    doubled = several.collect()
    if doubled:
        wanted = [r["digest"] for r in doubled]
        for r in forms.where(F.col("digest").isin(wanted)).select("digest", "form").collect():
            found.setdefault(r["digest"], []).append(r["form"])
    return {k: sorted(v) for k, v in found.items()}


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", into: str = "fingerprint") -> DataFrame:
    """Add a fingerprint that two rows share exactly if their canonical texts are equal.

    Null texts count as empty and equal one another; repeated rows share a fingerprint; no rows give no
    rows; a column named like the new one is replaced, all others stay.
    """
    clash = collisions(docs, key, text)
    named = F.pandas_udf(lambda s: s.map(lambda x: name_of(x or "", clash)), "string")
    return docs.withColumn(into, named(F.col(text)))


def _edges(docs: DataFrame, buckets: int) -> np.ndarray:
    share = [i / buckets for i in range(1, buckets)]
    row = docs.select(F.percentile_approx("doc_id", share, 20000).alias("at")).first()
    return np.unique(np.array(row["at"] or [], dtype=np.int64))


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (bucket, halo, rank, text), where rank is doc_id or LOWEST for null, sorted so that each row's follower by descending doc_id comes after it.

    Buckets are ranges of doc_id.  The first row of the range below is added to each as a halo row, and the
    first row of all to the lowest, so a text moves once and the order needs no single task.
    """
    spark = docs.sparkSession
    width = partitions(spark)
    edges = _edges(docs, 4 * width)
    ranged = F.pandas_udf(lambda k: pd.Series(np.searchsorted(edges, k.to_numpy(), side="right")), "int")
    keyed = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("doc_id", F.lit(LOWEST)).alias("rank"))
    bucketed = keyed.withColumn("bucket", ranged("rank"))
    tops = sorted((r["bucket"], r["top"]) for r in bucketed.groupBy("bucket").agg(F.max("rank").alias("top")).collect())
    copies = {top: tops[(i + 1) % len(tops)][0] for i, (_, top) in enumerate(tops)}
    into = F.pandas_udf(lambda k: pd.Series([copies.get(int(x), -1) for x in k]), "int")
    halo = bucketed.withColumn("also", into("rank"))
    both = F.array(
        F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("halo")), F.struct(F.col("also").alias("bucket"), F.lit(1).alias("halo"))
    )
    dealt = halo.withColumn("to", F.explode(F.filter(both, lambda x: x["bucket"] >= 0))).select(
        "to.bucket", "to.halo", "rank", "text"
    )
    order = ["bucket", "halo", F.col("rank").desc(), F.xxhash64("text")]
    return dealt.repartition(width, "bucket").sortWithinPartitions(*order)


def compared(rank: int, text: str, following: str, clash: dict[str, list[str]]) -> tuple:
    """What op3 returns of a document and the text that follows it."""
    half = len(text) // 2
    edited = text[: len(text) - half] + following[:half]
    form, changed = canonical(text), canonical(edited)
    sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    own = name_of_form(form, clash)
    # Likeness is by the forms themselves.  An edited form that only shares the digest gets a mark that no document has.
    other = name_of_form(changed, clash)
    if other == own and changed != form:
        other += "-edited"
    same = following == text or canonical(following) == form
    return (None if rank == LOWEST else int(rank), len(text), sha, own, other, float(form == changed), float(same))


def digest(docs: DataFrame) -> DataFrame:
    """The rows that op3 returns."""
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    clash = collisions(docs)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            out = []
            for halo, rank, text in zip(batch["halo"], batch["rank"], batch["text"], strict=True):
                if held is not None:
                    out.append(compared(*held, text, clash))
                    held = None
                if not halo:
                    held = (rank, text)
            yield pd.DataFrame(out, columns=[x.split()[0] for x in OUT.split(", ")]).astype({"doc_id": "Int64"})

    return with_next(docs).mapInPandas(rows, OUT)


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
