"""MinHash near-duplicates by tensored banding.

A few collections of minhashes are computed; every pair of collections makes one table key.  So n collections
give n (n - 1) / 2 tables, and the number of minhashes needed falls to about a square root.  Two sets meet in
a table if they agree in any two collections.  Links are confirmed on the full sets.

Only connectivity is asked for, so a bucket is never expanded while its members are joined already: members
are first compared with their bucket's most central member, then with leaders drawn anew.  What then is still
apart from most of its bucket is held against all of it by odd sketches (Mitzenmacher et al., 2014): the
parity bits of two sets differ in no more places than the sets have elements apart, so a pair whose bits
differ in too many is not linked, and only the others are compared in full.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nephos.llm.common import cut, gathered, partitions, released, small_batches, unused
from nephos.llm.components import components

#: Collections of minhashes, and minhashes in each.  At a Jaccard likeness of 0.8 a pair misses all tables
#: with probability 0.00018, at 0.85 with 0.000006, at 0.9 with 0.00000004.
COLLECTIONS, WIDTH = 16, 3
#: Rounds of leaders before what is apart in a bucket is compared pair by pair.
LEADER_ROUNDS = 2
#: 64-bit words of an odd sketch.
ODD_WORDS = 16
#: Ids broadcast to pick texts up to this many, and joined by shuffle beyond it.
BROADCAST_IDS = 2_000_000
#: Sets a worker keeps while it confirms links.
REMEMBERED_WORDS = 1_000_000

_seeds = np.random.default_rng(20_240_901)
_MIX = _seeds.integers(1, 2**63, size=16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP = _seeds.integers(0, 2**63, size=COLLECTIONS * WIDTH, dtype=np.uint64)
_TURN = _seeds.integers(1, 2**63, size=COLLECTIONS * WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of so many words; a shorter text is one run; no words, none."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    if len(found) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(found), seed=len(found))], np.uint64)
    each = np.array(list(map(xxhash.xxh3_64_intdigest, found)), np.uint64)
    n = len(each) - words + 1
    mixed = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(words):
            mixed += each[i : i + n] * _MIX[i]
        mixed ^= mixed >> np.uint64(29)
        mixed *= _MIX[-1]
        mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def collections_of(found: np.ndarray) -> np.ndarray:
    """One 64-bit key for each collection: its minhashes, hashed together."""
    with np.errstate(over="ignore"):
        least = np.array([((found ^ f) * t).min() for f, t in zip(_FLIP, _TURN, strict=True)], np.uint64).reshape(COLLECTIONS, WIDTH)
        keys = least[:, 0] * _MIX[0]
        for i in range(1, WIDTH):
            keys = (keys ^ (keys >> np.uint64(31)) ^ least[:, i]) * _MIX[i]
    return keys.view(np.int64)


def odd_sketch(found: np.ndarray) -> np.ndarray:
    """Parity, for each of the sketch's bits, of the number of elements that fall on it."""
    bits = np.bincount((found >> np.uint64(20)).astype(np.int64) % (64 * ODD_WORDS), minlength=64 * ODD_WORDS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """(id, n, whole, keys, odd): the size of each text's set, a digest of all of it, its collections' keys and odd sketch."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["id"], batch["text"], strict=True):
                found = shingles(text, words)
                whole = xxhash.xxh3_128_digest(found.tobytes())
                out.append((doc_id, len(found), whole, collections_of(found) if len(found) else [], odd_sketch(found)))
            yield pd.DataFrame(out, columns=["id", "n", "whole", "keys", "odd"])

    return docs.mapInPandas(lambda batches: released(made(batches)), "id long, n long, whole binary, keys array<long>, odd array<long>")


def confirmed(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of the pairs (u, v) whose full sets are alike."""
    ids = cut(gathered(pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct()))
    few = ids.count() <= BROADCAST_IDS
    texts = docs.join(F.broadcast(ids) if few else ids, "id", "left_semi")
    both = pairs.join(texts.select(F.col("id").alias("u"), F.col("text").alias("a")), "u").join(
        texts.select(F.col("id").alias("v"), F.col("text").alias("b")), "v"
    )

    def kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[int, np.ndarray] = {}
        held = 0
        for batch in batches:
            good = []
            for u, v, a, b in zip(batch["u"], batch["v"], batch["a"], batch["b"], strict=True):
                for key, text in ((u, a), (v, b)):
                    if key not in known:
                        if held > REMEMBERED_WORDS:
                            known.clear()
                            held = 0
                        known[key] = shingles(text, words)
                        held += len(known[key])
                    if key == u:
                        first = known[key]
                good.append(alike(first, known[v] if v in known else shingles(b, words), percent))
            yield batch.loc[good, ["u", "v"]]

    return both.mapInPandas(lambda batches: released(kept(batches)), "u long, v long")


def _links(docs: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame | None:
    """(id, component) of the classes that are linked with another."""
    pairs_of = [F.xxhash64(F.lit(i), F.lit(j), F.col("keys")[i], F.col("keys")[j]) for i, j in combinations(range(COLLECTIONS), 2)]
    rows = classes.select("id", F.col("n").cast("int").alias("n"), F.explode(F.array(*pairs_of)).alias("key"))
    shared = cut(gathered(rows.groupBy("key").agg(F.count("*").alias("k")).where("k > 1")))
    if not shared.count():
        return None
    members = cut(gathered(rows.join(shared, "key").select("key", "id", "n", "k")))
    # The more members share its keys, the more central a class is.
    central = members.groupBy("id").agg(F.sum("k").alias("g"))
    members = cut(gathered(members.drop("k").join(central, "id")))
    labels = tested = None
    near = F.least("n", "m") * 100 >= F.greatest("n", "m") * percent
    for turn in range(LEADER_ROUNDS + 1):
        if labels is None:
            here = members.withColumn("c", F.col("id"))
        else:
            named = labels.withColumnRenamed("component", "_c")
            here = cut(gathered(members.join(named, "id", "left").select("key", "id", "n", "g", F.coalesce("_c", "id").alias("c"))))
            apart = here.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("key")
            here = cut(gathered(here.join(apart, "key").select("key", "id", "n", "g", "c")))
            members = here.drop("c")
        if turn < LEADER_ROUNDS:
            drawn = F.struct((-F.col("g") if turn == 0 else F.xxhash64("id", F.lit(turn))).alias("h"), "id", "n", "c")
            lead = here.groupBy("key").agg(F.min(drawn).alias("x")).select(
                "key", F.col("x.h").alias("h"), F.col("x.id").alias("v"), F.col("x.n").alias("m"), F.col("x.c").alias("d")
            )
            found = here.join(lead, "key").where((F.col("c") != F.col("d")) & near)
            if turn == 0:
                found = found.groupBy("id").agg(F.min(F.struct("h", "v"))["v"].alias("v"))
        else:
            found = _apart(here, classes.select("id", "odd"), near, percent)
        found = found.select(F.greatest("id", "v").alias("u"), F.least("id", "v").alias("v")).distinct()
        if tested is not None:
            found = found.join(tested, ["u", "v"], "left_anti")
        found = cut(gathered(found))
        if found.count():
            tested = found if tested is None else tested.union(found)
            links = cut(gathered(confirmed(found, docs, words, percent)))
            labels = _merged(labels, links)
    return labels


def _apart(here: DataFrame, odd: DataFrame, near, percent: int) -> DataFrame:
    """Pairs (id, v) within a bucket of a member that is not in the bucket's largest component with one of another
    component, but for those whose odd sketches show that they are not linked."""
    sizes = here.groupBy("key", "c").agg(F.count("*").alias("k"))
    most = sizes.groupBy("key").agg(F.max(F.struct("k", "c"))["c"].alias("most"))
    drawn = cut(gathered(here.select("key", "id", "n", "c").join(odd, "id").join(most, "key")))
    left = drawn.where("c <> most").drop("most")
    right = drawn.select("key", "most", F.col("id").alias("v"), F.col("n").alias("m"), F.col("c").alias("d"), F.col("odd").alias("parity"))
    differ = reduce(lambda a, b: a + b, [F.bit_count(F.col("odd")[i].bitwiseXOR(F.col("parity")[i])) for i in range(ODD_WORDS)])
    # 100 (S - D) >= percent (S + D) for sizes that sum to S and sets that are D elements apart.
    close = differ * (100 + percent) <= (F.col("n") + F.col("m")) * (100 - percent)
    once = (F.col("id") > F.col("v")) | (F.col("d") == F.col("most"))
    met = left.join(right, "key").where((F.col("c") != F.col("d")) & once & near & close)
    return met.select("id", "v")


def _merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components after more links: the old components are the nodes, so the work follows the new links."""
    if labels is None:
        return cut(gathered(components(links)))
    for end in ("u", "v"):
        named = labels.select(F.col("id").alias(end), F.col("component").alias("_c"))
        links = links.join(named, end, "left").withColumn(end, F.coalesce("_c", end)).drop("_c")
    links = cut(gathered(links))
    if not links.count():
        return labels
    over = cut(gathered(components(links)))
    old = labels.select("id", F.col("component").alias("at")).join(over.select(F.col("id").alias("at"), F.col("component").alias("to")), "at", "left")
    fresh = over.join(labels.select("id"), "id", "left_anti")
    return cut(gathered(old.select("id", F.coalesce("to", "at").alias("component")).union(fresh.select("id", "component"))))


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, percent: int = 80) -> DataFrame:
    """(key, n_shingles, component_id, kept) for every row: the groups of near-duplicates.

    Two texts are linked if 100 * |A & B| >= percent * |A | B| for their sets of word runs.  Equal sets are
    one class and only classes are compared.  A null text, or one without words, has an empty set, links with
    nothing and is kept.  Rows without a key link with nothing and are kept, with a null component.  Rows that
    repeat a key count as one node and each gets a row.  No rows give no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    named = docs.where("id IS NOT NULL")
    sets = cut(sketches(named, words))
    full = sets.where("n > 0")
    # Each class makes many table rows, so classes are dealt finely before they do.
    classes = cut(full.groupBy("whole").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("odd").alias("odd")).repartition(4 * partitions(spark)))
    labels = _links(named, classes, words, percent)
    place = classes.select("whole", F.col("id").alias("class"))
    if labels is not None:
        place = cut(gathered(place.join(labels.select(F.col("id").alias("class"), "component"), "class", "left").select("whole", F.coalesce("component", "class").alias("class"))))
    linked = full.join(place, "whole").select("id", "n", F.col("class").alias("component_id"))
    rest = sets.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
    unnamed = docs.where("id IS NULL").select("id", F.lit(None).cast("long").alias("n"), F.lit(None).cast("long").alias("component_id"))
    return linked.union(rest).union(unnamed).select(
        F.col("id").alias(key),
        F.coalesce("n", F.lit(0).cast("long")).alias("n_shingles"),
        "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group of near-duplicates: that with the smallest key; rows that repeat that key all stay."""
    found = groups(docs, key, text, words, percent)
    name = unused("_gone", docs)
    gone = cut(gathered(found.where("NOT kept").select(F.col(key).alias(name)).distinct()))
    few = gone.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, F.col(f"`{key}`") == F.col(name), "left_anti")


def digest(documents: DataFrame) -> DataFrame:
    """The rows that op9 returns."""
    return groups(documents)
