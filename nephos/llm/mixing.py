"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed in cells of source, language and topic.  Each cell gets a probability, the same for all to
begin with; in turn for each of the three margins, probabilities are scaled so that the expected tokens meet
the margin's targets, and none goes above 1.  A document is then drawn with its cell's probability, so that the
expected tokens of the sample meet all margins and, together, the stated share of the corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nephos.llm.common import cut, local_rows

MARGINS = ("source", "lang", "topic")
#: Without targets, a margin's target shares are its shares in the corpus to this power, scaled to 1: below 1 they even out.
FLATTEN = {"source": 0.8, "lang": 0.8, "topic": 0.9}
#: Share of the corpus's tokens that the sample is to have.
KEEP = 0.5
ROUNDS = 24
#: Up to so many cells are fitted on the driver, more as a table.
DRIVER_CELLS = 200_000
SALT = "mix:"
#: A margin value's wanted shares, where given: margin, value, weight.
Targets = dict[str, dict[str, float]]


def topic_of(text: Column) -> Column:
    """A topic from a text's form, for tables that have none."""
    return (
        F.when(text.contains("!! "), "shouting")
        .when(text.contains("### ") | text.contains("%%% "), "symbols")
        .when(text.contains("licensed under"), "licence")
        .when(text.contains("@"), "contact")
        .when(F.length(text) < 400, "short prose")
        .when(F.length(text) < 4000, "prose")
        .otherwise("long prose")
    )


def tokens_of(text: Column) -> Column:
    """Runs of anything but space, tab, line feed and carriage return."""
    return F.regexp_count(text, F.lit("[^ \\t\\n\\r]+")).cast("long")


def cell_columns(docs: DataFrame, text: str = "text") -> dict[str, Column]:
    """The margins of each row and its tokens; null margins count as an empty name; a column topic is used if there is one."""
    body = F.coalesce(F.col(text), F.lit(""))
    topic = F.col("topic").cast("string") if "topic" in docs.columns else topic_of(body)
    named = {"source": F.col("source").cast("string"), "lang": F.col("lang").cast("string"), "topic": topic}
    return {k: F.coalesce(v, F.lit("")) for k, v in named.items()} | {"n_tokens": tokens_of(body)}


def draw_of(key: str) -> Column:
    """A number in [0, 1) that the key alone decides."""
    digest = F.md5(F.concat(F.lit(SALT), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def _wanted_here(tokens: np.ndarray, share: np.ndarray, total: float) -> np.ndarray:
    """Tokens that each value of a margin is to have: in proportion to its share, but no more than it has.

    What values with too few tokens leave goes to the others, by the least factor of the shares that reaches the total.
    """
    share = np.where(tokens > 0, share, 0.0)
    share = share / max(share.sum(), 1e-300)
    order = np.argsort(tokens / np.maximum(share, 1e-300), kind="stable")
    had = np.concatenate([[0.0], np.cumsum(tokens[order])])[:-1]
    left = 1 - np.concatenate([[0.0], np.cumsum(share[order])])[:-1]
    factor = ((total - had) / np.maximum(left, 1e-300))[left > 1e-9].max(initial=0.0)
    return np.minimum(tokens, factor * share)


def _fit_here(cells: list, targets: Targets, keep: float, rounds: int) -> np.ndarray:
    tokens = np.array([float(c["tokens"]) for c in cells])
    chance = np.full(len(cells), keep)
    places, wanted = [], []
    for margin in MARGINS:
        values, place = np.unique([c[margin] for c in cells], return_inverse=True)
        sums = np.bincount(place, tokens)
        if margin in targets:
            share = np.array([float(targets[margin].get(v, 0.0)) for v in values])
        else:
            share = (sums / max(tokens.sum(), 1)) ** FLATTEN[margin]
        places.append(place)
        wanted.append(_wanted_here(sums, share, keep * tokens.sum()))
    for _ in range(rounds):
        for place, want in zip(places, wanted, strict=True):
            sums = np.bincount(place, tokens * chance)
            chance = np.minimum(1.0, chance * np.where(sums > 0, want / np.where(sums > 0, sums, 1), 1.0)[place])
    return chance


def _wanted_there(cells: DataFrame, margin: str, targets: Targets, total: float, keep: float) -> DataFrame:
    """The same as a table (value, want): a margin has few values beside its cells, so one window orders them."""
    sums = cells.groupBy(margin).agg(F.sum("tokens").cast("double").alias("s"))
    if margin in targets:
        pairs = [(str(k), float(v)) for k, v in targets[margin].items()]
        given = local_rows(cells.sparkSession, pairs, [margin, "raw"], [pyarrow.string(), pyarrow.float64()])
        sums = sums.join(given, margin, "left").withColumn("raw", F.coalesce("raw", F.lit(0.0)))
    else:
        sums = sums.withColumn("raw", F.pow(F.col("s") / max(total, 1.0), F.lit(FLATTEN[margin])))
    sums = sums.withColumn("raw", F.when(F.col("s") > 0, F.col("raw")).otherwise(0.0))
    whole = max(sums.agg(F.sum("raw")).first()[0] or 0.0, 1e-300)
    shares = cut(sums.select(margin, "s", (F.col("raw") / whole).alias("share")))
    before = Window.orderBy(F.col("s") / F.greatest("share", F.lit(1e-300)), margin).rowsBetween(Window.unboundedPreceding, -1)
    had, left = F.coalesce(F.sum("s").over(before), F.lit(0.0)), 1 - F.coalesce(F.sum("share").over(before), F.lit(0.0))
    steps = shares.select(had.alias("had"), left.alias("left")).where("left > 1e-9")
    factor = steps.agg(F.max((F.lit(keep * total) - F.col("had")) / F.col("left"))).first()[0] or 0.0
    return cut(shares.select(margin, F.least("s", F.lit(factor) * F.col("share")).alias("want")))


def _fit_there(cells: DataFrame, targets: Targets, keep: float, rounds: int) -> DataFrame:
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    wanted = {m: _wanted_there(cells, m, targets, total, keep) for m in MARGINS}
    now = cells.withColumn("probability", F.lit(keep))
    for _ in range(rounds):
        for margin in MARGINS:
            sums = now.groupBy(margin).agg(F.sum(F.col("tokens") * F.col("probability")).alias("s")).join(wanted[margin], margin)
            factor = sums.select(margin, F.when(F.col("s") > 0, F.col("want") / F.col("s")).otherwise(1.0).alias("f"))
            now = now.join(factor, margin).withColumn("probability", F.least(F.lit(1.0), F.col("probability") * F.col("f"))).drop("f")
        now = cut(now)
    return now


def fit(
    measured: DataFrame, targets: Targets | None = None, keep: float = KEEP, rounds: int = ROUNDS, driver_cells: int = DRIVER_CELLS
) -> DataFrame:
    """(source, lang, topic, tokens, probability) of each cell of measured (source, lang, topic, n_tokens).

    A margin without targets gets its flattened shares; a value that its targets leave out is wanted not at all, and a value
    that is wanted more than it has is wanted whole.  A cell without tokens has probability keep times the factors of its
    margins.  residuals() says how well the margins are met.
    """
    targets = targets or {}
    cells = cut(measured.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens")))
    if cells.count() > driver_cells:
        return _fit_there(cells, targets, keep, rounds).select(*MARGINS, "tokens", "probability")
    held = cells.orderBy(*MARGINS).collect()
    chance = _fit_here(held, targets, keep, rounds)
    rows = [(*[c[m] for m in MARGINS], int(c["tokens"]), float(p)) for c, p in zip(held, chance, strict=True)]
    types = [pyarrow.string(), pyarrow.string(), pyarrow.string(), pyarrow.int64(), pyarrow.float64()]
    return local_rows(measured.sparkSession, rows, [*MARGINS, "tokens", "probability"], types)


def residuals(fitted: DataFrame, targets: Targets | None = None, keep: float = KEEP) -> DataFrame:
    """(margin, value, tokens, wanted, expected): how far the expected tokens of each margin value are from those wanted."""
    total = float(fitted.agg(F.sum("tokens")).first()[0] or 0)
    out = None
    for margin in MARGINS:
        sums = fitted.groupBy(margin).agg(F.sum("tokens").alias("tokens"), F.sum(F.col("tokens") * F.col("probability")).alias("expected"))
        one = sums.join(_wanted_there(fitted, margin, targets or {}, total, keep), margin)
        one = one.select(F.lit(margin).alias("margin"), F.col(margin).alias("value"), "tokens", F.col("want").alias("wanted"), "expected")
        out = one if out is None else out.unionByName(one)
    return out


def weighed(rows: DataFrame, fitted: DataFrame, key: str = "doc_id") -> DataFrame:
    """rows (source, lang, topic, the key) with probability and sampled of each."""
    few = fitted.count() <= DRIVER_CELLS
    fitted = fitted.select(*MARGINS, "probability")
    return rows.join(F.broadcast(fitted) if few else fitted, list(MARGINS)).withColumn("sampled", draw_of(key) < F.col("probability"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", targets: Targets | None = None, keep: float = KEEP) -> DataFrame:
    """The drawn rows of docs, with their columns.

    The key alone decides a row's draw: rows that repeat a key and a cell stay or go together.  Null margins
    are a cell of their own, null or empty texts have no tokens.  Columns of any name stay as they are.  No rows
    give no rows.
    """
    # The caller's columns travel as one, so none can clash with those made here.
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    packed = docs.select(whole, F.col(f"`{key}`").alias("key"), *[v.alias(k) for k, v in cell_columns(docs, text).items()])
    fitted = fit(packed.select(*MARGINS, "n_tokens"), targets, keep)
    return weighed(packed, fitted, "key").where("sampled").select("row.*")


def digest(documents: DataFrame) -> DataFrame:
    """The rows that op1 returns: every document with its cell, probability, the same over KEEP as weight, and draw."""
    measured = cut(documents.select("doc_id", *[v.alias(k) for k, v in cell_columns(documents).items()]))
    rows = weighed(measured, fit(measured))
    return rows.select(
        "doc_id", *MARGINS, "n_tokens", F.round(F.col("probability") / KEEP, 6).alias("weight"), F.round("probability", 6).alias("probability"), "sampled"
    )


def oracle() -> str:
    """SQL that says what digest() returns."""
    steps, last = [], "p0"
    for i in range(ROUNDS):
        for m in MARGINS:
            name = f"p{i}_{m}"
            steps.append(
                f"{name} AS MATERIALIZED (SELECT source, lang, topic, tokens, t_source, t_lang, t_topic,"
                f" least(1, p * coalesce(t_{m} / nullif(sum(tokens * p) OVER (PARTITION BY {m}), 0), 1)) AS p FROM {last})"
            )
            last = name
    wanted = []
    for m in MARGINS:
        wanted += [
            f"r_{m} AS (SELECT {m}, sum(tokens) AS s, CASE WHEN sum(tokens) > 0 THEN pow(sum(tokens) / (SELECT sum(tokens) FROM cells), {FLATTEN[m]}) ELSE 0 END AS raw FROM cells GROUP BY {m})",
            f"s_{m} AS (SELECT {m}, s, raw / (SELECT sum(raw) FROM r_{m}) AS share FROM r_{m})",
            f"c_{m} AS (SELECT max(({KEEP} * (SELECT sum(tokens) FROM cells) - had) / rest) AS factor FROM (SELECT coalesce(sum(s) OVER w, 0) AS had, 1 - coalesce(sum(share) OVER w, 0) AS rest FROM s_{m}"
            f" WINDOW w AS (ORDER BY s / greatest(share, 1e-300), {m} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE rest > 1e-9)",
        ]
    targets = ", ".join(f"least(s_{m}.s, c_{m}.factor * s_{m}.share) AS t_{m}" for m in MARGINS)
    joins = " ".join(f"JOIN s_{m} USING ({m}) CROSS JOIN c_{m}" for m in MARGINS)
    return f"""
WITH docs AS (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS text FROM documents),
measured AS (
  SELECT doc_id, source, lang,
    CASE WHEN contains(text, '!! ') THEN 'shouting'
         WHEN contains(text, '### ') OR contains(text, '%%% ') THEN 'symbols'
         WHEN contains(text, 'licensed under') THEN 'licence'
         WHEN contains(text, '@') THEN 'contact'
         WHEN length(text) < 400 THEN 'short prose'
         WHEN length(text) < 4000 THEN 'prose' ELSE 'long prose' END AS topic,
    len(regexp_extract_all(text, '[^ \\t\\n\\r]+'))::BIGINT AS n_tokens
  FROM docs),
cells AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM measured GROUP BY ALL),
{", ".join(wanted)},
p0 AS (SELECT source, lang, topic, tokens, {targets}, {KEEP}::DOUBLE AS p FROM cells {joins}),
{", ".join(steps)}
SELECT doc_id, source, lang, topic, n_tokens, round(p / {KEEP}, 6) AS weight, round(p, 6) AS probability,
  ('0x' || substr(md5('{SALT}' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / {float(16**13)} < p AS sampled
FROM measured JOIN {last} USING (source, lang, topic)"""
