"""Search, rules and edits over a directory of records, one row a record."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nephos.functions.columns import unused

ANY = -1


def matches(**keys) -> Column:
    """All keys equal; None, -1 and blank text match anything."""
    tests = [F.col(k) == v for k, v in keys.items() if v is not None and v != ANY and not (isinstance(v, str) and not v.strip())]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def masked(column: Column, value: int, ignored_bits: int) -> Column:
    """Equal but for the ignored bits."""
    return (column.bitwiseXOR(F.lit(value)).bitwiseAND(F.lit(~ignored_bits))) == 0


def label_like(column: Column, pattern: str) -> Column:
    """Equal character by character, where * in the pattern matches any character."""
    tests = [F.substring(column, i + 1, 1) == c for i, c in enumerate(pattern) if c != "*"]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def search(directory: DataFrame, **keys) -> DataFrame:
    return directory.where(matches(**keys))


def next_after(directory: DataFrame, handle: str, after: int, by: list[str]) -> DataFrame:
    """The first record beyond a handle, for each value of by."""
    w = Window.partitionBy(*by).orderBy(handle)
    n = unused("_n", directory)
    return directory.where(F.col(handle) > after).withColumn(n, F.row_number().over(w)).where(F.col(n) == 1).drop(n)


def listing(found: DataFrame, handle: str, most: int, by: list[str]) -> DataFrame:
    """Up to most handles of each group in order, with found, negative if there are more."""
    w = Window.partitionBy(*by)
    n = F.count("*").over(w)
    return (
        found.withColumn("place", F.row_number().over(w.orderBy(handle)))
        .withColumn("found", F.when(n > most, -n).otherwise(n))
        .where(F.col("place") <= most)
    )


def link(*files: DataFrame) -> DataFrame:
    """Files searched as one: their rows in the order of file_index."""
    numbered = [f.withColumn("file_index", F.lit(i)) for i, f in enumerate(files)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)


def rewrite(directory: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming records take the place of those with the same keys, or are added."""
    return directory.join(incoming.select(*keys).distinct(), keys, "left_anti").unionByName(incoming)


def erase(directory: DataFrame, condition: Column) -> DataFrame:
    """Erased records stay as rows that are marked deleted."""
    was = F.col("deleted") if "deleted" in directory.columns else F.lit(False)
    return directory.withColumn("deleted", was | F.coalesce(condition, F.lit(False)))


def live(directory: DataFrame) -> DataFrame:
    return directory.where(~F.col("deleted"))


def counts(directory: DataFrame, by: list[str]) -> DataFrame:
    return directory.groupBy(*by).agg(F.count("*").alias("n_all"), F.sum((~F.col("deleted")).cast("long")).alias("n_live"))


def edit(directory: DataFrame, condition: Column, **changes) -> DataFrame:
    """Set columns of the records that meet the condition; None, -1 and blank leave a column.  Sizes and types cannot change."""
    fixed = {"ni", "nj", "nk", "datyp"} & changes.keys()
    if fixed:
        raise ValueError(f"cannot be edited: {', '.join(sorted(fixed))}")
    blank = {k for k, v in changes.items() if v is None or (isinstance(v, (int, str)) and (v == ANY or not str(v).strip()))}
    real = {k: v for k, v in changes.items() if k not in blank}
    return directory.withColumns({k: F.when(condition, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(k)) for k, v in real.items()})


@dataclass(frozen=True)
class Rule:
    """A record meets a rule if it meets all of its criteria; it then is included or excluded."""

    include: bool
    criteria: tuple[Column, ...]


def one_of(column: str, *values) -> Column:
    return F.col(column).isin(*values)


def between(column: str, low, high, step: int | None = None) -> Column:
    """In a closed range, on every step of it if one is given; open ends are None."""
    c = F.col(column)
    tests = ([c >= low] if low is not None else []) + ([c <= high] if high is not None else [])
    if step:
        tests.append(F.pmod(c - F.lit(low), F.lit(step)) == 0)
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def starts_with(column: str, *heads: str) -> Column:
    return reduce(lambda a, b: a | b, [F.col(column).startswith(h) for h in heads])


def decide(rules: list[Rule]) -> Column:
    """Number of the first rule that a record meets if it includes, else 0.

    Where no rule is met: 0 if the last rule includes or any does, else 1.
    """
    met = [reduce(lambda a, b: a & b, r.criteria, F.lit(True)) for r in rules]
    rest = 0 if any(r.include for r in rules) else 1
    chain = F
    for i, (m, r) in enumerate(zip(met, rules, strict=True)):
        chain = chain.when(m, F.lit(i + 1 if r.include else 0))
    return chain.otherwise(F.lit(rest)) if rules else F.lit(1)


def level_alike(a: Column, b: Column) -> Column:
    """Level codes that are equal, or new-style codes of one kind and sign whose mantissas, brought to one exponent, differ by 1 at most."""

    def part(c: Column, shift: int, mask: int) -> Column:
        return F.shiftright(c, shift).bitwiseAND(F.lit(mask))

    ma, mb = part(a, 0, 0xFFFFF), part(b, 0, 0xFFFFF)
    sa, sb = ma > 1_000_000, mb > 1_000_000
    va, vb = F.when(sa, ma - 1_000_000).otherwise(ma), F.when(sb, mb - 1_000_000).otherwise(mb)
    ea, eb = part(a, 20, 15), part(b, 20, 15)
    top = F.greatest(ea, eb)
    apart = F.abs(va * F.pow(F.lit(10.0), top - ea) - vb * F.pow(F.lit(10.0), top - eb))
    new = (a > 32767) & (b > 32767) & (part(a, 24, 15) == part(b, 24, 15)) & (sa == sb)
    return (a == b) | (new & (apart <= 1))


def axes(grids: DataFrame, directory: DataFrame) -> DataFrame:
    """Each different grid (grtyp, ni, nj, ig1, ig2, ig3) with the records of the directory that hold its axes.

    These are called ">>" and "^^", or "^>" alone for kind U, and their ip1 to ip3 are the grid's ig1 to ig3; kind # leaves ip3
    free.  The first by handle counts that has the grid's ni (x) or nj (y); kind #, and sizes 0 or -1, take any; "^>" must be one
    row.  Gives x_handle, y_handle, the axes' sizes, the kind (Y if both records are alike in shape) and the reference, the x
    record's grtyp: F for kind U, else N, S, L, E or O.  All of these are null if a record is missing or refers to another kind.
    Records alike in name, keys and shape are one before the join, and fields of one grid are one grid.
    """
    keys = ["grtyp", "ni", "nj", "ig1", "ig2", "ig3"]
    named = directory.where(F.trim("nomvar").isin(">>", "^^", "^>"))
    shapes = named.groupBy(F.trim("nomvar").alias("_name"), *[F.col(c).alias(f"_{c}") for c in ("ip1", "ip2", "ip3", "ni", "nj")])
    a = shapes.agg(F.min(F.struct(F.col("handle").alias("handle"), F.col("grtyp").alias("grtyp"))).alias("_r"))
    a = a.withColumn("_r", F.struct("_r.handle", "_r.grtyp", F.col("_ni").alias("ni"), F.col("_nj").alias("nj")))
    tiles, cloud = F.col("grtyp") == "#", F.col("grtyp") == "U"
    met = grids.select(*keys).distinct().join(a, (F.col("_ip1") == F.col("ig1")) & (F.col("_ip2") == F.col("ig2")) & ((F.col("_ip3") == F.col("ig3")) | tiles), "left")
    any_size = lambda size: tiles | F.col(size).isin(0, -1)
    both = cloud & (F.col("_name") == "^>") & (F.col("_nj") == 1) & (F.col("_ni") > 0)
    x = both | ~cloud & (F.col("_name") == ">>") & ((F.col("_ni") == F.col("ni")) | any_size("ni"))
    y = both | ~cloud & (F.col("_name") == "^^") & ((F.col("_nj") == F.col("nj")) | any_size("nj"))
    found = met.groupBy(*keys).agg(F.min(F.when(x, F.col("_r"))).alias("_x"), F.min(F.when(y, F.col("_r"))).alias("_y"))
    known = F.when(cloud, F.col("_x.grtyp") == "F").otherwise(F.col("_x.grtyp").isin("N", "S", "L", "E", "O"))
    good = F.col("_x").isNotNull() & F.col("_y").isNotNull() & known
    alike = (F.col("_x.ni") == F.col("_y.ni")) & (F.col("_x.nj") == F.col("_y.nj"))
    kind = F.when(tiles | cloud, F.col("grtyp")).otherwise("Z")
    given = {
        "x_handle": F.col("_x.handle"), "y_handle": F.col("_y.handle"), "x_size": F.col("_x.ni"), "y_size": F.col("_y.nj"),
        "kind": F.when(alike & ~cloud, "Y").otherwise(kind), "reference": F.col("_x.grtyp"),
    }
    return found.select(*keys, *[F.when(good, v).alias(k) for k, v in given.items()])
