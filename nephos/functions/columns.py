"""What column arithmetic shares."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f reads it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def last_below(axis: Column, value: Column, equal: bool) -> Column:
    """1-based place of the last point of an ascending array below a value, or at it if equal; 0 without one.  By halving."""
    test = (lambda p: p <= value) if equal else (lambda p: p < value)

    def halved(s: Column, _: Column) -> Column:
        def parted(x: Column) -> Column:
            below = test(F.get(axis, x["mid"] - 1))
            return F.struct(F.when(below, x["mid"]).otherwise(x["lo"]).alias("lo"), F.when(below, x["hi"]).otherwise(x["mid"]).alias("hi"))

        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        return F.when(s["hi"] - s["lo"] > 1, once(F.struct(s["lo"].alias("lo"), s["hi"].alias("hi"), mid.alias("mid")), parted)).otherwise(s)

    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(axis) + 1)).cast("int") + 1)
    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), (F.size(axis) + 1).alias("hi")), halved)["lo"]


def unused(name: str, *frames: DataFrame) -> str:
    """A column name like this one that none of the frames has."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
