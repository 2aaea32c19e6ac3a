"""Observation reports: a header and blocks of elements by values by times, nested in one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nephos.functions.columns import unused


def gather(rows: DataFrame, report: list[str], block: list[str], element: str, value: str) -> DataFrame:
    """Rows to reports: blocks is an array of (block keys, elements, vals), in order."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(element).alias("e"), F.col(value).alias("v"))))
    blocks = rows.groupBy(*report, *block).agg(pairs.alias("_p"))
    one = F.struct(*block, F.transform("_p", lambda x: x["e"]).alias("elements"), F.transform("_p", lambda x: x["v"]).alias("vals"))
    return blocks.groupBy(*report).agg(F.array_sort(F.collect_list(one)).alias("blocks"))


def flatten(reports: DataFrame, report: list[str], block: list[str]) -> DataFrame:
    """Reports to rows (report, block, element, value)."""
    b = reports.select(*report, F.explode("blocks").alias("_b"))
    pair = F.explode(F.arrays_zip("_b.elements", "_b.vals")).alias("_p")
    return b.select(*report, *[F.col(f"_b.{c}").alias(c) for c in block], pair).select(
        *report, *block, F.col("_p.elements").alias("element"), F.col("_p.vals").alias("value")
    )


def block_summary(reports: DataFrame, report: list[str]) -> DataFrame:
    n = F.aggregate("blocks", F.lit(0).cast("long"), lambda a, b: a + F.size(b["elements"]))
    return reports.select(*report, F.size("blocks").cast("long").alias("n_blocks"), n.alias("n_elements"))


def delete_block(reports: DataFrame, where) -> DataFrame:
    return reports.withColumn("blocks", F.filter("blocks", lambda b: ~where(b)))


def find_block(reports: DataFrame, where) -> DataFrame:
    """The first block that meets a test, null without one."""
    return reports.withColumn("found", F.get(F.filter("blocks", where), F.lit(0)))


def to_real(rows: DataFrame, scales: DataFrame, element: str, value: str, missing: int, into: str = "real") -> DataFrame:
    """Coded integers to values by the scale and reference of each element.

    scales (element, scale, reference) is a table of codes; Spark broadcasts it if it is small.  An element
    without an entry keeps its value and the missing code is null.
    """
    s = scales.select(F.col("element").alias("_e"), "scale", "reference")
    j = rows.join(s, F.col(element) == F.col("_e"), "left").drop("_e")
    real = (F.col(value) + F.col("reference")) / F.pow(F.lit(10.0), F.col("scale"))
    return j.withColumn(into, F.when(F.col(value) == missing, F.lit(None)).when(F.col("scale").isNull(), F.col(value)).otherwise(real).cast("double")).drop("scale", "reference")


def to_code(rows: DataFrame, scales: DataFrame, element: str, real: str, missing: int, into: str = "code") -> DataFrame:
    s = scales.select(F.col("element").alias("_e"), "scale", "reference")
    j = rows.join(s, F.col(element) == F.col("_e"), "left").drop("_e")
    code = F.round(F.col(real) * F.pow(F.lit(10.0), F.col("scale"))) - F.col("reference")
    return j.withColumn(into, F.when(F.col(real).isNull(), F.lit(missing)).when(F.col("scale").isNull(), F.round(F.col(real))).otherwise(code).cast("long")).drop("scale", "reference")


def position_test(lat: Column, lon: Column, box: tuple[float, float, float, float]) -> Column:
    south, north, west, east = box
    return lat.between(south, north) & lon.between(west, east)


def replace_values(reports: DataFrame, where, vals) -> DataFrame:
    """The blocks that meet a test get other values, vals(block); an array of another size than the elements is an error."""

    def put(b: Column) -> Column:
        new = vals(b)
        checked = F.when(F.size(new) == F.size(b["elements"]), new).otherwise(F.raise_error(F.lit("a block's values are as many as its elements")).cast("array<bigint>"))
        return F.when(where(b), b.withField("vals", checked)).otherwise(b)

    return reports.withColumn("blocks", F.transform("blocks", put))


def descriptors(reports: DataFrame, report: list[str], block: list[str], first: int = 1) -> DataFrame:
    """A row for each block from a place on: its place, keys, number of elements, and the bits and type that its values need."""
    b = reports.select(*report, F.posexplode("blocks").alias("_n", "_b")).where(F.col("_n") >= first - 1)
    need = needed_bits(F.col("_b.vals"))
    return b.select(*report, (F.col("_n") + 1).alias("place"), *[F.col(f"_b.{c}").alias(c) for c in block], F.size("_b.elements").alias("n_elements"), need["bits"].alias("bits"), need["kind"].alias("kind"))


def needed_bits(vals: Column, least: int = 0) -> Column:
    """Bits and type (2 unsigned, 4 signed) for an array of integers in which -1 is missing.

    A greatest value of ones only needs one bit more, as all ones are the missing code; values below -1 need a sign.  An array
    of missing values needs no more than the least.
    """
    top, low = F.array_max(vals).cast("long"), F.array_min(vals).cast("long")
    signed = low < -1
    size = F.when(signed, F.greatest(top, -low)).otherwise(top)
    count = F.length(F.bin(F.greatest(size, F.lit(0))))
    count = F.when(size <= 0, 0).otherwise(count)
    ones = size + 1 == F.pow(F.lit(2.0), count)
    bits = count + F.when(ones, 1).otherwise(0) + F.when(signed, 1).otherwise(0)
    wide = signed & (bits > 31)
    nothing = (top == -1) & (low == -1)
    kind = F.when(signed & ~wide, F.lit(4)).otherwise(F.lit(2))
    return F.struct(F.when(nothing, F.lit(least)).otherwise(F.greatest(F.least(F.when(wide, 32).otherwise(bits), F.lit(32)), F.lit(least))).cast("int").alias("bits"), kind.alias("kind"))


def folded_date(date: Column) -> Column:
    """Year, month and day of eight digits as six, with twelve months more for each century after 1900."""
    year, month = F.floor(date / 10_000), F.floor(date / 100) % 100
    six = (year % 100) * 10_000 + (F.floor((year - 1900) / 100) * 12 + month) * 100 + date % 100
    return F.when(date > 999_999, six).otherwise(date).cast("long")


def unfolded_date(date: Column, always: bool = False) -> Column:
    """Eight digits of a folded date; one of the 1900s stays as it is unless always."""
    month = F.floor(date / 100) % 100
    eight = (1900 + F.floor(date / 10_000) % 100 + F.floor((month - 1) / 12) * 100) * 10_000 + (1 + (month - 1) % 12) * 100 + date % 100
    return F.when(F.lit(always) | (month > 12), eight).otherwise(date).cast("long")


#: Fields of a report's header that -1 leaves as they are.
HEADER = ("flags", "lat", "lon", "dx", "dy", "type", "elevation", "delay", "oars", "run")


def start_header(rows: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """Report headers: station of nine characters, time as hour and minute, folded date and the other fields, 0 without one."""
    own = [F.coalesce(fields.get(f, F.lit(0)).cast("long"), F.lit(0)).alias(f) for f in HEADER]
    time = fields["time"]
    return rows.select("*", F.struct(F.rpad(fields["station"], 9, " ").alias("station"), F.floor(time / 100).cast("long").alias("hour"), (time % 100).cast("long").alias("minute"), folded_date(fields["date"]).alias("date"), *own).alias("header"))


def update_header(reports: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """Headers with other fields: -1 keeps a field, * keeps a character of the station."""
    h = F.col("header")
    out = h
    for f in set(fields) & set(HEADER):
        out = out.withField(f, F.when(fields[f] == -1, h[f]).otherwise(fields[f]).cast("long"))
    if "station" in fields:
        new = F.rpad(fields["station"], 9, " ")
        letters = [F.when(F.substring(new, k, 1) == "*", F.substring(h["station"], k, 1)).otherwise(F.substring(new, k, 1)) for k in range(1, 10)]
        out = out.withField("station", F.concat(*letters))
    if "time" in fields:
        keep = fields["time"] == -1
        out = out.withField("hour", F.when(keep, h["hour"]).otherwise(F.floor(fields["time"] / 100)).cast("long")).withField("minute", F.when(keep, h["minute"]).otherwise(fields["time"] % 100).cast("long"))
    if "date" in fields:
        out = out.withField("date", F.when(fields["date"] == -1, h["date"]).otherwise(folded_date(fields["date"])))
    return reports.withColumn("header", out)


def header(reports: DataFrame, keys: list[str], eight: bool = False) -> DataFrame:
    """Headers as rows: station, time as hhmm, date and the other fields."""
    h = F.col("header")
    return reports.select(*keys, h["station"].alias("station"), (h["hour"] * 100 + h["minute"]).alias("time"), unfolded_date(h["date"], eight).alias("date"), *[h[f].alias(f) for f in HEADER])


#: Element codes of the lower half of a 64-bit real and of the parts of complex numbers, as FXXYYY.
LOWER, IMAGINARY, IMAGINARY_UPPER, IMAGINARY_LOWER = 55_204, 55_205, 55_206, 55_207


def paired_elements(elements: Column, kind: Column) -> Column:
    """Element codes (FXXYYY) of 64-bit (7), complex (8) and 64-bit complex (9) values with the codes of their parts put in where
    they are 0; null if their number does not fit or a code is another one."""
    parts = F.when(kind == 9, 4).when(kind.isin(7, 8), 2).otherwise(1)
    want = lambda k: (
        F.when((kind == 7) & (k % 2 == 1), LOWER).when((kind == 8) & (k % 2 == 1), IMAGINARY).when((kind == 9) & (k % 4 == 1), LOWER).when((kind == 9) & (k % 4 == 2), IMAGINARY_UPPER).when((kind == 9) & (k % 4 == 3), IMAGINARY_LOWER)
    )
    filled = F.transform(elements, lambda e, k: F.when(want(k).isNull() | (e == want(k)), e).when(e == 0, want(k)))
    return F.when((F.size(elements) % parts == 0) & ~F.exists(filled, lambda e: e.isNull()), filled)


def element_table(lines: DataFrame, line: str = "line", by: list[str] = ()) -> DataFrame:
    """(by, element, scale, reference, listed, repeats) of tables of elements in fixed columns: code in 1 to 6, a star in 51 for one
    that is not listed, scale in 64 to 66, reference in 67 to 77, M in 85 for one that repeats.  Remarks start with * or #."""
    text = F.col(line)
    number = lambda at, width: F.trim(F.substring(text, at, width)).try_cast("long")
    rows = lines.where(~F.substring(text, 1, 1).isin("*", "#") & F.substring(text, 1, 6).rlike("^[0-9]{6}$"))
    listed = F.substring(text, 51, 1) != "*"
    return rows.select(*by, number(1, 6).alias("element"), F.when(listed, number(64, 3)).alias("scale"), F.when(listed, number(67, 11)).alias("reference"), listed.alias("listed"), (F.lower(F.substring(text, 85, 1)) == "m").alias("repeats"))


def repeats(rows: DataFrame, table: DataFrame, element: str, into: str = "repeats", by: list[str] = ()) -> DataFrame:
    """Whether each row's element is one that repeats in a block, by the table of its own (by) where there are several.  An
    element that a table holds more than once counts once."""
    held = unused("_held", rows)
    known = table.where("repeats").select(*by, F.col("element").alias(element)).distinct().withColumn(held, F.lit(True))
    return rows.join(known, [*by, element], "left").select(*rows.columns, held).withColumn(into, F.col(held).isNotNull()).drop(held)
