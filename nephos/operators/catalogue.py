"""Named arrays with layouts and attributes, sections of definition files, and files of include and exclude rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed values of the store: results, options of entries, and flags of arrays.
OK, NOT_FOUND, READ_ONLY, WRONG_TYPE, WRONG_DIMENSION, REDEFINED, SYNTAX = 0, -1001, -1002, -1003, -1004, -1012, -1014
OPTIONS = {"WB_IS_ARRAY": 4096, "WB_REWRITE_AT_RESTART": 2048, "WB_REWRITE_MANY": 1024, "WB_REWRITE_UNTIL": 512, "WB_REWRITE_NONE": 256, "WB_READ_ONLY_ON_RESTART": 128, "WB_INITIALIZED": 64, "WB_IS_LOCAL": 8, "WB_CREATED_BY_RESTART": 4}
LAYOUT = ("low", "high", "halo", "halomax", "n")
RESTART, TO_ZERO, TO_NAN = 1, 2, 4


# Named arrays: a row (name, rank, layouts, key, uuid1, uuid2, initmode, flags, values).


def layout(low: Column, high: Column, halo: Column, halomax: Column, n: Column) -> Column:
    return F.struct(*[c.cast("int").alias(k) for k, c in zip(LAYOUT, (low, high, halo, halomax, n), strict=True)])


def created(arrays: DataFrame, restart: DataFrame | None = None) -> DataFrame:
    """Arrays (name, layouts, flags) with rank and values: those of the restart if it has the name, else zeros or NaN by the
    flags, else nulls.  An array of the restart with other bounds is an error."""
    size = F.aggregate("layouts", F.lit(1), lambda a, x: a * (x["high"] - x["low"] + 1))
    flag = lambda bit: F.col("flags").bitwiseAND(F.lit(bit)) != 0
    start = F.when(flag(TO_ZERO), F.lit(0.0)).when(flag(TO_NAN), F.lit(float("nan")))
    made = arrays.withColumns({"rank": F.size("layouts"), "values": F.array_repeat(start, size)})
    if restart is None:
        return made
    old = restart.select(F.col("name").alias("_name"), F.col("values").alias("_values"))
    met = made.join(old, (F.col("name") == F.col("_name")) & flag(RESTART), "left")
    same = F.when(F.size("_values") == F.size("values"), F.col("_values")).otherwise(F.raise_error(F.lit("an array of the restart has other bounds")).cast("array<double>"))
    return met.withColumn("values", F.when(F.col("_values").isNotNull(), same).otherwise(F.col("values"))).drop("_name", "_values")


def fetched(arrays: DataFrame, wanted: DataFrame) -> DataFrame:
    """(name, rank) with the array's values and a status: 0, -1001 without one of that name, -1004 if it has another rank."""
    have = arrays.select(F.col("name").alias("_name"), F.col("rank").alias("_rank"), "values")
    met = wanted.join(have, F.col("name") == F.col("_name"), "left")
    status = F.when(F.col("_name").isNull(), NOT_FOUND).when(F.col("rank") != F.col("_rank"), WRONG_DIMENSION).otherwise(OK)
    return met.withColumns({"status": status, "values": F.when(status == OK, F.col("values"))}).drop("_name", "_rank")


def dropped(arrays: DataFrame, names: DataFrame) -> DataFrame:
    return arrays.join(names.select("name"), "name", "left_anti")


def updated(arrays: DataFrame, changes: DataFrame) -> DataFrame:
    """Arrays with other halos, sizes, keys and flags; bounds stay.  changes has name, layouts, uuid1, uuid2 and flags."""
    more = changes.select(F.col("name").alias("_name"), *[F.col(c).alias(f"_{c}") for c in ("layouts", "uuid1", "uuid2", "flags")])
    met = arrays.join(more, F.col("name") == F.col("_name"), "left")
    one = lambda old, new: F.when(new.isNull(), old).otherwise(old.withField("halo", new["halo"]).withField("halomax", new["halomax"]).withField("n", new["n"]))
    hit = F.col("_name").isNotNull()
    merged = F.when(hit, F.zip_with("layouts", F.slice("_layouts", F.lit(1), F.size("layouts")), one)).otherwise(F.col("layouts"))
    return met.withColumns({"layouts": merged} | {c: F.when(hit, F.col(f"_{c}")).otherwise(F.col(c)) for c in ("uuid1", "uuid2", "flags")}).drop("_name", "_layouts", "_uuid1", "_uuid2", "_flags")


def metadata_words(layouts: Column, key: Column, uuid1: Column, uuid2: Column, initmode: Column, flags: Column) -> Column:
    """Metadata as 28 integers: five of each of four layouts, zeros where there are fewer, then three keys of two words each,
    lower first, the way of starting and the flags."""
    four = F.concat(layouts, F.array_repeat(layout(*[F.lit(0)] * 5), F.greatest(4 - F.size(layouts), F.lit(0))))
    bounds = F.flatten(F.transform(four, lambda x: F.array(*[x[k] for k in LAYOUT])))
    halves = [h for c in (key, uuid1, uuid2) for h in (_word(c), _word(F.shiftright(c.cast("long"), 32)))]
    return F.concat(bounds, F.array(*halves, initmode.cast("int"), flags.cast("int")))


def _word(c: Column) -> Column:
    """The lower 32 bits as a signed integer."""
    low = c.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))
    return F.when(low >= 1 << 31, low - (1 << 32)).otherwise(low).cast("int")


def from_metadata_words(w: Column) -> Column:
    """The struct of layouts, key, uuid1, uuid2, initmode and flags of 28 integers."""
    each = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.struct(*[F.get(w, k * 5 + i).alias(n) for i, n in enumerate(LAYOUT)]))
    whole = lambda at: F.shiftleft(F.get(w, F.lit(at + 1)).cast("long"), 32).bitwiseOR(F.get(w, F.lit(at)).cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.struct(each.alias("layouts"), whole(20).alias("key"), whole(22).alias("uuid1"), whole(24).alias("uuid2"), F.get(w, F.lit(26)).alias("initmode"), F.get(w, F.lit(27)).alias("flags"))


def directory(arrays: DataFrame) -> DataFrame:
    """What a listing of the arrays shows: name, rank, size, least, mean and greatest value."""
    held = F.filter("values", lambda x: x.isNotNull() & ~F.isnan(x))
    mean = F.aggregate(held, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(held), F.lit(0))
    return arrays.select("name", "rank", F.size("values").alias("size"), F.array_min(held).alias("least"), mean.alias("mean"), F.array_max(held).alias("greatest"))


def restart_arrays(arrays: DataFrame) -> DataFrame:
    """Those that a checkpoint writes and a restart reads."""
    return arrays.where(F.col("flags").bitwiseAND(F.lit(RESTART)) != 0)


# Sections of definition files: lines (file, n, line).


def section(lines: DataFrame, name: str) -> DataFrame:
    """The lines of a section: from @name up to the next line that starts with @; comments and blank lines go."""
    text = F.trim(F.regexp_replace("line", r"[!#].*$", ""))
    head = F.when(text.startswith("@"), F.lower(F.trim(F.substring(text, 2, 200))))
    w = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    named = lines.withColumns({"line": text, "_section": F.last(head, ignorenulls=True).over(w)})
    return named.where((F.col("_section") == name.lower()) & ~F.col("line").startswith("@") & (F.col("line") != "")).drop("_section")


def section_options(lines: DataFrame) -> DataFrame:
    """(file, options): the options that a section's options() lines give, added up; 256 without any."""
    list_ = F.regexp_extract("line", r"(?i)^options\s*\(([^)]*)\)", 1)
    known = F.create_map(*[F.lit(x) for k, v in OPTIONS.items() for x in (k, v)])
    total = F.aggregate(F.transform(F.split(list_, r"\s*[+,|]\s*"), lambda x: F.coalesce(known[F.upper(F.trim(x))], F.lit(0))), F.lit(0), lambda a, x: a.bitwiseOR(x))
    summed = lines.where(F.col("line").rlike(r"(?i)^options\s*\(")).withColumn("_o", total).groupBy("file").agg(F.bit_or("_o").alias("_o"))
    return lines.select("file").distinct().join(summed, "file", "left").select("file", F.coalesce("_o", F.lit(OPTIONS["WB_REWRITE_NONE"])).alias("options"))


def definitions(lines: DataFrame, package: str = "") -> DataFrame:
    """(file, n, name, kind, size, length, options, description) of define(key[TYPEn,len], OPT=[..], DESC="..") lines: R real, I whole, C
    text and L truth, n bytes each, an array of so many from 1 up."""
    d = F.col("line")
    key = F.regexp_extract(d, r"(?i)^define\s*\(\s*([a-z_][\w]*)\s*\[", 1)
    part = lambda k: F.regexp_extract(d, r"(?i)\[\s*([ricl])\s*([0-9]+)\s*,\s*([0-9]+)\s*\]", k)
    known = F.create_map(*[F.lit(x) for k, v in OPTIONS.items() for x in (k, v)])
    opt = F.regexp_extract(d, r"(?i)\bOPT\s*=\s*\[([^\]]*)\]", 1)
    own = F.when(opt != "", F.aggregate(F.transform(F.split(opt, r"\s*[+,|]\s*"), lambda x: F.coalesce(known[F.upper(F.trim(x))], F.lit(0))), F.lit(0), lambda a, x: a.bitwiseOR(x)))
    return lines.where(key != "").select("file", "n", F.upper(F.concat(F.lit(package), key)).alias("name"), F.upper(part(1)).alias("kind"), part(2).cast("int").alias("size"), part(3).cast("int").alias("length"), own.alias("options"), F.regexp_extract(d, r"(?i)\bDESC\s*=\s*\"([^\"]*)\"", 1).alias("description"))


def assigned(lines: DataFrame, package: str = "") -> DataFrame:
    """(file, n, name, items) of key = v1, v2 lines; quotes around items go, and commas inside them part nothing."""
    key = F.regexp_extract("line", r"^([A-Za-z_]\w*)\s*=", 1)
    rest = F.regexp_extract("line", r"^[A-Za-z_]\w*\s*=\s*(.*)$", 1)
    items = F.transform(F.split(rest, ",(?=(?:[^'\"]*['\"][^'\"]*['\"])*[^'\"]*$)"), lambda x: F.regexp_replace(F.trim(x), "^['\"]|['\"]$", ""))
    return lines.where(key != "").select("file", "n", F.upper(F.concat(F.lit(package), key)).alias("name"), items.alias("items"))


def loaded(lines: DataFrame, package: str = "", strict: bool = False) -> DataFrame:
    """(file, name, kind, size, length, options, items, status) of a section's keys.

    A key that is defined twice, assigned twice or assigned without a definition has a status that says so; strict or not, a key
    is to be defined in the same file.  Items of the wrong kind or too many are errors; a key that is only defined has none.
    """
    d = definitions(lines, package)
    options = section_options(lines).withColumnRenamed("options", "_all")
    first = Window.partitionBy("file", "name").orderBy("n")
    d = d.withColumns({"_times": F.count("*").over(Window.partitionBy("file", "name")), "_at": F.row_number().over(first)}).where("_at = 1").drop("_at", "n")
    a = assigned(lines, package).withColumns({"_given": F.count("*").over(Window.partitionBy("file", "name")), "_at": F.row_number().over(first)}).where("_at = 1").drop("_at", "n")
    met = d.join(a, ["file", "name"], "full").join(options, "file")
    number = F.when(F.col("kind") == "I", r"^[+-]?[0-9]+$").when(F.col("kind") == "R", r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eEdD][+-]?[0-9]+)?$").when(F.col("kind") == "L", r"(?i)^\.?(true|false|t|f)\.?$").otherwise("(?s)^.*$")
    wrong = F.exists("items", lambda x: ~F.regexp(x, number)) | ((F.col("kind") == "C") & F.exists("items", lambda x: F.length(x) > F.col("size")))
    status = (
        F.when(F.col("kind").isNull(), NOT_FOUND).when(F.col("_times") > 1, REDEFINED).when(F.col("_given") > 1, REDEFINED)
        .when(F.size("items") > F.greatest("length", F.lit(1)), WRONG_DIMENSION).when(wrong, WRONG_TYPE).otherwise(OK)
    )
    flags = F.coalesce("options", "_all").bitwiseOR(F.when(F.col("length") > 0, OPTIONS["WB_IS_ARRAY"]).otherwise(0)).bitwiseOR(F.when(F.col("items").isNotNull(), OPTIONS["WB_INITIALIZED"]).otherwise(0))
    return met.select("file", "name", "kind", "size", "length", flags.alias("options"), "items", status.alias("status"))


def checked(entries: DataFrame, head: str, mask: int) -> DataFrame:
    """The entries whose name starts so and that have one of the mask's options."""
    return entries.where(F.col("name").startswith(head.upper()) & (F.col("options").bitwiseAND(F.lit(mask)) != 0))


def restarted(entries: DataFrame) -> DataFrame:
    """Entries as a restart reads them: all are marked as created by it; those to be rewritten at restarts lose their write
    protection; those that are read-only from then on get it, once for all, and an error if they have no value; local ones lose
    their value."""
    has = lambda k: F.col("options").bitwiseAND(F.lit(OPTIONS[k])) != 0
    without = lambda c, *names: c.bitwiseAND(F.lit(~sum(OPTIONS[n] for n in names)))
    o = F.col("options").bitwiseOR(F.lit(OPTIONS["WB_CREATED_BY_RESTART"]))
    o = F.when(has("WB_REWRITE_AT_RESTART"), without(o, "WB_REWRITE_NONE")).otherwise(o)
    protected = F.when(has("WB_INITIALIZED"), without(o, "WB_REWRITE_MANY").bitwiseOR(F.lit(OPTIONS["WB_REWRITE_NONE"])))
    o = F.when(has("WB_READ_ONLY_ON_RESTART"), F.coalesce(protected, F.raise_error(F.lit("a key without a value cannot be made read-only")).cast("int"))).otherwise(o)
    o = F.when(has("WB_IS_LOCAL"), without(o, "WB_INITIALIZED")).otherwise(o)
    return entries.withColumns({"options": o, "items": F.when(~has("WB_IS_LOCAL"), F.col("items"))})


# Files of rules: a line of number, 'D' or 'E', field, how, count, then one of values; a line of 0 ends it.

FIELDS = {"D": "date", "I": "ip", "X": "extra", "N": "nomvar", "T": "typvar", "E": "etiket"}
EXTRA = ("ni", "nj", "nk", "ig1", "ig2", "ig3", "ig4", "grtyp")


def read_rules(lines: list[str]) -> list[dict]:
    """Rules of a file, in order: number, desire, field, how (value, range, delta) and values."""
    rules, at = [], 0
    while at < len(lines):
        head = [p.strip().strip("'").strip() for p in lines[at].split(",")]
        if not head[0].lstrip("-").isdigit():
            raise ValueError(f"line {at + 1} starts no rule")
        if int(head[0]) == 0:
            break
        if len(head) < 5 or at + 1 >= len(lines):
            raise ValueError(f"the rule of line {at + 1} is not whole")
        field = FIELDS.get(head[2][:1].upper())
        if field is None:
            raise ValueError(f"line {at + 1} names no field")
        if field == "ip":
            field += head[2][2:3]
        how = {"v": "value", "r": "range", "d": "delta"}.get(head[3][:1].lower())
        values = [v.strip() for v in lines[at + 1].split(",")]
        text = field in ("nomvar", "typvar", "etiket")
        parsed = [v.strip("'").rstrip() if text or v.startswith("'") else float(v) if how == "delta" and i == 2 else int(float(v)) for i, v in enumerate(values)]
        if how == "delta" and field.startswith("ip"):
            raise ValueError("steps of a level code cannot be read from a file")
        rules.append({"number": int(head[0]), "desire": head[1][:1].upper() == "D", "field": field, "how": how, "values": parsed[: 8 if field == "extra" else int(head[4])]})
        at += 2
    return rules


def write_rules(rules: list[dict]) -> list[str]:
    """The lines of a file of rules."""
    names = {"date": "Dates", "ip1": "IP1", "ip2": "IP2", "ip3": "IP3", "extra": "Xtra", "nomvar": "Nomvar", "typvar": "Typvar", "etiket": "Etiket"}
    width = {"nomvar": 4, "typvar": 2, "etiket": 12}
    out = []
    for r in rules:
        values = r["values"]
        out.append(f"{r['number']:2d}, '{'D' if r['desire'] else 'E'}', '{names[r['field']]:<10}', '{r['how']:>6}', {len(values):2d}")
        shown = [f"'{v:<{width.get(r['field'], 1)}}'" if isinstance(v, str) else str(v) for v in values]
        out.append("      " + ", ".join(shown))
    return [*out, " 0"]


def criterion(rule: dict, column) -> Column:
    """The test of one rule on its column: column(field) gives it.  Open ends of a range are -1; texts match by their start."""
    values, field = rule["values"], rule["field"]
    if field == "extra":
        return reduce(lambda a, b: a & b, [F.lit(True), *[column(n) == v for n, v in zip(EXTRA, values, strict=True) if v not in (-1, " ", "")]])
    c = column(field)
    if isinstance(values[0], str):
        return reduce(lambda a, b: a | b, [c.startswith(v) for v in values])
    if rule["how"] == "value":
        return F.lit(True) if values == [-1] else c.isin(*values)
    low, high = values[0], values[1]
    test = (F.lit(True) if low == -1 else c >= low) & (F.lit(True) if high == -1 else c <= high)
    return test & ((c - low) % values[2] == 0) if rule["how"] == "delta" else test


def selected(rows: DataFrame, rules: list[dict], column) -> DataFrame:
    """Rows by rules: criteria of one number hold together; the first number that fits decides; without any, rows stay only if
    no rule asks for rows.  _rule is the number that decided, 0 for none."""
    sets: dict[int, tuple[bool, Column]] = {}
    for r in rules:
        if r["number"] in sets and sets[r["number"]][0] != r["desire"]:
            raise ValueError(f"rule {r['number']} both asks for rows and leaves them out")
        test = criterion(r, column)
        sets[r["number"]] = (r["desire"], sets[r["number"]][1] & test if r["number"] in sets else test)
    chain, number = F.when(F.lit(False), F.lit(True)), F.when(F.lit(False), F.lit(0))
    for n, (desire, test) in sorted(sets.items()):
        chain, number = chain.when(test, F.lit(desire)), number.when(test, F.lit(n))
    keep = chain.otherwise(F.lit(not any(d for d, _ in sets.values())))
    return rows.withColumn("_rule", number.otherwise(F.lit(0))).where(keep)


def rule_hits(rows: DataFrame, rules: list[dict], column) -> DataFrame:
    """(number, desire, n): how many rows each number decides."""
    spark: SparkSession = rows.sparkSession
    numbers = sorted({(r["number"], r["desire"]) for r in rules})
    asked = spark.createDataFrame(numbers, "number int, desire boolean")
    everything = selected(rows, [r | {"desire": True} for r in rules], column)
    return asked.join(everything.groupBy(F.col("_rule").alias("number")).agg(F.count("*").alias("n")), "number", "left").fillna(0, ["n"])
