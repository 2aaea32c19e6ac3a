"""Queries of date words and stamps, report headers and elements, named arrays, definition sections and rule files."""

from __future__ import annotations

from pyspark.sql import functions as F

from nephos.functions import dates
from nephos.operators import catalogue as ops
from nephos.operators import reports
from nephos.plans.base import r4, read
from nephos.plans.grids import _reports


def date_words(spark, d):
    return read(spark, d, "events").withColumn("w", dates.words(F.col("ts"))).select("event_id", *[F.col(f"w.{c}").alias(c) for c in ("weekday", "month", "day", "year", "hour", "hundredths", "text")])


def date_words_stamp(spark, d):
    """Years of two and four digits, and days that some months do not have."""
    n = F.col("o_orderkey")
    year = F.when(n % 2 == 0, F.year("o_orderdate") - 1900).otherwise(F.year("o_orderdate") + n % 50)
    s = dates.from_words(F.month("o_orderdate"), (n % 31 + 1).cast("int"), year.cast("int"), (n % 24).cast("int"), n * 777 % 360_000)
    return read(spark, d, "orders").select("o_orderkey", s.alias("stamp"))


def _far(spark, d):
    """Orders' days moved to the years 0 to 9999."""
    days = F.col("o_orderkey") * 2437 % 3_652_000
    at = F.date_add(F.lit("0000-01-01").cast("date"), days.cast("int"))
    return read(spark, d, "orders").select("o_orderkey", days.alias("days"), F.make_timestamp(F.year(at), F.month(at), F.dayofmonth(at), (F.col("o_orderkey") % 24).cast("int"), F.lit(0), F.lit(0)).alias("at"))


def date_extended(spark, d):
    f = _far(spark, d).withColumns({"extended": dates.extended_stamp(F.col("at")), "stamp": dates.any_stamp(F.col("at"))})
    back = dates.unstamp_any(F.col("stamp"))
    return f.select("o_orderkey", dates.hours_of_year_0(F.col("at")).alias("hours"), "extended", F.col("stamp"), F.unix_seconds(back).alias("back"))


def date_true(spark, d):
    """Ticks and run numbers of stamps, old ones among them, and back."""
    run = F.col("o_orderkey") % 10
    tick = (F.unix_seconds(F.col("o_orderdate").cast("timestamp")) - dates.EPOCH_1980) / 5
    o = read(spark, d, "orders").withColumn("stamp", dates.from_true_date(F.floor(tick).cast("long"), run))
    t, r = dates.true_date(F.col("stamp"))
    return o.select("o_orderkey", "stamp", t.alias("ticks"), r.alias("run"))


def date_operational(spark, d):
    n = F.col("o_orderkey")
    text = F.concat(F.lpad((n % 100).cast("string"), 2, "0"), F.lpad((n % 366 + 1).cast("string"), 3, "0"), F.lpad((n % 24).cast("string"), 2, "0"))
    return read(spark, d, "orders").select("o_orderkey", dates.operational(F.when(n % 97 == 0, F.lit("soon")).otherwise(text)).alias("stamp"))


def date_whole_hours(spark, d):
    s = dates.stamp(F.col("o_orderdate"))
    later = dates.add_whole_hours(s, F.col("o_orderkey") % 5000 - 2500)
    return read(spark, d, "orders").select("o_orderkey", later.alias("later"), dates.whole_hours_between(later, s).alias("hours"))


def report_replace(spark, d):
    new = reports.replace_values(_reports(spark, d), lambda b: b["l_returnflag"] == "A", lambda b: F.transform(b["vals"], lambda v: 100 - v))
    return reports.flatten(new, ["l_orderkey"], ["l_returnflag"]).groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def report_descriptors(spark, d):
    r = reports.replace_values(_reports(spark, d), lambda b: b["l_returnflag"] == "R", lambda b: F.transform(b["vals"], lambda v: -v))
    return reports.descriptors(r, ["l_orderkey"], ["l_returnflag"], 2).select("l_orderkey", F.col("place").cast("long").alias("place"), "l_returnflag", "n_elements", "bits", "kind")


def _headers(spark, d):
    o = read(spark, d, "orders").withColumn("date", (F.year("o_orderdate") + F.col("o_orderkey") % 3 * 50) * 10_000 + F.month("o_orderdate") * 100 + F.dayofmonth("o_orderdate"))
    n = F.col("o_orderkey")
    return reports.start_header(o, {"station": F.concat(F.lit("ST"), (n % 1000).cast("string")), "time": n % 24 * 100 + n % 60, "date": F.col("date"), "lat": n % 18000, "lon": n % 36000, "flags": n % 7})


def report_header(spark, d):
    return reports.header(_headers(spark, d), ["o_orderkey"])


def report_header_update(spark, d):
    n = F.col("o_orderkey")
    changed = reports.update_header(_headers(spark, d), {"station": F.lit("**X"), "time": F.when(n % 2 == 0, F.lit(-1)).otherwise(F.lit(1234)), "date": F.lit(-1), "lat": F.lit(-1), "lon": n % 5, "run": F.lit(9)})
    return reports.header(changed, ["o_orderkey"], eight=True)


def element_pairs(spark, d):
    n = F.col("p_partkey")
    kind = F.element_at(F.array(*[F.lit(k) for k in (2, 7, 8, 9)]), (n % 4 + 1).cast("int"))
    second = F.when(n % 3 == 0, 0).when(n % 3 == 1, F.when(kind == 8, 55_205).otherwise(55_204)).otherwise(12_004)
    e = F.when(n % 5 == 0, F.array(n % 64_000, second, n % 7)).otherwise(F.array(n % 64_000, second, F.when(kind == 9, 0).otherwise(n % 9), F.lit(0)))
    x = read(spark, d, "part").select("p_partkey", kind.alias("kind"), reports.paired_elements(e.cast("array<long>"), kind).alias("e"))
    return x.select("p_partkey", "kind", F.concat_ws(",", F.transform("e", lambda v: v.cast("string"))).alias("elements"), F.col("e").isNull().alias("wrong"))


#: Codes that six digits have room for: so many parts side by side have a code each and share a table of elements.
CODES = 300_000


def _element_table_of(part):
    return part - part % CODES


def _element_lines(spark, d):
    """A table of elements in fixed columns, of the parts: remarks, unlisted and repeating ones among them."""
    n = F.col("p_partkey")
    body = F.concat(
        F.lpad((n * 7 % CODES).cast("string"), 6, "0"), F.rpad(F.lit("  NAME"), 44, " "), F.when(n % 11 == 0, "*").otherwise(" "), F.rpad(F.lit("UNIT"), 12, " "),
        F.lpad((F.col("p_size") % 5 - 1).cast("string"), 3, " "), F.lpad((-n * 3).cast("string"), 11, " "), F.rpad(F.lit(""), 7, " "), F.when(n % 4 == 0, "M").otherwise(" "),
    )
    return read(spark, d, "part").select("p_partkey", "p_size", _element_table_of(n).alias("table"), F.when(n % 13 == 0, F.concat(F.lit("*"), body)).otherwise(body).alias("line"))


def element_table(spark, d):
    return reports.element_table(_element_lines(spark, d))


def element_repeats(spark, d):
    tables, n = reports.element_table(_element_lines(spark, d), by=["table"]), F.col("l_partkey")
    li = read(spark, d, "lineitem").select("l_linenumber", _element_table_of(n).alias("table"), (n * 7 % CODES).alias("element"))
    return reports.repeats(li, tables, "element", by=["table"]).groupBy("l_linenumber").agg(F.sum(F.col("repeats").cast("long")).alias("n_repeat"), F.count("*").alias("n"))


def _arrays(spark, d):
    n = F.col("n_nationkey")
    return read(spark, d, "nation").select(
        F.col("n_name").alias("name"), F.array(ops.layout(F.lit(1), n % 4 + 2, F.lit(1), F.lit(2), n % 4 + 2), ops.layout(F.lit(0), F.lit(2), F.lit(0), F.lit(0), F.lit(3))).alias("layouts"),
        n.cast("long").alias("key"), (n * 10).cast("long").alias("uuid1"), (-n).cast("long").alias("uuid2"), F.lit(-1).alias("initmode"), (F.when(n % 2 == 0, ops.RESTART).otherwise(0) + F.when(n % 3 == 0, ops.TO_ZERO).when(n % 3 == 1, ops.TO_NAN).otherwise(0)).alias("flags"),
    )


def array_create(spark, d):
    old = ops.created(_arrays(spark, d).where("key < 10")).withColumn("values", F.transform("values", lambda x, i: i + 0.5))
    made = ops.created(_arrays(spark, d), old)
    return made.select("name", "rank", F.size("values").alias("size"), F.aggregate("values", F.lit(0.0), lambda a, x: a + F.when(F.isnan(x), -1.0).otherwise(F.coalesce(x, F.lit(-2.0)))).alias("total"))


def array_fetch(spark, d):
    have = ops.created(_arrays(spark, d).where("key % 4 <> 1"))
    wanted = read(spark, d, "nation").select(F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 5 == 0, 3).otherwise(2).alias("rank"))
    return ops.fetched(have, wanted).select("name", "status", F.size("values").alias("size"))


def array_update(spark, d):
    a = _arrays(spark, d)
    new = a.where("key % 2 = 1").withColumns({"layouts": F.transform("layouts", lambda x: ops.layout(F.lit(-9), F.lit(99), x["halo"] + 1, x["halomax"] + 2, x["n"] * 2)), "uuid1": F.lit(7).cast("long"), "flags": F.lit(5)})
    left = ops.dropped(ops.updated(a, new), a.where("key > 20"))
    one = F.get("layouts", F.lit(0))
    return left.select("name", one["low"].alias("low"), one["high"].alias("high"), one["halo"].alias("halo"), one["halomax"].alias("halomax"), one["n"].alias("n"), "uuid1", "uuid2", "flags")


def array_metadata(spark, d):
    a = _arrays(spark, d).withColumn("uuid1", F.col("uuid1") * 1_000_000_007_000)
    w = a.withColumn("w", ops.metadata_words(*[F.col(c) for c in ("layouts", "key", "uuid1", "uuid2", "initmode", "flags")])).withColumn("back", ops.from_metadata_words(F.col("w")))
    return w.select("name", F.concat_ws(",", F.transform("w", lambda x: x.cast("string"))).alias("words"), F.size("back.layouts").alias("n_layouts"), F.col("back.uuid1").alias("uuid1"), F.col("back.uuid2").alias("uuid2"))


def array_directory(spark, d):
    a = ops.created(_arrays(spark, d)).withColumn("values", F.transform("values", lambda x, i: F.when(i % 4 != 3, i * 1.5 - F.col("key"))))
    return ops.directory(ops.restart_arrays(a)).select("name", "rank", "size", r4("least").alias("least"), r4("mean").alias("mean"), r4("greatest").alias("greatest"))


def _definitions(spark, d):
    """A file for each region: a section with options, definitions and values, among others; some wrong."""
    n = read(spark, d, "nation").select(F.col("n_regionkey").alias("r"), F.col("n_nationkey").alias("k"))
    file = F.concat(F.lit("file"), F.col("r").cast("string"))
    kind = F.element_at(F.array(F.lit("i4"), F.lit("r8"), F.lit("c8"), F.lit("l4")), (F.col("k") % 4 + 1).cast("int"))
    item = F.element_at(F.array(F.concat(F.lit("1, "), F.col("k").cast("string")), F.lit("2.5, -1e3"), F.lit("'a, b', 'c'"), F.lit(".true., f")), (F.when(F.col("k") % 7 == 0, F.col("k") + 1).otherwise(F.col("k")) % 4 + 1).cast("int"))
    key = F.concat(F.lit("key_"), F.col("k").cast("string"))
    opt = F.when(F.col("k") % 5 == 0, ", OPT=[WB_REWRITE_MANY+WB_IS_LOCAL]").otherwise("")
    define = F.concat(F.lit("define("), key, F.lit("["), kind, F.lit(","), F.when(F.col("k") % 6 == 0, "1").otherwise("2"), F.lit("]"), opt, F.lit(", DESC=\"one\")"))
    body = n.select(file.alias("file"), F.explode(F.array(F.struct((100 + F.col("k")).alias("n"), F.when(F.col("k") % 8 != 3, define).otherwise(F.lit("# none")).alias("line")), F.struct((200 + F.col("k")).alias("n"), F.when(F.col("k") % 9 != 4, F.concat(key, F.lit(" = "), item)).otherwise(F.lit("")).alias("line")))).alias("x")).select("file", "x.n", "x.line")
    fixed = [(0, "version=100"), (1, "@other"), (2, "define(lost[i4,0])"), (3, "@spp"), (4, "options(WB_REWRITE_UNTIL)"), (900, "@"), (901, "lost = 3")]
    frame = n.select(file.alias("file")).distinct().select("file", F.explode(F.array(*[F.struct(F.lit(a).alias("n"), F.lit(b).alias("line")) for a, b in fixed])).alias("x")).select("file", "x.n", "x.line")
    return body.union(frame)


def section_load(spark, d):
    e = ops.loaded(ops.section(_definitions(spark, d), "spp"), "spp/")
    return e.select("file", "name", "kind", "size", "length", "options", F.concat_ws("|", "items").alias("items"), "status")


def section_check(spark, d):
    e = ops.loaded(ops.section(_definitions(spark, d), "spp"))
    return ops.checked(e.where("kind IS NOT NULL"), "key_1", ops.OPTIONS["WB_IS_ARRAY"] | ops.OPTIONS["WB_IS_LOCAL"]).groupBy("file").agg(F.count("*").alias("n"))


def store_restart(spark, d):
    n = F.col("p_partkey")
    options = F.lit(64) + F.when(n % 2 == 0, 256).otherwise(1024) + F.when(n % 3 == 0, 2048).otherwise(0) + F.when(n % 5 == 0, 128).otherwise(0) + F.when(n % 7 == 0, 8).otherwise(0)
    e = read(spark, d, "part").select("p_partkey", F.col("p_name").alias("name"), options.alias("options"), F.array(F.col("p_brand")).alias("items"))
    return ops.restarted(e).select("p_partkey", "options", F.get("items", F.lit(0)).alias("item"))


RULES = """ 1, 'E', 'IP1       ', ' value',  2
       12, 13
 2, 'D', 'IP1       ', ' range',  2
       5, 30
 2, 'D', 'Nomvar    ', ' value',  2
       'Bran', 'Brand#1'
 3, 'D', 'Dates     ', ' delta',  3
       100, 900, 7
 4, 'D', 'Xtra      ', 'value ',  8
       -1, -1, -1, 3, -1, -1, -1, ' '
 0
 5, 'D', 'IP2       ', ' value',  1
       1""".splitlines()


def _ruled(spark, d):
    columns = {"ip1": F.col("p_size"), "nomvar": F.col("p_brand"), "date": F.col("p_partkey"), "ig1": F.col("p_partkey") % 10}
    return read(spark, d, "part"), columns.__getitem__


def rules_from_file(spark, d):
    """The rules of a file, written and read once more, applied to the parts."""
    rows, column = _ruled(spark, d)
    rules = ops.read_rules(ops.write_rules(ops.read_rules(RULES)))
    return ops.selected(rows, rules, column).select("p_partkey", F.col("_rule").alias("rule"))


def rules_hits(spark, d):
    rows, column = _ruled(spark, d)
    return ops.rule_hits(rows, ops.read_rules(RULES), column)


QUERIES = {
    f.__name__: f
    for f in (date_words, date_words_stamp, date_extended, date_true, date_operational, date_whole_hours, report_replace, report_descriptors, report_header, report_header_update, element_pairs, element_table, element_repeats, array_create, array_fetch, array_update, array_metadata, array_directory, section_load, section_check, store_restart, rules_from_file, rules_hits)
}

_T = "((epoch({t}) - 315532800) // 5)::BIGINT"


def _stamp(t: str) -> str:
    """Old and new stamps of a time."""
    ticks = f"floor((epoch({t}) - 315532800) / 5)::BIGINT"
    return f"CASE WHEN year({t}) >= 2000 OR (year({t}) >= 1980 AND (minute({t}) <> 0 OR second({t}) <> 0)) THEN 123200000 + ({ticks} // 8) * 10 + {ticks} % 8 ELSE month({t}) * 10000000 + day({t}) * 100000 + (year({t}) - 1900) * 1000 + hour({t}) * 10 END"


def _any(t: str) -> str:
    h = f"((date_diff('day', DATE '1970-01-01', ({t})::DATE) + 719528) * 24 + hour({t}))"
    extended = f"3000000000 + ({h} // 8) * 10 + {h} % 8 - 4294967296"
    return f"(CASE WHEN year({t}) < 1900 OR year({t}) > 2235 OR {t} = TIMESTAMP '1901-01-01 01:00:00' THEN {extended} ELSE {_stamp(t)} END)::BIGINT"


_FLAG = "CASE l_returnflag WHEN 'A' THEN 100 - q ELSE q END"
_HEAD = """h AS (SELECT o_orderkey, rpad('ST' || (o_orderkey % 1000), 9, ' ') AS station, o_orderkey % 24 * 100 + o_orderkey % 60 AS time, ((year(o_orderdate) + o_orderkey % 3 * 50) * 10000 + month(o_orderdate) * 100 + day(o_orderdate))::BIGINT AS date,
    o_orderkey % 7 AS flags, o_orderkey % 18000 AS lat, o_orderkey % 36000 AS lon FROM orders)"""
_ZEROS = "0::BIGINT AS dx, 0::BIGINT AS dy, 0::BIGINT AS type, 0::BIGINT AS elevation, 0::BIGINT AS delay, 0::BIGINT AS oars"
_ELEMENTS = "SELECT p_partkey, p_partkey * 7 % 300000 AS element, p_size % 5 - 1 AS scale, -p_partkey * 3 AS reference, p_partkey % 11 <> 0 AS listed, p_partkey % 4 = 0 AS repeats FROM part WHERE p_partkey % 13 <> 0"
_ARR = "a AS (SELECT n_name AS name, n_nationkey::BIGINT AS k, n_nationkey % 4 + 2 AS high, CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE 0 END + CASE n_nationkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 4 ELSE 0 END AS flags FROM nation)"


def _word(v: str) -> str:
    return f"(CASE WHEN {v} & 4294967295 >= 2147483648 THEN ({v} & 4294967295) - 4294967296 ELSE {v} & 4294967295 END)"


_LOADED = """k AS (SELECT n_regionkey AS r, n_nationkey AS k, n_nationkey % 8 <> 3 AS defined, n_nationkey % 9 <> 4 AS given, ['I', 'R', 'C', 'L'][n_nationkey % 4 + 1] AS kind, [4, 8, 8, 4][n_nationkey % 4 + 1] AS size, CASE WHEN n_nationkey % 6 = 0 THEN 1 ELSE 2 END AS length,
      CASE WHEN n_nationkey % 7 = 0 THEN n_nationkey + 1 ELSE n_nationkey END % 4 AS i FROM nation),
    l AS (SELECT *, 4096 + CASE WHEN given THEN 64 ELSE 0 END + CASE WHEN k % 5 = 0 THEN 1032 ELSE 512 END AS options, CASE i WHEN 0 THEN '1|' || k WHEN 1 THEN '2.5|-1e3' WHEN 2 THEN 'a, b|c' ELSE '.true.|f' END AS items,
      CASE WHEN NOT defined THEN -1001 WHEN given AND length < 2 THEN -1004 WHEN given AND NOT CASE kind WHEN 'I' THEN i = 0 WHEN 'R' THEN i IN (0, 1) WHEN 'L' THEN i = 3 ELSE true END THEN -1003 ELSE 0 END AS status FROM k WHERE defined OR given)"""
_RULED = """r AS (SELECT p_partkey, CASE WHEN p_size IN (12, 13) THEN 1 WHEN p_size BETWEEN 5 AND 30 AND p_brand LIKE 'Bran%' THEN 2 WHEN p_partkey BETWEEN 100 AND 900 AND (p_partkey - 100) % 7 = 0 THEN 3 WHEN p_partkey % 10 = 3 THEN 4 ELSE 0 END AS rule FROM part)"""
_W = "strptime((CASE WHEN y < 100 THEN y + 1900 ELSE y END) || '-' || m || '-' || dd || ' ' || hh || ':' || (c // 6000) || ':' || (c // 100 % 60), '%Y-%m-%d %H:%M:%S')"
ORACLE_SQL = {
    "date_words": """SELECT event_id, (dayofweek(ts) + 1)::INTEGER AS weekday, month(ts)::INTEGER AS month, day(ts)::INTEGER AS day, year(ts)::INTEGER AS year, hour(ts)::INTEGER AS hour, ((minute(ts) * 60 + second(ts)) * 100)::INTEGER AS hundredths,
        upper(strftime(ts, ' %a %b ')) || strftime(ts, '%d %Y %HZ%M:%S') || '.00' AS text FROM events""",
    "date_words_stamp": f"""SELECT o_orderkey, coalesce({_any('t')}, 101010101) AS stamp FROM (SELECT o_orderkey, try_strptime((CASE WHEN y < 100 THEN y + 1900 ELSE y END) || '-' || m || '-' || dd || ' ' || (o_orderkey % 24) || ':' || (c // 6000) || ':' || (c // 100 % 60), '%Y-%m-%d %H:%M:%S') AS t
        FROM (SELECT o_orderkey, month(o_orderdate) AS m, o_orderkey % 31 + 1 AS dd, CASE WHEN o_orderkey % 2 = 0 THEN year(o_orderdate) - 1900 ELSE year(o_orderdate) + o_orderkey % 50 END AS y, o_orderkey * 777 % 360000 AS c FROM orders))""",
    "date_extended": f"""WITH f AS (SELECT o_orderkey, o_orderkey * 2437 % 3652000 AS days, o_orderkey % 24 AS h FROM orders), t AS (SELECT *, days * 24 + h AS hours, (days - 719528) * 86400 + h * 3600 AS s, make_timestamp(((days - 719528) * 86400 + h * 3600) * 1000000) AS t FROM f)
        SELECT o_orderkey, hours, 3000000000 + (hours // 8) * 10 + hours % 8 - 4294967296 AS extended, {_any('t')} AS stamp, s AS back FROM t""",
    "date_true": """WITH t AS (SELECT o_orderkey, o_orderdate AS t, floor((epoch(o_orderdate) - 315532800) / 5)::BIGINT AS tick FROM orders), s AS (SELECT *, tick >= 126230400 OR tick % 720 <> 0 AS new FROM t)
        SELECT o_orderkey, CASE WHEN new THEN 123200000 + (tick // 8) * 10 + tick % 8 ELSE month(t) * 10000000 + day(t) * 100000 + (year(t) - 1900) * 1000 + hour(t) * 10 + o_orderkey % 10 END AS stamp, CASE WHEN new THEN tick ELSE tick // 720 * 720 END AS ticks, CASE WHEN new THEN 0 ELSE o_orderkey % 10 END AS run FROM s""",
    "date_operational": f"""WITH n AS (SELECT o_orderkey, o_orderkey % 100 AS y, o_orderkey % 366 + 1 AS j, o_orderkey % 24 AS h FROM orders), t AS (SELECT *, make_timestamp(CASE WHEN y < 50 THEN 2000 + y ELSE 1900 + y END, 1, 1, 0, 0, 0) + to_days((j - 1)::INTEGER) + to_hours(h) AS t FROM n)
        SELECT o_orderkey, CASE WHEN o_orderkey % 97 = 0 THEN 10101011 WHEN y * 100000 + j * 100 + h < 9936624 THEN {_any('t')} ELSE 10101011 END AS stamp FROM t""",
    "date_whole_hours": f"""WITH t AS (SELECT o_orderkey, o_orderkey % 5000 - 2500 AS n, make_timestamp((floor(epoch(o_orderdate) / 5) * 5 * 1000000)::BIGINT) AS t FROM orders), u AS (SELECT *, CASE WHEN year(t) >= 2000 OR minute(t) <> 0 OR second(t) <> 0 THEN t ELSE date_trunc('hour', t) END + to_hours(n) AS t2 FROM t)
        SELECT o_orderkey, {_any('t2')} AS later, n AS hours FROM u""",
    "report_replace": f"SELECT l_returnflag, count(*) AS n, sum({_FLAG})::BIGINT AS total FROM (SELECT *, l_quantity::BIGINT AS q FROM lineitem) GROUP BY 1",
    "report_descriptors": """WITH b AS (SELECT l_orderkey, l_returnflag, count(*) AS n, max(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END)::BIGINT AS top, min(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END)::BIGINT AS low, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag) AS place FROM lineitem GROUP BY 1, 2),
        s AS (SELECT *, low < -1 AS signed, CASE WHEN low < -1 THEN greatest(top, -low) ELSE top END AS size FROM b), c AS (SELECT *, CASE WHEN size <= 0 THEN 0 ELSE floor(log2(size))::INTEGER + 1 END AS bits FROM s)
        SELECT l_orderkey, place, l_returnflag, n::INTEGER AS n_elements, CASE WHEN top = -1 AND low = -1 THEN 0 ELSE bits + CASE WHEN size + 1 = (1 << bits) THEN 1 ELSE 0 END + CASE WHEN signed THEN 1 ELSE 0 END END::INTEGER AS bits, CASE WHEN signed THEN 4 ELSE 2 END AS kind FROM c WHERE place >= 2""",
    "report_header": f"WITH {_HEAD} SELECT o_orderkey, station, time, CASE WHEN date >= 20000000 THEN date ELSE (date // 10000 % 100) * 10000 + date % 10000 END AS date, flags, lat, lon, {_ZEROS}, 0::BIGINT AS run FROM h",
    "report_header_update": f"WITH {_HEAD} SELECT o_orderkey, rpad('STX', 9, ' ') AS station, CASE WHEN o_orderkey % 2 = 0 THEN time ELSE 1234 END AS time, date, flags, lat, o_orderkey % 5 AS lon, {_ZEROS}, 9::BIGINT AS run FROM h",
    "element_pairs": """WITH k AS (SELECT p_partkey AS n, [2, 7, 8, 9][p_partkey % 4 + 1] AS kind FROM part), s AS (SELECT *, CASE n % 3 WHEN 0 THEN 0 WHEN 1 THEN CASE WHEN kind = 8 THEN 55205 ELSE 55204 END ELSE 12004 END AS b, CASE WHEN n % 5 = 0 THEN n % 7 WHEN kind = 9 THEN 0 ELSE n % 9 END AS c FROM k),
        w AS (SELECT *, n % 5 = 0 AS odd, kind > 2 AND (n % 5 = 0 OR n % 3 = 2) AS wrong FROM s)
        SELECT n AS p_partkey, kind, CASE WHEN wrong THEN '' WHEN odd THEN (n % 64000) || ',' || b || ',' || c WHEN kind = 2 THEN (n % 64000) || ',' || b || ',' || c || ',0' WHEN kind = 7 THEN (n % 64000) || ',55204,' || c || ',55204' WHEN kind = 8 THEN (n % 64000) || ',55205,' || c || ',55205'
        ELSE (n % 64000) || ',55204,55206,55207' END AS elements, wrong FROM w""",
    "element_table": f"SELECT element, CASE WHEN listed THEN scale END::BIGINT AS scale, CASE WHEN listed THEN reference END AS reference, listed, repeats FROM ({_ELEMENTS})",
    "element_repeats": f"SELECT l_linenumber, sum(CASE WHEN l_partkey IN (SELECT p_partkey FROM ({_ELEMENTS}) WHERE repeats) THEN 1 ELSE 0 END)::BIGINT AS n_repeat, count(*) AS n FROM lineitem GROUP BY 1",
    "array_create": f"""WITH {_ARR}, s AS (SELECT *, high * 3 AS size FROM a) SELECT name, 2 AS rank, size::INTEGER AS size, CASE WHEN k < 10 AND flags & 1 = 1 THEN size * (size - 1) / 2.0 + size * 0.5 WHEN flags & 2 = 2 THEN 0 WHEN flags & 4 = 4 THEN -size ELSE -2 * size END::DOUBLE AS total FROM s""",
    "array_fetch": f"WITH {_ARR} SELECT name, CASE WHEN k % 4 = 1 THEN -1001 WHEN k % 5 = 0 THEN -1004 ELSE 0 END AS status, CASE WHEN k % 4 <> 1 AND k % 5 <> 0 THEN high * 3 END::INTEGER AS size FROM a",
    "array_update": f"""WITH {_ARR} SELECT name, 1 AS low, high::INTEGER AS high, CASE WHEN k % 2 = 1 THEN 2 ELSE 1 END AS halo, CASE WHEN k % 2 = 1 THEN 4 ELSE 2 END AS halomax, (high * CASE WHEN k % 2 = 1 THEN 2 ELSE 1 END)::INTEGER AS n, CASE WHEN k % 2 = 1 THEN 7 ELSE k * 10 END AS uuid1, -k AS uuid2, CASE WHEN k % 2 = 1 THEN 5 ELSE flags END AS flags FROM a WHERE k <= 20""",
    "array_metadata": f"""WITH {_ARR}, u AS (SELECT *, k * 10000000070000 AS u FROM a) SELECT name, '1,' || high || ',1,2,' || high || ',0,2,0,0,3,0,0,0,0,0,0,0,0,0,0,' || k || ',0,' || {_word('u')} || ',' || (u >> 32) || ',' || (-k) || ',' || CASE WHEN k > 0 THEN -1 ELSE 0 END || ',-1,' || flags AS words, 4 AS n_layouts, u AS uuid1, -k AS uuid2 FROM u""",
    "array_directory": f"""WITH {_ARR}, v AS (SELECT name, high, i, CASE WHEN i % 4 <> 3 THEN i * 1.5 - k END::DOUBLE AS v FROM a, range(0, 15) r(i) WHERE i < high * 3 AND flags & 1 = 1) SELECT name, 2 AS rank, (any_value(high) * 3)::INTEGER AS size, round(min(v), 4) AS least, round(avg(v), 4) AS mean, round(max(v), 4) AS greatest FROM v GROUP BY 1""",
    "section_load": f"""WITH {_LOADED} SELECT 'file' || r AS file, 'SPP/KEY_' || k AS name, CASE WHEN defined THEN kind END AS kind, CASE WHEN defined THEN size END AS size, CASE WHEN defined THEN length END AS length,
        CASE WHEN defined THEN options ELSE 512 + 64 END AS options, CASE WHEN given THEN items ELSE '' END AS items, status FROM l""",
    "section_check": f"WITH {_LOADED} SELECT 'file' || r AS file, count(*) AS n FROM l WHERE defined AND ('KEY_' || k) LIKE 'KEY$_1%' ESCAPE '$' GROUP BY 1",
    "store_restart": """WITH o AS (SELECT p_partkey AS n, p_brand, 64 + CASE WHEN p_partkey % 2 = 0 THEN 256 ELSE 1024 END + CASE WHEN p_partkey % 3 = 0 THEN 2048 ELSE 0 END + CASE WHEN p_partkey % 5 = 0 THEN 128 ELSE 0 END + CASE WHEN p_partkey % 7 = 0 THEN 8 ELSE 0 END + 4 AS o FROM part),
        p AS (SELECT *, CASE WHEN n % 3 = 0 THEN o & ~256 ELSE o END AS a FROM o), q AS (SELECT *, CASE WHEN n % 5 = 0 THEN (a & ~1024) | 256 ELSE a END AS b FROM p) SELECT n AS p_partkey, CASE WHEN n % 7 = 0 THEN b & ~64 ELSE b END AS options, CASE WHEN n % 7 <> 0 THEN p_brand END AS item FROM q""",
    "rules_from_file": f"WITH {_RULED} SELECT p_partkey, rule FROM r WHERE rule > 1",
    "rules_hits": f"WITH {_RULED} SELECT t.number::INTEGER AS number, t.number > 1 AS desire, count(p_partkey) AS n FROM range(1, 5) t(number) LEFT JOIN r ON rule = t.number GROUP BY t.number",
}
