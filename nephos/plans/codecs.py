"""Queries of codes: levels, dates, grid descriptors, bits, missing values, packing and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from nephos.functions import codecs, dates, descriptors, levels
from nephos.operators import store
from nephos.plans.base import r4, read


def level_encode(spark, d):
    p = read(spark, d, "part")
    return p.select(
        "p_partkey",
        levels.encode(F.col("p_size").cast("double"), 2).alias("ip_new"),
        levels.encode_old(F.col("p_size").cast("double"), 2).alias("ip_old"),
        levels.encode_old(F.col("p_size") / 100.0, 1).alias("ip_sigma"),
        levels.encode_old(F.col("p_size") * 10.0, 0).alias("ip_height"),
    )


def level_decode(spark, d):
    code = F.lit(39845888 - 0) + F.col("p_size") * 7
    value, kind = levels.decode(code)
    old, old_kind = levels.decode(F.col("p_size") * 40)
    return read(spark, d, "part").select("p_partkey", r4(value).alias("value"), kind.alias("kind"), r4(old).alias("old_value"), old_kind.alias("old_kind"))


def level_round_trip(spark, d):
    value, kind = levels.decode(levels.encode(F.round("p_retailprice", 2), 4))
    return read(spark, d, "part").select("p_partkey", F.round(value, 1).alias("value"), kind.alias("kind"))


def date_stamp_encode(spark, d):
    at = F.col("ts")
    day, time = dates.printable(at)
    return read(spark, d, "events").select("event_id", dates.stamp(at).alias("stamp"), dates.ticks(at).alias("ticks"), day.alias("day"), time.alias("time"))


def date_stamp_old(spark, d):
    return read(spark, d, "orders").select("o_orderkey", dates.stamp(F.col("o_orderdate")).alias("stamp"))


def date_stamp_decode(spark, d):
    back = dates.unstamp(dates.stamp(F.col("ts")))
    return read(spark, d, "events").select("event_id", F.unix_seconds(back.cast("timestamp")).alias("seconds"))


def date_diff_incr(spark, d):
    o = read(spark, d, "orders")
    start = F.lit("1995-01-01").cast("timestamp")
    later = dates.add_hours(F.col("o_orderdate"), F.lit(7.5))
    return o.select("o_orderkey", r4(dates.hours_between(F.col("o_orderdate"), start)).alias("hours"), F.unix_seconds(later).alias("later"))


def calendar_360(spark, d):
    days = dates.days_360(F.year("o_orderdate"), F.month("o_orderdate"), F.least(F.dayofmonth("o_orderdate"), F.lit(30)))
    y, m, dd = dates.from_days_360(days + 45)
    plain = dates.days_365(F.year("o_orderdate"), F.month("o_orderdate"), F.dayofmonth("o_orderdate"))
    return read(spark, d, "orders").select("o_orderkey", days.alias("days"), y.alias("y"), m.alias("m"), dd.alias("d"), plain.alias("days_365"))


def grid_desc_pack(spark, d):
    s = read(spark, d, "supplier").select("s_suppkey", *[(F.col("s_suppkey") % n + 0.25).alias(f"xg{i}") for i, n in enumerate((90, 180, 7, 11), 1)])
    n, l = descriptors.pack("N", *[F.col(f"xg{i}") for i in range(1, 5)]), descriptors.pack("L", *[F.col(f"xg{i}") for i in range(1, 5)])
    return s.select("s_suppkey", *[c.cast("long").alias(f"n{i}") for i, c in enumerate(n, 1)], *[c.cast("long").alias(f"l{i}") for i, c in enumerate(l, 1)])


def missing_encode(spark, d):
    s = read(spark, d, "supplier").withColumn("v", F.when(F.col("s_acctbal") >= 0, F.round("s_acctbal", 2)))
    x = s.groupBy("s_nationkey").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    j = s.join(x, "s_nationkey")
    plug = codecs.plug(F.col("lo"), F.col("hi"), 6)
    return j.select("s_suppkey", r4(F.coalesce("v", plug)).alias("coded"))


def missing_decode(spark, d):
    coded = missing_encode(spark, d).withColumn("g", F.col("s_suppkey") % 5)
    most = coded.groupBy("g").agg(F.max("coded").alias("most"))
    return coded.join(most, "g").select("s_suppkey", F.when(F.col("coded") != F.col("most"), F.col("coded")).alias("value"))


def bits_get_put(spark, d):
    k = F.col("o_orderkey")
    return read(spark, d, "orders").select("o_orderkey", codecs.get_bits(k, 3, 5).alias("got"), codecs.put_bits(k, k % 100, 4, 6).alias("put"))


def hash_md5(spark, d):
    return read(spark, d, "part").select("p_partkey", F.md5(F.col("p_name").cast("binary")).alias("md5"), F.sha2("p_name", 256).alias("sha"))


def crc(spark, d):
    name = F.col("p_name").cast("binary")
    sums = [codecs.crc16(name, seed, step) for seed, step in ((F.lit(0), 1), (F.col("p_size") * 257, 1), (F.lit(0xFFFF), 4))]
    return read(spark, d, "part").select("p_partkey", *[c.cast("long").alias(f"crc{i}") for i, c in enumerate(sums)], F.crc32(name).alias("crc32"))


def pack_quantised(spark, d):
    c = read(spark, d, "customer")
    x = c.groupBy("c_nationkey").agg(F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi"))
    code = codecs.pack(F.col("c_acctbal"), F.col("lo"), F.col("hi"), 12)
    return c.join(x, "c_nationkey").select("c_custkey", code.alias("code"), F.round(codecs.unpack(code, F.col("lo"), F.col("hi"), 12), 3).alias("back"))


def run_lengths(spark, d):
    e = read(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("a"))
    t = e.select("user_id", F.transform("a", lambda x: x["event_type"]).alias("types"))
    coded = t.withColumn("runs", codecs.runs(F.col("types")))
    return coded.select("user_id", F.size("runs").cast("long").alias("n_runs"), F.size("types").cast("long").alias("n"), (codecs.unrun(F.col("runs")) == F.col("types")).alias("same"))


def kv_prefix(spark, d):
    entries = store.entries(read(spark, d, "nation").select(F.concat(F.lit("geo/"), F.col("n_name")).alias("name"), F.col("n_nationkey").cast("string").alias("value")))
    return store.keys(entries, "GEO/NATION_1").select("name", "value")


def kv_rewrite(spark, d):
    n = read(spark, d, "nation").select("n_name", "n_regionkey", "n_nationkey")
    writes = n.select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("name"), F.col("n_name").alias("value"), F.col("n_nationkey").cast("long").alias("turn"), F.lit(True).alias("rewritable"))
    return store.last_written(writes, "turn").select("name", "value")


QUERIES = {f.__name__: f for f in (level_encode, level_decode, level_round_trip, date_stamp_encode, date_stamp_old, date_stamp_decode, date_diff_incr, calendar_360, grid_desc_pack, missing_encode, missing_decode, bits_get_put, hash_md5, crc, pack_quantised, run_lengths, kv_prefix, kv_rewrite)}
_EIGHT = "[0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]"


def _bytes(step: int) -> str:
    return f"list_transform(range(0, length(p_name), {step}), lambda i: ascii(substr(p_name, i + 1, 1))::BIGINT)"


def _crc(seed: str, step: int) -> str:
    """Bit by bit."""
    bit = "CASE WHEN c & 32768 > 0 THEN xor(c << 1, 4129) & 65535 ELSE c << 1 END"
    return f"list_reduce(list_prepend(({seed})::BIGINT, {_bytes(step)}), lambda h, b: list_reduce(list_prepend(xor(h, b << 8), {_EIGHT}), lambda c, k: {bit}))"


_T = "floor((epoch(ts) - 315532800) / 5)::BIGINT"
_CODED = """WITH s AS (SELECT s_suppkey, s_nationkey, CASE WHEN s_acctbal >= 0 THEN round(s_acctbal, 2) END AS v FROM supplier),
    x AS (SELECT s_nationkey, min(v) AS lo, max(v) AS hi FROM s GROUP BY 1),
    c AS (SELECT s_suppkey, round(coalesce(v, CASE WHEN hi + (hi - lo) * 0.035 <> hi THEN hi + (hi - lo) * 0.035 WHEN hi = 0 THEN 1 ELSE hi * 2 END), 4) AS coded FROM s JOIN x USING (s_nationkey))"""
ORACLE_SQL = {
    "level_encode": """SELECT p_partkey, (2 << 24)::BIGINT + CASE WHEN p_size < 10 THEN 9 ELSE 8 END * 1048576 + (p_size * CASE WHEN p_size < 10 THEN 100000 ELSE 10000 END)::BIGINT AS ip_new,
        CASE WHEN p_size >= 10 THEN p_size ELSE p_size * 20 + 1800 END::BIGINT AS ip_old, (p_size * 100 + 2000)::BIGINT AS ip_sigma, (12001 + p_size * 2)::BIGINT AS ip_height FROM part""",
    "level_decode": """SELECT p_partkey, round(((39845888 + p_size * 7) & 1048575) / power(10.0, (((39845888 + p_size * 7) >> 20) & 15) - 4), 4) AS value, (((39845888 + p_size * 7) >> 24) & 15)::INTEGER AS kind,
        round(CASE WHEN c < 1100 THEN c WHEN c <= 1200 THEN 1200 - c WHEN c < 1400 THEN (c - 1200) / 20000.0 WHEN c < 1600 THEN (c - 1400) / 2000.0 WHEN c < 1800 THEN (c - 1600) / 200.0 WHEN c < 2000 THEN (c - 1800) / 20.0 ELSE (c - 2000) / 10000.0 END, 4)::DOUBLE AS old_value,
        CASE WHEN c < 1100 THEN 2 WHEN c <= 1200 THEN 3 WHEN c < 2000 THEN 2 ELSE 1 END AS old_kind FROM (SELECT *, p_size * 40 AS c FROM part)""",
    "level_round_trip": "SELECT p_partkey, round(round(p_retailprice, 2), 1) AS value, 4 AS kind FROM part",
    "date_stamp_encode": f"""SELECT event_id, CASE WHEN year(ts) >= 2000 THEN 123200000 + ({_T} // 8) * 10 + {_T} % 8 END AS stamp, {_T} AS ticks,
        (year(ts) * 10000 + month(ts) * 100 + day(ts))::BIGINT AS day, (hour(ts) * 1000000 + minute(ts) * 10000 + second(ts) * 100)::BIGINT AS time FROM events""",
    "date_stamp_old": """SELECT o_orderkey, CASE WHEN year(o_orderdate) >= 2000 OR (year(o_orderdate) >= 1980 AND (minute(o_orderdate) <> 0 OR second(o_orderdate) <> 0)) THEN 123200000 + (t // 8) * 10 + t % 8
        ELSE month(o_orderdate) * 10000000 + day(o_orderdate) * 100000 + (year(o_orderdate) - 1900) * 1000 + hour(o_orderdate) * 10 END AS stamp FROM (SELECT *, floor((epoch(o_orderdate) - 315532800) / 5)::BIGINT AS t FROM orders)""",
    "date_stamp_decode": "SELECT event_id, (floor(epoch(ts) / 5) * 5)::BIGINT AS seconds FROM events",
    "date_diff_incr": "SELECT o_orderkey, round((epoch(o_orderdate) - epoch(TIMESTAMP '1995-01-01')) / 3600, 4) AS hours, (epoch(o_orderdate) + 27000)::BIGINT AS later FROM orders",
    "calendar_360": """SELECT o_orderkey, days, ((days + 45) // 360)::INTEGER AS y, (((days + 45) % 360) // 30 + 1)::INTEGER AS m, ((days + 45) % 30 + 1)::INTEGER AS d,
        (year(o_orderdate) * 365 + [0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334][month(o_orderdate)] + day(o_orderdate) - 1)::BIGINT AS days_365 FROM (
        SELECT o_orderkey, o_orderdate, (year(o_orderdate) * 360 + (month(o_orderdate) - 1) * 30 + least(day(o_orderdate), 30) - 1)::BIGINT AS days FROM orders)""",
    "grid_desc_pack": """SELECT s_suppkey, round(xg2 * 10)::BIGINT AS n1, round(xg1 * 10)::BIGINT AS n2, round(xg4 * 100)::BIGINT AS n3, round(xg3 * 0.01)::BIGINT AS n4,
        round(xg3 * 100)::BIGINT AS l1, round(xg4 * 100)::BIGINT AS l2, round((90 + xg1) * 100)::BIGINT AS l3, round(xg2 * 100)::BIGINT AS l4
        FROM (SELECT s_suppkey, s_suppkey % 90 + 0.25 AS xg1, s_suppkey % 180 + 0.25 AS xg2, s_suppkey % 7 + 0.25 AS xg3, s_suppkey % 11 + 0.25 AS xg4 FROM supplier)""",
    "missing_encode": f"{_CODED} SELECT * FROM c",
    "missing_decode": f"{_CODED} SELECT s_suppkey, CASE WHEN coded <> max(coded) OVER (PARTITION BY s_suppkey % 5) THEN coded END AS value FROM c",
    "bits_get_put": "SELECT o_orderkey, (o_orderkey >> 3) & 31 AS got, (o_orderkey & ~(63 << 4)::BIGINT) | (((o_orderkey % 100) & 63) << 4) AS put FROM orders",
    "crc": f"""SELECT p_partkey, {_crc('0', 1)} AS crc0, {_crc('p_size * 257', 1)} AS crc1, {_crc('65535', 4)} AS crc2,
        xor(list_reduce(list_prepend(4294967295::BIGINT, {_bytes(1)}), lambda h, b: list_reduce(list_prepend(xor(h, b), {_EIGHT}), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)), 4294967295) AS crc32 FROM part""",
    "hash_md5": "SELECT p_partkey, md5(p_name) AS md5, sha256(p_name) AS sha FROM part",
    "pack_quantised": """SELECT c_custkey, code, round(lo + code * (hi - lo) / 4095, 3) AS back FROM (SELECT c_custkey, lo, hi, round((c_acctbal - lo) / (hi - lo) * 4095)::BIGINT AS code FROM customer JOIN
        (SELECT c_nationkey, min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer GROUP BY 1) USING (c_nationkey))""",
    "run_lengths": """SELECT user_id, sum(CASE WHEN event_type IS DISTINCT FROM p THEN 1 ELSE 0 END)::BIGINT AS n_runs, count(*) AS n, true AS same FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) GROUP BY 1""",
    "kv_prefix": "SELECT 'GEO/' || upper(n_name) AS name, n_nationkey::VARCHAR AS value FROM nation WHERE upper(n_name) LIKE 'NATION$_1%' ESCAPE '$'",
    "kv_rewrite": "SELECT 'R' || n_regionkey AS name, arg_max(n_name, n_nationkey) AS value FROM nation GROUP BY 1",
}
