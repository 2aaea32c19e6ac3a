"""Queries of level codes: all kinds, ranges and pairs in triples of codes, text; grid descriptors; integers' missing codes."""

from __future__ import annotations

from pyspark.sql import functions as F

from nephos.functions import codecs, descriptors, levels
from nephos.plans.base import r4, read, spread

#: Kinds, and the value of each as a factor of the row's size (1 to 50) and an offset.
SPREAD = {0: (-300.0, 9000.0), 1: (0.02, 0.0), 2: (21.5, 0.0), 3: (-1234.5, 30000.0), 4: (0.37, -9.0), 5: (0.0199, 0.0), 6: (3001.0, 0.0), 7: (377.7, 0.0), 10: (1e6, 0.0), 15: (1234.0, 0.0), 17: (3.0, 0.0), 21: (12345.0, 0.0)}


def _kinds(spark, d):
    p = read(spark, d, "part").select("p_partkey", "p_size", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(a).alias("a"), F.lit(b).alias("b")) for k, (a, b) in SPREAD.items()])).alias("s"))
    return p.select("p_partkey", "s.kind", (F.col("p_size") * F.col("s.a") + F.col("s.b")).alias("v"))


def level_kinds_encode(spark, d):
    return _kinds(spark, d).select("p_partkey", "kind", levels.encode(F.col("v"), F.col("kind")).alias("code"))


def level_kinds_decode(spark, d):
    """Codes of every kind and power, made of bits; kinds that share a number are told apart by their bounds."""
    n = F.col("p_partkey")
    code = (n % 16) * (1 << 24) + (n % 11 + 2) * (1 << 20) + (n * 7919) % 1_048_000
    value, kind = levels.decode(code)
    return read(spark, d, "part").select("p_partkey", F.round(value, 3).alias("value"), kind.alias("kind"))


def _rp(lo, hi, kind):
    return F.struct(lo.cast("double").alias("lo"), hi.cast("double").alias("hi"), kind.cast("int").alias("kind"))


def _triples(spark, d):
    """Levels and times, a third of each as ranges, every kind of level, and some errors."""
    n, s = F.col("p_partkey"), F.col("p_size").cast("double")
    kind = F.element_at(F.array(*[F.lit(k) for k in (0, 1, 2, 4, 5, 10)]), (n % 6 + 1).cast("int"))
    size = s / F.when(kind.isin(1, 5), 100.0).otherwise(1.0)
    level = _rp(size, F.when(n % 3 == 1, size / 2).otherwise(size), kind)
    time = _rp(s, F.when(n % 5 == 2, s + 6).otherwise(s), F.when(n % 17 == 0, 3).otherwise(10))
    return read(spark, d, "part").select("p_partkey", level.alias("level"), time.alias("time"), _rp(s + 0.5, s + 0.5, F.lit(3)).alias("other"))


def level_ranges_encode(spark, d):
    x = _triples(spark, d).withColumn("x", levels.encode_ranges(F.col("level"), F.col("time"), F.col("other")))
    return x.select("p_partkey", "x.ip1", "x.ip2", "x.ip3", "x.status")


def level_ranges_decode(spark, d):
    x = _triples(spark, d).withColumn("x", levels.encode_ranges(F.col("level"), F.col("time"), F.col("other")))
    x = x.where("x.status = 0").withColumn("y", levels.decode_ranges(F.col("x.ip1"), F.col("x.ip2"), F.col("x.ip3")))
    parts = [F.round(F.col(f"y.{p}.{e}"), 4).alias(f"{p}_{e}") for p in ("level", "time", "other") for e in ("lo", "hi")]
    return x.select("p_partkey", *parts, *[F.col(f"y.{p}.kind").alias(f"{p}_kind") for p in ("level", "time", "other")], "y.status")


def _pairs(spark, d):
    n, s = F.col("p_partkey"), F.col("p_size").cast("double")
    k1 = F.element_at(F.array(F.lit(2), F.lit(0), F.lit(4), F.lit(10)), (n % 4 + 1).cast("int"))
    k2 = F.when(n % 3 == 0, k1).otherwise(F.lit(10))
    k3 = F.when(n % 5 < 3, F.lit(10)).otherwise(F.lit(3))
    return read(spark, d, "part").select("p_partkey", s.alias("p1"), k1.alias("k1"), (51 - s).alias("p2"), k2.alias("k2"), (s * 2).alias("p3"), k3.alias("k3"))


def level_pairs_encode(spark, d):
    x = _pairs(spark, d).withColumn("x", levels.encode_pairs(*[F.col(c) for c in ("p1", "k1", "p2", "k2", "p3", "k3")]))
    return x.select("p_partkey", "x.ip1", "x.ip2", "x.ip3", "x.status")


def _codes(spark, d):
    """Every old-style band, new-style levels and times, and times in first place."""
    n = F.col("p_partkey")
    new = lambda v, k: levels.encode(v.cast("double"), k)
    one = F.when(n % 3 == 0, new(F.col("p_size"), 2)).when(n % 3 == 1, n * 37 % 32000).otherwise(new(F.col("p_size"), 10))
    two = F.when(n % 4 < 2, n % 240).when(n % 4 == 2, new(n % 48, 10)).otherwise(new(F.col("p_size") + 5, 2))
    three = F.when(n % 2 == 0, n % 90).otherwise(new(n % 36, 10))
    return spread(read(spark, d, "part").select("p_partkey", "p_size")).select("p_partkey", one.alias("ip1"), two.alias("ip2"), three.alias("ip3"))


def level_pairs_decode(spark, d):
    x = _codes(spark, d).withColumn("x", levels.decode_pairs(F.col("ip1"), F.col("ip2"), F.col("ip3")))
    return x.select("p_partkey", *[F.round(F.col(f"x.p{i}"), 6).alias(f"p{i}") for i in (1, 2, 3)], *[f"x.kind{i}" for i in (1, 2, 3)], "x.status")


def level_codes_text(spark, d):
    return _codes(spark, d).select("p_partkey", levels.codes_text(F.col("ip1"), F.col("ip2"), F.col("ip3")).alias("text"))


def level_units(spark, d):
    k = F.col("p_partkey").cast("int") - 3
    return read(spark, d, "part").where("p_partkey < 200").select(
        "p_partkey", levels.unit_of(k).alias("unit"), levels.is_level(k).alias("level"), levels.ascending(k).alias("up"), levels.descending(k).alias("down"), levels.is_invalid_kind(k).alias("invalid")
    )


def grid_desc_polar(spark, d):
    """Polar grids whose poles are on the grid, off it, and in either hemisphere; both forms and back."""
    n = F.col("p_partkey")
    x = [(n % 401) - 100.25, (n % 307) - 50.5, F.when(n % 3 == 0, 381000.0).otherwise(50000.0 + n % 100 * 100.0), (n % 720) / 2.0 - 180.0]
    out = {f"{kind}{i}": c for kind in "NS" for i, c in enumerate(descriptors.pack(kind, *[c.cast("double") for c in x]), 1)}
    p = read(spark, d, "part").select("p_partkey", *[c.alias(k) for k, c in out.items()])
    back = [c.alias(f"b{kind}{i}") for kind in "NS" for i, c in enumerate(descriptors.unpack(kind, *[F.col(f"{kind}{k}") for k in (1, 2, 3, 4)]), 1)]
    rows = p.select("*", *back)
    return rows.select("p_partkey", *[F.col(k).cast("long").alias(k.lower()) for k in out], *[F.round(F.col(f"b{kind}{i}"), 2 if i < 3 else 1).alias(f"back_{kind.lower()}{i}") for kind in "NS" for i in (1, 2, 3, 4)])


def grid_desc_rotated(spark, d):
    """Two points in fortieths of a degree, which come back as they are."""
    n = F.col("p_partkey")
    x = [(n % 7200) / 40.0 - 90, (n * 7 % 14400) / 40.0, (n * 11 % 3600) / 40.0 - 89.975, (n * 13 % 14400) / 40.0]
    g = descriptors.pack("E", *x)
    p = read(spark, d, "part").select("p_partkey", *[c.alias(f"g{i}") for i, c in enumerate(g, 1)])
    back = descriptors.unpack("E", *[F.col(f"g{i}") for i in (1, 2, 3, 4)])
    return p.select("p_partkey", *[F.col(f"g{i}").cast("long").alias(f"g{i}") for i in (1, 2, 3, 4)], *[F.round(c, 3).alias(f"x{i}") for i, c in enumerate(back, 1)])


def grid_desc_point(spark, d):
    n = F.col("p_partkey")
    g = descriptors.pack("+", (n * 12340 % 18_000_000 + 3) / 100_000.0 - 90, (n * 65530 % 36_000_000 + 7) / 100_000.0 - 180, F.lit(0.0), F.lit(0.0))
    p = read(spark, d, "part").select("p_partkey", *[c.alias(f"g{i}") for i, c in enumerate(g, 1)])
    back = descriptors.unpack("+", *[F.col(f"g{i}") for i in (1, 2, 3, 4)])
    return p.select("p_partkey", *[F.col(f"g{i}").cast("long").alias(f"g{i}") for i in (1, 2, 3, 4)], F.round(back[0], 5).alias("lat"), F.round(back[1], 5).alias("lon"))


def missing_integers(spark, d):
    """Signed and unsigned fields by brand; with few bits, the code is one that values have, too."""
    p = read(spark, d, "part").select("p_brand", "p_partkey", F.when(F.col("p_size") % 7 != 0, F.col("p_size")).alias("z"))
    most = p.groupBy("p_brand").agg(F.max("z").alias("most"))
    codes = {f"{'s' if signed else 'u'}{bits}": codecs.plug_integer(F.col("most"), bits, signed) for signed in (True, False) for bits in (5, 6, 16, 32)}
    return p.join(most, "p_brand").select("p_partkey", *[F.coalesce(F.col("z").cast("long"), c).alias(k) for k, c in codes.items()])


QUERIES = {
    f.__name__: f
    for f in (level_kinds_encode, level_kinds_decode, level_ranges_encode, level_ranges_decode, level_pairs_encode, level_pairs_decode, level_codes_text, level_units, grid_desc_polar, grid_desc_rotated, grid_desc_point, missing_integers)
}


def _enc(v: str, k: str) -> str:
    """The code of value v and kind k by logarithms."""
    t = f"(CASE WHEN {k} IN (6, 17) THEN greatest({v}, 1) * CASE WHEN {k} = 17 THEN -1 ELSE 1 END WHEN {k} = 21 THEN greatest({v}, 1.001e-4) * 1e4 ELSE {v} END)"
    e = f"greatest(0, least(15, CASE WHEN {t} = 0 THEN 15 WHEN {t} > 0 THEN 9 - floor(log10({t})) ELSE 4 + ceil(log10(4800 / -{t}) - 1e-12) END))::BIGINT"
    m = f"(round(abs({t}) * pow(10::DOUBLE, {e} - 4))::BIGINT + CASE WHEN {t} < 0 THEN 1000000 ELSE 0 END)"
    return f"(CASE WHEN {k} = 2 AND {v} = 0 THEN 0 WHEN {k} = 15 THEN 15 * 16777216 + round({v}) WHEN {v} BETWEEN {_case(k, 0)} AND {_case(k, 1)} THEN ({k} & 15) * 16777216 + {e} * 1048576 + {m} ELSE -999999 END)::BIGINT"


def _case(k: str, end: int) -> str:
    return f"CASE {k} " + " ".join(f"WHEN {n} THEN {b[end]!r}" for n, b in levels.BOUNDS.items()) + " END"


def _dec(c: str, what: str) -> str:
    """The value or the kind of code c."""
    raw = f"((CASE WHEN {c} & 1048575 > 1000000 THEN 1000000 - ({c} & 1048575) ELSE {c} & 1048575 END) / pow(10.0::DOUBLE, (({c} >> 20) & 15) - 4))"
    k = f"(({c} >> 24) & 15)"
    cases = [f"WHEN {k} = 15 AND {c} & 16777215 <= 2000000 THEN " + ("15" if what == "kind" else f"({c} & 16777215)::DOUBLE")]
    for first in (0, 1, 2, 3, 4, 5, 6, 7, 10):
        for real in (first, first + 16):
            if real in levels.BOUNDS and real != 15:
                low, high = levels.BOUNDS[real]
                v = {17: f"(-{raw})", 21: f"({raw} / 1e4)"}.get(real, raw)
                cases.append(f"WHEN {k} = {first} AND {v} BETWEEN {low!r} AND {high!r} THEN " + (str(real) if what == "kind" else v))
    new = f"CASE {' '.join(cases)} ELSE {'-1' if what == 'kind' else '-999999.0'} END"
    if what == "kind":
        old = f"CASE WHEN {c} > 12000 AND {c} <= 32000 THEN 0 WHEN {c} BETWEEN 2000 AND 12000 THEN 1 WHEN {c} BETWEEN 0 AND 1099 OR {c} BETWEEN 1201 AND 1999 THEN 2 ELSE 3 END"
    else:
        old = f"""CASE WHEN {c} > 12000 AND {c} <= 32000 THEN 5.0 * ({c} - 12001) WHEN {c} BETWEEN 2000 AND 12000 THEN ({c} - 2000) / 10000.0 WHEN {c} < 1100 THEN {c} WHEN {c} <= 1200 THEN 1200 - {c} WHEN {c} < 1400 THEN ({c} - 1200) / 20000.0
            WHEN {c} < 1600 THEN ({c} - 1400) / 2000.0 WHEN {c} < 1800 THEN ({c} - 1600) / 200.0 WHEN {c} < 2000 THEN ({c} - 1800) / 20.0 ELSE {c} END"""
    return f"(CASE WHEN {c} > 32767 THEN {new} ELSE {old} END)::{'INTEGER' if what == 'kind' else 'DOUBLE'}"


_UP, _DOWN, _LEVELS = "(0, 4, 21)", "(1, 2, 7)", "(0, 1, 2, 3, 4, 5, 6, 7, 21)"
_KINDS = " UNION ALL ".join(f"SELECT p_partkey, {k} AS kind, p_size * {a!r}::DOUBLE + {b!r} AS v FROM part" for k, (a, b) in SPREAD.items())
_TRIPLES = """t0 AS (SELECT p_partkey, p_partkey AS n, p_size::DOUBLE AS s, [0, 1, 2, 4, 5, 10][p_partkey % 6 + 1] AS k1 FROM part),
    t AS (SELECT p_partkey, k1, s / CASE WHEN k1 IN (1, 5) THEN 100.0 ELSE 1.0 END AS lo1, lo1 / CASE WHEN n % 3 = 1 THEN 2 ELSE 1 END AS hi1, s AS lo2, s + CASE WHEN n % 5 = 2 THEN 6 ELSE 0 END AS hi2, CASE WHEN n % 17 = 0 THEN 3 ELSE 10 END AS k2, s + 0.5 AS lo3 FROM t0),
    o AS (SELECT *, CASE WHEN hi1 <> lo1 AND k1 IN (0, 4) THEN hi1 ELSE lo1 END AS a, CASE WHEN hi1 <> lo1 AND k1 IN (0, 4) THEN lo1 ELSE hi1 END AS b,
      k1 = 10 OR k2 <> 10 OR (hi1 <> lo1 AND hi2 <> lo2) AS bad, greatest(lo2, hi2) AS tt, least(lo2, hi2) AS tb FROM t),
    q AS (SELECT *, CASE WHEN hi1 <> lo1 THEN b WHEN hi2 <> lo2 THEN tb ELSE lo3 END AS c, CASE WHEN hi1 <> lo1 THEN k1 WHEN hi2 <> lo2 THEN 10 ELSE 3 END AS k3 FROM o)"""
# Halved, a range's second end is the lesser: lower for heights, higher for pressures and sigma, and hybrid stays.
_PAIRS = """p AS (SELECT p_partkey, p_size::DOUBLE AS p1, [2, 0, 4, 10][p_partkey % 4 + 1] AS k1, 51.0 - p_size AS p2, p_size * 2.0 AS p3, CASE WHEN p_partkey % 5 < 3 THEN 10 ELSE 3 END AS k3 FROM part),
    q AS (SELECT *, CASE WHEN p_partkey % 3 = 0 THEN k1 ELSE 10 END AS k2 FROM p)"""
_CODES = f"""n AS (SELECT p_partkey, p_partkey AS n, p_size::DOUBLE AS s FROM part), c AS (SELECT p_partkey, CASE n % 3 WHEN 0 THEN {_enc('s', '2')} WHEN 1 THEN n * 37 % 32000 ELSE {_enc('s', '10')} END::BIGINT AS ip1,
    CASE WHEN n % 4 < 2 THEN n % 240 WHEN n % 4 = 2 THEN {_enc('(n % 48)::DOUBLE', '10')} ELSE {_enc('(s + 5)', '2')} END::BIGINT AS ip2, CASE WHEN n % 2 = 0 THEN n % 90 ELSE {_enc('(n % 36)::DOUBLE', '10')} END::BIGINT AS ip3 FROM n),
    w AS (SELECT *, {_dec('ip1', 'kind')} = 10 AS sw FROM c), x AS (SELECT p_partkey, ip1 AS c1, ip2 AS c2, sw, CASE WHEN sw THEN ip2 ELSE ip1 END AS ip1, CASE WHEN sw THEN ip1 ELSE ip2 END AS ip2, ip3 FROM w),
    d AS (SELECT *, {_dec('ip1', 'value')} AS p1, {_dec('ip1', 'kind')} AS k1, CASE WHEN ip2 < 32768 THEN ip2::DOUBLE ELSE {_dec('ip2', 'value')} END AS p2, CASE WHEN ip2 < 32768 THEN 10 ELSE {_dec('ip2', 'kind')} END AS k2,
      CASE WHEN ip3 < 32768 THEN ip3::DOUBLE ELSE {_dec('ip3', 'value')} END AS p3, CASE WHEN ip3 < 32768 THEN 3 ELSE {_dec('ip3', 'kind')} END AS k3 FROM x),
    e AS (SELECT *, k1 NOT IN {_LEVELS} OR (k2 NOT IN {_LEVELS} AND k2 <> 10) OR k3 < 0 AS bad, (CASE WHEN sw THEN 32 ELSE 0 END) | (CASE WHEN ip1 < 32768 THEN 2 ELSE 0 END) | (CASE WHEN ip2 < 32768 THEN 2 ELSE 0 END)
      | (CASE WHEN ip2 >= 32768 AND k2 IN {_LEVELS} THEN 32 ELSE 0 END) | (CASE WHEN ip3 < 32768 THEN 8 ELSE 0 END) AS st, k1 = k2 AND k3 = 10 AS layer FROM d),
    f AS (SELECT *, CASE WHEN layer THEN p3 ELSE p2 END AS q2, CASE WHEN layer THEN p2 ELSE p3 END AS q3, CASE WHEN layer THEN k3 ELSE k2 END AS m2, CASE WHEN layer THEN k2 ELSE k3 END AS m3 FROM e),
    g AS (SELECT *, k1 = m3 AND ((k1 IN {_UP} AND p1 > q3) OR (k1 IN {_DOWN} AND p1 < q3)) AS turn, m2 = m3 AND m2 = 10 AND q2 < q3 AS later FROM f),
    h AS (SELECT *, CASE WHEN turn THEN q3 ELSE p1 END AS r1, CASE WHEN later THEN q3 ELSE q2 END AS r2, CASE WHEN turn THEN p1 WHEN later THEN q2 ELSE q3 END AS r3 FROM g)"""
_UNIT = "CASE {k} " + " ".join(f"WHEN {k} THEN '{u}'" for k, u in levels.UNITS.items()) + " ELSE '??' END"
_SIX = "regexp_replace(printf('%g', {v}), 'e([+-])([0-9])$', 'e\\10\\2')"


def _part(v: str, code: str, k: str) -> str:
    return f"printf('%g', CASE WHEN bad THEN {code}::DOUBLE ELSE {v} END) || ' (' || CASE WHEN bad THEN '_0' ELSE {_UNIT.format(k=k)} END || ')'"


def _polar(kind: str) -> str:
    s = -1 if kind == "S" else 1
    return f"""SELECT *, abs(g2r) > 1800 AS wide, CASE WHEN beyond THEN round(x3 * CASE WHEN x3 > 204700 THEN 0.001 ELSE 0.01 END) ELSE o1 END::BIGINT AS g1,
        CASE WHEN beyond THEN CASE WHEN abs(g2r) > 1800 THEN abs(abs(g2r) - 3600) ELSE abs(g2r) END ELSE o2 END::BIGINT AS g2,
        CASE WHEN beyond THEN CASE WHEN x3 > 204700 THEN 32768 ELSE 0 END + round((CASE WHEN {s} * lon < 0 THEN {s} * lon + 360 ELSE {s} * lon END) * 32767 / 360) ELSE o3 END::BIGINT AS g3,
        CASE WHEN beyond THEN 32768 + CASE WHEN g2r < 0 THEN 16384 ELSE 0 END + CASE WHEN abs(g2r) > 1800 THEN 16384 ELSE 0 END + round((90 - {s} * lat) * 16383 / 180) ELSE o4 END::BIGINT AS g4 FROM ll"""


_POLAR = """n AS (SELECT p_partkey, p_partkey % 401 - 100.25::DOUBLE AS x1, p_partkey % 307 - 50.5::DOUBLE AS x2, CASE WHEN p_partkey % 3 = 0 THEN 381000.0 ELSE 50000.0 + p_partkey % 100 * 100.0 END::DOUBLE AS x3, (p_partkey % 720) / 2.0 - 180.0::DOUBLE AS x4 FROM part),
    o AS (SELECT *, round(x2 * 10)::BIGINT AS o1, round(x1 * 10)::BIGINT AS o2, round(x4 * 100)::BIGINT + CASE WHEN x4 < 0 THEN 36000 ELSE 0 END AS o3, round(x3 * 0.01)::BIGINT AS o4, round(x4 * 10)::BIGINT AS g2r, 1 - x1 AS x, 1 - x2 AS y, 1.866025 * 6.371e6 / x3 AS re FROM n),
    lo AS (SELECT *, o1 < 0 OR o2 < 0 OR o1 > 2047 OR o2 > 2047 OR o4 > 32000 AS beyond, degrees(asin((re * re - x * x - y * y) / (re * re + x * x + y * y))) AS lat, degrees(atan2(y, x)) - x4 AS raw FROM o),
    ll AS (SELECT *, CASE WHEN raw > 180 THEN raw - 360 WHEN raw < -180 THEN raw + 360 ELSE raw END AS lon FROM lo)"""


def _polar_back(kind: str) -> str:
    s = -1 if kind == "S" else 1
    return f"""SELECT p_partkey, g1, g2, g3, g4, CASE WHEN g4 < 32768 THEN g2 / 10.0 ELSE 1 - r * cos(radians(glon + ang)) END AS b1, CASE WHEN g4 < 32768 THEN g1 / 10.0 ELSE 1 - r * sin(radians(glon + ang)) END AS b2,
        CASE WHEN g4 < 32768 THEN g4 * 100.0 ELSE d60 END AS b3, CASE WHEN g4 < 32768 THEN g3 * 0.01 ELSE ang END AS b4 FROM (SELECT *, 1.866025 * 6.371e6 / nullif(d60, 0) * sqrt((1 - sin(radians(glat))) / (1 + sin(radians(glat)))) AS r FROM (
        SELECT *, g1 * CASE WHEN g3 > 32767 THEN 1000.0 ELSE 100.0 END::DOUBLE AS d60, CASE WHEN g4 - 32768 > 16383 THEN 360 - g2 * 0.1 ELSE g2 * 0.1 END::DOUBLE AS ang,
        {s} * (90 - (CASE WHEN g4 - 32768 > 16383 THEN g4 - 49152 ELSE g4 - 32768 END) * 180.0 / 16383) AS glat, {s} * (CASE WHEN g3 > 32767 THEN g3 - 32768 ELSE g3 END) * 360.0 / 32767 AS glon FROM {'south' if kind == 'S' else 'north'}))"""


ORACLE_SQL = {
    "level_kinds_encode": f"SELECT p_partkey, kind, {_enc('v', 'kind')} AS code FROM ({_KINDS})",
    "level_kinds_decode": f"WITH c AS (SELECT p_partkey, (p_partkey % 16) * 16777216 + (p_partkey % 11 + 2) * 1048576 + (p_partkey * 7919) % 1048000 AS c FROM part) SELECT p_partkey, round({_dec('c', 'value')}, 3) AS value, {_dec('c', 'kind')} AS kind FROM c",
    "level_ranges_encode": f"WITH {_TRIPLES} SELECT p_partkey, CASE WHEN bad THEN -1 ELSE {_enc('a', 'k1')} END AS ip1, CASE WHEN bad THEN -1 ELSE {_enc('tt', '10')} END AS ip2, CASE WHEN bad THEN -1 ELSE {_enc('c', 'k3')} END AS ip3, CASE WHEN bad THEN 64 ELSE 0 END AS status FROM q",
    "level_ranges_decode": f"""WITH {_TRIPLES}, i AS (SELECT *, {_enc('a', 'k1')} AS i1, {_enc('tt', '10')} AS i2, {_enc('c', 'k3')} AS i3 FROM q WHERE NOT bad),
        v AS (SELECT *, {_dec('i1', 'value')} AS v1, {_dec('i2', 'value')} AS v2, {_dec('i3', 'value')} AS v3 FROM i)
        SELECT p_partkey, round(v1, 4) AS level_lo, round(CASE WHEN k3 = k1 THEN v3 ELSE v1 END, 4) AS level_hi, k1 AS level_kind, round(CASE WHEN k3 = 10 THEN v3 ELSE v2 END, 4) AS time_lo, round(v2, 4) AS time_hi, 10 AS time_kind,
        CASE WHEN k3 = 3 THEN round(v3, 4) ELSE 0 END AS other_lo, CASE WHEN k3 = 3 THEN round(v3, 4) ELSE 0 END AS other_hi, CASE WHEN k3 = 3 THEN 3 ELSE -1 END AS other_kind, 0 AS status FROM v""".replace("round(v1, 4) AS level_lo, round(CASE WHEN k3 = k1 THEN v3 ELSE v1 END, 4) AS level_hi", "round(CASE WHEN k3 = k1 AND k1 IN (0, 4) THEN least(v1, v3) WHEN k3 = k1 AND k1 IN (1, 2) THEN greatest(v1, v3) ELSE v1 END, 4) AS level_lo, round(CASE WHEN k3 = k1 AND k1 IN (0, 4) THEN greatest(v1, v3) WHEN k3 = k1 AND k1 IN (1, 2) THEN least(v1, v3) WHEN k3 = k1 THEN v3 ELSE v1 END, 4) AS level_hi"),
    "level_pairs_encode": f"""WITH {_PAIRS}, c AS (SELECT *, {_enc('p1', 'k1')} AS c1, {_enc('p2', 'k2')} AS c2, {_enc('p3', 'k3')} AS c3, k1 = 10 OR (k2 <> 10 AND k2 <> k1) AS bad, k1 = k2 AND k3 = 10 AS layer,
          (p1 > p2 AND k1 IN (0, 4)) OR (p1 < p2 AND k1 = 2) AS turn, k2 = 10 AND k3 = 10 AND p2 < p3 AS later FROM q)
        SELECT p_partkey, CASE WHEN bad THEN -1 WHEN layer AND turn THEN c2 ELSE c1 END AS ip1, CASE WHEN bad THEN -1 WHEN layer OR later THEN c3 ELSE c2 END AS ip2, CASE WHEN bad THEN -1 WHEN layer THEN CASE WHEN turn THEN c1 ELSE c2 END WHEN later THEN c2 ELSE c3 END AS ip3,
        CASE WHEN bad THEN 64 WHEN k2 <> 10 THEN 32 ELSE 0 END AS status FROM c""",
    "level_pairs_decode": f"""WITH {_CODES} SELECT p_partkey, CASE WHEN NOT bad THEN round(r1, 6) END AS p1, CASE WHEN NOT bad THEN round(r2, 6) END AS p2, CASE WHEN NOT bad THEN round(r3, 6) END AS p3,
        CASE WHEN NOT bad THEN k1 END AS kind1, CASE WHEN NOT bad THEN m2 END AS kind2, CASE WHEN NOT bad THEN m3 END AS kind3, CASE WHEN bad THEN st | 64 ELSE st END AS status FROM h""",
    "level_codes_text": f"WITH {_CODES} SELECT p_partkey, 'IP1 ' || {_part('r1', 'c1', 'k1')} || ', IP2 ' || {_part('r2', 'c2', 'm2')} || ', IP3 ' || {_part('r3', 'ip3', 'm3')} AS text FROM h",
    "level_units": f"""SELECT p_partkey, CASE WHEN k < 0 THEN '!!' WHEN k > 31 AND k % 16 = 15 AND k < 160 THEN 'I' || (k // 16) WHEN k > 31 THEN '!!' ELSE {_UNIT.format(k='k')} END AS unit, k IN {_LEVELS} AS level, k IN {_UP} AS up, k IN {_DOWN} AS down,
        k < 0 OR (k > 31 AND k & 15 <> 15) AS invalid FROM (SELECT p_partkey, p_partkey - 3 AS k FROM part WHERE p_partkey < 200)""",
    "grid_desc_polar": f"""WITH {_POLAR}, north AS ({_polar('N')}), south AS ({_polar('S')}), bn AS ({_polar_back('N')}), bs AS ({_polar_back('S')})
        SELECT p_partkey, bn.g1 AS n1, bn.g2 AS n2, bn.g3 AS n3, bn.g4 AS n4, bs.g1 AS s1, bs.g2 AS s2, bs.g3 AS s3, bs.g4 AS s4, round(bn.b1, 2) AS back_n1, round(bn.b2, 2) AS back_n2, round(bn.b3, 1) AS back_n3, round(bn.b4, 1) AS back_n4,
        round(bs.b1, 2) AS back_s1, round(bs.b2, 2) AS back_s2, round(bs.b3, 1) AS back_s3, round(bs.b4, 1) AS back_s4 FROM bn JOIN bs USING (p_partkey)""",
    "grid_desc_rotated": """SELECT p_partkey, a // 4 AS g1, (CASE WHEN b < 0 THEN b + 7201 ELSE b END) // 4 AS g2, (c % 16384) * 4 + a % 4 AS g3, d * 4 + (CASE WHEN b < 0 THEN b + 7201 ELSE b END) % 4 AS g4,
        round(a / 40.0 - 90, 3)::DOUBLE AS x1, round((c - 3600) / 40.0, 3)::DOUBLE AS x2, round(b / 40.0, 3)::DOUBLE AS x3, round(d / 40.0, 3)::DOUBLE AS x4
        FROM (SELECT p_partkey, p_partkey % 7200 AS a, p_partkey * 11 % 3600 - 3599 AS b, p_partkey * 7 % 14400 + 3600 AS c, p_partkey * 13 % 14400 AS d FROM part)""",
    "grid_desc_point": """SELECT p_partkey, a - round(a / 1000.0)::BIGINT * 1000 + 1000 AS g1, b - round(b / 1000.0)::BIGINT * 1000 + 1000 AS g2, round(a / 1000.0)::BIGINT AS g3, round(b / 1000.0)::BIGINT AS g4, round(a / 100000.0 - 100, 5)::DOUBLE AS lat, round(b / 100000.0, 5)::DOUBLE AS lon
        FROM (SELECT p_partkey, p_partkey * 12340 % 18000000 + 1000003 AS a, CASE WHEN p_partkey * 65530 % 36000000 + 7 < 18000000 THEN p_partkey * 65530 % 36000000 + 18000007 ELSE p_partkey * 65530 % 36000000 - 17999993 END AS b FROM part)""",
    "missing_integers": "SELECT p_partkey, "
    + ", ".join(f"coalesce(z, CASE WHEN {top} > most THEN most + 1 ELSE {top} END)::BIGINT AS {n}" for n, top in (("s5", 15), ("s6", 31), ("s16", 32767), ("s32", 2147483647), ("u5", 31), ("u6", 63), ("u16", 65535), ("u32", 4294967295)))
    + " FROM (SELECT p_partkey, z, max(z) OVER (PARTITION BY p_brand) AS most FROM (SELECT p_partkey, p_brand, CASE WHEN p_size % 7 <> 0 THEN p_size END AS z FROM part))",
}
