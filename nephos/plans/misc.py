"""Queries of local projections, keyed digests, flags of missing values, options, stencils and headers of record files."""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nephos.functions import codecs, descriptors, sphere
from nephos.operators import directives, grids, gridset, records, scores, spectral
from nephos.plans.base import r4, read
from nephos.plans.defined import GRIDS, HALVES
from nephos.plans.files import _records, shared_folder
from nephos.sources import recordfile, tokens


def _places(spark, d):
    n = F.col("s_suppkey")
    return read(spark, d, "supplier").select(n, (n * 7 % 50 + 20.0).alias("lat"), (n * 31 % 90 + 225.5).alias("lon"))


def local_stereographic(spark, d):
    x, y = sphere.local_xy(F.col("lat"), F.col("lon"), 45.0, 270.0, 10_000.0, 200, 100)
    p = _places(spark, d).withColumns({"x": x, "y": y})
    lat, lon = sphere.local_latlon(F.col("x"), F.col("y"), 45.0, 270.0, 10_000.0, 200, 100)
    return p.select("s_suppkey", r4("x").alias("x"), r4("y").alias("y"), F.round(lat, 4).alias("lat"), F.round(lon, 4).alias("lon"))


def lambert_back(spark, d):
    x, y = sphere.lambert_xy(F.col("lat"), F.col("lon"), 30.0, 55.0, 45.0, 270.0)
    p = _places(spark, d).withColumns({"x": x, "y": y})
    lat, lon = sphere.lambert_latlon(F.col("x"), F.col("y"), 30.0, 55.0, 45.0, 270.0)
    return p.select("s_suppkey", F.round("x", 1).alias("x"), F.round("y", 1).alias("y"), F.round(lat, 4).alias("lat"), F.round(lon, 4).alias("lon"))


def hash_hmac(spark, d):
    data = F.col("p_name").cast("binary")
    return read(spark, d, "part").select("p_partkey", codecs.hmac_md5(data, b"key").alias("short"), codecs.hmac_md5(data, b"k" * 80).alias("long"))


def missing_flags(spark, d):
    """Flags out and back in, by default and of one's own."""
    v = F.when(F.col("p_size") % 4 != 0, F.col("p_size").cast("long"))
    kinds = ("i4", "i2", "i1", "u4", "u2", "u1")
    p = read(spark, d, "part").select("p_partkey", *[codecs.to_flag(v, k).alias(k) for k in kinds], codecs.to_flag(v.cast("double"), "real", {"real": -9.0}).alias("own"))
    return p.select("*", *[codecs.from_flag(F.col(k), k).alias(f"{k}_back") for k in ("i2", "u1")], codecs.from_flag(F.col("own"), "real", {"real": -9.0}).alias("own_back"))


def grid_options(spark, d):
    o = gridset.Options().set("DEGRE_INTERP", "lineaire").set("extrap_degree", "VALEUR").set("extrap_value", 7).set("weight_number", 6)
    rows = sorted((k, str(v)) for k, v in o.values.items())
    return spark.createDataFrame(rows, "name string, value string")


def field_by_options(spark, d):
    o = gridset.Options().set("degre_interp", "voisin").set("extrap_degree", "valeur").set("extrap_value", -5.0)
    e = read(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("z"))
    return o.regridded(e, "z", GRIDS["regional"], GRIDS["uneven"]).select("vec_id", "i", "j", r4("value").alias("value"))


def grid_halves(spark, d):
    rows = [(k, h.kind, h.ni, h.nj, float(h.numbers[0]), float(h.numbers[1])) for k, h in enumerate(HALVES.halves, 1)]
    return spark.createDataFrame(rows, "half long, kind string, ni long, nj long, lat double, lon double")


def stencil_points(spark, d):
    """Around every point of an 8 by 8 field, on the globe and on each half of it."""
    e = spark.range(0, 72).select((F.col("id") % 8 + 1).cast("int").alias("i"), F.floor(F.col("id") / 8).cast("int").alias("j"))
    parts = [e.select("i", "j", F.lit(p).alias("part"), F.explode(gridset.stencil(F.col("i"), F.col("j"), 8, 8, p)).alias("s")) for p in (0, 1, 2)]
    s = parts[0].union(parts[1]).union(parts[2])
    return s.groupBy("part", "i", "j").agg(F.count("*").alias("n"), F.sum(F.expr("s.column * s.row")).alias("product"), F.sum("s.column").alias("columns"), F.sum(F.expr("s.row * s.sign")).alias("rows"))


def record_file_headers(spark, d):
    """Headers of one file after another signature, erased records and some of them restored."""
    recordfile.register(spark)
    top = shared_folder(spark, "headers")
    _records(spark, d).coalesce(1).write.format("records").mode("append").save(top)
    path = recordfile.files(top)[0]
    recordfile.sign(path, "TEST")
    handles = [recordfile.handle(0, k) for k in range(20)]
    recordfile.erase(path, handles)
    recordfile.restore(path, handles[:5])
    sound = recordfile.check(spark, top).select("sound")
    return recordfile.headers(spark, top).drop("file").crossJoin(F.broadcast(sound))  # sound is one row


def pack_words(spark, d):
    """Tokens of 5, 13 and 16 bits, signed ones among them, in words and back."""
    z = F.transform("embedding", lambda x: F.floor(x.cast("double") * 100).cast("long"))
    e = read(spark, d, "embeddings").select("vec_id", F.slice(z, 1, 21).alias("z"))
    e = e.select("vec_id", "z", *[codecs.packed_words(F.col("z"), b).alias(f"w{b}") for b in (5, 13, 16)])
    back = codecs.unpacked_words(F.col("w13"), 13, F.size("z"), True)
    low = codecs.unpacked_words(F.col("w5"), 5, F.size("z"))
    total = lambda c: F.aggregate(F.transform(c, lambda x, k: x * (k + 1)), F.lit(0).cast("long"), lambda a, x: a + x)
    return e.select("vec_id", F.size("w5").alias("n5"), F.get("w16", F.lit(0)).alias("first"), F.get("w13", F.lit(8)).alias("last"), total(back).alias("total"), total(low).alias("low"))


def hybrid_records(spark, d):
    n = F.col("p_partkey")
    h = sphere.hybrid_record(n % 1300 * 1.0, n % 130 / 100.0 + 0.9, n * 7 % 800 + 350.5)
    p = read(spark, d, "part").select("p_partkey", h.alias("h"))
    top, power, reference = sphere.hybrid_of_record(F.col("h"))
    return p.select("p_partkey", F.col("h.ip1").alias("ip1"), F.col("h.ig2").cast("long").alias("ig2"), top.alias("top"), r4(power).alias("power"), reference.alias("reference"))


def legendre_polynomials(spark, d):
    """Normalised polynomials of waves up to 3 at nine sines."""
    table = spectral.legendre_table(spark, [float(np.degrees(np.arcsin(i / 10 - 0.4))) for i in range(9)], 3).where("m = 0")
    return table.select(F.col("lat").cast("long").alias("spot"), F.col("n").cast("long").alias("n"), F.round("p", 6).alias("p"))


def _tokens(spark, d):
    """Embeddings as smooth whole numbers: running sums of small steps, of up to 11 bits."""
    step = lambda x: F.floor(F.abs(x.cast("double")) * 20).cast("long")
    return read(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x, k: step(x) + k * (F.col("vec_id") % 5)).alias("z"))


def _packed_query(way):
    def query(spark, d):
        c = _tokens(spark, d).withColumn("b", tokens.compressed(F.col("z"), 8, 11, way)).withColumn("back", tokens.uncompressed(F.col("b"), 8, 8))
        return c.select("vec_id", F.octet_length("b").cast("long").alias("n_bytes"), F.hex(F.substring("b", 1, 4)).alias("head"), F.aggregate(F.transform("back", lambda x, k: x * (k + 1)), F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))

    return query


def pole_fit(spark, d):
    e = read(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("k", "x"))
    lat = F.floor(F.col("k") / 8) * 22.5 - 78.75
    fits = [("quadratic", True, 0), ("plane", False, 0), ("north", True, 1)]
    parts = [grids.pole_fit(e, lat, F.col("x").cast("double"), ["vec_id"], bent, half).select("vec_id", F.lit(name).alias("fit"), r4("north").alias("north"), r4("south").alias("south")) for name, bent, half in fits]
    return reduce(DataFrame.union, parts)


def lambert_grid(spark, d):
    spec = ((20.0, 235.0), 55.0, 270.0, 30.0, 45.0, 32.5, 25.0)
    x, y = sphere.lambert_grid_xy(F.col("lat"), F.col("lon"), *spec)
    p = _places(spark, d).withColumns({"x": x, "y": y})
    lat, lon = sphere.lambert_grid_latlon(F.col("x"), F.col("y"), *spec)
    return p.select("s_suppkey", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), F.round(lat, 4).alias("lat"), F.round(lon, 4).alias("lon"))


def bits_recut(spark, d):
    k = F.col("o_orderkey")
    three = [k * 7919 % (1 << 28), k * 104729 % (1 << 28), F.col("o_custkey") * 1299709 % (1 << 28)]
    four = codecs.recut(three, [28] * 3, [21] * 4)
    o = read(spark, d, "orders").select("o_orderkey", *[c.alias(f"p{i}") for i, c in enumerate(three, 1)], *[c.alias(f"g{i}") for i, c in enumerate(four, 1)])
    words = codecs.recut([F.col(f"g{i}") for i in range(1, 5)], [21] * 4, [32, 32, 20])
    back = codecs.recut(words, [32, 32, 20], [28] * 3)
    same = reduce(Column.__and__, [b == F.col(f"p{i}") for i, b in enumerate(back, 1)])
    return o.select("o_orderkey", *[f"g{i}" for i in range(1, 5)], *[w.alias(f"w{i}") for i, w in enumerate(words, 1)], same.alias("same"))


def axis_records(spark, d):
    c, p = F.col("c_custkey"), F.col("p_partkey")
    of = lambda letters, n: F.element_at(F.array(*map(F.lit, letters)), (n % len(letters) + 1).cast("int"))
    wanted = read(spark, d, "customer").select(of("ZY#U", c).alias("grtyp"), (c % 5 - 1).alias("ni"), (c % 3 + 1).alias("nj"), F.col("c_nationkey").alias("ig1"), (c % 4).alias("ig2"), (c % 2).alias("ig3"))
    held = read(spark, d, "part").select(
        p.alias("handle"), of([">>  ", "^^", "^>"], p).alias("nomvar"), of("LNEFOQ", F.floor(p / 3)).alias("grtyp"), (p % 4).alias("ni"), (F.floor(p / 4) % 4).alias("nj"),
        (p % 25).alias("ip1"), (F.floor(p / 25) % 4).alias("ip2"), (F.floor(p / 100) % 2).alias("ip3"),
    )
    return records.axes(wanted, held)


def grid_desc_text(spark, d):
    n = F.col("p_partkey")
    given = {
        "N": [n % 99 + 0.5, n % 77 + 0.5, 50000.0 + n % 100 * 100.0, n % 720 / 2.0], "E": [n % 3600 / 20.0 - 90, n * 7 % 7200 / 20.0, n * 11 % 1800 / 20.0 - 45, n * 13 % 7200 / 20.0],
        "A": [n % 3 * 1.0, n % 2 * 1.0, n * 0.0, n * 0.0], "Z": None,
    }
    codes = {k: descriptors.pack(k, *x) if x else (n * 997, n, n * 99991, F.lit(7)) for k, x in given.items()}
    p = read(spark, d, "part").select("p_partkey", *[c.alias(f"{k}{i}") for k, g in codes.items() for i, c in enumerate(g, 1)])
    return p.select("p_partkey", *[c.alias(f"{k.lower()}{i}") for k in codes for i, c in enumerate(descriptors.printable(k, *[F.col(f"{k}{j}") for j in (1, 2, 3, 4)]), 1)])


def pole_wind(spark, d):
    e = read(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("k", "x"))
    rows = e.select("vec_id", (F.col("k") % 16).alias("i"), (F.floor(F.col("k") / 16) % 2 + 1).alias("ring"), F.floor(F.col("k") / 32).alias("part"), F.col("x").cast("double").alias("x"))
    wind = rows.groupBy("vec_id", "i", "ring").agg(F.max(F.when(F.col("part") == 0, F.col("x"))).alias("u"), F.max(F.when(F.col("part") == 1, F.col("x"))).alias("v"))
    t = scores.pole_wind(wind, F.col("i") * 22.5, "u", "v", "ring", ["vec_id"])
    return t.select("vec_id", r4("speed").alias("speed"), F.round("angle", 3).alias("angle"))


def command_lines(spark, d):
    known = [("-", "none", ""), ("in", "a0", "a1"), ("in", "b0", "b1"), ("out_", "Out0", "Out1"), ("title.", "Ti", "Tj"), ("v", "no", "yes")]
    n = F.col("p_partkey").cast("string")
    lines = [F.concat(F.lit("p"), n, F.lit(" -In X"), n, F.lit(":y -v")), F.lit("-in=a:b:c"), F.concat(F.lit("-OUT=AbC"), n, F.lit(" -- last"), n), F.concat(F.lit("-in one two  -title==-Mixed"), n)]
    p = read(spark, d, "part").select("p_partkey", directives.answers(F.element_at(F.array(*lines), (F.col("p_partkey") % 4 + 1).cast("int")), known).alias("a"))
    return p.select("p_partkey", *[F.get("a", F.lit(i)).alias(k) for i, k in enumerate(("free", "in1", "in2", "out", "title", "v"))])


QUERIES = {f.__name__: f for f in (pack_words, hybrid_records, legendre_polynomials, pole_fit, lambert_grid, bits_recut, axis_records, grid_desc_text, pole_wind, command_lines)} | {"tokens_minimum": _packed_query(tokens.MINIMUM), "tokens_parallelogram": _packed_query(tokens.PARALLELOGRAM)} | {f.__name__: f for f in (local_stereographic, lambert_back, hash_hmac, missing_flags, grid_options, field_by_options, grid_halves, stencil_points, record_file_headers)}
_P = "(SELECT s_suppkey, s_suppkey * 7 % 50 + 20.0::DOUBLE AS lat, s_suppkey * 31 % 90 + 225.5::DOUBLE AS lon FROM supplier)"


def _pad(key: bytes, with_: int) -> str:
    return "unhex('" + "".join(f"{k ^ with_:02X}" for k in key.ljust(64, b"\0")) + "')"


def _hmac(key: bytes) -> str:
    return f"md5({_pad(key, 0x5C)} || unhex(md5({_pad(key, 0x36)} || encode(p_name))))"


_N = "(ln(cos(radians(30)) / cos(radians(55))) / ln(tan(pi() / 4 + radians(55) / 2) / tan(pi() / 4 + radians(30) / 2)))"
#: A key beyond 64 bytes counts by its digest.
_LONG = hashlib.md5(b"k" * 80).digest()
ORACLE_SQL = {
    # The tangent of half the way to the point, by the chord, times two radii, along its bearing from the centre.
    "local_stereographic": f"""SELECT s_suppkey, round(100.5 + r * sin(b) / 10000, 4) AS x, round(50.5 + r * cos(b) / 10000, 4) AS y, round(lat, 4) AS lat, round(lon, 4) AS lon FROM (SELECT *, 2 * 6371000.0 * tan(asin(sqrt(sin(radians(lat - 45) / 2) ** 2 + cos(radians(45)) * cos(radians(lat)) * sin(radians(lon - 270) / 2) ** 2))) AS r,
        atan2(sin(radians(lon - 270)) * cos(radians(lat)), cos(radians(45)) * sin(radians(lat)) - sin(radians(45)) * cos(radians(lat)) * cos(radians(lon - 270))) AS b FROM {_P})""",
    "lambert_back": f"""SELECT s_suppkey, round(r * sin(t), 1) AS x, round(r0 - r * cos(t), 1) AS y, round(lat, 4) AS lat, round(lon, 4) AS lon FROM (SELECT *, {_N} * radians(lon - 270) AS t, 6370997.0 * f / pow(tan(pi() / 4 + radians(lat) / 2), {_N}) AS r, 6370997.0 * f / pow(tan(pi() / 4 + radians(45) / 2), {_N}) AS r0
        FROM (SELECT *, cos(radians(30)) * pow(tan(pi() / 4 + radians(30) / 2), {_N}) / {_N} AS f FROM {_P}))""",
    "hash_hmac": f'SELECT p_partkey, {_hmac(b"key")} AS short, {_hmac(_LONG)} AS "long" FROM part',
    "missing_flags": """SELECT p_partkey, coalesce(v, -2147483648) AS i4, coalesce(v, -32768) AS i2, coalesce(v, -128) AS i1, coalesce(v, 4294967295) AS u4, coalesce(v, 65535) AS u2, coalesce(v, 255) AS u1, coalesce(v, -9)::DOUBLE AS own, v AS i2_back, v AS u1_back, v::DOUBLE AS own_back FROM (SELECT p_partkey, CASE WHEN p_size % 4 <> 0 THEN p_size::BIGINT END AS v FROM part)""",
    "grid_options": """SELECT * FROM (VALUES ('cloud_interp_alg', 'distance'), ('extrap_degree', 'value'), ('extrap_value', '7.0'), ('interp_degree', 'linear'), ('missing_distance_threshold', '3.0'), ('missing_gridpt_distance', '0.5'), ('missing_points_tolerance', '0'), ('polar_correction', 'yes'),
        ('subgridid', '-1'), ('use_1subgrid', 'no'), ('verbose', 'no'), ('weight_number', '6')) t(name, value)""",
    "field_by_options": """WITH t AS (SELECT i, j, ([200.0, 204.0, 209.0, 215.0, 222.0, 230.0, 239.0, 249.0][i] - 250) / 3 + 1 AS x, ([-20.0, -12.0, -5.0, 1.0, 6.0, 10.0, 19.0, 30.0][j] - 30) / 2 + 1 AS y FROM range(1, 9) a(i), range(1, 9) b(j))
        SELECT vec_id, i, j, round(CASE WHEN trunc(x + 0.5) BETWEEN 1 AND 8 AND trunc(y + 0.5) BETWEEN 1 AND 8 THEN embedding[((round(y) - 1) * 8 + greatest(1, round(x)))::BIGINT]::DOUBLE ELSE -5 END, 4) AS value FROM embeddings, t""",
    "grid_halves": "SELECT * FROM (VALUES (1::BIGINT, 'Z', 8::BIGINT, 4::BIGINT, 40.0::DOUBLE, 250.0::DOUBLE), (2, 'Z', 8, 4, 90.0, 90.0)) t(half, kind, ni, nj, lat, lon)",
    "stencil_points": """WITH p AS (SELECT part, i, j, i + di AS x, j + dj AS y FROM range(0, 3) a(part), range(1, 9) b(i), range(0, 9) c(j), range(-1, 3) e(di), range(-1, 3) g(dj)), s AS (SELECT *, (y < 1 AND part <> 1) OR (y > 8 AND part <> 2) AS over, CASE WHEN y < 1 THEN 1 - y WHEN y > 8 THEN 17 - y ELSE y END AS r,
          CASE WHEN (y < 1 AND part = 1) OR (y > 8 AND part = 2) THEN -1 ELSE 1 END AS sg FROM p), q AS (SELECT *, (x + 15 + CASE WHEN over THEN 4 ELSE 0 END) % 8 + 1 AS c FROM s)
        SELECT part::INTEGER AS part, i::INTEGER AS i, j::INTEGER AS j, count(*) AS n, sum(c * r)::BIGINT AS product, sum(c)::BIGINT AS columns, sum(r * sg)::BIGINT AS rows FROM q GROUP BY 1, 2, 3""",
    "record_file_headers": """WITH n AS (SELECT count(*) AS n, sum(10 + (64 * CASE vec_id % 3 WHEN 0 THEN 32 WHEN 1 THEN 64 ELSE 13 END + 183) // 64) AS size FROM embeddings)
        SELECT 'XDF0' AS version, 'TEST' AS signature, (26 + ceil(n / 256.0) * 2308 + size)::BIGINT AS size, 0::BIGINT AS rewrites, n AS extensions, ceil(n / 256.0)::BIGINT AS pages, 76::BIGINT AS largest, 16::BIGINT AS primary, 9::BIGINT AS primary_length, 2::BIGINT AS auxiliary, 1::BIGINT AS auxiliary_length, 15::BIGINT AS erasures, n - 15 AS records, true AS sound FROM n""",
}
_Z = """z AS (SELECT vec_id, k // 8 AS j, k % 8 AS i, k, floor(abs(embedding[k + 1]::DOUBLE) * 20)::BIGINT + k * (vec_id % 5) AS v FROM embeddings, range(0, 64) r(k))"""
_BYTES = "CASE WHEN 4 + (bits + 32) // 32 * 4 < 128 THEN 4 + (bits + 32) // 32 * 4 END"
_LEN = "CASE WHEN {v} = 0 THEN 0 ELSE floor(log2({v}))::BIGINT + 1 END"
_TOTAL = "SELECT vec_id, sum(v * (k + 1))::BIGINT AS total FROM z GROUP BY 1"
ORACLE_SQL["tokens_minimum"] = f"""WITH {_Z}, t AS (SELECT vec_id, i // 5 AS a, j // 5 AS b, count(*) AS n, max(v) - min(v) AS w FROM z GROUP BY 1, 2, 3), s AS (SELECT vec_id, sum(15 + n * {_LEN.format(v='w')})::BIGINT AS bits FROM t GROUP BY 1), u AS ({_TOTAL})
    SELECT vec_id, {_BYTES}::BIGINT AS n_bytes, CASE WHEN {_BYTES} IS NOT NULL THEN printf('%08X', (3 << 28) + (5 << 22) + (11 << 17) + (1 << 14)) END AS head, CASE WHEN {_BYTES} IS NOT NULL THEN total END AS total FROM s JOIN u USING (vec_id)"""
ORACLE_SQL["tokens_parallelogram"] = f"""WITH {_Z}, d AS (SELECT a.vec_id, a.i, a.j, abs(a.v - b.v - c.v + e.v) AS d FROM z a JOIN z b ON b.vec_id = a.vec_id AND b.k = a.k - 1 JOIN z c ON c.vec_id = a.vec_id AND c.k = a.k - 8 JOIN z e ON e.vec_id = a.vec_id AND e.k = a.k - 9 WHERE a.i > 0 AND a.j > 0),
    t AS (SELECT vec_id, (i - 1) // 3 AS a, (j - 1) // 3 AS b, count(*) AS n, max(d) AS w FROM d GROUP BY 1, 2, 3), s AS (SELECT vec_id, (3 + 15 * 11 + sum(4 + CASE WHEN w = 0 THEN 0 ELSE n * (1 + {_LEN.format(v='w')}) END))::BIGINT AS bits FROM t GROUP BY 1), u AS ({_TOTAL})
    SELECT vec_id, {_BYTES}::BIGINT AS n_bytes, CASE WHEN {_BYTES} IS NOT NULL THEN printf('%08X', (4 << 28) + (1 << 25) + (3 << 22) + (11 << 17) + (1 << 14)) END AS head, CASE WHEN {_BYTES} IS NOT NULL THEN total END AS total FROM s JOIN u USING (vec_id)"""
_Q = """q AS (SELECT vec_id, list_transform(embedding[1:21], lambda x: floor(x::DOUBLE * 100)::BIGINT) AS z FROM embeddings), p AS (SELECT vec_id, z, k, z[k] AS v FROM q, range(1, 22) r(k))"""
ORACLE_SQL["pack_words"] = f"""WITH {_Q} SELECT vec_id, 4 AS n5, any_value((z[1] & 65535) * 65536 + (z[2] & 65535))::BIGINT AS first, any_value(((z[20] & 8191) & 15) * 268435456 + (z[21] & 8191) * 32768)::BIGINT AS last, sum(v * k)::BIGINT AS total, sum((v & 31) * k)::BIGINT AS low FROM p GROUP BY 1"""
ORACLE_SQL["hybrid_records"] = """SELECT p_partkey, CASE WHEN good THEN CASE WHEN t = 0 THEN 0 WHEN t <= 1100 THEN (2 << 24) + (8 - floor(log10(t))::BIGINT + 1) * 1048576 + round(t * pow(10.0, 5 - floor(log10(t))))::BIGINT ELSE -999999 END END::BIGINT AS ip1, CASE WHEN good THEN g2 END AS ig2,
    CASE WHEN good AND t <= 1100 THEN t::DOUBLE END AS top, CASE WHEN good AND t <= 1100 THEN round(g2 / 1000.0, 4) END AS power, CASE WHEN good AND t <= 1100 THEN (p_partkey * 7 % 800 + 350)::DOUBLE END AS reference FROM (
    SELECT *, p_partkey % 1300 AS t, p_partkey * 7 % 800 BETWEEN 50 AND 699 AND p_partkey % 130 / 100.0::DOUBLE + 0.9::DOUBLE BETWEEN 1 AND 2 AND p_partkey % 1300 <= 1200 AS good, trunc((p_partkey % 130 / 100.0::DOUBLE + 0.9::DOUBLE) * 1000)::BIGINT AS g2 FROM part)"""
ORACLE_SQL["legendre_polynomials"] = "WITH x AS (SELECT a + 1 AS spot, (a / 10.0 - 0.4)::DOUBLE AS x FROM range(0, 9) r(a)) SELECT spot, n, round(CASE n WHEN 0 THEN sqrt(0.5) WHEN 1 THEN sqrt(1.5) * x WHEN 2 THEN sqrt(2.5) * (3 * x * x - 1) / 2 ELSE sqrt(3.5) * (5 * x * x * x - 3 * x) / 2 END, 6) + 0 AS p FROM x, range(0, 4) s(n)"
_RING = " ".join(f"list_sum(embedding[{8 * r + 1}:{8 * r + 8}]::DOUBLE[]) / 8 AS m{r}," for r in (0, 1, 6, 7))
# A circle's squared distance from the pole is that of the tangent of half its angle.
_BENT = "({0} * {b} - {1} * {a}) / ({b} - {a})".replace("{a}", "tan(radians(5.625)) ** 2").replace("{b}", "tan(radians(16.875)) ** 2")
ORACLE_SQL["pole_fit"] = f"""WITH m AS (SELECT {_RING} vec_id FROM embeddings), f AS (SELECT vec_id, {_BENT.format("m7", "m6")} AS n, {_BENT.format("m0", "m1")} AS s, (m6 + m7) / 2 AS pn, (m0 + m1) / 2 AS ps FROM m)
    SELECT vec_id, 'quadratic' AS fit, round(n, 4) AS north, round(s, 4) AS south FROM f UNION ALL SELECT vec_id, 'plane', round(pn, 4), round(ps, 4) FROM f UNION ALL SELECT vec_id, 'north', round(n, 4), round(n, 4) FROM f"""
_TAN = lambda v: f"tan(radians(45 + ({v}) / 2.0))"
_CONE = f"(ln(cos(radians(30)) / cos(radians(45))) / ln({_TAN('45')} / {_TAN('30')}))"
_RHO = lambda v: f"(6370997.0 * cos(radians(30)) * pow({_TAN('30')} / {_TAN(v)}, {_CONE}) / {_CONE})"
ORACLE_SQL["lambert_grid"] = f"""SELECT s_suppkey, round(1 + ({_RHO('lat')} * sin({_CONE} * radians(lon - 270)) - {_RHO('20')} * sin({_CONE} * radians(-35))) / 32500, 3) AS x,
    round(1 + ({_RHO('20')} * cos({_CONE} * radians(-35)) - {_RHO('lat')} * cos({_CONE} * radians(lon - 270))) / 25000, 3) AS y, round(lat, 4) AS lat, round(lon, 4) AS lon FROM {_P}"""
ORACLE_SQL["bits_recut"] = """WITH b AS (SELECT o_orderkey, (o_orderkey * 7919 % 268435456)::HUGEINT * 72057594037927936::HUGEINT + (o_orderkey * 104729 % 268435456)::HUGEINT * 268435456 + o_custkey * 1299709 % 268435456 AS b FROM orders)
    SELECT o_orderkey, (b // 9223372036854775808::HUGEINT)::BIGINT AS g1, (b // 4398046511104 % 2097152)::BIGINT AS g2, (b // 2097152 % 2097152)::BIGINT AS g3, (b % 2097152)::BIGINT AS g4,
    (b // 4503599627370496)::BIGINT AS w1, (b // 1048576 % 4294967296)::BIGINT AS w2, (b % 1048576)::BIGINT AS w3, true AS same FROM b"""
_AXIS = lambda name, size: f"""CASE WHEN grtyp = 'U' THEN nomvar = '^>' AND anj = 1 AND ani > 0 ELSE nomvar = '{name}' AND (grtyp = '#' OR {size} IN (0, -1) OR a{size} = {size}) END"""
ORACLE_SQL["axis_records"] = f"""WITH g AS (SELECT DISTINCT ['Z', 'Y', '#', 'U'][c_custkey % 4 + 1] AS grtyp, c_custkey % 5 - 1 AS ni, c_custkey % 3 + 1 AS nj, c_nationkey AS ig1, c_custkey % 4 AS ig2, c_custkey % 2 AS ig3 FROM customer),
    a AS (SELECT p_partkey AS handle, ['>>', '^^', '^>'][p_partkey % 3 + 1] AS nomvar, ['L', 'N', 'E', 'F', 'O', 'Q'][p_partkey // 3 % 6 + 1] AS agrtyp, p_partkey % 4 AS ani, p_partkey // 4 % 4 AS anj, p_partkey % 25 AS ip1, p_partkey // 25 % 4 AS ip2, p_partkey // 100 % 2 AS ip3 FROM part),
    m AS (SELECT g.*, min(handle) FILTER ({_AXIS('>>', 'ni')}) AS xh, min(handle) FILTER ({_AXIS('^^', 'nj')}) AS yh FROM g LEFT JOIN a ON ip1 = ig1 AND ip2 = ig2 AND (ip3 = ig3 OR grtyp = '#') GROUP BY ALL),
    k AS (SELECT m.*, x.ani AS xi, x.anj AS xj, y.ani AS yi, y.anj AS yj, x.agrtyp AS ref, CASE WHEN grtyp = 'U' THEN x.agrtyp = 'F' ELSE x.agrtyp IN ('N', 'S', 'L', 'E', 'O') END AND yh IS NOT NULL AS good FROM m LEFT JOIN a x ON x.handle = xh LEFT JOIN a y ON y.handle = yh)
    SELECT grtyp, ni, nj, ig1, ig2, ig3, CASE WHEN good THEN xh END AS x_handle, CASE WHEN good THEN yh END AS y_handle, CASE WHEN good THEN xi END AS x_size, CASE WHEN good THEN yj END AS y_size,
    CASE WHEN good THEN CASE WHEN grtyp <> 'U' AND xi = yi AND xj = yj THEN 'Y' WHEN grtyp IN ('#', 'U') THEN grtyp ELSE 'Z' END END AS kind, CASE WHEN good THEN ref END AS reference FROM k"""
_WIDE = lambda form, v, w: f"CASE WHEN length(printf('{form}', {v})) > {w} THEN repeat('*', {w}) ELSE printf('{form}', {v}) END"
ORACLE_SQL["grid_desc_text"] = f"""SELECT p_partkey, printf('%6.1f', (p_partkey % 99 + 0.5)::DOUBLE) AS n1, printf('%6.1f', (p_partkey % 77 + 0.5)::DOUBLE) AS n2, printf('%5.1fKm', (50 + p_partkey % 100 / 10.0)::DOUBLE) AS n3, printf('%7.3f', (p_partkey % 720 / 2.0)::DOUBLE) AS n4,
    printf('%6.2f', (p_partkey % 3600 / 20.0 - 90)::DOUBLE) AS e1, printf('%6.2f', (p_partkey * 7 % 7200 / 20.0)::DOUBLE) AS e2, printf('%7.3f', (p_partkey * 11 % 1800 / 20.0 - 45)::DOUBLE) AS e3, printf('%7.3f', (p_partkey * 13 % 7200 / 20.0)::DOUBLE) AS e4,
    printf('%6d', p_partkey % 3) AS a1, printf('%6d', p_partkey % 2) AS a2, '      0' AS a3, '      0' AS a4, {_WIDE('%6d', 'p_partkey * 997', 6)} AS z1, {_WIDE('%6d', 'p_partkey', 6)} AS z2, {_WIDE('%7d', 'p_partkey * 99991', 7)} AS z3, '      7' AS z4 FROM part"""
# Turned by a right angle beyond the longitude, as a complex number.
_POLAR_SUM = lambda r, f: f"list_sum(list_transform(range(0, 16), lambda i: embedding[{16 * r} + i + 1]::DOUBLE * {f[0]}(radians(90 + i * 22.5)) * {f[1]} - embedding[{32 + 16 * r} + i + 1]::DOUBLE * {f[2]}(radians(90 + i * 22.5)))) / 16"
_X, _Y = ("cos", 1, "sin"), ("sin", 1, "-cos")
ORACLE_SQL["pole_wind"] = f"""SELECT vec_id, round(sqrt(x * x + y * y), 4) AS speed, round(degrees(atan2(y, x)) + CASE WHEN y < 0 THEN 360 ELSE 0 END, 3) AS angle FROM (
    SELECT vec_id, ({_POLAR_SUM(0, _X)}) * 9 / 8 - ({_POLAR_SUM(1, _X)}) / 8 AS x, ({_POLAR_SUM(0, _Y)}) * 9 / 8 - ({_POLAR_SUM(1, _Y)}) / 8 AS y FROM embeddings)"""
ORACLE_SQL["command_lines"] = """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'P' || p_partkey WHEN 2 THEN 'LAST' || p_partkey WHEN 3 THEN 'NONE' END AS free, CASE p_partkey % 4 WHEN 0 THEN 'X' || p_partkey WHEN 2 THEN 'A0' WHEN 3 THEN 'ONE' END AS in1,
    CASE p_partkey % 4 WHEN 0 THEN 'Y' WHEN 2 THEN 'B0' WHEN 3 THEN 'TWO' END AS in2, CASE p_partkey % 4 WHEN 2 THEN 'abc' || p_partkey WHEN 1 THEN NULL ELSE 'out0' END AS out, CASE p_partkey % 4 WHEN 3 THEN '-Mixed' || p_partkey WHEN 1 THEN NULL ELSE 'Ti' END AS title,
    CASE p_partkey % 4 WHEN 0 THEN 'YES' WHEN 1 THEN NULL ELSE 'NO' END AS v FROM part"""
