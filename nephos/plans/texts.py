"""Queries of directives, names as text, words of files, and the cubic and surface kernels that stand by themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from nephos.functions import names
from nephos.operators import directives, grids, store
from nephos.plans.base import r4, read
from nephos.plans.files import _records, shared_folder
from nephos.plans.grids import _targets
from nephos.plans.more import AX, AY
from nephos.sources import recordfile, words


def directive_values(spark, d):
    """Each part's directives by themselves: a loop, a choice and lists; some cannot be read."""
    n, s = F.col("p_partkey"), F.col("p_size").cast("string")
    text = F.concat(
        F.lit("n = "), s, F.lit("\ntotal = 0 ! the sum\nwhile (n > 0 and not total > 900)\n total = total + n\n n := n - 1\nendwhile\nif (total >= 300)\n list = total, total * 2\n out = list[2] - 1\nelse\n out = -total / 2\nendif\n"),
        F.when(n % 10 == 0, "out = missing + 1").otherwise("out = out + 0.5"),
    )
    return read(spark, d, "part").select("p_partkey", directives.evaluated(text, "out").cast("double").alias("value"))


def directive_lines(spark, d):
    n = F.col("n_nationkey")
    line = F.when(n % 3 == 0, F.concat(F.lit("  "), F.col("n_name"), F.lit(" = "), n.cast("string"), F.lit(", 'two' ! rest"))).when(n % 3 == 1, F.concat(F.lower("n_name"), F.lit("(1, x)"))).otherwise(F.lit("# "))
    found = store.directives(read(spark, d, "nation").select(line.alias("line")))
    return found.select("name", F.concat_ws("|", "args").alias("args"))


def text_forms(spark, d):
    p = F.concat(F.lit("/data/"), F.col("p_brand"), F.lit("/"), F.col("p_name"), F.lit("  "))
    word = names.word_of(F.substring("p_brand", 1, 4))
    return read(spark, d, "part").select(
        "p_partkey", F.upper("p_name").alias("upper"), F.lower("p_brand").alias("lower"), names.trimmed_length(p).alias("length"), names.padded(F.col("p_name"), 6).alias("padded"), names.same_name(F.lower("p_brand"), F.lit("BRAND#1"), False).alias("starts"),
        names.all_letters(F.substring("p_brand", 1, 5)).alias("letters"), names.last_part(F.rtrim(p)).alias("last"), word.alias("word"), names.text_of_word(word).alias("text"),
    )


def file_kinds(spark, d):
    """First bytes of many kinds of file, and of none."""
    heads = ["47524942", "42554652", "434446", "89504E47", "1F8B08", "50415231", "", "0A41424320", "00000004AABBCCDD00000004", "FFFFFFFF01", "000000000000000058444630535444520000"]
    content = F.unhex(F.element_at(F.array(*[F.lit(h) for h in heads]), (F.col("p_partkey") % len(heads) + 1).cast("int")))
    return read(spark, d, "part").select("p_partkey", words.file_type(content).alias("kind"))


def file_words(spark, d):
    """A record file as words: its marks, its size in words and kilobytes, and what it is."""
    recordfile.register(spark)
    top = shared_folder(spark, "words")
    _records(spark, d).coalesce(1).write.format("records").mode("append").save(top)
    found = words.files(spark, f"file://{top}")
    head = words.words(found, 3, 3).join(words.sizes(found), "path").join(words.sniffed(found).select("path", "file_type"), "path")
    return head.select(names.text_of_word(F.get("words", F.lit(0))).alias("version"), names.text_of_word(F.get("words", F.lit(1))).alias("signature"), (F.get("words", F.lit(2)) * 2).alias("said"), F.col("n_words").cast("long").alias("n_words"), F.col("n_blocks").cast("long").alias("n_blocks"), "file_type")


def ibm_words(spark, d):
    n = F.col("p_partkey")
    word = n % 2 * (1 << 31) + (n % 9 + 62) * (1 << 24) + n * 7919 % (1 << 24)
    return read(spark, d, "part").select("p_partkey", F.round(words.ibm_to_float(word), 6).alias("value"))


def regrid_wrapped_cubic(spark, d):
    return _targets(spark, d).select("vec_id", "k", r4(grids.wrapped_bicubic(F.col("z"), F.col("x"), F.col("y"), 8, 8)).alias("value"))


def regrid_irregular_cubic(spark, d):
    return _targets(spark, d).select("vec_id", "k", r4(grids.irregular_bicubic(F.col("z"), F.col("x"), F.col("y"), AX, AY)).alias("value"))


def surface_extrapolated(spark, d):
    """Below the lowest level by the surface and a flux, and the wind there turned by height."""
    e = read(spark, d, "events").select("event_id", F.array(F.lit(250.0), F.lit(300.0)).alias("lev"), (F.col("value") / 10).alias("value"), F.col("value").alias("_t"), (F.col("event_id") % 7).alias("m"))
    t = grids.from_surface(e, F.col("m") * 1.5, F.lit(10.0), F.lit(0.25))
    u, v = grids.surface_wind(F.col("_t"), F.lit(300.0), F.col("m") / 10.0, F.lit(0.6), F.lit(250.0), F.lit(45.0), F.col("_t") / 1000)
    return t.select("event_id", r4("value").alias("value"), F.round(u, 5).alias("u"), F.round(v, 5).alias("v"))


QUERIES = {f.__name__: f for f in (directive_values, directive_lines, text_forms, file_kinds, file_words, ibm_words, regrid_wrapped_cubic, regrid_irregular_cubic, surface_extrapolated)}
_T = "t AS (SELECT vec_id, embedding AS z, k, ((vec_id * 7 + k * 13) % 32 / 4.0 + 0.75)::DOUBLE AS x, ((vec_id * 5 + k * 11) % 32 / 4.0 + 0.75)::DOUBLE AS y FROM embeddings, range(0, 5) r(k))"


def _even(d: str) -> list[str]:
    return [f"(-{d}*({d}-1)*({d}-2)/6)", f"(({d}+1)*({d}-1)*({d}-2)/2)", f"(-({d}+1)*{d}*({d}-2)/2)", f"(({d}+1)*{d}*({d}-1)/6)"]


def _cell(axis: list[float], v: str) -> str:
    """First of the four points around a place: the cell before the one it is in, kept on the axis."""
    return f"greatest(1, least({len(axis) - 3}, (CASE {' '.join(f'WHEN {v} <= {a} THEN {k}' for k, a in enumerate(axis[1:-1], 1))} ELSE {len(axis) - 1} END) - 1 + {_on(axis, v)}))"


def _on(axis: list[float], v: str) -> str:
    """1 where a place is exactly on an inner point, whose next cell counts."""
    return f"CASE WHEN {v} IN ({', '.join(map(str, axis[1:]))}) THEN 1 ELSE 0 END"


def _uneven(axis: list[float], first: str, v: str) -> list[str]:
    p = [f"{axis}[{first} + {k}]" for k in range(4)]
    return ["(" + " * ".join(f"(({v} - {p[n]}) / ({p[k]} - {p[n]}))" for n in range(4) if n != k) + ")" for k in range(4)]


_WRAP = " + ".join(f"{_even('dy')[b]} * {_even('dx')[a]} * z[(j + {b - 1} - 1) * 8 + (i + {a - 2} + 8) % 8 + 1]::DOUBLE" for b in range(4) for a in range(4))
_WILD = " + ".join(f"{_uneven(AY, 'j', 'y')[b]} * {_uneven(AX, 'i', 'x')[a]} * z[(j + {b} - 1) * 8 + i + {a}]::DOUBLE" for b in range(4) for a in range(4))
ORACLE_SQL = {
    # The loop stops at 0 or with the first sum above 900, which fifty parts reach from the top.
    "directive_values": """WITH s AS (SELECT p_partkey, p_size, list_reduce(list_prepend(0::BIGINT, list_transform(range(0, p_size), lambda k: p_size - k)), lambda a, x: CASE WHEN a > 900 THEN a ELSE a + x END) AS total FROM part)
        SELECT p_partkey, CASE WHEN p_partkey % 10 <> 0 THEN CASE WHEN total >= 300 THEN total * 2 - 1 ELSE floor(-total / 2.0) END + 0.5 END::DOUBLE AS value FROM s""",
    "directive_lines": "SELECT upper(n_name) AS name, CASE n_nationkey % 3 WHEN 0 THEN n_nationkey || '|two' ELSE '1|x' END AS args FROM nation WHERE n_nationkey % 3 < 2",
    "text_forms": """SELECT p_partkey, upper(p_name) AS upper, lower(p_brand) AS lower, (length(p_brand) + length(p_name) + 7)::INTEGER AS length, rpad(substr(p_name, 1, 6), 6, ' ') AS padded, p_brand LIKE 'Brand#1%' AS starts, true AS letters, p_name AS last,
        ascii('B') * 16777216::BIGINT + ascii('r') * 65536 + ascii('a') * 256 + ascii('n') AS word, 'Bran' AS text FROM part""",
    "file_kinds": "SELECT p_partkey, ['grib', 'bufr', 'netcdf', 'png', 'gzip', 'parquet', 'empty', 'text', 'unformatted', 'unknown', 'records random'][p_partkey % 11 + 1] AS kind FROM part",
    "file_words": """WITH n AS (SELECT 26 + ceil(count(*) / 256.0)::BIGINT * 2308 + sum(10 + (64 * CASE vec_id % 3 WHEN 0 THEN 32 WHEN 1 THEN 64 ELSE 13 END + 183) // 64) AS size FROM embeddings)
        SELECT 'XDF0' AS version, 'STDR' AS signature, (size * 2)::BIGINT AS said, (size * 2)::BIGINT AS n_words, ceil(size * 8 / 1024.0)::BIGINT AS n_blocks, 'records random' AS file_type FROM n""",
    "ibm_words": "SELECT p_partkey, round(CASE WHEN p_partkey % 2 = 1 THEN -1 ELSE 1 END * (p_partkey * 7919 % 16777216) / 16777216.0 * pow(16.0, p_partkey % 9 - 2), 6) AS value FROM part",
    "regrid_wrapped_cubic": f"WITH {_T}, c AS (SELECT *, floor(x)::BIGINT AS i, greatest(2, least(6, floor(y)))::BIGINT AS j FROM t), q AS (SELECT *, x - i AS dx, y - j AS dy FROM c) SELECT vec_id, k, round({_WRAP}, 4) AS value FROM q",
    "regrid_irregular_cubic": f"WITH {_T}, c AS (SELECT *, {_cell(AX, 'x')}::BIGINT AS i, {_cell(AY, 'y')}::BIGINT AS j FROM t) SELECT vec_id, k, round({_WILD}, 4) AS value FROM c",
    "surface_extrapolated": """SELECT event_id, round(CASE WHEN value < 250 THEN 10 + 0.25 * m * 1.5 ELSE value / 10 END, 4) AS value, round(value / 1000 * cos(a), 5) AS u, round(value / 1000 * sin(a), 5) AS v FROM (
        SELECT event_id, value, event_id % 7 AS m, event_id % 7 / 10.0 + (250 - value) / 300 * 0.6 * sin(radians(45)) AS a FROM events)""",
}
