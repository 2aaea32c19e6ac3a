"""Cases with known results and edges of the operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nephos.functions import codecs, dates, levels
from nephos.operators import grids, records, store, vertical
from nephos.sources import words


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_level_anchors(spark):
    lit = lambda x: F.lit(float(x))
    assert one(spark, levels.encode(lit(10), 2), levels.encode(lit(1000), 2), levels.encode(lit(1200), 2)) == (42043040, 39945888, -999999)
    assert one(spark, *levels.decode(F.lit(42043040)), *levels.decode(F.lit(500))) == (10.0, 2, 500.0, 2)


@pytest.mark.parametrize("kind", sorted(levels.BOUNDS))
def test_levels_round_trip(spark, kind):
    low, high = levels.BOUNDS[kind]
    values = [float(v) for v in np.linspace(max(low, -20000), min(high, 1e5), 97)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    value, got = levels.decode(levels.encode(F.col("v"), kind))
    for r in df.select("v", value.alias("back"), got.alias("kind")).collect():
        # Shared numbers: what both kinds can be is read as the first of them.
        shared = levels.BOUNDS.get(kind - 16, (1.0, 0.0))
        if kind in (17, 21) and shared[0] <= r["v"] * levels.FACTOR[kind] <= shared[1]:
            continue
        near = abs(r["back"] - r["v"]) <= (1e-5 if r["v"] >= 0 and kind != 17 else 1.1e-4) * max(1.0, abs(r["v"])) or kind == 15 and abs(r["back"] - r["v"]) <= 0.5
        assert r["kind"] == kind and near


def test_stamps(spark):
    at = F.to_timestamp(F.lit("2022-06-10 12:30:05"))
    old = F.to_timestamp(F.lit("1975-02-28 18:00:00"))
    s, o, back, past = one(spark, dates.stamp(at), dates.stamp(old), dates.unstamp(dates.stamp(at)) == at, dates.unstamp(dates.stamp(old)) == old)
    assert o == 22875180 and s > 123_200_000 and back and past


def test_vertical_golden_case(spark):
    """Two columns with known states, levels given in descending order."""
    level = [2.97, 2.44, 1.25, 0.64]
    states = {1: [0.1708, 0.6454, 0.9489846, 0.5971954], 2: [-0.1733, -0.8450, 3.009570, 0.744544]}
    rows = [(p, lev, s) for p, ss in states.items() for lev, s in zip(level, ss, strict=True)]
    source = spark.createDataFrame(rows, "point int, level double, state double")
    targets = spark.createDataFrame([(p, k, t) for p in states for k, t in enumerate((1.13, 2.62, 2.79, 0.5, 3.1), 1)], "point int, k int, t double")
    joined = vertical.joined(vertical.columns_of(source, "point", "level", "state"), targets, "point", "t")
    got = {(r["point"], r["k"]): r["value"] for r in vertical.lapse(vertical.linear(joined), 0.4, -0.5).collect()}
    expected = {(1, 4): 0.5411954, (1, 5): 0.1058001, (2, 4): 0.6885440, (2, 5): -0.2382999}
    assert all(abs(got[k] - v) < 1e-6 for k, v in expected.items())
    near = {(r["point"], r["k"]): r["value"] for r in vertical.nearest(joined).collect()}
    ascending = sorted(zip(level, states[1], strict=True))
    assert [near[1, k] for k in range(1, 6)] == [ascending[i - 1][1] for i in (2, 3, 4, 1, 4)]


def test_cubic_is_exact_for_cubics(spark):
    f = lambda x: 2 * x**3 - x**2 + 3 * x - 5
    source = spark.createDataFrame([(1, float(x), float(f(x)), float(6 * x**2 - 2 * x + 3)) for x in range(7)], "p int, l double, s double, d double")
    targets = spark.createDataFrame([(1, x / 7) for x in range(42)], "p int, t double")
    j = vertical.joined(vertical.columns_of(source, "p", "l", "s", "d"), targets, "p", "t")
    for r in vertical.cubic_with_slopes(vertical.cubic(j, into="c")).collect():
        assert abs(r["c"] - f(r["t"])) < 1e-9 and abs(r["value"] - f(r["t"])) < 1e-9


def test_regrid_is_exact_for_its_degree(spark):
    ni, nj = 7, 6
    plane = [2.0 * i - 3.0 * j + 1 for j in range(1, nj + 1) for i in range(1, ni + 1)]
    cube = [float(i**3 - i * j**2 + j) for j in range(1, nj + 1) for i in range(1, ni + 1)]
    pts = [(x / 3 + 0.2, y / 2 + 0.1) for x in range(1, 20) for y in range(1, 12)]
    df = spark.createDataFrame([(plane, cube, x, y) for x, y in pts], "p array<double>, c array<double>, x double, y double")
    x, y = F.col("x"), F.col("y")
    for r in df.select("x", "y", grids.bilinear(F.col("p"), x, y, ni, nj).alias("a"), grids.bicubic(F.col("c"), x, y, ni, nj).alias("b")).collect():
        assert abs(r["a"] - (2 * r["x"] - 3 * r["y"] + 1)) < 1e-9
        assert abs(r["b"] - (r["x"] ** 3 - r["x"] * r["y"] ** 2 + r["y"])) < 1e-8


def test_missing_plug(spark):
    assert one(spark, codecs.plug(F.lit(1.0), F.lit(1.0), 16), codecs.plug(F.lit(0.0), F.lit(0.0), 16), codecs.plug(F.lit(0.0), F.lit(10.0), 2)) == (2.0, 1.0, 15.5)


def test_rules_without_a_match(spark):
    df = spark.createDataFrame([(1,), (5,)], "a int")
    only_out = [records.Rule(False, (records.one_of("a", 1),))]
    only_in = [records.Rule(True, (records.one_of("a", 1),))]
    assert [tuple(r) for r in df.select(records.decide(only_out), records.decide(only_in), records.decide([])).collect()] == [(0, 1, 1), (1, 0, 1)]


def test_edit_refuses_sizes(spark):
    with pytest.raises(ValueError):
        records.edit(spark.createDataFrame([(1, 2)], "ni int, a int"), F.lit(True), ni=4)


def test_directives(spark):
    lines = spark.createDataFrame([("  nlat = 8 ! rows",), ("# none",), ("range(0., 'a b')",), ("",)], "line string")
    assert [(r["name"], r["args"]) for r in store.directives(lines).collect()] == [("NLAT", ["8"]), ("RANGE", ["0.", "a b"])]


def test_word_files(spark, tmp_path):
    np.arange(1, 9, dtype=">u4").tofile(tmp_path / "w.bin")
    (tmp_path / "t.txt").write_text("plain text\n")
    (tmp_path / "g.grb").write_bytes(b"GRIB" + bytes(20))
    found = words.files(spark, str(tmp_path))
    kinds = {r["path"].rsplit("/", 1)[1]: r["file_type"] for r in words.sniffed(found).collect()}
    assert kinds == {"w.bin": "unknown", "t.txt": "text", "g.grb": "grib"}
    got = words.words(found.where(F.col("path").endswith("w.bin")), 3, 100).first()["words"]
    assert got == [3, 4, 5, 6, 7, 8]
    assert one(spark, words.ibm_to_float(F.lit(0x42640000).cast("long"))) == (100.0,)


def test_directive_language():
    from nephos.operators.directives import DirectiveError, Directives, command_keys, environment_options

    seen = []
    run = Directives({"n": 2}, {"emit": lambda *a: seen.append(a)})
    run.run("""
      total = 0 ! sum
      WHILE (n < 5 AND NOT total > 100)
        total = total + n ** 2
        n := n + 1
      ENDWHILE
      IF (total = 29)
        emit(total, 'a, b', -1.5)
      ELSE
        emit(0)
      ENDIF
      list = 3, 4, 5
      PRINT list[2] * (1 + 1)
      UNDEF(n)
    """)
    assert seen == [(29, "a, b", -1.5)] and run.printed == [8] and "N" not in run.values
    for bad in ("x = ", "y = 1 +", "none(1)", "IF (1)", "z = missing"):
        with pytest.raises(DirectiveError):
            Directives().run(bad + ("" if "= " != bad[-2:] else "("))
    assert environment_options("A=1; b = x;") == {"A": "1", "B": "x"}
    assert command_keys(["-in", "f", "-v"], {"in": ("", "-"), "v": ("0", "1"), "out": ("o", "p")}) == {"in": "f", "v": "1", "out": "o"}


def test_legendre_functions_are_orthonormal():
    from nephos.operators.spectral import legendre

    x, w = np.polynomial.legendre.leggauss(20)
    tables = [legendre(v, 8) for v in x]
    for m in range(9):
        for n in range(m, 9):
            for k in range(m, 9):
                total = sum(a * t[m, n] * t[m, k] for a, t in zip(w, tables, strict=True))
                assert abs(total - (n == k)) < 1e-10


@pytest.mark.parametrize(("kind", "bits", "error"), [(5, 32, 1e-6), (5, 64, 0), (1, 16, 1e-4), (4, 12, 0.5), (69, 64, 0), (65, 12, 1e-3), (133, 32, 1e-6), (197, 64, 0)])
def test_payloads(kind, bits, error):
    from nephos.sources import recordstore as rs

    draw = np.random.default_rng(kind)
    values = [float(v) for v in draw.standard_normal(77)]
    if kind & rs.MISSING:
        values[0] = values[13] = values[76] = None
    back = rs.decode_values(rs.encode_values(values, kind, bits), 77, kind, bits)
    assert all((a is None) == (b is None) and (a is None or abs(a - b) <= error) for a, b in zip(values, back, strict=True))
    if not kind & rs.MISSING:
        with pytest.raises(ValueError):
            rs.encode_values([1.0, None], kind, bits)


def test_record_store(spark, tmp_path):
    from nephos.sources import recordstore as rs

    path = str(tmp_path / "store")
    first = spark.createDataFrame([(1, "UU", [1.5, 2.5]), (2, "VV", [3.0])], "handle long, nomvar string, field array<double>")
    rs.write(first, path)
    rs.write(spark.createDataFrame([(2, "VV", [4.25]), (3, "TT", [-1.0])], first.schema), path, kind=133, bits=64)
    found = rs.open_store(spark, path)
    assert {r["handle"]: r["field"] for r in rs.fields(found).collect()} == {1: [1.5, 2.5], 2: [4.25], 3: [-1.0]}
    assert records.search(found, nomvar="VV", handle=-1).select("handle").collect()[0][0] == 2


def test_cubic_regridding_on_uneven_and_closed_axes(spark):
    ax, ay = [0.0, 1.0, 2.5, 3.0, 5.0, 6.0], [0.0, 2.0, 3.0, 4.5, 5.0]
    f = lambda x, y: x**3 - x * y**2 + y - 2
    uneven = [float(f(x, y)) for y in ay for x in ax]
    ring = [float(np.sin(2 * np.pi * i / 40) * (1 + j)) for j in range(5) for i in range(40)]
    pts = [(x / 4 + 0.1, y / 3 + 0.05, x * 2.3 + 0.4, 1 + y / 4) for x in range(1, 22) for y in range(1, 13)]
    df = spark.createDataFrame([(uneven, ring, *p) for p in pts], "u array<double>, r array<double>, x double, y double, i double, j double")
    a = grids.irregular_bicubic(F.col("u"), F.col("x"), F.col("y"), ax, ay)
    b = grids.wrapped_bicubic(F.col("r"), F.col("i"), F.col("j"), 40, 5)
    for r in df.select("x", "y", "i", "j", a.alias("a"), b.alias("b")).collect():
        assert abs(r["a"] - f(r["x"], r["y"])) < 1e-8
        assert abs(r["b"] - np.sin(2 * np.pi * (r["i"] - 1) / 40) * r["j"]) < 1e-4 * 8


@pytest.mark.parametrize("count, quadratic", [(12, True), (12, False), (5, True), (3, True)])
def test_pole_values_are_those_of_least_squares(spark, count, quadratic):
    lats = [-80.0, -55.0, 10.0, 60.0, 75.0]
    z = np.random.default_rng(count).normal(size=(len(lats), count))
    rows = spark.createDataFrame([("a", lats[j], float(z[j, i])) for j in range(len(lats)) for i in range(count)] + [("one", 5.0, 2.0), ("one", 5.0, 4.0), ("none", 5.0, None)], "g string, la double, v double")
    got = {r["g"]: (r["north"], r["south"]) for r in grids.pole_fit(rows, F.col("la"), F.col("v"), ["g"], quadratic).collect()}
    want = []
    for j, sign in (((4, 3), 1), ((0, 1), -1)):
        r = np.repeat([np.tan(np.radians(90 - sign * lats[k]) / 2) for k in j], count)
        t = np.tile(np.arange(count) * 2 * np.pi / count, 2)
        x, y = r * np.cos(t), r * np.sin(t)
        terms = [np.ones(2 * count), x, y, x * x, x * y, y * y] if quadratic else [np.ones(2 * count), x, y]
        if count < 5:
            terms = terms[:1]
        want.append(np.linalg.lstsq(np.stack(terms, 1), z[list(j)].ravel(), rcond=None)[0][0])
    assert got.pop("a") == pytest.approx(want, abs=1e-9) and got == {"one": (3.0, 3.0)}


def test_axes_of_grids(spark):
    kinds = "handle long, nomvar string, grtyp string, ni int, nj int, ip1 int, ip2 int, ip3 int"
    held = spark.createDataFrame([
        (9, ">>  ", "L", 4, 1, 1, 2, 3), (5, ">>", "E", 4, 1, 1, 2, 3), (4, ">>", "E", 6, 1, 1, 2, 3), (7, "^^", "E", 1, 3, 1, 2, 3),
        (2, "^^", "L", 4, 3, 7, 7, 7), (1, ">>", "L", 4, 3, 7, 7, 7), (3, "^>", "F", 20, 1, 8, 8, 8), (6, ">>", "X", 4, 1, 9, 9, 9), (8, "^^", "X", 1, 3, 9, 9, 9), (10, "TT", "L", 4, 1, 1, 2, None),
    ], kinds)
    grid = "grtyp string, ni int, nj int, ig1 int, ig2 int, ig3 int"
    wanted = spark.createDataFrame([("Z", 4, 3, 1, 2, 3)] * 3 + [("Z", 0, -1, 1, 2, 3), ("Z", 5, 3, 1, 2, 3), ("#", 2, 2, 1, 2, 99), ("Y", 4, 3, 7, 7, 7), ("U", 0, 0, 8, 8, 8), ("Z", 4, 3, 9, 9, 9), ("Z", 4, 3, None, 2, 3)], grid)
    got = sorted(tuple(r)[3:4] + tuple(r)[6:] for r in records.axes(wanted, held).where("ig1 IS NOT NULL").collect() if r["x_handle"] is not None)
    assert got == [(1, 4, 7, 6, 3, "#", "E"), (1, 4, 7, 6, 3, "Z", "E"), (1, 5, 7, 4, 3, "Z", "E"), (7, 1, 2, 4, 3, "Y", "L"), (8, 3, 3, 20, 1, "U", "F")]
    assert records.axes(wanted, held).count() == 8 and records.axes(wanted, held.where("handle < 0")).where("kind IS NULL").count() == 8


def test_stores_are_appended_whole_or_not(spark, tmp_path):
    from nephos.sources import recordstore as rs

    a, b, c = (str(tmp_path / x) for x in "abc")
    rows = lambda *r: spark.createDataFrame(r, "handle long, nomvar string, field array<double>")
    rs.write(rows((1, "UU", [1.0]), (2, "VV", [2.0])), a)
    rs.write(rows((2, "VV", [5.0]), (3, "TT", [6.0])), b)
    rs.append(spark, a, b)
    assert {r["handle"]: r["field"] for r in rs.fields(rs.open_store(spark, b)).collect()} == {1: [1.0], 2: [2.0], 3: [6.0]}
    rs.write(rows((4, "UU", [1.0])).withColumn("more", F.lit(1)), c)
    with pytest.raises(ValueError, match="different columns"):
        rs.append(spark, c, b)
    assert spark.read.parquet(b).count() == 4


def test_bits_are_recut(spark):
    given = [0xFFFFFFF, 0, 0xABCDEF1]
    whole = given[0] << 56 | given[1] << 28 | given[2]
    assert one(spark, *codecs.recut([F.lit(g) for g in given], [28] * 3, [21] * 4)) == tuple(whole >> s & 0x1FFFFF for s in (63, 42, 21, 0))
    with pytest.raises(ValueError, match="84 bits"):
        codecs.recut([F.lit(g) for g in given], [28] * 3, [32, 32])


def test_descriptors_as_text(spark):
    from nephos.functions import descriptors

    lit = F.lit
    assert one(spark, *descriptors.printable("N", *descriptors.pack("N", lit(40.5), lit(50.0), lit(381000.0), lit(21.0)))) == ("  40.5", "  50.0", "381.0Km", " 21.000")
    assert one(spark, *descriptors.printable("Z", lit(12), lit(1234567), lit(-5), lit(None).cast("int"))) == ("    12", "******", "     -5", None)


def test_wind_at_the_pole(spark):
    # The same wind in the polar plane, seen from all longitudes; and none at all.
    lon = np.arange(12) * 30.0
    u, v = (lambda a: 3 * -np.sin(a) + 4 * np.cos(a))(np.radians(lon)), (lambda a: -3 * np.cos(a) - 4 * np.sin(a))(np.radians(lon))
    rows = [("a", float(m), float(x), float(y), ring) for m, x, y in zip(lon, u, v, strict=True) for ring in (1, 2)] + [("calm", 0.0, 0.0, 0.0, 1), ("calm", 0.0, 0.0, 0.0, 2)]
    from nephos.operators import scores

    got = {r["g"]: (r["speed"], r["angle"]) for r in scores.pole_wind(spark.createDataFrame(rows, "g string, lon double, u double, v double, ring int"), F.col("lon"), "u", "v", "ring", ["g"], 45.0).collect()}
    assert got["a"] == pytest.approx((5.0, 53.13010235), abs=1e-7) and got["calm"] == (0.0, 45.0)


def test_command_lines():
    from nephos.operators.directives import DirectiveError, command_line

    known = [("-", "", ""), ("-", "", ""), ("n.", "0", "1"), ("n.", "x", "y"), ("low_", "A", "B")]
    assert command_line([], known) == (["", "", "0", "x", "a"], 0)
    assert command_line("u -n =-5:6 -LOW -- -v".split(), known) == (["U", "-V", "-5", "6", "b"], 2)
    assert command_line("-n=-5 7".split(), known)[0][2:4] == ["-5", "7"]
    for bad in ("a b c", "-m", "-n 1:2:3", "-n 1 2 3", "-", "-low=a b", "-n -- 1 2 3"):
        with pytest.raises(DirectiveError):
            command_line(bad.split(), known)
    with pytest.raises(DirectiveError):
        command_line(["a"], known[2:])


def test_system_time(spark):
    import datetime as dt

    said = lambda t: (t.year * 10000 + t.month * 100 + t.day, (t.hour * 10000 + t.minute * 100 + t.second) * 100)
    before = said(dt.datetime.now(dt.UTC))
    assert before <= one(spark, *dates.system_time()) <= said(dt.datetime.now(dt.UTC))


def test_places_in_cells_and_clouds(spark):
    from nephos.operators import fields

    corners = [(0.0, 0.0), (4.0, 1.0), (5.0, 4.0), (-1.0, 2.0)]
    # The projective map by eight linear equations.
    rows, right = [], []
    for (x, y), (u, v) in zip(corners, ((0, 0), (1, 0), (1, 1), (0, 1)), strict=True):
        rows += [[u, v, 1, 0, 0, 0, -x * u, -x * v], [0, 0, 0, u, v, 1, -y * u, -y * v]]
        right += [x, y]
    m = np.append(np.linalg.solve(rows, right), 1.0).reshape(3, 3)
    lit = [(F.lit(x), F.lit(y)) for x, y in corners]
    for u, v in ((0.3, 0.7), (0.9, 0.05), (0.5, 0.5)):
        x, y, w = m @ [u, v, 1.0]
        assert one(spark, *fields.in_cell((F.lit(x / w), F.lit(y / w)), *lit)) == pytest.approx((u, v), abs=1e-9)
    assert one(spark, *fields.in_cell((F.lit(0.5), F.lit(0.5)), lit[0], lit[0], lit[0], lit[0])) == (None, None)
    even = spark.createDataFrame([([float(i) for _ in range(4) for i in range(5)], [float(j) for j in range(4) for _ in range(5)])], "xs array<double>, ys array<double>")
    for x, y, i, j, want in ((1.25, 2.5, 2, 3, (2.25, 3.5)), (0.1, 0.2, 1, 1, (1.1, 1.2)), (3.9, 2.9, 5, 4, (4.9, 3.9)), (4.5, 1.0, 5, 2, None), (0.5, 2.5, 5, 4, None)):
        at = fields.place_in_cloud((F.lit(x), F.lit(y)), F.col("xs"), F.col("ys"), F.lit(i), F.lit(j), 5, 4)
        got = even.select(at.alias("at")).first()["at"]
        assert (got is None and want is None) or tuple(got) == pytest.approx(want)


@pytest.mark.parametrize("ni, nj", [(10, 8), (8, 9), (9, 13), (14, 11)])
def test_fields_of_their_nodes(spark, ni, nj):
    # Cubics of both axes come back wherever the nodes are evenly spaced; the rest is near.
    from nephos.operators import series

    f = lambda i, j: 81 * ((i - 3) ** 3 - 2 * i * j + j**2)
    node = lambda k, n: (k - 1) % 3 == 0 or k == n
    z = [f(i, j) if node(i, ni) and node(j, nj) else -(10**9) for j in range(1, nj + 1) for i in range(1, ni + 1)]
    got = one(spark, series.refined(F.array(*[F.lit(v).cast("long") for v in z]), ni, nj))[0]
    plain = lambda k, n: (n - 1) % 3 == 0 or (k <= n - (n - 1) % 3 - 6) or node(k, n)
    for k, v in enumerate(got):
        i, j = k % ni + 1, k // ni + 1
        if plain(i, ni) and plain(j, nj):
            assert v == f(i, j)
    if (ni - 1) % 3 == 2:
        assert got[ni - 2] == int((f(ni, 1) + f(ni - 2, 1)) / 2 + (0.5001 if f(ni, 1) + f(ni - 2, 1) > 0 else -0.5001))
    with pytest.raises(ValueError):
        series.refined(F.array(), 7, 9)
