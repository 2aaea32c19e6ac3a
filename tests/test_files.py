"""Record files, rule files, definition sections and options beyond what their queries do."""

import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from nephos.operators import catalogue, gridset
from nephos.operators.gridset import Grid
from nephos.sources import recordfile, tokens

RECORD = {"nomvar": "TT", "typvar": "P", "etiket": "run", "grtyp": "X", "ni": 4, "nj": 3, "nk": 1, "datyp": 5, "nbits": 32}


def made(path, count):
    out = recordfile.Writer(str(path))
    handles = [out.put(RECORD | {"ip1": k}, recordfile.payload(np.arange(12) + k, 5, 32)) for k in range(count)]
    out.close()
    return handles


def test_more_than_a_page(spark, tmp_path):
    handles = made(tmp_path / "a.rec", 600)
    path = str(tmp_path / "a.rec")
    head = recordfile.file_header(path)
    assert (head["pages"], head["records"], head["size"] * 8) == (3, 600, os.path.getsize(path))
    assert [len(recordfile.read_page(path, a)[1]) for a in recordfile.page_addresses(path)] == [256, 256, 88]
    recordfile.register(spark)
    found = spark.read.format("records").load(str(tmp_path))
    assert found.rdd.getNumPartitions() == 3
    rows = {r["handle"]: r for r in found.collect()}
    assert list(rows) == handles and all(r["field"] == [float(k + i) for i in range(12)] for k, r in enumerate(rows.values()))
    assert recordfile.erase(path, [handles[0], handles[599], handles[0]]) == 2 and recordfile.erase(path, [handles[0]]) == 0
    left = spark.read.format("records").load(path)
    assert left.where("erased").count() == 2 and left.where("erased AND field IS NOT NULL").count() == 0
    assert recordfile.restore(path, [handles[599]]) == 1 and recordfile.file_header(path)["erasures"] == 1
    assert recordfile.check(spark, str(tmp_path)).first()["sound"]


def test_damage_is_found(spark, tmp_path):
    made(tmp_path / "a.rec", 3)
    path = str(tmp_path / "a.rec")
    with open(path, "r+b") as f:
        f.seek((recordfile.page_addresses(path)[0] - 1) * 8 + 100)
        f.write(b"\x01")
    assert not recordfile.check(spark, str(tmp_path)).first()["sound"]
    recordfile.register(spark)
    with pytest.raises(Exception, match="damaged"):
        spark.read.format("records").load(path).collect()
    recordfile.truncate(path, 4000)
    with pytest.raises(ValueError, match="damaged"):
        recordfile.file_header(path)
    (tmp_path / "b.rec").write_bytes(bytes(100))
    with pytest.raises(ValueError, match="no record file"):
        recordfile.file_header(str(tmp_path / "b.rec"))


def test_writing_is_all_or_nothing(spark, tmp_path):
    recordfile.register(spark)
    top = str(tmp_path / "out")
    good = spark.range(4).select(F.lit("UU").alias("nomvar"), F.lit(2).alias("ni"), F.lit(1).alias("nj"), F.col("id").cast("int").alias("ip1"), F.array(F.col("id") * 1.0, F.lit(2.0)).alias("field"))
    good.write.format("records").mode("append").save(top)
    with pytest.raises(Exception, match="as many values"):
        good.withColumn("ni", F.when(F.col("ip1") == 3, 9).otherwise(2)).write.format("records").mode("append").save(top)
    assert spark.read.format("records").load(top).count() == 4
    good.limit(1).write.format("records").mode("overwrite").save(top)
    assert [r["field"] for r in spark.read.format("records").load(top).collect()] == [[0.0, 2.0]]
    empty = str(tmp_path / "none")
    good.where("ip1 > 9").write.format("records").mode("append").save(empty)
    assert spark.read.format("records").load(empty).count() == 0
    with pytest.raises(ValueError):
        recordfile.entry(RECORD | {"ip1": 1 << 28}, 0, 0)


@pytest.mark.parametrize(("kind", "bits"), [(5, 32), (5, 64), (2, 9), (4, 11), (0, 32), (3, 8)])
def test_payloads_of_record_files(kind, bits):
    draw = np.random.default_rng(kind * 100 + bits)
    x = draw.normal(size=37) if kind == 5 else draw.integers(-(1 << bits - 1) if kind == 4 else 0, 1 << bits - (kind == 4), 37)
    back = recordfile.values(recordfile.payload(x, kind, bits).ljust(400, b"\0"), 37, kind, bits)
    assert np.allclose(back, x, rtol=1e-6 if bits == 32 else 0, atol=0)
    if kind in (2, 4):
        with pytest.raises(ValueError):
            recordfile.payload([1 << bits], kind, bits)


def test_words_of_an_entry():
    words = recordfile.entry(RECORD | {"ip1": 42043040, "ig2": 0x123456, "date_stamp": 442998815, "deet": 300, "npas": 12}, 33, 2335)
    assert words[0] == 1 << 24 | 33 and words[1] == 2335 and words[14] == 42043040 << 4 and words[17] == 44299881 * 8 + 5
    back = recordfile.described(words)
    assert back["ig2"] == 0x123456 and back["date_stamp"] == 442998815 and back["nomvar"] == "TT" and back["etiket"] == "RUN" and not back["erased"]
    assert struct.pack(">I", words[13])[:3].hex() == f"{(52 << 18 | 52 << 12):06x}"


@pytest.mark.parametrize("way", [tokens.MINIMUM, tokens.PARALLELOGRAM])
@pytest.mark.parametrize("bits", [4, 9, 15, 16])
def test_compressed_tokens(way, bits):
    draw = np.random.default_rng(bits)
    for ni, nj in ((2, 2), (16, 17), (31, 5)):
        for z in (draw.integers(0, 1 << bits, ni * nj), np.full(ni * nj, 3), np.minimum(np.arange(ni * nj) // 3, (1 << bits) - 1), draw.integers(0, 2, ni * nj) * ((1 << bits) - 1)):
            assert (tokens.uncompress(tokens.compress(z, ni, bits, way), ni, nj) == z).all()
    with pytest.raises(ValueError):
        tokens.compress(np.array([1, 2, 3, 1 << bits]), 2, bits, way)
    assert tokens.best_way(16, 16, 5) == tokens.PARALLELOGRAM and tokens.best_way(15, 16, 5) == tokens.MINIMUM


def test_rule_files():
    for bad in (["x"], [" 1, 'D', 'Q', 'value', 1", "3"], [" 1, 'D', 'IP1', 'delta', 3", "1, 2, 3"], [" 1, 'D', 'IP1'"]):
        with pytest.raises(ValueError):
            catalogue.read_rules(bad)
    rules = catalogue.read_rules([" 1, 'D', 'IP1', 'value', 1", "7", " 1, 'E', 'IP2', 'value', 1", "7", " 0"])
    with pytest.raises(ValueError):
        catalogue.selected(None, rules, F.col)
    assert catalogue.read_rules(catalogue.write_rules(rules)) == rules and catalogue.read_rules([" 0"]) == []


def test_arrays_of_a_restart(spark):
    one = spark.createDataFrame([("A", 3)], "name string, high int").select("name", F.array(catalogue.layout(F.lit(1), F.col("high"), F.lit(0), F.lit(0), F.col("high"))).alias("layouts"), F.lit(catalogue.RESTART | catalogue.TO_ZERO).alias("flags"))
    old = catalogue.created(one).withColumn("values", F.array(F.lit(1.0), F.lit(2.0)))
    with pytest.raises(Exception, match="other bounds"):
        catalogue.created(one, old).collect()
    assert catalogue.created(one.where("name = 'B'")).count() == 0


def test_options_and_grids():
    o = gridset.Options()
    for name, value in (("none", 1), ("interp_degree", "best"), ("weight_number", 17)):
        with pytest.raises(ValueError):
            o.set(name, value)
    assert o.set("Degre_Interp", "VOISIN").get("interp_degree") == "nearest"
    with pytest.raises(ValueError):
        Grid("Q", 4, 4)
    with pytest.raises(ValueError):
        Grid("Z", 4, 4, ref="L", ax=(1.0, 2.0), ay=(1.0, 2.0, 3.0, 4.0))


def test_linear_fields_are_exact_on_uneven_grids(spark):
    """In the outer cells a cubic's places go on as the last inner cell's, so only inner ones are exact."""
    ax, ay = tuple(float(x) for x in np.cumsum(np.linspace(1, 3, 30)) + 100), tuple(float(y) for y in np.cumsum(np.linspace(0.5, 2, 25)) - 20)
    grid = Grid("Z", 30, 25, (100, 100, 9000, 0), "L", ax, ay)
    z = [2 * x - 3 * y + 1 for y in ay for x in ax]
    draw = np.random.default_rng(4)
    rows = [(z, float(y), float(x)) for x, y in zip(draw.uniform(ax[1], ax[-2], 50), draw.uniform(ay[1], ay[-2], 50), strict=True)]
    df = spark.createDataFrame(rows, "z array<double>, lat double, lon double")
    for degree in ("linear", "cubic"):
        for r in df.select("lat", "lon", gridset.value_over(F.col("z"), grid, F.col("lat"), F.col("lon"), degree).alias("v")).collect():
            assert r["v"] == pytest.approx(2 * r["lon"] - 3 * r["lat"] + 1, abs=1e-8)
