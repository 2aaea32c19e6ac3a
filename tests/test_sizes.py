"""Faults that only larger tables show, against SQL on small made tables."""

from types import SimpleNamespace

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from nephos.operators import directives, grids, scores, series
from nephos.plans import catalogue
from tests.test_queries import rows


def held(spark, folder, tables, name):
    """A query's rows and its SQL's over made tables: (name, rows, schema)."""
    con = duckdb.connect()
    for table, values, schema in tables:
        spark.createDataFrame(values, schema).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    df = catalogue.QUERIES[name](spark, str(folder))
    answer = con.execute(catalogue.ORACLE_SQL[name])
    return rows(df.columns, df.collect()), rows([c[0] for c in answer.description], answer.fetchall())


#: Thousandths: as floats times 1000 they are whole, as doubles many are a little less.
EDGES = [("embeddings", [(k, [(k + i) % 500 / 1000 - 0.2 for i in range(64)]) for k in range(500)], "vec_id long, embedding array<float>")]


@pytest.mark.parametrize("name", ["coarse_refined", "lorenzo_residual"])
def test_floats_on_edges(spark, tmp_path, name):
    got, want = held(spark, tmp_path, EDGES, name)
    assert got == want


def test_codes_that_come_again(spark, tmp_path):
    """Parts 300 000 apart have the same code of six digits: a remark in one table, a repeating element in another, and both."""
    parts = [(k + 300_000 * t, k % 50 + 1) for k in range(60) for t in range(3)]
    tables = [("part", parts, "p_partkey long, p_size int"), ("lineitem", [(p, p % 7 + 1) for p, _ in parts] + [(299_999, 1), (None, 2)], "l_partkey long, l_linenumber int")]
    got, want = held(spark, tmp_path, tables, "element_repeats")
    assert got == want


def test_directives_of_one_text_run_once(monkeypatch):
    """Rows of one text share its run, and the turns of a loop do not read its lines again."""
    read, plain = [], directives.TOKEN
    monkeypatch.setattr(directives, "TOKEN", SimpleNamespace(match=lambda text, at: read.append(text) or plain.match(text, at)))
    monkeypatch.setattr(directives.F, "pandas_udf", lambda run, kind: run)
    lines = "count = 0\ntotal = 0\nwhile (count < 400)\n count = count + 1\n total = total + count * 2, 7\n total = total[1]\nendwhile\n"
    found = directives.evaluated(pd.Series([lines, None, "total = (", lines, "total = 1"] * 20), "total")
    assert found.tolist() == ["160400", None, None, "160400", "1"] * 20 and len(read) < 200


def test_product_of_all_rows(spark, tmp_path):
    draw = np.random.default_rng(4)
    tables = [("embeddings", [(k, x.tolist()) for k, x in enumerate(draw.normal(size=(70, 64)))], "vec_id long, embedding array<double>")]
    got, want = held(spark, tmp_path, tables, "matrix_product")
    assert got == want and len(got[1]) == 4900


def test_product_in_blocks(spark, monkeypatch):
    """Blocks of few rows and slices of few columns, places that are held twice or not at all, and what is not finite."""
    for name, size in (("BLOCK_ROWS", 3), ("SLICE", 2)):
        monkeypatch.setattr(series, name, size)
    a = [(i, i * k % 7, float(i + k)) for i in range(9) for k in range(i % 5)] + [(2, 50, float("inf")), (3, 0, None)]
    b = [(i * k % 7, f"c{i}", float(i - k)) for i in range(8) for k in range(i % 4)] + [(50, "c1", 2.0), (99, "c9", 1.0)]
    want = {}
    for i, k, v in a:
        for m, j, w in b:
            if k == m and v is not None:
                want[i, j] = want.get((i, j), 0.0) + v * w
    got = series.product(spark.createDataFrame(a, "i int, k long, v double"), spark.createDataFrame(b, "k long, j string, v double"))
    assert {(r["i"], r["j"]): r["v"] for r in got.collect()} == want and got.count() == len(want)


def test_neighbours_of_places(spark):
    """Crowded, shared and lonely places, across the first meridian, against brute force; and what a task meets stays few."""
    draw = np.random.default_rng(8)
    crowd = [(k, 10.0 + x, (0.5 + y) % 360) for k, (x, y) in enumerate(draw.normal(scale=0.4, size=(300, 2)).round(2).tolist())]
    spread = [(k, x, y) for k, (x, y) in enumerate(draw.uniform((-60, 0), (60, 359), size=(150, 2)).tolist(), 300)]
    shared = [(k, float(k % 3 * 5), float(k % 2 * 40)) for k in range(450, 520)]
    points = crowd + spread + shared + [(520, -60.0, 0.0), (521, 60.0, 359.9), (522, None, 3.0)]
    targets = [(k, x, y) for k, (x, y) in enumerate(draw.uniform((-70, 0), (70, 360), size=(200, 2)).tolist())] + [(k, 10.2, k % 4 * 119.9) for k in range(200, 260)] + [(300, 5.0, 40.0)]
    want = {}
    for t, lat, lon in targets:
        if -60 <= lat <= 60 and 0 <= lon <= 359.9:
            turn = lambda b, lon=lon: min(abs(b - lon), 360 - abs(b - lon))
            near = sorted(((a - lat) ** 2 + turn(b) ** 2, s) for s, a, b in points if a is not None and abs(a - lat) < 10 and turn(b) < 10)[:5]
            want |= {(t, s): (place, d2) for place, (d2, s) in enumerate(near, 1)}
    frames = [spark.createDataFrame(x, f"{n} int, lat double, lon double") for x, n in ((targets, "t"), (points, "s"))]
    got = {(r["t"], r["s"]): (r["place"], r["d2"]) for r in grids.nearest_points(*frames, "t", "s", 5).collect()}
    assert got.keys() == want.keys() and all(got[x][0] == want[x][0] and got[x][1] == pytest.approx(want[x][1]) for x in want)


def joined_rows(plan):
    """Rows that the joins of a plan that has run put out."""
    kind = plan.nodeName()
    if kind == "AdaptiveSparkPlan":
        return joined_rows(plan.executedPlan())
    if "QueryStage" in kind:
        return joined_rows(plan.plan())
    own = plan.metrics().apply("numOutputRows").value() if "Join" in kind else 0
    return own + sum(joined_rows(plan.children().apply(i)) for i in range(plan.children().size()))


def test_targets_of_one_place_meet_once(spark):
    """3000 targets at 40 places, the fourth source farther off than a tile that holds few: not each with all of the box."""
    n = F.col("id")
    s = spark.range(420).select(n.alias("s"), F.floor(n / 21).cast("double").alias("lat"), (n % 21).cast("double").alias("lon"))
    t = spark.range(3000).select(n.alias("t"), (n % 8 + 5).cast("double").alias("lat"), (n % 5 + 5.25).alias("lon"))
    near = grids.nearest_points(t, s, "t", "s", 4).groupBy("place").count()
    assert sorted(map(tuple, near.collect())) == [(k, 3000) for k in (1, 2, 3, 4)]
    assert joined_rows(near._jdf.queryExecution().executedPlan()) < 20_000


def test_costly_rows_are_dealt(spark, tmp_path):
    """A small file of many rows whose levels are costly to write is not one task's."""
    spark.range(120_000).select(F.col("id").alias("p_partkey"), (F.col("id") % 50 + 1).cast("int").alias("p_size")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    text = catalogue.QUERIES["level_codes_text"](spark, str(tmp_path))
    assert text.groupBy(F.spark_partition_id()).count().count() == 3


def shuffled_rows(plan):
    """Rows that the exchanges of a plan that has run wrote."""
    kind = plan.nodeName()
    if kind == "AdaptiveSparkPlan":
        return shuffled_rows(plan.executedPlan())
    if "QueryStage" in kind:
        return shuffled_rows(plan.plan())
    own = plan.metrics().apply("shuffleRecordsWritten").value() if kind == "Exchange" else 0
    return own + sum(shuffled_rows(plan.children().apply(i)) for i in range(plan.children().size()))


def test_gradients_deal_rows_once(spark):
    """Rows over several bands of j, some missing, against plain sums; no row is sent three times."""
    cells = {(i, j): (float(i * j % 17), float((i + 2 * j) % 13)) for i in range(1, 6) for j in range(200, 1100) if (i + j) % 29}
    a = b = 0.0
    for (i, j), x in cells.items():
        ends = [cells.get(at) for at in ((i + 1, j), (i, j + 1))]
        if all(ends):
            for y in ends:
                df, dv = x[0] - y[0], x[1] - y[1]
                a, b = a + abs(df - dv), b + max(abs(df), abs(dv))
    frame = spark.createDataFrame([(0, *at, *x) for at, x in cells.items()], "g int, i int, j int, f double, v double")
    score = scores.gradient_score(frame, "i", "j", "f", "v", ["g"])
    assert score.collect()[0]["s1"] == pytest.approx(100 * a / b)
    assert shuffled_rows(score._jdf.queryExecution().executedPlan()) < 1.5 * len(cells)


def test_waves_are_summed_in_their_row(spark, tmp_path):
    """Fewer rows are shuffled than the spectrum has coefficients, let alone those times latitudes."""
    spark.createDataFrame([(k, [float(k + i) for i in range(64)]) for k in range(200)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    back = catalogue.QUERIES["spectral_round_trip"](spark, str(tmp_path))
    assert sorted((r["m"], r["n"], r["re"]) for r in back.collect() if r["vec_id"] == 3) == [(m, n, 3.0 + 8 * m + n) for m in range(7) for n in range(m, 7)]
    assert shuffled_rows(back._jdf.queryExecution().executedPlan()) < 200 * 28
