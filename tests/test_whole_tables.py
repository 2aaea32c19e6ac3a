"""Queries of whole tables against brute force."""

import numpy as np
import pytest

from nephos.plans import catalogue


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("whole"))
    draw = np.random.default_rng(9)
    tables = {
        "orders": ([(int(k), float(z)) for k, z in enumerate(draw.integers(1, 10_000, 5000), 7)], "o_orderkey long, o_totalprice double"),
        "customer": ([(k,) for k in range(900)], "c_custkey long"),
        "supplier": ([(k, k / 7) for k in range(300)], "s_suppkey long, s_acctbal double"),
        "embeddings": ([(k, v.tolist()) for k, v in enumerate(draw.normal(size=(90, 64)))], "vec_id long, embedding array<double>"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}.parquet")
    return d, {k: rows for k, (rows, _) in tables.items()}


def test_regrid(spark, made):
    d, rows = made
    total, over = {}, {}
    for k, z in rows["orders"]:
        low, high = k / 2, k / 2 + 0.5
        for c in range(int(low // 15.25), int(high // 15.25) + 1):
            w = min(high, (c + 1) * 15.25) - max(low, c * 15.25)
            if w > 0:
                total[c], over[c] = total.get(c, 0) + w * z, over.get(c, 0) + w
    got = {r["id"]: (r["mean"], r["overlap"]) for r in catalogue.QUERIES["regrid_average"](spark, d).collect()}
    assert got.keys() == over.keys() and len(got) == 165
    assert all(got[c] == pytest.approx((total[c] / over[c], over[c]), abs=0.006) for c in over)


def test_nearest(spark, made):
    d, rows = made
    s = [(k, k * 37 % 140 - 70.0, k * 91 % 359 + 0.5) for k, _ in rows["supplier"]]
    want = {}
    for (c,) in rows["customer"]:
        lat, lon = c * 13 % 150 - 75.0, c * 29 % 359 + 0.25
        if not (min(a for _, a, _ in s) <= lat <= max(a for _, a, _ in s) and min(b for *_, b in s) <= lon <= max(b for *_, b in s)):
            continue
        turn = lambda b, lon=lon: min(abs(b - lon), 360 - abs(b - lon))
        near = sorted(((a - lat) ** 2 + turn(b) ** 2, k) for k, a, b in s if abs(a - lat) < 10 and turn(b) < 10)[:4]
        whole = sum(1 / max(x, 1e-10) for x, _ in near)
        want |= {(c, k): (i, 1 / max(x, 1e-10) / whole) for i, (x, k) in enumerate(near, 1)}
    got = {(r["c_custkey"], r["s_suppkey"]): (r["place"], r["weight"]) for r in catalogue.QUERIES["knn_weights"](spark, d).collect()}
    assert got.keys() == want.keys() and max(c for c, _ in got) > 500
    assert all(got[k] == pytest.approx(want[k], abs=1e-4) for k in want)


def test_product(spark, made):
    d, rows = made
    m = np.array([v for _, v in rows["embeddings"]])
    got = catalogue.QUERIES["matrix_product"](spark, d).collect()
    assert len(got) == 2 * 90 and max(abs(r["v"] - (m @ m.T)[r["i"], r["j"]]) for r in got) < 1e-4


def test_spectral(spark, made):
    d, rows = made
    want = {(k, q // 8, q % 8): (v[q], v[q] * (q // 8)) for k, v in rows["embeddings"] for q in range(64) if q // 8 <= q % 8 <= 6}
    got = {(r["vec_id"], r["m"], r["n"]): (r["re"], r["im"]) for r in catalogue.QUERIES["spectral_round_trip"](spark, d).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-4) for k in want)
