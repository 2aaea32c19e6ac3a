import numpy as np

from nephos.llm import lattice
from nephos.llm.common import table


def brute(rows):
    """n_links and components by comparing all pairs."""
    good = {k: np.array(v, float) for k, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    keys = list(good)
    unit = np.stack([good[k] / np.linalg.norm(good[k]) for k in keys])
    near = unit @ unit.T >= 0.9 - 1e-12
    parent = {k: k for k, _ in rows}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, j in zip(*np.nonzero(np.triu(near, 1)), strict=True):
        a, b = root(keys[i]), root(keys[j])
        parent[max(a, b)] = min(a, b)
    links = dict(zip(keys, near.sum(1) - 1, strict=True))
    return {k: (int(links.get(k, 0)), root(k), root(k) == k) for k in parent}


def result(df):
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in df.collect()}


def test_lattice_points():
    draw = np.random.default_rng(3)
    x = draw.standard_normal((500, 8)) * 2
    p = lattice.nearest(x)
    assert ((p.sum(1) % 4 == 0) & ((p % 2 == 0).all(1) | (p % 2 == 1).all(1))).all()
    far = ((x - p / 2) ** 2).sum(1)
    assert far.max() <= 1 + 1e-9
    around = p[:, None, :] + lattice.MINIMAL
    assert (((x[:, None, :] - around / 2) ** 2).sum(2) >= far[:, None] - 1e-9).all()


def test_table_against_brute_force(spark):
    rows = table(spark, "/root/testdata/sf0.001", "embeddings")
    assert result(lattice.near(rows)) == brute([(r["vec_id"], r["embedding"]) for r in rows.collect()])


def test_copies_near_vectors_and_edges(spark):
    draw = np.random.default_rng(4)
    base = draw.standard_normal((12, 64))
    rows = [(i, [float(x) for x in base[i % 12] + (draw.standard_normal(64) * 0.22 if i % 3 else 0)]) for i in range(240)]
    rows += [(300, None), (301, [0.0] * 64), (302, [float("nan")] * 64), (303, [float("inf")] * 64), (304, [None] * 64), (305, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS id", "2 AS u")
    assert result(lattice.near(df)) == brute(rows)
    assert lattice.near(df.where("vec_id > 999")).count() == 0


def test_recall_of_planted_pairs(spark):
    """Pairs at cosines from 0.9 to 0.95, one a seed, in the table's width and others: at least 0.9 is asked, 0.99 held."""
    for width in (64, 256):
        draw = np.random.default_rng(width)
        rows, want = [], 0
        for i in range(1500):
            a, b = draw.standard_normal((2, width))
            a /= np.linalg.norm(a)
            b -= (a @ b) * a
            b /= np.linalg.norm(b)
            c = draw.uniform(0.85, 0.95)
            rows += [(2 * i, a.tolist()), (2 * i + 1, (c * a + np.sqrt(1 - c * c) * b).tolist())]
            want += c >= 0.9
        got = result(lattice.near(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
        exact = brute(rows)
        assert sum(v[0] for v in exact.values()) == 2 * want > 1000
        assert sum(v[0] for v in got.values()) >= 0.99 * 2 * want
        assert all(got[k][0] <= exact[k][0] for k in got)


def test_extreme_components_ties_and_repeats(spark):
    draw = np.random.default_rng(5)
    base = draw.standard_normal(16)
    near = base + draw.standard_normal(16) * 0.1
    scale = [1e200, 1e-170, 1.0, 1e300]
    rows = [(i, (v * s).tolist()) for i, (v, s) in enumerate((v, s) for v in (base, near) for s in scale)]
    got = result(lattice.near(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    assert got == {i: (7, 0, i == 0) for i in range(8)}
    # Two rows of one key, and equal vectors under two keys.
    twice = [(1, base.tolist()), (1, base.tolist()), (2, base.tolist()), (3, (-base).tolist())]
    out = sorted(tuple(r) for r in lattice.near(spark.createDataFrame(twice, "vec_id long, embedding array<double>")).collect())
    assert out == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True)]


def test_every_plan_finds_pairs_at_the_threshold():
    draw = np.random.default_rng(12)
    a, b = draw.standard_normal((2, 2500, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b -= (a * b).sum(1)[:, None] * a
    b = 0.9 * a + np.sqrt(1 - 0.81) * b / np.linalg.norm(b, axis=1)[:, None]
    for _, plan in lattice.PLANS:
        met = np.zeros(len(a), bool)
        (own_a, look_a), (own_b, look_b) = lattice.cells(a, plan), lattice.cells(b, plan)
        for own, look in ((own_a, look_b), (own_b, look_a)):
            met |= (look.reshape(len(a), plan.tables, -1) == own[:, :, None]).any((1, 2))
        assert met.mean() >= 0.997


def test_plans_agree(spark):
    draw = np.random.default_rng(13)
    base = draw.standard_normal((40, 64))
    rows = [(i, [float(x) for x in base[i % 40] + draw.standard_normal(64) * 0.15]) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute(rows)
    assert all(result(lattice.near(df, plan=plan)) == want for _, plan in lattice.PLANS)


def test_links_do_not_hang_on_the_number_of_vectors(spark, monkeypatch):
    """Four pairs at the threshold, of which each plan that was once chosen by a count missed one or two."""
    draw = np.random.default_rng(2)
    a, b = draw.standard_normal((2, 2500, 64))[:, [771, 1106, 1630, 1892]]
    a /= np.linalg.norm(a, axis=1)[:, None]
    b -= (a * b).sum(1)[:, None] * a
    c = 0.9 + 1e-9
    b = c * a + np.sqrt(1 - c * c) * b / np.linalg.norm(b, axis=1)[:, None]
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([a, b]))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for count in (len(rows), 5_000_000, 50_000_000):
        monkeypatch.setattr(type(df), "count", lambda self, count=count: count)
        assert result(lattice.near(df)) == brute(rows), count
