import random
from collections import defaultdict

from nephos.llm import minhash
from nephos.llm.common import table


def brute(rows, words, percent):
    """Components by comparing every pair that shares a shingle."""
    sets = {}
    for key, text in rows:
        found = bytes(text or "", "utf-8").lower().split()
        runs = {tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1))} if found else set()
        sets[key] = runs
    holders, parent = defaultdict(list), {k: k for k in sets}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for key, runs in sets.items():
        for run in runs:
            holders[run].append(key)
    for a, runs in sets.items():
        near = {b for run in runs for b in holders[run] if b > a}
        for b in near:
            common = len(runs & sets[b])
            if 100 * common >= percent * (len(runs) + len(sets[b]) - common):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), root(k), root(k) == k) for k in sets}


def result(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()}


def test_against_brute_force(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert result(minhash.groups(docs)) == brute(rows, 4, 80)


def test_large_group_of_near_copies(spark):
    draw = random.Random(5)
    base = [f"w{draw.randrange(500)}" for _ in range(120)]
    rows = []
    for i in range(150):
        own = list(base)
        for _ in range(draw.randrange(4)):
            own[draw.randrange(len(own))] = f"x{i}"
        rows.append((i, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(minhash.groups(df)) == brute(rows, 4, 80)


def test_group_that_only_its_base_holds_together(spark):
    draw = random.Random(11)
    base = [f"w{draw.randrange(900)}" for _ in range(150)]
    rows = [(500, " ".join(base))]
    for i in range(60):
        own = list(base)
        for _ in range(4):
            own[draw.randrange(len(own))] = f"x{i}"
        rows.append((i, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(minhash.groups(df)) == brute(rows, 4, 80)


def test_odd_sketch_never_overstates():
    draw = random.Random(2)
    for _ in range(50):
        a = minhash.shingles(" ".join(str(draw.randrange(300)) for _ in range(400)), 1)
        b = minhash.shingles(" ".join(str(draw.randrange(300)) for _ in range(draw.randrange(1, 400))), 1)
        x = minhash.odd_sketch(a).view("u1") ^ minhash.odd_sketch(b).view("u1")
        assert sum(int(v).bit_count() for v in x) <= len(set(a.tolist()) ^ set(b.tolist()))


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a b"), (5, "A  B"), (6, "é"), (7, "É"), (8, "x " * 50_000), (9, "X " * 40_000), (10, "\xa0"), (None, "a b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS n")
    got = result(minhash.groups(df))
    assert got.pop(None) == (0, None, True)
    assert got == brute(rows[:-1], 4, 80)
    assert minhash.groups(df.where("doc_id > 99")).count() == 0
    assert sorted(r["doc_id"] or 0 for r in minhash.deduplicated(df).collect()) == [0, 1, 2, 3, 4, 6, 7, 8, 10]
