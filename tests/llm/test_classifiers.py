import zlib

import numpy as np
import pytest

from nephos.llm import language, toxicity
from nephos.llm.common import table

SF = "/root/testdata/sf0.01"


def out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def test_languages_of_held_out_rows(spark):
    docs = table(spark, SF, "documents")
    true = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    got = language.digest(docs).collect()
    assert len(got) == len(true) and all(r["held_out"] == out(r["doc_id"]) and 0 <= r["score"] <= 1 for r in got)
    held = [r["lang_pred"] == true[r["doc_id"]] for r in got if r["held_out"]]
    assert np.mean(held) > 0.97


def greedy(text, known):
    """Phrases by the longest match in known, from scratch."""
    n = at = 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in known:
            size += 1
        at += size
        n += 1
    return n


def test_phrases_against_brute_force():
    texts = {"a": " the cat sat on the mat with that hat ", "b": " le chat est sur la table avec ce chapeau "}
    model = language.Model(texts)
    sample = "the table sat on le chat with that chapeau zzz"
    coded = model.encoded(sample, model.classes())
    costs = model.costs_of([coded])[0]
    plain = "".join(c if c != "z" else "\0" for c in sample)
    expected = [greedy(plain, texts[x]) * np.log2(len(texts[x])) for x in ("a", "b")]
    assert costs == pytest.approx(expected)


@pytest.mark.parametrize(("block", "side"), [(1024, 4096), (64, 5), (7, 3), (1, 2)])
def test_phrases_go_on_across_blocks(monkeypatch, block, side):
    draw = np.random.default_rng(0)
    texts = {"a": " " + "the cat sat on the mat " * 150, "b": " " + " ".join("".join(draw.choice(list("abcdefgh"), 4)) for _ in range(700)) + " ", "c": " le chat est sur la table "}
    model = language.Model(texts)
    asked = ["the cat sat on the mat " * 200, texts["b"][200:2900] + "zzz " + texts["b"][10:900], "the cat " * 400 + "le chat" * 200, "", "a"]
    asked = [" ".join(t.split()) for t in asked]
    want = [[greedy("".join(c if c in model.symbol or c == " " else "\0" for c in t), texts[x]) * np.log2(len(texts[x])) for x in model.langs] for t in asked]
    monkeypatch.setattr(language, "BLOCK", block)
    monkeypatch.setattr(language, "SIDE_BY_SIDE", side)
    table = model.classes()
    assert model.costs_of([model.encoded(t, table) for t in asked]) == pytest.approx(np.array(want))


def test_languages_of_many_letters(spark):
    draw = np.random.default_rng(3)
    made = {}
    for lang, start, n in (("zh", 0x4E00, 3000), ("ko", 0xAC00, 2000), ("el", 0x3B1, 17), ("ext", 0x30000, 900)):
        words = ["".join(chr(start + int(c)) for c in draw.integers(n, size=2)) for _ in range(1500)]
        made[lang] = [" ".join(draw.choice(words, 12)) for _ in range(400)]
    learned = {k: " " + " ".join(v[:300]) + " " for k, v in made.items()}
    model = language.Model(learned)
    assert len(model.symbol) > 4000
    for lang in made:
        coded = model.encoded(made[lang][350], model.classes())
        plain = "".join(c if c in model.symbol or c == " " else "\0" for c in made[lang][350])
        assert model.costs_of([coded])[0] == pytest.approx([greedy(plain, learned[x]) * np.log2(len(learned[x])) for x in model.langs])
    rows = [(i, k, t) for k, v in made.items() for i, t in enumerate(v[300:])]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = language.identify(df, language.train(spark.createDataFrame([(k, t) for k, v in made.items() for t in v[:300]], "lang string, text string"))).collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in got]) > 0.97


def test_copies_and_stray_languages_in_training(spark, monkeypatch):
    words = {"en": "the of and water house which never under", "fr": "le chat avec maison jamais sous quelle nous", "pl": "nie jest gdzie dom woda pod nigdy kiedy"}
    draw = np.random.default_rng(4)
    texts = {k: [" ".join(draw.choice(w.split(), 60)) for _ in range(600)] for k, w in words.items()}
    rows = [("en", t) for t in texts["en"]] + [("fr", texts["fr"][0])] * 20_000 + [("pl", t) for t in texts["pl"]] + [("pl", t) for t in texts["pl"][:3] for _ in range(2000)]
    rows += [("zz", "ab"), ("yy", "123"), (None, "le chat"), ("en", None)]
    model = language.train(spark.createDataFrame(rows, "lang string, text string").repartition(4))
    assert model.langs == ["en", "fr", "pl", "zz"]
    size = dict(zip(model.langs, model.costs, strict=True))
    assert size["en"] == size["pl"] == np.log2(language.SAMPLE_LETTERS) and size["fr"] == size["zz"] == np.log2(language.LEAST_LETTERS)
    asked = [(k, t) for k, v in texts.items() for t in v[500:]]
    got = model.predict([t for _, t in asked], model.classes())
    assert np.mean([a[0] == g[0] for a, g in zip(asked, got, strict=True)]) > 0.97
    monkeypatch.setattr(language, "SAMPLE_ROWS", 50)
    some = [(k, f"{chr(97 + i // 676)}{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}") for k, n in (("en", 500), ("fr", 60), ("pl", 7)) for i in range(n)]
    small = language.train(spark.createDataFrame(some + some[:1] * 3000, "lang string, text string"))
    assert small.langs == ["en", "fr", "pl"] and small.learned == {"en": 50, "fr": 50, "pl": 7}
    assert language.train(spark.createDataFrame([("en", "1"), ("fr", "2")], "lang string, text string")).langs == []


def test_language_edges(spark):
    model = language.Model({"en": " the cat and the dog " * 20, "fr": " le chat et le chien " * 20})
    rows = [(1, None), (2, ""), (3, "12 !! 3"), (4, "the dog"), (5, "le chien"), (6, "the cat " * 40_000), (7, "日本")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS lang_pred", "'y' AS lang", "1 AS _made", "2 AS Score")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(df, model).collect()}
    assert [got[i] for i in (1, 2, 3)] == [("und", 0.0)] * 3
    assert [got[i][0] for i in (4, 5, 6)] == ["en", "fr", "en"] and got[7][0] in ("en", "fr")
    assert language.digest(df.where("doc_id > 99").withColumn("source", df.lang)).count() == 0


def test_toxicity_of_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    toxic = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    got = [r for r in toxicity.digest(docs, labels).collect() if r["held_out"] and r["doc_id"] in toxic]
    hit = [r["predicted"] for r in got if toxic[r["doc_id"]] == 1]
    wrong = [r["predicted"] for r in got if toxic[r["doc_id"]] == 0]
    assert np.mean(hit) > 0.6 and np.mean(wrong) < 0.02


def test_toxicity_edges(spark):
    model = toxicity.fit(["you are a foul worm today " + str(i) for i in range(20)] + ["a fine day by the sea " + str(i) for i in range(20)], [1] * 20 + [0] * 20)
    rows = [(1, None), (2, ""), (3, "foul worm " * 30_000), (4, "a fine day by the sea"), (5, "you are a foul worm")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'old' AS score")
    got = {r["doc_id"]: (r["score"], r["predicted"]) for r in toxicity.scores(df, model).collect()}
    assert got[1] == got[2] and got[4][1] == 0 and got[5][1] == 1 and all((s >= 0.7) == bool(p) for s, p in got.values())
    assert toxicity.fit([], []).score("x") == 0.5
    empty = df.where("doc_id > 9").select("doc_id", "text")
    assert toxicity.digest(empty, spark.createDataFrame([], "doc_id long, toxic int")).count() == 0


def test_toxicity_learns_from_the_end_of_long_texts(spark):
    draw = np.random.default_rng(6)
    words = np.array("day sea fine walk house tree river stone bread light".split())
    clean = [" ".join(draw.choice(words, 2500)) for _ in range(60)]
    rows = [(i, t + (" you foul worm" * 5 if i % 2 else "")) for i, t in enumerate(clean)]
    assert min(len(t) for t in clean) > 8000
    model = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int"))
    assert model.score(clean[0] + " you foul worm" * 5) >= 0.7 > model.score(clean[1])


def test_language_learns_past_a_shared_header(spark):
    words = {"en": "the of and water house which never under", "fr": "le chat avec maison jamais sous quelle nous"}
    draw = np.random.default_rng(8)
    texts = {k: [" ".join(draw.choice(w.split(), 300)) for _ in range(60)] for k, w in words.items()}
    header = "licence notice all rights reserved " * 20
    model = language.train(spark.createDataFrame([(k, header + t) for k, v in texts.items() for t in v[:40]], "lang string, text string"))
    asked = [(k, t) for k, v in texts.items() for t in v[40:]]
    got = model.predict([t for _, t in asked], model.classes())
    assert all(a[0] == g[0] for a, g in zip(asked, got, strict=True))
