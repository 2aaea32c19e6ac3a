"""Queries on whole tables against plain Python that shares no kernel with them."""

import math
import struct
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from nephos.llm import language, minhash, secrets, sharding, toxicity
from nephos.llm.common import table
from tests.llm.test_classifiers import greedy
from tests.llm.test_exact_sharding_secrets_mixing import jump_slowly, slow_base

SF = "/root/testdata/sf0.001"


def test_languages_phrase_for_phrase(spark, monkeypatch):
    learned = {}
    kept = language.Model.__init__

    def keep(self, texts, least=None):
        learned.update(texts)
        kept(self, texts, least)

    monkeypatch.setattr(language.Model, "__init__", keep)
    docs = table(spark, SF, "documents")
    got = {r["doc_id"]: r for r in language.digest(docs).collect()}
    letters = {k: {c for c in t if c.isalpha()} for k, t in learned.items()}
    every = set().union(*letters.values())
    cost = {k: math.log2(max(2, language.LEAST_LETTERS, len(t))) for k, t in learned.items()}
    for r in docs.collect():
        plain = " ".join("".join(c if c.isalpha() else " " for c in language.folded(r["text"] or "")).split(" "))
        plain = " ".join(plain.split()) + (" " if plain.endswith(" ") and plain.strip() else "")
        if not any(c.isalpha() for c in plain):
            assert got[r["doc_id"]]["lang_pred"] == "und"
            continue
        bits = {}
        for k, known in learned.items():
            strange = sum(c.isalpha() and c not in letters[k] for c in plain)
            text = "".join(c if c == " " or c in every else "\0" for c in plain)
            bits[k] = greedy(text, known) * cost[k] + strange * (max(cost.values()) - cost[k])
        best = sorted(bits, key=lambda k: (bits[k], k))
        gap = min(bits[best[1]] - bits[best[0]], 60.0)
        assert got[r["doc_id"]]["lang_pred"] == best[0] and got[r["doc_id"]]["score"] == pytest.approx(1 / (1 + 2.0**-gap))
        assert got[r["doc_id"]]["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)


def test_toxicity_scores_feature_by_feature(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = toxicity.train(docs.select("doc_id", "text"), labels.where(~language.held_out()).select("doc_id", "toxic"))
    odd = [int(x) for x in toxicity._ODD]

    def place(gram):
        mixed = len(gram) * 0x9E3779B1 & 0xFFFFFFFF
        for c, m in zip(gram, odd, strict=False):
            mixed = (mixed ^ ord(c)) * m & 0xFFFFFFFF
            mixed ^= mixed >> 15
        return mixed >> 32 - toxicity.BITS

    for r in toxicity.scores(docs, model).collect():
        text = " " + " ".join((r["text"] or "").lower().split()) + " "
        grams = {text[i : i + n] for n in toxicity.ORDERS for i in range(len(text) - n + 1)}
        logit = model.bias + sum(float(model.weight[p]) for p in {place(g) for g in grams})
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-max(-40, min(40, logit)))), abs=1e-6) and r["predicted"] == (r["score"] >= 0.7)


def test_shards_row_by_row(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    slots = {}
    for r in sharding.digest(docs).collect():
        key = xxhash.xxh64_intdigest(struct.pack("<q", r["doc_id"]), seed=42)
        assert (r["shard"], r["grown_shard"]) == (jump_slowly(key, 16), jump_slowly(key, 17)) and r["law"] == "key"
        assert (r["size"], r["text_crc32"]) == (len(texts[r["doc_id"]]) + 1, zlib.crc32(texts[r["doc_id"]]))
        slots.setdefault(r["shard"], set()).add(r["slot"])
    assert all(s == set(range(len(s))) for s in slots.values())


def test_all_secret_spans(spark):
    """The fixed spans stay, those by name add to them and lie outside of all of them."""
    for r in secrets.scan(table(spark, "/root/testdata/sf0.01", "documents")).collect():
        text = r["text"] or ""
        base = {(s["start"], s["end"], s["kind"]) for s in r["secrets"] if s["kind"] != "named"}
        assert base == set(slow_base(text))
        for s in r["secrets"]:
            if s["kind"] == "named":
                assert s["end"] > s["start"] and not any(a <= s["start"] and s["end"] <= b for a, b, _ in base)


def test_minhash_recall_near_the_threshold(spark):
    """Pairs at likeness 0.80 to 0.83: at least 0.99 of them are linked, and none below 0.8."""
    draw = np.random.default_rng(21)
    rows, want, below = [], [], []
    for i in range(600):
        n = 400
        first = [f"w{i}x{k}" for k in range(n)]
        second = list(first)
        for k in draw.choice(np.arange(10, n - 10), size=int(draw.integers(8, 13)), replace=False):
            second[k] = f"v{i}x{k}"
        a, b = ({tuple(t[k : k + 4]) for k in range(n - 3)} for t in (first, second))
        like = len(a & b) / len(a | b)
        rows += [(2 * i, " ".join(first)), (2 * i + 1, " ".join(second))]
        (want if like >= 0.8 else below).append(i)
    got = {r["doc_id"]: r["component_id"] for r in minhash.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(want) > 50 and len(below) > 50
    assert sum(got[2 * i] == got[2 * i + 1] for i in want) >= 0.99 * len(want) and all(got[2 * i] != got[2 * i + 1] for i in below)


CLASH = ["_made", "_gone", "_source", "_lang", "_topic", "_weight", "_probability", "id", "n", "row", "key", "weight", "h", "lang_pred"]


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_rows(spark, stage):
    """Null and empty texts and keys, repeated rows, very long texts, and columns of any name; a stage drops what it is to drop only."""
    rows = [(1, None, None, None, 0), (2, "", "en", "s", 0), (None, "the cat sat on the mat by the door of the house", "en", "s", 47), (3, "12 !!", "fr", None, 5), (3, "12 !!", "fr", None, 5)]
    rows += [(10 + i, f"the cat number {i} sat with the dog on a mat of the house and the moon was white", "en", "s", 80) for i in range(30)] + [(50, "a long text of many words here " * 30_000, "en", "t", 930_000)]
    rows += [(60 + i, f"le chat numero {i} dort sur la table avec le chien de la maison blanche", "fr", "t", 70) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", *[f"{i} AS {c}" for i, c in enumerate(CLASH)])
    out = stage(spark, docs, SF)
    kept = out.collect()
    last = stage is corpus_pipeline.STAGES[-1][1]
    if not last:
        assert out.columns == docs.columns and all(r[c] == i for r in kept for i, c in enumerate(CLASH))
    if stage is corpus_pipeline.identify_language:
        assert {r["doc_id"] for r in kept} == {None, *range(10, 40), 50, *range(60, 90)}
    elif stage is corpus_pipeline.remove_near_duplicates or stage is corpus_pipeline.redact_secrets:
        assert len(kept) == len(rows)
    elif last:
        assert len(kept) == len(rows) and all((r["n_tokens"] == 0) == (r["doc_id"] in (1, 2)) for r in kept)
    assert stage(spark, docs.where(F.lit(False)), SF).count() == 0
