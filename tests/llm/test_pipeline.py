from hashlib import sha256

import corpus_pipeline
from nephos.llm import bpe, language, mixing, secrets
from nephos.llm.common import table
from tests.llm.test_minhash import brute

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_python(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        out = stage(spark, docs, SF)
        after = {r["doc_id"]: r for r in out.collect()}
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns
        if stage is corpus_pipeline.identify_language:
            assert after.keys() == {k for k, r in before.items() if any(c.isalpha() for c in r["text"] or "")}
        elif stage is corpus_pipeline.remove_near_duplicates:
            kept = brute([(k, r["text"]) for k, r in before.items()], 5, 80)
            assert after.keys() == {k for k, v in kept.items() if v[2]} and all(after[k] == before[k] for k in after)
        elif stage is corpus_pipeline.redact_secrets:
            assert {k: r["text"] for k, r in after.items()} == {k: secrets.redacted(r["text"]) for k, r in before.items()}
        elif stage is corpus_pipeline.mix_sources:
            chance = {r["doc_id"]: r["probability"] for r in mixing.digest(docs).collect()}
            sampled = {r["doc_id"] for r in mixing.digest(docs).collect() if r["sampled"]}
            assert after.keys() == sampled and abs(sum(chance.values()) - len(sampled)) < 5 * len(before) ** 0.5
        else:
            words = bpe.vocabulary(bpe.standard_path())
            assert {k: r["ids"] for k, r in after.items()} == {k: words.encode(r["text"]) for k, r in before.items()}
        docs = spark.createDataFrame(list(after.values()), out.schema)


def test_run_gives_the_last_stage(spark):
    rows = corpus_pipeline.run(spark, SF)
    got = rows.collect()
    assert rows.columns == ["doc_id", "lang", "source", "n_chars", "n_tokens", "ids"]
    assert got and all(r["n_tokens"] == len(r["ids"]) and r["lang"] != language.UNDETERMINED for r in got)
    assert len({sha256(str(r["ids"]).encode()).digest() for r in got}) > 1
