import hashlib
import random
import struct
import unicodedata
from functools import cache

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from nephos.llm import bpe
from nephos.llm.common import table


@pytest.fixture(scope="module")
def library():
    found = Tokenizer.from_file(bpe.standard_path())
    found.no_truncation()
    found.no_padding()
    return found


def test_whole_table(spark, library):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    got = bpe.digest(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@cache
def loaded():
    return Tokenizer.from_file(bpe.standard_path())


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="abehinorst'<|>endoftx ΣÉ\t", max_size=60))
def test_any_text(text):
    # Characters that Python's Unicode data do not know have no defined class.
    if any(unicodedata.category(c) in ("Cs", "Cn") for c in text):
        return
    library = loaded()
    words = bpe.vocabulary(bpe.standard_path())
    ids = library.encode(text, add_special_tokens=False).ids
    assert words.encode(text) == ids and words.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_long_words_and_special_tokens(library):
    draw = random.Random(3)
    words = bpe.vocabulary(bpe.standard_path())
    for text in ("ha" * 5000, "!" * 999, "".join(draw.choices("abcdefghij", k=20_000)), "a<|endoftext|>b <|startoftext|>", "I'LL we'Re don'T"):
        assert words.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "  \n"), (4, "word"), (4, "word")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS n_tokens", "1 AS _made")
    got = bpe.decode(bpe.encode(df)).collect()
    assert [len(r["ids"]) for r in got] == [0, 0, 0, 1, 1] and got[3]["decoded"] == "word</w>"
    assert sorted(r["n_tokens"] for r in bpe.digests(df).collect()) == [0, 0, 0, 1, 1]
    assert [r["_made"] for r in bpe.digests(df).collect()] == [1] * 5
    assert bpe.encode(df.where("doc_id > 9")).count() == 0
