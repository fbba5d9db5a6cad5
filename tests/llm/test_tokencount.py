import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.models import Unigram

from hitloom.llm import tokencount as T

PIECES = T.sentencepiece_vocabulary(T.piece_path())
BYTES = [(f"<0x{b:02X}>", 0.0) for b in range(256)]
LIB = Tokenizer(Unigram([("<unk>", 0.0), *BYTES, *PIECES.items()], 0, byte_fallback=True))
MINE = T.counter(T.piece_path())


def lib(text, model=LIB):
    return len(model.encode(T.START + text.replace(" ", T.START), add_special_tokens=False).ids) if text else 0


@pytest.mark.parametrize("text", ["Hello World", "  two  spaces ", "a\n\nb\tü 日本 😀😀 梦", "The quick brown fox", "▁▁ x ▁", "aaaaaaaaaaaaaaaa", "      ", "ΟΔΟΣ ßé", "\x00\x01"])
def test_as_library(text):
    assert MINE.count(text)[0] == lib(text)


@settings(max_examples=300, deadline=None)
@given(st.text("theaino rs. ▁é😀", max_size=60))
def test_any_text(text):
    assert MINE.count(text)[0] == lib(text)


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.text("abc", min_size=1, max_size=4), st.integers(-3, 0), min_size=1, max_size=12), st.text("abcd", min_size=1, max_size=14))
def test_ties(pieces, text):
    model = Tokenizer(Unigram([("<unk>", 0.0), *BYTES, *((p, float(s)) for p, s in pieces.items())], 0, byte_fallback=True))
    # the library's least score runs over all entries, of which the added ones are 0
    own = T.UnigramCounter({p: float(s) for p, s in pieces.items()})
    assert own._best(text)[0] == len(model.encode(text, add_special_tokens=False).ids)


def test_sums_that_are_not_exact():
    """Whole texts under vocabularies with scores in tenths, where a sum depends on what it starts from."""
    rng = random.Random(11)
    for _ in range(3000):
        letters = [T.START + "a", T.START + "b", T.START, "a", "b", "c"]
        pieces = {"".join(rng.choice(letters[3:] if k else letters) for k in range(rng.randint(1, 4))): -rng.randint(0, 40) / 10 for _ in range(rng.randint(2, 14))}
        text = "".join(rng.choice("abc ") for _ in range(rng.randint(1, 60)))
        model = Tokenizer(Unigram([("<unk>", 0.0), *BYTES, *pieces.items()], 0, byte_fallback=True))
        own = T.UnigramCounter(pieces)
        assert own.count(text)[0] == lib(text, model), (pieces, text)


def test_exact_scores_are_remembered():
    own = T.UnigramCounter({T.START + "a": -1.5, "b": -2.25, "c": -3.0})
    assert own.exact and own.count("ab ab cb")[1] == T.UnigramCounter({T.START + "a": -1.5, "b": -2.25, "c": -3.0})._best("▁ab▁ab▁cb")[1] and own.recent
    assert not T.UnigramCounter({T.START + "a": -0.1}).exact


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = {r.doc_id: r.n_tokens for r in T.op9_token_counts(spark, sf_dir).collect()}
    assert got == {r.doc_id: lib(r.text or "") for r in docs}


def test_cases(spark):
    rows = [(1, None), (2, ""), (None, "a b"), (3, "x" * 100_000), (4, "a b " * 50_000), (4, "a b " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit("x")).withColumn("score", F.lit(1))
    got = T.count_tokens(docs, T.piece_path()).collect()
    assert len(got) == 6 and {r.doc_id: r.n_tokens for r in got}[3] == lib("x" * 100_000)
    assert T.count_tokens(docs.limit(0), T.piece_path()).count() == 0
