import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hitloom.llm import bpe
from hitloom.llm import common as C

PATH = bpe.word_bpe_path()
LIB = Tokenizer.from_file(PATH)
CASES = [
    "", " ", "Hello, World! it's 12 o'clock", "ΟΔΟΣ ΣΑΣ", "İstanbul STRASSE ß", "été  x y", "a<|endoftext|>b <|startoftext|>",
    "x" * 3000, "ab" * 500 + "!" * 700, "日本語テキスト 🎉🎉 \x1c\x1d a", "don't we'LL I'M you'Re", "\n\n\t tab\x0b\x0c", "١٢٣ ½", "<|endoftext|", "a\x85b c",
]


def lib(text):
    ids = LIB.encode(text, add_special_tokens=False).ids
    return ids, LIB.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", CASES)
def test_as_library(text):
    t = bpe.tokenizer(PATH)
    raw = t.encode(text)
    assert (np.frombuffer(raw, "<u4").tolist(), t.decode(raw)) == lib(text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs", "Cn"]), max_size=60))
def test_any_text(text):
    raw = bpe.tokenizer(PATH).encode(text)
    assert np.frombuffer(raw, "<u4").tolist() == lib(text)[0]


@given(st.text("ab cdeth", min_size=1, max_size=200))
def test_long_words_merge_alike(text):
    t = bpe.tokenizer(PATH)
    word = text.replace(" ", "") or "a"
    ids = [t.vocab[c] for c in word[:-1]] + [t.vocab[word[-1] + "</w>"]]
    assert t._merge(list(ids)) == t._merge_long(list(ids))


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: r for r in bpe.op1_bpe(spark, sf_dir).collect()}
    for r in docs.collect():
        ids, text = lib(r.text or "")
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_edges(spark):
    rows = [(1, None, "x"), (None, "a b", "x"), (2, "", None), (2, "", None), (3, "w" * 200_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").withColumn("n_tokens", F.lit(7))
    out = bpe.encode(docs, PATH)
    assert out.count() == 5
    assert bpe.decode(out, PATH).count() == 5
    assert bpe.digests(docs, PATH).where("doc_id = 2").count() == 2
    assert bpe.digests(docs.limit(0), PATH).count() == 0


def test_memory_of_recent_words():
    """Long words are not kept, and short ones only up to the bound."""
    kept = C.Recent(len)
    assert sum(kept[f"{i:010d}" * 1000] for i in range(200_000)) == 2_000_000_000 and not kept and not kept.old
    kept = C.Recent(len, 100_000)
    for i in range(5000):
        assert kept[f"{i:0100d}"] == 100
    assert (len(kept) + len(kept.old)) * (100 + C.Recent.EACH) <= 2 * (100_000 + 300) and kept[f"{4999:0100d}"] == 100
