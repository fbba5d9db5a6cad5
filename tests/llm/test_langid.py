import math
import re
import unicodedata
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hitloom.llm import langid as L
from hitloom.llm.common import held_out


def test_codes():
    for k in (2, 3, 4, 5, 9):
        c = L.code(k)
        assert set(np.unique(c)) == {-1, 1} and len({tuple(r) for r in c}) == k
    d = min(int((a != b).sum()) for i, a in enumerate(L.code(4)) for b in L.code(4)[:i])
    assert d == 4  # the exhaustive code of four classes corrects one wrong bit


def test_wrong_bit_is_corrected():
    codes = L.code(4)
    model = L.Model(list("abcd"), codes, np.zeros((L.BUCKETS, 7)), np.zeros(7), np.ones(7))
    for c in range(4):
        for bit in range(7):
            f = 3.0 * codes[c]
            f[bit] *= -1
            model.bias = f
            assert model.losses(np.zeros(L.BUCKETS)).argmin() == c


def test_as_all_codewords(spark, sf_dir):
    """The query's rows by plain Python: n-grams one by one, every codeword's weighted loss, the least of them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = L.fit(docs.where(~held_out()))
    got = {r.doc_id: r for r in L.op3_language_id(spark, sf_dir).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        letters = "".join(c if unicodedata.category(c)[0] == "L" else " " for c in r.text or "")
        plain = re.sub(" +", " ", letters).lower()
        if not plain.strip():
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
            continue
        raw, n = f" {plain} ".encode(), Counter()
        for i in range(len(raw)):
            pair = raw[i] * 257 + raw[i + 1] if i + 1 < len(raw) else None
            grams = [raw[i], pair, pair * 263 + raw[i + 2] if i + 2 < len(raw) else None]
            n.update((g * 0x9E3779B1 + k * 0x85EBCA6B) % 2**32 >> 19 for k, g in enumerate(grams) if g is not None)
        size = math.sqrt(sum(n.values()))
        bits = [sum(math.sqrt(v) / size * float(model.weights[b, k]) for b, v in n.items()) + float(model.bias[k]) for k in range(model.codes.shape[1])]
        loss = {lang: sum(t * math.log1p(math.exp(-f * c)) for f, c, t in zip(bits, word, model.trust, strict=True)) for lang, word in zip(model.labels, model.codes, strict=True)}
        best = min(loss, key=loss.get)
        assert got[r.doc_id].lang_pred == best
        assert got[r.doc_id].score == pytest.approx(1 / sum(math.exp(loss[best] - v) for v in loss.values()), abs=1e-4)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    got = L.op3_language_id(spark, "/root/testdata/sf0.01").join(docs, "doc_id").where("held_out").toPandas()
    assert len(got) > 100 and (got.lang == got.lang_pred).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_cases(spark):
    text = {"en": "the house and the garden with three trees", "de": "das haus und der garten mit drei bäumen über"}
    rows = [(i, f"{text[g]} {i}", g, g) for i in range(40) for g in text] + [(99, None, "en", "x"), (100, "", None, "x"), (101, "12 %% 3", "de", "x"), (None, "the garden", None, "x"), (102, "the house " * 30_000, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string").withColumn("held_out", F.lit(1))
    model = L.fit(docs)
    got = L.identify(docs, model).collect()
    assert len(got) == len(rows)
    assert {r.lang_pred for r in got if r.doc_id in (99, 100, 101)} == {"und"}
    assert all(r.lang_pred == "en" for r in got if r.doc_id in (None, 102))
    assert L.identify(docs, L.fit(docs.limit(0))).where("lang_pred <> 'und'").count() == 0
    assert L.identify(docs.limit(0), model).count() == 0
    kept = L.language_stage(spark, docs, "")
    assert kept.columns == docs.columns and kept.where("doc_id IN (99, 100, 101)").count() == 0 and kept.count() >= 80
    one = L.fit(docs.where("lang = 'en'"))
    assert one.predict("das haus")[0] == "en"
    assert docs.where(held_out()).where("doc_id IS NULL").count() == 0
    assert L.language_stage(spark, docs, "").where("doc_id IS NULL").count() == 1
    two = L.fit(docs.unionAll(docs).repartition(5))
    assert (two.weights == model.weights).all() and (two.trust == model.trust).all()
