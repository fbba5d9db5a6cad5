import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hitloom.llm import ordinal as O
from hitloom.llm.common import held_out


def test_four_grades_recovered():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 6)).astype(np.float32)
    true = np.array([1.5, -2.0, 0.5, 0, 0, 1.0])
    cuts = np.array([-1.0, 0.3, 2.0])
    y = ((x @ true + rng.logistic(size=4000))[:, None] > cuts).sum(axis=1)
    w, t = O.fit_ordinal(x, y, 4, steps=400, rate=0.05)
    assert np.all(np.diff(t) > 0)
    assert np.abs(w - true).max() < 0.2 and np.abs(t - cuts).max() < 0.2


def test_whole_runs_and_lengths_count():
    hasher = O.Hasher()
    different = lambda a, b: set(hasher(a)[0]) != set(hasher(b)[0])
    assert different("!!!!!!!! a", "!!!!!!!!@@@@ a")
    assert different("w " * 5000, "w " * 100_000)


def test_as_dense_formula(spark, sf_dir):
    """The query's rows from the fitted weights, each text's features counted afresh and summed in plain Python."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = O.fit(docs.where(~held_out()), labels.where(~held_out()))
    got = {r.doc_id: r for r in O.op7_quality_grade(spark, sf_dir).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        words, lines = (r.text or "").split(), [x for x in (r.text or "").split("\n") if x.strip()]
        n = Counter()
        for part in re.findall(r"\w+|[^\w\s]+", r.text or ""):
            if re.match(r"\w", part):
                shape = "digit" if part.isdigit() else "upper" if len(part) > 1 and part.isupper() else "title" if part[0].isupper() else "lower"
                n.update([O._bucket("w" + part.lower()), O._bucket("s" + shape)])
            else:
                n[O._bucket("m" + part)] += 1
        n[O._bucket("repeat")] += sum(a == b for a, b in zip(words, words[1:], strict=False))
        n[O._bucket("line again")] += 5 * (len(lines) - len(set(lines)))
        n[O._bucket(f"length {len(words).bit_length()}")] += 1
        z = sum(model.weights[k] * math.sqrt(v) for k, v in n.items()) / math.sqrt(sum(n.values()))
        tails = [1 / (1 + math.exp(t - z)) for t in model.cuts]
        want = model.grades[0] + sum(p * (b - a) for p, a, b in zip(tails, model.grades, model.grades[1:], strict=False))
        assert got[r.doc_id].expected_grade == pytest.approx(want, abs=1e-5) and got[r.doc_id].tail == pytest.approx(tails[-1], abs=1e-5)
        assert got[r.doc_id].kept == (got[r.doc_id].tail >= 0.5)


def test_fit_takes_equal_rows_once(spark):
    rows = [(i % 7, f"{'good' if i % 2 else '###'} text {i % 14}") for i in range(280)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(7)], "doc_id long, quality int")
    one, two = O.fit(docs, marks, sample=10), O.fit(docs.repartition(5), marks, sample=10)
    assert (one.weights == two.weights).all() and (one.cuts == two.cuts).all()


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = O.op7_quality_grade(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    bad, good = got[got.quality == 0], got[got.quality == 1]
    print(len(bad), len(good), bad.kept.mean(), good.kept.mean())
    assert good.kept.mean() > 0.98 and bad.kept.mean() < 0.15


def test_cases(spark):
    rows = [(i, ("fine words in a row " if i % 3 else "%%% ### ") * (i % 3 + 1)) for i in range(120)] + [(500, None), (501, ""), (None, "words"), (502, "ab " * 60_000), (502, "ab " * 60_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("tail", F.lit("x"))
    marks = spark.createDataFrame([(i, i % 3) for i in range(120)] + [(None, 1), (7, None)], "doc_id long, quality int")
    model = O.fit(docs, marks)
    assert model.grades == [0, 1, 2] and len(model.cuts) == 2
    got = {r.doc_id: r for r in O.grade(docs, model).collect()}
    assert O.grade(docs, model).count() == len(rows)
    assert got[3].expected_grade < 0.5 < got[4].expected_grade < got[5].expected_grade
    some = {r.doc_id: r for r in O.grade(docs, model, least=1).collect()}
    assert all(some[i].tail >= got[i].tail for i in got)
    assert not O.grade(docs, O.fit(docs, marks.limit(0))).where("kept").count()
    assert O.grade(docs.limit(0), model).count() == 0
