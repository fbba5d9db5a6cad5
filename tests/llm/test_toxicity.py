import functools
import math
from collections import Counter

import numpy as np
import pytest
import regex
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hitloom.llm import toxicity as T
from hitloom.llm.common import held_out


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


LEXICON = {"abcab": 1.0, "abcde": 2.0, "bbbbb": 3.0, "abc": 4.0, "acacac": 5.0}
TRIE = T.FuzzyTrie(LEXICON, {"cccc": 6.0})


@given(st.text("abcde", max_size=8))
def test_automaton_is_levenshtein(word):
    exact = max([LEXICON.get(word, 0.0), 6.0 * (word[:4] == "cccc")])
    near = max([w for t, w in LEXICON.items() if len(t) >= T.FUZZY_FROM and distance(t, word) == 1], default=0.0)
    assert TRIE.match(word) == (exact, 0.0 if exact else near)


@given(st.lists(st.text("abc", min_size=1, max_size=7), max_size=6), st.text("abcd", max_size=8))
def test_any_lexicon(terms, word):
    lexicon = {t: float(i + 1) for i, t in enumerate(terms)}
    got = T.FuzzyTrie(lexicon, {}).match(word)
    near = max([w for t, w in lexicon.items() if len(t) >= T.FUZZY_FROM and distance(t, word) == 1], default=0.0)
    assert got == (lexicon.get(word, 0.0), 0.0 if word in lexicon else near)


def corpus(n=400):
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        words = [f"{'abcdefghij'[(i * 7 + k * 3) % 10]}word{'klmnop'[(i + k) % 6]}" for k in range(20)]
        if bad:
            words[5] = words[11] = ("gruffle", "snorkel", "blatherskite")[i // 4 % 3]
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return rows, labels


def test_misspelling_and_quotation(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x"))
    marks = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    model = T.fit(docs, marks)
    assert {"gruffle", "snorkel", "blatherskite"} <= set(model.words)
    s = T.Scorer(model)
    assert s.score("you are a gruffle and nothing else") > 0.5
    assert s.features("such a gruffle")[1] == 0 and s.features("such a griffle")[1] > 0
    assert s.score("they used the term gruffle in the report") < s.score("go away gruffle in the report")
    assert s.score('it reads "gruffle" on page two') < s.score("it reads gruffle on page two")
    more = [(None, "gruffle gruffle"), (9000, None), (9001, ""), (9002, "aword " * 40_000), (9002, "aword " * 40_000)]
    odd = spark.createDataFrame(more, "doc_id long, text string")
    got = T.score(odd, model).collect()
    assert len(got) == 5 and [r.predicted for r in got if r.doc_id is None] == [1] and all(r.predicted == 0 for r in got if r.doc_id)
    assert T.score(odd.limit(0), model).count() == 0
    assert T.fit(docs, marks.limit(0)).words == {}


def test_signs_inside_words():
    """A digit or sign in place of a letter is one edit; words that signs join are also read apart."""
    s = T.Scorer(T.Model({"gruffle": 5.0, "worthless": 4.0}))
    for text in ("you gruff1e", "a gr*ffle!", "gru-ffle", "gruffle-like", "(worth!ess)"):
        assert s.features(text)[0] or s.features(text)[1], text
    for text in ("gr**ffle", "gr*ff1e", "worth less things", "gruf"):
        assert not any(s.features(text)), text
    assert s.features("gruffle-like")[0] == 5.0 and s.features("gruff1e")[:2] == [0.0, 5.0]


def test_words_of_reporting_are_learned(spark):
    rows, labels = corpus()
    rows += [(1000 + i, f"some {'abcdefghij'[i % 10]} text where memokla wrtex {('gruffle', 'snorkel', 'blatherskite')[i % 3]} is told of {i}") for i in range(42)]
    labels += [(1000 + i, 0) for i in range(42)]
    model = T.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert {"memokla", "wrtex"} <= model.reporting and not {"bwordk", "gruffle"} & model.reporting
    s = T.Scorer(model)
    assert s.features("when memokla wrtex gruffle came")[0] == pytest.approx(T.QUOTED * s.features("when they just gruffle came")[0])
    again = T.fit(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert again.words == model.words and again.reporting == model.reporting and np.allclose(again.weights, model.weights)


def test_candidates_by_join(spark, monkeypatch):
    rows, labels = corpus()
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    one = T.fit(docs, marks)
    monkeypatch.setattr(T, "BROADCAST_TERMS", 1)
    monkeypatch.setattr(T, "BROADCAST_LABELS", 1)
    two = T.fit(docs, marks)
    assert one.words == two.words and one.stems == two.stems and np.allclose(one.weights, two.weights)


def test_lexicon_by_counting(spark, sf_dir):
    """Terms and odds of the whole training table by plain counting."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = T.fit(docs.where(~held_out()), labels.where(~held_out()))
    marks = {r.doc_id: r.toxic for r in labels.where(~held_out()).collect()}
    n, total = {0: Counter(), 1: Counter()}, Counter()
    for r in docs.where(~held_out()).collect():
        if r.doc_id in marks:
            words = set(regex.findall(r"[\p{L}\p{M}]+", (r.text or "").lower()))
            n[marks[r.doc_id]].update({"=" + w for w in words if len(w) > 2} | {"^" + w[:k] for w in words for k in (4, 5, 6, 7) if len(w) > k})
            total[marks[r.doc_id]] += 1
    want = {}
    for term, a in n[1].items():
        odds = math.log((a + 0.5) / (total[1] - a + 0.5)) - math.log((n[0][term] + 0.5) / (total[0] - n[0][term] + 0.5))
        if a >= max(T.LEAST_DOCS, T.LEAST_SHARE * total[1]) and odds >= T.LEAST_ODDS:
            want[term] = odds
    got = {"=" + k: v for k, v in model.words.items()} | {"^" + k: v for k, v in model.stems.items()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-5) for k in want)


def test_scores_by_edit_distance(spark, sf_dir):
    """The query's rows by quadratic edit distance of every token to every term, in plain Python."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = T.fit(docs.where(~held_out()), labels.where(~held_out()))
    got = {r.doc_id: r for r in T.op5_toxicity(spark, sf_dir).collect()}

    def word(w):
        exact = max([model.words.get(w, 0.0), *(v for k, v in model.stems.items() if w.startswith(k))])
        near = [v for k, v in model.words.items() if len(k) >= T.FUZZY_FROM and abs(len(k) - len(w)) <= 1 and k != w and distance(k, w) == 1]
        return exact, 0.0 if exact else max(near, default=0.0)

    @functools.cache
    def token(t):
        parts = regex.findall(r"[\p{L}\p{M}]+", t)
        both = [word(p) for p in parts] + ([(0.0, word(t)[1])] if len(parts) == 2 else [])
        return max(a for a, _ in both), max(b for _, b in both)

    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        low = (r.text or "").lower()
        spans = [(m.start(), m.end(), m[0]) for m in regex.finditer(r"[\p{L}\p{M}]+(?:[^\p{L}\p{M}\s][\p{L}\p{M}]+)*", low)]
        best = fuzzy = total = told = 0.0
        for i, (start, end, t) in enumerate(spans):
            exact, near = token(t)
            if not exact and not near:
                continue
            before, after = spans[max(0, i - 8) : i], spans[i + 1 : i + 9]
            left = low[before[0][0] if before else start : start]
            right = low[end : (after[-1] if after else spans[i])[1] + 2]
            inside = sum(c in T.MARKS for c in left) % 2 == 1 and any(c in T.MARKS for c in right)
            factor = 0.35 if inside or any(w in model.reporting for _, _, w in before) else 1.0
            told = max(told, exact, near) if factor < 1 else told
            best, fuzzy, total = max(best, factor * exact), max(fuzzy, factor * near), total + factor * (exact + near / 2)
        z = model.bias + sum(a * b for a, b in zip([best, fuzzy, math.log1p(total), total / (10 + len(spans)), told], model.weights, strict=True))
        want = 1 / (1 + math.exp(-max(-30, min(30, z))))
        assert got[r.doc_id].score == pytest.approx(want, abs=1e-9) and got[r.doc_id].predicted == (want >= 0.5), r.doc_id


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = T.op5_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    bad, good = got[got.toxic == 1], got[got.toxic == 0]
    assert bad.predicted.mean() > 0.85 and good.predicted.mean() < 0.01
    auc = (bad.score.to_numpy()[:, None] > good.score.to_numpy()[None]).mean() + 0.5 * (bad.score.to_numpy()[:, None] == good.score.to_numpy()[None]).mean()
    assert auc > 0.95
    print(bad.predicted.mean(), good.predicted.mean(), auc, len(bad), len(good))
    assert got.score.between(0, 1).all()


@pytest.mark.parametrize("text", [None, "", "12 %%"])
def test_without_words(text):
    assert 0 < T.Scorer(T.Model()).score(text) < 0.5
