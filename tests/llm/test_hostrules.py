import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hitloom.llm import hostrules as H


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = Counter(windows)
    covered = {i + d for i, w in enumerate(windows) if twice[w] > 1 for d in range(5)}
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(covered)]


@given(st.text("ab #\n\té", max_size=120))
def test_counts(text):
    assert H.Counter()(text) == brute(text)


def test_as_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    assert sorted(tuple(r) for r in H.op6_quality_rules(spark, sf_dir).collect()) == sorted(con.sql(H.ORACLE).fetchall())


def prior(counts):
    """Of hosts given as (documents, failures)."""
    n, k = zip(*counts, strict=True)
    return H.beta_prior(len(n), sum(n), float(sum(v * v for v in n)), sum(k), sum(b * b / a for a, b in counts))


def test_prior_recovers_beta():
    rng = np.random.default_rng(3)
    rates = rng.beta(2.0, 8.0, 4000)
    for sizes in (np.full(4000, 40), rng.integers(1, 12, 4000)):
        a, b = prior(list(zip(sizes.tolist(), rng.binomial(sizes, rates).tolist(), strict=True)))
        assert a / (a + b) == pytest.approx(0.2, rel=0.05) and a + b == pytest.approx(10, rel=0.25)


def test_prior_of_little():
    """Hosts of one document tell nothing of how hosts differ: a failure does not condemn its host."""
    a, b = prior([(1, int(i % 10 == 0)) for i in range(1000)])
    assert (1 + a) / (1 + a + b) < 0.25
    assert prior([(50, 5)] * 200) == pytest.approx((0.1 * H.MOST_DOCS, 0.9 * H.MOST_DOCS))
    assert H.beta_prior(0, 0, 0.0, 0, 0.0) == prior([(5, 0), (7, 0)]) == (0.0, H.FEW_DOCS)
    assert prior([(9, 4)]) == pytest.approx((4 / 9 * H.FEW_DOCS, 5 / 9 * H.FEW_DOCS))


def test_columns(spark, sf_dir):
    assert H.op6_quality_rules(spark, sf_dir).columns[:8] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def test_small_hosts(spark):
    """Hosts of one document, one in ten with a failing one, stay; a large host that fails goes."""
    good = " ".join(f"word{i}" for i in range(30))
    rows = [(i, ("# " * 40 if i % 10 == 0 else "") + good, f"h{i}") for i in range(500)]
    docs = spark.createDataFrame(rows + [(1000 + i, "# " * 40 + good, "bad") for i in range(300)], "doc_id long, text string, source string")
    got = {r.doc_id: r.host_ok for r in H.apply_rules(docs).collect()}
    assert not got[1000] and all(got[i] for i in range(500) if i % 10)


def test_host_verdict_reaches_documents(spark):
    good = " ".join(f"word{i}" for i in range(30))
    rows = [(i, good, f"h{i % 9}") for i in range(900)]
    rows += [(1000 + i, "# " * 40 + good, "bad") for i in range(90)] + [(1100 + i, good, "bad") for i in range(5)]
    rows += [(2000, "# " * 40 + good, "one"), (2001, None, None), (2002, "", None), (2003, good, None), (2003, good, None), (2004, "x y " * 30_000, "h1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("host", F.lit(1)).withColumn("n_words", F.lit("x"))
    got = {r.doc_id: r for r in H.apply_rules(docs).collect()}
    assert H.apply_rules(docs).count() == len(rows)
    assert not any(got[1100 + i].kept for i in range(5)) and all(got[i].kept for i in range(900))
    assert got[2003].kept and not got[2001].kept and not got[2002].kept and got[2004].base_failed
    assert H.apply_rules(docs.limit(0)).count() == 0
