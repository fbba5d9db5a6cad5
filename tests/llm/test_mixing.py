from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from hitloom.llm import mixing as M


def water_fill(sizes, weights, most=3):
    """Targets by repeated resharing."""
    total, full = sum(sizes), {}
    while True:
        free = [i for i in range(len(sizes)) if i not in full]
        left, w = total - sum(full.values()), sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / w > most * sizes[i]]
        if not over:
            return [full.get(i, left * weights[i] / w if i not in full else 0) for i in range(len(sizes))]
        full |= {i: most * sizes[i] for i in over}


@pytest.mark.parametrize("sizes", [[10, 20, 30], [1, 1000, 5, 700], [5], [0, 9, 0, 4], [3, 3, 3, 100, 0, 2, 1]])
def test_targets(spark, sizes):
    names = [*(f"s{i}" for i in range(len(sizes) - 1)), None]
    df = spark.createDataFrame(list(zip(names, sizes, strict=True)), "source string, source_size long")
    got = {r.source: r.target for r in M.targets(df).collect()}
    want = water_fill(sizes, [M.WEIGHTS[i % 3] for i in range(len(sizes))])
    assert [got[n] for n in names] == pytest.approx(want)


def test_as_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = sorted(con.sql(M.ORACLE).fetchall())
    got = sorted(tuple(r) for r in M.op4_mixing(spark, sf_dir).collect())
    assert got == want


def check(rows):
    by = defaultdict(lambda: [0, 0, 0])
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size
        b = by[r.source_size, r.target]
        b[0] += r.taken
        b[1] = max(b[1], r.size)
    for (_, target), (taken, largest, _) in by.items():
        assert abs(taken - target) <= largest / 2 + 1e-6


def test_cells_do_not_matter(spark, sf_dir, monkeypatch):
    one = sorted(tuple(r) for r in M.op4_mixing(spark, sf_dir).collect())
    monkeypatch.setattr(M, "CELL_ROWS", 3)
    rows = M.op4_mixing(spark, sf_dir).collect()
    assert sorted(tuple(r) for r in rows) == one
    check(rows)


def test_cases(spark):
    rows = [(1, "a b", "x"), (1, "a b", "x"), (2, None, "x"), (3, "", None), (4, "w " * 30_000, None), (None, "q", "y"), (5, "p q r s", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("no")).withColumn("target", F.lit(1))
    got = M.mix(docs).collect()
    assert len(got) == len(rows)
    check(got)
    assert M.mix(docs.limit(0)).count() == 0
    staged = M.mixing_stage(spark, docs, "")
    assert staged.columns == docs.columns
    assert sum(len(r.text.split()) for r in staged.collect()) == sum(r.taken for r in got)


def test_emphasis(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "'s' AS source", "'a b c' AS text", "IF(id < 2000, 3, 1) AS e")
    got = {r.doc_id: r.copies for r in M.mix(docs, emphasis="e").collect()}
    assert abs(sum(got.values()) - 4000) <= 1
    assert sum(got[i] for i in range(2000)) == pytest.approx(3000, rel=0.05)
    assert all(got[i] >= 1 for i in range(2000)) and all(got[i] <= 1 for i in range(2000, 4000))


def test_probabilities_are_unequal(spark):
    """Long documents are taken less often, each as often as its emphasis says, and the words still meet the target."""
    docs = spark.range(6000).selectExpr("id AS doc_id", "IF(id < 4000, 's', 't') AS source", "repeat('w ', IF(id % 2 = 0, 4, 256)) AS text")
    rows = M.mix(docs).collect()
    check(rows)
    for low, high in ((0, 4000), (4000, 6000)):
        short, long = (sum(r.copies for r in rows if low <= r.doc_id < high and r.doc_id % 2 == k) for k in (0, 1))
        assert short / long == pytest.approx(22 / 16, rel=0.06)


@pytest.mark.parametrize("target", [10, 400, 1000, 2900, 3000])
def test_full_classes(spark, target):
    """Expected words meet every target that three copies of each document can meet."""
    classes = [(7, 300), (3, 500), (1, 200)]
    df = spark.createDataFrame([("s", float(target), g, w) for g, w in classes], "source string, target double, g long, words long")
    copies = {r.g: 3.0 if r.full else r.left * r.g / r.rest for r in M.shares(df).collect()}
    assert sum(copies[g] * w for g, w in classes) == pytest.approx(target) and max(copies.values()) <= 3
    free = [copies[g] / g for g, _ in classes if copies[g] < 3]
    assert all(v == pytest.approx(free[0]) for v in free)


def test_columns(spark, sf_dir):
    assert M.op4_mixing(spark, sf_dir).columns[:5] == ["doc_id", "size", "source_size", "target", "taken"]


@pytest.mark.parametrize("other", ["x", "y"])
def test_stage_by_row(spark, other):
    """Rows under one key or none get their own copies, and own columns stay as they are."""
    rows = [(1, "", other), (1, "a b", "x"), (None, "", "x"), (None, "c", "x"), (None, "d e f", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for name in ("k", "copy", "copies", "locator", "row_id"):
        docs = docs.withColumn(name, F.concat(F.lit("own "), "text"))
    want = defaultdict(int)
    for r in M.mix(docs.withColumn("t", F.col("text")), row="t").collect():
        want[r.row_id] += r.copies
    out = M.mixing_stage(spark, docs, "")
    assert out.columns == docs.columns
    got = defaultdict(int)
    for r in out.collect():
        got[r.text] += 1
        assert {r.k, r.copy, r.copies, r.locator, r.row_id} == {"own " + r.text}
    assert got == {t: n for t, n in want.items() if n} and "" not in got


def test_stage_on_files_read_twice(spark, tmp_path):
    """Each row is taken as often as the mix of all six rows says, though two have the same place in a file."""
    rows = [(1, "a b c", "s"), (2, "d e f", "s"), (3, "g h i", "t")]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(path)
    apart = spark.createDataFrame([(*r, str(i)) for i, r in enumerate(rows * 2)], "doc_id long, text string, source string, uid string")
    want = sum(r.copies for r in M.mix(apart, row="uid").collect())
    assert M.mixing_stage(spark, spark.read.parquet(path, path), "").count() == want > 0
