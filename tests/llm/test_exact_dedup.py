import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from hitloom.llm import exact_dedup as E


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    return sorted(((i, max(groups[t or ""]), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows), key=str)


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = E.op10_exact_dedup(spark, sf_dir).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute([tuple(r) for r in docs])
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_cases(spark):
    rows = [(1, None), (2, ""), (3, "a"), (4, "a "), (5, "a"), (5, "a"), (6, "z" * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("keep_id", F.lit("x")).withColumn("group_size", F.lit(1))
    got = E.exact_dedup(docs).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute(rows)
    assert sum(r.kept for r in got) == 4
    assert E.exact_dedup(docs.limit(0)).count() == 0
    kept = E.dedup_stage(spark, docs, "")
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 4, 5, 6]


def test_large_groups_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(E, "GROUP_ROWS", 3)
    docs = spark.range(40).selectExpr("id AS doc_id", "IF(id < 30, 'same', concat('t', id % 2)) AS text")
    weak = lambda c: F.when(F.length(c) == 4, F.lit("x")).otherwise("y")
    got = {r.doc_id: (r.keep_id, r.group_size) for r in E.exact_dedup(docs, digest=weak).collect()}
    assert got[0] == (29, 30) and got[30] == (38, 5) and got[31] == (39, 5)


def test_null_key_and_colliding_digest(spark):
    rows = [(None, "a"), (1, "a"), (2, "b"), (3, "b"), (4, "bb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    weak = lambda c: F.lit("same")
    got = sorted((str(r.doc_id), r.keep_id, r.group_size, r.kept) for r in E.exact_dedup(docs, digest=weak).collect())
    assert got == [("1", 1, 2, True), ("2", 3, 2, False), ("3", 3, 2, True), ("4", 4, 1, True), ("None", 1, 2, False)]


def test_later_batches_and_restart(spark, tmp_path):
    rows = spark.createDataFrame([(b"x", 1, "f#0"), (b"y", 2, "f#1")], E.ARRIVAL)
    rows.write.parquet(str(tmp_path / "in"))
    run = lambda: E.run_stream(spark.readStream.schema(E.ARRIVAL).parquet(str(tmp_path / "in")), str(tmp_path / "log"), str(tmp_path / "ck"))
    run()
    spark.createDataFrame([(b"x", 7, "g#0"), (b"z", 3, "g#1")], E.ARRIVAL).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    run()
    got = {bytes(r.digest).decode(): (r.keep_id, r.keep_locator, r.group_size) for r in E.latest(spark, str(tmp_path / "log")).collect()}
    assert got == {"x": (7, "g#0", 2), "y": (2, "f#1", 1), "z": (3, "g#1", 1)}


def test_own_columns_stay(spark):
    rows = [(1, "a", "own 1"), (2, "a", "own 2"), (None, "b", "own 3"), (None, "b", "own 4"), (3, None, "own 5")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mark string")
    for name in ("locator", "Locator_", "digest", "keep_id", "share"):
        docs = docs.withColumn(name, F.col("mark"))
    out = E.dedup_stage(spark, docs, "")
    got = out.collect()
    assert out.columns == docs.columns and len(got) == 3 and {"own 2", "own 5"} < {r.mark for r in got}
    assert all(len({r.mark, r.locator, r.Locator_, r.digest, r.keep_id, r.share}) == 1 for r in got)


def test_state_over_calls(spark, tmp_path):
    """A repeated batch counts once, and documents of a later one meet those of the first."""
    first, second = [(1, "a"), (2, "b"), (5, "a"), (6, None)], [(3, "a"), (9, "b"), (10, "c"), (4, "")]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    state = f"file://{tmp_path}/state"
    verdicts = lambda df: sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in df.collect())
    one = verdicts(E.exact_dedup(frame(first), state=state, batch="one"))
    assert one == [(1, 5, 2, False), (2, 2, 1, True), (5, 5, 2, True), (6, 6, 1, True)]
    assert verdicts(E.exact_dedup(frame(first), state=state, batch="one")) == one
    want = [(3, 5, 3, False), (4, 6, 2, False), (9, 9, 2, True), (10, 10, 1, True)]
    assert verdicts(E.exact_dedup(frame(second), state=state, batch="two")) == want
    assert verdicts(E.exact_dedup(frame(second), state=state, batch="two")) == want
    assert verdicts(E.exact_dedup(frame(first), state=state, batch="one")) == [(1, 5, 3, False), (2, 9, 2, False), (5, 5, 3, True), (6, 6, 2, True)]


def test_state_checks_bytes(spark, tmp_path):
    """Under a digest that clashes, texts of earlier batches are read again and groups are those of equal texts."""
    weak = lambda c: F.lit("same").cast("binary")
    state = f"file://{tmp_path}/state"
    for batch, rows in (("one", [(1, "a"), (2, "b")]), ("two", [(3, "a"), (4, "c")])):
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/{batch}")
        got = E.exact_dedup(spark.read.parquet(f"{tmp_path}/{batch}"), digest=weak, state=state, batch=batch).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == [(3, 3, 2, True), (4, 4, 1, True)]


def test_files_read_twice(spark, tmp_path):
    """A path named twice gives each row twice, and one row of a group stays."""
    path = str(tmp_path / "docs")
    spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "doc_id long, text string").coalesce(1).write.parquet(path)
    got = E.exact_dedup(spark.read.parquet(path, path)).collect()
    assert len({r.locator for r in got}) == 6 and sorted((r.doc_id, r.group_size) for r in got if r.kept) == [(2, 4), (3, 2)]
    assert sorted(r.doc_id for r in E.dedup_stage(spark, spark.read.parquet(path, path), "").collect()) == [2, 3]
