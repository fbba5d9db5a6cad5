import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from hitloom.llm import neardup as N


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def brute(rows, width, percent):
    """Components by comparing every two sets that share a shingle."""
    sets = {i: shingles(t, width) for i, t in rows}
    by_set = defaultdict(list)
    for i, s in sets.items():
        by_set[s if s else i].append(i)
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(i, j):
        i, j = sorted((top(i), top(j)))
        parent[j] = i

    for same in by_set.values():
        for j in same[1:]:
            join(same[0], j)
    have = defaultdict(list)
    reps = [v[0] for k, v in by_set.items() if not isinstance(k, int)]
    for i in reps:
        for s in sets[i]:
            have[s].append(i)
    for i in reps:
        common = defaultdict(int)
        for s in sets[i]:
            for j in have[s]:
                if j > i:
                    common[j] += 1
        for j, n in common.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                join(i, j)
    return {i: (len(sets[i]), top(i), top(i) == i) for i in sets}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_whole_table(spark, sf_dir, width, percent):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert result(N.near_duplicates(docs, width=width, percent=percent)) == brute(rows, width, percent)


def edited(base, rng, n):
    words = list(base)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return " ".join(words)


def test_large_groups(spark):
    """Groups just below, around and above the threshold, each larger than a small node, and a long chain."""
    rng = random.Random(3)
    rows = []
    for edits in (1, 2, 3, 4):
        base = [f"w{rng.randrange(10**6)}" for _ in range(100)]
        rows += [edited(base, rng, edits) for _ in range(60)]
    words = [f"c{i}" for i in range(260)]
    rows += [" ".join(words[i : i + 100]) for i in range(0, 160, 4)]
    shared = " ".join(f"s{i}" for i in range(30))
    rows += [shared + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(60)) for _ in range(60)]
    rows = list(enumerate(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(N.near_duplicates(docs, width=3, percent=85)) == brute(rows, 3, 85)


def test_cases(spark):
    rows = [(1, None), (2, ""), (3, "one two"), (4, "ONE two"), (5, " \t\n"), (6, "w " * 50_000), (7, "Ä b c"), (8, "ä b c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("x")).withColumn("component_id", F.lit(0))
    assert result(N.near_duplicates(docs, width=3, percent=85)) == brute(rows, 3, 85)
    assert N.near_duplicates(docs.limit(0)).count() == 0
    odd = docs.unionAll(docs.where("doc_id = 3")).unionAll(docs.where("doc_id = 3").withColumn("doc_id", F.lit(None).cast("long")).select(docs.columns))
    assert N.near_duplicates(odd).count() == 10
    text = "a b c d e f g h"
    same = spark.createDataFrame([(1, text), (1, "other words altogether"), (2, text), (2, text), (3, "other words altogether"), (None, text)], "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.component_id)) for r in N.near_duplicates(same).collect())
    assert got == [("1", "1"), ("1", "1"), ("2", "1"), ("2", "1"), ("3", "1"), ("None", "None")]
    kept = N.neardup_stage(spark, docs, "")
    assert kept.columns == docs.columns and kept.count() == 7


def test_trees():
    assert N.trees_for(0.85, 0.99999) == 4
    assert N.trees_for(1.0, 0.999) == 1


def test_stage_by_row(spark):
    """Rows without an identifier stay, and rows that share one follow their own verdicts."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(None, a), (None, b), (None, ""), (1, a), (2, a + " end"), (2, b), (3, c), (4, c), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("locator", F.lit("own"))
    out = N.neardup_stage(spark, docs, "")
    assert out.columns == docs.columns and {r.locator for r in out.collect()} == {"own"}
    want = [(None, a), (None, b), (None, ""), (1, a), (2, b), (3, c), (5, None)]
    assert sorted(repr((r.doc_id, r.text)) for r in out.collect()) == sorted(map(repr, want))


def test_stage_keeps_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b c"), (None, "d e f"), (1, "g h i")], "doc_id long, text string")
    assert sorted(r.text for r in N.neardup_stage(spark, docs, "").collect()) == ["a b c", "d e f", "g h i"]


def test_stage_keeps_one_row_of_a_group(spark, tmp_path):
    """Near copies and repeated rows under one key, rows without words or key, and files read twice."""
    words = " ".join(f"w{i}" for i in range(12))
    rows = [(1, words, "a"), (1, words + " more", "b"), (2, words, "c"), (3, "other text of six plain words", "d"), (3, "other text of six plain words", "d"), (4, None, "e"), (4, None, "e"), (None, words, "f")]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string, tag string").coalesce(1).write.parquet(path)
    once = [(1,), (3,), (4,), (4,), (None,)]
    assert sorted(map(tuple, N.neardup_stage(spark, spark.read.parquet(path), "").select("doc_id").collect()), key=str) == sorted(once, key=str)
    twice = N.neardup_stage(spark, spark.read.parquet(path, path), "")
    assert sorted(map(tuple, twice.select("doc_id").collect()), key=str) == sorted([(1,), (3,), (4,), (4,), (4,), (4,), (None,), (None,)], key=str)
    assert twice.columns == ["doc_id", "text", "tag"]
