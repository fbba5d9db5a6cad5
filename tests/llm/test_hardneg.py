import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hitloom.llm import hardneg as H


def brute(rows):
    """rows: (vec_id, vector, label), identifiers unique."""
    rows = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in rows if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for a, va, ya in rows:
        if a % 100:
            continue
        got = sorted((-min(max(sum(p * q for p, q in zip(va, v, strict=False)), 1 - 2**63), 2**63 - 1), i, y == ya) for i, v, y in rows if i != a)
        for ps, p, _ in [g for g in got if g[2]][:5]:
            near = [(s, i) for s, i, same in got if not same and 30 * -ps <= 100 * -s <= 90 * -ps]
            out |= {(a, p, r, i, -ps, -s) for r, (s, i) in enumerate(near[:10], 1)}
    return out


def check(df, want):
    got = df.collect()
    assert df.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_whole_table(spark, sf_dir):
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 and r.label is not None else r.label) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    check(H.op12_hard_negatives(spark, sf_dir), brute(rows))


@pytest.mark.parametrize("seed", range(2))
def test_parts_and_ties(spark, monkeypatch, seed):
    """Small parts, blocks and chunks; few different values give many ties and repeated vectors."""
    for name, v in (("LEAST_PART", 60), ("ANCHORS", 3), ("CHUNK", 17)):
        monkeypatch.setattr(H, name, v)
    rng = random.Random(seed)
    rows = [(i * (25 if i % 3 else 1), [rng.choice((-0.5, 0.25, 0.5, 1.0)) for _ in range(11)], rng.randrange(3)) for i in range(400) if i % 3 or i * 25 % 75 or i < 3]
    rows = list({r[0]: r for r in rows}.values())
    check(H.hard_negatives(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")), brute(rows))


def test_cases(spark):
    rows = [(0, [1.0, 2.0], 1), (100, [1.0], 1), (1, [3.0, 1.0, 5.0], 1), (2, [1.0, 0.5], 2), (3, [0.5, 1.0], 2), (4, [], 1), (200, [], 2), (5, None, 1), (6, [1.0, None], 2), (7, [float("nan"), 1.0], 1), (8, [1.0, 1.0], None), (9, [float("inf"), 0.0], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("rank", F.lit("x")).withColumn("part", F.lit(1))
    want = brute(rows)
    check(H.hard_negatives(df), want)
    check(H.hard_negatives(df.union(df)), want)
    assert H.hard_negatives(df.limit(0)).count() == 0
    huge = [(0, [3e4] * 3, 0), (1, [1e20, 2.0, 1.0], 0), (2, [2e9, 1.0, 1.0], 1), (3, [1e19, 0.0, -1e30], 1), (4, [5e19, 1.0, 1.0], 1)]
    want = brute(huge)
    assert {(p, n) for _, p, _, n, _, _ in want} == {(1, 2)}
    check(H.hard_negatives(spark.createDataFrame(huge, "vec_id long, embedding array<double>, label int")), want)


@pytest.mark.parametrize("d", [1, 8, 13, 64])
def test_scores_are_exact(d):
    rng = np.random.default_rng(d)
    v, a = rng.integers(-(2**12), 2**11, (50, d)), rng.integers(-300, 300, (7, d))
    packed = H.planes(v)
    assert (H.scores(H.tables(a, packed.shape[0]), packed) == v @ a.T).all()
    big = v.astype(object) * 2**50
    packed = H.planes(big)
    assert (H.scores(H.tables(a.astype(object) * 2**40, packed.shape[0]), packed) == (v @ a.T).astype(object) * 2**90).all()
