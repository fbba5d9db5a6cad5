"""Clusters of real-valued positions against brute force."""

import time

import numpy as np
import pytest

from hitloom.operators import position_clusters as P


def brute_force(event, dut, at, reach):
    n = len(event)
    label = np.arange(n)
    changed = True
    while changed:
        changed = False
        for i in range(n):
            for j in range(n):
                if (event[i], dut[i]) == (event[j], dut[j]) and all(abs(c[i] - c[j]) <= d for c, d in zip(at, reach, strict=True)) and label[j] < label[i]:
                    label[i], changed = label[j], True
    numbers, counts = {}, {}
    for i in range(n):
        key = (event[i], dut[i])
        if label[i] == i:
            numbers[i] = counts.get(key, 0)
            counts[key] = numbers[i] + 1
    return [numbers[r] for r in label], [counts[e, d] for e, d in zip(event, dut, strict=True)]


@pytest.mark.parametrize("seed", range(12))
def test_brute_force(seed):
    """Also positions on the borders of cells, equal ones and an axis without a reach."""
    rng = np.random.default_rng(seed)
    n = 60
    order = np.lexsort((rng.permutation(n), rng.integers(0, 2, n), rng.integers(0, 3, n)))
    event, dut = np.sort(rng.integers(0, 3, n)), np.zeros(n, int)
    dut[order[::2]] = 1
    order = np.lexsort((dut, event))
    event, dut = event[order], dut[order]
    reach = [0.3, [0.7, 0.0][seed % 2], 1]
    x = rng.uniform(-3, 3, n) if seed % 3 else rng.integers(-10, 11, n) * 0.3
    at = [x, rng.integers(-3, 4, n) * 0.35, rng.integers(0, 4, n)]
    ids, counts = P.number_by_position(event, dut, at, reach)
    assert (list(ids), list(counts)) == brute_force(event, dut, at, reach)


def test_crowded_place():
    """A crowd in one spot is settled by cells and boxes, not by its pairs."""
    rng = np.random.default_rng(1)
    n = 200_000
    at = [rng.normal(0, 1, n), rng.normal(0, 1, n)]
    began = time.perf_counter()
    ids, counts = P.number_by_position(np.zeros(n, int), np.zeros(n, int), at, [0.5, 0.5])
    assert counts[0] == ids.max() + 1 < 30 and time.perf_counter() - began < 20


def test_table(spark):
    rows = [(1, 0, 1, 0.0, 0.0, 0, 5.0), (1, 0, 2, None, 1.0, 0, 1.0), (1, 0, 3, 9.0, 9.0, 0, 2.0), (1, 0, 4, 0.5, 0.5, 1, 7.0), (2, 1, 1, float("nan"), 0.0, 0, 1.0)]
    hits = spark.createDataFrame(rows, "event_number long, dut int, ordinal int, x double, y double, frame int, charge double")
    got = P.build_position_clusters(P.position_cluster_ids(hits, 1.0, 1.0)).orderBy("cluster_id").collect()
    assert [(r.n_hits, r.charge, r.seed_x, r.mean_x, r.err_y, r.frame, r.n_cluster, r.cluster_shape) for r in got] == [(2, 12.0, 0.5, 0.25, 0.5, 0, 2, -1), (1, 2.0, 9.0, 9.0, 0.0, 0, 2, -1)]
    assert P.position_cluster_ids(hits, 1.0, 1.0, 0).where("n_cluster = 3").count() == 3
    assert P.position_cluster_ids(hits.limit(0), 1.0, 1.0).count() == 0
