"""Steps whose cost must not grow faster than their input: the same results as brute force, without the plans that grew."""

import time
import tracemalloc
from collections import Counter

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from hitloom.functions import geometry as G
from hitloom.operators import clusters as K
from hitloom.operators import correlation as C
from hitloom.operators import estimate as E
from hitloom.operators import histograms as H
from hitloom.operators import joins as J
from hitloom.operators import position_clusters as P
from hitloom.operators import selection
from hitloom.operators import tracking as T
from hitloom.plans import registry, tracking
from hitloom.runtime import Scratch
from hitloom.sources import views


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plane_correlation_counts_in_tasks(spark, monkeypatch):
    """A busy event, null and far bins, in small portions; no pairs are joined."""
    monkeypatch.setattr(J, "PAIRS", 50)
    rng = np.random.default_rng(1)
    rows = [(int(e), int(d), None if a % 7 == 0 else int(a) * 10**k, int(b)) for k, n, top in ((0, 400, 60), (12, 30, 5)) for e, d, a, b in zip(rng.integers(0, top, n), rng.integers(0, 4, n), rng.integers(0, 30, n), rng.integers(0, 5, n), strict=True)]
    rows += [(999, int(d), 3, int(b)) for d, b in zip(rng.integers(0, 4, 300), rng.integers(0, 3, 300), strict=True)]
    df = spark.createDataFrame(rows, "event_number long, dut int, a long, b long").repartition(5)
    found = J.plane_correlation(df, {"one": F.col("a"), "two": F.col("b")}, [0, 2])
    want = Counter()
    for e, d, *bins in rows:
        for e2, d2, *bins2 in rows:
            if e == e2 and d in (0, 2) and d2 != d:
                want.update((d, d2, k, u, v) for k, u, v in zip(("one", "two"), bins, bins2, strict=True) if u is not None and v is not None)
    assert {tuple(r)[:5]: r.n for r in found.collect()} == want
    assert "Join" not in plan(found)
    assert J.plane_correlation(df.limit(0), {"one": F.col("a")}, [0]).count() == 0


def test_align_writes_a_round_once(spark, monkeypatch):
    """A round of the alignment writes hits side by side and residuals, no fits, and finds tracks without a join."""
    written, table = [], Scratch.table
    monkeypatch.setattr(Scratch, "table", lambda self, df, name="t": written.append((name, plan(df))) or table(self, df, name))
    truth, rows = tracking.shifted(spark, "/root/testdata/sf0.001")
    E.align(rows.where("event_number < 300"), truth, groups=[[1, 2]], fit_duts=[0, 1, 2, 3, 4, 5], iterations=2, isolation=None, tolerance=0.0)
    names = [n for n, _ in written]
    assert names.count("wide") == 2 and "fits" not in names
    assert all("SortMergeJoin" not in p for n, p in written if n in ("wide", "residuals"))


def test_modes_shuffle_counts_and_not_values(spark, monkeypatch):
    """Medians, deviations and counts of groups of distinct, equal and few values against numpy; no plan deals values by range or joins them by a shuffle."""
    written, table = [], Scratch.table
    monkeypatch.setattr(Scratch, "table", lambda self, df, name="t": written.append((name, plan(df))) or table(self, df, name))
    rng = np.random.default_rng(9)
    groups = {0: rng.normal(3, 20, 3001), 1: rng.integers(-3, 4, 2000) * 0.25, 2: np.full(50, 0.1), 3: rng.normal(0, 1, 10), 4: np.r_[np.full(30, -7.5), rng.uniform(100, 600, 71)]}
    rows = [(g, float(v)) for g, values in groups.items() for v in values]
    df = spark.createDataFrame(rows, "dut int, r double").withColumn("w", F.lit(5.3)).repartition(3)
    got = {v.dut: v for v in H.density_modes(df, ["dut"], "r", "w").collect()}
    assert sorted(got) == [0, 1, 4]
    for g, v in got.items():
        assert v.n == len(groups[g]) and v.median == np.median(groups[g]) and np.isclose(v.sigma, groups[g].std(), rtol=1e-12)
    assert abs(got[0].mode - 3) < 5 and written and all("rangepartitioning" not in p for _, p in written)


def test_alignment_passes_sums_and_whole_hits(spark, monkeypatch):
    """Hits that are found side by side equal those of the long form, shapes go along; fits reach Spark as a row per plane and task, with and without isolation."""
    truth, rows = tracking.shifted(spark, "/root/testdata/sf0.001")
    n = F.max("ordinal").over(Window.partitionBy("event_number"))
    rows = rows.where("event_number < 200 AND x IS NOT NULL").withColumn("n", n).withColumn("ordinal", F.when(F.col("dut") % 2 == 1, F.col("n") + 1 - F.col("ordinal")).otherwise(F.col("ordinal"))).drop("n")
    rows = Scratch(spark, "mixed").table(rows.withColumn("cluster_shape", F.col("event_number") * 100 + F.col("dut") * 10 + F.col("ordinal")))
    data = T.planes_in_arrays(rows, [p.dut for p in truth], ["x", "y", "cluster_shape"])
    wide = T.tracks_found(data, truth[::-1], {0, 1, 2, 3, 4, 5})
    assert data.count() == wide.count()  # planes of the arrays stand in the order of the list
    wide = T.tracks_found(data, truth, {0, 1, 2, 3, 4, 5})
    got = {(r.event_number, r.ordinal, d): (r.x[d], r.y[d], r.cluster_shape[d]) for r in wide.collect() for d in range(6) if r.x[d] is not None}
    found = T.find_tracks(E.global_hits(rows.withColumns({"lx": F.col("x"), "ly": F.col("y")}), truth), truth, {0, 1, 2, 3, 4, 5}, keep=["lx", "ly", "cluster_shape"])
    assert got == {(r.event_number, r.ordinal, r.dut): (r.lx, r.ly, r.cluster_shape) for r in found.collect()}
    for isolation in (None, (500.0, 500.0)):
        seen, totals = [], T.LineFits.totals
        monkeypatch.setattr(T.LineFits, "totals", lambda *a, seen=seen, totals=totals: seen.append(totals(*a)) or seen[-1])
        _, _, history = E.align(rows, G.TRACK_PLANES, groups=[[1, 2]], fit_duts=[0, 1, 2, 3, 4, 5], iterations=1, isolation=isolation, shapes=tuple(range(0, 20000, 3)))
        monkeypatch.undo()
        fits = T.fit_tracks(rows, G.TRACK_PLANES, [0, 1, 2, 3, 4, 5], [1, 2], exclude_own=False, quality=(250.0, 250.0), isolation=isolation, use_limits=True, centre=[1, 2], keep=["x", "y", "cluster_shape"])
        for c in ["hit_flag", "quality_flag", *(["isolated_track_flag", "isolated_hit_flag"] if isolation else [])]:
            fits = fits.where(F.col(c).bitwiseAND(F.expr("shiftleft(1L, fit_dut)")) != 0)
        fits = fits.where("chi_red < 10 AND cluster_shape % 3 = 0").withColumnsRenamed({"fit_dut": "dut", "x": "lx", "y": "ly"})
        want = {r.dut: r.asDict() for r in fits.groupBy("dut").agg(F.count("*").alias("n"), *E.moment_columns()).collect()}
        sums = {r.dut: r.asDict() for r in seen[0].collect()}
        assert sums.keys() == want.keys() and history[0]["tracks"] == sum(v["n"] for v in want.values())
        assert all(np.isclose(sums[d][k], v, rtol=1e-9, atol=1e-6) for d in want for k, v in want[d].items())


def test_places_of_few_values(monkeypatch):
    """Tables over places against range sums, with windows met exactly, and in time that grows as the tracks."""
    monkeypatch.setattr(C, "SMALL", 8)
    rng = np.random.default_rng(5)
    sides = [(rng.integers(0, 90, n), rng.integers(0, 30, n) * 25.0, rng.integers(0, 15, n) * 2.5, rng.normal(0, 5, n)) for n in (500, 300, 1)]
    for p, q in ((0, None), (0, 1), (2, 1), (1, 2)):
        monkeypatch.setattr(C, "PLACES", 20_000)
        got = C.pair_sums(sides[p], None if q is None else sides[q], 200.0, 50.0, 5.0)
        monkeypatch.setattr(C, "PLACES", 0)
        np.testing.assert_allclose(got, C.pair_sums(sides[p], None if q is None else sides[q], 200.0, 50.0, 5.0), rtol=1e-9, atol=1e-9)
    monkeypatch.undo()
    n = 60_000
    columns = np.arange(n), rng.integers(0, 8, n) * 100.0 + rng.integers(-3, 4, n), rng.integers(0, 2, n) * 100.0 + rng.integers(0, 50, n) * 0.75, rng.normal(0, 5, n)
    start = time.process_time()
    C.pair_sums(columns, None, 200.0, 50.0, 5.0)
    assert time.process_time() - start < 1.8  # 30 us a track; more than 35 by range sums


def test_correlation_shuffles_tracks_once(spark, monkeypatch):
    """Pairs whose rounded distance just meets a border, by tables and by ranges; tracks are shuffled once, and again only in pieces of crowded cells."""
    rng = np.random.default_rng(3)
    n = 1500
    x = (rng.integers(0, 6, n) - 3) * 1e2 + (rng.integers(1, 8, n) - 4) * 1e-5 * 150000.0
    y = (rng.integers(0, 12, n) - 5) * 1e2 + (rng.integers(1, 51, n) - 25) * 1e-6 * 150000.0
    event, r = rng.integers(0, 700, n), rng.normal(0, 5, n)
    want = Counter()
    for axis, u, v in (("x", x, y), ("y", y, x)):
        d = np.abs(u[:, None] - u)
        near = (event[:, None] < event) & (d <= 200) & (np.abs(v[:, None] - v) < 5)
        want.update((axis, int(b)) for b in np.floor(d[near] / 50))
    df = spark.createDataFrame([(1, int(e), *map(float, v)) for e, *v in zip(event, x, y, r, r, strict=True)], "dut int, event_number long, x double, y double, rx double, ry double").repartition(2)
    written, counted = [], Scratch.counted
    monkeypatch.setattr(Scratch, "counted", lambda self, frame, name="t", **k: written.append((frame, counted(self, frame, name, **k))) or written[-1][1])
    for places, block in ((20_000, 1000), (0, 1000), (20_000, 100), (0, 100)):
        monkeypatch.setattr(C, "PLACES", places)
        monkeypatch.setattr(C, "LEAF", 64)
        monkeypatch.setattr(C, "LONGEST", 30)
        got = C.later_sums(df, 200.0, 50.0, block=block, tasks=3)
        assert {(v.axis, v.bin): v.n for v in got.collect()} == want
        frame, (table, seen) = written[-1]
        assert "Join" not in plan(frame) and plan(frame).count("hashpartitioning") == 1 and (seen["pieces"] > 0) == (block == 100)


def test_tables_of_any_shape_stay_small():
    """Many values along one axis and one along the other: no table is wider than the places."""
    rng = np.random.default_rng(13)
    n = 19_000
    for a, b in ((np.arange(n) * 0.5, np.zeros(n)), (np.zeros(n), np.arange(n) * 0.05)):
        columns = np.arange(n), rng.permutation(a), rng.permutation(b), rng.normal(0, 5, n)
        tracemalloc.start()
        C.pair_sums(columns, None, 200.0, 50.0, 5.0)
        assert tracemalloc.get_traced_memory()[1] < 3e8
        tracemalloc.stop()


def test_cells_are_found_by_search():
    """Clusters of far and near positions against all pairs, and cells looked up as columns."""
    rng = np.random.default_rng(2)
    for scale in (1.0, 1e6):
        event, dut = np.sort(rng.integers(0, 40, 900)), np.zeros(900, int)
        x, y = np.floor(rng.uniform(0, 12, 900)) * scale + rng.uniform(0, 0.9, 900), rng.uniform(0, 12, 900)
        got = P.number_by_position(event, dut, [x, y], [0.8, 0.8])[0]
        near = (event[:, None] == event) & (abs(x[:, None] - x) <= 0.8) & (abs(y[:, None] - y) <= 0.8)
        root = np.arange(900)
        while not np.array_equal(root, new := np.where(near, root, 900).min(axis=1)):
            root = new
        for e in np.unique(event):
            tops = np.unique(root[event == e])
            assert got[event == e].tolist() == np.searchsorted(tops, root[event == e]).tolist()
    n = 200_000
    event = np.repeat(np.arange(n // 4), 4)
    start = time.process_time()
    P.number_by_position(event, np.zeros(n, int), [rng.uniform(-5000, 5000, n), rng.uniform(-2500, 2500, n)], [1500.0, 1000.0])
    assert time.process_time() - start < 2.0


def test_position_clusters_deal_hits_once(spark, monkeypatch):
    """Clusters built in the tasks that number the hits equal the aggregates over their hits, with null, nan and equal charges; in more tasks than shuffle partitions too there is one shuffle."""
    rng = np.random.default_rng(12)
    some = lambda n, share: rng.random(n) < share
    n = 1500
    charge = [None if a else float("nan") if b else float(c) for a, b, c in zip(some(n, 0.1), some(n, 0.02), rng.integers(1, 4, n), strict=True)]
    rows = [(int(e), int(d), i, None if a else float(x), float(y), None if b else int(f), c) for i, (e, d, a, x, y, b, f, c) in enumerate(zip(rng.integers(0, 20, n), rng.integers(0, 2, n), some(n, 0.05), rng.uniform(0, 8, n), rng.uniform(0, 8, n), some(n, 0.1), rng.integers(0, 5, n), charge, strict=True))]
    df = spark.createDataFrame(rows, "event_number long, dut int, ordinal int, x double, y double, frame int, charge double").repartition(3)
    for weighted in (False, True):
        got, want = P.position_clusters(df, 0.4, 0.4, weighted=weighted), P.build_position_clusters(P.position_cluster_ids(df, 0.4, 0.4), weighted)
        assert got.columns == want.columns and got.dtypes == want.dtypes
        clean = lambda r: tuple(None if v is None else "nan" if v != v else round(v, 9) for v in r)
        assert sorted(map(clean, got.collect()), key=str) == sorted(map(clean, want.collect()), key=str)
    assert P.position_clusters(df.limit(0), 0.4, 0.4).count() == 0
    monkeypatch.setattr(views, "TASK_ROWS", 500)
    p = plan(registry.QUERIES["position_clusters"](spark, "/root/testdata/sf0.001"))
    assert p.count("hashpartitioning") == 1


def test_clusters_are_built_in_bounded_tasks(spark, monkeypatch):
    """More tasks than shuffle partitions, and no shuffle by cluster behind them."""
    monkeypatch.setattr(views, "TASK_ROWS", 500)
    found = registry.QUERIES["cluster_shape"](spark, "/root/testdata/sf0.001")
    tasks = -(-views.count(spark, "/root/testdata/sf0.001") // 500)
    assert tasks > 4 and plan(found).count("hashpartitioning(event_number") == 1 and f", {tasks}), REPARTITION_BY_NUM" in plan(found)
    assert "hashpartitioning(event_number#" in plan(found) and ", cluster_id#" not in "".join(v for v in plan(found).splitlines() if "Exchange" in v)


def test_joins_repeat_a_pixel_for_few_cells(spark, monkeypatch):
    """The links of a matrix of pixels, from far fewer rows than neighbouring places."""
    seen = {}
    monkeypatch.setattr(K, "connected_components", lambda links, scratch: seen.update(links=links) or links.select(links.a.alias("id"), links.a.alias("component")).limit(0))
    rows = [(1, 0, i, i % 30, i // 30) for i in range(900) if i % 5]
    K.clusters_by_joins(spark.createDataFrame(rows, "event_number long, dut int, ordinal int, column int, row int"), 3, 3, None, Scratch(spark, "cells"))
    want = sum(abs(a[3] - b[3]) <= 3 and abs(a[4] - b[4]) <= 3 for k, a in enumerate(rows) for b in rows[:k])
    assert seen["links"].count() == want == seen["links"].distinct().count()
    assert "explode(array(" not in plan(seen["links"]) and "explode([" not in plan(seen["links"])


def test_residual_pairs_shuffle_tracks_and_not_pairs(spark, monkeypatch):
    """Every pair once, across the borders of cells, in portions; tracks are dealt once and no pairs are joined."""
    monkeypatch.setattr(J, "PAIRS", 40)
    rng = np.random.default_rng(4)
    n = 700
    x, y = np.where(np.arange(n) % 2, rng.integers(-8, 8, n) * 50.0, rng.uniform(-400, 400, n)), np.where(np.arange(n) % 3, rng.integers(-60, 60, n) * 2.5, rng.uniform(-150, 150, n))
    event = rng.integers(0, 200, n)
    rows = [(int(e), i, float(a), float(b)) for i, (e, a, b) in enumerate(zip(event, x, y, strict=True))]
    df = spark.createDataFrame([*rows, (1, n, None, 1.0), (2, n, float("nan"), 1.0), (None, n, 1.0, 1.0)], "event_number long, ordinal int, x double, y double").repartition(3)
    found = J.later_pairs(df, 100.0, 10.0)
    assert "Join" not in plan(found) and plan(found).count("hashpartitioning") == 1
    want = Counter()
    for axis, u, v in (("x", x, y), ("y", y, x)):
        d = abs(u[:, None] - u)
        i, j = np.nonzero((event[:, None] < event) & (d <= 100) & (abs(v[:, None] - v) < 5))
        want.update((axis, int(event[a]), int(a), int(event[b]), int(b), int(d[a, b] // 10)) for a, b in zip(i, j, strict=True))
    assert Counter(map(tuple, found.collect())) == want and len(want) > 1000
    assert J.later_pairs(df.limit(0), 100.0, 10.0).count() == 0


def test_isolation_joins_no_pairs(spark, sf_dir, monkeypatch):
    """Flags of both positions of a row against all pairs, small and crowded events, rows without a position; one dealing and no join."""
    rng = np.random.default_rng(6)
    event, dut = np.r_[rng.integers(0, 60, 400), np.full(200, 99)], np.r_[rng.integers(0, 3, 400), np.full(200, 1)]
    at = rng.uniform(-40, 40, (4, 600)).round(1)
    lost = rng.random(600) < 0.1
    rows = [(int(e), i, int(d), None if z else float(x), None if z else float(y), float(u), float(v)) for i, (e, d, z, x, y, u, v) in enumerate(zip(event, dut, lost, *at, strict=True))]
    df = spark.createDataFrame(rows, "event_number long, ordinal int, dut int, x double, y double, ix double, iy double").repartition(3)
    found = selection.isolated_rows(df, {"own": ("x", "y", 4.0, 2.0), "line": ("ix", "iy", 3.0, 3.0)})
    same = (event[:, None] == event) & (dut[:, None] == dut) & ~np.eye(600, dtype=bool)
    near = lambda x, y, a, b: (same & (((x[:, None] - x) / a) ** 2 + ((y[:, None] - y) / b) ** 2 <= 1))
    own, line = ~(near(at[0], at[1], 4, 2) & ~lost).any(axis=1), ~near(at[2], at[3], 3, 3).any(axis=1)
    want = {i: (None if lost[i] else bool(own[i]), bool(line[i])) for i in range(600)}
    assert {r.ordinal: (r.own, r.line) for r in found.collect()} == want and 50 < own.sum() < 550
    for name in ("isolation_flags", "fit_statistics", "fit_statistics_trend"):
        p = plan(registry.QUERIES[name](spark, sf_dir))
        assert "Join" not in p and p.count("hashpartitioning(l_orderkey") + p.count("hashpartitioning(event_number") == 1


def test_small_matrices_go_entry_by_entry(monkeypatch):
    """Products, inverses and first axes of stacks against numpy's, which works on a matrix at a time and is not called by smoothers and fits."""
    rng = np.random.default_rng(8)
    a, f = rng.normal(0, 1, (300, 4, 4)), np.eye(4)
    f[0, 2] = 3.0
    a = a @ a.transpose(0, 2, 1) + 0.1 * np.eye(4)
    np.testing.assert_allclose(T.times(f, a, f.T), f @ a @ f.T, rtol=1e-12, atol=1e-12)
    np.testing.assert_allclose(T.inverse(a), np.linalg.inv(a), rtol=1e-6, atol=1e-8)
    np.testing.assert_allclose(T.inverse(a[:, :2, :2]), np.linalg.inv(a[:, :2, :2]), rtol=1e-9)
    b = a[:, :3, :3] * np.array([1e8, 1.0, 1e-8])[rng.integers(0, 3, 300)][:, None, None]
    axes = T.first_axis(*(b[:, i, j] for i in range(3) for j in range(i, 3)))
    np.testing.assert_allclose(np.abs((axes * np.linalg.eigh(b)[1][:, :, -1]).sum(axis=1)), 1, atol=1e-12)
    assert T.first_axis(*np.zeros((6, 1))).tolist() == [[0, 0, 1]]
    np.testing.assert_allclose(T.upper_tail(np.array([0.0, 3.0, 8.0]), np.array([1, 2, 4])), [1.0, np.exp(-1.5) * 2.5, np.exp(-4.0) * (1 + 4 + 8 + 64 / 6)], rtol=1e-14)
    meas, err, seed = rng.normal(0, 5, (50, 6, 2)), np.full((50, 6, 2), 5.0), np.zeros((50, 4))

    def one_by_one(*_, **__):
        raise AssertionError("a matrix at a time")

    monkeypatch.setattr(np.linalg, "inv", one_by_one)
    monkeypatch.setattr(np.linalg, "eigh", one_by_one)
    T.Smoother(G.TRACK_PLANES, set(range(6))).run(meas, err, seed)
    T.LineFits.line({0: np.ones(50, bool), 1: np.ones(50, bool)}, np.full(50, 2), {0: rng.normal(0, 1, (50, 3)), 1: rng.normal(0, 1, (50, 3))})


def test_align_kalman_reads_a_batch_from_its_folder(spark, monkeypatch):
    """Tracks are written once, side by side; a batch neither deals hits nor reads other batches."""
    written, plans, table, fit = [], [], Scratch.table, T.fit_tracks
    monkeypatch.setattr(Scratch, "table", lambda self, df, name="t", **k: written.append((name, k)) or table(self, df, name, **k))
    monkeypatch.setattr(T, "fit_tracks", lambda *a, **k: plans.append(plan(fit(*a, **k))) or fit(*a, **k))
    truth, rows = tracking.shifted(spark, "/root/testdata/sf0.001")
    E.align_kalman(rows, G.TRACK_PLANES, fixed=[0, 5], batches=3)
    assert [n for n, _ in written] == ["tracks"] and len(plans) == 3
    assert all("Exchange" not in p and "PartitionFilters: [isnotnull(batch" in p for p in plans)
