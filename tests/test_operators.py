"""Unit vectors, closure tests and invariance to partitioning."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hitloom.functions import expressions as X
from hitloom.functions import geometry as G
from hitloom.operators import clusters as C
from hitloom.operators import components as CC
from hitloom.operators import estimate as E
from hitloom.operators import events as EV
from hitloom.operators import histograms as H
from hitloom.operators import joins as J
from hitloom.operators import results as RS
from hitloom.operators import tracking as T
from hitloom.plans import registry
from hitloom.plans import tracking as P


def events(spark, values):
    return spark.createDataFrame([(v, i) for i, v in enumerate(values)], "event_number long, ordinal int")


def event_lists(seed):
    """Two random ordered lists of event numbers with repeats; one of them may be empty."""
    rng = random.Random(seed)
    return [sorted(rng.randrange(12) for _ in range(n)) for n in (rng.randrange(1, 30), rng.randrange(30) if seed else 0)]


@pytest.mark.parametrize("seed", range(4))
def test_event_multisets(spark, seed):
    """An event stands in the union as often as in the list that has it more often; common events and rows with a partner."""
    a, b = event_lists(seed)
    x, y = events(spark, a), events(spark, b)
    assert Counter(r.event_number for r in J.multiset_max(x, y).collect()) == Counter(a) | Counter(b)
    assert sorted(r[0] for r in x.select("event_number").intersect(y.select("event_number")).collect()) == sorted(set(a) & set(b))
    assert sorted(r[0] for r in x.join(y, "event_number", "left_semi").collect()) == [v for v in a if v in b]


@pytest.mark.parametrize("seed", range(4))
def test_map_ordinal(spark, seed):
    """Rows of an event meet by their position in it; the rest of the left side meets nothing."""
    a, b = event_lists(seed)
    right = spark.createDataFrame([(e, i, i) for i, e in enumerate(b)], "event_number long, ordinal int, v int")
    at = {e: [i for i, v in enumerate(b) if v == e] for e in a}
    want = [(i, e, at[e][k] if (k := a[:i].count(e)) < len(at[e]) else None) for i, e in enumerate(a)]
    got = J.map_ordinal(events(spark, a), right).select("ordinal", "event_number", "v").collect()
    assert sorted(map(tuple, got)) == want


@settings(max_examples=50, deadline=None)
@given(st.tuples(*[st.floats(-3.1, 3.1)] * 3), st.tuples(*[st.floats(-1e4, 1e4)] * 3))
def test_rotation_is_orthogonal(angles, point):
    r = np.array(G.rotation(*angles))
    assert np.allclose(r @ r.T, np.eye(3)) and np.isclose(np.linalg.det(r), 1)
    assert np.allclose(r.T @ (r @ np.array(point)), point)


def test_local_global_identity(spark):
    rng = random.Random(0)
    planes = [G.Plane(i, tx=rng.uniform(-9, 9), ty=rng.uniform(-9, 9), tz=1e4 * i, alpha=rng.uniform(-3, 3), beta=rng.uniform(-1.5, 1.5), gamma=rng.uniform(-3, 3)) for i in range(40)]
    rows = G.with_geometry(spark.range(40).selectExpr("CAST(id AS INT) AS dut", "id * 7.5D AS x", "3D - id AS y"), G.geometry(spark, planes))
    g = rows.withColumns(dict(zip("abc", G.to_global(F.col("x"), F.col("y"), F.lit(0.0)), strict=True)))
    x, y, z = G.to_local(F.col("a"), F.col("b"), F.col("c"))
    angles = X.euler_angles({f"r{i}{j}": F.col(f"r{i}{j}") for i in (1, 2, 3) for j in (1, 2, 3)})
    for r in g.select("x", "y", x.alias("x2"), y.alias("y2"), z.alias("z2"), "alpha", "beta", "gamma", *(a.alias(f"e{i}") for i, a in enumerate(angles))).collect():
        assert abs(r.x - r.x2) < 1e-6 and abs(r.y - r.y2) < 1e-6 and abs(r.z2) < 1e-6
        assert np.allclose(G.rotation(r.e0, r.e1, r.e2), G.rotation(r.alpha, r.beta, r.gamma))


def test_scalar_functions(spark):
    row = spark.range(1).select(
        X.morton(F.lit(5), F.lit(3)).alias("m"), X.shape_pixels(F.lit(11).cast("long")).alias("s"), F.struct(*X.unmorton(F.lit(27).cast("long"))).alias("u"),
        X.polygon_area(F.array(*(F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y")) for a, b in ((0, 0), (4, 0), (4, 3), (0, 3))))).alias("area"),
        X.chi2_pvalue(F.lit(4.0), F.lit(4)).alias("p"), F.array(*X.spherical(F.lit(0.0), F.lit(-2.0), F.lit(0.0))).alias("sp"),
    ).first()
    assert row.m == 0b011011 and row.s == [0, 1, 3] and tuple(row.u) == (5, 3) and row.area == 12
    assert row.p == pytest.approx(3 * math.exp(-2)) and row.sp == pytest.approx([1.5 * math.pi, math.pi / 2, 2])


def hits(spark, rows):
    return spark.createDataFrame([(0, 0, i + 1, 0, c, r, float(q)) for i, (c, r, q) in enumerate(rows)], "event_number long, dut int, ordinal int, frame int, column int, row int, charge double")


@pytest.mark.parametrize(("pixels", "shape"), [([(3, 3)], 1), ([(3, 3), (4, 3)], 3), ([(3, 3), (3, 4)], 5), ([(3, 3), (4, 3), (3, 4)], 7), ([(3, 3), (4, 3), (3, 4), (4, 4)], 15), ([(i, 1) for i in range(1, 10)], -1)])
def test_cluster_shapes(spark, pixels, shape):
    rows = C.cluster_ids(hits(spark, [(c, r, 1) for c, r in pixels]), 1, 1)
    got = C.build_clusters(rows).collect()
    assert [r.cluster_shape for r in got] == [shape] and got[0].n_hits == len(pixels)


def test_long_chain_and_kernel_agree(spark):
    pixels = [(c, 1, c) for c in range(1, 101)] + [(300, 300, 1), (301, 300, 9)]
    random.Random(5).shuffle(pixels)
    h = hits(spark, pixels)
    one = {(r.ordinal, r.cluster_id) for r in C.cluster_ids(h, 1, 1).collect()}
    two = {(r.ordinal, r.cluster_id) for r in EV.clusters_by_kernel(h, 1, 1).collect()}
    assert one == two and len({c for _, c in one}) == 2


def test_charge_weighted_mean_and_noise(spark):
    rows = C.cluster_ids(hits(spark, [(1, 1, 1), (2, 1, 3), (9, 9, 1)]), 1, 1)
    first = next(r for r in C.build_clusters(rows, weighted=True).collect() if r.n_hits == 2)
    assert first.mean_column == 1.75 and (first.seed_column, first.seed_row) == (2, 1)
    noisy = spark.createDataFrame([(0, 9, 9), (0, 1, 1)], "dut int, column int, row int")
    assert C.drop_noisy(rows, noisy).count() == 2


def test_map_events_never_splits(spark):
    df = spark.range(5000).selectExpr("id % 97 AS event_number", "CAST(id AS INT) AS ordinal")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        got = EV.map_events(df, lambda b: b.groupby("event_number", as_index=False).agg(n=("ordinal", "size")), "event_number long, n long").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == 97 and sum(r.n for r in got) == 5000


def test_strict_histogram(spark):
    df = spark.createDataFrame([(0,), (5,)], "x int")
    assert H.counts(df, bin=H.unit_bin(F.col("x"), 3)).count() == 1
    with pytest.raises(Exception, match="outside"):
        H.counts(df, bin=H.unit_bin(F.col("x"), 3, strict=True)).collect()
    edges = spark.createDataFrame([(v,) for v in (0.0, 1.0, 5.0, 5.1, -0.1)], "x double")
    assert sorted((r.b, r.n) for r in H.counts(edges, b=H.edge_bin(F.col("x"), 0.0, 5.0, 5)).collect()) == [(0, 1), (1, 1), (4, 1)]


def test_components(spark):
    chain = [(i, i + 1) for i in range(300)] + [(1000, 1001), (5, 5), (2000, 2000)] + [(3000, 3000 + i) for i in range(1, 50)]
    got = {r.id: r.component for r in CC.connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert {got[i] for i in range(301)} == {0} and got[1001] == 1000 and got[2000] == 2000 and got[3049] == 3000
    assert CC.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_line_fit_as_svd(spark):
    rng = np.random.default_rng(2)
    pts = [(t, k, *map(float, rng.normal(size=3) * (5, 5, 0) + np.array([3, -2, 1000]) * k)) for t in range(30) for k in range(6)]
    rows = spark.createDataFrame(pts, "t int, k int, x double, y double, z double")
    for r in T.line_fit(rows, ["t"]).collect():
        p = np.array([q[2:] for q in pts if q[0] == r.t])
        v = np.linalg.svd(p - p.mean(axis=0))[2][0]
        assert np.allclose(np.array([r.sx, r.sy, r.sz]), v * np.sign(v[2]), atol=1e-9) and np.allclose([r.ox, r.oy, r.oz], p.mean(axis=0))


def test_found_tracks_are_whole(spark):
    """Well separated tracks whose hits were shuffled inside each plane come back together."""
    rng = random.Random(1)
    rows = []
    for e in range(40):
        n = rng.randrange(1, 6)
        for plane in G.TRACK_PLANES:
            order = rng.sample(range(n), n) if plane.dut else list(range(n))
            rows += [(e, order[t] + 1, plane.dut, 1000.0 * t + 1e-4 * plane.tz + rng.uniform(-3, 3), 500.0 * t + rng.uniform(-3, 3), plane.tz, t) for t in range(n) if plane.dut in (0, 5) or rng.random() > 0.1]
    df = spark.createDataFrame(rows, "event_number long, ordinal int, dut int, x double, y double, z double, truth int")
    found = T.find_tracks(df, G.TRACK_PLANES).alias("f").join(df.alias("d"), F.expr("f.event_number = d.event_number AND f.dut = d.dut AND f.was = d.ordinal"))
    per = found.groupBy("f.event_number", F.col("f.ordinal")).agg(F.countDistinct("truth").alias("n")).collect()
    assert all(r.n == 1 for r in per)
    again = T.find_tracks(df.repartition(7), G.TRACK_PLANES)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, T.find_tracks(df, G.TRACK_PLANES).collect()))


def test_kalman_without_scattering_is_the_line(spark):
    planes = [G.Plane(i, tz=1e4 * i, material_budget=1e-15, gamma=0.1 * i, alpha=0.05 * i) for i in range(6)]
    rng = np.random.default_rng(4)
    a = np.column_stack([rng.normal(size=(50, 2)) * 100, rng.normal(size=(50, 2)) * 1e-3])
    k = T.Smoother(planes, set(range(6)))
    exact = np.stack([k.measure(i, np.column_stack([a[:, :2] + a[:, 2:] * p.tz, a[:, 2:]]))[0] for i, p in enumerate(planes)], axis=1)
    err = np.full((50, 6, 2), 5.0)
    states, _, chi2 = k.run(exact, err, a + rng.normal(size=a.shape) * [1, 1, 1e-6, 1e-6])
    assert np.abs(states[:, :, 0] - (a[:, :1] + a[:, 2:3] * np.array([p.tz for p in planes]))).max() < 0.5
    assert chi2.max() < 0.1


def test_kalman_chi2_has_its_mean(spark):
    rng = np.random.default_rng(5)
    n, planes = 2000, [G.Plane(i, tz=1.5e5 * i, material_budget=7e-4) for i in range(6)]
    k = T.Smoother(planes, set(range(6)), energy=2000.0)
    s = np.column_stack([rng.normal(size=(n, 2)) * 10, np.zeros((n, 2))])
    meas = []
    for i in range(6):
        meas.append(s[:, :2] + rng.normal(size=(n, 2)) * 5)
        q = k.scatter(i, s)
        s = s.copy()
        s[:, 2:] += rng.normal(size=(n, 2)) * np.sqrt(q[:, 2, 2])[:, None]
        s[:, :2] += s[:, 2:] * 1.5e5
    seed = np.zeros((n, 4))
    _, _, chi2 = k.run(np.stack(meas, axis=1), np.full((n, 6, 2), 5.0), seed)
    assert np.median(chi2, axis=0)[1:] == pytest.approx(2 * math.log(2), rel=0.15)


def test_moments_give_the_normal_equations(spark):
    rng, plane = np.random.default_rng(3), G.Plane(1, tx=30.0, ty=-20.0, tz=5e4, alpha=0.02, beta=-0.03, gamma=0.4)
    rows = []
    for _ in range(200):
        s = np.array([*rng.normal(size=2) * 1e-2, 1.0])
        rows.append((1, *map(float, rng.normal(size=2) * 3000), *map(float, rng.normal(size=3) * 1000), *map(float, s / np.linalg.norm(s))))
    df = spark.createDataFrame(rows, "dut int, lx double, ly double, ox double, oy double, oz double, sx double, sy double, sz double")
    got = E.moment_sums(plane, *E.plane_moments(df)[1])
    turn = G.rotate(F.col("lx"), F.col("ly"), F.lit(0.0))
    full = G.with_geometry(df, G.geometry(spark, [plane]))
    want = E.alignment_sums(full.withColumns({f"p{a}": v for a, v in zip("xyz", turn, strict=True)})).first().asDict()
    assert all(got[k] == pytest.approx(want[k], rel=1e-6, abs=1e-3) for k in got)


def test_alignment_closes(spark):
    truth, rows = P.shifted(spark, "/root/testdata/sf0.001")
    start = E.prealign(rows, G.TRACK_PLANES, 0, 25.0)
    assert all(abs(a.tx - b.tx) < 40 and abs(a.ty - b.ty) < 40 for a, b in zip(start, truth, strict=True))
    planes, _, history = E.align(rows, G.TRACK_PLANES, groups=[[1, 2, 3, 4]], fit_duts=[0, 1, 2, 3, 4, 5], isolation=None, find=False)
    assert history[-1]["moved"] < history[0]["moved"]
    assert all(abs(a.tx - b.tx) < 3 and abs(a.ty - b.ty) < 3 and abs(a.gamma - b.gamma) < 3e-4 for a, b in zip(planes, truth, strict=True))
    planes, history = E.align_kalman(rows, G.TRACK_PLANES, fixed=[0, 5], batches=8)
    assert all(abs(a.tx - b.tx) < 5 and abs(a.ty - b.ty) < 5 for a, b in zip(planes, truth, strict=True)) and history


def test_telescope_turns_to_the_axis(spark, tmp_path):
    planes = [G.Plane(i, tx=10.0 + 5 * i, ty=-3.0 * i, tz=1e4 * i, gamma=0.1) for i in range(4)]
    out = E.align_telescope(planes, [0, 1, 2, 3], 0)
    assert all(abs(p.tx) < 1e-6 and abs(p.ty) < 1e-6 for p in out)
    gap = lambda a, b: math.dist((a.tx, a.ty, a.tz), (b.tx, b.ty, b.tz))
    assert gap(out[0], out[3]) == pytest.approx(gap(planes[0], planes[3]))
    G.save_geometry(spark, planes, str(tmp_path / "g"), 1)
    G.save_geometry(spark, out, str(tmp_path / "g"), 2)
    assert G.load_geometry(spark, str(tmp_path / "g"), 1) == planes and G.load_geometry(spark, str(tmp_path / "g")) == out


def test_alignment_finds_tracks(spark):
    truth, rows = P.shifted(spark, "/root/testdata/sf0.001")
    planes, _, _ = E.align(rows.where("event_number < 1500"), truth, groups=[[1, 2, 3, 4]], fit_duts=[0, 1, 2, 3, 4, 5], iterations=2, isolation=None)
    assert all(abs(a.tx - b.tx) < 5 and abs(a.ty - b.ty) < 5 for a, b in zip(planes, truth, strict=True))


def test_histogram_fits(spark):
    x = np.arange(-30, 31)
    g = [(0, int(v), int(1000 * math.exp(-0.5 * ((v - 2) / 5) ** 2) + 0.5)) for v in x]
    b = [(1, int(v), int(E.box(np.array([v]), [500, -1, 2, 12])[0] + 0.5)) for v in x]
    df = spark.createDataFrame(g, "dut int, bin int, n int")
    r = E.fit_histograms(df, ["dut"], "bin").first()
    assert r.mean == pytest.approx(2, abs=0.02) and r.sigma == pytest.approx(5, abs=0.05) and r.fitted
    r = E.fit_histograms(spark.createDataFrame(b, "dut int, bin int, n int"), ["dut"], "bin", shape="box").first()
    assert r.mean == pytest.approx(-1, abs=0.05) and r.half_width == pytest.approx(12, abs=0.1)


def test_residual_range_follows_the_peak(spark):
    tracks = P.plane_rows(spark, "/root/testdata/sf0.001")
    h = RS.residual_histograms(tracks, bins=50, span=1.0)
    per = h.groupBy("dut", "axis").agg(F.sum("n").alias("n"), F.max("bin").alias("top"), F.first("lo").alias("lo"), F.first("hi").alias("hi")).collect()
    assert len(per) == 12 and all(r.n > 4000 and r.top <= 49 and r.lo < 0 < r.hi for r in per)


def test_periodic_padding(spark):
    cells = spark.createDataFrame([(i, j, 10 * i + j) for i in range(4) for j in range(3)], "bx int, by_ int, n int")
    got = {(r.bx, r.by_): r.n for r in RS.wrapped(cells, 4, 3, 1).collect()}
    assert len(got) == 6 * 5 and got[-1, -1] == 32 and got[4, 0] == 0 and got[0, 3] == 0


def test_total_purity(spark):
    m = spark.createDataFrame([(0, 10, 5, 50.0), (0, 30, 30, 100.0)], "dut int, n_hits long, n_pure long, purity double")
    r = RS.total_purity(m).first()
    assert r.purity == pytest.approx(87.5) and r.weighted == pytest.approx(87.5)


def test_own_hit_changes_the_fit(spark):
    rows, geo = P.track_hits(spark, "/root/testdata/sf0.001").where("event_number < 200"), G.TRACK_PLANES
    biased = T.fit_tracks(rows, geo, [0, 1, 2, 3, 4, 5], [2, 3], exclude_own=False)
    assert biased.groupBy("event_number", "ordinal").agg(F.countDistinct("sx").alias("n")).where("n > 1").count() == 0
    unbiased = T.fit_tracks(rows, geo, [0, 1, 2, 3, 4, 5], [2, 3])
    assert unbiased.groupBy("event_number", "ordinal").agg(F.countDistinct("sx").alias("n")).where("n > 1").count() > 0
    one = T.fit_tracks(rows, geo, [0, 1, 3, 4, 5], [2], exclude_own=False)
    key = ["event_number", "ordinal"]
    a = {(r[0], r[1]): r.chi2 for r in unbiased.where("fit_dut = 2").select(*key, "chi2").collect()}
    b = {(r[0], r[1]): r.chi2 for r in one.select(*key, "chi2").collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)


@pytest.mark.parametrize("name", ["merge_clusters", "cluster_build", "efficiency_map", "event_delta", "find_tracks", "noisy_pixels", "plane_correlation", "isolation_flags"])
def test_partitioning_does_not_matter(spark, name):
    """The same rows whatever the number of partitions of reads and shuffles."""
    keys = {"spark.sql.shuffle.partitions": ("1", "13"), "spark.sql.files.maxPartitionBytes": ("1g", "20k"), "spark.sql.files.openCostInBytes": ("4m", "1k")}
    before, found = {k: spark.conf.get(k) for k in keys}, []
    try:
        for i in (0, 1):
            for k, v in keys.items():
                spark.conf.set(k, v[i])
            found.append(sorted(map(str, registry.QUERIES[name](spark, "/root/testdata/sf0.001").collect())))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found[0] == found[1]


def test_interval_and_background(spark):
    assert E.shortest_interval(5, 5)[1] == 0 and E.shortest_interval(0, 9)[0] == 0 and math.isnan(E.shortest_interval(0, 0)[0])
    assert E.shortest_interval(1, 1)[0] == pytest.approx(math.sqrt(0.32) - 1) and E.shortest_interval(0, 1)[1] == pytest.approx(1 - math.sqrt(0.32))
    cells = spark.createDataFrame([(0, 1, i, j, 10 + 50 * (i == j)) for i in range(8) for j in range(8)], "ref int, dut int, bin_ref int, bin int, n int")
    out = E.reduce_background(cells, ["ref", "dut"]).toPandas()
    assert out.n.min() == 0 and out[out.bin == out.bin_ref].n.min() > out[out.bin != out.bin_ref].n.max()


@pytest.mark.parametrize(("k", "n"), [(1, 2), (90, 100), (0, 7), (999, 1000), (950_000, 10**6), (950 * 10**6, 10**9), (3, 10**12), (10**12 // 3, 10**12), (10**12 - 1, 10**12), (10**12, 10**12)])
def test_interval_has_its_mass(k, n):
    """The interval holds 68 % of the distribution, by sums over a fine grid, and the density is the same at ends inside the range."""
    lo, hi = E.shortest_interval(k, n)
    mode, rest, s = k / n, (n - k) / n, math.sqrt((k + 1) * (n - k + 1) / (n + 3)) / (n + 2)
    d = np.concatenate([np.linspace(max(-mode, -30 * s), lo, 200_001), np.linspace(lo, hi, 200_001), np.linspace(hi, min(rest, 30 * s), 200_001)])
    with np.errstate(divide="ignore", invalid="ignore"):
        log = (k * np.log1p(d / mode) if k else 0 * d) + ((n - k) * np.log1p(-d / rest) if n > k else 0)
    density = np.exp(log)
    area = [np.trapezoid(density[i : i + 200_001], d[i : i + 200_001]) for i in (0, 200_001, 400_002)]
    assert area[1] / sum(area) == pytest.approx(0.68, abs=2e-6) and lo <= 0 <= hi
    if 0 < k < n and lo > -mode and hi < rest:
        assert density[200_001] == pytest.approx(density[400_002], rel=1e-6)


def test_quantiles_are_exact(spark):
    """Interpolated order statistics as numpy has them, with an outlier, ties, a group of one row and nulls."""
    rng = np.random.default_rng(3)
    rows = [(g, float(v)) for g, n in (("a", 3001), ("b", 1), ("c", 500)) for v in np.round(rng.normal(0, 50, n), 0 if g == "c" else 6)] + [("a", 1e9), ("c", -1e9), ("a", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    shares = {"low": 0.0, "q25": 0.25, "mid": 0.5, "q99": 0.99, "top": 1.0}
    got = {r.g: r for r in H.quantiles(df, ["g"], "v", shares).collect()}
    for g in "abc":
        values = [v for k, v in rows if k == g and v is not None]
        assert [got[g][k] for k in shares] == pytest.approx([np.quantile(values, q) for q in shares.values()], rel=1e-12, abs=1e-9)
    assert H.quantiles(df.limit(0), ["g"], "v", shares).count() == 0
    plan = H.quantiles(df, ["g"], "v", shares)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "NestedLoop" not in plan and "CartesianProduct" not in plan
