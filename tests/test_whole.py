"""Whole results on more rows than a cut would leave, against brute force."""

from collections import Counter, defaultdict
from dataclasses import replace

import numpy as np
import pytest

from hitloom.functions import geometry as G
from hitloom.operators import correlation as C
from hitloom.plans import registry
from hitloom.plans.positions import DIAMONDS
from hitloom.sources import views


@pytest.fixture(scope="module")
def planes(spark, sf_dir):
    """Event, ordinal, positions and residuals of the hits of each plane, as columns."""
    rows = views.tracks(spark, sf_dir).where("x IS NOT NULL").selectExpr("dut", "event_number", "ordinal", "ix", "iy", "x - ix", "y - iy").collect()
    found = {d: [np.array(c) for c in zip(*(r[1:] for r in rows if r[0] == d), strict=True)] for d in {r[0] for r in rows}}
    assert all(len(c[0]) > 500 for c in found.values())
    return found


def later_pairs(event, u, v, width):
    near = (event[None, :] > event[:, None]) & (abs(u[:, None] - u[None, :]) <= width) & (abs(v[:, None] - v[None, :]) < 5)
    return np.nonzero(near)


def binned(event, u, v, r, far, width):
    """Number of pairs and correlation by bin."""
    a, b = later_pairs(event, u, v, far)
    bins = np.floor(abs(u[a] - u[b]) / width).astype(int)
    return {k: ((bins == k).sum(), np.corrcoef(r[a[bins == k]], r[b[bins == k]])[0, 1]) for k in set(bins.tolist()) if (bins == k).sum() > 20}


def test_residual_correlation(spark, sf_dir, planes):
    want = {}
    for dut, (event, _, x, y, rx, ry) in planes.items():
        for axis, columns in (("x", (x, y, rx)), ("y", (y, x, ry))):
            want |= {(dut, axis, k): v for k, v in binned(event, *columns, 200, 50).items()}
    got = {(v.dut, v.axis, v.bin): (v.n, v.r) for v in registry.QUERIES["residual_correlation"](spark, sf_dir).collect()}
    assert set(got) == set(want)
    for k in want:
        assert got[k] == (want[k][0], pytest.approx(want[k][1], abs=2e-6))


@pytest.mark.parametrize("leaf", [1, 4, 4096])
def test_range_sums(monkeypatch, leaf):
    """Range sums against all pairs, on coordinates that meet the borders of windows exactly."""
    monkeypatch.setattr(C, "LEAF", leaf)
    rng = np.random.default_rng(leaf)
    columns = [(rng.integers(0, 40, n), np.round(rng.uniform(0, 300, n), 0 if leaf == 4 else 12), np.round(rng.uniform(0, 20, n), 0 if leaf == 4 else 12), rng.normal(0, 5, n)) for n in (300, 200, 1)]
    for p, q in ((0, None), (0, 1), (2, 1), (1, 2)):
        want = 0
        for (pe, pu, pv, pr), (qe, qu, qv, qr) in [(columns[p], columns[p])] if q is None else [(columns[p], columns[q]), (columns[q], columns[p])]:
            i, j = np.nonzero((pe[:, None] < qe) & (abs(pu[:, None] - qu) <= 100) & (abs(pv[:, None] - qv) < 5))
            k, a, b = np.floor(abs(pu[i] - qu[j]) / 30).astype(int), pr[i], qr[j]
            want = want + np.stack([np.bincount(k, w, 4) for w in (None, a, b, a * a, b * b, a * b)], axis=1)
        assert C.pair_sums(columns[p], q and columns[q], 100.0, 30.0, 5.0) == pytest.approx(want, rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("block", [40, 20_000])
def test_crowded_spot(spark, block):
    """A spot smaller than a window with a third of all tracks, tracks at borders and of one event, dealt to many shares or to one."""
    rng = np.random.default_rng(block)
    n = 900
    x, y = np.where(np.arange(n) % 3 == 0, rng.normal(790, 20, n), rng.uniform(-900, 900, n)), np.where(np.arange(n) % 3 == 0, rng.normal(79, 2, n), rng.uniform(-100, 100, n))
    x[:20], y[:20] = np.arange(20) * 200.0 - 1600, 80.0
    event, rx, ry = rng.integers(0, 300, n), rng.normal(0, 5, n), rng.normal(0, 7, n)
    df = spark.createDataFrame([(1, *map(float, v[1:3]), int(v[0]), *map(float, v[3:])) for v in zip(event, x, y, rx, ry, strict=True)], "dut int, x double, y double, event_number long, rx double, ry double")
    got = {(v.axis, v.bin): (v.n, v.r) for v in C.correlation(C.later_sums(df, 200.0, 50.0, block=block)).where("n > 20").collect()}
    want = {(a, k): v for a, c in (("x", (x, y, rx)), ("y", (y, x, ry))) for k, v in binned(event, *c, 200, 50).items()}
    assert set(got) == set(want)
    for k in want:
        assert got[k] == (want[k][0], pytest.approx(want[k][1], abs=1e-9))
    assert C.later_sums(df.limit(0), 200.0, 50.0).count() == 0


def test_residual_pairs(spark, sf_dir, planes):
    want = []
    for axis in "xy":
        event, ordinal, x, y, *_ = planes[2]
        u, v = (x, y) if axis == "x" else (y, x)
        a, b = later_pairs(event, u, v, 100)
        want += [(axis, *map(int, t)) for t in zip(event[a], ordinal[a], event[b], ordinal[b], np.floor(abs(u[a] - u[b]) / 10).astype(int), strict=True)]
    got = registry.QUERIES["residual_pairs"](spark, sf_dir).select("axis", "e1", "o1", "e2", "o2", "bin").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_all_planes(spark, sf_dir):
    """Shapes, event correlation and nearest values of every plane."""
    want = {(t.event_number, t.ordinal, t.dut, k) for t in views.tracks(spark, sf_dir).collect() for k in range(63) if t.cluster_shape >> k & 1}
    got = registry.QUERIES["shape_to_pixels"](spark, sf_dir).collect()
    assert len(got) == len(want) and {(v.event_number, v.ordinal, v.dut, v.pixel) for v in got} == want

    hits = views.hits(spark, sf_dir).collect()
    near = {(h.event_number, h.ordinal, h.dut, min((1, 4, 9, 16), key=lambda v: (abs(v - h.column), -v))) for h in hits}
    got = registry.QUERIES["nearest_value"](spark, sf_dir).collect()
    assert len(got) == len(hits) and {(v.event_number, v.ordinal, v.dut, v.nearest) for v in got} == near

    at = defaultdict(list)
    for h in hits:
        at["column", h.event_number, h.dut].append(h.column)
        at["row", h.event_number, h.dut].append(h.row)
    pairs = Counter((dut, axis, early, late) for (axis, event, dut), places in at.items() for back in (1, 2, 3) for early in at.get((axis, event - back, dut), ()) for late in places)
    got = registry.QUERIES["event_correlation"](spark, sf_dir).collect()
    assert {(v.dut, v.axis, v.early, v.late): v.n for v in got} == pairs


def test_nearest_pixel_irregular(spark, sf_dir):
    """Every crossing point within reach of a pixel against all pixels of its plane; of equally near ones the smaller column, then row."""
    planes = [replace(DIAMONDS[i % 2], dut=i) for i in range(6)]
    pixels = G.pixel_positions(spark, planes, {p.dut: (p.name, (38, 140)) for p in planes}).toPandas().sort_values(["dut", "column", "row"])
    points = views.tracks(spark, sf_dir).select("event_number", "ordinal", "dut", "ix", "iy").where("abs(ix) <= 10000 AND abs(iy) <= 8400").toPandas()
    got = {(v.event_number, v.ordinal, v.dut): (v.col, v.row_) for v in registry.QUERIES["nearest_pixel_irregular"](spark, sf_dir).collect()}
    checked = 0
    for dut, mine in points.groupby("dut"):
        table = pixels[pixels["dut"] == dut]
        px, py, names = table["px"].to_numpy(), table["py"].to_numpy(), table[["column", "row"]].to_numpy()
        for start in range(0, len(mine), 1000):
            part = mine.iloc[start : start + 1000]
            dx, dy = px - part["ix"].to_numpy()[:, None], py - part["iy"].to_numpy()[:, None]
            d = dx * dx + dy * dy
            for point, k, far in zip(part.itertuples(), d.argmin(axis=1), d.min(axis=1), strict=True):
                if far <= 500.0**2:
                    assert got[point.event_number, point.ordinal, dut] == tuple(names[k])
                    checked += 1
    assert checked > 1000
