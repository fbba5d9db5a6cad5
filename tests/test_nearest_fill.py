"""The distance transform behind ``nearest_fill`` against brute force."""

import time

import numpy as np
import pytest

from hitloom.operators import histograms as H

DDL = "dut int, col int, row_ int, n long"


def brute(filled, wanted):
    out = {(d, c, r): n for d, c, r, n in filled}
    for d, c, r in wanted:
        own = [((c - b) ** 2 + (r - s) ** 2, b, s, n) for e, b, s, n in filled if e == d]
        out.setdefault((d, c, r), min(own, key=lambda v: v[:3])[3] if own else None)
    return out


@pytest.mark.parametrize("share", [0.02, 0.2, 0.7])
def test_as_brute_force(spark, share):
    rng = np.random.default_rng(int(share * 100))
    grid = [(d, c, r) for d in (0, 1, 2) for c in range(-3, 14) for r in range(1, 20)]
    filled = [(*g, int(rng.integers(1, 10**6))) for g in grid if g[0] < 2 and rng.random() < share]
    got = H.nearest_fill(spark.createDataFrame(filled, DDL), spark.createDataFrame(grid, "dut int, col int, row_ int"), ["dut"]).collect()
    assert len(got) == len(grid)
    assert {(r.dut, r.col, r.row_): r.n for r in got} == brute(filled, grid)


def test_envelope():
    rng = np.random.default_rng(3)
    for _ in range(300):
        at = np.unique(rng.integers(-20, 40, rng.integers(1, 25)))
        d, x = rng.integers(0, 15, len(at)), rng.permutation(np.arange(-25, 45))
        assert (H.envelope(at, d, x) == ((x[:, None] - at) ** 2 + d * d).argmin(axis=1)).all()


def test_cases(spark):
    """No filled cell, no wanted cell, repeated wanted cells, null counts and extra columns."""
    want = spark.createDataFrame([(1, 1, 1), (1, 1, 1), (1, 2, 5)], "dut int, col int, row_ int").selectExpr("*", "7 AS n", "8 AS d")
    none = spark.createDataFrame([], DDL)
    assert [tuple(r) for r in H.nearest_fill(none, want, ["dut"]).orderBy("col").collect()] == [(1, 1, 1, None), (1, 2, 5, None)]
    some = spark.createDataFrame([(1, 2, 4, None), (1, 9, 9, 3)], DDL)
    assert {tuple(r) for r in H.nearest_fill(some, want, ["dut"]).collect()} == {(1, 2, 4, None), (1, 9, 9, 3), (1, 1, 1, None), (1, 2, 5, None)}
    assert H.nearest_fill(some, want.where("dut > 5"), ["dut"]).count() == 2


def test_large_plane(spark):
    """A plane of 1152 x 576 cells with ten filled ones, however far they are."""
    rng = np.random.default_rng(9)
    seeds = [(0, int(c), int(r), i) for i, (c, r) in enumerate(zip(rng.integers(0, 1152, 10), rng.integers(0, 576, 10), strict=True))]
    grid = spark.range(1152 * 576).selectExpr("0 AS dut", "CAST(id % 1152 AS INT) AS col", "CAST(id div 1152 AS INT) AS row_")
    began = time.perf_counter()
    got = H.nearest_fill(spark.createDataFrame(seeds, DDL), grid, ["dut"]).toPandas()
    assert time.perf_counter() - began < 60 and len(got) == 1152 * 576
    c, r = np.array([s[1] for s in seeds]), np.array([s[2] for s in seeds])
    order = np.lexsort((r, c))
    d = (got["col"].to_numpy()[:, None] - c[order]) ** 2 + (got["row_"].to_numpy()[:, None] - r[order]) ** 2
    assert (got["n"].to_numpy() == order[d.argmin(axis=1)]).all()
