"""Fits of peak and line models against known parameters."""

import numpy as np
import pytest

from hitloom.operators import fits as X

TRUE = {
    "gauss": [100, 3, 2], "gauss_offset": [100, 3, 2, 15], "gauss_offset_slope": [100, 3, 2, 40, 0.8],
    "double_gauss": [100, 0, 1.5, 40, 1, 6], "double_gauss_offset": [100, 0, 1.5, 40, 1, 6, 12], "linear": [5, -0.25],
}
DDL = "dut int, bin int, n double"


@pytest.mark.parametrize("model", X.MODELS)
def test_known_parameters(spark, model):
    x, rng = np.arange(-25, 25), np.random.default_rng(5)
    want = {d: np.array(TRUE[model]) * rng.uniform(0.9, 1.1, len(TRUE[model])) for d in range(5)}
    rows = [(d, int(b), float(n)) for d, p in want.items() for b, n in zip(x, X.values(model, x[None].astype(float), p[None])[0][0], strict=True)]
    rng.shuffle(rows)
    got = X.fit_models(spark.createDataFrame([(int(d), int(b), float(n)) for d, b, n in rows], DDL), ["dut"], "bin", model=model).collect()
    assert len(got) == 5
    for r in got:
        assert r.fitted and r.n_bins == len(x)
        assert [r[k] for k in X.MODELS[model]] == pytest.approx(list(want[r.dut]), rel=1e-5, abs=1e-5)


@pytest.mark.parametrize("model", X.MODELS)
def test_derivatives(model):
    x, p = np.linspace(-9, 9, 40)[None], np.array([TRUE[model]], float)
    jac = X.values(model, x, p)[1]
    for i in range(p.shape[1]):
        d = np.zeros_like(p)
        d[0, i] = 1e-6
        assert jac[0, :, i] == pytest.approx(((X.values(model, x, p + d)[0] - X.values(model, x, p - d)[0]) / 2e-6)[0], abs=1e-4)


def test_errors_and_noise(spark):
    """A line's standard errors are those of ordinary regression; a noisy peak is found within five of its errors."""
    rng = np.random.default_rng(7)
    x = np.arange(30)
    y = 4 + 0.5 * x + rng.normal(0, 1, 30)
    r = X.fit_models(spark.createDataFrame([(1, int(a), float(b)) for a, b in zip(x, y, strict=True)], DDL), ["dut"], "bin", model="linear").first()
    (slope, offset), cov = np.polyfit(x, y, 1, cov=True)
    assert (r.offset, r.slope, r.offset_err, r.slope_err) == pytest.approx((offset, slope, *np.sqrt(np.diag(cov))[::-1]))
    y = X.values("gauss_offset", x[None].astype(float), np.array([[200, 14, 3, 30.0]]))[0][0] + rng.normal(0, 5, 30)
    r = X.fit_models(spark.createDataFrame([(1, int(a), float(b)) for a, b in zip(x, y, strict=True)], DDL), ["dut"], "bin").first()
    assert all(abs(r[k] - v) < 5 * r[f"{k}_err"] for k, v in zip(X.MODELS["gauss_offset"], (200, 14, 3, 30), strict=True))


def test_cases(spark):
    """Too few bins, one bin, equal bins, nulls, no rows, and columns named like the results' own."""
    rows = [(1, 0, 5.0), (2, 0, 5.0), (2, 1, 7.0), (2, 2, None), (None, 1, 3.0), *((3, i, 4.0) for i in range(9))]
    df = spark.createDataFrame(rows, DDL).selectExpr("*", "'a' AS b", "1 AS cost", "2 AS x_")
    got = {r.dut: r for r in X.fit_models(df, ["dut"], "bin").collect()}
    assert set(got) == {1, 2, 3, None} and [got[d].n_bins for d in (1, 2, 3, None)] == [1, 2, 9, 1]
    assert not got[1].fitted and got[1].height is None and not got[2].fitted
    assert not got[3].fitted or got[3].offset is not None
    line = {r.dut: r for r in X.fit_models(df, ["dut"], "bin", model="linear").collect()}
    assert (line[2].offset, line[2].slope, line[2].slope_err) == (pytest.approx(5), pytest.approx(2), None) and line[3].slope == pytest.approx(0)
    assert X.fit_models(df.where("dut > 9"), ["dut"], "bin").count() == 0
