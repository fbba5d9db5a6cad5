"""Least-squares fits of peak and line models to many histograms at once.

A histogram is gathered into one row (it is as long as its bins); the rows of an
Arrow batch are then fitted together, with analytic derivatives.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitloom.runtime import ship

PEAK, SECOND = ("height", "mean", "sigma"), ("height_2", "mean_2", "sigma_2")

#: Parameters of each model: peaks first, then the coefficients of the line below them.
MODELS = {
    "gauss": (*PEAK,),
    "gauss_offset": (*PEAK, "offset"),
    "gauss_offset_slope": (*PEAK, "offset", "slope"),
    "double_gauss": (*PEAK, *SECOND),
    "double_gauss_offset": (*PEAK, *SECOND, "offset"),
    "linear": ("offset", "slope"),
}

#: Numbers of a Jacobian that are held at once.
ROOM = 4_000_000


def peaks(model: str) -> int:
    return sum(name.startswith("mean") for name in MODELS[model])


def values(model: str, x: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values (b, n) of a model at the points ``x`` (b, n) for the parameters ``p`` (b, k), and their derivatives (b, n, k)."""
    jac = np.empty((*x.shape, p.shape[1]))
    total = np.zeros_like(x)
    for i in range(0, 3 * peaks(model), 3):
        height, mean, sigma = (p[:, i + j, None] for j in range(3))
        u = (x - mean) / sigma
        e = np.exp(-0.5 * u * u)
        total += height * e
        jac[:, :, i], jac[:, :, i + 1], jac[:, :, i + 2] = e, height * e * u / sigma, height * e * u * u / sigma
    for power, i in enumerate(range(3 * peaks(model), p.shape[1])):
        jac[:, :, i] = x**power
        total += p[:, i, None] * jac[:, :, i]
    return total, jac


def starts(model: str, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> list[np.ndarray]:
    """Parameters to start from: the moments above the lower tenth of the bins where the model has an offset.

    Two peaks start from a narrow and a wide one at the same place, and from one on each side.
    """
    names, b = MODELS[model], len(x)
    base = np.zeros(b)
    if "offset" in names:
        rank = np.maximum((w.sum(axis=1) * 0.1).astype(int), 0)
        base = np.sort(np.where(w > 0, y, np.inf), axis=1)[np.arange(b), rank]
    rest = {"offset": base, "slope": np.zeros(b)}
    if not peaks(model):
        return [np.column_stack([rest[k] for k in names])]
    above = np.clip(y - base[:, None], 0, None) * w
    total = np.maximum(above.sum(axis=1), 1e-300)
    mean = (above * x).sum(axis=1) / total
    width = np.sqrt((above * (x - mean[:, None]) ** 2).sum(axis=1) / total)
    span = np.where(w > 0, x, -np.inf).max(axis=1) - np.where(w > 0, x, np.inf).min(axis=1)
    width = np.maximum(width, np.maximum(span, 1.0) / (2 * np.maximum(w.sum(axis=1), 1)))
    top = above.max(axis=1)
    tip = x[np.arange(b), above.argmax(axis=1)]
    if peaks(model) == 1:
        first = [(top, mean, width), (top, tip, width / 3)]
    else:
        first = [(0.7 * top, mean, 0.6 * width, 0.3 * top, mean, 2 * width), (top, mean - width, width / 2, top, mean + width, width / 2), (top, tip, width / 3, 0.2 * top, mean, width)]
    return [np.column_stack([*f, *(rest[k] for k in names[3 * peaks(model) :])]) for f in first]


def descend(model: str, p: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, steps: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Damped Gauss-Newton steps for all histograms at once: parameters and sums of squares. Settled ones leave the batch."""
    p, damp, live = p.copy(), np.full(len(p), 1e-2), np.arange(len(p))
    cost = _cost(model, p, x, y, w)
    for _ in range(steps):
        if not len(live):
            break
        trial, new = _step(model, p[live], x[live], y[live], w[live], damp[live])
        better = new < cost[live]
        settled = better & (cost[live] - new <= 1e-13 * cost[live]) | (damp[live] > 1e14)
        ok = live[better]
        p[ok], cost[ok] = trial[better], new[better]
        damp[live] = np.where(better, damp[live] / 5, damp[live] * 5)
        live = live[~settled]
    for _ in range(2):  # undamped: exact where the model is linear
        trial, new = _step(model, p, x, y, w, np.full(len(p), 1e-15))
        better = new <= cost * (1 + 1e-13)
        p[better], cost[better] = trial[better], new[better]
    return p, cost


def _cost(model, p, x, y, w):
    with np.errstate(all="ignore"):
        cost = (w * (y - values(model, x, p)[0]) ** 2).sum(axis=1)
    return np.where(np.isfinite(cost), cost, np.inf)


def _normal(model, p, x, y, w):
    v, jac = values(model, x, p)
    jac *= w[:, :, None]
    t = jac.transpose(0, 2, 1)
    return np.nan_to_num(t @ jac), np.nan_to_num(t @ ((y - v) * w)[:, :, None])


def _step(model, p, x, y, w, damp):
    with np.errstate(all="ignore"):
        a, g = _normal(model, p, x, y, w)
        d = np.einsum("bii->bi", a)
        scale = 1 / np.sqrt(np.maximum(d, 1e-280))  # unit diagonal: parameters of any size
        a = a * scale[:, :, None] * scale[:, None, :]
        a[:, np.arange(p.shape[1]), np.arange(p.shape[1])] = 1 + damp[:, None]
        try:
            move = np.linalg.solve(a, g * scale[:, :, None])[:, :, 0] * scale
        except np.linalg.LinAlgError:  # one histogram with two equal columns stops the whole batch
            move = (np.linalg.pinv(a, hermitian=True) @ (g * scale[:, :, None]))[:, :, 0] * scale
        trial = p + move
    return trial, _cost(model, trial, x, y, w)


def errors(model: str, p: np.ndarray, cost: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Standard errors of the parameters from the scatter around the fit; NaN without a point to spare."""
    a, _ = _normal(model, p, x, y, w)
    scale = 1 / np.sqrt(np.maximum(np.einsum("bii->bi", a), 1e-280))
    inverse = np.linalg.pinv(a * scale[:, :, None] * scale[:, None, :], hermitian=True) * scale[:, :, None] * scale[:, None, :]
    spare = w.sum(axis=1) - p.shape[1]
    with np.errstate(all="ignore"):
        return np.sqrt(np.maximum(np.einsum("bii->bi", inverse), 0) * np.where(spare > 0, cost / spare, np.nan)[:, None])


def fit_batch(model: str, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parameters, their errors and the sums of squares of the best of all starts; sigmas are positive, the narrower of two peaks is first."""
    best, cost = None, None
    for start in starts(model, x, y, w):
        p, c = descend(model, start, x, y, w)
        if best is None:
            best, cost = p, c
        else:
            better = c < cost
            best[better], cost[better] = p[better], c[better]
    for i in range(2, 3 * peaks(model), 3):
        best[:, i] = np.abs(best[:, i])
    if peaks(model) == 2:
        turned = best[:, 5] < best[:, 2]
        best[turned, :6] = best[turned][:, [3, 4, 5, 0, 1, 2]]
    return best, errors(model, best, cost, x, y, w), cost


def fit_models(hist: DataFrame, by: list[str], at: str, n: str = "n", model: str = "gauss_offset") -> DataFrame:
    """Least-squares fit of a model of ``MODELS`` to each histogram, one row per group.

    Columns: ``by``, n_bins, total, fitted, cost (the sum of squares), and each
    parameter with its standard error ``<name>_err`` (null without a bin to
    spare). ``hist`` has one row per bin; rows with a null place or count are
    no bins, a place that is there twice counts as two. With fewer bins than
    parameters, or where no start leads to a finite fit, ``fitted`` is false
    and parameters are null. An empty table gives no rows.
    """
    ship(hist.sparkSession)
    names = MODELS[model]
    bins = hist.where(F.col(at).isNotNull() & F.col(n).isNotNull()).select(*by, F.struct(F.col(at).cast("double").alias("x"), F.col(n).cast("double").alias("y")).alias("b"))
    rows = bins.groupBy(*by).agg(F.sort_array(F.collect_list("b")).alias("b")).select(*by, F.col("b.x").alias("x_"), F.col("b.y").alias("y_"))
    results = ["cost", *(f"{k}{e}" for k, e in product(names, ("", "_err")))]
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*by).schema), "n_bins long, total double, fitted boolean", *(f"{k} double" for k in results)])

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            longest = max(map(len, b["x_"]), default=1)
            size = max(1, ROOM // (longest * len(names)))
            for i in range(0, len(b), size):
                yield _fit_rows(b.iloc[i : i + size], by, model, results)

    return rows.mapInPandas(fit, ddl)


def _fit_rows(b: pd.DataFrame, by: list[str], model: str, results: list[str]) -> pd.DataFrame:
    names = MODELS[model]
    lengths = b["x_"].map(len).to_numpy()
    x, y, w = (np.zeros((len(b), max(lengths.max(), len(names)))) for _ in range(3))
    inside = np.arange(x.shape[1]) < lengths[:, None]
    x[inside], y[inside], w[inside] = np.concatenate(b["x_"].to_numpy()), np.concatenate(b["y_"].to_numpy()), 1.0
    p, e, cost = fit_batch(model, x, y, w)
    fitted = (lengths >= len(names)) & np.isfinite(cost) & np.isfinite(p).all(axis=1)
    table = np.column_stack([cost, *(c for i in range(len(names)) for c in (p[:, i], e[:, i]))])
    table[~fitted] = np.nan
    out = b[by].reset_index(drop=True)
    out["n_bins"], out["total"], out["fitted"] = lengths, (y * w).sum(axis=1), fitted
    for k, c in zip(results, table.T, strict=True):
        out[k] = pd.Series(c).astype(object).where(np.isfinite(c), None)
    return out
