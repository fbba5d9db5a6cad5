"""Small estimators that finish an aggregate: histogram fits, background, intervals, alignment."""

from __future__ import annotations

import math
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hitloom.functions.geometry import Plane, rotation
from hitloom.operators.joins import plane_correlation
from hitloom.runtime import Scratch, ship


def least_squares(model, start: np.ndarray, x: np.ndarray, y: np.ndarray, steps: int = 60) -> np.ndarray:
    """Levenberg-Marquardt with a numerical Jacobian, for a handful of parameters."""
    p, damp = np.array(start, float), 1e-2
    cost = float(((model(x, p) - y) ** 2).sum())
    for _ in range(steps):
        h = 1e-6 * np.maximum(np.abs(p), 1e-3)
        jac = np.stack([(model(x, p + np.eye(len(p))[i] * h[i]) - model(x, p - np.eye(len(p))[i] * h[i])) / (2 * h[i]) for i in range(len(p))], axis=1)
        a, g = jac.T @ jac, jac.T @ (y - model(x, p))
        trial = p + np.linalg.solve(a + damp * np.diag(np.diag(a) + 1e-12), g)
        new = float(((model(x, trial) - y) ** 2).sum())
        if new < cost:
            done = cost - new < 1e-12 * cost
            p, cost, damp = trial, new, damp / 5
            if done:
                break
        else:
            damp *= 5
    return p


def gauss(x, p):
    return p[0] * np.exp(-0.5 * ((x - p[1]) / p[2]) ** 2)


_erf = np.vectorize(math.erf, otypes=[float])


def box(x, p):
    """A box of full width 2 w smeared by a Gaussian: p is height, centre, sigma, w."""
    s = math.sqrt(2) * abs(p[2])
    return p[0] * 0.5 * (_erf((x - p[1] + p[3]) / s) - _erf((x - p[1] - p[3]) / s))


def fit_histograms(hist: DataFrame, by: list[str], at: str, n: str = "n", shape: str = "gauss") -> DataFrame:
    """Fit a Gaussian or a smeared box to each histogram; its moments stand in where the fit does not converge.

    ``hist`` has one row per bin, so a group is as large as its number of bins.
    """
    ship(hist.sparkSession)
    fields = hist.select(*by).schema

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(at)
        x, y = group[at].to_numpy(float), group[n].to_numpy(float)
        mean = float(np.average(x, weights=y))
        rms = float(np.sqrt(max(np.average((x - mean) ** 2, weights=y), 1e-12)))
        height, ok = float(y.max()), True
        try:
            start = [height, mean, rms] if shape == "gauss" else [height, mean, rms / 3, rms * math.sqrt(3)]
            p = least_squares(gauss if shape == "gauss" else box, np.array(start), x, y)
            ok = bool(np.isfinite(p).all() and abs(p[1] - mean) <= 3 * rms)
        except np.linalg.LinAlgError:
            ok = False
        if not ok:
            p = np.array([height, mean, rms, 0.0])
        row = {k: group[k].iloc[0] for k in by} | {"height": p[0], "mean": p[1], "sigma": abs(p[2]), "half_width": abs(p[3]) if len(p) > 3 else 0.0, "fitted": ok, "total": int(y.sum()), "moment_mean": mean, "moment_rms": rms}
        return pd.DataFrame([row])

    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", height double, mean double, sigma double, half_width double, fitted boolean, total long, moment_mean double, moment_rms double"
    return hist.groupBy(*by).applyInPandas(fit, ddl)


def damped_sine(x, p):
    """p is the height and length of the damped term, the height, phase and period of the sine."""
    return p[0] * np.exp(-x / p[1]) + p[2] * np.sin(2 * np.pi * x / p[4] + p[3])


def fit_damped_sine(points: DataFrame, by: list[str], at: str, value: str, n: str, period: float) -> DataFrame:
    """Fit ``damped_sine`` to the few points of each group, each counting by its number ``n``; the best of a few starts around ``period``."""
    ship(points.sparkSession)
    fields = points.select(*by).schema

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        x, y, w = (group[c].to_numpy(float) for c in (at, value, n))
        w = np.sqrt(w / w.mean())
        best = None
        for factor in (0.5, 1.0, 2.0, 4.0):
            for phase in (0.0, np.pi / 2, np.pi):
                try:
                    p = least_squares(lambda v, q: damped_sine(v, q) * w, np.array([0.1, x.mean() or 1.0, 0.1, phase, factor * period]), x, y * w)
                except np.linalg.LinAlgError:
                    continue
                cost = float((((damped_sine(x, p) - y) * w) ** 2).sum())
                if np.isfinite(cost) and (best is None or cost < best[0]):
                    best = cost, p
        names = ["damped", "length", "sine", "phase", "period"]
        row = {k: group[k].iloc[0] for k in by} | dict(zip(names, best[1] if best else [None] * 5, strict=True)) | {"cost": best[0] if best else None, "points": len(x)}
        return pd.DataFrame([row])

    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", damped double, length double, sine double, phase double, period double, cost double, points int"
    return points.groupBy(*by).applyInPandas(fit, ddl)


def line_angles(step: float, tolerance: float = 0.1) -> list[float]:
    """Angles in degrees, in steps, of normals whose lines have a slope within ``tolerance`` of 1 or -1."""
    angles = [k * step for k in range(1, int(180 / step))]
    return [t for t in angles if abs(abs(math.cos(math.radians(t)) / math.sin(math.radians(t))) - 1) <= tolerance]


def hough_lines(cells: DataFrame, by: list[str], step: float = 0.1, most: int = 1) -> DataFrame:
    """Lines ref = slope * bin + offset through correlation cells (by, bin_ref, bin, n): (by, rank, votes, theta, rho, slope, offset).

    The fullest reference bin (of equals the smallest) of each bin votes for
    all lines of a slope near 1 or -1 through it, in whole bins of their distance
    from the origin; the ``most`` lines with the most votes are returned. Cells
    and votes are as many as bins of a plane allow, whatever the number of hits.
    """
    top = cells.groupBy(*by, "bin").agg(F.max(F.struct("n", (-F.col("bin_ref")).alias("r")))["r"].alias("r")).withColumn("r", -F.col("r"))
    votes = top.withColumn("theta", F.explode(F.array(*map(F.lit, line_angles(step)))))
    a = F.radians("theta")
    rho = F.floor(F.col("bin") * F.cos(a) + F.col("r") * F.sin(a) + 0.5 + 1e-6).cast("int")
    counts = votes.groupBy(*by, "theta", rho.alias("rho")).agg(F.count("*").alias("votes"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("votes"), "theta", "rho"))
    best = counts.withColumn("rank", rank).where(F.col("rank") <= most)
    return best.select(*by, "rank", "votes", "theta", "rho", (-F.cos(a) / F.sin(a)).alias("slope"), (F.col("rho") / F.sin(a)).alias("offset"))


def reduce_background(cells: DataFrame, by: list[str]) -> DataFrame:
    """Take the rank-one part of each correlation matrix away and shift the rest to a minimum of 0.

    A matrix is as large as the extents of two planes over the bin width.
    """
    ship(cells.sparkSession)
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cells.select(*by, "bin_ref", "bin").schema) + ", n double"

    def reduce_(g: pd.DataFrame) -> pd.DataFrame:
        rows, cols = np.unique(g["bin_ref"]), np.unique(g["bin"])
        m = np.zeros((len(rows), len(cols)))
        i, j = np.searchsorted(rows, g["bin_ref"]), np.searchsorted(cols, g["bin"])
        m[i, j] = g["n"]
        u, s, v = np.linalg.svd(m, full_matrices=False)
        m -= np.trunc(s[0] * np.outer(u[:, 0], v[0]))
        return g[[*by, "bin_ref", "bin"]].assign(n=m[i, j] - m.min())

    return cells.groupBy(*by).applyInPandas(reduce_, ddl)


def shortest_interval(k: int, n: int, mass: float = 0.68) -> tuple[float, float]:
    """Signed distances from k / n to the ends of the shortest interval of Beta(k + 1, n - k + 1) with that mass; NaN without trials.

    Everything is counted from the mode k / n, so nothing cancels at any n: the
    ends are where the density falls to one level, and the level is found by
    halving, with the mass integrated in panels between the ends.
    """
    if n <= 0:
        return math.nan, math.nan
    mode, rest = k / n, (n - k) / n
    scale = math.sqrt((k + 1) * (n - k + 1) / (n + 3)) / (n + 2)
    left, right = max(-mode, -40 * scale), min(rest, 40 * scale)  # nothing is left beyond, in an exponential tail too
    nodes, weights = np.polynomial.legendre.leggauss(16)

    def log_density(d):
        with np.errstate(divide="ignore"):
            return (k * np.log1p(np.maximum(d / mode, -1)) if k else 0.0) + ((n - k) * np.log1p(np.maximum(-d / rest, -1)) if n > k else 0.0)

    def integral(a: float, b: float) -> float:
        edges = np.linspace(a, b, 41)
        half = (edges[1:] - edges[:-1]) / 2
        return float((np.exp(log_density((edges[:-1] + half)[:, None] + half[:, None] * nodes)) * weights * half[:, None]).sum())

    def end(far: float, level: float) -> float:
        """Where the density falls to ``level`` between the mode and ``far``; ``far`` if it does not."""
        if far == 0 or log_density(far) >= level:
            return far
        near = 0.0
        for _ in range(60):
            middle = (near + far) / 2
            near, far = (middle, far) if log_density(middle) >= level else (near, middle)
        return (near + far) / 2

    wanted = mass * (integral(left, 0.0) + integral(0.0, right))
    high, low = 0.0, -900.0
    for _ in range(60):
        level = (high + low) / 2
        a, b = end(left, level), end(right, level)
        high, low = (level, low) if integral(a, 0.0) + integral(0.0, b) < wanted else (high, level)
    return a, b


def prealign(hits: DataFrame, planes: list[Plane], reference: int, width: float, reduce: bool = True) -> list[Plane]:
    """Translations, reflections and area limits of planes from their correlations with a reference plane.

    ``hits`` has local x, y. Global positions are counted over each plane's
    extent in bins of ``width``; after the background is taken off (``reduce``)
    the best line of a slope near 1 or -1 is voted for. What it says amid its
    bins is the translation, a negative slope turns the plane over.
    Limits are set (or narrowed) to the pixels where the density of bins that
    follow the line is at least half of its maximum. What reaches the driver is
    a row per plane and axis and the fullest cell of each bin of a plane.
    """
    from hitloom.functions import geometry as G

    at = {p.dut: p for p in planes}
    geo = G.geometry(hits.sparkSession, planes)
    rows = G.with_geometry(hits.where("x IS NOT NULL AND y IS NOT NULL").select("event_number", "dut", "x", "y"), geo)
    g = G.to_global(F.col("x"), F.col("y"), F.lit(0.0))
    rows = G.with_extents(rows.select("event_number", "dut", *(v.alias(a) for v, a in zip(g, "xy", strict=False))), geo, width)
    scratch = Scratch(hits.sparkSession, "prealign")
    keys = ["ref", "dut", "axis"]
    cells = scratch.table(plane_correlation(rows, {a: G.extent_bin(F.col(a), a, width) for a in "xy"}, [reference]), "cells")
    if reduce:
        cells = scratch.table(reduce_background(cells, keys).where("n > 0"), "reduced")
    lines = {(r["dut"], r["axis"]): r for r in hough_lines(cells, keys).collect()}
    tops = cells.groupBy(*keys, "bin").agg(F.max(F.struct("n", (-F.col("bin_ref")).alias("r")))["r"].alias("r")).select("dut", "axis", "bin", (-F.col("r")).alias("r")).toPandas()
    out = {}
    for p in planes:
        if p.dut == reference or (p.dut, "x") not in lines or (p.dut, "y") not in lines:
            out[p.dut] = p
            continue
        r, move, reach = np.array(rotation(p.alpha, p.beta, p.gamma)), {}, {}
        for i, axis in enumerate("xy"):
            line, own = lines[p.dut, axis], tops[(tops.dut == p.dut) & (tops.axis == axis)]
            (lo, n), (ref_lo, _) = (histogram_range(q, i, width) for q in (p, at[reference]))
            pitch = p.column_size if i == 0 else p.row_size
            off = np.abs(own["r"] - line["slope"] * own["bin"] - line["offset"]).to_numpy() * width
            near = own["bin"].to_numpy()[off <= 2 * math.sqrt(12) * pitch]
            middle = near.mean() if len(near) else (n - 1) / 2  # the slope's error must not grow on the way to the plane's centre
            move[f"t{axis}"] = ref_lo + (line["offset"] + line["slope"] * middle + 0.5 - math.copysign(1.0, line["slope"]) * (middle - (n - 1) / 2)) * width
            reach[axis] = dense_range(lo + (near + 0.5) * width, lo + (np.arange(n) + 0.5) * width)
            if line["slope"] < 0:
                r = np.array(rotation(0, math.pi, 0) if i == 0 else rotation(math.pi, 0, 0)) @ r
        out[p.dut] = replace(p, **move, **_angles(r), **area_limits(p, reach))
    return [out[p.dut] for p in planes]


def histogram_range(p: Plane, axis: int, width: float) -> tuple[float, int]:
    """First edge and number of bins that ``geometry.extent_bin`` has for a plane."""
    r = rotation(p.alpha, p.beta, p.gamma)[axis]
    size = sum(abs(v) * n * c for v, n, c in zip(r, (p.n_columns, p.n_rows), (p.column_size, p.row_size), strict=False))
    n = math.ceil(size / width)
    return (p.tx, p.ty, p.tz)[axis] - n * width / 2, n


def dense_range(points: np.ndarray, grid: np.ndarray) -> tuple[float, float] | None:
    """Where on the grid a Gaussian density of the points (bandwidth by their number and spread) is at least half of its maximum."""
    if len(points) < 2 or not points.std():
        return None
    w = points.std() * len(points) ** -0.2
    density = np.array([np.exp(-0.5 * ((points - x) / w) ** 2).sum() for x in grid])
    inside = grid[density > 0.5 * density.max()]
    return float(inside.min()), float(inside.max())


def area_limits(p: Plane, reach: dict) -> dict:
    """The plane's local limits, narrowed to its pixels whose global positions are in the ranges of ``reach``."""
    r = np.array(rotation(p.alpha, p.beta, p.gamma))
    x, y = (pitch * (np.arange(n) + 0.5 - n / 2) for pitch, n in ((p.column_size, p.n_columns), (p.row_size, p.n_rows)))
    x, y = (v.ravel() for v in np.meshgrid(x, y))
    inside = np.ones(len(x), bool)
    for i, axis in enumerate("xy"):
        if reach[axis]:
            g = x * r[i, 0] + y * r[i, 1] + (p.tx, p.ty)[i]
            inside &= (g >= reach[axis][0]) & (g <= reach[axis][1])
    if not inside.any():
        return {}
    pick = lambda f, old, new: new if old is None else f(old, new)
    return {f"{a}_{n}": pick(f, getattr(p, f"{a}_{n}"), float(g(v[inside]))) for a, v in (("x", x), ("y", y)) for n, f, g in (("lo", max, np.min), ("hi", min, np.max))}


def align_telescope(planes: list[Plane], selected: list[int], reference: int) -> list[Plane]:
    """Turn and shift the whole telescope so that the line through the selected planes' centres is the z axis.

    The reference plane's centre goes to x = y = 0; distances between planes stay.
    """
    centres = np.array([[p.tx, p.ty, p.tz] for p in planes if p.dut in selected])
    mean = centres.mean(axis=0)
    axis = np.linalg.svd(centres - mean)[2][0]
    axis = axis * (1 if axis[2] >= 0 else -1)
    v = np.cross(axis, [0.0, 0.0, 1.0])
    s, c = np.linalg.norm(v), axis[2]
    k = np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]])
    turn = np.eye(3) if s < 1e-15 else np.eye(3) + k + k @ k * ((1 - c) / s**2)
    ref = next(p for p in planes if p.dut == reference)
    origin = turn @ (np.array([ref.tx, ref.ty, ref.tz]) - mean) + mean
    out = []
    for p in planes:
        r = turn @ np.array(rotation(p.alpha, p.beta, p.gamma))
        t = turn @ (np.array([p.tx, p.ty, p.tz]) - mean) + mean - [origin[0], origin[1], origin[2] - ref.tz]
        out.append(replace(p, tx=float(t[0]), ty=float(t[1]), tz=float(t[2]), **_angles(r)))
    return out


def _angles(r: np.ndarray) -> dict:
    """Angles of a rotation matrix as the fields of a plane."""
    return {"alpha": math.atan2(r[2, 1], r[2, 2]), "beta": -math.asin(max(-1.0, min(1.0, float(r[2, 0])))), "gamma": math.atan2(r[1, 0], r[0, 0])}


def _design(p: list[Column]) -> list[list[Column | None]]:
    """Change of a global hit position with three small rotations and three shifts; None is zero."""
    one = F.lit(1.0)
    return [[None, p[2], -p[1], one, None, None], [-p[2], None, p[0], None, one, None], [p[1], -p[0], None, None, None, one]]


def alignment_sums(rows: DataFrame) -> DataFrame:
    """Normal equations of the six parameters of each plane, as 21 + 6 plain sums.

    ``rows`` has per hit and track: dut, rotated local position px, py, pz, the
    plane's tx, ty, tz, a track point ox, oy, oz and unit direction sx, sy, sz.
    Distances are taken across the track: with L = 1 - s s', L is idempotent.
    """
    s = [F.col(f"s{a}") for a in "xyz"]
    cross = [[(1.0 if i == j else 0.0) - s[i] * s[j] for j in range(3)] for i in range(3)]
    m = _design([F.col(f"p{a}") for a in "xyz"])
    d = [F.col(f"o{a}") - F.col(f"p{a}") - F.col(f"t{a}") for a in "xyz"]
    lm = [[sum((cross[i][k] * m[k][j] for k in range(3) if m[k][j] is not None), F.lit(0.0)) for j in range(6)] for i in range(3)]
    dot = lambda a, v: F.sum(sum((m[i][a] * v[i] for i in range(3) if m[i][a] is not None), F.lit(0.0)))
    normal = [dot(a, [lm[i][b] for i in range(3)]).alias(f"n{a}{b}") for a in range(6) for b in range(a, 6)]
    right = [sum(cross[i][k] * d[k] for k in range(3)) for i in range(3)]
    return rows.groupBy("dut").agg(F.count("*").alias("n"), *normal, *(dot(a, right).alias(f"b{a}") for a in range(6)))


def alignment_solution(sums: dict, free: list[int]) -> np.ndarray:
    """Three turns and three shifts that solve a plane's normal equations for its ``free`` ones; the rest is zero."""
    a = np.array([[sums[f"n{min(i, j)}{max(i, j)}"] for j in range(6)] for i in range(6)])
    b = np.array([sums[f"b{i}"] for i in range(6)])
    step = np.zeros(6)
    step[free] = np.linalg.lstsq(a[np.ix_(free, free)], b[free], rcond=None)[0]
    return step


def moved_plane(plane: Plane, step: np.ndarray) -> Plane:
    """A plane after three small turns and three shifts in the global frame."""
    w = step[:3]
    r = (np.eye(3) + np.array([[0, -w[2], w[1]], [w[2], 0, -w[0]], [-w[1], w[0], 0]])) @ np.array(rotation(plane.alpha, plane.beta, plane.gamma))
    u, _, v = np.linalg.svd(r)
    return replace(plane, tx=plane.tx + float(step[3]), ty=plane.ty + float(step[4]), tz=plane.tz + float(step[5]), **_angles(u @ v))


def turned(planes: list[Plane], beam: tuple[float, float, float]) -> list[Plane]:
    """The planes after a rotation of the whole telescope towards the beam."""
    turn = np.array(rotation(*beam))
    out = []
    for p in planes:
        t = turn @ np.array([p.tx, p.ty, p.tz])
        out.append(replace(p, tx=float(t[0]), ty=float(t[1]), tz=float(t[2]), **_angles(turn @ np.array(rotation(p.alpha, p.beta, p.gamma)))))
    return out


def global_hits(hits: DataFrame, planes: list[Plane]) -> DataFrame:
    """Local x, y to global x, y, z; all other columns go along."""
    from hitloom.functions import geometry as G

    rows = G.with_geometry(hits, G.geometry(hits.sparkSession, planes).select("dut", "tx", "ty", "tz", *(f"r{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3))))
    g = G.to_global(F.col("x"), F.col("y"), F.lit(0.0))
    rest = [c for c in hits.columns if c not in ("x", "y")]
    return rows.select(*rest, *(v.alias(a) for v, a in zip(g, "xyz", strict=True)))


def moment_columns() -> list[Column]:
    """The aggregates of ``plane_moments``."""
    s, o, u = [F.col(f"s{a}") for a in "xyz"], [F.col(f"o{a}") for a in "xyz"], [F.col("lx"), F.col("ly"), F.lit(1.0)]
    across = [[(1.0 if i == j else 0.0) - s[i] * s[j] for j in range(3)] for i in range(3)]
    pairs = [(i, j) for i in range(3) for j in range(i, 3)]
    squares = [F.sum(across[i][j] * u[a] * u[b]).alias(f"s{i}{j}{a}{b}") for i, j in pairs for a, b in pairs]
    return squares + [F.sum(sum(across[i][k] * o[k] for k in range(3)) * u[a]).alias(f"t{i}{a}") for i in range(3) for a in range(3)]


def moment_totals(lx: np.ndarray, ly: np.ndarray, o: np.ndarray, s: np.ndarray) -> np.ndarray:
    """The sums of ``moment_columns`` over rows, in their order."""
    pairs = [(i, j) for i in range(3) for j in range(i, 3)]
    across = {(i, j): (1.0 if i == j else 0.0) - s[i] * s[j] for i, j in pairs}
    u = np.stack([lx, ly, np.ones(len(lx))])
    squares = np.stack([across[k] for k in pairs]) @ np.stack([u[a] * u[b] for a, b in pairs]).T
    moved = np.stack([sum(across[min(i, k), max(i, k)] * o[k] for k in range(3)) for i in range(3)]) @ u.T
    return np.r_[squares.ravel(), moved.ravel()]


MOMENTS = [f"s{i}{j}{a}{b}" for i in range(3) for j in range(i, 3) for a in range(3) for b in range(a, 3)] + [f"t{i}{a}" for i in range(3) for a in range(3)]


def plane_moments(selected: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """All that steps of a plane need of its tracks: ``S`` (3, 3, 3, 3) and ``T`` (3, 3) per dut, from one aggregate.

    ``selected`` has per track and plane the local hit lx, ly and the global line
    o*, s*. With u = (lx, ly, 1) a hit lies at A u, where A has the first two
    columns of the plane's rotation and its translation, and the squared distance
    across the track, L = 1 - s s', is quadratic in A. S[i, a, j, b] sums
    L[i, j] u[a] u[b] and T[i, a] sums (L o)[i] u[a].
    """
    return moments_of(selected.groupBy("dut").agg(*moment_columns()).collect())


def moments_of(rows: list) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """``plane_moments`` from its collected aggregates."""
    pairs, out = [(i, j) for i in range(3) for j in range(i, 3)], {}
    for r in rows:
        big = np.empty((3, 3, 3, 3))
        for i, j in pairs:
            for a, b in pairs:
                for k, m in {(i, j), (j, i)}:
                    for c, d in {(a, b), (b, a)}:
                        big[k, c, m, d] = r[f"s{i}{j}{a}{b}"]
        out[r["dut"]] = big, np.array([[r[f"t{i}{a}"] for a in range(3)] for i in range(3)])
    return out


def moment_sums(plane: Plane, big: np.ndarray, mixed: np.ndarray) -> dict:
    """The sums of ``alignment_sums`` for a plane where it stands now, from its moments."""
    at = np.array(rotation(plane.alpha, plane.beta, plane.gamma))
    at[:, 2] = plane.tx, plane.ty, plane.tz
    change = np.zeros((6, 3, 3))  # of A with three turns and three shifts
    for k in range(3):
        change[k, :, :2] = np.cross(np.eye(3)[k], at[:, :2].T).T
        change[3 + k, k, 2] = 1
    left = mixed - np.einsum("iajb,jb->ia", big, at)
    normal = np.einsum("kia,iajb,ljb->kl", change, big, change)
    right = np.einsum("kia,ia->k", change, left)
    return {f"n{a}{b}": normal[a, b] for a in range(6) for b in range(a, 6)} | {f"b{a}": right[a] for a in range(6)}


def fit_planes(known: dict[int, tuple[np.ndarray, np.ndarray]], planes: list[Plane], free: dict[int, list[int]], steps: int) -> tuple[list[Plane], int]:
    """Gauss-Newton steps for the planes of ``free`` until shifts fall below 1e-4 micrometres and turns below 1e-5, or ``steps`` are done.

    The steps need no more of the tracks than ``known``, the moments of each plane. A step is damped by 0.9, and by less down to 0.3 for a
    plane that swings back.
    """
    out, longest = [], 0
    for p in planes:
        damp, last = 0.9, np.zeros(6)
        for done in range(1, steps + 1) if p.dut in free and p.dut in known else ():
            longest = max(longest, done)
            step = alignment_solution(moment_sums(p, *known[p.dut]), free[p.dut])
            if float(step @ last) < 0:
                damp = max(0.3, damp - 0.2)
            last, p = step, moved_plane(p, damp * step)
            if np.abs(step[3:]).max() < 1e-4 and np.abs(step[:3]).max() < 1e-5:
                break
        out.append(p)
    return out, longest


def align(
    local_hits: DataFrame, planes: list[Plane], groups: list[list[int]], fit_duts: list[int], iterations: int = 3, free: tuple = (2, 3, 4), telescope: list[int] = (),
    max_chi_red: float | None = 10.0, shapes: tuple = (), quality: tuple[float, float] = (250.0, 250.0), isolation: tuple[float, float] | None = (500.0, 500.0),
    find: bool = True, steps: int = 8, tolerance: float = 1e-3,
) -> tuple[list[Plane], tuple[float, float, float], list[dict]]:
    """Planes and the beam's direction from tracks, one group of planes after another: ``(planes, beam, history)``.

    ``local_hits`` has event_number, ordinal, dut, x, y (local; null: no hit),
    x_err, y_err and, if ``shapes`` are named, cluster_shape. Each round for a
    group: the telescope is turned to the z axis if planes of the group belong
    to ``telescope``; from the second round on hits are associated anew in the
    frame of the beam; tracks are fitted for each plane of the group with all
    hits of ``fit_duts``, its residuals counted from their mode; tracks with a
    hit on the plane that is good and alone, a reduced chi2 below
    ``max_chi_red`` and a cluster of one of the ``shapes`` are selected; if fit
    planes are in the group their mean angles become the beam's; and the plane is
    moved along its ``free`` parameters (three turns, three shifts). State on
    the driver is the list of planes; hits are written once, the planes of a track side by side, a round writes
    its tracks so with their residuals and passes sums of the fits on, no rows.
    """
    from hitloom.operators.tracking import TRACK, LineFits, planes_in_arrays, residual_modes, tracks_found

    spark, beam, history = local_hits.sparkSession, (0.0, 0.0, 0.0), []
    ship(spark)
    scratch = Scratch(spark, "align")
    columns = ["x", "y", "x_err", "y_err", *(["cluster_shape"] if shapes else [])]
    hits = local_hits.select(*TRACK, "dut", *columns).where("x IS NOT NULL AND y IS NOT NULL")
    data = scratch.table(planes_in_arrays(hits, [p.dut for p in planes], columns), "wide")
    flags = ["hit_flag", "quality_flag", *(["isolated_track_flag", "isolated_hit_flag"] if isolation else [])]

    def sums_of(fits: pd.DataFrame) -> np.ndarray:
        """Number, angles and moments of the selected tracks of a plane."""
        bit = np.int64(1) << int(fits["fit_dut"].iloc[0])
        ok = np.logical_and.reduce([fits[c].to_numpy() & bit != 0 for c in flags])
        if max_chi_red:
            ok &= fits["chi_red"].to_numpy() < max_chi_red
        if shapes:
            ok &= fits["own_cluster_shape"].isin(shapes).to_numpy()
        lx, ly, *line = fits[["own_x", "own_y", *(f"{k}{a}" for k in "os" for a in "xyz")]].to_numpy(float)[ok].T
        o, s = np.array(line[:3]), np.array(line[3:])
        return np.r_[ok.sum(), np.arctan2(s[1], np.abs(s[2])).sum(), np.arctan2(-s[0], np.abs(s[2])).sum(), moment_totals(lx, ly, o, s)]

    for group in groups:
        wide = data
        for round_ in range(iterations):
            own = [d for d in group if d in telescope]
            if len(own) > 1:
                planes = align_telescope(planes, own, own[0])
            if find and round_:
                wide = scratch.table(tracks_found(data, turned(planes, beam), set(fit_duts)), "wide")
            fits = LineFits(planes, fit_duts, group, False, 3, quality, True, ["x", "y", *columns[4:]])
            fits.shift = residual_modes(fits.residuals(wide))
            fits.isolation = isolation
            # all that is needed of the tracks, from one pass over them
            rows = wide if isolation is None else wide.repartition(TRACK[0]).sortWithinPartitions(*TRACK)
            sums = fits.totals(rows, sums_of, ["n", "alpha", "beta", *MOMENTS]).where("n > 0").collect()
            if wide is not data:
                scratch.release(wide)
            n = sum(r["n"] for r in sums)
            if not n:
                break
            if set(group) & set(fit_duts):
                beam = (math.fsum(r["alpha"] for r in sums) / n, math.fsum(r["beta"] for r in sums) / n, 0.0)
            before = planes
            planes, done = fit_planes(moments_of(sums), planes, {d: list(free) for d in group}, steps)
            moved = max(max(abs(a.tx - b.tx), abs(a.ty - b.ty), abs(a.tz - b.tz)) for a, b in zip(planes, before, strict=True))
            history.append({"group": group, "round": round_, "tracks": int(n), "steps": done, "moved": moved})
            if moved < tolerance:
                break
    return planes, beam, history


def align_kalman(
    local_hits: DataFrame, planes: list[Plane], fixed: list[int], batches: int = 8, annealing: float = 1e4, errors: tuple = (50.0, 50.0, 0.0, 0.0, 0.0, 0.01),
    max_chi_red: float | None = None, deviation: float | None = 3.0,
) -> tuple[list[Plane], list[dict]]:
    """Kalman filter alignment by mini-batches of tracks: ``(planes, history)``.

    The filter knows six parameters of each plane in its own frame, three shifts
    and three turns, with ``errors`` (0: frozen). The sequential form takes one
    track after another; here a batch of events adds D'WD and D'Wr of the
    residuals of all its tracks as plain sums, for a fixed geometry, and one
    information-filter update follows. The measurement variance is raised by
    ``annealing`` at first and falls to one with the batches, so early, poorly
    known residuals weigh little. A track is fitted without the plane's own hit;
    tracks with a reduced chi2 (by the raised variance) above ``max_chi_red``
    are skipped, and an update that changes a parameter by more than
    ``deviation`` of its errors is rejected. Tracks are written once, their planes
    side by side, with a folder per batch, so that a batch reads only its own.
    """
    from hitloom.operators.tracking import TRACK, fit_tracks, planes_side_by_side

    spark = local_hits.sparkSession
    free = [i for i, e in enumerate(errors) if e > 0]
    cov = {p.dut: np.diag(np.square(np.array(errors)[free])) for p in planes}
    rows = local_hits.select(*TRACK, "dut", "x", "y", "x_err", "y_err").where("x IS NOT NULL AND y IS NOT NULL")
    duts, history = [p.dut for p in planes], []
    wide = planes_side_by_side(rows, duts, ["x", "y", "x_err", "y_err"]).withColumn("batch", F.pmod(F.xxhash64("event_number"), F.lit(batches)))
    data = Scratch(spark, "kalman-align").table(wide, "tracks", by="batch")
    for t in range(batches):
        heat = annealing ** ((batches - 1 - t) / max(1, batches - 1))
        fits = fit_tracks(data.where(F.col("batch") == t), planes, duts, [d for d in duts if d not in fixed], keep=["x", "y", "x_err", "y_err"], wide_rows=True).where("x IS NOT NULL")
        if max_chi_red is not None:
            fits = fits.where(F.col("chi_red") < max_chi_red * heat)
        u, v = F.col("offset_x"), F.col("offset_y")
        tu, tv, zero, one = F.col("slope_x") / F.col("slope_z"), F.col("slope_y") / F.col("slope_z"), F.lit(0.0), F.lit(1.0)
        change = [(-one, zero), (zero, -one), (tu, tv), (tu * v, tv * v), (-tu * u, -tv * u), (v, -u)]  # of the crossing point with each parameter
        weight = [1 / (F.col(f"{a}_err") ** 2 * heat) for a in "xy"]
        residual = [F.col("x") - u, F.col("y") - v]
        total = lambda a, b: F.sum(sum((weight[k] * a[k] * b[k] for k in (0, 1)), zero))  # noqa: B023, E731
        sums = fits.groupBy("fit_dut").agg(
            F.count("*").alias("n"), *(total(change[i], change[j]).alias(f"a{i}{j}") for i in free for j in free if i <= j), *(total(change[i], residual).alias(f"b{i}") for i in free),
        )
        for r in sums.collect():
            d = r["fit_dut"]
            info = np.array([[r[f"a{min(i, j)}{max(i, j)}"] for j in free] for i in free])
            new = np.linalg.inv(np.linalg.inv(cov[d]) + info)
            step = np.zeros(6)
            step[free] = new @ np.array([r[f"b{i}"] for i in free])
            kept = deviation is None or bool((np.abs(step[free]) <= deviation * np.sqrt(np.diag(cov[d]))).all())
            if kept:
                cov[d] = new
                planes = [_moved_in_frame(p, step) if p.dut == d else p for p in planes]
            history.append({"batch": t, "dut": d, "tracks": r["n"], "kept": kept} | dict(zip(("dx", "dy", "dz", "dalpha", "dbeta", "dgamma"), step.tolist(), strict=True)))
    return planes, history


def _moved_in_frame(p: Plane, step: np.ndarray) -> Plane:
    """A plane after three shifts and three small turns in its own frame."""
    r = np.array(rotation(p.alpha, p.beta, p.gamma))
    t, w = r @ step[:3], step[3:]
    u, _, v = np.linalg.svd(r @ (np.eye(3) + np.array([[0, -w[2], w[1]], [w[2], 0, -w[0]], [-w[1], w[0], 0]])))
    return replace(p, tx=p.tx + float(t[0]), ty=p.ty + float(t[1]), tz=p.tz + float(t[2]), **_angles(u @ v))
