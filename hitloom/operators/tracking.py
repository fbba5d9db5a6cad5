"""Track building and fitting.

Sums over the hits of a track are aggregates of Spark; what SQL cannot say (an
eigenvector, hit swapping inside an event, a Kalman smoother) runs as numpy on
Arrow batches of many tracks at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from hitloom.functions.geometry import Plane, rotation
from hitloom.operators.events import Neighbours, dealt, first_rows, gathered, map_events, whole_events
from hitloom.operators.histograms import density_modes
from hitloom.runtime import Scratch, ship

TRACK = ["event_number", "ordinal"]
#: Tracks whose events are searched together.
TOGETHER = 50_000


def line_fit(points: DataFrame, keys: list[str], x: str = "x", y: str = "y", z: str = "z") -> DataFrame:
    """Total least squares line per key: mean point ``o*``, unit direction ``s*`` with s_z >= 0, and ``n`` points.

    The scatter matrix is one partial aggregate; its first eigenvector is found
    for a whole batch at once. Points with a null coordinate do not count; a
    single point has no direction (null).
    """
    ship(points.sparkSession)
    known = points.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(z).isNotNull())
    pairs = {"xx": (x, x), "xy": (x, y), "xz": (x, z), "yy": (y, y), "yz": (y, z), "zz": (z, z)}
    sums = known.groupBy(*keys).agg(F.count("*").alias("n"), *(F.avg(c).alias(f"o{a}") for a, c in zip("xyz", (x, y, z), strict=True)), *(F.covar_pop(*p).alias(k) for k, p in pairs.items()))

    out = sums.withColumn("d", F.when(F.col("n") > 1, _direction()(*pairs)))
    return out.select(*keys, "n", "ox", "oy", "oz", "d.sx", "d.sy", "d.sz")


def planes_side_by_side(hits: DataFrame, duts: list[int], columns: list[str]) -> DataFrame:
    """One row per track with a struct ``h_<dut>`` of ``columns`` for each plane (null without a row), in the order of events and tracks.

    Rows are dealt by event at most once; the aggregate takes them as they stand.
    """
    at = lambda d: F.max(F.when(F.col("dut") == d, F.struct(*columns))).alias(f"h_{d}")
    rows = dealt(hits.where(F.col("dut").isin(duts)).select(*TRACK, "dut", *columns))
    return rows.where("place_ > 0").groupBy(*TRACK).agg(*map(at, duts)).sortWithinPartitions(*TRACK)


def planes_in_arrays(hits: DataFrame, duts: list[int], columns: list[str]) -> DataFrame:
    """The same with an array over ``duts`` for each of ``columns``: rows of few columns, which are cheap to pass on."""
    return planes_side_by_side(hits, duts, columns).select(*TRACK, *(F.array(*(F.col(f"h_{d}")[c] for d in duts)).alias(c) for c in columns))


def _direction():
    @F.pandas_udf("sx double, sy double, sz double")
    def direction(xx: pd.Series, xy: pd.Series, xz: pd.Series, yy: pd.Series, yz: pd.Series, zz: pd.Series) -> pd.DataFrame:
        v = first_axis(*(np.nan_to_num(np.asarray(c, float)) for c in (xx, xy, xz, yy, yz, zz)))
        v *= np.where(v[:, 2:] < 0, -1.0, 1.0)
        return pd.DataFrame(v, columns=["sx", "sy", "sz"])

    return direction


def first_axis(xx: np.ndarray, xy: np.ndarray, xz: np.ndarray, yy: np.ndarray, yz: np.ndarray, zz: np.ndarray) -> np.ndarray:
    """Unit eigenvectors (n, 3) of the largest eigenvalues of symmetric matrices: Jacobi rotations of all matrices at once, column by column."""
    a = {(0, 0): xx.copy(), (0, 1): xy.copy(), (0, 2): xz.copy(), (1, 1): yy.copy(), (1, 2): yz.copy(), (2, 2): zz.copy()}
    v = [[np.full(len(xx), float(i == j)) for j in range(3)] for i in range(3)]
    at = lambda i, j: (min(i, j), max(i, j))
    with np.errstate(divide="ignore", invalid="ignore", over="ignore", under="ignore"):
        for _ in range(12):
            scale = np.abs(a[0, 0]) + np.abs(a[1, 1]) + np.abs(a[2, 2])
            if not (np.abs(a[0, 1]) + np.abs(a[0, 2]) + np.abs(a[1, 2]) > 1e-17 * scale).any():
                break
            for p, q in ((0, 2), (1, 2), (0, 1)):
                off = a[p, q]
                theta = (a[q, q] - a[p, p]) / (2 * off)
                t = np.where(off == 0, 0.0, np.copysign(1.0, theta) / (np.abs(theta) + np.hypot(theta, 1.0)))
                c = 1 / np.sqrt(t * t + 1)
                s = t * c
                a[p, p], a[q, q], a[p, q] = a[p, p] - t * off, a[q, q] + t * off, np.zeros(len(off))
                r = 3 - p - q
                u, w = a[at(p, r)], a[at(q, r)]
                a[at(p, r)], a[at(q, r)] = c * u - s * w, s * u + c * w
                for row in v:
                    row[p], row[q] = c * row[p] - s * row[q], s * row[p] + c * row[q]
    best = 2 - np.argmax(np.stack([a[2, 2], a[1, 1], a[0, 0]]), axis=0)
    return np.stack([np.choose(best, row) for row in v], axis=1)


def fit_tracks(
    hits: DataFrame, planes: list[Plane], fit_duts: list[int], for_duts: list[int], exclude_own: bool = True, min_hits: int = 3,
    quality: tuple[float, float] = (1e9, 1e9), isolation: tuple[float, float] | None = None, use_limits: bool = False, centre: list[int] = (), keep: list[str] = (), wide_rows: bool = False,
) -> DataFrame:
    """Straight-line fits of long-form tracks: one row per (event, ordinal, fit_dut).

    ``hits`` has local positions x, y (null: no hit) with errors x_err, y_err
    per plane. A plane of ``for_duts`` is fitted from ``fit_duts``, without its
    own hit if ``exclude_own``. chi2 sums over fit planes; the flags cover all
    planes: a hit within ``quality`` (and the plane's limits), no other track
    of the event (fitted for the same plane) within ``isolation`` where the
    line crosses, no other hit. Residuals of planes in ``centre`` are counted
    from the mode of their density. offset_x, offset_y is where the line
    crosses the fitted plane, slope_* its unit direction there, both in the
    plane's frame; o*, s* are the line in the global frame. ``keep`` names
    columns of the fitted plane's own row that go along.

    Hits are dealt by event once (not at all if they stand so), the planes of a track
    stand side by side in a row, and a kernel fits the rows of a batch of whole
    events and looks for other tracks and hits near: neither fits nor pairs are
    written or shuffled. One event must fit into a task. The kernel is an opaque step of
    the plan, so results can be filtered by any column. ``wide_rows``: ``hits`` are rows of
    ``planes_side_by_side`` already (with ``isolation`` in the order of events, all of one in a task). With ``centre`` the rows of
    tracks are written, to be read for the modes first.
    A plane that a line never crosses has a null crossing and no quality bit; an
    error of zero makes chi2 null.
    """
    ship(hits.sparkSession)
    wide = hits if wide_rows else planes_side_by_side(hits, [p.dut for p in planes], list(dict.fromkeys(["x", "y", "x_err", "y_err", *keep])))
    fits = LineFits(planes, fit_duts, for_duts, exclude_own, min_hits, quality, use_limits, list(keep))
    if centre:  # written once, read for the modes and for the fits
        wide = Scratch(hits.sparkSession, "tracks").table(wide, "wide")
        fits.shift = residual_modes(LineFits(planes, fit_duts, list(centre), exclude_own, min_hits, quality, use_limits, []).residuals(wide))
        if isolation is not None:
            wide = wide.repartition(TRACK[0]).sortWithinPartitions(*TRACK)
    fits.isolation = isolation
    flags = ["hit_flag", "quality_flag", *(["isolated_track_flag", "isolated_hit_flag"] if isolation is not None else [])]
    return fits.apply(wide).select(*TRACK, "fit_dut", "n", "chi2", "chi_red", *flags, "offset_x", "offset_y", "slope_x", "slope_y", "slope_z", "ox", "oy", "oz", "sx", "sy", "sz", *(F.col(f"own_{k}").alias(k) for k in keep))


def residual_modes(residuals: DataFrame) -> dict[tuple[int, str], float]:
    """Modes by fitted plane and axis of :meth:`LineFits.residuals`, searched half a deviation around the medians; none for ten rows or fewer.

    The fits are done once for all planes and their residuals written; a mode per plane and axis reaches the driver.
    """
    scratch = Scratch(residuals.sparkSession, "residuals")
    written = scratch.table(residuals, "residuals")
    found = {(r["dut"], "xy"[r["axis"]]): r["mode"] for r in density_modes(written, ["dut", "axis"], "v", "w").collect()}
    scratch.release(written)
    return found


def line_ends(lines: DataFrame, planes: list[Plane]) -> DataFrame:
    """``lines`` (global point o*, direction s*) with ``first_*`` and ``last_*``: where they cross the planes of the smallest and largest z; null where a line runs along the plane."""
    ends = {"first": min(planes, key=lambda p: p.tz), "last": max(planes, key=lambda p: p.tz)}
    columns = {}
    for k, p in ends.items():
        normal = [row[2] for row in rotation(p.alpha, p.beta, p.gamma)]
        over, under = (sum(f(a, v, t) for a, v, t in zip("xyz", normal, (p.tx, p.ty, p.tz), strict=True)) for f in (lambda a, v, t: (F.lit(t) - F.col(f"o{a}")) * v, lambda a, v, t: F.col(f"s{a}") * v))
        run = F.when(under != 0, over / under)
        columns |= {f"{k}_{a}": F.col(f"o{a}") + run * F.col(f"s{a}") for a in "xyz"}
    return lines.withColumns(columns)


class LineFits:
    """Straight lines through the hits of tracks whose planes stand side by side, all tracks of a batch at once.

    Planes that are fitted from the same hits share their lines.
    """

    def __init__(self, planes: list[Plane], fit_duts: list[int], for_duts: list[int], exclude_own: bool, min_hits: int, quality: tuple[float, float], use_limits: bool, keep: list[str]):
        self.planes, self.fit_duts, self.for_duts = {p.dut: p for p in planes}, list(fit_duts), list(for_duts)
        self.exclude_own, self.min_hits, self.quality, self.use_limits, self.keep = exclude_own, min_hits, quality, use_limits, keep
        self.turn = {d: np.array(rotation(p.alpha, p.beta, p.gamma)) for d, p in self.planes.items()}
        self.place = {d: np.array([p.tx, p.ty, p.tz]) for d, p in self.planes.items()}
        self.shift: dict[tuple[int, str], float] = {}
        self.isolation: tuple[float, float] | None = None

    def apply(self, wide: DataFrame) -> DataFrame:
        """One row per track and fitted plane with at least ``min_hits`` hits; ``res_*`` is the own hit from the crossing.

        Flags of isolation need rows in the order of events, all of an event in one task.
        """
        flat = self.flat(wide)
        kinds = dict(flat.dtypes)
        double = ["chi2", "chi_red", "offset_x", "offset_y", "slope_x", "slope_y", "slope_z", "ox", "oy", "oz", "sx", "sy", "sz", "res_x", "res_y"]
        flags = ["hit_flag", "quality_flag", *(["isolated_track_flag", "isolated_hit_flag"] if self.isolation is not None else [])]
        ddl = [*(f"{k} {kinds[k]}" for k in TRACK), "fit_dut int, n int", *(f"{k} long" for k in flags), *(f"{k} double" for k in double)]
        ddl += [f"`own_{k}` {kinds[f'own_{k}_{self.for_duts[0]}']}" for k in self.keep]

        fields = to_arrow_schema(_parse_datatype_string(", ".join(ddl)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in self.frames(batches):
                for found in self.fit(b):
                    yield from pa.Table.from_arrays([pa.Array.from_pandas(found[f.name], type=f.type) for f in fields], schema=fields).to_batches()

        return flat.mapInArrow(run, ", ".join(ddl))

    def flat(self, wide: DataFrame, errors: bool = True) -> DataFrame:
        """What the fits read of the planes' structs, a column each, or of the arrays of ``planes_in_arrays``."""
        if "x" in wide.columns:
            return wide.select(*TRACK, "x", "y", *(["x_err", "y_err"] if errors else []), *(k for k in self.keep if k not in ("x", "y", "x_err", "y_err")))
        columns = {f"{c}_{d}": F.col(f"h_{d}")[c] for d in self.planes for c in ("x", "y")} | {f"{c}_{d}": F.col(f"h_{d}")[c] for d in self.fit_duts for c in ("x_err", "y_err")}
        columns |= {f"own_{k}_{d}": F.col(f"h_{d}")[k] for d in self.for_duts for k in self.keep}
        return wide.select(*TRACK, *(c.cast("double").alias(k) if not k.startswith("own_") else c.alias(k) for k, c in columns.items()))

    def frames(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        """Batches, of whole events where isolation is asked for, with a column for each part of a plane's hit."""
        for table in (pa.Table.from_batches([b]) for b in batches) if self.isolation is None else whole_events(batches, TRACK[0]):
            if not table.num_rows:
                continue
            if "x" not in table.column_names:
                yield table.to_pandas()
                continue
            parts = {c: table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1).T for c in table.column_names if c not in TRACK}
            columns = {f"{c}_{d}": v for c, rows in parts.items() for d, v in zip(self.planes, rows, strict=True)}
            yield pd.DataFrame({k: table.column(k).to_numpy() for k in TRACK} | columns | {f"own_{k}_{d}": columns[f"{k}_{d}"] for d in self.for_duts for k in self.keep if k in parts}, copy=False)

    def totals(self, wide: DataFrame, fn: Callable[[pd.DataFrame], np.ndarray], columns: list[str]) -> DataFrame:
        """Sums (dut, columns) of what ``fn`` finds in the rows of a fitted plane, as :meth:`apply` has them; tasks return a row per plane."""
        fields = to_arrow_schema(_parse_datatype_string("dut int, " + ", ".join(f"{c} double" for c in columns)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for b in self.frames(batches):
                for found in self.fit(b):
                    d = int(found["fit_dut"].iloc[0])
                    total[d] = total.get(d, 0.0) + fn(found)
            if total:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip([list(total), *np.array(list(total.values())).T], fields, strict=True)], schema=fields)

        found = self.flat(wide).mapInArrow(run, "dut int, " + ", ".join(f"{c} double" for c in columns))
        return found.groupBy("dut").agg(*(F.sum(c).alias(c) for c in columns))

    def residuals(self, wide: DataFrame) -> DataFrame:
        """Own hits from the crossings, (dut, axis, w, v), of tracks with at least ``min_hits`` hits; axes are 0 and 1, unknown values are left out and w is a pixel's error."""
        fields = to_arrow_schema(_parse_datatype_string("dut int, axis int, w double, v double"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in self.frames(batches):
                local, has, _ = self.hits(b)
                for d, some, _, _, m, s in self.lines(b, local, has):
                    away = local[d][some] - self.cross(d, m, s)[0]
                    for k, (v, size) in enumerate(zip(away.T, (self.planes[d].column_size, self.planes[d].row_size), strict=True)):
                        v = v[~np.isnan(v)]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), i), f.type) for i, f in zip((d, k, size / 12**0.5), fields, strict=False)] + [pa.array(v)], schema=fields)

        return self.flat(wide, errors=False).mapInArrow(run, "dut int, axis int, w double, v double")

    def hits(self, b: pd.DataFrame) -> tuple[dict, dict, np.ndarray]:
        """Local positions by plane, whether they are known, and these as bits."""
        local = {d: b[[f"x_{d}", f"y_{d}"]].to_numpy(float) for d in self.planes}
        has = {d: ~np.isnan(v).any(axis=1) for d, v in local.items()}
        return local, has, sum(has[d].astype(np.int64) << d for d in self.planes)

    def lines(self, b: pd.DataFrame, local: dict, has: dict) -> Iterator[tuple]:
        """For each fitted plane: the rows with enough hits, which hits are used and how many, mean points and directions."""
        points, known = {d: local[d] @ self.turn[d][:, :2].T + self.place[d] for d in self.fit_duts}, {}
        for d in self.for_duts:
            left_out = d if self.exclude_own and d in self.fit_duts else None
            if left_out not in known:
                used = {f: has[f] for f in self.fit_duts if f != left_out}
                n = sum((u.astype(int) for u in used.values()), np.zeros(len(b), int))
                some = np.flatnonzero((n >= self.min_hits) & (n > 0))
                used, n = {f: u[some] for f, u in used.items()}, n[some]
                known[left_out] = (some, used, n, *(self.line(used, n, {f: points[f][some] for f in used}) if len(some) else (None, None)))
            if len(known[left_out][0]):
                yield d, *known[left_out]

    def fit(self, b: pd.DataFrame) -> Iterator[pd.DataFrame]:
        local, has, hit_flag = self.hits(b)
        alone_hit, known = None, None
        if self.isolation is not None:
            round_ = {d: self.quality[0] >= 2.5 * p.column_size and self.quality[1] >= 2.5 * p.row_size for d, p in self.planes.items()}
            alone_hit = self.alone(b, local, round_)
        for d, some, used, n, m, s in self.lines(b, local, has):
            if known is None or known[0] is not m:  # planes that share their lines share where these cross
                known = m, b.iloc[some], {k: v[some] for k, v in local.items()}, {k: v[some] for k, v in has.items()}, {p: self.cross(p, m, s) for p in self.planes}
            _, own, near, there, crossing = known
            rows = self.row(d, own, used, n, hit_flag[some], m, s, near, there, crossing)
            if alone_hit is not None:
                rows = rows.assign(isolated_track_flag=self.alone(own, {p: v for p, (v, _) in crossing.items()}, dict.fromkeys(self.planes, True)), isolated_hit_flag=alone_hit[some])
            yield rows

    def alone(self, b: pd.DataFrame, at: dict, ellipse: dict[int, bool]) -> np.ndarray:
        """A bit per plane on which no other row of the event is within the isolation of a row's position; all bits of rows without one."""
        neighbours, bits = Neighbours(b[TRACK[0]].to_numpy()), np.zeros(len(b), np.int64)
        for d, v in at.items():
            bits |= (~neighbours.near(v[:, 0], v[:, 1], *map(float, self.isolation), ellipse[d])).astype(np.int64) << d
        return bits

    @staticmethod
    def line(used: dict, n: np.ndarray, points: dict) -> tuple[np.ndarray, np.ndarray]:
        """Mean point and unit direction (s_z >= 0) of the points with a true flag."""
        mean = sum(np.where(u[:, None], points[f], 0.0) for f, u in used.items()) / n[:, None]
        pairs = [(i, j) for i in range(3) for j in range(i, 3)]
        second = [np.zeros(len(n)) for _ in pairs]
        for f, u in used.items():
            away = [np.where(u, points[f][:, i] - mean[:, i], 0.0) for i in range(3)]
            for k, (i, j) in enumerate(pairs):
                second[k] += away[i] * away[j]
        s = first_axis(*second)
        return mean, s * np.where(s[:, 2:] < 0, -1.0, 1.0)

    def cross(self, d: int, m: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where lines cross a plane, in its frame, and their directions there (third part >= 0)."""
        r, t = self.turn[d], self.place[d]
        under = s @ r[:, 2]
        k = ((t - m) @ r[:, 2]) / np.where(under != 0, under, np.nan)
        own = s @ r
        return (m + k[:, None] * s - t) @ r[:, :2], own * np.where(own[:, 2:] < 0, -1.0, 1.0)

    def row(self, d: int, b: pd.DataFrame, used: dict, n: np.ndarray, hit_flag: np.ndarray, m: np.ndarray, s: np.ndarray, local: dict, has: dict, crossing: dict) -> pd.DataFrame:
        """The rows of a fitted plane from where the lines cross each plane."""
        chi2, good = np.zeros(len(b)), np.zeros(len(b), np.int64)
        for p, plane in self.planes.items():
            residual = local[p] - crossing[p][0]
            residual = residual - [self.shift.get((p, a), 0.0) for a in "xy"]
            if p in used:
                error = b[[f"x_err_{p}", f"y_err_{p}"]].to_numpy(float)
                pull = residual / np.where(error != 0, error, np.nan)
                chi2 += np.where(used[p], pull[:, 0] ** 2 + pull[:, 1] ** 2, 0.0)
            good |= (has[p] & self.inside(plane, residual, local[p])).astype(np.int64) << p
        out = {k: b[k].to_numpy() for k in TRACK} | {"fit_dut": d, "n": n, "hit_flag": hit_flag, "quality_flag": good, "chi2": chi2}
        out["chi_red"] = np.where(n > 2, chi2 / (2.0 * np.maximum(n - 2, 1)), np.nan)
        groups = {"offset_": crossing[d][0], "slope_": crossing[d][1], "o": m, "s": s, "res_": local[d] - crossing[d][0]}
        out |= {f"{k}{a}": v[:, i] for k, v in groups.items() for i, a in enumerate("xyz"[: v.shape[1]])}
        return pd.DataFrame(out | {f"own_{k}": b[f"own_{k}_{d}"].to_numpy() for k in self.keep})

    def inside(self, p: Plane, residual: np.ndarray, hit: np.ndarray) -> np.ndarray:
        """Within the quality cut (``in_window`` of batches) and the plane's limits."""
        ax, ay = map(float, self.quality)
        u, v = residual[:, 0], residual[:, 1]
        ok = (u / ax) ** 2 + (v / ay) ** 2 <= 1 if ax >= 2.5 * p.column_size and ay >= 2.5 * p.row_size else (np.abs(u) <= ax) & (np.abs(v) <= ay)
        if self.use_limits:
            for i, (lo, hi) in enumerate(((p.x_lo, p.x_hi), (p.y_lo, p.y_hi))):
                ok = ok & (True if lo is None else hit[:, i] >= lo) & (True if hi is None else hit[:, i] <= hi)
        return ok


class Finder:
    """Re-association of the hits of many events with equally many rows, plane by plane downstream.

    While a plane is worked on, the rows' upstream hits stand still: where each
    row leads to, and its distance to each of the plane's hits, are found once
    for all events. Rows are then settled one after another, in all events at
    once, by exchanging which hit of the plane each row holds.
    """

    #: Distances that are held at once.
    ROOM = 4_000_000

    def __init__(self, planes: list[Plane], extrapolate: set[int] | None = None):
        self.planes = sorted(planes, key=lambda p: p.tz)
        self.usable = [extrapolate is None or p.dut in extrapolate for p in self.planes]
        self.points = np.array([[p.tx, p.ty, p.tz] for p in self.planes])
        self.normals = np.array([[row[2] for row in rotation(p.alpha, p.beta, p.gamma)] for p in self.planes])

    def expect(self, pos: np.ndarray, k: int) -> np.ndarray:
        """Where rows' upstream hits lead to on plane ``k`` (nan: nowhere): the line of the two nearest usable ones, else the first hit."""
        shape = pos.shape[:-2]
        first, near, far = (np.full((*shape, 3), np.nan) for _ in range(3))
        found = np.zeros(shape, int)  # usable hits so far, going upstream
        for r in range(k - 1, -1, -1):
            have = ~np.isnan(pos[..., r, 0])
            first[have] = pos[..., r, :][have]
            if self.usable[r]:
                near[have & (found == 0)] = pos[..., r, :][have & (found == 0)]
                far[have & (found == 1)] = pos[..., r, :][have & (found == 1)]
                found += have
        run = near - far
        with np.errstate(invalid="ignore", divide="ignore"):
            step = (self.points[k] - near) @ self.normals[k] / (run @ self.normals[k])
        return np.where((found >= 2)[..., None], (near + step[..., None] * run)[..., :2], first[..., :2])

    def solve(self, pos: np.ndarray) -> np.ndarray:
        """``pos`` is events x rows x planes (z order) x 3 with nan for no hit, changed in place; returns the row each hit came from."""
        events, n = pos.shape[:2]
        source = np.tile(np.arange(n)[None, :, None], (events, 1, len(self.planes)))
        if n > 1:
            size = max(1, self.ROOM // (n * n))
            for lo in range(0, events, size):
                part = slice(lo, lo + size)
                for k in range(1, len(self.planes)):
                    held = self._plane(pos[part], k)
                    for table in (pos, source):
                        own = held if table[part, :, k].ndim == 2 else held[..., None]
                        table[part, :, k] = np.take_along_axis(table[part, :, k], own, axis=1)
        return source

    def _plane(self, pos: np.ndarray, k: int) -> np.ndarray:
        """For each event and row the row whose hit on plane ``k`` it holds in the end."""
        events, n = pos.shape[:2]
        goal = self.expect(pos, k)
        leads = ~np.isnan(goal[..., 0])
        off = np.hypot(goal[:, :, None, 0] - pos[:, None, :, k, 0], goal[:, :, None, 1] - pos[:, None, :, k, 1])  # row, hit
        held = np.tile(np.arange(n), (events, 1))
        row = np.arange(n)
        for first in range(n):
            e = np.flatnonzero(leads[:, first])
            t = np.full(len(e), first)
            while len(e):
                mine = held[e]
                gap = np.take_along_axis(off[e, t], mine, axis=1)  # row t to the hit of each row
                own = np.take_along_axis(off[e], mine[:, :, None], axis=2)[:, :, 0]  # each row to its hit
                now = gap[np.arange(len(e)), t]
                with np.errstate(invalid="ignore"):
                    free = ~np.isnan(gap) & (row != t[:, None]) & ~(now[:, None] < gap) & ~(leads[e] & (gap > own))
                best = np.where(free, gap, np.inf)
                chosen = n - 1 - best[:, ::-1].argmin(axis=1)  # the last of equally near ones
                swap = free[np.arange(len(e)), chosen]
                e, t, chosen = e[swap], t[swap], chosen[swap]
                held[e, t], held[e, chosen] = held[e, chosen], held[e, t]
                again = (chosen < t) & leads[e, chosen]
                e, t = e[again], chosen[again]
        return held


def find_tracks(hits: DataFrame, planes: list[Plane], extrapolate: set[int] | None = None, keep: list[str] = ()) -> DataFrame:
    """Long-form rows with a new ``ordinal`` per hit: which track of the event it belongs to (``was`` is the old one); columns ``keep`` go along.

    Positions are global. Rows are dealt by event once; the events of a batch
    with equally many rows are worked on together.
    """
    finder = Finder(planes, extrapolate)
    rank = {p.dut: i for i, p in enumerate(finder.planes)}

    def fn(batch: pd.DataFrame) -> pd.DataFrame:
        event, old, xyz = batch["event_number"].to_numpy(), batch["ordinal"].to_numpy(), batch[["x", "y", "z"]].to_numpy(float)
        new, k = old.copy(), batch["dut"].map(rank).to_numpy()
        heads = first_rows(event, old)  # rows of a track stand together
        track = np.cumsum(heads) - 1
        start = np.flatnonzero(first_rows(event))
        group = np.cumsum(first_rows(event)) - 1
        t = track - track[start][group]
        sizes = np.diff(np.r_[track[start], track[-1] + 1])
        names = old[heads]
        for n in np.unique(sizes[sizes > 1]):
            events = np.flatnonzero(sizes == n)
            at = np.full(len(sizes), -1)
            at[events] = np.arange(len(events))
            own = np.flatnonzero(sizes[group] == n)
            pos = np.full((len(events), n, len(rank), 3), np.nan)
            pos[at[group[own]], t[own], k[own]] = xyz[own]
            source = finder.solve(pos)
            target = np.empty_like(source)
            np.put_along_axis(target, source, np.broadcast_to(np.arange(n)[None, :, None], source.shape), axis=1)
            new[own] = names[track[start][group[own]] + target[at[group[own]], t[own], k[own]]]
        return pd.DataFrame({"event_number": event, "ordinal": new, "dut": batch["dut"], "was": old, "x": batch["x"], "y": batch["y"], "z": batch["z"]} | {k: batch[k] for k in keep})

    schema = "event_number long, ordinal int, dut int, was int, x double, y double, z double"
    schema += "".join(f", `{k}` {dict(hits.dtypes)[k]}" for k in keep)
    rows = hits.where(F.col("dut").isin(list(rank))).select(*TRACK, "dut", "x", "y", "z", *keep)
    return map_events(rows, fn, schema, order=("ordinal", "dut"))


def tracks_found(wide: DataFrame, planes: list[Plane], extrapolate: set[int] | None = None) -> DataFrame:
    """Rows of ``planes_in_arrays`` of local hits, in the order of ``planes``, with the hits that ``find_tracks`` gives to them.

    Rows are dealt by event once; all that is known of a hit goes with it.
    """
    finder = Finder(planes, extrapolate)
    places, turn, fields = [planes.index(p) for p in finder.planes], [np.array(rotation(p.alpha, p.beta, p.gamma)) for p in finder.planes], to_arrow_schema(wide.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in map(pa.Table.combine_chunks, gathered(whole_events(batches, TRACK[0]), TOGETHER)):
            rows = table.num_rows
            parts = {f.name: table.column(f.name).combine_chunks().flatten() for f in fields if f.name not in TRACK}
            x, y = (parts[c].to_numpy(zero_copy_only=False).astype(float).reshape(rows, -1)[:, places] for c in "xy")
            at = np.empty((rows, len(turn), 3))
            for k, r in enumerate(turn):
                for i in range(3):
                    at[:, k, i] = r[i, 0] * x[:, k] + r[i, 1] * y[:, k] + r[i, 2] * 0.0 + finder.points[k, i]
            start = np.flatnonzero(first_rows(table.column(TRACK[0]).to_numpy()))
            sizes = np.diff(np.r_[start, rows])
            came = np.tile(np.arange(rows)[:, None], len(turn))
            for n in np.unique(sizes[sizes > 1]):
                own = start[sizes == n][:, None] + np.arange(n)
                came[own] = own[:, :1, None] + finder.solve(at[own])
            came[:, places] = came.copy()
            taken = pa.array((came * len(turn) + np.arange(len(turn))).ravel())
            ends = pa.array(np.arange(rows + 1, dtype=np.int32) * len(turn))
            found = {c: pa.ListArray.from_arrays(ends, v.take(taken)) for c, v in parts.items()}
            yield from pa.Table.from_arrays([found[f.name].cast(f.type) if f.name in found else table.column(f.name) for f in fields], schema=fields).to_batches()

    ship(wide.sparkSession)
    return dealt(wide).where("place_ > 0").select(*wide.columns).mapInArrow(run, wide.schema)


def times(*parts: np.ndarray) -> np.ndarray:
    """Product of stacks of small matrices, entry by entry over all of a stack: far faster than a matrix at a time."""
    out = parts[0]
    for m in parts[1:]:
        n = max(len(out) if out.ndim == 3 else 1, len(m) if m.ndim == 3 else 1)
        found = np.empty((out.shape[-2], m.shape[-1], n))
        for i in range(out.shape[-2]):
            for j in range(m.shape[-1]):
                terms = [out[..., i, k] * m[..., k, j] for k in range(m.shape[-2]) if out.ndim == 3 or out[i, k] if m.ndim == 3 or m[k, j]]  # zeros of a fixed matrix add nothing
                found[i, j] = sum(terms[1:], terms[0]) if terms else 0.0
        out = found.transpose(2, 0, 1)
    return out


def inverse(m: np.ndarray) -> np.ndarray:
    """Inverses of a stack of 2 x 2 matrices, or of positive ones of 4 x 4 by blocks."""
    out = np.empty((m.shape[1], m.shape[2], len(m)))
    if m.shape[1] == 2:
        a, b, c, d = m[:, 0, 0], m[:, 0, 1], m[:, 1, 0], m[:, 1, 1]
        det = a * d - b * c
        out[0, 0], out[0, 1], out[1, 0], out[1, 1] = d / det, -b / det, -c / det, a / det
        return out.transpose(2, 0, 1)
    a, b, c, d = m[:, :2, :2], m[:, :2, 2:], m[:, 2:, :2], m[:, 2:, 2:]
    own = inverse(a)
    left, right = times(own, b), times(c, own)
    rest = inverse(d - times(c, left))
    upper = -times(left, rest)
    parts = own - times(upper, right), upper, -times(rest, right), rest
    for (i, j), part in zip(((0, 0), (0, 2), (2, 0), (2, 2)), parts, strict=True):
        out[i : i + 2, j : j + 2] = part.transpose(1, 2, 0)
    return out.transpose(2, 0, 1)


class Smoother:
    """Kalman filter and Rauch-Tung-Striebel smoother for many tracks at once.

    The state at a plane is (x, y, dx/dz, dy/dz) where the track passes the
    plane's centre in z. A measurement is the local position of the crossing
    point; its derivatives are taken at the predicted state. Scattering widens
    the slopes behind each plane (Highland's formula along the inclined path).
    """

    def __init__(self, planes: list[Plane], fit_duts: set[int], energy: float = 5000.0, mass: float = 0.511):
        self.planes = sorted(planes, key=lambda p: p.tz)
        if any(p.material_budget <= 0 for p in self.planes[:-1]):
            raise ValueError("each plane before the last needs a material budget")
        self.used = [p.dut in fit_duts for p in self.planes]
        momentum = (energy**2 - mass**2) ** 0.5
        self.pbeta = momentum * momentum / energy
        self.axes = np.array([rotation(p.alpha, p.beta, p.gamma) for p in self.planes])

    def measure(self, k: int, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Local crossing point (n, 2) and its derivatives (n, 2, 4)."""
        p, axes = self.planes[k], self.axes[k]
        d = np.column_stack([s[:, 2], s[:, 3], np.ones(len(s))])
        away = np.column_stack([s[:, 0] - p.tx, s[:, 1] - p.ty, np.zeros(len(s))])
        slant = d @ axes[:, 2]
        run = -(away @ axes[:, 2]) / slant
        local = (away + run[:, None] * d) @ axes[:, :2]
        h = np.empty((2, 4, len(s))).transpose(2, 0, 1)
        for j in (0, 1):
            move = -axes[j, 2] / slant  # change of the run with the position
            along = axes[j, :2] + move[:, None] * (d @ axes[:, :2])
            h[:, :, j] = along
            h[:, :, j + 2] = run[:, None] * along
        return local, h

    def scatter(self, k: int, s: np.ndarray) -> np.ndarray:
        q = np.zeros((4, 4, len(s))).transpose(2, 0, 1)
        tx, ty = s[:, 2], s[:, 3]
        length = 1 + tx * tx + ty * ty
        x = self.planes[k].material_budget * np.sqrt(length)
        if self.planes[k].material_budget > 0:
            var = (13.6 / self.pbeta * np.sqrt(x) * (1 + 0.038 * np.log(x))) ** 2 * length
            q[:, 2, 2], q[:, 3, 3] = var * (1 + tx * tx), var * (1 + ty * ty)
            q[:, 2, 3] = q[:, 3, 2] = var * tx * ty
        return q

    def run(self, meas: np.ndarray, err: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Smoothed states (n, planes, 4), their covariances and each plane's chi2; ``meas`` has nan where there is no hit."""
        n, m = len(meas), len(self.planes)
        s, c = seed.copy(), np.repeat(np.diag([2e2, 2e2, 9e-6, 9e-6])[None], n, axis=0)
        filtered, before = [], []
        for k in range(m):
            if k:
                f = np.eye(4)
                f[0, 2] = f[1, 3] = self.planes[k].tz - self.planes[k - 1].tz
                c = times(f, c + self.scatter(k - 1, s), f.T)
                s = s @ f.T
            else:
                f = None
            before.append((f, s, c))
            if self.used[k]:
                have = ~np.isnan(meas[:, k, 0])
                local, h = self.measure(k, s)
                v = np.zeros((2, 2, n)).transpose(2, 0, 1)
                v[:, 0, 0], v[:, 1, 1] = err[:, k, 0] ** 2, err[:, k, 1] ** 2
                ht = h.transpose(0, 2, 1)
                across = times(c, ht)
                gain = times(across, inverse(np.where(have[:, None, None], times(h, across) + v, np.eye(2))))
                gain[~have] = 0
                diff = np.where(have[:, None], np.nan_to_num(meas[:, k]) - local, 0.0)
                s = s + times(gain, diff[:, :, None])[:, :, 0]
                c = c - times(gain, times(h, c))
            filtered.append((s, c))
        states, covs = np.empty((m, 4, n)).transpose(2, 0, 1), np.empty((m, 4, 4, n)).transpose(3, 0, 1, 2)
        states[:, -1], covs[:, -1] = filtered[-1]
        for k in range(m - 2, -1, -1):
            f, s1, c1 = before[k + 1]
            s, c = filtered[k]
            g = times(c, f.T, inverse(c1))  # slopes before the plane's own scattering
            states[:, k] = s + times(g, (states[:, k + 1] - s1)[:, :, None])[:, :, 0]
            covs[:, k] = c + times(g, covs[:, k + 1] - c1, g.transpose(0, 2, 1))
        chi2 = np.full((n, m), np.nan)
        for k in range(m):
            local, h = self.measure(k, states[:, k])
            v = np.zeros((2, 2, n)).transpose(2, 0, 1)
            v[:, 0, 0], v[:, 1, 1] = err[:, k, 0] ** 2, err[:, k, 1] ** 2
            spread = times(h, covs[:, k], h.transpose(0, 2, 1))
            r = meas[:, k] - local
            cov = v - spread if self.used[k] else v + spread
            chi2[:, k] = times(r[:, None, :], inverse(cov), r[:, :, None])[:, 0, 0]
        return states, covs, chi2


def kalman_fit(hits: DataFrame, planes: list[Plane], fit_duts: list[int], min_hits: int = 3, energy: float = 5000.0, mass: float = 0.511) -> DataFrame:
    """Smoothed track per plane: offset_x, offset_y, slope_x, slope_y, chi2, chi_red and p of the track.

    ``hits`` has local positions x, y (null: no hit) with errors x_err, y_err.
    The seed is the straight line through the first and last fit hit.
    """
    ship(hits.sparkSession)
    smoother = Smoother(planes, set(fit_duts), energy, mass)
    order = [p.dut for p in smoother.planes]
    known = planes_side_by_side(hits, order, ["x", "y", "x_err", "y_err"])
    there = [F.col(f"h_{d}")["x"].isNotNull().cast("int") for d in order if d in fit_duts]
    columns = {c: [f"{c}_{d}" for d in order] for c in ("x", "y", "x_err", "y_err")}
    tracks = known.withColumn("n", sum(there[1:], there[0]).cast("long")).where(F.col("n") >= min_hits)
    tracks = tracks.select(*TRACK, "n", *(F.col(f"h_{d}")[c].alias(f"{c}_{d}") for c in columns for d in order))
    axes, centre = smoother.axes, np.array([[p.tx, p.ty, p.tz] for p in smoother.planes])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            both = lambda *names: np.stack([b[columns[c]].to_numpy(float) for c in names], axis=2)  # noqa: B023, E731
            meas, err = both("x", "y"), np.nan_to_num(both("x_err", "y_err"), nan=1.0)
            glob = np.einsum("kij,nkj->nki", axes[:, :, :2], meas) + centre
            ok = ~np.isnan(meas[:, :, 0]) & np.array(smoother.used)
            first, last = ok.argmax(axis=1), len(order) - 1 - ok[:, ::-1].argmax(axis=1)
            i = np.arange(len(b))
            a, z = glob[i, first], glob[i, last]
            slope = (z - a)[:, :2] / (z - a)[:, 2:]
            seed = np.column_stack([a[:, :2] + slope * (centre[0, 2] - a[:, 2])[:, None], slope])
            states, _, chi2 = smoother.run(meas, err, seed)
            total = np.where(ok, chi2, 0.0).sum(axis=1)
            at = np.tile(order, len(b))
            flat = lambda j: states[:, :, j].ravel()
            rep = lambda v: np.repeat(np.asarray(v), len(order))
            yield pd.DataFrame({"event_number": rep(b["event_number"]), "ordinal": rep(b["ordinal"]), "fit_dut": at, "n": rep(b["n"]), "offset_x": flat(0), "offset_y": flat(1), "slope_x": flat(2), "slope_y": flat(3), "chi2": rep(total), "p": rep(upper_tail(total, b["n"].to_numpy() - 2))})

    schema = "event_number long, ordinal int, fit_dut int, n long, offset_x double, offset_y double, slope_x double, slope_y double, chi2 double, p double"
    out = tracks.mapInPandas(run, schema)
    return out.withColumn("chi_red", F.col("chi2") / (2 * F.col("n") - 4)).select(*(c for c in out.columns if c != "p"), "chi_red", "p")


def upper_tail(chi2: np.ndarray, half: np.ndarray) -> np.ndarray:
    """``chi2_pvalue`` for twice ``half`` degrees of freedom, once a track; nan without any."""
    term, total = np.ones(len(chi2)), np.zeros(len(chi2))
    for k in range(1, int(half.max(initial=0)) + 1):
        total += np.where(k <= half, term, 0.0)
        term = term * (chi2 / 2) / k
    return np.where(half > 0, np.exp(-chi2 / 2) * total, np.nan)
