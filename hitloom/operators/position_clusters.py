"""Hits at real-valued positions to clusters: neighbours of an event within a reach, components, one row per cluster."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StructType

from hitloom.operators.events import EVENT, compact, dealt, first_rows, label_components, whole_events
from hitloom.runtime import ship

#: A cell's side by the reach: a little over a half, so that hits of one cell are neighbours and neighbours are two cells apart at most, whatever is rounded.
SIDE = 0.5 + 1e-7
#: Pairs of hits that are compared at a time.
PAIRS = 2_000_000


def _any_near(first: np.ndarray, count: np.ndarray, at: np.ndarray, reach: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which cell pairs ``a, b`` hold two hits within reach, by comparing their hits."""
    out = np.zeros(len(a), bool)
    size = count[a] * count[b]
    for part in np.split(np.arange(len(a)), np.flatnonzero(np.diff(np.cumsum(size) // PAIRS)) + 1):
        n = size[part]
        pair = np.repeat(np.arange(len(part)), n)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        wide = count[b[part]][pair]
        near = (np.abs(at[first[a[part]][pair] + k // wide] - at[first[b[part]][pair] + k % wide]) <= reach).all(axis=1)
        out[part[np.unique(pair[near])]] = True
    return out


def number_by_position(event: np.ndarray, dut: np.ndarray, at: list[np.ndarray], reach: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """Cluster of each hit, numbered in its event and plane by first hits, and how many there are; rows stand by event, plane and ordinal.

    Cells of half the reach are the vertices: hits of one cell are connected,
    and two cells that are at most two steps apart are if any of their hits are.
    That is decided by the boxes around their hits where these allow it; of the
    other cells only those are compared hit by hit that are not connected yet.
    """
    group = np.cumsum(first_rows(event, dut)) - 1
    place = np.stack(at, axis=1).astype(float)
    # without a reach only equal values meet: their ranks stand three cells apart
    steps = [np.floor(c / (d * SIDE)).astype(np.int64) if d else 3 * np.unique(c, return_inverse=True)[1] for c, d in zip(place.T, reach, strict=True)]
    cells, own, count = np.unique(np.stack([group, *steps], axis=1), axis=0, return_inverse=True, return_counts=True)
    own = own.ravel()
    by_cell = np.argsort(own, kind="stable")
    first = np.cumsum(count) - count
    at_cell = place[by_cell]
    low, high = np.minimum.reduceat(at_cell, first), np.maximum.reduceat(at_cell, first)
    reached = np.array(reach, float)
    # cells as ordered numbers, with room for two steps at both ends; where they do not fit into a number, steps between groups and far cells are cut to three
    spread = cells - cells.min(axis=0)
    if np.prod((spread.max(axis=0, initial=0) + 5).astype(float)) > 2.0**62:
        spread = np.stack([compact(c) for c in cells.T], axis=1)
    room = spread.max(axis=0, initial=0) + 5
    factor = np.r_[np.cumprod(room[:0:-1])[::-1], 1]
    key = (spread + 2) @ factor  # ascending, as the cells are
    left, right = [], []
    for offset in np.ndindex(*[5] * len(at)):
        move = np.array(offset) - 2
        if tuple(move) <= (0,) * len(at):
            continue
        wanted = key + int(move @ factor[1:])
        b = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
        a = np.flatnonzero(key[b] == wanted)
        b = b[a]
        left.append(a)
        right.append(b)
    # cells in the order of their first hits, so that the smallest label is the first; groups stand one after the other
    by_first = np.argsort(by_cell[first])
    rank = np.empty_like(by_first)
    rank[by_first] = np.arange(len(by_first))
    a, b = np.concatenate(left), np.concatenate(right)
    near = (np.maximum(high[a] - low[b], high[b] - low[a]) <= reached).all(axis=1)
    root = label_components(len(cells), rank[a[near]], rank[b[near]])
    unsure = np.flatnonzero(~near & (np.maximum(low[a] - high[b], low[b] - high[a]) <= reached).all(axis=1) & (root[rank[a]] != root[rank[b]]))
    near[unsure] = _any_near(first, count, at_cell, reached, a[unsure], b[unsure])
    root = label_components(len(cells), rank[a[near]], rank[b[near]])
    tops = np.flatnonzero(root == np.arange(len(root)))
    starts = np.flatnonzero(first_rows(cells[by_first][tops, 0]))
    counts = np.diff(np.r_[starts, len(tops)])
    number = np.empty(len(root), np.int32)
    number[tops] = np.arange(len(tops)) - np.repeat(starts, counts)
    return number[root[rank[own]]], counts[group].astype(np.int32)


def position_cluster_ids(hits: DataFrame, d_x: float, d_y: float, d_frame: int | None = None) -> DataFrame:
    """``hits`` with the number of their cluster in the event, counted in the order of first hits, and ``n_cluster``.

    Two hits are neighbours if x, y and (if given) frame differ by no more than
    the given distances. Hits without a position are left out; an empty table
    gives an empty one. Events are dealt to tasks, in which whole batches of
    them are joined up at once; one event must fit into a task.
    """
    schema = StructType([*hits.schema.fields]).add("cluster_id", IntegerType()).add("n_cluster", IntegerType())
    return _by_events(hits, d_x, d_y, d_frame, lambda t: t, schema)


def position_clusters(hits: DataFrame, d_x: float, d_y: float, d_frame: int | None = None, weighted: bool = False, charge_correction: float = 0.0) -> DataFrame:
    """The rows of ``build_position_clusters`` of ``position_cluster_ids``, built where the hits are numbered: hits are dealt by event once and not shuffled again."""
    schema = build_position_clusters(position_cluster_ids(hits, d_x, d_y, d_frame), weighted, charge_correction).schema
    return _by_events(hits, d_x, d_y, d_frame, lambda t: _built(t, weighted, charge_correction), schema)


def _by_events(hits: DataFrame, d_x: float, d_y: float, d_frame: int | None, fn: Callable[[pa.Table], pa.Table], schema: StructType) -> DataFrame:
    """What ``fn`` makes of batches of whole events with ``cluster_id`` and ``n_cluster``; rows that come dealt by event are not dealt again."""
    fields = to_arrow_schema(schema)
    axes = {"x": d_x, "y": d_y} | ({} if d_frame is None else {"frame": d_frame})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_events(batches, "event_number"):
            get = lambda c: table.column(c).to_numpy()  # noqa: B023, E731
            ids, n = number_by_position(get("event_number"), get("dut"), [get(c) for c in axes], list(axes.values()))
            found = fn(table.append_column("cluster_id", pa.array(ids)).append_column("n_cluster", pa.array(n)))
            yield from pa.Table.from_arrays([found.column(f.name).cast(f.type) for f in fields], schema=fields).to_batches()

    ship(hits.sparkSession)
    known = hits.where(F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y"))
    return dealt(known, order=("dut", "ordinal")).mapInArrow(run, schema)


def _built(hits: pa.Table, weighted: bool, charge_correction: float) -> pa.Table:
    """``build_position_clusters`` of whole events."""
    charge, unknown = hits.column("charge").to_numpy().astype(float), hits.column("charge").is_null().to_numpy()
    rank = np.where(np.isnan(charge) & ~unknown, np.inf, np.nan_to_num(charge))  # as Spark orders them: null, numbers, nan
    keys = [hits.column(c).to_numpy() for c in (*EVENT, "cluster_id")]
    order = np.lexsort((hits.column("ordinal").to_numpy(), -rank, unknown, *keys[::-1]))
    heads = first_rows(*(k[order] for k in keys))
    hits, seeds = hits.take(pa.array(order)), np.flatnonzero(heads)
    w = pc.add(hits.column("charge").cast(pa.float64()), charge_correction) if weighted else pa.array(np.ones(len(order)))
    rows = {c: hits.column(c) for c in ("x", "y", "charge", "frame")} | {"g": pa.array(np.cumsum(heads)), "w": w} | {f"w{c}": pc.multiply(w, hits.column(c)) for c in "xy"}
    found = pa.table(rows).group_by("g", use_threads=False).aggregate([("g", "count"), ("charge", "sum"), ("w", "sum"), ("frame", "min"), *((c, f) for c in "xy" for f in ("min", "max")), ("wx", "sum"), ("wy", "sum")])
    first = hits.take(pa.array(seeds))
    under = found.column("w_sum")
    under = pc.if_else(pc.equal(under, 0.0), None, under)
    columns = {c: first.column(c) for c in (*EVENT, "cluster_id", "n_cluster")} | {f"seed_{c}": first.column(c) for c in "xy"}
    columns |= {"n_hits": found.column("g_count"), "charge": found.column("charge_sum"), "frame": found.column("frame_min"), "cluster_shape": pa.array(np.full(len(seeds), -1))}
    return pa.table(columns | {f"mean_{c}": pc.divide(found.column(f"w{c}_sum"), under) for c in "xy"} | {f"err_{c}": pc.subtract(found.column(f"{c}_max"), found.column(f"{c}_min")) for c in "xy"})


def build_position_clusters(cluster_hits: DataFrame, weighted: bool = False, charge_correction: float = 0.0) -> DataFrame:
    """One row per cluster: size, charge, seed (largest charge, then first), mean position, first frame, extent; a cluster of positions has shape -1."""
    w = F.col("charge") + charge_correction
    mean = (lambda c: F.sum(w * F.col(c)) / F.sum(w)) if weighted else (lambda c: F.avg(c))
    seed = F.max(F.struct("charge", (-F.col("ordinal")).alias("o"), "x", "y"))
    return cluster_hits.groupBy(*EVENT, "cluster_id").agg(
        F.count("*").alias("n_hits"), F.sum("charge").alias("charge"), seed["x"].alias("seed_x"), seed["y"].alias("seed_y"), mean("x").alias("mean_x"), mean("y").alias("mean_y"),
        F.min("frame").alias("frame"), (F.max("x") - F.min("x")).alias("err_x"), (F.max("y") - F.min("y")).alias("err_y"), F.max("n_cluster").alias("n_cluster"), F.lit(-1).cast("long").alias("cluster_shape"),
    )
