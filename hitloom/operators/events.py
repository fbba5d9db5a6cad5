"""User functions on whole events.

``map_events`` deals rows by event, unless they stand so already, sorts them
inside partitions and hands a function batches that never split an event: the
last event of an Arrow batch waits for the next one. Memory follows the batch
size plus one event.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StructType

from hitloom.runtime import ship

EVENT = ["event_number", "dut"]
#: Tracks of an event up to which all its pairs are looked at.
FEW = 32


def whole_events(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole events from batches that are sorted by ``key``."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        events = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(events, events[-1]))  # first row of the batch's last event
        first = waiting[-1].column(waiting[-1].schema.get_field_index(key))[-1].as_py() if waiting else None
        if waiting and (cut or first != events[-1]):
            done = waiting + ([batch.slice(0, cut)] if cut else [])
            yield pa.Table.from_batches(done)
            waiting = []
        elif cut:
            yield pa.Table.from_batches([batch.slice(0, cut)])
        waiting.append(batch.slice(cut))
    if waiting:
        yield pa.Table.from_batches(waiting)


def gathered(tables: Iterator[pa.Table], rows: int) -> Iterator[pa.Table]:
    """Tables put together until they have ``rows`` rows or more, for kernels that cost much a call."""
    held, n = [], 0
    for t in tables:
        held.append(t)
        n += t.num_rows
        if n >= rows:
            yield pa.concat_tables(held)
            held, n = [], 0
    if held:
        yield pa.concat_tables(held)


def dealt(df: DataFrame, key: str = "event_number", order: tuple = ("ordinal",)) -> DataFrame:
    """All rows of an event in one task, by event and ``order``, with their ``place_`` in the event from 1.

    A window asks for this dealing, so rows that come dealt by event are not shuffled again.
    """
    return df.withColumn("place_", F.row_number().over(Window.partitionBy(key).orderBy(*order))).sortWithinPartitions(key, *order)


def map_events(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, key: str = "event_number", order: tuple = ("ordinal",)) -> DataFrame:
    """Apply ``fn`` to event-aligned batches; it may return any number of rows of ``schema``."""
    from pyspark.sql.types import _parse_datatype_string

    fields = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_events(batches, key):
            found = fn(table.drop_columns("place_").to_pandas())
            yield from pa.Table.from_arrays([pa.Array.from_pandas(found[f.name], type=f.type) for f in fields], schema=fields).to_batches()

    ship(df.sparkSession)
    return dealt(df, key, order).mapInArrow(run, schema)


def first_rows(*columns: np.ndarray) -> np.ndarray:
    """Whether a row of sorted columns differs from the row before."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def label_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest vertex of each of ``n`` vertices' component: roots of edges are hooked to the smaller one and paths are halved."""
    root = np.arange(n)
    while len(a):
        u, v = root[a], root[b]
        apart = u != v
        if not apart.any():
            break
        a, b, u, v = a[apart], b[apart], u[apart], v[apart]
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while not np.array_equal(root, up := root[root]):
            root = up
    return root


def close_pixels(group: np.ndarray, at: list[np.ndarray], reach: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of different pixels of one group that are no further apart than ``reach`` on each axis.

    Pixels are met over cells of reach + 1: a cell holds a bounded number of
    distinct pixels, so the pairs grow with the pixels and not with their square.
    """
    cells = np.stack([group, *(c // (d + 1) for c, d in zip(at, reach, strict=True))], axis=1)
    low = cells.min(axis=0)
    size = cells.max(axis=0) - low + 3  # room for neighbours at both ends
    if np.prod(size.astype(float)) > 2.0**62:
        cells[:, 0] = np.unique(group, return_inverse=True)[1]
        low, size = cells.min(axis=0), cells.max(axis=0) - cells.min(axis=0) + 3
    step = np.r_[np.cumprod(size[:0:-1])[::-1], 1]
    key = ((cells - low + 1) * step).sum(axis=1)
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    left, right = [], []
    for offset in np.ndindex(*[3] * len(at)):
        shift = int(((np.array(offset) - 1) * step[1:]).sum())
        if shift < 0:
            continue
        first, end = np.searchsorted(ordered, key + shift), np.searchsorted(ordered, key + shift, "right")
        n = end - first
        a = np.repeat(np.arange(len(key)), n)
        b = order[np.repeat(first - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())]
        near = a < b if shift == 0 else np.ones(len(a), bool)
        for c, d in zip(at, reach, strict=True):
            near &= np.abs(c[a] - c[b]) <= d
        left.append(a[near])
        right.append(b[near])
    return np.concatenate(left), np.concatenate(right)


def number_clusters(event: np.ndarray, dut: np.ndarray, at: list[np.ndarray], reach: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Cluster of each hit, numbered in its event and plane by first hits, and how many there are; rows stand by event, plane and ordinal."""
    group = np.cumsum(first_rows(event, dut)) - 1
    pixels, first, own = np.unique(np.stack([group, *at], axis=1), axis=0, return_index=True, return_inverse=True)
    by_first = np.argsort(first)  # pixels in the order of their first hits, so that the smallest label is the first
    rank = np.empty_like(by_first)
    rank[by_first] = np.arange(len(by_first))
    pixels = pixels[by_first]
    root = label_components(len(pixels), *close_pixels(pixels[:, 0], list(pixels[:, 1:].T), reach))
    label = root[rank[own.ravel()]]
    tops = np.flatnonzero(root == np.arange(len(root)))  # one per cluster, by group and first hit
    starts = np.flatnonzero(first_rows(pixels[tops, 0]))
    counts = np.diff(np.r_[starts, len(tops)])
    number = np.empty(len(root), np.int32)
    number[tops] = np.arange(len(tops)) - np.repeat(starts, counts)
    return number[label], counts[group].astype(np.int32)


def clusters_by_kernel(hits: DataFrame, d_column: int, d_row: int, d_frame: int | None = None) -> DataFrame:
    """``hits`` with ``cluster_id`` and ``n_cluster``: union of neighbouring pixels, whole batches of events at a time.

    Time and memory follow the number of hits, also in dense events; one event
    must fit into a task (``clusters.cluster_ids`` takes larger ones apart).
    """
    schema = StructType([*hits.schema.fields]).add("cluster_id", IntegerType()).add("n_cluster", IntegerType())  # a copy, as add changes the list
    fields = to_arrow_schema(schema)
    axes = {"column": d_column, "row": d_row} | ({} if d_frame is None else {"frame": d_frame})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_events(batches, "event_number"):
            get = lambda c: table.column(c).to_numpy().astype(np.int64)  # noqa: B023, E731
            ids, n = number_clusters(get("event_number"), get("dut"), [get(c) for c in axes], list(axes.values()))
            columns = [table.column(f.name) for f in fields if f.name not in ("cluster_id", "n_cluster")]
            yield from pa.Table.from_arrays([*columns, pa.array(ids), pa.array(n)], schema=fields).to_batches()

    ship(hits.sparkSession)
    return dealt(hits, order=("dut", "ordinal")).mapInArrow(run, schema)


def inside(u: np.ndarray, v: np.ndarray, dx: float, dy: float, ellipse: bool) -> np.ndarray:
    """Whether distances are within the ellipse or rectangle of half-axes ``dx, dy``."""
    if ellipse and dx > 0 and dy > 0:
        return (u / dx) * (u / dx) + (v / dy) * (v / dy) <= 1
    return (u <= dx) & (v <= dy)


def compact(c: np.ndarray) -> np.ndarray:
    """Small whole numbers in the order of ``c``, as far apart as before up to a distance of 3."""
    known, own = np.unique(c, return_inverse=True)
    return np.r_[0, np.cumsum(np.minimum(np.diff(known), 3)).astype(np.int64)][own]


class Neighbours:
    """Rows that stand by event (and plane, if given), asked which of them have another row of their event near.

    Pairs are listed for events of up to ``FEW`` rows. In larger ones rows are met over
    cells so small that rows sharing one are near; rows alone in their cell look around
    it, so the work grows with the rows and not with their square.
    """

    def __init__(self, event: np.ndarray, *more: np.ndarray):
        start = np.flatnonzero(first_rows(event, *more)) if len(event) else np.zeros(0, np.int64)
        count = np.diff(np.r_[start, len(event)])
        self.group = np.repeat(np.arange(len(start)), count)
        few = count <= FEW
        after = np.repeat(np.where(few, start + count, 0), count) - np.arange(len(event)) - 1  # rows behind one in a small event
        after = np.maximum(after, 0)
        self.i = np.repeat(np.arange(len(event)), after)
        self.j = self.i + 1 + np.arange(len(self.i)) - np.repeat(np.cumsum(after) - after, after)
        self.crowded = np.flatnonzero(~few[self.group])

    def near(self, x: np.ndarray, y: np.ndarray, dx: float, dy: float, ellipse: bool) -> np.ndarray:
        """A flag per row; rows without a position have none and disturb nobody."""
        out = np.zeros(len(x), bool)
        close = inside(np.abs(x[self.i] - x[self.j]), np.abs(y[self.i] - y[self.j]), dx, dy, ellipse)
        out[self.i[close]] = True
        out[self.j[close]] = True
        rows = self.crowded[~(np.isnan(x[self.crowded]) | np.isnan(y[self.crowded]))]
        if len(rows) and dx >= 0 and dy >= 0:
            out[rows] = self._crowded(self.group[rows], x[rows], y[rows], dx, dy, ellipse)
        return out

    def _crowded(self, group: np.ndarray, x: np.ndarray, y: np.ndarray, dx: float, dy: float, ellipse: bool) -> np.ndarray:
        cx, cy = (compact(np.floor(c / (0.7 * d)) if d > 0 else np.unique(c, return_inverse=True)[1]) + 2 for c, d in ((x, dx), (y, dy)))
        high = int(cy.max()) + 3
        wide = int(cx.max()) + 3
        key = (group * wide + cx) * high + cy
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        out = np.searchsorted(ordered, key, "right") - np.searchsorted(ordered, key) > 1
        for shift in (a * high + b for a in range(-2, 3) for b in range(-2, 3) if a or b):
            alone = np.flatnonzero(~out)
            first = np.searchsorted(ordered, key[alone] + shift)
            n = np.searchsorted(ordered, key[alone] + shift, "right") - first
            a = np.repeat(alone, n)
            b = order[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(len(a))]
            out[a[inside(np.abs(x[a] - x[b]), np.abs(y[a] - y[b]), dx, dy, ellipse)]] = True
        return out
