"""Joins of event tables. An event is the grain of every join; rows of one event keep an explicit ordinal."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from hitloom.operators.events import dealt, first_rows, whole_events
from hitloom.runtime import Scratch, ship

#: Parts of a cell on each axis that have a list of pixels of their own, and lists up to which they are broadcast.
FINE, BROADCAST_PARTS = 8, 1_000_000
#: Tasks that make the lists: of few rows each, but long to work on.
TASKS = 32
#: Side of the cells of ``later_pairs`` in reaches, and its columns.
CELL, LATER = 3, "axis int, e1 long, o1 int, e2 long, o2 int, bin int"
#: Rows and pairs that a task counts at a time, and counts that it holds at most.
ROWS, PAIRS, CELLS = 200_000, 2_000_000, 4_000_000


def number_rows(df: DataFrame, *keys: str, by: tuple = ("ordinal",), name: str = "k") -> DataFrame:
    """Position of a row in its group, from 0."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*by)) - 1)


def merge_planes(df: DataFrame, values: list[str], planes: list[int], only_events_of: int | None = None) -> DataFrame:
    """Row k of an event holds the k-th row of each plane side by side.

    Dealt by event once: the numbering and the grouping both find their rows together.
    ``only_events_of`` keeps events up to the last one of that plane.
    """
    rows = number_rows(df.repartition("event_number"), "dut", "event_number")
    if only_events_of is not None:
        last = df.where(F.col("dut") == only_events_of).agg(F.max("event_number")).first()[0]
        rows = rows.where(F.col("event_number") <= F.lit(last))
    at = lambda p, v: F.max(F.when(F.col("dut") == p, F.col(v))).alias(f"{v}_dut_{p}")
    flag = F.bit_or(F.expr("shiftleft(1L, dut)")).alias("hit_flag")
    return rows.groupBy("event_number", "k").agg(*(at(p, v) for p in planes for v in values), flag)


def multiset_max(a: DataFrame, b: DataFrame, key: str = "event_number") -> DataFrame:
    """Each value as often as in that side which has it more often."""
    one, two = (number_rows(x.select(key), key, by=(key,)) for x in (a, b))
    return one.unionAll(two).distinct().select(key)


def map_ordinal(left: DataFrame, right: DataFrame) -> DataFrame:
    """The k-th row of an event on the left gets the k-th row of that event on the right, or nulls."""
    return number_rows(left, "event_number").join(number_rows(right.withColumnRenamed("ordinal", "ordinal_r"), "event_number", by=("ordinal_r",)), ["event_number", "k"], "left")


def lookup(df: DataFrame, table: DataFrame, keys: list[str], value: str, fill=None) -> DataFrame:
    """Value of the matching row; unmatched rows get ``fill`` or, without one, are dropped."""
    if fill is None:
        return df.join(table.select(*keys, value), keys)
    return df.join(table.select(*keys, value), keys, "left").withColumn(value, F.coalesce(F.col(value), F.lit(fill)))


def band_pairs(df: DataFrame, width: int, key: str = "event_number", same: tuple = ()) -> DataFrame:
    """Rows as (earlier, later) with e - width <= e' < e: each row is repeated for its ``width`` targets and met by an equi-join, on columns ``same`` too."""
    early = df.withColumn(key, F.explode(F.sequence(F.col(key) + 1, F.col(key) + width)))
    cols = [c for c in df.columns if c not in (key, *same)]
    return early.select(key, *same, *(F.col(c).alias(f"{c}_early") for c in cols)).join(df, [key, *same])


def plane_pairs(df: DataFrame, bin_: Column, references: list[int]) -> DataFrame:
    """Counts of (bin in a reference plane, bin in another plane) over all row pairs of one event.

    Each side is summed per event and bin first, so a busy event contributes
    products of counts and not its pairs of rows. Dealt by event once: the sums
    and both sides of the join use that shuffle.
    """
    cells = df.select("event_number", "dut", bin_.alias("bin")).repartition("event_number").groupBy("event_number", "dut", "bin").agg(F.count("*").alias("n"))
    ref = cells.where(F.col("dut").isin(references)).select("event_number", F.col("dut").alias("ref"), F.col("bin").alias("bin_ref"), F.col("n").alias("m"))
    return ref.join(cells, "event_number").where("ref <> dut").groupBy("ref", "dut", "bin_ref", "bin").agg(F.sum(F.col("n") * F.col("m")).alias("n"))


def plane_correlation(df: DataFrame, bins: dict[str, Column], references: list[int]) -> DataFrame:
    """Counts (ref, dut, axis, bin_ref, bin) of row pairs of an event, each axis of ``bins`` with itself; rows with a null bin do not count.

    Rows are dealt by event (not at all if they stand so). Tasks sum whole events,
    a busy one per bin first, so that neither pairs nor bins of events are
    shuffled but only the counts of a task, which are as many as bins of the planes allow.
    One event must fit into a task.
    """
    ship(df.sparkSession)
    axes = list(bins)
    rows = df.select("event_number", "dut", *(c.cast("long").alias(f"b{i}") for i, c in enumerate(bins.values())))
    kind = dict(df.dtypes)["dut"]
    ddl = f"ref {kind}, dut {kind}, at int, bin_ref long, bin long, n long"
    fields = to_arrow_schema(_parse_datatype_string(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for part in large_parts(whole_events(batches, "event_number"), ROWS):
            event, dut = (part.column(c).to_numpy() for c in ("event_number", "dut"))
            for i in range(len(axes)):
                column = part.column(f"b{i}")
                known = column.is_valid().to_numpy()
                b = column.drop_null().to_numpy()
                for pairs in counted_pairs(event[known], dut[known], b, references):
                    held.append(np.stack([pairs[0], pairs[1], np.full(len(pairs[0]), i), *pairs[2:]]))
            if sum(h.shape[1] for h in held) > CELLS:
                held = [summed(np.concatenate(held, axis=1))]
            if held and held[0].shape[1] > CELLS // 2:
                yield from cells(held.pop(0))
        if held:
            yield from cells(summed(np.concatenate(held, axis=1)))

    def cells(found: np.ndarray) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_arrays([pa.array(c).cast(f.type) for c, f in zip(found, fields, strict=True)], schema=fields)
        yield from table.to_batches(max_chunksize=100_000)

    found = dealt(rows, order=("dut",)).mapInArrow(run, ddl)
    sums = found.groupBy("ref", "dut", "at", "bin_ref", "bin").agg(F.sum("n").alias("n"))
    return sums.select("ref", "dut", F.element_at(F.array(*map(F.lit, axes)), F.col("at") + 1).alias("axis"), "bin_ref", "bin", "n")


def large_parts(tables: Iterator[pa.Table], rows: int) -> Iterator[pa.Table]:
    """The tables in groups of ``rows`` rows or more, as one each."""
    waiting, n = [], 0
    for t in tables:
        waiting.append(t)
        n += t.num_rows
        if n >= rows:
            yield pa.concat_tables(waiting)
            waiting, n = [], 0
    if waiting:
        yield pa.concat_tables(waiting)


def code(*columns: np.ndarray) -> np.ndarray:
    """One whole number for the values of a row, equal and ordered as the rows are."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    spans = [int(c.max()) - int(c.min()) + 1 for c in columns]
    if math.prod(spans) >= 2**62:
        columns = [np.unique(c, return_inverse=True)[1] for c in columns]
        spans = [int(c.max()) + 1 for c in columns]
    out = np.zeros(len(columns[0]), np.int64)
    for c, span in zip(columns, spans, strict=True):
        out = out * span + (c.astype(np.int64) - int(c.min()))
    return out


def summed(rows: np.ndarray) -> np.ndarray:
    """Rows (as columns of an array) that agree in all but the last value, once each with its sum."""
    key = code(*rows[:-1])
    span = int(key.max(initial=0)) + 1
    if span <= 4 * len(key) + 1_000_000:  # counted in place; sums of whole numbers stay exact
        first = np.full(span, -1)
        first[key] = np.arange(len(key))
        at = np.flatnonzero(first >= 0)
        total = np.zeros(span, np.int64)
        np.add.at(total, key, rows[-1])
        return np.concatenate([rows[:-1, first[at]], total[at][None]])
    order = np.argsort(key, kind="stable")
    start = np.flatnonzero(first_rows(key[order]))
    return np.concatenate([rows[:-1, order[start]], np.add.reduceat(rows[-1, order], start)[None]])


def counted_pairs(event: np.ndarray, dut: np.ndarray, b: np.ndarray, references: list[int]) -> Iterator[np.ndarray]:
    """Counts (ref, dut, bin_ref, bin, n) of pairs of rows of an event and two planes, the first of ``references``; rows stand by event."""
    if not len(event):
        return
    group = np.cumsum(first_rows(event)) - 1
    key = code(group, dut, b)
    order = np.argsort(key, kind="stable")
    start = np.flatnonzero(first_rows(key[order]))
    n = np.diff(np.r_[start, len(key)])
    group, dut, b = (c[order[start]].astype(np.int64) for c in (group, dut, b))
    head = np.flatnonzero(first_rows(group))
    size = np.diff(np.r_[head, len(group)])
    ref = np.flatnonzero(np.isin(dut, references))
    count = size[group[ref]]
    ends, lo = np.cumsum(count), 0
    while lo < len(ref):
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + PAIRS, "right")))
        c = count[lo:hi]
        i = np.repeat(ref[lo:hi], c)
        j = np.repeat(head[group[ref[lo:hi]]] - (ends[lo:hi] - c - before), c) + np.arange(len(i))
        apart = dut[i] != dut[j]
        i, j = i[apart], j[apart]
        if len(i):
            yield summed(np.stack([dut[i], dut[j], b[i], b[j], n[i] * n[j]]))
        lo = hi


def event_correlation(df: DataFrame, bins: dict[str, Column], width: int) -> DataFrame:
    """Counts (dut, axis, early, late) of pairs of a plane's rows with e - width <= e' < e, each axis with itself."""
    axes = F.explode(F.array(*(F.struct(F.lit(a).alias("axis"), c.cast("long").alias("bin")) for a, c in bins.items())))
    rows = df.select("event_number", "dut", axes.alias("a")).select("event_number", "dut", "a.axis", "a.bin").where("bin IS NOT NULL")
    cells = rows.groupBy("event_number", "dut", "axis", "bin").agg(F.count("*").alias("n"))
    pairs = band_pairs(cells, width, same=("dut", "axis"))
    return pairs.groupBy("dut", "axis", F.col("bin_early").alias("early"), F.col("bin").alias("late")).agg(F.sum(F.col("n") * F.col("n_early")).alias("n"))


def nearest_pixel(points: DataFrame, pixels: DataFrame, x: str, y: str, cell: float, half_x: float, half_y: float) -> DataFrame:
    """``points`` (with ``dut``) with the ``column`` and ``row`` of the pixel of their plane whose centre ``px, py`` is nearest.

    For planes of any pixel positions. Points outside the matrix (``half_x``,
    ``half_y`` from its centre), which would be nearest to a pixel mirrored at its edge,
    are dropped. No point of a matrix may be farther than ``cell`` from its
    nearest pixel: pixels stand in nine cells of a grid. Cells are cut into ``FINE`` by
    ``FINE`` parts, which keep only pixels that can be the nearest to one of their points: no
    farther from the part than the nearest pixel is from all of it. A point meets the
    few of its part by an equi-join. Parts are as many as planes allow, whatever the number of
    points. Of equally near pixels the one of the smaller column, then row is taken.
    """
    at = lambda c, side=cell: F.floor(F.col(c) / side)
    around = F.array(*(F.struct((at("px") + i).alias("cx"), (at("py") + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    table = pixels.select("dut", "column", "row", "px", "py", F.explode(around).alias("c")).select("dut", "column", "row", "px", "py", "c.cx", "c.cy")
    listed = table.repartition(TASKS, "dut", "cx", "cy").groupBy("dut", "cx", "cy").agg(F.collect_list(F.struct("px", "py", "column", "row")).alias("near"))  # as many as pixels fit in nine cells
    side = cell / FINE
    listed = narrowed(listed, side, FINE)
    keys = ["dut", "cx", "cy"]
    listed, seen = Scratch(points.sparkSession, "pixels").counted(listed, "parts")
    listed = F.broadcast(listed) if seen["n"] <= BROADCAST_PARTS else listed
    inside = points.where((F.abs(F.col(x)) <= half_x) & (F.abs(F.col(y)) <= half_y)).withColumns({"cx": at(x, side), "cy": at(y, side)})
    d = lambda p: (p["px"] - F.col(x)) * (p["px"] - F.col(x)) + (p["py"] - F.col(y)) * (p["py"] - F.col(y))
    best = F.array_min(F.transform("near", lambda p: F.struct(d(p).alias("d"), p["column"].alias("column"), p["row"].alias("row"))))
    return inside.join(listed, keys).withColumn("b", best).select(*points.columns, F.col("b.column").alias("column"), F.col("b.row").alias("row"))


def narrowed(listed: DataFrame, side: float, n: int) -> DataFrame:
    """Lists ``near`` of pixels of cells (dut, cx, cy) for the n by n parts, ``side`` wide, of each cell: without pixels that another one is nearer than everywhere in the part."""
    i, j = (v.ravel() for v in np.indices((n, n)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = "px", "py", "column", "row"
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                near, cx, cy = [np.asarray(getattr(r, k)) for k in names], r.cx * n + i, r.cy * n + j
                low, high = 0.0, 0.0
                for cell, at in ((cx, near[0]), (cy, near[1])):
                    before, behind = cell[:, None] * side - at, at - (cell[:, None] + 1) * side
                    low = low + np.maximum(np.maximum(before, behind), 0.0) ** 2
                    high = high + np.maximum(np.abs(before), np.abs(behind)) ** 2
                kept = low <= high.min(axis=1, keepdims=True) * (1 + 1e-9) + 1e-9 * side * side  # well apart from rounding
                out.append(pd.DataFrame({"dut": r.dut, "cx": cx, "cy": cy} | {k: [v[m] for m in kept] for k, v in zip(names, near, strict=True)}))
            if out:
                yield pd.concat(out)

    flat = listed.select("dut", "cx", "cy", *(F.col(f"near.{k}").alias(k) for k in ("px", "py", "column", "row")))
    kinds = ", ".join(f"`{k}` {v}" for k, v in flat.dtypes)
    return flat.mapInPandas(run, kinds).select("dut", "cx", "cy", F.arrays_zip("px", "py", "column", "row").alias("near"))


def nearest_of(value: Column, values: list) -> Column:
    """The closest of a short sorted list; of two equally close ones the larger."""
    return -F.array_min(F.array(*(F.struct(F.abs(value - v).alias("d"), F.lit(-v).alias("v")) for v in values)))["v"]


def row_before(df: DataFrame, value: str, order: list[str], by: list[str], width: int, name: str = "before") -> DataFrame:
    """``df`` with ``value`` of the row before it in ``order`` among the rows of equal ``by``.

    No window spans a group: the first column of ``order`` is cut into ranges
    of ``width``, rows look back inside their range, and a range's first row
    takes the last value of the ranges before it, found on one row per range.
    """
    rows = df.withColumn("range_", F.floor(F.col(order[0]) / width))
    own = Window.partitionBy(*by, "range_").orderBy(*order)
    last = rows.groupBy(*by, "range_").agg(F.max_by(value, F.struct(*order)).alias("last_"))
    edges = last.withColumn("edge_", F.lag("last_").over(Window.partitionBy(*by).orderBy("range_"))).drop("last_")
    rows = rows.withColumns({"inside_": F.lag(value).over(own), "first_": F.row_number().over(own) == 1})
    out = rows.join(edges, [*by, "range_"])
    return out.withColumn(name, F.when(F.col("first_"), F.col("edge_")).otherwise(F.col("inside_"))).drop("range_", "inside_", "first_", "edge_")


def close_pairs(df: DataFrame, near: Column, keys: list[str], row: str = "ordinal") -> DataFrame:
    """Pairs a, b of rows with equal keys, a before b, that meet a condition on the two sides."""
    a, b = df.alias("a"), df.alias("b")
    same = F.col(f"a.{row}") < F.col(f"b.{row}")
    for k in keys:
        same = same & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    return a.join(b, same & near).select(*(F.col(f"a.{k}").alias(k) for k in keys), F.col(f"a.{row}").alias("a"), F.col(f"b.{row}").alias("b"))


def nearest_value(df: DataFrame, value: str, grid: DataFrame, keys: list[str]) -> DataFrame:
    """Closest value of a sorted list (column ``v`` of ``grid``, per ``keys``); of two equally close ones the larger.

    The value stands in ``nearest_`` (null where the list of the keys is empty).
    As-of join both ways by one window over the union of rows and grid values.
    """
    points = grid.select(*keys, F.col("v").alias("at"), F.col("v").alias("g"), F.lit(0).alias("is_row"), F.lit(None).alias("payload"))
    rows = df.select(*keys, F.col(value).alias("at"), F.lit(None).cast(grid.schema["v"].dataType).alias("g"), F.lit(1).alias("is_row"), F.struct(*[c for c in df.columns if c not in keys]).alias("payload"))
    points = points.withColumn("payload", F.lit(None).cast(rows.schema["payload"].dataType))
    w = Window.partitionBy(*keys).orderBy("at", "is_row")
    both = points.unionByName(rows).withColumns({
        "below": F.last("g", True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "above": F.first("g", True).over(w.rowsBetween(0, Window.unboundedFollowing)),
    }).where("is_row = 1")
    nearest = F.when(F.col("below").isNull() | (F.col("above") - F.col("at") <= F.col("at") - F.col("below")), F.coalesce("above", "below")).otherwise(F.col("below"))
    return both.select(*keys, "payload.*", nearest.alias("nearest_"))


def later_pairs(tracks: DataFrame, far: float, width: float, near: float = 5.0) -> DataFrame:
    """Pairs (axis, e1, o1, e2, o2, bin) of tracks of different events, the earlier first: no further apart than ``far`` on ``axis`` (in bins of ``width``) and closer than ``near`` on the other.

    ``tracks`` has event_number, ordinal, x and y; every track is a reference
    for all later ones, and a track without a position or event has no pairs. Tracks are dealt once, for both axes, to
    cells of ``CELL`` times ``far``; those near a border are guests next door as
    well, as earlier ones. Tasks list the pairs in portions of ``PAIRS``
    candidates, so that no pair is shuffled, held or spilled; the tracks of a
    cell must fit into a task.
    """
    side, fields = CELL * far, to_arrow_schema(_parse_datatype_string(LATER))
    known = tracks.where(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c}) AND abs({c}) < double('inf')" for c in "xy") + " AND event_number IS NOT NULL")
    rows = known.select(F.col("event_number").cast("long").alias("e"), F.col("ordinal").cast("int").alias("o"), *(F.col(c).cast("double").alias(c) for c in "xy"))
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    home = {c: F.floor(F.col(c) / side) for c in "xy"}
    reach = 1.01 * max(far, near)  # what is sent too far finds no pair
    there = lambda c, i: F.floor((F.col(c) + i * reach) / side) == home[c] + i
    met = F.filter(steps, lambda s: there("x", s["i"]) & there("y", s["j"]))
    dealt_ = rows.withColumn("s", F.explode(met)).select("e", "o", "x", "y", (home["x"] + F.col("s.i")).alias("cx"), (home["y"] + F.col("s.j")).alias("cy"), ((F.col("s.i") == 0) & (F.col("s.j") == 0)).alias("own"))
    tasks = int(tracks.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # as a number: small inputs with many pairs are not put together
    dealt_ = dealt_.repartition(tasks, "cx", "cy").sortWithinPartitions("cx", "cy")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in cells_of(batches, "cx", "cy"):
            e, o, x, y, own = (t.column(c).to_numpy() for c in ("e", "o", "x", "y", "own"))
            for axis, u, v in ((0, x, y), (1, y, x)):
                for i, j, d in pairs_in_cell(e, u, v, own, far, near):
                    columns = [np.full(len(i), axis, np.int32), e[i], o[i], e[j], o[j], np.floor(d / width).astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, fields, strict=True)], schema=fields)

    ship(tracks.sparkSession)
    return dealt_.mapInArrow(run, LATER).withColumn("axis", F.when(F.col("axis") == 0, "x").otherwise("y"))


def cells_of(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """The rows of one cell after another, from batches that are sorted by ``keys``."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        at = [b.column(b.schema.get_field_index(k)).to_numpy() for k in keys]
        cuts = [0, *np.flatnonzero(first_rows(*at))[1:].tolist(), b.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            cell = tuple(k[lo] for k in at)
            if held and cell != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(lo, hi - lo))
            last = cell
    if held:
        yield pa.Table.from_batches(held)


def pairs_in_cell(e: np.ndarray, u: np.ndarray, v: np.ndarray, own: np.ndarray, far: float, near: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Earlier rows, later ``own`` rows and their distances on ``u``, in portions; rows stand in strips of ``near`` along v and by u inside."""
    strip = np.floor(v / (1.000001 * near))  # a little wider, so that rounding never puts a strip between two near rows
    order = np.lexsort((u, strip))
    start = np.flatnonzero(first_rows(strip[order]))
    kinds, ends = strip[order][start], np.r_[start[1:], len(order)]
    ordered, mine, slack = u[order], np.flatnonzero(own), 1e-9 * (np.abs(u).max() + far)
    lo, hi = np.zeros((2, 3, len(mine)), np.int64)
    for k, (name, first, last) in enumerate(zip(kinds, start, ends, strict=True)):
        for side in (-1, 0, 1):
            here = np.flatnonzero(strip[mine] == name + side)
            lo[side + 1, here] = first + np.searchsorted(ordered[first:last], u[mine[here]] - far - slack)
            hi[side + 1, here] = first + np.searchsorted(ordered[first:last], u[mine[here]] + far + slack, "right")
    for side in range(3):
        n = hi[side] - lo[side]
        done = np.r_[0, np.cumsum(n)]
        a = 0
        while a < len(mine):
            b = max(a + 1, int(np.searchsorted(done, done[a] + PAIRS, "right")) - 1)
            i = order[np.repeat(lo[side, a:b] - (done[a:b] - done[a]), n[a:b]) + np.arange(done[b] - done[a])]
            j = np.repeat(mine[a:b], n[a:b])
            a = b
            d = np.abs(u[i] - u[j])
            close = (e[j] > e[i]) & (d <= far) & (np.abs(v[i] - v[j]) < near)
            if close.any():
                yield i[close], j[close], d[close]
