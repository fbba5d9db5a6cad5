"""Choosing tracks and events."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from hitloom.functions import expressions as X
from hitloom.operators.events import Neighbours, dealt, first_rows, whole_events
from hitloom.runtime import ship

TRACK = ["event_number", "ordinal"]


def select_tracks(df: DataFrame, hit=(), no_hit=(), quality=(), isolated_track=(), isolated_hit=()) -> DataFrame:
    """Tracks with all required hits and none of the forbidden ones.

    Quality and isolated-hit bits are demanded wherever the track has a hit,
    isolated-track bits always.
    """
    flag = F.col("hit_flag")
    keep = X.all_bits(flag, list(hit)) & X.no_bits(flag, list(no_hit))
    for name, duts in (("quality_flag", quality), ("isolated_hit_flag", isolated_hit)):
        if duts:
            need = flag.bitwiseAND(F.lit(X.mask_of(list(duts))).cast("long"))
            keep = keep & (F.col(name).bitwiseAND(need) == need)
    if isolated_track:
        keep = keep & X.all_bits(F.col("isolated_track_flag"), list(isolated_track))
    return df.where(keep)


def query_filter(df: DataFrame, text: str) -> DataFrame:
    """Filter by a boolean text over columns that joins terms by ``&`` and ``|``; anything but one predicate is refused."""
    if ";" in text or any(w in text.lower().split() for w in ("select", "from")):
        raise ValueError("only a predicate over columns is allowed")
    return df.where(F.expr(text.replace("&", " AND ").replace("|", " OR ").replace("==", "=")))


def alone(table: pa.Table, cuts: dict[str, tuple[str, str, float, float]], ellipse: bool) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """For each cut whether rows, by event and plane, have no other row near, and whether they have a position at all."""
    get = lambda c: table.column(c).to_numpy()
    neighbours, out = Neighbours(get(TRACK[0]), get("dut")), {}
    for name, (x, y, dx, dy) in cuts.items():
        u, v = (get(c).astype(float) for c in (x, y))
        out[name] = ~neighbours.near(u, v, dx, dy, ellipse), ~(np.isnan(u) | np.isnan(v))
    return out


def isolated_rows(rows: DataFrame, cuts: dict[str, tuple[str, str, float, float]], keep: list[str] = (), ellipse: bool = True) -> DataFrame:
    """event_number, ordinal, dut and ``keep`` of each row, with a flag per name of ``cuts`` (x, y, dx, dy): no other row of the event and plane has (x, y) within the ellipse or rectangle of half-axes dx, dy.

    Null where the row has no position; such rows disturb nobody. Rows are dealt
    by event at most once, and tasks look for neighbours in batches of whole
    events: no pairs are joined, whatever the number of cuts. One event must fit into a task.
    """
    columns = list(dict.fromkeys([*TRACK, "dut", *keep, *(c for v in cuts.values() for c in v[:2])]))
    given, kinds = [*TRACK, "dut", *keep], dict(rows.dtypes)
    ddl = ", ".join([*(f"`{c}` {kinds[c]}" for c in given), *(f"`{k}` boolean" for k in cuts)])
    fields = to_arrow_schema(_parse_datatype_string(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_events(batches, TRACK[0]):
            flags = [pa.array(flag, mask=~there) for flag, there in alone(table, cuts, ellipse).values()]
            yield from pa.Table.from_arrays([*(table.column(c) for c in given), *flags], schema=fields).to_batches()

    ship(rows.sparkSession)
    return dealt(rows.select(*columns), order=("dut", "ordinal")).mapInArrow(run, ddl)


def isolation_flags(rows: DataFrame, x: str, y: str, dx: float, dy: float, ellipse: bool = True) -> DataFrame:
    """Bit per plane: no other row of the event has (x, y) within the ellipse or rectangle of half-axes dx, dy.

    Rows with a null position have no bit and disturb nobody; tracks without any
    position have no row. Dealt and done as ``isolated_rows``.
    """
    kinds = dict(rows.dtypes)
    ddl = ", ".join([*(f"{c} {kinds[c]}" for c in TRACK), "isolated_flag long"])
    fields = to_arrow_schema(_parse_datatype_string(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_events(batches, TRACK[0]):
            flag, there = alone(table, {"alone": (x, y, dx, dy)}, ellipse)["alone"]
            event, ordinal, bit = (table.column(c).to_numpy()[there] for c in (*TRACK, "dut"))
            if not len(event):
                continue
            bit = np.where(flag[there], np.int64(1) << bit.astype(np.int64), 0)
            order = np.lexsort((ordinal, event))
            start = np.flatnonzero(first_rows(event[order], ordinal[order]))
            yield from pa.Table.from_arrays([pa.array(event[order][start]), pa.array(ordinal[order][start]), pa.array(np.bitwise_or.reduceat(bit[order], start))], schema=fields).to_batches()

    ship(rows.sparkSession)
    return dealt(rows.select(*TRACK, "dut", x, y), order=("dut", "ordinal")).mapInArrow(run, ddl)


def sample_events(df: DataFrame, n: int, seed: str) -> DataFrame:
    """All rows of ``n`` whole events, taken in the order of a seeded hash; the same ones in every run."""
    key = F.md5(F.concat(F.col("event_number").cast("string"), F.lit(f"#{seed}")).cast("binary"))
    chosen = df.select("event_number").distinct().orderBy(key, "event_number").limit(n)
    return df.join(F.broadcast(chosen) if n <= 1_000_000 else chosen, "event_number", "left_semi")
