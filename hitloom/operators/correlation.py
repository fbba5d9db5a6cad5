"""Correlation of residuals of neighbouring tracks of different events, summed without a row for a pair."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from hitloom.operators.events import first_rows, gathered
from hitloom.runtime import Scratch, ship

#: Tracks of a cell that one task holds while others stream past.
BLOCK = 1_000_000
#: Tracks that a task packs together and that a row holds at most, tracks of a plane that one task sums, and queries of range sums at a time.
PACK, LONGEST, TASK_TRACKS, QUERIES = 1_000_000, 50_000, 1_000_000, 1 << 17
#: Events (a power of 2) of a block whose pairs are looked at one by one, and candidates that numpy takes in one go.
LEAF, AT_ONCE = 2048, 1 << 18
#: Events (a power of 2) of a block where coordinates have few values, and places (values of u times values of v) up to which they count as few.
SMALL, PLACES = 256, 20_000
SUMS = ["n", "s1", "s2", "s11", "s22", "s12"]


def borders(values: np.ndarray, guess: np.ndarray, met) -> np.ndarray:
    """The first places in ascending ``values`` where ``met(values)``, a condition per query that holds from some value on, is true.

    ``guess`` holds values near the borders; values are looked at themselves, as rounded differences may hold for some that the guess tells apart.
    """
    known = np.unique(values)
    if not len(known):
        return np.zeros(len(guess), np.int64)
    at = np.searchsorted(known, guess)
    while True:
        back = (at > 0) & met(known[np.maximum(at - 1, 0)])
        on = (at < len(known)) & ~met(known[np.minimum(at, len(known) - 1)])
        if not (back | on).any():
            return np.searchsorted(values, np.r_[known, np.inf][at])
        at = at - back + (on & ~back)


class Windows:
    """Places of the windows' borders of queries (u, v) among points (u, v), in the order of u and of v."""

    def __init__(self, pu: np.ndarray, pv: np.ndarray, u: np.ndarray, v: np.ndarray, far: float, width: float, near: float):
        self.u_order, self.v_order = np.argsort(pu, kind="stable"), np.argsort(pv, kind="stable")
        su, sv = pu[self.u_order], pv[self.v_order]
        self.bins = int(far // width) + 1
        edges = [(k * width, lambda d, k=k: np.floor(d / width) >= k) for k in range(1, self.bins)] + [(far, lambda d: d > far)]
        up = [borders(su, u + e, lambda t, met=met: met(t - u)) for e, met in edges]
        down = [borders(su, u - e, lambda t, met=met: ~met(u - t)) for e, met in edges]
        self.u = np.stack([*down[::-1], *up], axis=1)  # borders from the far end on one side to the other's
        upper = borders(sv, v + near, lambda t: t - v >= near)
        lower = borders(sv, v - near, lambda t: v - t < near)
        self.v = np.stack([lower, np.maximum(upper, lower)], axis=1)


def prefix_sums(value: np.ndarray, weight: np.ndarray, at: np.ndarray, below: np.ndarray) -> np.ndarray:
    """For each query the sums of ``weight`` (points, w) over the first ``at`` points whose ``value`` (integers) is less than ``below``.

    The points are split by the bits of their values from the top, each time
    zeros before ones in the order they had; a query follows the bits of its
    bound and takes all zeros where that has a one.
    """
    total = np.zeros((len(at), weight.shape[1]))
    for bit in range(int(value.max(initial=0) + 1).bit_length() - 1, -1, -1):
        one = value >> bit & 1 == 1
        zeros = np.zeros(len(value) + 1, np.int64)
        np.cumsum(~one, out=zeros[1:])
        sums = np.zeros((len(value) + 1, weight.shape[1]))
        np.cumsum(np.where(one[:, None], 0, weight), axis=0, out=sums[1:])
        z, taken = zeros[at], below >> bit & 1 == 1
        total[taken] += sums[at[taken]]
        at = np.where(taken, zeros[-1] + at - z, z)
        order = np.concatenate([np.flatnonzero(~one), np.flatnonzero(one)])
        value, weight = value[order], weight[order]
    return total


def earlier_sums(points: tuple, queries: tuple, events: int, far: float, width: float, near: float) -> np.ndarray:
    """Sums (bins, 6) over pairs of a point and a query in whose window it lies, if a block of ``LEAF`` events ends between its event and the query's.

    Columns are (event, u, v, r), events the numbers below ``events``. They are
    halved again and again: points of the first half meet queries of the second
    in one pass over all blocks of a size, by sums over ranges of u and v, so
    that the cost grows as n log^2 n.
    """
    (pe, pu, pv, pr), (qe, qu, qv, qr) = points, queries
    total = np.zeros((int(far // width) + 1, 6))
    if len(qe) > QUERIES:
        return sum((earlier_sums(points, tuple(c[lo : lo + QUERIES] for c in queries), events, far, width, near) for lo in range(0, len(qe), QUERIES)), total)
    levels = range(LEAF.bit_length() - 1, int(max(events - 1, 0)).bit_length())
    if not levels or not len(pe) or not len(qe):
        return total
    w = Windows(pu, pv, qu, qv, far, width, near)
    n = len(pe) + 1
    weight = np.stack([np.ones(len(pr)), pr, pr * pr], axis=1)
    v_place = np.empty(len(pe), np.int64)
    v_place[w.v_order] = np.arange(len(pe))
    for level in levels:
        left, right = pe >> level & 1 == 0, np.flatnonzero(qe >> level & 1 == 1)
        if not len(right) or not left.any():
            continue
        node, asked = pe >> level + 1, qe[right] >> level + 1
        by_u = w.u_order[left[w.u_order]]
        by_u = by_u[np.argsort(node[by_u], kind="stable")]
        by_v = w.v_order[left[w.v_order]]
        by_v = by_v[np.argsort(node[by_v], kind="stable")]
        u_place = np.empty(len(pe), np.int64)
        u_place[w.u_order] = np.arange(len(pe))
        keys_u, keys_v = node[by_u] * n + u_place[by_u], node[by_v] * n + v_place[by_v]
        local = np.empty(len(pe), np.int64)
        local[by_v] = np.arange(len(by_v)) - np.searchsorted(node[by_v], node[by_v])
        first = np.searchsorted(keys_v, asked * n)
        low, high = (np.searchsorted(keys_v, asked * n + w.v[right, k]) - first for k in (0, 1))
        some = np.flatnonzero(high > low)
        right, asked, low, high = right[some], asked[some], low[some], high[some]
        at = np.searchsorted(keys_u, (asked[:, None] * n + w.u[right]).ravel())
        borders = w.u.shape[1]
        args = local[by_u], weight[by_u]
        both = prefix_sums(*args, np.tile(at, 2), np.concatenate([np.repeat(high, borders), np.repeat(low, borders)]))
        inside = (both[: len(at)] - both[len(at) :]).reshape(len(right), borders, 3)
        strips = np.diff(inside, axis=1)  # from the far end on one side to the other's; the middle one is bin 0
        middle = w.bins - 1
        found = np.stack([strips[:, middle] if b == 0 else strips[:, middle - b] + strips[:, middle + b] for b in range(w.bins)], axis=1)
        r = qr[right][:, None]
        for k, c in enumerate((found[..., 0], found[..., 1], found[..., 0] * r, found[..., 2], found[..., 0] * r * r, found[..., 1] * r)):
            total[:, k] += c.sum(axis=0)
    return total


def placed_sums(points: tuple, queries: tuple, u: np.ndarray, v: np.ndarray, leaf: int, far: float, width: float, near: float) -> np.ndarray:
    """The same as ``earlier_sums`` with blocks of ``leaf`` events, where u and v have few values: columns are (event, place in ``u``, place in ``v``, r) in the order of events.

    A table over the values of u and v sums the points of all blocks so far, up to each u and near each v, so
    that a query takes its ranges of u from a few places of it. The cost grows with the tracks, by the size of the table
    for each block.
    """
    bins = int(far // width) + 1
    total = np.zeros((bins, 6))
    if not len(points[0]) or not len(queries[0]):
        return total
    bits = leaf.bit_length() - 1
    (at, pu, pv, pr), (asked, qu, qv, qr) = (((e >> bits), u[cu.min() : cu.max() + 1], v[cv.min() : cv.max() + 1], r) for e, cu, cv, r in (points, queries))
    (own_u, own_v), (q_u, q_v) = ((cu - cu.min(), cv - cv.min()) for _, cu, cv, _ in (points, queries))
    place = own_u * len(pv) + own_v
    edges = Windows(pu, pv, qu, pv[:1].repeat(len(qu)), far, width, near).u
    low, high = Windows(pu, pv, pu[:1].repeat(len(qv)), qv, far, width, near).v.T
    wish, power = edges[q_u] * len(qv) + q_v[:, None], np.stack([np.ones(len(qr)), qr, qr * qr])
    starts = np.r_[np.flatnonzero(np.r_[True, asked[1:] != asked[:-1]]), len(asked)]
    table, corner, taken = np.zeros((3, len(pu) * len(pv))), np.zeros((3, len(pu) + 1, len(pv) + 1)), 0
    sums = np.zeros((3, 3 * (2 * bins - 1)))
    for lo, hi in zip(starts[:-1], starts[1:], strict=True):
        upto = int(np.searchsorted(at, asked[lo]))
        if upto > taken:
            here, w = place[taken:upto], pr[taken:upto]
            for k, w_ in enumerate((None, w, w * w)):
                table[k] += np.bincount(here, w_, table.shape[1])
            np.cumsum(np.cumsum(table.reshape(3, len(pu), -1), axis=1), axis=2, out=corner[:, 1:, 1:])
            taken = upto
        if taken:
            inside = np.subtract(corner.take(high, axis=2), corner.take(low, axis=2)).reshape(3, -1)
            strips = np.diff(inside.take(wish[lo:hi], axis=1), axis=2)
            sums += power[:, lo:hi] @ strips.transpose(1, 0, 2).reshape(hi - lo, -1)
    sums = sums.reshape(3, 3, -1)
    folded = sums[..., bins - 1 :].copy()
    folded[..., 1:] += sums[..., : bins - 1][..., ::-1]
    for k, (a, b) in enumerate(((0, 0), (1, 0), (0, 1), (2, 0), (0, 2), (1, 1))):  # powers of the residuals of points and of queries
        total[:, k] = folded[b, a]
    return total


def block_sums(held: tuple, others: tuple | None, far: float, width: float, near: float, leaf: int | None = None) -> np.ndarray:
    """The same for the pairs in one block of ``leaf`` (``LEAF``) events, one by one and in either order of events."""
    bins, leaf = int(far // width) + 1, (leaf or LEAF).bit_length() - 1
    total = np.zeros((bins, 6))
    order = np.lexsort((held[2], held[0] >> leaf))
    he, hu, hv, hr = (c[order] for c in held)
    oe, ou, ov, or_ = (he, hu, hv, hr) if others is None else others
    # one ordered key for (block, v), in which blocks lie further apart than any v; candidates are looked at again below
    span = 4 * (np.abs(np.concatenate([hv, ov])).max(initial=1) + near)
    key, at, slack = (he >> leaf) * span + hv, (oe >> leaf) * span + ov, near + 1e-9 * span * (1 + len(he))
    start = np.arange(1, len(at) + 1) if others is None else np.searchsorted(key, at - slack)
    count = np.maximum(np.searchsorted(key, at + slack, "right") - start, 0)
    ends, lo = np.cumsum(count), 0
    while lo < len(at):
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + AT_ONCE, "right")))
        n = count[lo:hi]
        j = np.repeat(np.arange(lo, hi), n)
        i = np.repeat(start[lo:hi] - (ends[lo:hi] - n - before), n) + np.arange(n.sum())
        du = np.abs(hu[i] - ou[j])
        ok = np.flatnonzero(du <= far)
        i, j, du = i[ok], j[ok], du[ok]
        ok = np.flatnonzero((np.abs(hv[i] - ov[j]) < near) & (he[i] != oe[j]) & (he[i] >> leaf == oe[j] >> leaf))
        i, j, bin_ = i[ok], j[ok], np.floor(du[ok] / width).astype(np.int64)
        swap = he[i] > oe[j]
        a, b = np.where(swap, or_[j], hr[i]), np.where(swap, hr[i], or_[j])
        for k, w in enumerate((None, a, b, a * a, b * b, a * b)):
            total[:, k] += np.bincount(bin_, w, bins)
        lo = hi
    return total


def pair_sums(held: tuple, others: tuple | None, far: float, width: float, near: float, among: bool = False) -> np.ndarray:
    """Sums (bins, 6) over pairs of columns (event, u, v, r): of ``held`` with ``others``, or among themselves, or (``among``) both.

    A pair has different events, is no further apart than ``far`` in u and
    closer than ``near`` in v; bins of |du| are ``width`` wide and r1 is the
    residual of the earlier event.
    """
    two = others or tuple(c[:0] for c in held)
    n = len(held[0])
    events, e = np.unique(np.concatenate([held[0], two[0]]), return_inverse=True)
    u, cu = np.unique(np.concatenate([held[1], two[1]]), return_inverse=True)
    v, cv = np.unique(np.concatenate([held[2], two[2]]), return_inverse=True)
    held, two = (e[:n], *held[1:]), (e[n:], *two[1:])
    few = len(u) * len(v) <= PLACES
    leaf = min(LEAF, SMALL) if few else LEAF
    if few:
        sides = []
        for part, r in ((slice(0, n), held[3]), (slice(n, None), two[3])):
            order = np.argsort(e[part], kind="stable")
            sides.append((e[part][order], cu[part][order], cv[part][order], r[order]))
        earlier = lambda a, b: placed_sums(sides[a], sides[b], u, v, leaf, far, width, near)
    else:
        earlier = lambda a, b: earlier_sums((held, two)[a], (held, two)[b], len(events), far, width, near)
    total = 0.0
    if others is None or among:
        total = total + block_sums(held, None, far, width, near, leaf) + earlier(0, 0)
    if others is not None:
        total = total + block_sums(held, two, far, width, near, leaf) + earlier(0, 1) + earlier(1, 0)
    return total


def later_sums(tracks: DataFrame, far: float, width: float, near: float = 5.0, block: int = BLOCK, tasks: int | None = None) -> DataFrame:
    """Sums (dut, axis, bin, n, s1, s2, s11, s22, s12) over pairs of tracks of different events of a plane, along x and along y.

    ``tracks`` has dut, event_number, x, y and residuals rx, ry; every track is
    a reference for all later ones. Pairs are those of :func:`pair_sums`, with u
    along the axis. A plane is cut into cells a few windows wide; a track goes
    to its own cell and, near a border, to the cells before it, so that each
    pair meets once. Tracks go as arrays, a row per cell, and are shuffled once, to ``tasks`` tasks. Only
    those of a cell with more than ``block`` tracks are written and dealt again to several
    tasks: each holds a share while the shares behind it and the neighbours'
    tracks stream past. Tasks return sums by bin, never pairs.
    """
    spark = tracks.sparkSession
    ship(spark)
    place = " AND ".join(f"{c} IS NOT NULL AND NOT isnan({c}) AND abs({c}) < double('inf')" for c in "xy")
    rows = tracks.where(f"{place} AND event_number IS NOT NULL AND (rx IS NOT NULL OR ry IS NOT NULL)")
    rows = rows.select("dut", F.col("event_number").cast("long").alias("e"), *(F.col(c).cast("double").alias(c) for c in ("x", "y", "rx", "ry")))
    cell, plane = ["dut", "axis", "cu", "cv"], f"dut {dict(tracks.dtypes)['dut']}, axis int"
    values = "e array<long>, u array<double>, v array<double>, r array<double>"
    ddl = f"{plane}, cu long, cv long, kind int, {values}"
    fields = to_arrow_schema(_parse_datatype_string(ddl))
    packed = rows.mapInArrow(lambda b: pack(b, far, near, fields), ddl)
    packed = packed.repartition(tasks, *cell) if tasks else packed.repartition(*cell)
    result = f"{plane}, bin int, " + ", ".join(f"{c} double" for c in SUMS) + f", cu long, cv long, share int, kind int, {values}"
    outcome = to_arrow_schema(_parse_datatype_string(result))

    def summed(dealt: DataFrame, keys: list[str], most: int | None) -> DataFrame:
        return dealt.sortWithinPartitions(*keys, "kind").mapInArrow(lambda b: cell_sums(b, keys, far, width, near, block, most, outcome), result)

    found, seen = Scratch(spark, "correlation").counted(summed(packed, cell, block), "sums", pieces=F.count("share"))
    sums = found.where("share IS NULL").select("dut", "axis", "bin", *SUMS)
    if seen["pieces"]:
        pieces = found.where("share IS NOT NULL").select(*cell, "share", "kind", "e", "u", "v", "r")
        up_to = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        own, guests = pieces.where("kind = 0"), pieces.where("kind = 1")
        shares = own.groupBy(*cell).agg((F.max("share") + 1).alias("shares"))
        behind = own.where("share > 0").withColumns({"share": up_to(F.col("share")), "kind": F.lit(1)})
        guests = guests.join(shares, cell).withColumn("share", up_to(F.col("shares"))).select(*pieces.columns)
        again = own.unionByName(behind).unionByName(guests).repartition(*cell, "share")
        sums = sums.unionByName(summed(again, [*cell, "share"], None).select("dut", "axis", "bin", *SUMS))
    total = sums.groupBy("dut", "axis", "bin").agg(F.sum("n").cast("long").alias("n"), *(F.sum(c).alias(c) for c in SUMS[1:]))
    return total.withColumn("axis", F.when(F.col("axis") == 0, "x").otherwise("y"))


def pack(batches: Iterator[pa.RecordBatch], far: float, near: float, fields: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows (dut, axis, cu, cv, kind, arrays) of tracks (dut, e, x, y, rx, ry) that share a cell, for both axes; kind 1 are guests of a neighbour."""
    side = 4 * far, 32 * near
    reach = 1.01 * far, 1.01 * near  # what is sent too far finds no pair
    for table in gathered((pa.Table.from_batches([b]) for b in batches if b.num_rows), PACK):
        column = {c: table.column(c).to_numpy() for c in table.column_names}
        for axis, (a, b) in enumerate(("xy", "yx")):
            known = np.flatnonzero(table.column(f"r{a}").is_valid().to_numpy())
            u, v = column[a][known], column[b][known]
            cu, cv = (np.floor(c / d).astype(np.int64) for c, d in zip((u, v), side, strict=True))
            low_u, high_u, low_v = np.floor((u - reach[0]) / side[0]) < cu, np.floor((u + reach[0]) / side[0]) > cu, np.floor((v - reach[1]) / side[1]) < cv
            parts = [(0, 0, 0, np.arange(len(u)))] + [(1, i, j, np.flatnonzero(m)) for i, j, m in ((-1, 0, low_u), (-1, -1, low_u & low_v), (0, -1, low_v), (1, -1, high_u & low_v))]
            rows = np.concatenate([m for *_, m in parts])
            kind, to_u, to_v = (np.concatenate([np.full(len(p[3]), p[k]) for p in parts]) for k in range(3))
            keys = [column["dut"][known][rows], cu[rows] + to_u, cv[rows] + to_v, kind]
            order = np.lexsort(keys[::-1])
            heads = np.flatnonzero(first_rows(*(k[order] for k in keys))) if len(order) else np.zeros(0, np.int64)
            heads = np.union1d(heads, np.arange(0, len(order), LONGEST))  # a crowded cell has several rows
            ends, rows = pa.array(np.r_[heads, len(order)].astype(np.int32)), known[rows[order]]
            first = dict(zip(("dut", "cu", "cv", "kind"), (k[order][heads] for k in keys), strict=True)) | {"axis": np.full(len(heads), axis)}
            lists = {k: pa.ListArray.from_arrays(ends, pa.array(column[c][rows])) for k, c in (("e", "e"), ("u", a), ("v", b), ("r", f"r{a}"))}
            yield from pa.Table.from_arrays([lists[f.name].cast(f.type) if f.name in lists else pa.array(first[f.name], type=f.type) for f in fields], schema=fields).to_batches(max_chunksize=1000)


def cell_sums(batches: Iterator[pa.RecordBatch], keys: list[str], far: float, width: float, near: float, block: int, most: int | None, fields: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Sums by bin over the pairs of the cells ``keys``, whose rows come together with guests last; a cell with more than ``most`` tracks is passed on as pieces, numbered by shares."""
    total: dict[tuple, np.ndarray] = {}
    names = ["e", "u", "v", "r"]
    key, kept, held, passing, share, waiting, alone = None, [], None, [], None, 0, False  # waiting: tracks in kept or, later, in passing; alone: pairs of held are still to be summed

    def add(others: tuple | None) -> None:
        nonlocal alone
        found, alone = pair_sums(held, others, far, width, near, alone), False
        total[key[:2]] = total[key[:2]] + found if key[:2] in total else found

    def joined(parts: list) -> tuple:
        return tuple(np.concatenate(c) for c in zip(*parts, strict=True))

    def piece(parts: list, kind: int) -> Iterator[pa.RecordBatch]:
        for p in parts:
            row = dict(zip(keys, key, strict=False)) | {"share": share, "kind": kind} | {k: pa.array([v], type=fields.field(k).type) for k, v in zip(names, p, strict=True)}
            yield pa.RecordBatch.from_arrays([row[f.name] if f.name in names else pa.array([row.get(f.name)], type=f.type) for f in fields], schema=fields)

    for batch in batches:
        column = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in [*keys, "kind"]}
        ends = batch.column("e").offsets.to_numpy()
        flat = [batch.column(c).values.to_numpy() for c in names]
        for i in range(batch.num_rows):
            here, part = tuple(column[c][i] for c in keys), tuple(v[ends[i] : ends[i + 1]].copy() for v in flat)
            if here != key:
                if kept and share is None:
                    held = joined(kept)
                    add(None)
                if passing:
                    add(joined(passing))
                if kept and share is not None:
                    yield from piece(kept, 0)
                key, kept, held, passing, share, waiting = here, [], None, [], None, 0
            waiting += len(part[0])
            if column["kind"][i] == 0:
                kept.append(part)
                if most and waiting > most:
                    share = 0 if share is None else share
                    yield from piece(kept, 0)
                    kept, share, waiting = [], share + 1, 0
            elif share is not None:
                if kept:
                    yield from piece(kept, 0)
                    kept = []
                yield from piece([part], 1)
            else:
                if kept:
                    held, kept, waiting, alone = joined(kept), [], len(part[0]), True
                if held is not None:
                    passing.append(part)
                    if waiting > block:
                        add(joined(passing))
                        passing, waiting = [], 0
    if kept and share is not None:
        yield from piece(kept, 0)
    elif kept:
        held = joined(kept)
        add(None)
    if passing:
        add(joined(passing))
    rows = [(dut, axis, b, *v) for (dut, axis), sums in total.items() for b, v in enumerate(sums.tolist()) if v[0]]
    if rows:
        columns = dict(zip(["dut", "axis", "bin", *SUMS], zip(*rows, strict=True), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(columns.get(f.name, [None] * len(rows)), type=f.type) for f in fields], schema=fields)


def correlation(sums: DataFrame) -> DataFrame:
    """``sums`` with the Pearson correlation ``r`` (null where a side does not vary)."""
    n = F.col("n").cast("double")
    spread = lambda q, s: n * F.col(q) - F.col(s) * F.col(s)
    under = F.sqrt(spread("s11", "s1")) * F.sqrt(spread("s22", "s2"))
    return sums.withColumn("r", F.when(under > 0, (n * F.col("s12") - F.col("s1") * F.col("s2")) / under))
