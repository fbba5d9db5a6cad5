"""Histograms as sparse long tables, binned means, moments, quantiles and stencils on small grids."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hitloom.runtime import Scratch, ship

#: Rows of the cells that hold medians up to which they are broadcast, and parts of a bin of the second count.
BROADCAST_CELLS, FINER = 10_000, 4096


def unit_bin(c: Column, n: int, strict: bool = False) -> Column:
    """Whole-number bin 0 to n - 1. Outside: null, or an error if ``strict``."""
    b = F.floor(c).cast("int")
    outside = F.raise_error(F.lit("value outside the histogram")).cast("int") if strict else F.lit(None).cast("int")
    return F.when((b >= 0) & (b < n), b).otherwise(outside)


def edge_bin(c: Column, lo: float, hi: float, n: int) -> Column:
    """Bin of n equal half-open ones, the last closed; null outside."""
    b = F.floor((c - lo) * (n / (hi - lo))).cast("int")
    return F.when((c >= lo) & (c <= hi), F.least(b, F.lit(n - 1)))


def counts(df: DataFrame, **bins: Column) -> DataFrame:
    """Number of rows per bin; rows with a null bin are outside."""
    out = df.groupBy(*(c.alias(k) for k, c in bins.items())).agg(F.count("*").alias("n"))
    return out.dropna(subset=list(bins))


def moments(hist: DataFrame, by: list[str], at: str, n: str = "n") -> DataFrame:
    """Mean, RMS and median of a histogram from its bins and counts."""
    total = F.sum(n)
    mean = F.sum(F.col(n) * F.col(at)) / total
    square = F.sum(F.col(n) * F.col(at) * F.col(at)) / total
    return hist.groupBy(*by).agg(mean.alias("mean"), F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("rms"), F.expr(f"percentile({at}, 0.5, {n})").alias("median"))


def peak_width(hist: DataFrame, by: list[str], at: str, n: str = "n") -> DataFrame:
    """First and last bin at half of the largest count or above, their centre and width, and the fullest bin."""
    top = Window.partitionBy(*by)
    rows = hist.withColumn("top", F.max(n).over(top))
    high = rows.where(F.col(n) * 2 >= F.col("top"))
    return high.groupBy(*by).agg(F.min(at).alias("lo"), F.max(at).alias("hi"), F.max(F.struct(F.col(n), (-F.col(at)).alias("at"))).alias("m")).select(
        *by, "lo", "hi", ((F.col("lo") + F.col("hi")) / 2).alias("center"), (F.col("hi") - F.col("lo") + 1).alias("width"), (-F.col("m.at")).alias("max_at")
    )


def quantile_mask(hist: DataFrame, by: list[str], at: str, low: float = 0.05, high: float = 0.95, n: str = "n") -> DataFrame:
    """Bins with ``low`` <= cumulative share and not above ``high``."""
    w = Window.partitionBy(*by)
    run = F.sum(n).over(w.orderBy(at).rowsBetween(Window.unboundedPreceding, 0)) / F.sum(n).over(w)
    return hist.withColumn("share", run).withColumn("inside", (F.col("share") >= low) & ~(F.col("share") > high))


def stencil(cells: DataFrame, by: list[str], size: int) -> DataFrame:
    """Each cell (col, row_, n) meets the filled cells of its size x size neighbourhood: explode to offsets, equi-join."""
    half = size // 2
    offsets = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-half, half + 1) for j in range(-half, half + 1)))
    around = cells.select(*by, "col", "row_", F.explode(offsets).alias("o")).select(*by, "col", "row_", (F.col("col") + F.col("o.i")).alias("c2"), (F.col("row_") + F.col("o.j")).alias("r2"))
    other = cells.select(*by, F.col("col").alias("c2"), F.col("row_").alias("r2"), F.col("n").alias("n2"))
    return around.join(other, [*by, "c2", "r2"])


def median_filter(cells: DataFrame, by: list[str], size: int = 3) -> DataFrame:
    """Median over the neighbourhood, where empty and outside cells are zeros; for filled cells only."""
    n, rank = size * size, (size * size) // 2
    near = stencil(cells, by, size).groupBy(*by, "col", "row_").agg(F.sort_array(F.collect_list("n2")).alias("v"))  # at most size x size values
    zeros = F.lit(n) - F.size("v")
    return near.select(*by, "col", "row_", F.when(zeros > rank, F.lit(0)).otherwise(F.get("v", F.lit(rank) - zeros)).cast("long").alias("expected"))


def noise_mask(cells: DataFrame, by: list[str], threshold: float, size: int, rounds: int | None = None) -> DataFrame:
    """Pixels that stand out of their median neighbourhood by ``threshold`` sigmas: (by, col, row_, n, masked).

    Masked pixels take the expected value for the next round. A detector is done
    after the round that finds no new pixel, or after ``rounds``. The occupancy
    table has one row per pixel of the detector, whatever the number of hits;
    each round is written, so that the next one's plan starts there.
    """
    scratch = Scratch(cells.sparkSession, "noise")
    state, done = cells.select(*by, "col", "row_", "n").withColumn("masked", F.lit(False)), 0
    state = scratch.table(state, "round")
    while rounds is None or done < rounds:
        known = state.join(median_filter(state, by, size), [*by, "col", "row_"])
        known = known.withColumn("diff", F.when(F.col("n") != 0, (F.col("n") - F.col("expected")) / F.sqrt("n")))
        known = known.join(known.groupBy(*by).agg(F.stddev_pop("diff").alias("sigma")), by)
        known = known.withColumn("new", F.coalesce(F.col("diff") > threshold * F.col("sigma"), F.lit(False)))
        fresh = F.col("new") & ~F.col("masked")
        live = known.groupBy(*by).agg(F.bool_or(fresh).alias("live"))
        known = known.join(live, by).withColumn("fresh", fresh).withColumn("masked", F.col("masked") | F.col("new") & F.col("live"))
        after = known.select(*by, "col", "row_", F.when(F.col("masked") & F.col("live"), F.col("expected")).otherwise(F.col("n")).cast("long").alias("n"), "masked", "fresh")
        before, (state, seen) = state, scratch.counted(after, "round", fresh=F.count_if("fresh"))
        state, done = state.drop("fresh"), done + 1
        scratch.release(before)
        if not seen["fresh"]:
            break
    return state


def nearest_fill(cells: DataFrame, wanted: DataFrame, by: list[str]) -> DataFrame:
    """Missing cells take the value of the nearest filled one (ties: smallest column, then row); null only where none is filled.

    An exact distance transform in two passes. Along each column that has filled
    cells, every row that misses one finds the last filled cell above and the next
    below; these rows are at most the grid. Then the columns of one row compete: the
    lower envelope of their parabolas, in whole numbers, gives the winner of each
    missing cell. ``by`` names at least one key; a column or a row of a detector
    is the largest group. Keys are not null; a cell wanted twice is returned once.
    """
    cell = [*by, "col", "row_"]
    ship(cells.sparkSession)
    filled = cells.select(*cell, "n")
    missing = wanted.select(*cell).distinct().join(filled, cell, "left_anti")
    lines = filled.select(*by, "col").distinct().join(missing.select(*by, "row_").distinct(), by)
    one = F.struct(F.col("row_").alias("at"), "n")
    points = filled.withColumn("own", one).unionByName(lines.withColumns({"n": F.lit(None).cast(filled.schema["n"].dataType), "own": F.lit(None).cast(filled.select(one).schema[0].dataType)}))
    column = Window.partitionBy(*by, "col").orderBy("row_")
    above = F.last("own", ignorenulls=True).over(column.rangeBetween(Window.unboundedPreceding, 0))
    below = F.first("own", ignorenulls=True).over(column.rangeBetween(0, Window.unboundedFollowing))
    near = points.withColumns({"a": above, "b": below}).where("own IS NULL")
    up = F.col("a").isNotNull() & (F.col("b").isNull() | (F.col("row_") - F.col("a.at") <= F.col("b.at") - F.col("row_")))
    near = near.select(*by, "row_", "col", F.abs(F.col("row_") - F.when(up, F.col("a.at")).otherwise(F.col("b.at"))).cast("long").alias("d"), F.when(up, F.col("a.n")).otherwise(F.col("b.n")).alias("n"))
    # filled columns carry d, missing cells do not
    both = near.unionByName(missing.select(*by, "row_", "col", F.lit(None).cast("long").alias("d"), F.lit(None).cast(filled.schema["n"].dataType).alias("n")))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in filled.schema)

    def nearest(g: pd.DataFrame) -> pd.DataFrame:
        seeds, out = g[g["d"].notna()].sort_values("col"), g[g["d"].isna()][[*cell, "n"]]
        if len(seeds) and len(out):
            won = envelope(seeds["col"].to_numpy("int64"), seeds["d"].to_numpy("int64"), out["col"].to_numpy("int64"))
            out = out.assign(n=seeds["n"].to_numpy()[won])
        return out

    return filled.unionByName(both.groupBy(*by, "row_").applyInPandas(nearest, kinds))


def envelope(at: np.ndarray, d: np.ndarray, x: np.ndarray) -> np.ndarray:
    """For each ``x`` the index of the smallest (x - at)^2 + d^2, of equal ones the first; ``at`` ascends without repeats."""
    places, heights = at.tolist(), (d * d + at * at).tolist()
    kept, begins = [0], [int(x.min())]
    for i in range(1, len(places)):
        while True:
            j = kept[-1]
            begin = (heights[i] - heights[j]) // (2 * (places[i] - places[j])) + 1  # from here on, i is nearer than j
            if begin > begins[-1]:
                kept.append(i)
                begins.append(begin)
                break
            if len(kept) == 1:  # nearer from the first x on
                kept[0] = i
                break
            kept.pop()
            begins.pop()
    return np.array(kept)[np.searchsorted(begins, x, side="right") - 1]


def quantiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Exact quantiles of each group, interpolated between ranks as usual: a column for each entry of ``shares``.

    The different values of all groups are dealt by range of (group, value) and
    written; counts of a group's ranges tell in which ranges its wanted ranks
    lie, and only these are put in order. Ranges are as large as a partition,
    whatever the spread of the values and however large one group. Nulls do
    not count; keys must not be null.
    """
    scratch = Scratch(df.sparkSession, "quantiles")
    values = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("v")).groupBy(*by, "v").agg(F.count("*").alias("m"))
    values = scratch.table(values.repartitionByRange(*by, "v").withColumn("range_", F.spark_partition_id()), "values")
    counts = values.groupBy(*by, "range_").agg(F.sum("m").alias("m"))
    up_to = lambda keys, at: Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("end", F.sum("m").over(up_to(by, "range_"))).withColumn("start", F.col("end") - F.col("m"))  # a row for each range of a group
    wanted = F.explode(F.array(*(F.struct(F.lit(k).alias("name"), (F.lit(float(q)) * (F.col("total") - 1)).alias("r")) for k, q in shares.items())))
    ranks = counts.groupBy(*by).agg(F.sum("m").alias("total")).select(*by, wanted.alias("w")).select(*by, "w.name", "w.r", F.floor("w.r").alias("k0"), F.ceil("w.r").alias("k1"))
    holds = lambda k: (F.col("start") <= F.col(k)) & (F.col(k) < F.col("end"))
    ranges = counts.join(ranks, by).where(holds("k0") | holds("k1")).select(*by, "range_", F.col("start").alias("before")).distinct()
    inside = values.join(ranges, [*by, "range_"]).withColumn("end", F.col("before") + F.sum("m").over(up_to([*by, "range_"], "v"))).withColumn("start", F.col("end") - F.col("m"))
    ends = inside.join(ranks, by).groupBy(*by, "name", "r", "k0").agg(F.max(F.when(holds("k0"), F.col("v"))).alias("v0"), F.max(F.when(holds("k1"), F.col("v"))).alias("v1"))
    found = ends.withColumn("q", F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col("r") - F.col("k0")))
    return found.groupBy(*by).agg(*(F.max(F.when(F.col("name") == k, F.col("q"))).alias(k) for k in shares))


def medians(rows: DataFrame, by: list[str], value: str, cells: list[Column]) -> tuple[DataFrame, DataFrame]:
    """Exact medians (by, median) of values that are not null, and the counts (by, cell_0, m, mean, var, least, most) by the first of ``cells``.

    ``cells`` grow with the value and are ever finer; rows are counted by the first one, those of the
    cells that hold the middle ranks by the next, and by value at last. No value is shuffled or put in order but those of the
    last cells; ``rows`` are read once for each count.
    """
    scratch, keys, found = Scratch(rows.sparkSession, "medians"), list(by), None
    stats = F.count("*").alias("m"), F.avg(value).alias("mean"), F.var_pop(value).alias("var"), F.min(value).alias("least"), F.max(value).alias("most")
    first = scratch.table(rows.groupBy(*keys, cells[0].alias("cell_0")).agg(*stats), "cells")
    rank = 0.5 * (F.sum("m").over(Window.partitionBy(*by)) - 1)
    counts = first.select(*by, "cell_0", "m").withColumns({"rank_": rank, "base_": F.lit(0).cast("long")})
    holds = lambda k: (F.col("start") <= k(F.col("rank_"))) & (k(F.col("rank_")) < F.col("end"))
    for k, cell in enumerate([*cells[1:], F.col(value)], 1):
        last = f"cell_{k - 1}"
        counts = counts.withColumn("end", F.col("base_") + F.sum("m").over(Window.partitionBy(*keys).orderBy(last).rowsBetween(Window.unboundedPreceding, 0))).withColumn("start", F.col("end") - F.col("m"))
        keys.append(last)
        middle, seen = scratch.counted(counts.where(holds(F.floor) | holds(F.ceil)).select(*keys, "rank_", F.col("start").alias("base_")), "middle")  # two a group at most
        inside = rows.withColumns({f"cell_{i}": c for i, c in enumerate(cells[:k])}).join(F.broadcast(middle) if seen["n"] <= BROADCAST_CELLS else middle, keys)
        counts = inside.groupBy(*keys, "rank_", "base_", cell.alias(f"cell_{k}")).agg(F.count("*").alias("m"))
    last = f"cell_{len(cells)}"
    counts = counts.withColumn("end", F.col("base_") + F.sum("m").over(Window.partitionBy(*keys).orderBy(last).rowsBetween(Window.unboundedPreceding, 0))).withColumn("start", F.col("end") - F.col("m"))
    ends = counts.groupBy(*by, "rank_").agg(F.max(F.when(holds(F.floor), F.col(last))).alias("v0"), F.max(F.when(holds(F.ceil), F.col(last))).alias("v1"))
    return ends.select(*by, (F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col("rank_") - F.floor("rank_"))).alias("median")), first


def density_modes(df: DataFrame, by: list[str], value: str, width: str) -> DataFrame:
    """Mode of a Gaussian density estimate of each group: (by, n, median, sigma, mode); groups of ten rows or fewer have none.

    ``width`` is a column with the group's bandwidth. The density is taken on a
    grid of about one point a unit, half a standard deviation around the
    median, from a histogram with eight bins a bandwidth; of equal densities the
    first point counts. Values are counted by bin and never shuffled.
    """
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("value_"), F.col(width).cast("double").alias("w"))
    rows = rows.where("w IS NOT NULL")
    middle, hist = medians(rows, [*by, "w"], "value_", [F.floor(F.col("value_") / (F.col("w") / 8)), F.floor(F.col("value_") / (F.col("w") / 8 / FINER))])
    total = hist.groupBy(*by, "w").agg(F.sum("m").alias("n"), (F.sum(F.col("m") * F.col("mean")) / F.sum("m")).alias("centre"), (F.min("least") < F.max("most")).alias("varied"))
    spread = F.sum(F.col("m") * (F.col("var") + (F.col("mean") - F.col("centre")) * (F.col("mean") - F.col("centre"))))
    stats = hist.join(total, [*by, "w"]).where("n > 10 AND varied").groupBy(*by, "w", "n").agg(F.sqrt(spread / F.col("n")).alias("sigma")).join(middle, [*by, "w"])
    step, points = F.col("w") / 8, F.greatest(F.ceil("sigma"), F.lit(1)).cast("int")
    lo = F.col("median") - 0.5 * F.col("sigma")
    near = hist.select(*by, "w", F.col("cell_0").alias("bin"), "m").join(stats, [*by, "w"]).withColumn("at", (F.col("bin") + 0.5) * step).where(F.abs(F.col("at") - F.col("median")) <= 0.5 * F.col("sigma") + 6 * F.col("w"))
    grid = near.withColumn("i", F.explode(F.sequence(F.lit(0), points - 1)))
    grid = grid.withColumn("g", F.when(points > 1, lo + F.col("i") * (F.col("sigma") / (points - 1))).otherwise(lo))
    u = (F.col("at") - F.col("g")) / F.col("w")
    density = grid.groupBy(*by, "n", "median", "sigma", "i", "g").agg(F.round(F.sum(F.col("m") * F.exp(-0.5 * u * u)), 6).alias("d"))
    return density.groupBy(*by, "n", "median", "sigma").agg(F.max_by("g", F.struct("d", (-F.col("i")).alias("i"))).alias("mode"))
