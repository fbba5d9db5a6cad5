"""Reading and writing detector tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hitloom.operators.joins import row_before

#: The fixed core of a hit table; further columns pass through.
CORE = {"event_number": "bigint", "dut": "int", "frame": "int", "column": "int", "row": "int", "charge": "double"}


def as_hits(df: DataFrame) -> DataFrame:
    """Core columns in their types, then all others as they are."""
    extra = [c for c in df.columns if c not in CORE]
    return df.select(*(F.col(c).cast(t).alias(c) for c, t in CORE.items()), *extra)


def position_columns(df: DataFrame) -> tuple[Column, Column, bool]:
    """The best position a table has: x, y, then mean_x, mean_y, else indices (the flag tells positions from indices)."""
    have = set(df.columns)
    for a, b, is_position in (("x", "y", True), ("mean_x", "mean_y", True), ("mean_column", "mean_row", False), ("column", "row", False)):
        if {a, b} <= have:
            return F.col(a), F.col(b), is_position
    raise ValueError("the table has neither positions nor indices")


def event_range(df: DataFrame, start: int | None, stop: int | None) -> DataFrame:
    """Events from ``start`` up to but not including ``stop``; both reach the scan as filters."""
    if start is not None:
        df = df.where(F.col("event_number") >= start)
    return df if stop is None else df.where(F.col("event_number") < stop)


def write_by_plane(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Partitioned by plane and dealt to tasks by ranges of plane and event, so that plane and event filters skip files and row groups.

    ``mode``: "overwrite" replaces the whole table, "append" adds rows to it,
    "replace" replaces the planes of ``df`` and leaves all others.
    """
    rows = df.repartitionByRange("dut", "event_number").sortWithinPartitions("dut", "event_number", *[c for c in ("ordinal",) if c in df.columns])
    writer = rows.write.mode("append" if mode == "append" else "overwrite").partitionBy("dut")
    if mode == "replace":
        writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def combine_runs(runs: list[DataFrame], offsets: list[int] | None = None) -> DataFrame:
    """Concatenate runs with their events shifted by ``offsets``, by default so that each run starts after the last event of the runs before it."""
    spark = runs[0].sparkSession
    if offsets is None:
        ends = reduce(DataFrame.unionByName, (r.agg(F.max("event_number").alias("last")).select(F.lit(i).alias("run"), "last") for i, r in enumerate(runs)))
        before = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)  # one row per run
        table = ends.withColumn("offset", F.coalesce(F.sum(F.coalesce(F.col("last") + 1, F.lit(0))).over(before), F.lit(0))).select("run", "offset")
    else:
        table = spark.createDataFrame(list(enumerate(offsets)), "run int, offset long")
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (r.withColumn("run", F.lit(i)) for i, r in enumerate(runs)))
    return rows.join(F.broadcast(table), "run").withColumn("event_number", F.col("event_number") + F.col("offset")).drop("offset")


def in_order(df: DataFrame, order: list[str], by: list[str] = (), width: int = 100_000) -> DataFrame:
    """``df`` as it is; reading it fails if an event number is smaller than that of the row before it in ``order``."""
    rows = row_before(df, "event_number", order, list(by), width)
    wrong = F.raise_error(F.concat(F.lit("event number decreases at "), F.col("event_number").cast("string"))).cast("long")
    return rows.withColumn("event_number", F.when(F.col("before") > F.col("event_number"), wrong).otherwise(F.col("event_number"))).drop("before")


def import_renamed(raw: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Raw names to hit names: relative_BCID is the frame and tot the charge; with ``order``, decreasing event numbers are an error."""
    named = as_hits(raw.withColumnsRenamed({"relative_BCID": "frame", "tot": "charge"}))
    return named if order is None else in_order(named, order, ["dut"])


def import_interleaved(raw: DataFrame, planes: list[int]) -> DataFrame:
    """One table of several planes with indices from 0 to hits of the named planes with indices from 1."""
    ids = raw.sparkSession.createDataFrame([(p, i) for i, p in enumerate(planes)], "plane int, dut int")
    rows = raw.join(F.broadcast(ids), "plane").withColumns({"column": F.col("column") + 1, "row": F.col("row") + 1, "frame": F.lit(0), "charge": F.lit(0.0)})
    return as_hits(rows.drop("plane"))


def write_histograms(cells: DataFrame, edges: dict[str, tuple], path: str) -> str:
    """Long cells (dut, hist, bin_x, bin_y, n, ... any means and masks) and beside them the axes: ``edges`` has (first edge, width, bins) of x and y for each hist."""
    cells.write.mode("overwrite").partitionBy("hist").parquet(f"{path}/cells")
    axes = [(k, *map(float, x[:2]), x[2], *map(float, y[:2]), y[2]) for k, (x, y) in edges.items()]
    cells.sparkSession.createDataFrame(axes, "hist string, x_first double, x_width double, x_bins int, y_first double, y_width double, y_bins int").coalesce(1).write.mode("overwrite").parquet(f"{path}/axes")
    return path


def read_histograms(spark: SparkSession, path: str) -> DataFrame:
    """The cells with the lower and upper edges of their bins."""
    axes = spark.read.parquet(f"{path}/axes")
    side = lambda a, k: F.col(f"{a}_first") + (F.col(f"bin_{a}") + k) * F.col(f"{a}_width")
    rows = spark.read.parquet(f"{path}/cells").join(F.broadcast(axes), "hist")  # one row a histogram
    return rows.withColumns({f"{a}_{n}": side(a, k) for a in "xy" for n, k in (("lo", 0), ("hi", 1))}).drop(*(f"{a}_{c}" for a in "xy" for c in ("first", "width", "bins")))
