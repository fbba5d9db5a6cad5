"""Hits to clusters: neighbouring pixels of an event, components, one row per cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hitloom.functions.expressions import morton
from hitloom.operators.components import connected_components
from hitloom.operators.events import EVENT, clusters_by_kernel
from hitloom.runtime import Scratch

#: Hits of one event and plane above which its clusters are found by joins instead of in one task.
DENSE = 1_000_000


def cluster_ids(hits: DataFrame, d_column: int, d_row: int, d_frame: int | None = None, dense: int = DENSE) -> DataFrame:
    """``hits`` with the number of their cluster in the event, counted in the order of first hits, and ``n_cluster``.

    Two hits are neighbours if they are no further apart than the given number
    of columns, rows and (if given) frames; a cluster is what neighbours
    connect. Ordinals are distinct in an event and plane. Events are dealt to
    tasks, in which whole batches of them are joined up at once; an event with
    more than ``dense`` hits on a plane is taken apart and its clusters are
    connected components of a pixel table.
    """
    scratch = Scratch(hits.sparkSession, "clusters")
    sizes = hits.groupBy(*EVENT).agg(F.count("*").alias("n")).where(F.col("n") > dense).select(*EVENT)
    crowded, seen = scratch.counted(sizes, "dense")
    if not seen["n"]:
        return clusters_by_kernel(hits, d_column, d_row, d_frame)
    # few at any size: each stands for more than ``dense`` rows
    rest = hits.join(F.broadcast(crowded), EVENT, "left_anti")
    own = clusters_by_joins(hits.join(F.broadcast(crowded), EVENT, "left_semi"), d_column, d_row, d_frame, scratch)
    return clusters_by_kernel(rest, d_column, d_row, d_frame).unionByName(own)


def clusters_by_joins(hits: DataFrame, d_column: int, d_row: int, d_frame: int | None, scratch: Scratch) -> DataFrame:
    """The same as one job over all hits: occupied pixels meet their neighbours by an equi-join and components do the rest."""
    axes = {"column": d_column, "row": d_row} | ({} if d_frame is None else {"frame": d_frame})
    pixel = [*EVENT, *axes]
    # the numbers are drawn once, as the table is written
    vertices = scratch.table(hits.groupBy(*pixel).agg(F.min("ordinal").alias("first")).withColumn("id", F.monotonically_increasing_id()), "pixels")
    # a pixel goes to the few cells that its reach touches, and meets each neighbour in the neighbour's own cell
    cell = lambda c, by=0: F.floor((F.col(c) + by) / (2 * (axes[c] + 1)))
    there = vertices
    for c, d in axes.items():
        there = there.withColumn(f"cell_{c}", F.explode(F.sequence(cell(c, -d), cell(c, d))))
    own = vertices.select(F.col("id").alias("other"), *EVENT, *(F.col(c).alias(f"other_{c}") for c in axes), *(cell(c).alias(f"cell_{c}") for c in axes))
    links = there.join(own, [*EVENT, *(f"cell_{c}" for c in axes)]).where("id < other")
    for c, d in axes.items():
        links = links.where(F.abs(F.col(c) - F.col(f"other_{c}")) <= d)
    links = links.select(F.col("id").alias("a"), F.col("other").alias("b"))
    found = connected_components(links, scratch=scratch)
    named = vertices.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    named = scratch.table(named, "named")
    firsts = named.groupBy(*EVENT, "component").agg(F.min("first").alias("first"))
    by_event = Window.partitionBy(*EVENT)
    numbers = firsts.withColumns({"cluster_id": (F.row_number().over(by_event.orderBy("first")) - 1).cast("int"), "n_cluster": F.count("*").over(by_event).cast("int")})
    return hits.join(named.select(*pixel, "component"), pixel).join(numbers.drop("first"), [*EVENT, "component"]).select(*hits.columns, "cluster_id", "n_cluster")


def build_clusters(cluster_hits: DataFrame, weighted: bool = False, charge_correction: float = 0.0, extra: list[Column] = ()) -> DataFrame:
    """One row per cluster: size, charge, seed (largest charge, then first), mean position, frame, extent, shape.

    ``extra`` are further aggregates over the hits of a cluster.
    """
    key = [*EVENT, "cluster_id"]
    first = F.min_by(F.struct("column", "row"), "ordinal")
    w = F.col("charge") + charge_correction
    mean = (lambda c: F.sum(w * F.col(c)) / F.sum(w)) if weighted else (lambda c: F.avg(c))
    low = Window.partitionBy(*key)
    bit = morton(F.col("column") - F.col("c0"), F.col("row") - F.col("r0"))
    # only hits within seven pixels of the first hit, and inside 8 x 8, set a bit
    near = (F.abs(F.col("column") - F.col("f.column")) < 8) & (F.abs(F.col("row") - F.col("f.row")) < 8)
    order = low.orderBy("ordinal").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = cluster_hits.withColumns({"c0": F.min("column").over(low), "r0": F.min("row").over(low), "f": F.first(F.struct("column", "row")).over(order)})
    rows = rows.withColumn("bit", F.when(near & (F.col("column") - F.col("c0") < 8) & (F.col("row") - F.col("r0") < 8), bit.cast("int")))
    shape = F.bit_or(F.when(F.col("bit") < 63, F.expr("shiftleft(1L, bit)")))
    large = (F.max("column") - F.min("column") >= 8) | (F.max("row") - F.min("row") >= 8) | F.max(F.coalesce(F.col("bit") == 63, F.lit(False)))
    seed = F.max(F.struct("charge", (-F.col("ordinal")).alias("o"), "column", "row"))
    return rows.groupBy(*key).agg(
        F.count("*").alias("n_hits"), F.sum("charge").alias("charge"), seed["column"].alias("seed_column"), seed["row"].alias("seed_row"),
        mean("column").alias("mean_column"), mean("row").alias("mean_row"), F.min("frame").alias("frame"),
        (F.max("column") - F.min("column")).alias("extent_column"), (F.max("row") - F.min("row")).alias("extent_row"),
        F.max("n_cluster").alias("n_cluster"), F.when(large, F.lit(-1)).otherwise(shape).cast("long").alias("cluster_shape"), *extra,
    )


def drop_noisy(cluster_hits: DataFrame, noisy: DataFrame) -> DataFrame:
    """Hits of clusters that have a pixel outside the (dut, column, row) list ``noisy``, which is joined as its size suggests."""
    rows = cluster_hits.join(noisy.select("dut", "column", "row").distinct().withColumn("noisy", F.lit(True)), ["dut", "column", "row"], "left")
    good = rows.where("noisy IS NULL").select(*EVENT, "cluster_id").distinct()
    return rows.drop("noisy").join(good, [*EVENT, "cluster_id"], "left_semi")
