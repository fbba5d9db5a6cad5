"""Connected components of an edge table by alternating large-star and small-star steps.

Both steps are a grouped minimum and an equi-join on the vertex, so a hub is
pre-aggregated before its shuffle and its join can be split by AQE. The number
of rounds grows with the logarithm of the longest chain. Labels and edges stay
in the cluster; only a count and a checksum of each round reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitloom.runtime import Scratch


def _write(scratch: Scratch, edges: DataFrame) -> tuple[DataFrame, dict]:
    """The edges as a table, with a count and checksums taken while writing."""
    return scratch.counted(edges, "edges", x=F.expr("bit_xor(xxhash64(hi, lo))"), s=F.sum(F.col("lo").cast("decimal(38,0)")))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", scratch: Scratch | None = None) -> DataFrame:
    """Rows ``(id, component)`` for every vertex of ``edges``; component is the smallest id.

    ``a`` and ``b`` are integer columns; order and repeats do not matter, rows
    with a null end are ignored, and an edge from a vertex to itself yields
    that vertex alone. An empty table gives an empty result.
    """
    scratch = scratch or Scratch(edges.sparkSession, "components")
    pairs = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    loops = pairs.where("a = b").select(F.col("a").alias("id"))
    now, state = _write(scratch, pairs.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    while state["n"]:
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(now.select(F.col("lo"), F.col("hi")))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (
            large.join(least, "hi")
            .select(F.explode(F.array(F.struct(F.col("hi"), F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e"))
            .select("e.hi", "e.lo")
            .where("hi <> lo")
            .distinct()
        )
        new, after = _write(scratch, small)
        scratch.release(now)
        done = after == state
        now, state = new, after
        if done:
            break
    stars = now.groupBy("hi").agg(F.min("lo").alias("component")).withColumnRenamed("hi", "id")
    roots = now.select(F.col("lo").alias("id"), F.col("lo").alias("component"))
    alone = loops.select("id", F.col("id").alias("component"))
    return stars.unionAll(roots).unionAll(alone).groupBy("id").agg(F.min("component").alias("component"))
