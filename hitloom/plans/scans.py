"""Queries on reading, writing, ordering and sampling."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Window
from pyspark.sql import functions as F

from hitloom.functions import geometry as G
from hitloom.functions.expressions import r6
from hitloom.operators import joins as J
from hitloom.operators import selection
from hitloom.operators.tracking import line_ends
from hitloom.plans.positions import global_hits, local_hits, sql
from hitloom.plans.registry import query
from hitloom.runtime import Scratch
from hitloom.sources import tables as T
from hitloom.sources import views

K = ["event_number", "dut", "ordinal"]


@query("scan_hits", sql('SELECT event_number, dut, frame, "column" AS col, "row" AS row_, charge, ordinal FROM hits'))
def scan_hits(spark, sf_dir):
    return T.as_hits(views.hits(spark, sf_dir)).withColumnsRenamed({"column": "col", "row": "row_"})


@query("scan_clusters_or_hits", sql('SELECT event_number, dut, ordinal, CAST("column" AS DOUBLE) AS a, CAST("row" AS DOUBLE) AS b, false AS is_position FROM hits UNION ALL SELECT event_number, dut, ordinal, x, y, true FROM tracks'))
def scan_clusters_or_hits(spark, sf_dir):
    def found(df):
        a, b, is_position = T.position_columns(df)
        return df.select(*K, a.cast("double").alias("a"), b.cast("double").alias("b"), F.lit(is_position).alias("is_position"))

    return found(views.hits(spark, sf_dir)).unionAll(found(views.tracks(spark, sf_dir)))


@query("event_range_scan", sql('SELECT event_number, dut, ordinal, charge FROM hits WHERE event_number >= 500 AND event_number < 3000'))
def event_range_scan(spark, sf_dir):
    return T.event_range(views.hits(spark, sf_dir), 500, 3000).select(*K, "charge")


@query("import_hits_rename", sql('SELECT event_number, dut, frame % 16 AS frame, "column" AS col, charge FROM hits'))
def import_hits_rename(spark, sf_dir):
    """Raw tables of all planes; an event number that decreases in the order of arrival would be an error."""
    raw = views.hits(spark, sf_dir).withColumn("relative_BCID", F.col("frame") % 16).drop("frame").withColumnRenamed("charge", "tot").withColumn("arrival", F.col("event_number") * 16 + F.col("ordinal"))
    return T.import_renamed(raw, ["arrival", "ordinal"]).select("event_number", "dut", "frame", F.col("column").alias("col"), "charge")


@query("import_hits_split_planes", sql('SELECT event_number, CASE dut WHEN 2 THEN 0 ELSE 1 END AS dut, 0 AS frame, "column" AS col, "row" AS row_, 0e0 AS charge FROM hits WHERE dut <> 1'))
def import_hits_split_planes(spark, sf_dir):
    """Planes 2 and 0 of an interleaved table whose indices start at 0."""
    raw = views.hits(spark, sf_dir).select("event_number", F.col("dut").alias("plane"), (F.col("column") - 1).alias("column"), (F.col("row") - 1).alias("row"))
    return T.import_interleaved(raw, [2, 0]).withColumnsRenamed({"column": "col", "row": "row_"})


@query("write_table", sql('SELECT event_number, dut, ordinal, "column" AS col, charge FROM hits'))
def write_table(spark, sf_dir):
    """A table written in three ways: early events first, later ones appended, then plane 2 as a whole replaced."""
    path = Scratch(spark, "hits").path("hits")
    rows = views.hits(spark, sf_dir).select(*K, F.col("column").alias("col"), "charge")
    early = F.col("event_number") % 2 == 0
    T.write_by_plane(rows.where(early & (F.col("dut") < 2)), path)
    T.write_by_plane(rows.where(~early | (F.col("dut") == 2)).where("dut < 2 OR charge > 10"), path, "append")
    T.write_by_plane(rows.where("dut = 2"), path, "replace")
    return spark.read.schema(rows.schema).parquet(path).select(rows.columns)


def _hist_sql(name: str, x: str, y: str, width_x: float, width_y: float) -> str:
    return (f"""SELECT dut, '{name}' AS hist, {x} AS bin_x, {y} AS bin_y, count(*) AS n, CAST(({x}) * {width_x} AS DOUBLE) AS x_lo, CAST(({x} + 1) * {width_x} AS DOUBLE) AS x_hi,
      CAST(({y}) * {width_y} AS DOUBLE) AS y_lo, CAST(({y} + 1) * {width_y} AS DOUBLE) AS y_hi, count(*) < 20 AS masked FROM hits GROUP BY ALL""")


@query("write_histogram", sql(_hist_sql("occupancy", '"column" - 1', '"row" - 1', 100, 50) + " UNION ALL " + _hist_sql("charge", "CAST(floor(charge / 2) AS INT)", "0", 2, 1)))
def write_histogram(spark, sf_dir):
    """Two histograms in one table, with the edges of their bins and a mask of bins with fewer than 20 hits; edges stand in a table of their own."""
    hits = views.hits(spark, sf_dir)
    occ = hits.groupBy("dut", (F.col("column") - 1).alias("bin_x"), (F.col("row") - 1).alias("bin_y")).agg(F.count("*").alias("n")).withColumn("hist", F.lit("occupancy"))
    charge = hits.groupBy("dut", F.floor(F.col("charge") / 2).cast("int").alias("bin_x")).agg(F.count("*").alias("n")).withColumns({"hist": F.lit("charge"), "bin_y": F.lit(0)})
    cells = occ.unionByName(charge).withColumn("masked", F.col("n") < 20)
    edges = {"occupancy": ((0.0, 100.0, 16), (0.0, 50.0, 16)), "charge": ((0.0, 2.0, 64), (0.0, 1.0, 1))}
    return T.read_histograms(spark, T.write_histograms(cells, edges, Scratch(spark, "histograms").path("histograms"))).select("dut", "hist", "bin_x", "bin_y", "n", "x_lo", "x_hi", "y_lo", "y_hi", "masked")


@query("combine_runs", sql("""
    WITH ends AS (SELECT dut, max(event_number) + 1 AS n FROM hits GROUP BY dut), offs AS (SELECT dut, coalesce(sum(n) OVER (ORDER BY dut ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM ends)
    SELECT 'after' AS offsets, CAST(dut AS INT) AS run, CAST(event_number + o AS BIGINT) AS event_number, ordinal, charge FROM hits JOIN offs USING (dut)
    UNION ALL SELECT 'given', CAST(dut AS INT), event_number + CASE dut WHEN 0 THEN 0 WHEN 1 THEN 1000000 ELSE 5000 END, ordinal, charge FROM hits"""))
def combine_runs(spark, sf_dir):
    """The planes' tables taken as three runs, one after another and with given offsets."""
    hits = views.hits(spark, sf_dir)
    runs = [hits.where(F.col("dut") == i).drop("dut") for i in range(3)]
    both = [T.combine_runs(runs, o).withColumn("offsets", F.lit(name)) for name, o in (("after", None), ("given", [0, 1_000_000, 5_000]))]
    return both[0].unionByName(both[1]).select("offsets", "run", "event_number", "ordinal", "charge")


@query("z_order", sql("SELECT dut, CAST(row_number() OVER (ORDER BY tz) - 1 AS INT) AS z_rank, count(*) AS n_hits FROM geo JOIN hits USING (dut) GROUP BY dut, tz"))
def z_order(spark, sf_dir):
    geo = G.geometry(spark, G.HIT_PLANES).withColumn("z_rank", F.row_number().over(Window.orderBy("tz")) - 1)
    return views.hits(spark, sf_dir).groupBy("dut").agg(F.count("*").alias("n_hits")).join(F.broadcast(geo.select("dut", "z_rank")), "dut").select("dut", "z_rank", "n_hits")


@query("top_k_bins", sql('SELECT dut, "column" AS col, "row" AS row_, count(*) AS n FROM hits GROUP BY ALL ORDER BY n DESC, dut, col, row_ LIMIT 20'))
def top_k_bins(spark, sf_dir):
    """The 20 fullest pixels."""
    occ = views.hits(spark, sf_dir).groupBy("dut", F.col("column").alias("col"), F.col("row").alias("row_")).agg(F.count("*").alias("n"))
    return occ.orderBy(F.desc("n"), "dut", "col", "row_").limit(20)


@query("sample_events", sql("SELECT event_number, dut, ordinal FROM hits WHERE event_number IN (SELECT event_number FROM (SELECT DISTINCT event_number FROM hits) AS e ORDER BY md5(concat(CAST(event_number AS VARCHAR), '#7')), event_number LIMIT 300)"))
def sample_events(spark, sf_dir):
    """Whole events, 300 of them, in the order of a seeded hash."""
    return selection.sample_events(views.hits(spark, sf_dir), 300, "7").select(*K)


@query("limit_tracks", sql("SELECT event_number, ordinal, chi2 FROM tracks WHERE dut = 0 ORDER BY event_number, ordinal LIMIT 500"))
def limit_tracks(spark, sf_dir):
    return views.tracks(spark, sf_dir).where("dut = 0").orderBy("event_number", "ordinal").limit(500).select("event_number", "ordinal", "chi2")


@query("event_display", sql("SELECT event_number, dut, ordinal, round(gx / 1000, 6) + 0e0 AS x_mm, round(gy / 1000, 6) + 0e0 AS y_mm, round(gz / 1000, 6) + 0e0 AS z_mm FROM global_ WHERE event_number >= 100 AND event_number < 400"))
def event_display(spark, sf_dir):
    """Hits of an event range in global millimetres."""
    rows = T.event_range(global_hits(spark, sf_dir), 100, 400)
    return rows.select(*K, *(r6(F.col(f"g{a}") / 1000).alias(f"{a}_mm") for a in "xyz"))


#: Planes that stand at an angle, so that lines of an event end at different z.
LEANING = [replace(p, alpha=0.02 * p.dut, beta=-0.01 * p.dut) for p in G.TRACK_PLANES]
_RUN = "((tx - ix) * r13 + (ty - iy) * r23 + tz * r33) / (sx * r13 + sy * r23 + sz * r33)"


@query("event_display_tracks", sql(f"""
    WITH ends AS (SELECT event_number, ordinal, g.dut, round((ix + run * sx) / 1000, 6) + 0e0 AS x, round((iy + run * sy) / 1000, 6) + 0e0 AS y, round(run * sz / 1000, 6) + 0e0 AS z
      FROM (SELECT t.*, g.dut AS at, {_RUN} AS run FROM (SELECT * EXCLUDE (z) FROM tracks WHERE dut = 0 AND event_number >= 100 AND event_number < 400) AS t, ({G.sql_values(LEANING)}) AS g WHERE g.dut IN (0, 5)) AS r JOIN (SELECT unnest([0, 5]) AS dut) AS g ON g.dut = r.at)
    SELECT a.event_number, a.ordinal, {", ".join(f"{s}.{c} AS {k}_{c}_mm" for s, k in (("a", "first"), ("b", "last")) for c in "xyz")} FROM ends AS a JOIN ends AS b USING (event_number, ordinal) WHERE a.dut = 0 AND b.dut = 5"""))
def event_display_tracks(spark, sf_dir):
    """Lines of the tracks of an event range: where they cross the first and the last plane, in millimetres."""
    rows = T.event_range(views.tracks(spark, sf_dir), 100, 400).where("dut = 0")
    lines = rows.select("event_number", "ordinal", F.col("ix").alias("ox"), F.col("iy").alias("oy"), F.lit(0.0).alias("oz"), "sx", "sy", "sz")
    return line_ends(lines, LEANING).select("event_number", "ordinal", *(r6(F.col(f"{k}_{a}") / 1000).alias(f"{k}_{a}_mm") for k in ("first", "last") for a in "xyz"))


ARRIVAL = "event_number + 5 * (ordinal % 2), event_number, ordinal"


@query("hit_checks", sql(f"""
    WITH rows AS (SELECT *, lag(event_number) OVER (PARTITION BY dut ORDER BY {ARRIVAL}) AS before FROM local_)
    SELECT dut, count(*) FILTER ("column" < 1 OR "row" < 1) AS below, count(*) FILTER ("column" > 14 OR "row" > 15) AS above, count(*) FILTER (abs(lx) > 700) AS outside, count(*) FILTER (event_number < 0) AS negative,
      count(*) FILTER (before > event_number) AS decreasing FROM rows GROUP BY dut"""))
def hit_checks(spark, sf_dir):
    """Violations per plane against a matrix of 14 x 15 pixels, an extent of 700 and events that do not decrease in an order of arrival in which some do."""
    c, r = F.col("column"), F.col("row")
    rows = J.row_before(local_hits(spark, sf_dir).withColumn("arrival", F.expr(ARRIVAL.split(",")[0])), "event_number", ["arrival", "event_number", "ordinal"], ["dut"], 1000)
    rules = {"below": (c < 1) | (r < 1), "above": (c > 14) | (r > 15), "outside": F.abs("lx") > 700, "negative": F.col("event_number") < 0, "decreasing": F.col("before") > F.col("event_number")}
    return rows.groupBy("dut").agg(*(F.count_if(v).alias(k) for k, v in rules.items()))
