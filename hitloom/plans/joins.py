"""Queries on joins and flags."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Window
from pyspark.sql import functions as F

from hitloom.functions import expressions as X
from hitloom.functions import geometry as G
from hitloom.functions.expressions import r6
from hitloom.operators import clusters as C
from hitloom.operators import joins as J
from hitloom.operators.selection import isolated_rows, isolation_flags, query_filter, select_tracks
from hitloom.plans.clusters import clustered, sql as cluster_sql
from hitloom.plans.positions import DIAMONDS, global_hits, plane_tracks, sql
from hitloom.plans.registry import query
from hitloom.sources import views

TK = ["event_number", "ordinal"]


@query("merge_on_event", sql("SELECT a.event_number, a.ordinal AS i, b.ordinal AS j FROM hits AS a JOIN hits AS b ON a.event_number = b.event_number AND a.dut = 0 AND b.dut = 1"))
def merge_on_event(spark, sf_dir):
    h = views.hits(spark, sf_dir)
    return h.where("dut = 0").select("event_number", F.col("ordinal").alias("i")).join(h.where("dut = 1").select("event_number", F.col("ordinal").alias("j")), "event_number")


_MERGE = ", ".join(f'max(CASE WHEN dut = {p} THEN {c} END) AS {v}_dut_{p}' for p in range(3) for c, v in (('"column"', "col"), ("charge", "charge")))


@query("merge_clusters", sql(f"SELECT event_number, CAST(ordinal - 1 AS INT) AS k, {_MERGE}, CAST(bit_or(1 << dut) AS BIGINT) AS hit_flag FROM hits GROUP BY event_number, ordinal"))
def merge_clusters(spark, sf_dir):
    h = views.hits(spark, sf_dir).withColumnRenamed("column", "col")
    return J.merge_planes(h, ["col", "charge"], [0, 1, 2])


@query("event_multiset_max", sql("WITH n AS (SELECT event_number, max(n) AS n FROM (SELECT event_number, dut, count(*) AS n FROM hits WHERE dut < 2 GROUP BY ALL) AS c GROUP BY event_number) SELECT event_number FROM n, LATERAL (SELECT unnest(range(0, n))) AS r"))
def event_multiset_max(spark, sf_dir):
    h = views.hits(spark, sf_dir)
    return J.multiset_max(h.where("dut = 0"), h.where("dut = 1"))


@query("map_ordinal", sql('SELECT a.event_number, a.ordinal, b."column" AS col FROM (SELECT * FROM hits WHERE dut = 0) AS a LEFT JOIN (SELECT * FROM hits WHERE dut = 2) AS b ON a.event_number = b.event_number AND a.ordinal = b.ordinal'))
def map_ordinal(spark, sf_dir):
    h = views.hits(spark, sf_dir)
    return J.map_ordinal(h.where("dut = 0").select("event_number", "ordinal"), h.where("dut = 2").select("event_number", "ordinal", F.col("column").alias("col"))).select("event_number", "ordinal", "col")


@query("events_in_both", sql("SELECT event_number FROM hits WHERE dut = 0 INTERSECT SELECT event_number FROM hits WHERE dut = 2"))
def events_in_both(spark, sf_dir):
    h = views.hits(spark, sf_dir).select("event_number", "dut")
    return h.where("dut = 0").select("event_number").intersect(h.where("dut = 2").select("event_number"))


@query("events_semi", sql("SELECT event_number, ordinal FROM hits WHERE dut = 0 AND event_number IN (SELECT event_number FROM hits WHERE dut = 2)"))
def events_semi(spark, sf_dir):
    h = views.hits(spark, sf_dir)
    return h.where("dut = 0").join(h.where("dut = 2"), "event_number", "left_semi").select(*TK)


@query("lookup_join", sql("SELECT a.event_number, a.ordinal, coalesce(b.charge, -1e0) AS charge FROM (SELECT * FROM hits WHERE dut = 0) AS a LEFT JOIN (SELECT * FROM hits WHERE dut = 1) AS b ON a.event_number = b.event_number AND a.ordinal = b.ordinal"))
def lookup_join(spark, sf_dir):
    h = views.hits(spark, sf_dir)
    return J.lookup(h.where("dut = 0").select(*TK), h.where("dut = 1"), TK, "charge", fill=-1.0)


_EXTENT = """SELECT dut, """ + ", ".join(f"max(c{a}) - min(c{a}) AS size_{a}" for a in "xy") + """ FROM (
      SELECT dut, """ + ", ".join(f"r{i}1 * p * column_size * n_columns * 5e-1 + r{i}2 * q * row_size * n_rows * 5e-1 + t{a} AS c{a}" for i, a in enumerate("xy", 1)) + """
      FROM geo, (VALUES (-1), (1)) AS s(p), (VALUES (-1), (1)) AS t(q)) AS corners GROUP BY dut"""
_PLACED = "CAST(floor((g{a} - (t{a} - ceil(size_{a} / 100) * 50)) / 100) AS BIGINT)"


@query("plane_correlation", sql(f"""
    WITH extents AS ({_EXTENT}),
      bins AS (SELECT event_number, dut, 'column' AS axis, CAST(floor("column" / 2) AS BIGINT) AS bin FROM hits UNION ALL SELECT event_number, dut, 'row', CAST(floor("row" / 2) AS BIGINT) FROM hits
        {" ".join(f"UNION ALL SELECT event_number, dut, '{a}', b FROM (SELECT event_number, dut, size_{a}, {_PLACED.format(a=a)} AS b FROM global_ JOIN extents USING (dut)) AS t WHERE b >= 0 AND b < ceil(size_{a} / 100)" for a in "xy")})
    SELECT a.dut AS ref, b.dut, a.axis, a.bin AS bin_ref, b.bin, count(*) AS n FROM bins AS a JOIN bins AS b ON a.event_number = b.event_number AND a.axis = b.axis AND a.dut <> b.dut AND a.dut IN (0, 1) GROUP BY ALL"""))
def plane_correlation(spark, sf_dir):
    """By indices (two pixels a bin) and by global positions (100 micrometres a bin, over each plane's extent), on both axes in one pass."""
    bins = {"column": F.floor(F.col("column") / 2), "row": F.floor(F.col("row") / 2)} | {a: G.extent_bin(F.col(f"g{a}"), a, 100.0) for a in "xy"}
    return J.plane_correlation(G.with_extents(global_hits(spark, sf_dir), G.geometry(spark, G.HIT_PLANES), 100.0), bins, [0, 1])


@query("event_correlation", sql("""
    WITH bins AS (SELECT event_number, dut, 'column' AS axis, CAST("column" AS BIGINT) AS bin FROM hits UNION ALL SELECT event_number, dut, 'row', CAST("row" AS BIGINT) FROM hits)
    SELECT a.dut, a.axis, a.bin AS early, b.bin AS late, count(*) AS n FROM bins AS a JOIN (SELECT *, unnest([1, 2, 3]) AS back FROM bins) AS b
      ON a.dut = b.dut AND a.axis = b.axis AND a.event_number = b.event_number - b.back GROUP BY ALL"""))
def event_correlation(spark, sf_dir):
    """Columns and rows of each plane in an event and the three before it, summed per event first."""
    return J.event_correlation(views.hits(spark, sf_dir), {"column": F.col("column"), "row": F.col("row")}, 3)


@query("isolation_flags", sql("""
    SELECT event_number, ordinal, CAST(bit_or(CASE WHEN near THEN 0 ELSE 1 << dut END) AS BIGINT) AS isolated_flag
    FROM (SELECT a.event_number, a.ordinal, a.dut, coalesce(bool_or(((a.ix - b.ix) / 1000) ** 2 + ((a.iy - b.iy) / 1000) ** 2 <= 1), false) AS near
      FROM tracks AS a LEFT JOIN tracks AS b ON a.event_number = b.event_number AND a.dut = b.dut AND a.ordinal <> b.ordinal GROUP BY ALL) AS t GROUP BY ALL"""))
def isolation_flags_query(spark, sf_dir):
    """Bit per plane: no other track of the event within an ellipse of 1000 micrometres."""
    return isolation_flags(views.tracks(spark, sf_dir), "ix", "iy", 1000.0, 1000.0)


@query("nearest_pixel", sql("SELECT event_number, ordinal, dut, CAST(floor(ix / 184e-1 + 576) + 1 AS INT) AS col, CAST(floor(iy / 184e-1 + 288) + 1 AS INT) AS row_ FROM tracks WHERE abs(ix) < 105984e-1 AND abs(iy) < 52992e-1"))
def nearest_pixel(spark, sf_dir):
    """On a rectangular matrix the nearest centre is arithmetic; positions outside are dropped."""
    t = views.tracks(spark, sf_dir)
    inside = (F.abs("ix") < 576 * 18.4) & (F.abs("iy") < 288 * 18.4)
    return t.where(inside).select(*TK, "dut", (F.floor(F.col("ix") / 18.4 + 576) + 1).cast("int").alias("col"), (F.floor(F.col("iy") / 18.4 + 288) + 1).cast("int").alias("row_"))


@query("nearest_pixel_irregular")
def nearest_pixel_irregular(spark, sf_dir):
    """Crossing points to the pixels of two diamond sensors (planes by turns), met over a grid; without SQL, as a nested loop over all pixels is too slow."""
    planes = [replace(DIAMONDS[i % 2], dut=i) for i in range(6)]
    pixels = G.pixel_positions(spark, planes, {p.dut: (p.name, (38, 140)) for p in planes})
    t = views.tracks(spark, sf_dir).select(*TK, "dut", "ix", "iy")
    found = J.nearest_pixel(t, pixels, "ix", "iy", 500.0, 40 * 250.0, 168 * 50.0)
    return found.select(*TK, "dut", F.col("column").alias("col"), F.col("row").alias("row_"))


@query("nearest_value", sql("""
    SELECT h.event_number, h.ordinal, h.dut, max((SELECT v FROM (VALUES (1), (4), (9), (16)) AS g(v) ORDER BY abs(v - h."column"), v DESC LIMIT 1)) AS nearest,
      arg_min(p."column", abs(p."column" - h."column") * 1000 - p."column") AS nearest_hit
    FROM hits AS h LEFT JOIN (SELECT * FROM hits WHERE dut = 0) AS p ON p.event_number = h.event_number GROUP BY h.event_number, h.ordinal, h.dut"""))
def nearest_value(spark, sf_dir):
    """Columns to the nearest of a fixed list, and to the nearest column that plane 0 has in the event (null: none)."""
    h = views.hits(spark, sf_dir).select("event_number", "dut", "ordinal", "column")
    own = h.withColumn("nearest", J.nearest_of(F.col("column"), [1, 4, 9, 16]))
    grid = h.where("dut = 0").select("event_number", F.col("column").alias("v"))
    return J.nearest_value(own, "column", grid, ["event_number"]).select(*TK, "dut", "nearest", F.col("nearest_").alias("nearest_hit"))


DISABLED = [(0, 3, 4), (1, 5, 5), (2, 1, 16), (2, 8, 8)]
_DIS = ", ".join(map(str, DISABLED))


def disabled(spark):
    return spark.createDataFrame(DISABLED, "dut int, column int, row int")


@query("disabled_pixel_anti", sql(f'SELECT event_number, dut, ordinal FROM hits WHERE (dut, "column", "row") NOT IN (VALUES {_DIS})'))
def disabled_pixel_anti(spark, sf_dir):
    return views.hits(spark, sf_dir).join(F.broadcast(disabled(spark)), ["dut", "column", "row"], "left_anti").select("event_number", "dut", "ordinal")


@query("noisy_cluster_drop", cluster_sql('SELECT event_number, dut, ordinal, cluster_id FROM (SELECT *, max(CASE WHEN "row" > 12 THEN 0 ELSE 1 END) OVER (PARTITION BY event_number, dut, cluster_id) AS good FROM cluster_hits) AS t WHERE good = 1'))
def noisy_cluster_drop(spark, sf_dir):
    """Hits of clusters of which not every pixel is noisy (rows above 12)."""
    noisy = spark.range(256).select((F.col("id") % 16 + 1).cast("int").alias("column"), (F.floor(F.col("id") / 16) + 1).cast("int").alias("row"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("dut")).where("row > 12")
    return C.drop_noisy(clustered(spark, sf_dir), noisy).select("event_number", "dut", "ordinal", "cluster_id")


@query("enabled_pixel_filter", sql("SELECT event_number, ordinal, dut FROM tracks WHERE NOT (CAST(floor(ix / 184e-1 + 576) + 1 AS INT) % 7 = 3 AND CAST(floor(iy / 184e-1 + 288) + 1 AS INT) % 5 = 2)"))
def enabled_pixel_filter(spark, sf_dir):
    """Tracks whose nearest pixel is enabled; disabled ones are listed in a table of pixels."""
    pixels = spark.range(1152 * 576).select((F.col("id") % 1152 + 1).cast("int").alias("col"), (F.floor(F.col("id") / 1152) + 1).cast("int").alias("row_"))
    off = pixels.where("col % 7 = 3 AND row_ % 5 = 2")
    at = views.tracks(spark, sf_dir).withColumns({"col": (F.floor(F.col("ix") / 18.4 + 576) + 1).cast("int"), "row_": (F.floor(F.col("iy") / 18.4 + 288) + 1).cast("int")})
    return at.join(F.broadcast(off), ["col", "row_"], "left_anti").select(*TK, "dut")


@query("pixel_neighbour_pairs", sql('SELECT a.event_number, a.dut, a.ordinal AS a, b.ordinal AS b FROM hits AS a JOIN hits AS b ON a.event_number = b.event_number AND a.dut = b.dut AND a.ordinal < b.ordinal AND abs(a."column" - b."column") <= 3 AND abs(a."row" - b."row") <= 3'))
def pixel_neighbour_pairs(spark, sf_dir):
    near = (F.abs(F.col("a.column") - F.col("b.column")) <= 3) & (F.abs(F.col("a.row") - F.col("b.row")) <= 3)
    return J.close_pairs(views.hits(spark, sf_dir), near, ["event_number", "dut"])


LATER = "b.event_number > a.event_number AND abs(a.{u} - b.{u}) <= {far} AND abs(a.{v} - b.{v}) < 5"
#: The tracks of plane 2 met in a grid, as SQL: each goes to its cell and the eight around it.
GRID_SQL = """t AS (SELECT event_number, ordinal, ix AS x, iy AS y, x - ix AS rx, y - iy AS ry FROM tracks WHERE dut = 2 AND x IS NOT NULL),
      steps AS (SELECT i, j FROM (VALUES (-1), (0), (1)) AS p(i), (VALUES (-1), (0), (1)) AS q(j))"""


def grid_pairs_sql(u: str, v: str, far: int) -> str:
    return f"""(SELECT *, floor({u} / {far}) + i AS cu, floor({v} / 5e0) + j AS cv FROM t, steps) AS a JOIN t AS b
      ON a.cu = floor(b.{u} / {far}) AND a.cv = floor(b.{v} / 5e0) AND {LATER.format(u=u, v=v, far=far)}"""


@query("residual_pairs", sql(f"""
    WITH {GRID_SQL} SELECT 'x' AS axis, a.event_number AS e1, a.ordinal AS o1, b.event_number AS e2, b.ordinal AS o2, CAST(floor(abs(a.x - b.x) / 10) AS INT) AS bin FROM {grid_pairs_sql("x", "y", 100)}
    UNION ALL SELECT 'y', a.event_number, a.ordinal, b.event_number, b.ordinal, CAST(floor(abs(a.y - b.y) / 10) AS INT) FROM {grid_pairs_sql("y", "x", 100)}"""))
def residual_pairs(spark, sf_dir):
    """Every track with the tracks of later events close to it along x, and those along y: within 100 by 5 micrometres."""
    return J.later_pairs(plane_2(spark, sf_dir), 100.0, 10.0)


def plane_2(spark, sf_dir):
    return views.tracks(spark, sf_dir).where("dut = 2 AND x IS NOT NULL").select(*TK, F.col("ix").alias("x"), F.col("iy").alias("y"), (F.col("x") - F.col("ix")).alias("rx"), (F.col("y") - F.col("iy")).alias("ry"))


@query("residuals", sql("SELECT event_number, ordinal, dut, round(x - ix, 6) + 0e0 AS rx, round(y - iy, 6) + 0e0 AS ry, round(sqrt((x - ix) * (x - ix) + (y - iy) * (y - iy)), 6) AS distance FROM tracks WHERE x IS NOT NULL AND chi2 IS NOT NULL"))
def residuals(spark, sf_dir):
    dx, dy = F.col("x") - F.col("ix"), F.col("y") - F.col("iy")
    return views.tracks(spark, sf_dir).where("x IS NOT NULL AND chi2 IS NOT NULL").select(*TK, "dut", r6(dx).alias("rx"), r6(dy).alias("ry"), F.round(F.sqrt(dx * dx + dy * dy), 6).alias("distance"))


FLAGS = "CAST(bit_or(CASE WHEN x IS NULL THEN 0 ELSE 1 << dut END) AS BIGINT) AS hit_flag"
QUALITY = "CAST(bit_or(CASE WHEN x IS NOT NULL AND abs(x - ix) <= 4 AND abs(y - iy) <= 3 THEN 1 << dut ELSE 0 END) AS BIGINT) AS quality_flag"


@query("hit_flag", sql(f"SELECT event_number, ordinal, {FLAGS} FROM tracks GROUP BY ALL"))
def hit_flag(spark, sf_dir):
    bit = F.expr("shiftleft(1L, dut)")
    return views.tracks(spark, sf_dir).groupBy(*TK).agg(F.bit_or(F.when(F.col("x").isNotNull(), bit).otherwise(0)).alias("hit_flag"))


def track_flags(spark, sf_dir):
    """Hit and quality flags of each track over all planes."""
    t = plane_tracks(spark, sf_dir)
    bit = F.expr("shiftleft(1L, dut)")
    good = F.col("x").isNotNull() & G.within_limits(F.col("x"), F.col("y")) & X.in_window(F.col("x") - F.col("ix"), F.col("y") - F.col("iy"), F.lit(4.0), F.lit(3.0), F.col("column_size"), F.col("row_size"))
    return t.groupBy(*TK).agg(F.bit_or(F.when(F.col("x").isNotNull(), bit).otherwise(0)).alias("hit_flag"), F.bit_or(F.when(good, bit).otherwise(0)).alias("quality_flag"), F.max("chi_red").alias("chi_red"))


@query("quality_flag", sql(f"SELECT event_number, ordinal, {QUALITY} FROM tracks GROUP BY ALL"))
def quality_flag(spark, sf_dir):
    """Cuts of 4 and 3 micrometres are below 2.5 pitches, so the window is a rectangle."""
    return track_flags(spark, sf_dir).select(*TK, "quality_flag")


@query("select_tracks", sql(f"SELECT event_number, ordinal, hit_flag, quality_flag FROM (SELECT event_number, ordinal, {FLAGS}, {QUALITY} FROM tracks GROUP BY ALL) AS t WHERE hit_flag & 3 = 3 AND hit_flag & 32 = 0 AND quality_flag & (hit_flag & 6) = hit_flag & 6"))
def select_tracks_query(spark, sf_dir):
    return select_tracks(track_flags(spark, sf_dir), hit=[0, 1], no_hit=[5], quality=[1, 2]).drop("chi_red")


@query("query_filter", sql("SELECT event_number, ordinal, dut FROM tracks WHERE (chi_red < 2 AND n_hits = 1) OR frame > 5"))
def query_filter_query(spark, sf_dir):
    return query_filter(views.tracks(spark, sf_dir), "(chi_red < 2) & (n_hits == 1) | (frame > 5)").select(*TK, "dut")


@query("fit_candidate_filter", sql(f"SELECT event_number, ordinal FROM (SELECT event_number, ordinal, {FLAGS} FROM tracks GROUP BY ALL) AS t WHERE bit_count(hit_flag & 31) >= 5"))
def fit_candidate_filter(spark, sf_dir):
    """Tracks with five hits or more on planes 0 to 4."""
    return track_flags(spark, sf_dir).where(F.bit_count(F.col("hit_flag").bitwiseAND(F.lit(31).cast("long"))) >= 5).select(*TK)


SHAPES = (1, 3, 5, 13, 14, 7, 11, 15)  # fixed values: cluster shapes that are used for alignment


@query("alignment_track_filter", sql("SELECT event_number, ordinal, dut FROM tracks WHERE x IS NOT NULL AND chi_red < 3 AND cluster_shape IN (1, 3, 5, 13, 14, 7, 11, 15)"))
def alignment_track_filter(spark, sf_dir):
    return views.tracks(spark, sf_dir).where(F.col("x").isNotNull() & (F.col("chi_red") < 3) & F.col("cluster_shape").isin(*SHAPES)).select(*TK, "dut")


@query("ordinal_in_event", sql("SELECT event_number, dut, ordinal, CAST(row_number() OVER (PARTITION BY dut, event_number ORDER BY charge, ordinal) - 1 AS INT) AS k FROM hits"))
def ordinal_in_event(spark, sf_dir):
    return J.number_rows(views.hits(spark, sf_dir), "dut", "event_number", by=("charge", "ordinal")).select("event_number", "dut", "ordinal", "k")


@query("event_delta", sql("SELECT event_number, event_number - lag(event_number) OVER (ORDER BY event_number) AS delta FROM (SELECT DISTINCT event_number FROM hits) AS e"))
def event_delta(spark, sf_dir):
    """Difference of consecutive event numbers, without one global window: a lag inside ranges of events, and each range's first event from the last one of the range before."""
    width = 1000
    e = views.hits(spark, sf_dir).select("event_number").distinct().withColumn("part", F.floor(F.col("event_number") / width))
    inside = e.withColumn("before", F.lag("event_number").over(Window.partitionBy("part").orderBy("event_number")))
    ends = e.groupBy("part").agg(F.max("event_number").alias("last"))
    coarse = ends.withColumn("upper", F.floor(F.col("part") / width))
    prev = coarse.withColumn("prev", F.lag("last").over(Window.partitionBy("upper").orderBy("part")))
    tops = coarse.groupBy("upper").agg(F.max("last").alias("top")).withColumn("prev_top", F.lag("top").over(Window.orderBy("upper")))  # one row per million events
    prev = prev.join(F.broadcast(tops.select("upper", "prev_top")), "upper").select("part", F.coalesce("prev", "prev_top").alias("prev"))
    return inside.join(prev, "part").select("event_number", (F.col("event_number") - F.coalesce("before", "prev")).alias("delta"))


@query("first_last_plane", sql("SELECT event_number, ordinal, min(dut) AS first_dut, max(dut) AS last_dut FROM tracks WHERE x IS NOT NULL AND dut < 4 GROUP BY ALL"))
def first_last_plane(spark, sf_dir):
    """First and last plane in z order with a hit before plane 4."""
    t = plane_tracks(spark, sf_dir).where("x IS NOT NULL AND tz < 600000")
    return t.groupBy(*TK).agg(F.min_by("dut", "tz").alias("first_dut"), F.max_by("dut", "tz").alias("last_dut"))


_NEAR = """SELECT event_number, ordinal, dut, count(*) AS n FROM (SELECT a.event_number, a.ordinal, a.dut FROM tracks AS a JOIN tracks AS b ON a.event_number = b.event_number AND a.dut = b.dut AND a.ordinal <> b.ordinal
      AND ((a.{x} - b.{x}) / 1000) ** 2 + ((a.{y} - b.{y}) / 1000) ** 2 <= 1) AS p GROUP BY ALL"""


_FIT_FLAGS = f"""
    WITH near_track AS ({_NEAR.format(x="ix", y="iy")}), near_hit AS ({_NEAR.format(x="x", y="y")}),
      flags AS (SELECT t.dut, t.event_number // 1000 AS bucket, t.x IS NOT NULL AS h, coalesce(abs(t.x - ix) <= 4 AND abs(t.y - iy) <= 3, false) AS q, a.n IS NULL AS it, b.n IS NULL AS ih
        FROM tracks AS t LEFT JOIN near_track AS a USING (event_number, ordinal, dut) LEFT JOIN near_hit AS b USING (event_number, ordinal, dut)),
      sums AS (SELECT {{by}}, count(*) AS n_tracks, count(*) FILTER (h) AS with_hit, count(*) FILTER (h AND q) AS good, count(*) FILTER (h AND it) AS single_track, count(*) FILTER (h AND ih) AS single_hit, count(*) FILTER (q AND it AND ih) AS all_three FROM flags GROUP BY {{by}})
    SELECT *, {", ".join(f"round({k} / CAST(nullif({of}, 0) AS DOUBLE), 9) AS share_{k}" for k, of in (("with_hit", "n_tracks"), ("good", "with_hit"), ("single_track", "with_hit"), ("single_hit", "with_hit"), ("all_three", "n_tracks")))} FROM sums"""


def fit_shares(spark, sf_dir, *by):
    t = isolated_rows(views.tracks(spark, sf_dir), {"it": ("ix", "iy", 1000.0, 1000.0), "ih": ("x", "y", 1000.0, 1000.0)}, keep=["x", "y", "ix", "iy"])
    t = t.withColumns({
        "h": F.col("x").isNotNull(), "q": F.coalesce((F.abs(F.col("x") - F.col("ix")) <= 4) & (F.abs(F.col("y") - F.col("iy")) <= 3), F.lit(False)),
        "ih": F.coalesce("ih", F.lit(True)), "bucket": F.expr("event_number div 1000"),
    })
    h, q, it, ih = (F.col(c) for c in ("h", "q", "it", "ih"))
    counts = {"with_hit": h, "good": h & q, "single_track": h & it, "single_hit": h & ih, "all_three": q & it & ih}
    sums = t.groupBy(*by).agg(F.count("*").alias("n_tracks"), *(F.count_if(c).alias(k) for k, c in counts.items()))
    of = {k: "n_tracks" if k in ("with_hit", "all_three") else "with_hit" for k in counts}
    return sums.withColumns({f"share_{k}": F.round(F.when(F.col(o) > 0, F.col(k) / F.col(o)), 9) for k, o in of.items()})


@query("fit_statistics", sql(_FIT_FLAGS.format(by="dut")))
def fit_statistics(spark, sf_dir):
    """Shares per plane: tracks with a hit, and of these with a good one, with no other track and no other hit near; all three together of all tracks."""
    return fit_shares(spark, sf_dir, "dut")


@query("fit_statistics_trend", sql(_FIT_FLAGS.format(by="dut, bucket")))
def fit_statistics_trend(spark, sf_dir):
    """The same shares per thousand events; a share of no tracks is null."""
    return fit_shares(spark, sf_dir, "dut", "bucket")
