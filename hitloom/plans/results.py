"""Queries on residuals, efficiency, purity and distributions of fitted tracks."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Window
from pyspark.sql import functions as F

from hitloom.functions import geometry as G
from hitloom.functions.expressions import r6
from hitloom.operators import correlation as C
from hitloom.operators import estimate as E
from hitloom.operators import histograms as H
from hitloom.operators import joins as J
from hitloom.operators import results as R
from hitloom.operators.results import distance, rx, ry
from hitloom.plans.joins import GRID_SQL, grid_pairs_sql
from hitloom.plans.positions import plane_tracks, sql
from hitloom.plans.registry import query
from hitloom.sources import views

D_SQL = "sqrt((x - ix) * (x - ix) + (y - iy) * (y - iy))"
RES = 500.0  # bin width of the maps in micrometres
BINS = "CAST(floor((ix + 6000) / 500) AS INT) AS bx, CAST(floor((iy + 3000) / 500) AS INT) AS by_"


def bin_x():
    return F.floor((F.col("ix") + 6000) / RES).cast("int")


def bin_y():
    return F.floor((F.col("iy") + 3000) / RES).cast("int")


def pixel_x():
    return F.floor(F.col("ix") / 18.4).cast("int").alias("px")


def pixel_y():
    return F.floor(F.col("iy") / 18.4).cast("int").alias("py")


def with_hit(spark, sf_dir):
    return views.tracks(spark, sf_dir).where("x IS NOT NULL")


def mean6(c):
    return F.round(F.avg(c), 6) + F.lit(0.0)


@query("hist_1d", sql('SELECT dut, "column" - 1 AS bin, count(*) AS n FROM hits GROUP BY ALL'))
def hist_1d(spark, sf_dir):
    return H.counts(views.hits(spark, sf_dir), dut=F.col("dut"), bin=H.unit_bin(F.col("column") - 1, 16, strict=True))


@query("hist_2d", sql('SELECT dut, "column" - 1 AS bx, "row" - 1 AS by_, count(*) AS n FROM hits GROUP BY ALL'))
def hist_2d(spark, sf_dir):
    return H.counts(views.hits(spark, sf_dir), dut=F.col("dut"), bx=H.unit_bin(F.col("column") - 1, 16, strict=True), by_=H.unit_bin(F.col("row") - 1, 16, strict=True))


@query("hist_3d", sql('SELECT dut, "column" - 1 AS bx, "row" - 1 AS by_, CAST(floor(charge / 10) AS INT) AS bz, count(*) AS n FROM hits GROUP BY ALL'))
def hist_3d(spark, sf_dir):
    bins = {"bx": H.unit_bin(F.col("column") - 1, 16, strict=True), "by_": H.unit_bin(F.col("row") - 1, 16, strict=True), "bz": H.unit_bin(F.col("charge") / 10, 6, strict=True)}
    return H.counts(views.hits(spark, sf_dir), dut=F.col("dut"), **bins)


@query("hist_edges", sql("SELECT dut, CAST(least(floor((chi2 - 0) * (8 / 40e0)), 7) AS INT) AS bin, count(*) AS n FROM tracks WHERE chi2 BETWEEN 0 AND 40 GROUP BY ALL"))
def hist_edges(spark, sf_dir):
    return H.counts(views.tracks(spark, sf_dir), dut=F.col("dut"), bin=H.edge_bin(F.col("chi2"), 0.0, 40.0, 8))


@query("binned_mean", sql(f"SELECT dut, {BINS}, count(*) AS n, round(avg(x - ix), 6) + 0e0 AS mean FROM tracks WHERE x IS NOT NULL GROUP BY ALL"))
def binned_mean(spark, sf_dir):
    return with_hit(spark, sf_dir).groupBy("dut", bin_x().alias("bx"), bin_y().alias("by_")).agg(F.count("*").alias("n"), mean6(rx()).alias("mean"))


@query("binned_count", sql("SELECT n_hits AS bin, frame, count(*) AS n FROM tracks GROUP BY ALL"))
def binned_count(spark, sf_dir):
    return views.tracks(spark, sf_dir).groupBy(F.col("n_hits").alias("bin"), "frame").agg(F.count("*").alias("n"))


@query("binned_collect", sql("SELECT dut, frame AS bin, round(quantile_cont(charge, 0.25), 6) AS q25, round(median(charge), 6) AS q50, count(*) AS n FROM tracks WHERE charge IS NOT NULL GROUP BY ALL"))
def binned_collect(spark, sf_dir):
    """Order statistics per bin from ranks over counted values, not from lists."""
    t = views.tracks(spark, sf_dir).where("charge IS NOT NULL").select("dut", F.col("frame").alias("bin"), "charge")
    q = H.quantiles(t, ["dut", "bin"], "charge", {"q25": 0.25, "q50": 0.5})
    return t.groupBy("dut", "bin").agg(F.count("*").alias("n")).join(q, ["dut", "bin"]).select("dut", "bin", F.round("q25", 6).alias("q25"), F.round("q50", 6).alias("q50"), "n")


HIST = "SELECT dut, CAST(floor((x - ix) * 2) AS INT) AS bin, count(*) AS n FROM tracks WHERE x IS NOT NULL GROUP BY ALL"


def residual_bins(spark, sf_dir):
    return with_hit(spark, sf_dir).groupBy("dut", F.floor(rx() * 2).cast("int").alias("bin")).agg(F.count("*").alias("n"))


_AXES = "SELECT dut, 'x' AS axis, x - ix AS r FROM tracks WHERE x IS NOT NULL UNION ALL SELECT dut, 'y', y - iy FROM tracks WHERE x IS NOT NULL"


@query("residual_hist", sql(f"""
    WITH rows AS ({_AXES}), fine AS (SELECT dut, axis, CAST(floor(r / (184e-1 / 100)) AS INT) AS b, count(*) AS n FROM rows GROUP BY ALL),
      high AS (SELECT *, max(n) OVER (PARTITION BY dut, axis) AS top FROM fine),
      peak AS (SELECT dut, axis, (min(b) + max(b)) / 2e0 AS center, max(b) - min(b) + 1 AS width FROM high WHERE n * 2 >= top GROUP BY dut, axis),
      ends AS (SELECT dut, axis, (center + 5e-1 - 6e0 * width) * (184e-1 / 100) AS lo, (center + 5e-1 + 6e0 * width) * (184e-1 / 100) AS hi FROM peak)
    SELECT dut, axis, round(lo, 6) + 0e0 AS lo, round(hi, 6) + 0e0 AS hi, CAST(least(floor((r - lo) * 200 / (hi - lo)), 199) AS INT) AS bin, count(*) AS n FROM rows JOIN ends USING (dut, axis) WHERE r BETWEEN lo AND hi GROUP BY ALL"""))
def residual_hist(spark, sf_dir):
    """200 bins on both axes over six half-maximum widths around each peak, found in a first pass."""
    h = R.residual_histograms(plane_tracks(spark, sf_dir))
    return h.select("dut", "axis", r6(F.col("lo")).alias("lo"), r6(F.col("hi")).alias("hi"), "bin", "n")


#: The tracks' planes with limits on every second one.
LIMITED = [replace(p, x_lo=-4000.0, x_hi=4500.0, y_lo=-2000.0) if p.dut % 2 else p for p in G.TRACK_PLANES]


def _position_sql(r: str, p: str) -> str:
    lo, v = ("6000", "y") if p == "x" else ("3000", "x")
    return f"""SELECT dut, '{r}' AS residual, '{p}' AS position, {r} - i{r} AS r, CAST(floor((i{p} + {lo}) / 500) AS INT) AS bin_pos FROM tracks JOIN ({G.sql_values(LIMITED)}) AS g USING (dut)
      WHERE x IS NOT NULL AND coalesce({v} >= {v}_lo, true) AND coalesce({v} <= {v}_hi, true)"""


@query("residual_vs_position", sql(f"""
    WITH rows AS ({" UNION ALL ".join(_position_sql(r, p) for r in "xy" for p in "xy")}), bins AS (SELECT dut, residual, position, bin_pos, count(*) AS pos_n, round(round(sum(r), 6) / count(*), 6) + 0e0 AS pos_mean FROM rows GROUP BY ALL)
    SELECT dut, residual, position, bin_pos, CAST(floor(r / 5e-1) AS INT) AS bin_res, count(*) AS n, pos_n, pos_mean FROM rows JOIN bins USING (dut, residual, position, bin_pos) GROUP BY ALL"""))
def residual_vs_position(spark, sf_dir):
    """Both residuals against both positions, with the count and mean of each position bin; every second plane has limits."""
    t = G.with_geometry(views.tracks(spark, sf_dir).drop("z"), G.geometry(spark, LIMITED))
    m = R.residual_position_maps(t, RES, 0.5, (-6000.0, -3000.0))
    return m.select("dut", "residual", "position", "bin_pos", "bin_res", "n", "pos_n", r6(r6(F.col("pos_mean") * F.col("pos_n")) / F.col("pos_n")).alias("pos_mean"))


@query("residual_map", sql(f"SELECT dut, CAST(floor(ix / 184e-1) AS INT) AS px, CAST(floor(iy / 184e-1) AS INT) AS py, round(avg({D_SQL}), 6) AS mean_distance, count(*) AS n FROM tracks WHERE x IS NOT NULL GROUP BY ALL"))
def residual_map(spark, sf_dir):
    """Per pixel of the plane."""
    return with_hit(spark, sf_dir).groupBy("dut", pixel_x(), pixel_y()).agg(mean6(distance()).alias("mean_distance"), F.count("*").alias("n"))


@query("hist_moments", sql(f"SELECT dut, round(sum(n * bin) / sum(n), 6) + 0e0 AS mean, round(sqrt(sum(n * bin * bin) / sum(n) - (sum(n * bin) / sum(n)) ** 2), 6) AS rms FROM ({HIST}) AS h GROUP BY dut"))
def hist_moments(spark, sf_dir):
    m = H.moments(residual_bins(spark, sf_dir), ["dut"], "bin")
    return m.select("dut", r6(F.col("mean")).alias("mean"), r6(F.col("rms")).alias("rms"))


@query("peak_fwhm", sql(f"""SELECT dut, min(bin) FILTER (n * 2 >= top) AS lo, max(bin) FILTER (n * 2 >= top) AS hi, (min(bin) FILTER (n * 2 >= top) + max(bin) FILTER (n * 2 >= top)) / 2e0 AS center,
      max(bin) FILTER (n * 2 >= top) - min(bin) FILTER (n * 2 >= top) + 1 AS width, min(bin) FILTER (n = top) AS max_at FROM (SELECT *, max(n) OVER (PARTITION BY dut) AS top FROM ({HIST}) AS h) AS t GROUP BY dut"""))
def peak_fwhm(spark, sf_dir):
    return H.peak_width(residual_bins(spark, sf_dir), ["dut"], "bin")


@query("hist_quantile_mask", sql(f"SELECT dut, bin, n FROM (SELECT *, sum(n) OVER (PARTITION BY dut ORDER BY bin) / CAST(sum(n) OVER (PARTITION BY dut) AS DOUBLE) AS q FROM ({HIST}) AS h) AS t WHERE q >= 5e-2 AND NOT q > 95e-2"))
def hist_quantile_mask(spark, sf_dir):
    return H.quantile_mask(residual_bins(spark, sf_dir), ["dut"], "bin").where("inside").select("dut", "bin", "n")


CUT = (4.0, 3.0)


V_SQL = "coalesce(abs(x - ix) <= 4 AND abs(y - iy) <= 3, false)"


@query("efficiency_map", sql(f"""
    SELECT dut, {BINS}, count(*) AS n_tracks, count(*) FILTER ({V_SQL}) AS n_valid, count(*) FILTER (x IS NOT NULL) AS n_hits_all, round(100e0 * count(*) FILTER ({V_SQL}) / count(*), 6) AS efficiency,
      round(avg(x - ix) FILTER ({V_SQL}), 6) + 0e0 AS mean_rx, round(avg(charge) FILTER ({V_SQL}), 6) AS mean_charge, round(avg(n_hits) FILTER ({V_SQL}), 6) AS mean_size, round(avg(atan2(sy, sz)) FILTER ({V_SQL}), 9) + 0e0 AS mean_alpha
    FROM tracks GROUP BY ALL HAVING count(*) >= 2"""))
def efficiency_map(spark, sf_dir):
    """One pass over the tracks: counts, efficiency and means per bin; bins with fewer than two tracks are masked."""
    m = R.efficiency_map(plane_tracks(spark, sf_dir), CUT, (-6000.0, -3000.0), RES, least=2)
    six = ["efficiency", "mean_rx", "mean_charge", "mean_size"]
    return m.select("dut", "bx", "by_", "n_tracks", "n_valid", "n_hits_all", *(r6(F.col(c)).alias(c) for c in six), (F.round("mean_alpha", 9) + 0.0).alias("mean_alpha"))


@query("efficiency_total", sql(f"SELECT dut, count(*) FILTER ({V_SQL}) AS k, count(*) AS n, round(count(*) FILTER ({V_SQL}) / CAST(count(*) AS DOUBLE), 9) AS efficiency FROM tracks GROUP BY dut"))
def efficiency_total(spark, sf_dir):
    t = plane_tracks(spark, sf_dir).withColumn("v", R.valid_hit(CUT))
    return t.groupBy("dut").agg(F.count_if("v").alias("k"), F.count("*").alias("n")).withColumn("efficiency", F.round(F.col("k") / F.col("n"), 9))


PIX = "CAST(floor(ix / 184e-1) AS INT) AS px, CAST(floor(iy / 184e-1) AS INT) AS py"


@query("pixel_efficiency", sql(f"SELECT dut, {PIX}, count(*) AS n_tracks, count(*) FILTER ({V_SQL}) AS n_valid FROM tracks GROUP BY ALL"))
def pixel_efficiency(spark, sf_dir):
    return plane_tracks(spark, sf_dir).withColumn("v", R.valid_hit(CUT)).groupBy("dut", pixel_x(), pixel_y()).agg(F.count("*").alias("n_tracks"), F.count_if("v").alias("n_valid"))


REGIONS = [("left", -5200.0, 0.0, -2000.0, 2000.0), ("right", 0.0, 4500.0, -2000.0, 2000.0), ("core", -1000.0, 1000.0, -1000.0, 1000.0)]
_REG = ", ".join(f"('{n}', {a}, {b}, {c}, {d})" for n, a, b, c, d in REGIONS)


MEAN_SQL = {"rx": "x - ix", "ry": "y - iy", "distance": D_SQL, "charge": "charge", "frame": "frame", "size": "n_hits"}
_MEANS = ", ".join(f"round(avg({v}) FILTER ({V_SQL}), 6) + 0e0 AS mean_{k}" for k, v in MEAN_SQL.items())


def means():
    return [r6(F.col(f"mean_{k}")).alias(f"mean_{k}") for k in MEAN_SQL]


_EXTENT = f"tracks JOIN ({G.sql_values(LIMITED)}) AS g USING (dut) WHERE abs(ix) <= n_columns * column_size / 2 + 500 AND abs(iy) <= n_rows * row_size / 2 + 0"


@query("efficiency_map_area", sql(f"""
    SELECT dut, {BINS}, count(*) AS n_tracks, count(*) FILTER ({V_SQL}) AS n_valid, round(100e0 * count(*) FILTER ({V_SQL}) / count(*), 6) AS efficiency, {_MEANS},
      round(avg(atan2(sy, sz)) FILTER ({V_SQL}), 9) + 0e0 AS mean_alpha, round(avg(atan2(-sx, sz)) FILTER ({V_SQL}), 9) + 0e0 AS mean_beta FROM {_EXTENT} GROUP BY ALL"""))
def efficiency_map_area(spark, sf_dir):
    """All eight means, on the planes' matrices and one more bin on both sides along x."""
    m = R.efficiency_map(R.in_area(plane_tracks(spark, sf_dir), RES, (300.0, 0.0)), CUT, (-6000.0, -3000.0), RES)
    return m.select("dut", "bx", "by_", "n_tracks", "n_valid", r6(F.col("efficiency")).alias("efficiency"), *means(), *((F.round(c, 9) + 0.0).alias(c) for c in ("mean_alpha", "mean_beta")))


_IN_REGIONS = f"tracks JOIN (VALUES {_REG}) AS r(region, a, b, c, d) ON ix > a AND ix < b AND iy > c AND iy < d"


@query("region_efficiency", sql(f"SELECT region, dut, count(*) AS n_tracks, count(*) FILTER ({V_SQL}) AS n_valid, round(count(*) FILTER ({V_SQL}) / CAST(count(*) AS DOUBLE), 9) AS efficiency, {_MEANS} FROM {_IN_REGIONS} GROUP BY ALL"))
def region_efficiency(spark, sf_dir):
    """Efficiency and means of valid hits in open rectangles; their distributions are in ``region_distributions``."""
    e = R.efficiency_by(R.in_regions(plane_tracks(spark, sf_dir), REGIONS), CUT, "region", "dut")
    return e.select("region", "dut", "n_tracks", "n_valid", F.round("efficiency", 9).alias("efficiency"), *means())


@query("region_distributions", sql(f"""SELECT region, dut, kind, bin, count(*) AS n FROM (SELECT region, dut, unnest(['charge', 'frame', 'size', 'shape', 'alpha', 'beta']) AS kind,
      unnest([CAST(charge AS BIGINT), CAST(frame AS BIGINT), CAST(n_hits AS BIGINT), cluster_shape, CAST(floor(atan2(sy, abs(sz)) / 1e-6) AS BIGINT), CAST(floor(atan2(-sx, abs(sz)) / 1e-6) AS BIGINT)]) AS bin
      FROM {_IN_REGIONS} WHERE {V_SQL}) AS t GROUP BY ALL"""))
def region_distributions(spark, sf_dir):
    """Charge, frame, cluster size, cluster shape and angles of valid hits per region and plane."""
    return R.distributions(R.in_regions(plane_tracks(spark, sf_dir), REGIONS), CUT, "region", "dut")


_CELL = "CAST(floor((((ix + 105984e-1) % 184e-1 + 184e-1) % 184e-1) / 46e-1) AS INT)"
_CELLY = "CAST(floor((((iy + 52992e-1) % 184e-1 + 184e-1) % 184e-1) / 46e-1) AS INT)"


def in_pixel(spark, sf_dir):
    """Tracks with the quarter of the primitive cell they cross."""
    return R.in_pixel(plane_tracks(spark, sf_dir).withColumn("v", R.valid_hit(CUT)), 4.6)


@query("in_pixel_maps", sql(f"""
    WITH cells AS (SELECT region, dut, {_CELL} AS bx, {_CELLY} AS by_, count(*) AS n_tracks, count(*) FILTER ({V_SQL}) AS n_valid, round(100e0 * count(*) FILTER ({V_SQL}) / count(*), 6) AS efficiency, {_MEANS} FROM {_IN_REGIONS} GROUP BY ALL)
    SELECT cells.* REPLACE (bx + 4 * i AS bx, by_ + 4 * j AS by_) FROM cells, (VALUES (-1), (0), (1)) AS p(i), (VALUES (-1), (0), (1)) AS q(j) WHERE bx + 4 * i BETWEEN -1 AND 4 AND by_ + 4 * j BETWEEN -1 AND 4"""))
def in_pixel_maps(spark, sf_dir):
    """Efficiency and means over the quarters of the primitive cell per region and plane, with one more bin on each side from the opposite edge."""
    rows = R.in_regions(R.in_pixel(plane_tracks(spark, sf_dir), 4.6), REGIONS)
    cells = R.efficiency_by(rows, CUT, "region", "dut", "bx", "by_")
    cells = cells.select("region", "dut", "bx", "by_", "n_tracks", "n_valid", F.round(100 * F.col("efficiency"), 6).alias("efficiency"), *means())
    return R.wrapped(cells, 4, 4, 1)


@query("in_pixel_shape", sql(f"SELECT dut, bx, by_, max(n) AS n, arg_max(cluster_shape, n * 1000 - cluster_shape) AS shape FROM (SELECT dut, {_CELL} AS bx, {_CELLY} AS by_, cluster_shape, count(*) AS n FROM tracks WHERE {V_SQL} GROUP BY ALL) AS t GROUP BY ALL"))
def in_pixel_shape(spark, sf_dir):
    """The most frequent shape per quarter cell, the smaller code at ties."""
    c = in_pixel(spark, sf_dir).where("v").groupBy("dut", "bx", "by_", "cluster_shape").agg(F.count("*").alias("n"))
    top = c.groupBy("dut", "bx", "by_").agg(F.max(F.struct("n", (-F.col("cluster_shape")).alias("s"))).alias("t"))
    return top.select("dut", "bx", "by_", "t.n", (-F.col("t.s")).alias("shape"))


SHAPES = (1, 3, 5, 13, 14, 7, 11, 15)  # fixed values: shapes of small clusters that are counted inside the pixel


@query("in_pixel_shape_counts", sql(f"SELECT region, dut, {_CELL} AS bx, {_CELLY} AS by_, cluster_shape, count(*) AS n FROM {_IN_REGIONS} WHERE {V_SQL} AND cluster_shape IN {SHAPES} GROUP BY ALL"))
def in_pixel_shape_counts(spark, sf_dir):
    """Counts of each small shape per quarter cell, region and plane."""
    rows = R.in_regions(R.in_pixel(plane_tracks(spark, sf_dir), 4.6), REGIONS)
    return R.in_pixel_shapes(rows, CUT, SHAPES, "region", "dut")


EVERYWHERE = ("all", -1e9, 1e9, -1e9, 1e9)


@query("efficiency_trend", sql(f"""
    SELECT region, dut, CAST(floor(event_number / 500) AS BIGINT) AS chunk, count(*) AS n_tracks, count(*) FILTER ({V_SQL}) AS n_valid FROM (SELECT tracks.*, region FROM {_IN_REGIONS} UNION ALL SELECT tracks.*, 'all' FROM tracks) AS t GROUP BY ALL"""))
def efficiency_trend(spark, sf_dir):
    """Per 500 event numbers, for each region and for all tracks."""
    t = R.in_regions(plane_tracks(spark, sf_dir), [*REGIONS, EVERYWHERE]).withColumn("v", R.valid_hit(CUT))
    return t.groupBy("region", "dut", F.floor(F.col("event_number") / 500).alias("chunk")).agg(F.count("*").alias("n_tracks"), F.count_if("v").alias("n_valid"))


@query("charge_frame_size_dists", sql(f"SELECT dut, kind, bin, count(*) AS n FROM (SELECT dut, unnest(['charge', 'frame', 'size']) AS kind, unnest([CAST(charge AS INT), frame, n_hits]) AS bin FROM tracks WHERE {V_SQL}) AS t GROUP BY ALL"))
def charge_frame_size_dists(spark, sf_dir):
    t = plane_tracks(spark, sf_dir).where(R.valid_hit(CUT))
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).cast("int").alias("bin")) for k, c in (("charge", "charge"), ("frame", "frame"), ("size", "n_hits")))))
    return t.select("dut", kinds.alias("a")).groupBy("dut", F.col("a.kind").alias("kind"), F.col("a.bin").alias("bin")).agg(F.count("*").alias("n"))


@query("size_shape_vs_angle", sql("""
    SELECT dut, angle, what, code, CAST(floor(v * 1e6) AS INT) AS angle_bin, count(*) AS n
    FROM (SELECT dut, unnest(['alpha', 'beta', 'alpha', 'beta']) AS angle, unnest(['size', 'size', 'shape', 'shape']) AS what, unnest([atan2(sy, abs(sz)), atan2(-sx, abs(sz)), atan2(sy, abs(sz)), atan2(-sx, abs(sz))]) AS v,
        unnest([CAST(n_hits AS BIGINT), CAST(n_hits AS BIGINT), cluster_shape, cluster_shape]) AS code FROM tracks WHERE x IS NOT NULL) AS t WHERE what = 'shape' OR code BETWEEN 1 AND 9 GROUP BY ALL"""))
def size_shape_vs_angle(spark, sf_dir):
    """Cluster sizes 1 to 9 and cluster shapes against both angles."""
    _, alpha, beta = G.angles(F.col("sx"), F.col("sy"), F.col("sz"))
    kinds = [F.struct(F.lit(a).alias("angle"), F.lit(w).alias("what"), F.floor(v * 1e6).cast("int").alias("angle_bin"), c.cast("long").alias("code")) for w, c in (("size", F.col("n_hits")), ("shape", F.col("cluster_shape"))) for a, v in (("alpha", alpha), ("beta", beta))]
    rows = with_hit(spark, sf_dir).select("dut", F.explode(F.array(*kinds)).alias("k")).select("dut", "k.*").where("what = 'shape' OR code BETWEEN 1 AND 9")
    return rows.groupBy("dut", "angle", "what", "code", "angle_bin").agg(F.count("*").alias("n"))


@query("purity", sql(f"SELECT dut, CAST(floor((x + 6000) / 500) AS INT) AS bx, CAST(floor((y + 3000) / 500) AS INT) AS by_, count(*) AS n_hits, count(*) FILTER ({D_SQL} < 4) AS n_pure, round(100e0 * count(*) FILTER ({D_SQL} < 4) / count(*), 6) AS purity FROM tracks WHERE x IS NOT NULL GROUP BY ALL HAVING count(*) >= 2"))
def purity(spark, sf_dir):
    """Share of hits with a track within 4 micrometres; bins with fewer than two hits are masked."""
    m = R.purity_map(views.tracks(spark, sf_dir), 4.0, (-6000.0, -3000.0), RES, least=2)
    return m.withColumn("purity", F.round("purity", 6))


@query("purity_ranges", sql(f"""SELECT dut, CAST(floor((x + 6000) / 500) AS INT) AS bx, CAST(floor((y + 3000) / 500) AS INT) AS by_, count(*) AS n_hits,
    count(*) FILTER ({D_SQL} < 4 AND ix BETWEEN -4000 AND 3000 AND iy BETWEEN -1500 AND 2000) AS n_pure, round(100e0 * count(*) FILTER ({D_SQL} < 4 AND ix BETWEEN -4000 AND 3000 AND iy BETWEEN -1500 AND 2000) / count(*), 6) AS purity
    FROM tracks WHERE x IS NOT NULL GROUP BY ALL"""))
def purity_ranges(spark, sf_dir):
    """Only tracks that cross a plane in the middle make a hit pure."""
    m = R.purity_map(views.tracks(spark, sf_dir), 4.0, (-6000.0, -3000.0), RES, x_range=(-4000.0, 3000.0), y_range=(-1500.0, 2000.0))
    return m.withColumn("purity", F.round("purity", 6))


@query("purity_total", sql(f"""
    WITH bins AS (SELECT dut, count(*) AS n_hits, count(*) FILTER ({D_SQL} < 4) AS n_pure FROM tracks WHERE x IS NOT NULL GROUP BY dut, floor((x + 6000) / 500), floor((y + 3000) / 500) HAVING count(*) >= 2)
    SELECT dut, round(100e0 * sum(n_pure) / sum(n_hits), 6) AS purity, round(sum(100e0 * n_pure / n_hits * n_hits) / sum(n_hits), 6) AS weighted FROM bins GROUP BY dut"""))
def purity_total(spark, sf_dir):
    """Overall purity of each plane and the hit-weighted mean over its bins."""
    t = R.total_purity(R.purity_map(views.tracks(spark, sf_dir), 4.0, (-6000.0, -3000.0), RES, least=2))
    return t.select("dut", F.round("purity", 6).alias("purity"), F.round("weighted", 6).alias("weighted"))


#: Planes that stand at an angle, so that local and global angles of a track differ.
TURNED = [replace(p, alpha=0.02 * p.dut, beta=-0.01 * p.dut) for p in G.TRACK_PLANES]
_ANGLES = {"total": "acos(abs({2}) / sqrt({0} * {0} + {1} * {1} + {2} * {2}))", "alpha": "atan2({1}, abs({2}))", "beta": "atan2(-({0}), abs({2}))"}
_SLOPES = {"local": [f"(r1{i} * sx + r2{i} * sy + r3{i} * sz)" for i in (1, 2, 3)], "global": ["sx", "sy", "sz"]}


@query("track_angle_hist", sql(f"""
    WITH a AS ({" UNION ALL ".join(f"SELECT dut, '{f}' AS frame, '{n}' AS angle, {e.format(*v)} AS v FROM tracks JOIN ({G.sql_values(TURNED)}) AS g USING (dut)" for f, v in _SLOPES.items() for n, e in _ANGLES.items())}),
      r AS (SELECT dut, frame, angle, avg(v) AS m, stddev_pop(v) AS s FROM a GROUP BY ALL)
    SELECT dut, frame, angle, CAST(least(floor((v - (m - 5e0 * s)) * (20 / ((m + 5e0 * s) - (m - 5e0 * s))) + 1e-9), 19) AS INT) AS bin, count(*) AS n, round(m, 9) + 0e0 AS mean, round(s, 9) AS sigma FROM a JOIN r USING (dut, frame, angle) WHERE v BETWEEN m - 5e0 * s AND m + 5e0 * s GROUP BY ALL"""))
def track_angle_hist(spark, sf_dir):
    """Total, alpha and beta angle in 20 bins over mean +- 5 sigma, in the frame of each (turned) plane and in the global one."""
    h = R.angle_histograms(turned_tracks(spark, sf_dir), 20)
    return h.select("dut", "frame", "angle", "bin", "n", (F.round("mean", 9) + 0.0).alias("mean"), F.round("sigma", 9).alias("sigma"))


def turned_tracks(spark, sf_dir):
    return G.with_geometry(views.tracks(spark, sf_dir).drop("z"), G.geometry(spark, TURNED))


@query("track_angle_fit")
def track_angle_fit(spark, sf_dir):
    """Gaussians fitted to the angle histograms, in bins; the fit itself is held against known peaks in the tests, these results are not."""
    return E.fit_histograms(R.angle_histograms(turned_tracks(spark, sf_dir), 100), ["dut", "frame", "angle"], "bin")


@query("tracks_per_event", sql("SELECT n AS n_tracks, count(*) AS n_events FROM (SELECT event_number, count(*) AS n FROM tracks WHERE dut = 0 GROUP BY event_number) AS e GROUP BY n"))
def tracks_per_event(spark, sf_dir):
    per = views.tracks(spark, sf_dir).where("dut = 0").groupBy("event_number").agg(F.count("*").alias("n_tracks"))
    return per.groupBy("n_tracks").agg(F.count("*").alias("n_events"))


_P = "exp(-chi2 / 2) * (1 + chi2 / 2 + (chi2 / 2) * (chi2 / 2) / 2 + (chi2 / 2) * (chi2 / 2) * (chi2 / 2) / 6)"


@query("chi2_hists", sql(f"""
    WITH t AS (SELECT dut, chi2, chi_red, {_P} AS p FROM tracks WHERE dut = 0), top AS (SELECT quantile_cont(chi2, 0.99) AS top FROM t)
    SELECT 'full' AS kind, CAST(least(floor(chi2 * (250 / top)), 249) AS INT) AS bin, count(*) AS n FROM t, top WHERE chi2 BETWEEN 0 AND top GROUP BY ALL
    UNION ALL SELECT 'narrow', CAST(least(floor(chi2 * 5), 99) AS INT), count(*) FROM t WHERE chi2 BETWEEN 0 AND 20 GROUP BY ALL
    UNION ALL SELECT 'reduced', CAST(least(floor(chi_red * 5), 49) AS INT), count(*) FROM t WHERE chi_red BETWEEN 0 AND 10 GROUP BY ALL
    UNION ALL SELECT 'p', CAST(least(floor(p * 50), 49) AS INT), count(*) FROM t WHERE p BETWEEN 0 AND 1 GROUP BY ALL"""))
def chi2_hists(spark, sf_dir):
    """Per track, read on plane 0; six hits leave eight degrees of freedom."""
    return R.chi2_histograms(views.tracks(spark, sf_dir).where("dut = 0"), F.lit(8))


@query("density_and_charge_maps", sql(f"SELECT dut, {PIX}, count(*) AS n_tracks, count(x) AS n_hits, round(avg(charge), 6) AS mean_charge FROM tracks GROUP BY ALL"))
def density_and_charge_maps(spark, sf_dir):
    return views.tracks(spark, sf_dir).groupBy("dut", pixel_x(), pixel_y()).agg(F.count("*").alias("n_tracks"), F.count("x").alias("n_hits"), mean6("charge").alias("mean_charge"))


_CORR = "SELECT a.dut, '{u}' AS axis, CAST(floor(abs(a.{u} - b.{u}) / 50) AS INT) AS bin, a.r{u} AS r1, b.r{u} AS r2 FROM "


@query("residual_correlation", sql(f"""
    WITH {GRID_SQL.replace("WHERE dut = 2 AND", "WHERE").replace("SELECT event_number", "SELECT dut, event_number")}, pairs AS ({_CORR.format(u="x")} {grid_pairs_sql("x", "y", 200)} AND a.dut = b.dut UNION ALL {_CORR.format(u="y")} {grid_pairs_sql("y", "x", 200)} AND a.dut = b.dut)
    SELECT dut, axis, bin, count(*) AS n, round(corr(r1, r2), 6) + 0e0 AS r FROM pairs GROUP BY ALL HAVING count(*) > 20"""))
def residual_correlation(spark, sf_dir):
    """Pearson correlation of residuals of track pairs of a plane by their distance, along x and along y; every track is a reference."""
    return correlations(spark, sf_dir).select("dut", "axis", "bin", "n", r6(F.col("r")).alias("r"))


def correlations(spark, sf_dir):
    tracks = with_hit(spark, sf_dir).select("dut", "event_number", F.col("ix").alias("x"), F.col("iy").alias("y"), rx().alias("rx"), ry().alias("ry"))
    tasks = -(-len(G.TRACK_PLANES) * views.count(spark, sf_dir) // C.TASK_TRACKS)
    return C.correlation(C.later_sums(tracks, 200.0, 50.0, tasks=max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions"))))).where("n > 20")


@query("residual_correlation_fit")
def residual_correlation_fit(spark, sf_dir):
    """A damped term and a sine fitted to the correlations of each plane and axis; the period starts at the pitch."""
    points = correlations(spark, sf_dir).withColumn("x", (F.col("bin") + 0.5) * 50.0)
    return E.fit_damped_sine(points, ["dut", "axis"], "x", "r", "n", 18.4)


@query("residual_slope", sql("""
    WITH b AS (SELECT dut, (CAST(floor((ix + 6000) / 500) AS INT) + 5e-1) * 500 - 6000 AS p, count(*) AS n, avg(x - ix) AS m FROM tracks WHERE x IS NOT NULL GROUP BY ALL),
      kept AS (SELECT dut, p, m, CAST(n AS DOUBLE) * n AS w FROM (SELECT *, quantile_cont(n, 0.32) OVER (PARTITION BY dut) AS least FROM b) AS c WHERE n > least)
    SELECT dut, count(*) AS n_bins, round((sum(w) * sum(w * p * m) - sum(w * p) * sum(w * m)) / nullif(greatest(sum(w) * sum(w * p * p) - sum(w * p) * sum(w * p), 0), 0), 9) + 0e0 AS slope,
      round((sum(w * p * p) * sum(w * m) - sum(w * p) * sum(w * p * m)) / nullif(greatest(sum(w) * sum(w * p * p) - sum(w * p) * sum(w * p), 0), 0), 6) + 0e0 AS offset_ FROM kept GROUP BY dut"""))
def residual_slope(spark, sf_dir):
    """Weighted line through the mean residual of each position bin with more hits than the 32nd percentile of bins."""
    b = with_hit(spark, sf_dir).groupBy("dut", bin_x().alias("b")).agg(F.count("*").alias("n"), F.avg(rx()).alias("m")).withColumn("p", (F.col("b") + 0.5) * RES - 6000)
    s = R.residual_slope(b, ["dut"], "p", "m")
    return s.select("dut", "n_bins", (F.round("slope", 9) + 0.0).alias("slope"), r6(F.col("offset")).alias("offset_"))


_PAIR_BINS = " UNION ALL ".join(f"""SELECT dut, '{r}' AS residual, '{p}' AS position, (CAST(floor((i{p} + {lo}) / 500) AS INT) + 5e-1) * 500 - {lo} AS p, count(*) AS n, avg({r} - i{r}) AS m
      FROM tracks JOIN ({G.sql_values(LIMITED)}) AS g USING (dut) WHERE x IS NOT NULL AND coalesce({v} >= {v}_lo, true) AND coalesce({v} <= {v}_hi, true) GROUP BY dut, floor((i{p} + {lo}) / 500)""" for r in "xy" for p, v, lo in (("x", "y", 6000), ("y", "x", 3000)))


@query("residual_slopes", sql(f"""
    WITH b AS ({_PAIR_BINS}), kept AS (SELECT b.*, CAST(n AS DOUBLE) * n AS w FROM b JOIN ({G.sql_values(LIMITED)}) AS g USING (dut)
      WHERE CASE position WHEN 'x' THEN coalesce(p >= x_lo, true) AND coalesce(p <= x_hi, true) ELSE coalesce(p >= y_lo, true) AND coalesce(p <= y_hi, true) END)
    SELECT dut, residual, position, count(*) AS n_bins, round((sum(w) * sum(w * p * m) - sum(w * p) * sum(w * m)) / nullif(greatest(sum(w) * sum(w * p * p) - sum(w * p) * sum(w * p), 0), 0), 9) + 0e0 AS slope,
      round((sum(w * p * p) * sum(w * m) - sum(w * p) * sum(w * p * m)) / nullif(greatest(sum(w) * sum(w * p * p) - sum(w * p) * sum(w * p), 0), 0), 6) + 0e0 AS offset_ FROM kept GROUP BY ALL"""))
def residual_slopes(spark, sf_dir):
    """Lines through the mean residuals of both axes against both positions, between the limits of each plane."""
    geo = G.geometry(spark, LIMITED)
    maps = R.residual_position_maps(G.with_geometry(views.tracks(spark, sf_dir).drop("z"), geo), RES, 0.5, (-6000.0, -3000.0))
    bins = maps.groupBy("dut", "residual", "position", "bin_pos").agg(F.max("pos_n").alias("n"), F.max("pos_mean").alias("m"))
    along_x = F.col("position") == "x"
    bins = G.with_geometry(bins, geo).withColumns({"p": (F.col("bin_pos") + 0.5) * RES - F.when(along_x, 6000.0).otherwise(3000.0)})
    ends = [F.coalesce(F.when(along_x, F.col(f"x_{e}")).otherwise(F.col(f"y_{e}")), F.col("p")) for e in ("lo", "hi")]
    s = R.residual_slope(bins, ["dut", "residual", "position"], "p", "m", limits=tuple(ends))
    return s.select("dut", "residual", "position", "n_bins", (F.round("slope", 9) + 0.0).alias("slope"), r6(F.col("offset")).alias("offset_"))


@query("residual_slope_gauss")
def residual_slope_gauss(spark, sf_dir):
    """The same between the outermost bins of a plane that have a tenth of its fullest bin, through the means of Gaussians fitted to each bin's residuals."""
    h = with_hit(spark, sf_dir).groupBy("dut", bin_x().alias("b"), F.floor(rx() * 2).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    fits = E.fit_histograms(h, ["dut", "b"], "bin").select("dut", "b", ((F.col("mean") + 0.5) / 2).alias("m"))
    b = h.groupBy("dut", "b").agg(F.sum("n").alias("n")).join(fits, ["dut", "b"]).withColumn("p", (F.col("b") + 0.5) * RES - 6000)
    w = Window.partitionBy("dut")  # a row for each position bin
    lit = F.when(F.col("n") >= F.max("n").over(w) / 10, F.col("p"))
    b = b.withColumn("lit", lit).withColumns({"lo": F.min("lit").over(w), "hi": F.max("lit").over(w)})
    return R.residual_slope(b, ["dut"], "p", "m", limits=(F.col("lo"), F.col("hi")))


@query("kde_mode", sql(f"""
    WITH rows AS ({_AXES}), stats AS (SELECT dut, axis, count(*) AS n, stddev_pop(r) AS s, median(r) AS med, CAST({18.4 / 12**0.5!r} AS DOUBLE) AS w FROM rows GROUP BY dut, axis HAVING count(*) > 10),
      hist AS (SELECT dut, axis, floor(r / (w / 8)) AS b, count(*) AS m FROM rows JOIN stats USING (dut, axis) GROUP BY ALL),
      grid AS (SELECT *, CASE WHEN k > 1 THEN med - 5e-1 * s + i * (s / (k - 1)) ELSE med - 5e-1 * s END AS g FROM (SELECT *, greatest(CAST(ceil(s) AS INT), 1) AS k, unnest(range(0, greatest(CAST(ceil(s) AS INT), 1))) AS i FROM stats) AS e),
      dens AS (SELECT dut, axis, n, i, g, round(sum(m * exp(-5e-1 * (((b + 5e-1) * (w / 8) - g) / w) * (((b + 5e-1) * (w / 8) - g) / w))), 6) AS d FROM grid JOIN hist USING (dut, axis) WHERE abs((b + 5e-1) * (w / 8) - med) <= 5e-1 * s + 6 * w GROUP BY ALL)
    SELECT dut, axis, n, round(g, 6) + 0e0 AS mode FROM (SELECT *, row_number() OVER (PARTITION BY dut, axis ORDER BY d DESC, i) AS k FROM dens) AS t WHERE k = 1"""))
def kde_mode(spark, sf_dir):
    """Where the density of each plane's residuals is greatest, near their median; the bandwidth is a pixel's error."""
    axes = F.explode(F.array(*(F.struct(F.lit(a).alias("axis"), r.alias("r")) for a, r in (("x", rx()), ("y", ry())))))
    rows = with_hit(spark, sf_dir).select("dut", axes.alias("a")).select("dut", "a.axis", "a.r", F.lit(18.4 / 12**0.5).alias("w"))
    return H.density_modes(rows, ["dut", "axis"], "r", "w").select("dut", "axis", "n", r6(F.col("mode")).alias("mode"))


_LINES = E.line_angles(0.5)


@query("hough_vote", sql(f"""
    WITH bins AS (SELECT event_number, dut, 'column' AS axis, "column" AS bin FROM hits UNION ALL SELECT event_number, dut, 'row', "row" FROM hits),
      c AS (SELECT a.dut AS ref, b.dut, a.axis, a.bin AS r, b.bin AS d, count(*) AS n FROM bins AS a JOIN bins AS b ON a.event_number = b.event_number AND a.axis = b.axis AND a.dut = 0 AND b.dut <> 0 GROUP BY ALL),
      top AS (SELECT ref, dut, axis, d, arg_max(r, n * 1000 - r) AS r FROM c GROUP BY ref, dut, axis, d),
      votes AS (SELECT ref, dut, axis, t, CAST(floor(d * cos(radians(t)) + r * sin(radians(t)) + 5e-1 + 1e-6) AS INT) AS rho, count(*) AS votes FROM top, (SELECT unnest([{", ".join(f"CAST({t!r} AS DOUBLE)" for t in _LINES)}]) AS t) AS l GROUP BY ALL),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY ref, dut, axis ORDER BY votes DESC, t, rho) AS rank FROM votes)
    SELECT ref, dut, axis, CAST(rank AS INT) AS rank, votes, round(-cos(radians(t)) / sin(radians(t)), 6) + 0e0 AS slope, round(rho / sin(radians(t)), 6) + 0e0 AS offset_ FROM ranked WHERE rank <= 5"""))
def hough_vote(spark, sf_dir):
    """The fullest reference bin for each bin of a plane votes for lines of a slope near 1 or -1; the five lines with the most votes for each pair and axis."""
    cells = J.plane_correlation(views.hits(spark, sf_dir), {"column": F.col("column"), "row": F.col("row")}, [0])
    lines = E.hough_lines(cells, ["ref", "dut", "axis"], step=0.5, most=5)
    return lines.select("ref", "dut", "axis", "rank", "votes", r6(F.col("slope")).alias("slope"), r6(F.col("offset")).alias("offset_"))
