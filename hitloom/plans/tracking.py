"""Queries on track building, fitting, alignment and streams."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hitloom.functions import geometry as G
from hitloom.functions.expressions import r6
from hitloom.operators import clusters as C
from hitloom.operators import estimate as E
from hitloom.operators import events as EV
from hitloom.operators import fits as FIT
from hitloom.operators import tracking as T
from hitloom.operators.joins import plane_correlation
from hitloom.plans.clusters import sql as cluster_sql
from hitloom.plans.positions import sql
from hitloom.plans.registry import query
from hitloom.runtime import Scratch, ship
from hitloom.sources import views
from hitloom.streaming import running as R

TK = ["event_number", "ordinal"]
PITCH = 18.4 / 12**0.5


def track_hits(spark, sf_dir):
    """Hits of tracks with errors; the planes stand upright, so local x, y are global."""
    rows = views.tracks(spark, sf_dir).select(*TK, "dut", "x", "y", F.when(F.col("x").isNotNull(), F.col("z")).alias("z"))
    return rows.withColumns({"x_err": F.lit(PITCH), "y_err": F.lit(PITCH)})


def plane_rows(spark, sf_dir):
    return G.with_geometry(views.tracks(spark, sf_dir).drop("z"), geo(spark))


def geo(spark):
    return G.geometry(spark, G.TRACK_PLANES)


@query("line_fit", sql("SELECT event_number, ordinal, count(x) AS n, round(avg(x), 6) + 0e0 AS ox, round(avg(y), 6) + 0e0 AS oy, round(avg(CASE WHEN x IS NOT NULL THEN z END), 6) + 0e0 AS oz FROM tracks GROUP BY ALL"))
def line_fit(spark, sf_dir):
    """The mean point; the direction is held against numpy in the tests."""
    f = T.line_fit(track_hits(spark, sf_dir), TK)
    return f.select(*TK, "n", *(r6(F.col(f"o{a}")).alias(f"o{a}") for a in "xyz"))


def fitted(spark, sf_dir):
    return T.fit_tracks(track_hits(spark, sf_dir), G.TRACK_PLANES, [0, 1, 2, 3, 4, 5], [1, 2, 3, 4], quality=(36.8, 36.8), isolation=(1000.0, 1000.0))


@query("fit_tracks")
def fit_tracks(spark, sf_dir):
    """Unbiased fits for the four inner planes, with all flags; counts and flags of the rows are in ``fit_track_flags``."""
    return fitted(spark, sf_dir)


@query("fit_track_flags", sql("""
    WITH duts AS (SELECT unnest([1, 2, 3, 4]) AS d), rows AS (SELECT event_number, ordinal, d AS fit_dut, count(x) FILTER (dut <> d) AS n, CAST(bit_or(CASE WHEN x IS NULL THEN 0 ELSE 1 << dut END) AS BIGINT) AS hit_flag,
        round(avg(x) FILTER (dut <> d), 6) + 0e0 AS ox, round(avg(y) FILTER (dut <> d), 6) + 0e0 AS oy FROM tracks, duts GROUP BY ALL),
      near AS (SELECT a.event_number, a.ordinal, a.dut FROM tracks AS a JOIN tracks AS b ON a.event_number = b.event_number AND a.dut = b.dut AND a.ordinal <> b.ordinal AND abs(a.x - b.x) <= 1000 AND abs(a.y - b.y) <= 1000 GROUP BY ALL),
      bits AS (SELECT event_number, ordinal, CAST(bit_or(1 << dut) AS BIGINT) AS near FROM near GROUP BY ALL)
    SELECT event_number, ordinal, fit_dut, n, hit_flag, 63 & ~coalesce(near, 0) AS isolated_hit_flag, ox, oy FROM rows LEFT JOIN bits USING (event_number, ordinal) WHERE n >= 3"""))
def fit_track_flags(spark, sf_dir):
    """What SQL can say of the fits: rows, hits used, hit and isolation flags, and the point of each line. Cuts of two pixels are below 2.5, so hits are met in a rectangle."""
    return fitted(spark, sf_dir).select(*TK, "fit_dut", F.col("n").cast("long").alias("n"), "hit_flag", "isolated_hit_flag", r6(F.col("ox")).alias("ox"), r6(F.col("oy")).alias("oy"))


@query("find_tracks")
def find_tracks(spark, sf_dir):
    """Hits whose ordinals were turned round inside each plane of an event are put back on their tracks."""
    rows = track_hits(spark, sf_dir)
    n = F.max("ordinal").over(Window.partitionBy("event_number"))
    mixed = rows.withColumn("n", n).withColumn("ordinal", F.when(F.col("dut") % 2 == 1, F.col("n") + 1 - F.col("ordinal")).otherwise(F.col("ordinal"))).drop("n")
    return T.find_tracks(mixed, G.TRACK_PLANES)


@query("kalman_fit")
def kalman_fit(spark, sf_dir):
    return T.kalman_fit(track_hits(spark, sf_dir), G.TRACK_PLANES, [0, 1, 2, 3, 4, 5])


def residual_histogram(spark, sf_dir):
    r = F.floor((F.col("x") - F.col("ix")) * 2).cast("int")
    return views.tracks(spark, sf_dir).where("x IS NOT NULL").groupBy("dut", r.alias("bin")).agg(F.count("*").alias("n"))


@query("gauss_fit")
def gauss_fit(spark, sf_dir):
    return E.fit_histograms(residual_histogram(spark, sf_dir), ["dut"], "bin")


@query("box_fit")
def box_fit(spark, sf_dir):
    return E.fit_histograms(residual_histogram(spark, sf_dir), ["dut"], "bin", shape="box")


@query("fit_moments", sql("""
    WITH h AS (SELECT dut, CAST(floor((x - ix) * 2) AS INT) AS bin, count(*) AS n FROM tracks WHERE x IS NOT NULL GROUP BY ALL)
    SELECT dut, CAST(sum(n) AS BIGINT) AS total, round(sum(n * bin) / sum(n), 6) + 0e0 AS moment_mean, round(sqrt(sum(n * bin * bin) / sum(n) - (sum(n * bin) / sum(n)) ** 2), 6) AS moment_rms FROM h GROUP BY dut"""))
def fit_moments(spark, sf_dir):
    """Rows and moments of the histograms that the fits start from."""
    return E.fit_histograms(residual_histogram(spark, sf_dir), ["dut"], "bin", shape="box").select("dut", "total", r6(F.col("moment_mean")).alias("moment_mean"), F.round("moment_rms", 6).alias("moment_rms"))


def each_model(spark, sf_dir):
    """The residual histogram of each plane fitted by every model with a peak."""
    h = Scratch(spark, "residuals").table(residual_histogram(spark, sf_dir), "histogram")  # a row per bin, read by each model
    return {m: FIT.fit_models(h, ["dut"], "bin", model=m) for m in FIT.MODELS if FIT.peaks(m)}


@query("fit_models")
def fit_models(spark, sf_dir):
    """Every peak model fitted to the residuals of each plane, one row per parameter; the tests hold each model against known parameters."""
    parts = []
    for m, f in each_model(spark, sf_dir).items():
        named = F.explode(F.array(*(F.struct(F.lit(k).alias("parameter"), F.col(k).alias("value"), F.col(f"{k}_err").alias("error")) for k in FIT.MODELS[m])))
        parts.append(f.select("dut", F.lit(m).alias("model"), "fitted", "cost", named.alias("p")).select("dut", "model", "fitted", "cost", "p.*"))
    return reduce(DataFrame.unionByName, parts)


@query("fit_model_sums", sql(f"""
    WITH h AS (SELECT dut, CAST(floor((x - ix) * 2) AS INT) AS bin, count(*) AS n FROM tracks WHERE x IS NOT NULL GROUP BY ALL)
    SELECT dut, model, count(*) AS n_bins, CAST(sum(n) AS BIGINT) AS total FROM h, (SELECT unnest({[m for m in FIT.MODELS if FIT.peaks(m)]}) AS model) GROUP BY ALL"""))
def fit_model_sums(spark, sf_dir):
    """Bins and rows that each model is fitted to."""
    return reduce(DataFrame.unionByName, (f.select("dut", F.lit(m).alias("model"), "n_bins", F.col("total").cast("long").alias("total")) for m, f in each_model(spark, sf_dir).items()))


@query("linear_fit", sql("""
    WITH h AS (SELECT dut, event_number // 100 AS bucket, count(*) AS n FROM hits GROUP BY ALL)
    SELECT dut, count(*) AS n_bins, CAST(sum(n) AS BIGINT) AS total, round(regr_intercept(n, bucket), 6) + 0e0 AS "offset", round(regr_slope(n, bucket), 6) + 0e0 AS slope FROM h GROUP BY dut"""))
def linear_fit(spark, sf_dir):
    """Drift of the hit rate: a line through the hits of each plane per hundred events."""
    h = views.hits(spark, sf_dir).groupBy("dut", F.expr("event_number div 100").alias("bucket")).agg(F.count("*").alias("n"))
    return FIT.fit_models(h, ["dut"], "bucket", model="linear").select("dut", "n_bins", F.col("total").cast("long").alias("total"), r6(F.col("offset")).alias("offset"), r6(F.col("slope")).alias("slope"))


@query("background_reduction")
def background_reduction(spark, sf_dir):
    h = views.hits(spark, sf_dir)
    return E.reduce_background(plane_correlation(h, {"column": F.col("column"), "row": F.col("row")}, [0]), ["ref", "dut", "axis"])


@query("efficiency_interval")
def efficiency_interval(spark, sf_dir):
    """Shortest 68 % interval of each plane's efficiency, on the few aggregated rows."""
    from hitloom.plans.results import efficiency_total

    found = efficiency_total(spark, sf_dir)
    ship(spark)

    @F.pandas_udf("lo double, hi double")
    def interval(k: pd.Series, n: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([E.shortest_interval(int(a), int(b)) for a, b in zip(k, n, strict=True)], columns=["lo", "hi"])

    return found.withColumn("i", interval("k", "n")).select("dut", "k", "n", "efficiency", "i.lo", "i.hi")


def shifted(spark, sf_dir):
    """Tracks' hits in the local frames of planes that stand elsewhere than assumed."""
    truth = [replace(p, tx=x, ty=y, gamma=g) for p, (x, y, g) in zip(G.TRACK_PLANES, [(0.0, 0.0, 0.0), (40.0, -25.0, 0.002), (-30.0, 10.0, -0.001), (20.0, 35.0, 0.0015), (-15.0, -40.0, 0.001), (0.0, 0.0, 0.0)], strict=True)]
    rows = G.with_geometry(track_hits(spark, sf_dir), G.geometry(spark, truth))
    x, y, _ = G.to_local(F.col("x"), F.col("y"), F.col("z"))
    return truth, rows.select(*TK, "dut", x.alias("x"), y.alias("y"), "x_err", "y_err")


def planes_table(spark, planes):
    return spark.createDataFrame([(p.dut, *(float(v) for v in (p.tx, p.ty, p.tz, p.alpha, p.beta, p.gamma))) for p in planes], "dut int, tx double, ty double, tz double, alpha double, beta double, gamma double")


@query("prealign")
def prealign(spark, sf_dir):
    return planes_table(spark, E.prealign(shifted(spark, sf_dir)[1], G.TRACK_PLANES, 0, 25.0))


def alignment_rows(spark, sf_dir):
    rows = G.with_geometry(track_hits(spark, sf_dir).where("x IS NOT NULL"), geo(spark))
    t = views.tracks(spark, sf_dir).where("dut = 0")
    norm = F.sqrt(F.col("sx") * F.col("sx") + F.col("sy") * F.col("sy") + 1)
    t = t.select(*TK, F.col("ix").alias("ox"), F.col("iy").alias("oy"), F.lit(0.0).alias("oz"), (F.col("sx") / norm).alias("sx"), (F.col("sy") / norm).alias("sy"), (1 / norm).alias("sz"))
    return rows.withColumns({"px": F.col("x"), "py": F.col("y"), "pz": F.lit(0.0)}).select(*TK, "dut", "tx", "ty", "tz", "px", "py", "pz").join(t, TK)


def _alignment_sql() -> str:
    """All 27 sums over the count: changes of a hit with the six parameters, taken across the track."""
    u = ["ux", "uy", "uz"]
    turns = [["0e0", "0e0", "py"], ["0e0", "0e0", "-px"], ["-py", "px", "0e0"]]
    shifts = [["1e0", "0e0", "0e0"], ["0e0", "1e0", "0e0"], ["0e0", "0e0", "1e0"]]
    m = turns + shifts
    across = lambda v: [f"({v[i]} - {u[i]} * ({' + '.join(f'{u[k]} * ({v[k]})' for k in range(3))}))" for i in range(3)]
    dot = lambda a, b: " + ".join(f"({a[i]}) * {b[i]}" for i in range(3))
    out = [f"round(sum({dot(m[a], across(m[b]))}) / count(*) / {10 ** (3 * ((a < 3) + (b < 3)))}e0, 6) + 0e0 AS n{a}{b}" for a in range(6) for b in range(a, 6)]
    return ", ".join(out + [f"round(sum({dot(m[a], across(['dx', 'dy', 'dz']))}) / count(*) / {10 ** (3 * (a < 3))}e0, 6) + 0e0 AS b{a}" for a in range(6)])


@query("alignment_step", sql(f"""
    SELECT dut, count(*) AS n, {_alignment_sql()}
    FROM (SELECT t.dut, t.x AS px, t.y AS py, f.sx / sqrt(f.sx * f.sx + f.sy * f.sy + 1) AS ux, f.sy / sqrt(f.sx * f.sx + f.sy * f.sy + 1) AS uy, 1 / sqrt(f.sx * f.sx + f.sy * f.sy + 1) AS uz, f.ix - t.x AS dx, f.iy - t.y AS dy, -t.z AS dz
      FROM tracks AS t JOIN tracks AS f ON t.event_number = f.event_number AND t.ordinal = f.ordinal AND f.dut = 0 WHERE t.x IS NOT NULL) AS r GROUP BY dut"""))
def alignment_step(spark, sf_dir):
    """Means of all terms of the normal equations (turns in thousandths); the damped steps are tested by closure."""
    s = E.alignment_sums(alignment_rows(spark, sf_dir))
    scale = lambda *k: F.col("n") * float(10 ** (3 * sum(v < 3 for v in k)))
    pairs = [r6(F.col(f"n{a}{b}") / scale(a, b)).alias(f"n{a}{b}") for a in range(6) for b in range(a, 6)]
    return s.select("dut", "n", *pairs, *(r6(F.col(f"b{a}") / scale(a)).alias(f"b{a}") for a in range(6)))


@query("align")
def align(spark, sf_dir):
    """The four inner planes between the outer ones, in three rounds with new tracks in each."""
    return planes_table(spark, E.align(shifted(spark, sf_dir)[1], G.TRACK_PLANES, [[1, 2, 3, 4]], [0, 1, 2, 3, 4, 5], isolation=None)[0])


@query("align_kalman")
def align_kalman(spark, sf_dir):
    return planes_table(spark, E.align_kalman(shifted(spark, sf_dir)[1], G.TRACK_PLANES, fixed=[0, 5], batches=6)[0])


@query("map_events", sql("SELECT event_number, count(*) AS n, sum(charge) AS charge FROM hits GROUP BY event_number"))
def map_events(spark, sf_dir):
    """A user function on whole events: here rows and charge of each."""
    fn = lambda b: b.groupby("event_number", as_index=False).agg(n=("charge", "size"), charge=("charge", "sum"))
    return EV.map_events(views.hits(spark, sf_dir), fn, "event_number long, n long, charge double")


@query("cluster_hits_kernel", cluster_sql("SELECT event_number, dut, ordinal, cluster_id FROM cluster_hits"))
def cluster_hits_kernel(spark, sf_dir):
    """In batches of whole events, and for crowded ones by joins; the query has both ways, each for half of the events."""
    hits, even = views.hits(spark, sf_dir), F.col("event_number") % 2 == 0
    one = EV.clusters_by_kernel(hits.where(even), 3, 3)
    two = C.clusters_by_joins(hits.where(~even), 3, 3, None, Scratch(spark, "clusters"))
    return one.unionByName(two).select("event_number", "dut", "ordinal", "cluster_id")


_STREAM = "SELECT CAST(epoch(time_bucket(INTERVAL 1 DAY, ts)) AS BIGINT) AS start, CAST(user_id % 3 AS INT) AS dut, "


@query("stream_occupancy", _STREAM + "CAST(event_id % 16 + 1 AS INT) AS col, CAST(user_id % 16 + 1 AS INT) AS row_, count(*) AS n FROM events GROUP BY ALL")
def stream_occupancy(spark, sf_dir):
    return R.run_to_table(R.running_occupancy(R.stream_of(spark, sf_dir)), ["dut", "col", "row_"], Scratch(spark, "stream"))


@query("stream_efficiency_trend", _STREAM + "count(*) FILTER (event_type <> 'error') AS n_pass, count(*) AS n FROM events GROUP BY ALL")
def stream_efficiency_trend(spark, sf_dir):
    return R.run_to_table(R.running_efficiency(R.stream_of(spark, sf_dir)), ["dut"], Scratch(spark, "stream"))


