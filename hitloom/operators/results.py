"""Residual, efficiency, purity and angle summaries of fitted tracks.

Input rows are one per (track, plane): ``dut``, the hit ``x, y`` (null: none),
the track's crossing point ``ix, iy``, its local slope ``sx, sy, sz`` and the
hit's ``charge, frame, n_hits``, with plane constants attached where a cut or
a cell needs them. Every summary is one grouped pass with conditional
aggregates; bins are sparse rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hitloom.functions import geometry as G
from hitloom.functions.expressions import chi2_pvalue, in_window
from hitloom.operators import histograms as H


def rx() -> Column:
    return F.col("x") - F.col("ix")


def ry() -> Column:
    return F.col("y") - F.col("iy")


def distance() -> Column:
    return F.sqrt(rx() * rx() + ry() * ry())


def position_bin(c: str, lo: float, width: float) -> Column:
    return F.floor((F.col(c) - lo) / width).cast("int")


def valid_hit(cut: tuple[float | None, float | None]) -> Column:
    """A hit inside the cut window around the crossing point; a null cut is open."""
    inside = in_window(rx(), ry(), F.lit(cut[0]).cast("double"), F.lit(cut[1]).cast("double"), F.col("column_size"), F.col("row_size"))
    return F.col("x").isNotNull() & F.coalesce(inside, F.lit(False))


def in_area(tracks: DataFrame, width: float, extend: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """Rows whose crossing point lies on the plane's matrix, or beside it by no more than ``extend``, rounded up to whole bins of ``width``."""
    half = lambda n, size, more: F.col(n) * F.col(size) / 2 + F.ceil(F.lit(more) / width) * width
    return tracks.where((F.abs("ix") <= half("n_columns", "column_size", extend[0])) & (F.abs("iy") <= half("n_rows", "row_size", extend[1])))


def efficiency_map(tracks: DataFrame, cut, lo: tuple[float, float], width: float, least: int = 1) -> DataFrame:
    """Counts, efficiency and means of valid hits per plane and bin; bins with fewer than ``least`` tracks are left out."""
    of = lambda c: F.avg(F.when(F.col("v"), c))
    _, alpha, beta = G.angles(F.col("sx"), F.col("sy"), F.col("sz"))
    rows = tracks.withColumn("v", valid_hit(cut)).groupBy("dut", position_bin("ix", lo[0], width).alias("bx"), position_bin("iy", lo[1], width).alias("by_")).agg(
        F.count("*").alias("n_tracks"), F.count_if("v").alias("n_valid"), F.count_if(F.col("x").isNotNull()).alias("n_hits_all"), (100 * F.count_if("v") / F.count("*")).alias("efficiency"),
        of(rx()).alias("mean_rx"), of(ry()).alias("mean_ry"), of(distance()).alias("mean_distance"), of(F.col("charge")).alias("mean_charge"), of(F.col("frame")).alias("mean_frame"),
        of(F.col("n_hits")).alias("mean_size"), of(alpha).alias("mean_alpha"), of(beta).alias("mean_beta"),
    )
    return rows.where(F.col("n_tracks") >= least)


MEANS = ("rx", "ry", "distance", "charge", "frame", "size")


def efficiency_by(tracks: DataFrame, cut, *by: str) -> DataFrame:
    """Tracks, valid hits, efficiency and means over valid hits (residuals, distance, charge, frame, cluster size) for any grouping."""
    values = {"rx": rx(), "ry": ry(), "distance": distance(), "charge": F.col("charge"), "frame": F.col("frame"), "size": F.col("n_hits")}
    means = (F.avg(F.when(F.col("v"), values[k])).alias(f"mean_{k}") for k in MEANS)
    out = tracks.withColumn("v", valid_hit(cut)).groupBy(*by).agg(F.count("*").alias("n_tracks"), F.count_if("v").alias("n_valid"), *means)
    return out.withColumn("efficiency", F.col("n_valid") / F.col("n_tracks"))


def distributions(tracks: DataFrame, cut, *by: str, angle_width: float = 1e-6) -> DataFrame:
    """Counts (by, kind, bin, n) of valid hits by charge, frame, cluster size and shape, and by alpha and beta in bins of ``angle_width``, in one pass."""
    _, alpha, beta = G.angles(F.col("sx"), F.col("sy"), F.col("sz"))
    kinds = {"charge": F.col("charge"), "frame": F.col("frame"), "size": F.col("n_hits"), "shape": F.col("cluster_shape"), "alpha": F.floor(alpha / angle_width), "beta": F.floor(beta / angle_width)}
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), c.cast("long").alias("bin")) for k, c in kinds.items())))
    rows = tracks.where(valid_hit(cut)).select(*by, each.alias("a"))
    return rows.groupBy(*by, F.col("a.kind").alias("kind"), F.col("a.bin").alias("bin")).agg(F.count("*").alias("n"))


def residual_position_maps(tracks: DataFrame, position_width: float, residual_width: float, lo: tuple[float, float]) -> DataFrame:
    """Four two-dimensional histograms per plane: residual x or y against position x or y, with count and mean residual of each position bin.

    Positions are the crossing points. Histograms over x take the hits inside
    the plane's y limits, those over y the hits inside its x limits.
    """
    within = {"x": F.coalesce(F.col("y") >= F.col("y_lo"), F.lit(True)) & F.coalesce(F.col("y") <= F.col("y_hi"), F.lit(True)), "y": F.coalesce(F.col("x") >= F.col("x_lo"), F.lit(True)) & F.coalesce(F.col("x") <= F.col("x_hi"), F.lit(True))}
    kinds = [F.struct(F.lit(r).alias("residual"), F.lit(p).alias("position"), v.alias("r"), position_bin(f"i{p}", at, position_width).alias("bin_pos"), within[p].alias("ok")) for r, v in (("x", rx()), ("y", ry())) for p, at in zip("xy", lo, strict=True)]
    rows = tracks.where("x IS NOT NULL").select("dut", F.explode(F.array(*kinds)).alias("a")).select("dut", "a.*").where("ok")
    keys = ["dut", "residual", "position", "bin_pos"]
    cells = rows.groupBy(*keys, F.floor(F.col("r") / residual_width).cast("int").alias("bin_res")).agg(F.count("*").alias("n"), F.sum("r").alias("s"))
    w = Window.partitionBy(*keys)  # as many rows as there are residual bins
    return cells.withColumns({"pos_n": F.sum("n").over(w), "pos_mean": F.sum("s").over(w) / F.sum("n").over(w)}).drop("s")


def residual_slope(bins: DataFrame, by: list[str], at: str, mean: str, n: str = "n", share: float = 0.32, limits: tuple[float | Column | None, float | Column | None] | None = None) -> DataFrame:
    """Weighted line (by, n_bins, slope, offset) through the mean residuals of position bins; a bin weighs by the square of its count.

    Used are the bins whose position lies inside ``limits``, or without limits
    those with more rows than the ``share`` quantile of the bins' counts. A
    plane has as many bins as its size allows, so these sums are small.
    """
    if limits is None:
        w = Window.partitionBy(*by)
        kept = bins.withColumn("least_", F.percentile(n, F.lit(share)).over(w)).where(F.col(n) > F.col("least_"))
    else:
        kept = bins.where((F.lit(True) if limits[0] is None else F.col(at) >= limits[0]) & (F.lit(True) if limits[1] is None else F.col(at) <= limits[1]))
    w, p, m = F.col(n).cast("double") * F.col(n), F.col(at), F.col(mean)
    sums = kept.groupBy(*by).agg(F.count("*").alias("n_bins"), *(F.sum(v).alias(k) for k, v in (("s", w), ("sp", w * p), ("sm", w * m), ("spp", w * p * p), ("spm", w * p * m))))
    under = F.col("s") * F.col("spp") - F.col("sp") * F.col("sp")
    slope, offset = (F.col("s") * F.col("spm") - F.col("sp") * F.col("sm")), (F.col("spp") * F.col("sm") - F.col("sp") * F.col("spm"))
    return sums.select(*by, "n_bins", F.when(under > 0, slope / under).alias("slope"), F.when(under > 0, offset / under).alias("offset"))


def hit_pattern(cluster_hits: DataFrame, places: DataFrame, key: list[str], width: float, lo: float, half: int) -> DataFrame:
    """Counts (dut, bx, by_, d_column, d_row, n, mode) of clusters' pixels relative to the pixel under the centre of the map bin ``bx, by_`` that ``places`` has for the cluster.

    Map bins are ``width`` pixels wide and start at ``lo``; pixels up to ``half``
    away count; ``mode`` marks the most frequent one (of equals the smallest
    column, then row).
    """
    centre = lambda c: F.floor((F.col(c) + 0.5) * width + lo + 0.5).cast("int")
    d = (F.col("column") - centre("bx")).alias("d_column"), (F.col("row") - centre("by_")).alias("d_row")
    cells = cluster_hits.join(places, key).select("dut", "bx", "by_", *d).where((F.abs("d_column") <= half) & (F.abs("d_row") <= half)).groupBy("dut", "bx", "by_", "d_column", "d_row").agg(F.count("*").alias("n"))
    first = F.row_number().over(Window.partitionBy("dut", "bx", "by_").orderBy(F.desc("n"), "d_column", "d_row"))  # one row per pixel of the window
    return cells.withColumn("mode", first == 1)


def angle_histograms(tracks: DataFrame, bins: int, span: float = 5.0) -> DataFrame:
    """Histograms (dut, frame, angle, bin, n, mean, sigma) of the total, alpha and beta angle of tracks, in each plane's frame and the global one, over mean +- ``span`` sigma.

    ``tracks`` has global slopes sx, sy, sz and plane constants. A bit of slack
    keeps values at bin edges on one side.
    """
    own = G.rotate(F.col("sx"), F.col("sy"), F.col("sz"), back=True)
    frames = {"local": own, "global": (F.col("sx"), F.col("sy"), F.col("sz"))}
    kinds = {(f, n): v for f, s in frames.items() for n, v in zip(("total", "alpha", "beta"), G.angles(*s), strict=True)}
    name = "_".join
    angles = tracks.select("dut", *(v.alias(name(k)) for k, v in kinds.items()))
    sums = angles.groupBy("dut").agg(*(f(name(k)).alias(f"{m}_{name(k)}") for k in kinds for m, f in (("mean", F.avg), ("sigma", F.stddev_pop))))  # a row a plane

    def placed(k: tuple[str, str]) -> Column:
        v, mean, sigma = F.col(name(k)), F.col(f"mean_{name(k)}"), F.col(f"sigma_{name(k)}")
        lo, hi = mean - span * sigma, mean + span * sigma
        return F.when(v.between(lo, hi) & (sigma > 0), F.least(F.floor((v - lo) * (bins / (hi - lo)) + 1e-9), F.lit(bins - 1)).cast("int"))

    each = lambda column: F.explode(F.array(*(F.struct(F.lit(f).alias("frame"), F.lit(n).alias("angle"), *column((f, n))) for f, n in kinds)))
    counts = angles.join(F.broadcast(sums), "dut").select("dut", each(lambda k: [placed(k).alias("bin")]).alias("a")).where("a.bin IS NOT NULL").groupBy("dut", "a.frame", "a.angle", "a.bin").agg(F.count("*").alias("n"))
    ranges = sums.select("dut", each(lambda k: [F.col(f"{m}_{name(k)}").alias(m) for m in ("mean", "sigma")]).alias("a")).select("dut", "a.*")  # six rows a plane
    return counts.join(F.broadcast(ranges), ["dut", "frame", "angle"]).select("dut", "frame", "angle", "mean", "sigma", "bin", "n")


def chi2_histograms(tracks: DataFrame, ndof: Column) -> DataFrame:
    """Counts (kind, bin, n): chi2 up to its 99th percentile in 250 bins and up to 20 in 100, reduced chi2 up to 10 in 50, the p-value in 50."""
    found = H.quantiles(tracks.select(F.lit(1).alias("one"), "chi2"), ["one"], "chi2", {"top": 0.99}).first()
    top = F.lit(found["top"] if found else None).cast("double")
    rows = tracks.withColumn("p", chi2_pvalue(F.col("chi2"), ndof))
    full = F.when(F.col("chi2").between(0, top), F.least(F.floor(F.col("chi2") * (250 / top)), F.lit(249)).cast("int"))
    kinds = {"full": full, "narrow": H.edge_bin(F.col("chi2"), 0.0, 20.0, 100), "reduced": H.edge_bin(F.col("chi_red"), 0.0, 10.0, 50), "p": H.edge_bin(F.col("p"), 0.0, 1.0, 50)}
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), c.alias("bin")) for k, c in kinds.items())))
    return rows.select(each.alias("a")).where("a.bin IS NOT NULL").groupBy(F.col("a.kind").alias("kind"), F.col("a.bin").alias("bin")).agg(F.count("*").alias("n"))


def in_regions(tracks: DataFrame, regions: list[tuple[str, float, float, float, float]]) -> DataFrame:
    """Rows once for each open rectangle (name, x_lo, x_hi, y_lo, y_hi) that holds their crossing point."""
    box = lambda a, b, c, d: (F.col("ix") > a) & (F.col("ix") < b) & (F.col("iy") > c) & (F.col("iy") < d)
    names = F.array_compact(F.array(*(F.when(box(*r[1:]), F.lit(r[0])) for r in regions)))
    return tracks.withColumn("region", F.explode(names))


def in_pixel(tracks: DataFrame, width: float) -> DataFrame:
    """Rows with the bin ``bx, by_`` of the primitive cell that the track crosses."""
    x, y = G.cell_position(F.col("ix"), F.col("iy"))
    return tracks.withColumns({"bx": F.floor(x / width).cast("int"), "by_": F.floor(y / width).cast("int")})


def in_pixel_shapes(tracks: DataFrame, cut, shapes: tuple[int, ...], *by: str) -> DataFrame:
    """Counts of valid hits for each of ``shapes`` per bin ``bx, by_`` of the primitive cell and any grouping ``by``."""
    rows = tracks.where(valid_hit(cut) & F.col("cluster_shape").isin(*shapes))
    return rows.groupBy(*by, "bx", "by_", "cluster_shape").agg(F.count("*").alias("n"))


def wrapped(cells: DataFrame, nx: int, ny: int, pad: int) -> DataFrame:
    """A periodic map with ``pad`` more bins on each side, taken from the opposite edge."""
    copies = [F.struct((F.col("bx") + i * nx).alias("bx"), (F.col("by_") + j * ny).alias("by_")) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    rest = [c for c in cells.columns if c not in ("bx", "by_")]
    out = cells.select(*rest, F.explode(F.array(*copies)).alias("c")).select(*rest, "c.bx", "c.by_")
    return out.where(F.col("bx").between(-pad, nx + pad - 1) & F.col("by_").between(-pad, ny + pad - 1))


def purity_map(tracks: DataFrame, cut: float, lo: tuple[float, float], width: float, least: int = 1, x_range: tuple[float, float] | None = None, y_range: tuple[float, float] | None = None) -> DataFrame:
    """Share of hits with a track closer than ``cut`` per bin of the hit's position, in percent.

    With ranges only tracks that cross the plane inside them (ends included) make a hit pure.
    """
    inside = [F.col(c).between(*r) for c, r in (("ix", x_range), ("iy", y_range)) if r is not None]
    pure = distance() < cut
    for one in inside:
        pure = pure & one
    hits = tracks.where("x IS NOT NULL").withColumn("pure", pure)
    rows = hits.groupBy("dut", position_bin("x", lo[0], width).alias("bx"), position_bin("y", lo[1], width).alias("by_")).agg(F.count("*").alias("n_hits"), F.count_if("pure").alias("n_pure"))
    return rows.where(F.col("n_hits") >= least).withColumn("purity", 100 * F.col("n_pure") / F.col("n_hits"))


def total_purity(purity: DataFrame) -> DataFrame:
    """Overall purity and the hit-weighted mean over bins per plane."""
    return purity.groupBy("dut").agg((100 * F.sum("n_pure") / F.sum("n_hits")).alias("purity"), (F.sum(F.col("purity") * F.col("n_hits")) / F.sum("n_hits")).alias("weighted"))


def residual_histograms(tracks: DataFrame, bins: int = 200, span: float = 6.0) -> DataFrame:
    """Residual histograms of both axes with a range of their own: ``span`` times the half-maximum width around the peak.

    The first pass is a fine histogram (a hundredth of the pixel pitch), of
    which centre and width are read; the second fills ``bins`` bins.
    """
    axes = F.explode(F.array(F.struct(F.lit("x").alias("axis"), rx().alias("r"), F.col("column_size").alias("p")), F.struct(F.lit("y").alias("axis"), ry().alias("r"), F.col("row_size").alias("p"))))
    rows = tracks.where("x IS NOT NULL").select("dut", axes.alias("a")).select("dut", "a.axis", "a.r", "a.p")
    fine = rows.groupBy("dut", "axis", "p", F.floor(F.col("r") / (F.col("p") / 100)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    peak = H.peak_width(fine, ["dut", "axis", "p"], "bin")
    step = F.col("p") / 100
    ranges = peak.select("dut", "axis", ((F.col("center") + 0.5 - span * F.col("width")) * step).alias("lo"), ((F.col("center") + 0.5 + span * F.col("width")) * step).alias("hi"))
    placed = rows.drop("p").join(F.broadcast(ranges), ["dut", "axis"])  # two rows a plane
    bin_ = F.least(F.floor((F.col("r") - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))), F.lit(bins - 1)).cast("int")
    return placed.where("r BETWEEN lo AND hi").groupBy("dut", "axis", "lo", "hi", bin_.alias("bin")).agg(F.count("*").alias("n"))
