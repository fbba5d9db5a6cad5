"""Queries on coordinates, planes and scalar functions."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from hitloom.functions import expressions as X
from hitloom.functions import geometry as G
from hitloom.functions.expressions import r6
from hitloom.plans.registry import query
from hitloom.sources import views

GEO = G.sql_values(G.HIT_PLANES)
TGEO = G.sql_values(G.TRACK_PLANES)
KEYS = ["event_number", "dut", "ordinal"]
LX = 'column_size * ("column" - 5e-1 - n_columns * 5e-1)'
LY = 'row_size * ("row" - 5e-1 - n_rows * 5e-1)'
LOCAL = f'SELECT hits.*, geo.* EXCLUDE (dut), {LX} AS lx, {LY} AS ly FROM hits JOIN geo USING (dut)'
GLOBAL = "SELECT *, r11 * lx + r12 * ly + tx AS gx, r21 * lx + r22 * ly + ty AS gy, r31 * lx + r32 * ly + tz AS gz FROM local_"


def sql(text: str) -> str:
    return views.with_views(text, geo=GEO, tgeo=TGEO, local_=LOCAL, global_=GLOBAL)


def local_hits(spark, sf_dir):
    """Hits with plane constants and local positions lx, ly."""
    rows = G.with_geometry(views.hits(spark, sf_dir), G.geometry(spark, G.HIT_PLANES))
    x, y = G.local_from_index(F.col("column"), F.col("row"))
    return rows.withColumns({"lx": x, "ly": y})


def global_hits(spark, sf_dir):
    x, y, z = G.to_global(F.col("lx"), F.col("ly"), F.lit(0.0))
    return local_hits(spark, sf_dir).withColumns({"gx": x, "gy": y, "gz": z})


def plane_tracks(spark, sf_dir):
    return G.with_geometry(views.tracks(spark, sf_dir).drop("z"), G.geometry(spark, G.TRACK_PLANES))


@query("index_to_local", sql("SELECT event_number, dut, ordinal, lx AS x, ly AS y FROM local_"))
def index_to_local(spark, sf_dir):
    """An index outside its plane's matrix is an error."""
    rows = G.with_geometry(views.hits(spark, sf_dir), G.geometry(spark, G.HIT_PLANES))
    x, y = G.local_from_index(F.col("column"), F.col("row"), strict=True)
    return rows.select(*KEYS, x.alias("x"), y.alias("y"))


@query("local_to_index", sql('SELECT event_number, dut, ordinal, round(lx / column_size + 5e-1 + n_columns * 5e-1, 6) AS column_f, CAST(floor(ly / row_size + 5e-1 + n_rows * 5e-1 + 1e-9) AS INT) AS row_i FROM local_'))
def local_to_index(spark, sf_dir):
    c, r = G.index_from_local(F.col("lx"), F.col("ly"))
    return local_hits(spark, sf_dir).select(*KEYS, F.round(c, 6).alias("column_f"), F.floor(r + 1e-9).cast("int").alias("row_i"))


@query("local_to_global", sql("SELECT event_number, dut, ordinal, round(gx, 6) + 0e0 AS x, round(gy, 6) + 0e0 AS y, round(gz, 6) + 0e0 AS z FROM global_"))
def local_to_global(spark, sf_dir):
    return global_hits(spark, sf_dir).select(*KEYS, r6(F.col("gx")).alias("x"), r6(F.col("gy")).alias("y"), r6(F.col("gz")).alias("z"))


BACK = "round(r11 * (gx - tx) + r21 * (gy - ty) + r31 * (gz - tz), 6) + 0e0 AS x, round(r12 * (gx - tx) + r22 * (gy - ty) + r32 * (gz - tz), 6) + 0e0 AS y"


@query("global_to_local", sql(f"SELECT event_number, dut, ordinal, {BACK} FROM global_"))
def global_to_local(spark, sf_dir):
    x, y, _ = G.to_local(F.col("gx"), F.col("gy"), F.col("gz"))
    return global_hits(spark, sf_dir).select(*KEYS, r6(x).alias("x"), r6(y).alias("y"))


@query("index_to_global", sql(f"SELECT event_number, dut, ordinal, round(r11 * {LX} + r12 * {LY} + tx, 6) + 0e0 AS x, round(r21 * {LX} + r22 * {LY} + ty, 6) + 0e0 AS y FROM local_"))
def index_to_global(spark, sf_dir):
    rows = G.with_geometry(views.hits(spark, sf_dir), G.geometry(spark, G.HIT_PLANES))
    x, y, _ = G.to_global(*G.local_from_index(F.col("column"), F.col("row")), F.lit(0.0))
    return rows.select(*KEYS, r6(x).alias("x"), r6(y).alias("y"))


@query("global_to_index", sql('SELECT event_number, dut, ordinal, "column" AS col, "row" AS row_ FROM hits'))
def global_to_index(spark, sf_dir):
    x, y, _ = G.to_local(F.col("gx"), F.col("gy"), F.col("gz"))
    c, r = G.index_from_local(x, y)
    return global_hits(spark, sf_dir).select(*KEYS, F.round(c).cast("int").alias("col"), F.round(r).cast("int").alias("row_"))


@query("plane_extent", sql(f"""
    WITH corners AS (SELECT geo.*, a * column_size * n_columns * 5e-1 AS u, b * row_size * n_rows * 5e-1 AS v FROM geo, (VALUES (-1), (1)) AS p(a), (VALUES (-1), (1)) AS q(b)),
      extents AS (SELECT dut, min(u) AS local_x_lo, max(u) AS local_x_hi, min(v) AS local_y_lo, max(v) AS local_y_hi,
        {", ".join(f"round({f}(r{i}1 * u + r{i}2 * v + t{a}), 6) + 0e0 AS {a}_{n}" for i, a in enumerate("xyz", 1) for n, f in (("lo", "min"), ("hi", "max")))} FROM corners GROUP BY dut),
      held AS (SELECT dut, count(*) AS n_hits FROM hits GROUP BY dut)
    SELECT * FROM extents JOIN held USING (dut)"""))
def plane_extent(spark, sf_dir):
    """Local and global extent of each plane from its corners, with the number of hits it holds."""
    geo = G.geometry(spark, G.HIT_PLANES)
    half = {"x": F.col("column_size") * F.col("n_columns") * 0.5, "y": F.col("row_size") * F.col("n_rows") * 0.5}
    out = {f"local_{a}_{n}": s * h for a, h in half.items() for n, s in (("lo", -1), ("hi", 1))}
    out |= {f"{a}_{n}": r6(v) for i, a in enumerate("xyz") for n, v in zip(("lo", "hi"), G.extent(i), strict=True)}
    n = views.hits(spark, sf_dir).groupBy("dut").agg(F.count("*").alias("n_hits"))
    return n.join(F.broadcast(geo.select("dut", *(v.alias(f"e_{k}") for k, v in out.items()))), "dut").select("dut", "n_hits", *(F.col(f"e_{k}").alias(k) for k in out))


@query("primitive_cell", sql("""
    SELECT event_number, dut, ordinal, round(((lx + column_size * n_columns * 5e-1) % (column_size * cell_columns) + column_size * cell_columns) % (column_size * cell_columns), 6) + 0e0 AS cx,
      round(((ly + row_size * n_rows * 5e-1) % (row_size * cell_rows) + row_size * cell_rows) % (row_size * cell_rows), 6) + 0e0 AS cy FROM local_"""))
def primitive_cell(spark, sf_dir):
    x, y = G.cell_position(F.col("lx"), F.col("ly"))
    return local_hits(spark, sf_dir).select(*KEYS, r6(x).alias("cx"), r6(y).alias("cy"))


_B = G.rotation(*G.BEAM)


def _times(m, v):
    return [" + ".join(f"({m[i][j]!r}) * {v[j]}" for j in range(3)) for i in range(3)]


@query("align_to_beam", sql("SELECT event_number, dut, ordinal, " + ", ".join(f"round({e}, 6) + 0e0 AS {n}" for e, n in zip(_times(_B, ["gx", "gy", "gz"]), "xyz", strict=True)) + " FROM global_"))
def align_to_beam(spark, sf_dir):
    """Plane rotation first, then the telescope's."""
    v = G.fixed_rotation(_B, F.col("gx"), F.col("gy"), F.col("gz"))
    return global_hits(spark, sf_dir).select(*KEYS, *(r6(c).alias(n) for c, n in zip(v, "xyz", strict=True)))


@query("apply_alignment", sql("""
    SELECT event_number, dut, ordinal, round(gx, 6) + 0e0 AS x, round(gy, 6) + 0e0 AS y, round(r11 * 1e-3 + r12 * 2e-3 + r13, 9) + 0e0 AS slope_x, round(r21 * 1e-3 + r22 * 2e-3 + r23, 9) + 0e0 AS slope_y,
      round(abs(r11 * column_size / sqrt(12e0) + r12 * row_size / sqrt(12e0)), 6) + 0e0 AS err_x, round(abs(r21 * column_size / sqrt(12e0) + r22 * row_size / sqrt(12e0)), 6) + 0e0 AS err_y FROM global_"""))
def apply_alignment(spark, sf_dir):
    """Positions move and turn, slopes turn, errors turn and lose their sign."""
    slope = G.rotate(F.lit(1e-3), F.lit(2e-3), F.lit(1.0))
    err = G.rotate(F.col("column_size") / F.sqrt(F.lit(12.0)), F.col("row_size") / F.sqrt(F.lit(12.0)), F.lit(0.0))
    return global_hits(spark, sf_dir).select(
        *KEYS, r6(F.col("gx")).alias("x"), r6(F.col("gy")).alias("y"), (F.round(slope[0], 9) + 0.0).alias("slope_x"), (F.round(slope[1], 9) + 0.0).alias("slope_y"), r6(F.abs(err[0])).alias("err_x"), r6(F.abs(err[1])).alias("err_y")
    )


@query("intersect_plane", sql("""
    SELECT event_number, dut, ordinal, round(gx + 1e-3 * k, 6) + 0e0 AS x, round(gy - 2e-3 * k, 6) + 0e0 AS y, round(gz + k, 6) + 0e0 AS z
    FROM (SELECT h.event_number, h.dut, h.ordinal, gx, gy, gz, ((q.tx - gx) * q.r13 + (q.ty - gy) * q.r23 + (q.tz - gz) * q.r33) / (1e-3 * q.r13 - 2e-3 * q.r23 + q.r33) AS k
      FROM global_ AS h JOIN geo AS q ON q.dut = 2 WHERE h.dut <> 2) AS t"""))
def intersect_plane(spark, sf_dir):
    """Lines through the hits of other planes, carried on to plane 2."""
    rows = global_hits(spark, sf_dir).where("dut <> 2").select(*KEYS, "gx", "gy", "gz")
    target = G.geometry(spark, G.HIT_PLANES).withColumnRenamed("dut", "target")
    p = G.intersect((F.col("gx"), F.col("gy"), F.col("gz")), (F.lit(1e-3), F.lit(-2e-3), F.lit(1.0)))
    return rows.withColumn("target", F.lit(2)).join(F.broadcast(target), "target").select(*KEYS, *(r6(c).alias(n) for c, n in zip(p, "xyz", strict=True)))


@query("charge_filter", sql("SELECT event_number, dut, ordinal, charge FROM hits WHERE charge BETWEEN 5 AND 40"))
def charge_filter(spark, sf_dir):
    return views.hits(spark, sf_dir).where(F.col("charge").between(5, 40)).select(*KEYS, "charge")


@query("limit_filter", sql("SELECT event_number, dut, ordinal FROM local_ WHERE coalesce(lx >= x_lo, true) AND coalesce(lx <= x_hi, true) AND coalesce(ly >= y_lo, true) AND coalesce(ly <= y_hi, true)"))
def limit_filter(spark, sf_dir):
    return local_hits(spark, sf_dir).where(G.within_limits(F.col("lx"), F.col("ly"))).select(*KEYS)


_MODELS_SQL = ", ".join(f"({i}, '{n}', CAST({v[0]!r} AS DOUBLE), CAST({v[1]!r} AS DOUBLE), {v[2]}, {v[3]}, {v[4]}, {v[5]})" for i, (n, v) in enumerate(G.MODELS.items()))


@query("detector_models", sql(f"""
    SELECT name AS model, column_size, row_size, n_columns, n_rows, cell_columns, cell_rows, count(*) AS n_parts
    FROM (VALUES {_MODELS_SQL}) AS m(i, name, column_size, row_size, n_columns, n_rows, cell_columns, cell_rows) JOIN part ON p_partkey % {len(G.MODELS)} = i GROUP BY ALL"""))
def detector_models(spark, sf_dir):
    """Parts dealt to detector models, with the models' constants attached."""
    rows = [(i, n, *v) for i, (n, v) in enumerate(G.MODELS.items())]
    models = spark.createDataFrame(rows, "i long, model string, column_size double, row_size double, n_columns int, n_rows int, cell_columns int, cell_rows int")
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").groupBy((F.col("p_partkey") % len(rows)).alias("i")).agg(F.count("*").alias("n_parts"))
    return parts.join(F.broadcast(models), "i").drop("i").select("model", "column_size", "row_size", "n_columns", "n_rows", "cell_columns", "cell_rows", "n_parts")


@query("geometry_dim", sql("SELECT dut, name, column_size, row_size, n_columns, n_rows, tx, ty, tz, x_lo, x_hi, CAST(count(*) AS BIGINT) AS n_hits FROM geo JOIN hits USING (dut) GROUP BY ALL"))
def geometry_dim(spark, sf_dir):
    counts = views.hits(spark, sf_dir).groupBy("dut").agg(F.count("*").alias("n_hits"))
    return G.with_geometry(counts, G.geometry(spark, G.HIT_PLANES)).select("dut", "name", "column_size", "row_size", "n_columns", "n_rows", "tx", "ty", "tz", "x_lo", "x_hi", "n_hits")


@query("geometry_join", sql("SELECT event_number, dut, ordinal, name, column_size, tz FROM hits JOIN geo USING (dut)"))
def geometry_join(spark, sf_dir):
    return G.with_geometry(views.hits(spark, sf_dir), G.geometry(spark, G.HIT_PLANES)).select(*KEYS, "name", "column_size", "tz")


#: First pixel of the diamonds of the queries, and their planes.
SENSOR_AT = (3, 2)
DIAMONDS = [G.Plane(i, name).of_model(name) for i, name in enumerate(("Diamond3D", "DiamondPseudo3D"))]


def _diamond_sql(model: str) -> str:
    """x and y of pixel (c, r) of a diamond; i and j count from the sensor's first pixel."""
    width, square, height = G.SENSOR
    defects = " OR ".join(f"i BETWEEN {a} AND {b - 1} AND j BETWEEN {c} AND {d - 1}" for a, b, c, d in G.DEFECTS[model]) or "false"
    on = f"i BETWEEN 0 AND {width - 1} AND NOT ({defects})"
    parts = [[], []]
    for axis in (0, 1):
        for (i, j), v in G.SQUARE_CELLS[model].items():
            parts[axis].append(f"WHEN {on} AND j BETWEEN 0 AND {square - 1} AND i % 4 = {i} AND j % 2 = {j} THEN CAST({v[axis]!r} AS DOUBLE)")
        for k, v in enumerate(G.HEXAGONS):
            which = "" if k < 3 else " AND i % 4 IN (1, 2)"
            sign = "" if axis else "CASE WHEN i % 2 = 0 THEN 1 ELSE -1 END * "
            parts[axis].append(f"WHEN {on} AND j BETWEEN {square} AND {height - 1} AND (j - {square}) % 4 = {k}{which} THEN {sign}CAST({v[axis]!r} AS DOUBLE)")
    case = lambda axis: "CASE " + " ".join(parts[axis]) + " ELSE 0e0 END"
    return f"(c - 405e-1) * 250 + CASE WHEN c % 2 = 1 THEN -100 ELSE 100 END + {case(0)} AS x, (r - 1685e-1) * 50 + {case(1)} AS y"


@query("pixel_position_lookup", sql(f"""
    WITH p AS (SELECT event_number, dut AS plane, ordinal, "column" AS c, ("row" - 1) * 4 + frame % 4 + 1 AS r, "column" - {SENSOR_AT[0]} AS i, ("row" - 1) * 4 + frame % 4 + 1 - {SENSOR_AT[1]} AS j FROM hits)
    SELECT event_number, plane, ordinal, model, round(x, 6) + 0e0 AS x, round(y, 6) + 0e0 AS y FROM (SELECT *, 'Diamond3D' AS model, {_diamond_sql("Diamond3D")} FROM p
      UNION ALL SELECT *, 'DiamondPseudo3D', {_diamond_sql("DiamondPseudo3D")} FROM p) AS t"""))
def pixel_position_lookup(spark, sf_dir):
    """Centres of the pixels of two diamond sensors, looked up in a table of all pixels of the matrix."""
    pixels = G.pixel_positions(spark, DIAMONDS, {p.dut: (p.name, SENSOR_AT) for p in DIAMONDS}).withColumn("model", F.when(F.col("dut") == 0, DIAMONDS[0].name).otherwise(DIAMONDS[1].name))
    rows = views.hits(spark, sf_dir).select("event_number", F.col("dut").alias("plane"), "ordinal", "column", ((F.col("row") - 1) * 4 + F.col("frame") % 4 + 1).alias("row"))
    return rows.join(F.broadcast(pixels), ["column", "row"]).select("event_number", "plane", "ordinal", "model", r6(F.col("px")).alias("x"), r6(F.col("py")).alias("y"))


@query("track_angles", sql("SELECT event_number, ordinal, dut, round(acos(abs(sz) / sqrt(sx * sx + sy * sy + sz * sz)), 6) + 0e0 AS total, round(atan2(sy, abs(sz)), 9) + 0e0 AS alpha, round(atan2(-sx, abs(sz)), 9) + 0e0 AS beta FROM tracks"))
def track_angles(spark, sf_dir):
    t, a, b = G.angles(F.col("sx"), F.col("sy"), F.col("sz"))
    return views.tracks(spark, sf_dir).select("event_number", "ordinal", "dut", r6(t).alias("total"), (F.round(a, 9) + 0.0).alias("alpha"), (F.round(b, 9) + 0.0).alias("beta"))


@query("rotation_matrices", sql("""
    SELECT DISTINCT l_linenumber AS k, round(cos(b) * cos(c), 9) + 0e0 AS r11, round(sin(a) * sin(b) * cos(c) - cos(a) * sin(c), 9) + 0e0 AS r12, round(cos(a) * sin(b) * cos(c) + sin(a) * sin(c), 9) + 0e0 AS r13,
      round(-sin(b), 9) + 0e0 AS r31, round(sin(a) * cos(b), 9) + 0e0 AS r32, round(cos(a) * cos(b), 9) + 0e0 AS r33
    FROM (SELECT l_linenumber, l_linenumber * 3e-1 AS a, l_linenumber * 2e-1 AS b, l_linenumber * -1e-1 AS c FROM lineitem) AS t"""))
def rotation_matrices(spark, sf_dir):
    k = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_linenumber").alias("k")).distinct()
    (ca, sa), (cb, sb), (cg, sg) = ((F.cos(v), F.sin(v)) for v in (F.col("k") * 0.3, F.col("k") * 0.2, F.col("k") * -0.1))
    m = {"r11": cb * cg, "r12": sa * sb * cg - ca * sg, "r13": ca * sb * cg + sa * sg, "r31": -sb, "r32": sa * cb, "r33": ca * cb}
    return k.select("k", *((F.round(v, 9) + 0.0).alias(n) for n, v in m.items()))


@query("euler_angles", sql("SELECT dut, round(alpha, 9) + 0e0 AS alpha, round(beta, 9) + 0e0 AS beta, round(gamma, 9) + 0e0 AS gamma, count(*) AS n FROM geo JOIN hits USING (dut) GROUP BY ALL"))
def euler_angles(spark, sf_dir):
    """Angles recovered from the matrices of the planes that have hits."""
    geo = G.geometry(spark, G.HIT_PLANES)
    a, b, c = X.euler_angles({n: F.col(n) for n in geo.columns})
    found = geo.select("dut", (F.round(a, 9) + 0.0).alias("alpha"), (F.round(b, 9) + 0.0).alias("beta"), (F.round(c, 9) + 0.0).alias("gamma"))
    return views.hits(spark, sf_dir).groupBy("dut").agg(F.count("*").alias("n")).join(F.broadcast(found), "dut")


@query("apply_matrix", sql("SELECT event_number, dut, ordinal, round(2 * lx - ly + 1, 6) AS x, round(lx + 3 * ly - 2, 6) AS y, round(-lx + 5e-1 * ly, 6) + 0e0 AS z FROM local_"))
def apply_matrix(spark, sf_dir):
    x, y, z = G.fixed_rotation([[2.0, -1.0, 0.0], [1.0, 3.0, 0.0], [-1.0, 0.5, 0.0]], F.col("lx"), F.col("ly"), F.lit(0.0))
    return local_hits(spark, sf_dir).select(*KEYS, r6(x + 1).alias("x"), r6(y - 2).alias("y"), r6(z).alias("z"))


@query("plane_normal", sql("SELECT event_number, dut, ordinal, round(-ly * 2e0, 6) + 0e0 AS nx, round(lx * 2e0, 6) + 0e0 AS ny, round(lx * 1e0 - ly * 3e0, 6) + 0e0 AS nz FROM local_"))
def plane_normal(spark, sf_dir):
    """Normal of the plane spanned by (3, 1, 2) and the position (lx, ly, 0), as the skew matrix of the first applied to the second."""
    v = (F.lit(3.0), F.lit(1.0), F.lit(2.0))
    w = (F.col("lx"), F.col("ly"), F.lit(0.0))
    s = X.skew(v)
    nx, ny, nz = (s[i][0] * w[0] + s[i][1] * w[1] + s[i][2] * w[2] for i in range(3))
    return local_hits(spark, sf_dir).select(*KEYS, r6(nx).alias("nx"), r6(ny).alias("ny"), r6(-nz).alias("nz"))


@query("skew", sql("SELECT event_number, dut, ordinal, round(-lx, 6) + 0e0 AS m12, round(ly, 6) + 0e0 AS m02, round(lx * ly, 6) + 0e0 AS m_ly FROM local_"))
def skew(spark, sf_dir):
    """Two entries of the skew matrix of (lx, ly, 0), and the third component of its product with (0, ly, 1)."""
    m = X.skew((F.col("lx"), F.col("ly"), F.lit(0.0)))
    return local_hits(spark, sf_dir).select(*KEYS, r6(m[1][2]).alias("m12"), r6(m[0][2]).alias("m02"), r6(m[2][1] * F.col("ly")).alias("m_ly"))


@query("spherical", sql("""
    SELECT event_number, dut, ordinal, round(CASE WHEN atan2(gy, gx) < 0 THEN atan2(gy, gx) + 2 * pi() ELSE atan2(gy, gx) END, 6) + 0e0 AS phi,
      round(acos(gz / sqrt(gx * gx + gy * gy + gz * gz)), 6) + 0e0 AS theta, round(sqrt(gx * gx + gy * gy + gz * gz), 6) AS r FROM global_"""))
def spherical(spark, sf_dir):
    p, t, r = X.spherical(F.col("gx"), F.col("gy"), F.col("gz"))
    return global_hits(spark, sf_dir).select(*KEYS, r6(p).alias("phi"), r6(t).alias("theta"), r6(r).alias("r"))


_M = " | ".join(f"((((({v}) >> {k}) & 1)) << {2 * k + o})" for k in range(4) for v, o in (('CAST("column" - 1 AS BIGINT)', 0), ('CAST("row" - 1 AS BIGINT)', 1)))


@query("morton", sql(f'SELECT event_number, dut, ordinal, {_M} AS code, "column" - 1 AS x, "row" - 1 AS y FROM hits'))
def morton(spark, sf_dir):
    """Interleave the pixel indices and take them apart again."""
    rows = views.hits(spark, sf_dir).withColumn("code", X.morton(F.col("column") - 1, F.col("row") - 1, 4))
    x, y = X.unmorton(F.col("code"), 4)
    return rows.select(*KEYS, "code", x.cast("int").alias("x"), y.cast("int").alias("y"))


@query("shape_to_pixels", sql("SELECT event_number, ordinal, dut, k AS pixel FROM tracks, (SELECT CAST(unnest(range(0, 63)) AS INT) AS k) WHERE (cluster_shape >> k) & 1 = 1"))
def shape_to_pixels(spark, sf_dir):
    return views.tracks(spark, sf_dir).select("event_number", "ordinal", "dut", F.explode(X.shape_pixels(F.col("cluster_shape"))).alias("pixel"))


@query("popcount", sql("SELECT event_number, ordinal, dut, CAST(bit_count(cluster_shape) AS INT) AS n FROM tracks"))
def popcount(spark, sf_dir):
    return views.tracks(spark, sf_dir).select("event_number", "ordinal", "dut", F.bit_count("cluster_shape").alias("n"))


@query("polygon_area", sql("SELECT event_number, dut, ordinal, round(abs(column_size * \"column\" * row_size * \"row\") / 2, 6) AS area FROM local_"))
def polygon_area(spark, sf_dir):
    """Area of the triangle from the matrix corner over a hit's column to its row."""
    w, h = F.col("column_size") * F.col("column"), F.col("row_size") * F.col("row")
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return local_hits(spark, sf_dir).select(*KEYS, F.round(X.polygon_area(F.array(p(F.lit(0.0), F.lit(0.0)), p(w, F.lit(0.0)), p(w, h))), 6).alias("area"))


@query("chi2_pvalue", sql("SELECT event_number, ordinal, dut, round(exp(-chi2 / 2) * (1 + chi2 / 2 + (chi2 / 2) * (chi2 / 2) / 2 + (chi2 / 2) * (chi2 / 2) * (chi2 / 2) / 6), 9) + 0e0 AS p FROM tracks"))
def chi2_pvalue(spark, sf_dir):
    """Six hits leave eight degrees of freedom."""
    return views.tracks(spark, sf_dir).select("event_number", "ordinal", "dut", (F.round(X.chi2_pvalue(F.col("chi2"), F.lit(8)), 9) + 0.0).alias("p"))


MOMENTUM, BETA = math.sqrt(5000.0**2 - 0.511**2), math.sqrt(5000.0**2 - 0.511**2) / 5000.0


@query("scatter_angle", sql(f"""
    SELECT event_number, ordinal, dut, round(136e-1 / (CAST({MOMENTUM!r} AS DOUBLE) * CAST({BETA!r} AS DOUBLE)) * sqrt(x) * (1 + 38e-3 * ln(x)), 12) AS theta
    FROM (SELECT event_number, ordinal, dut, material_budget * sqrt(1 + sx * sx + sy * sy) AS x FROM tracks JOIN tgeo USING (dut)) AS t"""))
def scatter_angle(spark, sf_dir):
    """Material along the inclined track."""
    x = F.col("material_budget") * F.sqrt(1 + F.col("sx") * F.col("sx") + F.col("sy") * F.col("sy"))
    return plane_tracks(spark, sf_dir).select("event_number", "ordinal", "dut", F.round(X.scatter_angle(x, F.lit(MOMENTUM), F.lit(BETA)), 12).alias("theta"))
