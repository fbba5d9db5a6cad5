"""Queries on clusters, occupancy and noise."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from hitloom.operators import clusters as C
from hitloom.operators import histograms as H
from hitloom.operators import position_clusters as P
from hitloom.operators import results as R
from hitloom.functions.expressions import r6
from hitloom.plans.positions import local_hits, sql as _sql
from hitloom.plans.registry import query
from hitloom.sources import views

LINKED = """SELECT a.event_number, a.dut, a.ordinal AS a, b.ordinal AS b FROM hits AS a JOIN hits AS b ON a.event_number = b.event_number AND a.dut = b.dut
  AND a.ordinal <> b.ordinal AND abs(a."column" - b."column") <= 3 AND abs(a."row" - b."row") <= 3"""
REACH = """SELECT event_number, dut, ordinal AS a, ordinal AS b FROM hits UNION SELECT reach.event_number, reach.dut, reach.a, linked.b FROM reach JOIN linked
  ON reach.event_number = linked.event_number AND reach.dut = linked.dut AND reach.b = linked.a"""
CLUSTER_HITS = """SELECT hits.*, CAST(dense_rank() OVER (PARTITION BY hits.event_number, hits.dut ORDER BY m) - 1 AS INT) AS cluster_id, m
  FROM hits JOIN (SELECT event_number, dut, a, min(b) AS m FROM reach GROUP BY ALL) AS l ON hits.event_number = l.event_number AND hits.dut = l.dut AND hits.ordinal = l.a"""


def sql(text: str) -> str:
    from hitloom.sources.views import with_views

    out = with_views(text, linked=LINKED, reach=REACH, cluster_hits=CLUSTER_HITS)
    return out.replace("WITH ", "WITH RECURSIVE ", 1)


def clustered(spark, sf_dir):
    return C.cluster_ids(views.hits(spark, sf_dir), 3, 3)


def clustered_by_event(spark, sf_dir):
    """The same dealt by event in tasks of bounded rows: the steps by cluster need no other shuffle, and their memory does not grow with the table."""
    return views.by_event(clustered(spark, sf_dir), views.count(spark, sf_dir))


def built(spark, sf_dir):
    return C.build_clusters(clustered_by_event(spark, sf_dir))


KEY = ["event_number", "dut", "cluster_id"]


@query("cluster_ids", sql("SELECT event_number, dut, ordinal, cluster_id, CAST(max(cluster_id) OVER (PARTITION BY event_number, dut) + 1 AS INT) AS n_cluster FROM cluster_hits"))
def cluster_ids(spark, sf_dir):
    return clustered(spark, sf_dir).select("event_number", "dut", "ordinal", "cluster_id", "n_cluster")


@query("cluster_build", sql("""
    SELECT event_number, dut, cluster_id, count(*) AS n_hits, sum(charge) AS charge, arg_max("column", charge * 1000 - ordinal) AS seed_column, arg_max("row", charge * 1000 - ordinal) AS seed_row,
      round(avg("column"), 6) AS mean_column, round(avg("row"), 6) AS mean_row, min(frame) AS frame, max("column") - min("column") AS extent_column, max(charge) AS max_charge FROM cluster_hits GROUP BY ALL"""))
def cluster_build(spark, sf_dir):
    """With the largest charge as an extra aggregate."""
    c = C.build_clusters(clustered_by_event(spark, sf_dir), extra=[F.max("charge").alias("max_charge")])
    return c.select(*KEY, "n_hits", "charge", "seed_column", "seed_row", F.round("mean_column", 6).alias("mean_column"), F.round("mean_row", 6).alias("mean_row"), "frame", "extent_column", "max_charge")


_BIT = " + ".join(f"((({v} >> {k}) & 1) << {2 * k + o})" for k in range(3) for v, o in (('(c - c0)', 0), ('(r - r0)', 1)))


_SHAPES = f"""
    WITH box AS (SELECT event_number, dut, cluster_id, "column" AS c, "row" AS r, min("column") OVER k AS c0, min("row") OVER k AS r0, max("column") OVER k AS c1, max("row") OVER k AS r1,
        first("column") OVER (k ORDER BY ordinal) AS cf, first("row") OVER (k ORDER BY ordinal) AS rf FROM cluster_hits WINDOW k AS (PARTITION BY event_number, dut, cluster_id)),
      bits AS (SELECT *, CASE WHEN abs(c - cf) < 8 AND abs(r - rf) < 8 AND c - c0 < 8 AND r - r0 < 8 THEN CAST({_BIT} AS INT) END AS bit FROM box)
    SELECT event_number, dut, cluster_id, CAST(CASE WHEN max(c1 - c0) >= 8 OR max(r1 - r0) >= 8 OR coalesce(max(bit) = 63, false) THEN -1 ELSE bit_or(CAST(1 AS BIGINT) << least(bit, 62)) END AS BIGINT) AS cluster_shape
    FROM bits GROUP BY ALL"""


@query("cluster_shape", sql(_SHAPES))
def cluster_shape(spark, sf_dir):
    return built(spark, sf_dir).select(*KEY, "cluster_shape")


_PLACED = "SELECT event_number, dut, ordinal, x, y, charge, frame FROM tracks WHERE x IS NOT NULL"
_PLACED_LINKS = """SELECT a.event_number, a.dut, a.ordinal AS a, b.ordinal AS b FROM placed AS a JOIN placed AS b ON a.event_number = b.event_number AND a.dut = b.dut
  AND a.ordinal <> b.ordinal AND abs(a.x - b.x) <= 15e2 AND abs(a.y - b.y) <= 10e2"""
_POSITIONS = views.with_views("""
    SELECT event_number, dut, cluster_id, count(*) AS n_hits, sum(charge) AS charge, round(arg_max(x, charge * 1000 - ordinal), 6) + 0e0 AS seed_x, round(arg_max(y, charge * 1000 - ordinal), 6) + 0e0 AS seed_y, round(avg(x), 6) + 0e0 AS mean_x, round(avg(y), 6) + 0e0 AS mean_y,
      min(frame) AS frame, round(max(x) - min(x), 6) + 0e0 AS err_x, round(max(y) - min(y), 6) + 0e0 AS err_y, max(n_cluster) AS n_cluster, CAST(-1 AS BIGINT) AS cluster_shape
    FROM (SELECT *, CAST(max(cluster_id) OVER (PARTITION BY event_number, dut) + 1 AS INT) AS n_cluster FROM placed_hits) AS h GROUP BY event_number, dut, cluster_id""",
    placed=_PLACED, placed_links=_PLACED_LINKS, placed_reach=REACH.replace("FROM hits", "FROM placed").replace("reach", "placed_reach").replace("linked", "placed_links"),
    placed_hits="""SELECT placed.*, CAST(dense_rank() OVER (PARTITION BY placed.event_number, placed.dut ORDER BY m) - 1 AS INT) AS cluster_id
  FROM placed JOIN (SELECT event_number, dut, a, min(b) AS m FROM placed_reach GROUP BY ALL) AS l ON placed.event_number = l.event_number AND placed.dut = l.dut AND placed.ordinal = l.a""").replace("WITH ", "WITH RECURSIVE ", 1)  # fmt: skip


@query("position_clusters", _POSITIONS)
def position_clusters(spark, sf_dir):
    """Clusters of the tracks' hits by their positions, within 1500 and 1000 micrometres."""
    c = P.position_clusters(views.tracks(spark, sf_dir).select("event_number", "dut", "ordinal", "x", "y", "charge", "frame"), 1500.0, 1000.0)
    return c.select(*KEY, "n_hits", "charge", *(r6(F.col(k)).alias(k) for k in ("seed_x", "seed_y", "mean_x", "mean_y")), "frame", *(r6(F.col(k)).alias(k) for k in ("err_x", "err_y")), "n_cluster", "cluster_shape")


@query("n_cluster", sql("SELECT event_number, dut, count(DISTINCT cluster_id) AS n_cluster FROM cluster_hits GROUP BY ALL"))
def n_cluster(spark, sf_dir):
    return clustered(spark, sf_dir).groupBy("event_number", "dut").agg(F.max("n_cluster").cast("long").alias("n_cluster"))


@query("cluster_size_hist", sql("SELECT dut, n_hits, count(*) AS n FROM (SELECT event_number, dut, cluster_id, count(*) AS n_hits FROM cluster_hits GROUP BY ALL) AS c GROUP BY ALL"))
def cluster_size_hist(spark, sf_dir):
    return built(spark, sf_dir).groupBy("dut", "n_hits").agg(F.count("*").alias("n"))


@query("cluster_shape_hist", _sql("SELECT dut, cluster_shape, count(*) AS n FROM tracks WHERE cluster_shape BETWEEN 0 AND 65534 GROUP BY ALL"))
def cluster_shape_hist(spark, sf_dir):
    return views.tracks(spark, sf_dir).where(F.col("cluster_shape").between(0, 65534)).groupBy("dut", "cluster_shape").agg(F.count("*").alias("n"))


NAMED = (1, 3, 5, 6, 9, 13, 14, 7, 11, 19, 261, 15, 95, 783, 4959)  # fixed values: cluster shapes with a name


@query("cluster_shape_summary", sql(f"WITH shapes AS ({_SHAPES}) SELECT dut, CASE WHEN cluster_shape IN (1, 3, 5, 6, 9, 13, 14, 7, 11, 19, 261, 15, 95, 783, 4959) THEN cluster_shape ELSE -1 END AS shape, count(*) AS n FROM shapes GROUP BY ALL"))
def cluster_shape_summary(spark, sf_dir):
    """Named shapes and one row for all others, over the clusters of the hits."""
    shape = F.when(F.col("cluster_shape").isin(*NAMED), F.col("cluster_shape")).otherwise(F.lit(-1).cast("long"))
    return built(spark, sf_dir).groupBy("dut", shape.alias("shape")).agg(F.count("*").alias("n"))


@query("cluster_errors", _sql("SELECT event_number, dut, ordinal, round(column_size / sqrt(12e0), 6) AS err_x, round(row_size / sqrt(12e0), 6) AS err_y FROM local_"))
def cluster_errors(spark, sf_dir):
    return local_hits(spark, sf_dir).select("event_number", "dut", "ordinal", F.round(F.col("column_size") / F.sqrt(F.lit(12.0)), 6).alias("err_x"), F.round(F.col("row_size") / F.sqrt(F.lit(12.0)), 6).alias("err_y"))


def occupancy_of(spark, sf_dir):
    return views.hits(spark, sf_dir).groupBy("dut", F.col("column").alias("col"), F.col("row").alias("row_")).agg(F.count("*").alias("n"))


OCC = 'SELECT dut, "column" AS col, "row" AS row_, count(*) AS n FROM hits GROUP BY ALL'


@query("occupancy", _sql(OCC))
def occupancy(spark, sf_dir):
    return occupancy_of(spark, sf_dir)


@query("occupancy_projection", _sql(f"""
    WITH occ AS ({OCC}), sums AS (SELECT dut, 'column' AS axis, col AS bin, CAST(sum(n) AS BIGINT) AS n, CAST(sum(CASE WHEN row_ <= 12 THEN n ELSE 0 END) AS BIGINT) AS n_unmasked FROM occ GROUP BY ALL
      UNION ALL SELECT dut, 'row', row_, CAST(sum(n) AS BIGINT), CAST(sum(CASE WHEN row_ <= 12 THEN n ELSE 0 END) AS BIGINT) FROM occ GROUP BY ALL)
    SELECT *, round(quantile_cont(n, 0.99) OVER (PARTITION BY dut, axis), 6) AS scale, round(quantile_cont(n_unmasked, 0.99) OVER (PARTITION BY dut, axis), 6) AS scale_unmasked FROM sums"""))
def occupancy_projection(spark, sf_dir):
    """Sums over columns and rows, with and without masked pixels (rows above 12), and the 99 % scale of each projection."""
    occ = occupancy_of(spark, sf_dir)
    axes = F.explode(F.array(F.struct(F.lit("column").alias("axis"), F.col("col").alias("bin")), F.struct(F.lit("row").alias("axis"), F.col("row_").alias("bin"))))
    rows = occ.withColumn("a", axes).select("dut", "a.axis", "a.bin", "n", (F.col("row_") <= 12).alias("ok"))
    sums = rows.groupBy("dut", "axis", "bin").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("ok"), F.col("n")).otherwise(0)).alias("n_unmasked"))
    w = Window.partitionBy("dut", "axis")  # as many rows as the matrix has columns or rows
    return sums.withColumns({f"scale{k}": F.round(F.percentile(f"n{k}", F.lit(0.99)).over(w), 6) for k in ("", "_unmasked")})


_MED = f"""WITH occ AS ({OCC}), med AS (SELECT a.dut, a.col, a.row_, a.n, coalesce(list_sort(list(b.n) || [0 FOR x IN range(0, 9 - CAST(count(*) AS INT))])[5], 0) AS expected
      FROM occ AS a JOIN occ AS b ON a.dut = b.dut AND abs(a.col - b.col) <= 1 AND abs(a.row_ - b.row_) <= 1 GROUP BY ALL)"""


@query("median_filter", _sql(f"{_MED} SELECT dut, col, row_, CAST(expected AS BIGINT) AS expected FROM med"))
def median_filter(spark, sf_dir):
    return H.median_filter(occupancy_of(spark, sf_dir), ["dut"], 3)


@query("noise_std", _sql(f"{_MED} SELECT dut, round(stddev_pop((n - expected) / sqrt(n)), 6) AS sigma FROM med GROUP BY dut"))
def noise_std(spark, sf_dir):
    occ = occupancy_of(spark, sf_dir)
    known = occ.join(H.median_filter(occ, ["dut"], 3), ["dut", "col", "row_"])
    return known.groupBy("dut").agg(F.round(F.stddev_pop((F.col("n") - F.col("expected")) / F.sqrt("n")), 6).alias("sigma"))


def _noise_sql(rounds: int) -> str:
    """The rounds one after another: a plane that finds no new pixel stands still, so further rounds change nothing."""
    steps = [f"r0 AS MATERIALIZED (SELECT dut, col, row_, n, false AS masked FROM ({OCC}) AS o)"]
    for k in range(rounds):
        steps += [
            f"""e{k} AS MATERIALIZED (SELECT a.dut, a.col, a.row_, a.n, a.masked, coalesce(list_sort(list(b.n) || [0 FOR x IN range(0, 9 - CAST(count(*) AS INT))])[5], 0) AS e
              FROM r{k} AS a JOIN r{k} AS b ON a.dut = b.dut AND abs(a.col - b.col) <= 1 AND abs(a.row_ - b.row_) <= 1 GROUP BY ALL)""",
            f"s{k} AS (SELECT dut, stddev_pop(CASE WHEN n <> 0 THEN (n - e) / sqrt(n) END) AS sigma FROM e{k} GROUP BY dut)",
            f"f{k} AS MATERIALIZED (SELECT e{k}.*, coalesce(n <> 0 AND (n - e) / sqrt(greatest(n, 1)) > 2 * sigma, false) AS found FROM e{k} JOIN s{k} USING (dut))",
            f"v{k} AS (SELECT dut, bool_or(found AND NOT masked) AS live FROM f{k} GROUP BY dut)",
            f"r{k + 1} AS MATERIALIZED (SELECT dut, col, row_, CASE WHEN live AND (masked OR found) THEN e ELSE n END AS n, masked OR live AND found AS masked FROM f{k} JOIN v{k} USING (dut))",
        ]
    return f"WITH {', '.join(steps)} SELECT dut, col, row_ FROM r{rounds} WHERE masked"


@query("noisy_pixels", _sql(_noise_sql(40)))
def noisy_pixels(spark, sf_dir):
    """Pixels two sigmas above their neighbourhood, in rounds until no plane finds a new one (forty in the SQL; 16 rounds reach the end at sf0.01, the further ones change nothing)."""
    return H.noise_mask(occupancy_of(spark, sf_dir), ["dut"], 2.0, 3).where("masked").select("dut", "col", "row_")


@query("unique_neighbours", _sql(f"WITH occ AS ({OCC}) SELECT a.dut, a.col, a.row_, count(DISTINCT b.n) AS n_unique FROM occ AS a JOIN occ AS b ON a.dut = b.dut AND abs(a.col - b.col) <= 1 AND abs(a.row_ - b.row_) <= 1 GROUP BY ALL"))
def unique_neighbours(spark, sf_dir):
    return H.stencil(occupancy_of(spark, sf_dir), ["dut"], 3).groupBy("dut", "col", "row_").agg(F.countDistinct("n2").alias("n_unique"))


@query("nearest_fill", _sql(f"""WITH occ AS ({OCC} HAVING "column" % 9 = 0 AND "row" % 5 = 0), want AS (SELECT d AS dut, c AS col, r AS row_ FROM (SELECT unnest([0, 1, 2]) AS d), (SELECT CAST(unnest(range(1, 17)) AS INT) AS c), (SELECT CAST(unnest(range(1, 17)) AS INT) AS r))
    SELECT w.dut, w.col, w.row_, (SELECT o.n FROM occ AS o WHERE o.dut = w.dut ORDER BY (o.col - w.col) ** 2 + (o.row_ - w.row_) ** 2, o.col, o.row_ LIMIT 1) AS n FROM want AS w"""))
def nearest_fill(spark, sf_dir):
    """A few pixels known, the others filled from the nearest, however far."""
    occ = occupancy_of(spark, sf_dir).where("col % 9 = 0 AND row_ % 5 = 0")
    grid = spark.range(3 * 256).select((F.col("id") % 3).cast("int").alias("dut"), (F.floor(F.col("id") / 3) % 16 + 1).cast("int").alias("col"), (F.floor(F.col("id") / 48) + 1).cast("int").alias("row_"))
    return H.nearest_fill(occ, grid, ["dut"])


@query("hit_pattern", sql("""
    WITH places AS (SELECT event_number, dut, cluster_id, CAST(floor(avg("column") / 5e-1) AS INT) AS bx, CAST(floor(avg("row") / 5e-1) AS INT) AS by_ FROM cluster_hits GROUP BY ALL),
      counts AS (SELECT p.dut, bx, by_, h."column" - CAST(floor((bx + 5e-1) * 5e-1 + 5e-1) AS INT) AS d_column, h."row" - CAST(floor((by_ + 5e-1) * 5e-1 + 5e-1) AS INT) AS d_row, count(*) AS n
        FROM places AS p JOIN cluster_hits AS h ON p.event_number = h.event_number AND p.dut = h.dut AND p.cluster_id = h.cluster_id GROUP BY ALL),
      near AS (SELECT * FROM counts WHERE abs(d_column) <= 5 AND abs(d_row) <= 5)
    SELECT *, row_number() OVER (PARTITION BY dut, bx, by_ ORDER BY n DESC, d_column, d_row) = 1 AS mode FROM near"""))
def hit_pattern(spark, sf_dir):
    """For each bin of half a pixel in which a cluster lies: its hits' pixels relative to the pixel under the bin's centre, in a window of 11 x 11, and which is the most frequent."""
    rows = clustered(spark, sf_dir)
    at = {n: F.floor(F.col(f"mean_{c}") / 0.5).cast("int").alias(n) for n, c in (("bx", "column"), ("by_", "row"))}
    return R.hit_pattern(rows, C.build_clusters(rows).select(*KEY, *at.values()), KEY, 0.5, 0.0, 5)
