"""Detector tables derived from the order tables by integer arithmetic.

The texts are SQL that Spark and DuckDB read alike; both engines give the same
rows. ``hits`` has three planes of 16 x 16 pixels, ``tracks`` six planes with a
straight track per row, its crossing point with each plane and the hit there
(null where the plane has none).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ORDER = "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate"

HITS = f"""
SELECT CAST(l_orderkey AS BIGINT) AS event_number, CAST((l_linenumber - 1) % 3 AS INT) AS dut,
  CAST(row_number() OVER (PARTITION BY l_orderkey, (l_linenumber - 1) % 3 ORDER BY {ORDER}) AS INT) AS ordinal,
  CAST(l_linenumber AS INT) AS frame, CAST(l_partkey % 16 + 1 AS INT) AS col, CAST(l_suppkey % 16 + 1 AS INT) AS row_,
  CAST(l_quantity AS DOUBLE) AS charge
FROM lineitem"""

TRACKS = f"""
SELECT event_number, ordinal, dut,
  CASE WHEN (p + 3 * dut) % 11 <> 0 THEN (s % 100 - 50) * 1e2 + (l - 4) * 1e-5 * z + ((p * (dut + 7)) % 41 - 20) * 25e-2 END AS x,
  CASE WHEN (p + 3 * dut) % 11 <> 0 THEN (p % 50 - 25) * 1e2 + (q - 25) * 1e-6 * z + ((p * (dut + 13)) % 37 - 18) * 25e-2 END AS y,
  z, (s % 100 - 50) * 1e2 + (l - 4) * 1e-5 * z AS ix, (p % 50 - 25) * 1e2 + (q - 25) * 1e-6 * z AS iy,
  (l - 4) * 1e-5 AS sx, (q - 25) * 1e-6 AS sy, 1e0 AS sz,
  CAST((p * 31 + s * 7) % 400 AS DOUBLE) / 10 AS chi2, CAST((p * 31 + s * 7) % 400 AS DOUBLE) / 80 AS chi_red,
  CAST(q AS DOUBLE) AS charge, CAST(l AS INT) AS frame, CAST((p + dut) % 4 + 1 AS INT) AS n_hits,
  CAST(CASE (p + s + dut) % 8 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 5 WHEN 3 THEN 7 WHEN 4 THEN 11 WHEN 5 THEN 13 WHEN 6 THEN 14 ELSE 15 END AS BIGINT) AS cluster_shape
FROM (SELECT base.*, CAST(d AS INT) AS dut, CAST(d * 150000 AS DOUBLE) AS z
  FROM (SELECT CAST(l_orderkey AS BIGINT) AS event_number, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {ORDER}) AS INT) AS ordinal,
      CAST(l_partkey AS BIGINT) AS p, CAST(l_suppkey AS BIGINT) AS s, CAST(l_linenumber AS INT) AS l, CAST(l_quantity AS DOUBLE) AS q FROM lineitem) AS base
  <planes>) AS crossed"""


#: The six planes of a track: a list of constants for DuckDB, an array that is unfolded for Spark.
PLANES = "CROSS JOIN (SELECT 0 AS d UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5) AS planes"
TRACKS = TRACKS.replace("<planes>", PLANES)


#: Rows of ``lineitem`` that a task gets at most, about; their number, not that of the partitions, bounds its memory.
TASK_ROWS = 250_000


def _view(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Rows are dealt by event, the key of all later steps: the key keeps its name up to the end, so that Spark knows it in them."""
    text = text.replace(PLANES, "LATERAL VIEW explode(sequence(0, 5)) planes AS d").replace("CAST(l_orderkey AS BIGINT) AS event_number", "l_orderkey").replace("event_number", "l_orderkey")
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    rows = by_event(rows.withColumn("l_orderkey", rows["l_orderkey"].cast("long")), rows.count(), "l_orderkey")
    return spark.sql(text.replace("FROM lineitem", "FROM {lineitem}"), lineitem=rows).withColumnRenamed("l_orderkey", "event_number")


def by_event(df: DataFrame, rows: int, key: str = "event_number") -> DataFrame:
    """``df`` of ``rows`` rows dealt by event, in more tasks than shuffle partitions where these would get more than ``TASK_ROWS`` rows."""
    tasks = -(-rows // TASK_ROWS)
    return df.repartition(tasks, key) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df.repartition(key)


def count(spark: SparkSession, sf_dir: str) -> int:
    """Rows of ``hits``."""
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_number, dut, ordinal, frame, column, row, charge."""
    return _view(spark, sf_dir, HITS).withColumnsRenamed({"col": "column", "row_": "row"})


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits (x, y) and crossing points (ix, iy) of straight tracks in the local frame of each plane."""
    return _view(spark, sf_dir, TRACKS)


def with_views(sql: str, **more: str) -> str:
    """DuckDB SQL over those of the views ``hits`` and ``tracks`` and of ``more`` that it names."""
    ctes = {"hits": HITS.replace(" AS col,", ' AS "column",').replace(" AS row_,", ' AS "row",'), "tracks": TRACKS} | more
    used, seen = [], sql
    for k in reversed(ctes):  # a view is named by the query or by a later view
        if k in seen:
            used.insert(0, k)
            seen += ctes[k]
    body = sql.strip()
    head = ",\n".join(f"{k} AS ({ctes[k].strip()})" for k in used)
    if body.upper().startswith("WITH "):
        return f"WITH {head},\n{body[5:]}" if used else body
    return f"WITH {head}\n{body}" if used else body
