"""Running summaries of a hit stream in event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitloom.runtime import Scratch

LATENESS = "2 hours"


def hit_stream(events: DataFrame) -> DataFrame:
    """The event stream as hits: plane, pixel, charge and whether the hit counts as a pass."""
    # event times without a zone are read as UTC, whatever the session's zone
    since = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))")
    return events.select(
        F.timestamp_micros(since).alias("ts"), (F.col("user_id") % 3).cast("int").alias("dut"), (F.col("event_id") % 16 + 1).cast("int").alias("col"), (F.col("user_id") % 16 + 1).cast("int").alias("row_"),
        F.col("value").alias("charge"), (F.col("event_type") != "error").alias("passed"),
    )


def running_occupancy(hits: DataFrame, width: str = "1 day", late: str = LATENESS) -> DataFrame:
    """Hits per window, plane and pixel; rows later than the watermark are dropped."""
    w = F.window("ts", width)
    return hits.withWatermark("ts", late).groupBy(w.alias("w"), "dut", "col", "row_").agg(F.count("*").alias("n"))


def running_efficiency(hits: DataFrame, width: str = "1 day", late: str = LATENESS) -> DataFrame:
    """Passes and all hits per window and plane."""
    w = F.window("ts", width)
    return hits.withWatermark("ts", late).groupBy(w.alias("w"), "dut").agg(F.count_if("passed").alias("n_pass"), F.count("*").alias("n"))


def run_to_table(state: DataFrame, keys: list[str], scratch: Scratch) -> DataFrame:
    """Run a streaming aggregate over what its source has now; the newest row of each key.

    Every micro-batch writes its changed rows to a folder of its own, so a
    repeated batch replaces itself and counts are read at their largest.
    """
    log = scratch.path("changes")

    def write(changed: DataFrame, batch: int) -> None:
        changed.withColumn("start", F.unix_seconds(F.col("w.start"))).drop("w").write.mode("overwrite").parquet(f"{log}/batch={batch}")

    query = state.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", scratch.path("progress")).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = scratch.spark.read.parquet(log).drop("batch")
    values = [c for c in rows.columns if c not in [*keys, "start"]]
    return rows.groupBy("start", *keys).agg(*(F.max(c).alias(c) for c in values))


def stream_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a file stream; a table that is one file is picked from its folder by name."""
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    reader = spark.readStream.schema(table.schema)
    if any(f.endswith("/events.parquet") for f in table.inputFiles()):
        return hit_stream(reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir))
    return hit_stream(reader.parquet(f"{sf_dir}/events.parquet"))
