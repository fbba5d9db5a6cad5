"""Exact deduplication by a stateful stream.

Rows arrive as a stream of (digest, stable identifier, content locator). Keyed
state on disk (RocksDB store, no expiry, no watermark) keeps for each digest
the largest identifier, the locator of its row and the number of rows. A later
batch updates the state and appends the changed keys to a log of states in the
shared folder. Each group with more than one row is then checked byte for byte:
texts are compared with the text that the locator points at, and rows that
share a digest without sharing the bytes are grouped by the text itself.

With a ``state`` folder arrivals, state and log outlive the call: documents of
further calls meet those of earlier ones, and a call that was broken off and is
made again with the same ``batch`` name goes on from the stream's checkpoint.
Without one each call has a folder of its own.

Only the narrow arrival rows are shuffled by digest. Texts are read again for
groups with more than one row; the digests of these groups are broadcast below
a counted bound and joined by shuffle beyond it. Counting and the choice of
the row to keep are partial aggregates, so that one group with a third of all
rows reaches its task as one row for each upstream task.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hitloom.llm.common import read
from hitloom.runtime import Scratch

#: Groups to check that one broadcast may hold (a digest of 32 bytes, a locator and two numbers each).
BROADCAST_KEYS = 200_000
#: Settings of the stream: state on disk, and a store closed once its task has committed, so that
#: the executors' disks hold the stores of running tasks and not one of every partition.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}
#: Copies of one text that are compared with the kept one in one task, about.
GROUP_ROWS = 500
ARRIVAL = "digest binary, doc_id long, locator string"


def sha256(text: Column) -> Column:
    """The 32 bytes of a text's SHA-256 in UTF-8; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def located(docs: DataFrame, scratch: Scratch, name: str = "locator") -> DataFrame:
    """``docs`` with a column ``name`` (file and row) that no other row has.

    Frames not read from files, and those that read a file twice, are written
    first; the latter is found by counting hashes of the places.
    """
    where = F.concat_ws("#", "_metadata.file_path", F.col("_metadata.row_index").cast("string"))
    try:
        rows = docs.withColumn(name, where)
        if rows.groupBy(F.xxhash64(name)).count().where("count > 1").isEmpty():
            return rows
    except AnalysisException:  # no file metadata: the frame is not a plain read
        pass
    return scratch.table(docs, "documents").withColumn(name, where)


def unused(docs: DataFrame, name: str = "locator") -> str:
    """``name``, made longer until no column of ``docs`` has it."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def run_stream(arrivals: DataFrame, log: str, checkpoint: str) -> None:
    """Bring the keyed state up to date with all rows of the stream ``arrivals`` that it has not seen.

    Each micro-batch appends its changed keys to ``log``/batch=<id>; writing a
    batch again replaces it.
    """
    spark = arrivals.sparkSession
    state = arrivals.groupBy("digest").agg(
        F.max(F.struct("doc_id", "locator")).alias("keep"), F.count("*").alias("group_size")
    )

    def append(changed: DataFrame, batch: int) -> None:
        changed.select("digest", "keep.doc_id", "keep.locator", "group_size").write.mode("overwrite").parquet(f"{log}/batch={batch}")

    before = {k: spark.conf.get(k, None) for k in STORE}
    for k, v in STORE.items():
        spark.conf.set(k, v)
    try:
        query = state.writeStream.outputMode("update").foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)


def latest(spark: SparkSession, log: str) -> DataFrame:
    """The newest state of each digest: counts only grow."""
    rows = spark.read.schema("digest binary, doc_id long, locator string, group_size long, batch long").parquet(log)
    return rows.groupBy("digest").agg(F.max(F.struct("group_size", "doc_id", "locator")).alias("s")).select(
        "digest", F.col("s.doc_id").alias("keep_id"), F.col("s.locator").alias("keep_locator"), F.col("s.group_size").alias("group_size")
    )


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", digest=sha256, state: str | None = None, batch: str = "0", locator: str | None = None) -> DataFrame:
    """One row for each row of ``docs``: key, locator, keep_id, group_size, kept, text_sha256.

    Null text counts as empty. Of rows with equal texts the one with the
    largest key stays; of repeated rows with that key, the one whose locator is
    the greatest string. A null key is smaller than any other. Other columns
    are not read. An empty table gives an empty result.

    ``state`` names a folder that all executors reach and that later calls may
    name again: groups then cover the rows of all batches, a row of ``docs``
    stays if no row of a batch so far with the same text has a larger key, and a
    ``batch`` that is there already is not counted twice. Files of earlier
    batches must stay where they were, as texts are compared with them.
    ``locator`` names a column of ``docs`` that tells rows apart, as
    :func:`located` makes it; without one it is made here.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact")
    if state and not docs.inputFiles():
        docs = once(docs, f"{state}/documents/batch={batch}")
    name = locator or unused(docs)
    rows = (docs if locator else located(docs, scratch, name)).select(F.col(key).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"), F.col(name).alias("locator"))
    made = rows.select(digest(F.col("text")).cast("binary").alias("digest"), "doc_id", "locator", *([] if digest is sha256 else [sha256(F.col("text")).alias("sha")]))
    arrivals = once(made, f"{state}/arrivals/batch={batch}") if state else scratch.table(made, "arrivals")
    log, path = f"{state}/states" if state else scratch.path("states"), arrivals.inputFiles()
    own = F.lower(F.hex("digest" if digest is sha256 else "sha")).alias("text_sha256")
    if not path:
        return arrivals.select(F.col("doc_id").alias(key), "locator", F.col("doc_id").alias("keep_id"), F.lit(0).cast("long").alias("group_size"), F.lit(True).alias("kept"), own)
    source = spark.readStream.schema(ARRIVAL).option("recursiveFileLookup", "true")
    run_stream(source.parquet(f"{state}/arrivals" if state else path[0].rsplit("/", 1)[0]), log, f"{state}/progress" if state else scratch.path("progress"))
    groups = latest(spark, log)

    hits = groups.where("group_size > 1")
    hits = F.broadcast(hits) if hits.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else hits
    copies = rows.select(digest(F.col("text")).cast("binary").alias("digest"), "doc_id", "locator", "text").join(hits, "digest")
    if state:  # texts of earlier batches that share a digest with one of this batch
        earlier = earlier_rows(spark, arrivals, state, batch, key, text)
        if earlier is not None:
            copies = copies.unionByName(earlier.join(groups.where("group_size > 1"), "digest"))
    # a large group is dealt to several tasks, and its kept text to each of them
    shares = F.ceil(F.col("group_size") / F.lit(float(GROUP_ROWS)))
    kept_text = copies.where("locator = keep_locator").select("digest", F.explode(F.sequence(F.lit(0).cast("long"), shares - 1)).alias("share"), F.col("text").alias("keep_text"))
    dealt = copies.withColumn("share", F.pmod(F.xxhash64("locator"), shares))
    clash = dealt.join(kept_text, ["digest", "share"]).where("text <> keep_text").select("digest").distinct()
    clash = scratch.table(clash, "clashes")

    found = arrivals.join(groups, "digest")
    if clash.isEmpty():
        out = found
    else:  # different bytes under one digest: these groups are formed by the text
        apart = copies.join(clash, "digest", "left_semi").select("digest", "doc_id", "locator", "text")
        by_text = apart.groupBy("digest", "text").agg(F.max(F.struct("doc_id", "locator")).alias("keep"), F.count("*").alias("group_size"))
        apart = apart.join(by_text, ["digest", "text"]).select("locator", "keep.doc_id", F.col("keep.locator").alias("keep_locator"), "group_size")
        apart = arrivals.join(apart.withColumnRenamed("doc_id", "keep_id"), "locator")
        out = found.join(clash, "digest", "left_anti").unionByName(apart)
    return out.select(F.col("doc_id").alias(key), "locator", "keep_id", "group_size", (F.col("locator") == F.col("keep_locator")).alias("kept"), own)


def once(df: DataFrame, path: str) -> DataFrame:
    """``df`` written to ``path`` unless a whole table is there already, and read back."""
    spark = df.sparkSession
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def earlier_rows(spark: SparkSession, arrivals: DataFrame, state: str, batch: str, key: str, text: str) -> DataFrame | None:
    """Rows (digest, doc_id, locator, text) of other batches whose digest is in ``arrivals``; None without such rows.

    Only the names of the files in which they stand reach the driver.
    """
    old = spark.read.schema(f"{ARRIVAL}, batch string").parquet(f"{state}/arrivals").where(F.col("batch") != batch).drop("batch")
    old = old.join(arrivals.select("digest").distinct(), "digest", "left_semi")
    files = [r[0] for r in old.select(F.substring_index("locator", "#", 1)).distinct().collect()]
    if not files:
        return None
    where = F.concat_ws("#", "_metadata.file_path", F.col("_metadata.row_index").cast("string"))
    texts = spark.read.parquet(*files).select(where.alias("locator"), F.coalesce(text, F.lit("")).alias("text"))
    return old.join(texts, "locator").select("digest", "doc_id", "locator", "text")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents")).drop("locator")


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of ``docs`` that stay, with the same columns, whatever their names; each row follows its own verdict."""
    name = unused(docs)
    rows = located(docs, Scratch(spark, "stage"), name)
    kept = exact_dedup(rows, locator=name).where("kept").select(F.col("locator").alias(name))
    return rows.join(kept, name, "left_semi").drop(name)


ORACLE = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
  count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
