"""Mixing sources to target weights by Pareto order sampling, with built-in functions only.

A document's expected copies are c * emphasis, up to three, where c makes the
source's expected words meet its target. By default the emphasis falls with
the document's length (by powers of two, see :func:`emphasis_of`), so that long
documents are repeated less often than short ones and a few of them cannot make
up a source's share. The whole part of the expected copies is certain. The rest
is an inclusion probability p below one, and the documents that get one more
copy are those of smallest rank (u / (1 - u)) / (p / (1 - p)), u being uniform
and fixed by the row's identifier. The sample is of fixed size in words:
documents are taken in rank order until the source's words meet its target, the
last one if that brings the sum closer, so the sum misses its target by half a
document at most. A document of no words is never copied.

No source is gathered in one task. c comes from sums per (source, emphasis), a
few dozen rows a source. Ranks are cut into cells; words are summed per
(source, cell), the running sum is taken over the cells, and only the documents
of the one cell in which a source's sum is met are put in order. Cells follow
the number of rows, so such a cell has about ``CELL_ROWS`` rows at every size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hitloom.llm.common import WORD, read
from hitloom.llm.exact_dedup import located, unused
from hitloom.runtime import Scratch

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
#: Rows of a source that are put in order in one task, about.
CELL_ROWS = 2_000


def words(text: str = "text") -> Column:
    """Number of words; null counts as empty."""
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")


def uniform(key: str, seed: int) -> Column:
    """A number strictly between 0 and 1 fixed by the key: 52 bits of an MD5."""
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(key).cast("string"), F.lit("null"))).cast("binary"))
    return (F.conv(F.substring(h, 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """Rows ``(source, source_size, target)`` from ``sizes`` (source, source_size), one row per source.

    Sources in code point order, null last, weigh ``weights`` in turn and share
    the sum of sizes. A target is at most ``most`` times its source's size and
    the excess goes to the others by weight: with sources ordered by capacity
    over weight, a source is full if its capacity per weight is below what is
    left per weight once all before it are full. Only this table of one row
    per source is ordered as a whole.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("weight", pick.cast("long")).withColumn("cap", F.col("source_size") * most)
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy()
    left = (F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double")
    per = left / (F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    rows = rows.withColumn("per", per).withColumn("full", F.col("cap") / F.col("weight") < F.col("per"))
    top = F.max("per").over(all_rows)
    return rows.select("source", "source_size", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(top * F.col("weight")).alias("target"))


def emphasis_of(size: Column) -> Column:
    """Whole number from 24 for a document of one word down to 1, one less for each doubling of its words."""
    octave = F.length(F.bin(size)) - 1
    return F.greatest(F.lit(24) - octave, F.lit(1)).cast("long")


def shares(classes: DataFrame, most: int = MOST_COPIES) -> DataFrame:
    """Rows ``(source, g, full, left, rest)`` from ``classes`` (source, target, g, words): expected copies are ``left * g / rest``, or ``most`` if ``full``.

    Classes of a source in falling order of emphasis g are full as long as an
    equal rate for all that are not yet full would exceed ``most``; ``left`` is
    what full classes leave of the target and ``rest`` the emphasised words of
    the others. Sums are of whole numbers, so they do not depend on order.
    """
    falling = Window.partitionBy("source").orderBy(F.col("g").desc())
    before, after = falling.rowsBetween(Window.unboundedPreceding, -1), falling.rowsBetween(0, Window.unboundedFollowing)
    rows = classes.withColumns({
        "left": F.col("target") - most * F.coalesce(F.sum("words").over(before), F.lit(0)), "rest": F.sum(F.col("g") * F.col("words")).over(after),
    })
    rows = rows.withColumn("full", F.col("left") * F.col("g") >= F.lit(float(most)) * F.col("rest"))
    first = F.max(F.when(~F.col("full") & (F.col("rest") > 0), F.struct("g", "left", "rest"))).over(Window.partitionBy("source"))
    return rows.withColumn("first", first).select("source", "g", "full", F.col("first.left").alias("left"), F.col("first.rest").alias("rest"))


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", seed: int = 0, emphasis: str | None = None, scratch: Scratch | None = None, row: str | None = None) -> DataFrame:
    """One row for each row of ``docs``: key, size, source_size, target, taken, copies, and ``row_id`` if ``row`` names a column that tells rows apart.

    A null source is a source of its own, null and empty texts have size 0 and
    are not copied, repeated rows are rows like others and rows of equal rank
    stand in order of key and size. ``emphasis`` names a column of whole numbers
    from 0 on (null: 1) that expected copies within a source follow, up to
    three copies; each of its values is one class of the source. Other columns
    are not read. An empty table gives an empty result.
    """
    scratch = scratch or Scratch(docs.sparkSession, "mix")
    carry = ["row_id"] if row else []
    rows = docs.select(
        F.col(key).alias("doc_id"), F.col(source).alias("source"), words(text).alias("size"), uniform(key, seed).alias("u"),
        *([F.greatest(F.coalesce(F.col(emphasis), F.lit(1)).cast("long"), F.lit(0)).alias("g")] if emphasis else []),
        *(F.col(row).alias(c) for c in carry),
    )
    rows = scratch.table(rows if emphasis else rows.withColumn("g", emphasis_of(F.col("size"))), "sizes")
    classes = scratch.table(rows.groupBy("source", "g").agg(F.sum("size").alias("words"), F.count("*").alias("n")), "classes")
    sums = classes.groupBy("source").agg(F.sum("words").alias("source_size"), F.sum("n").alias("n"))
    goal = targets(sums.select("source", "source_size")).join(sums.select(F.col("source").alias("s"), "n"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    goal = scratch.table(goal, "targets")
    same = F.col("source").eqNullSafe(F.col("s"))
    rate = shares(classes.drop("n").join(goal.select(F.col("source").alias("s"), "target"), same).drop("s"))
    plan = rate.join(goal.withColumnRenamed("source", "s"), same).drop("s")
    plan, seen = scratch.counted(plan.select(F.col("source").alias("s"), F.col("g").alias("g_"), "full", "left", "rest", "source_size", "target", "n"), "plan")
    known = rows.join(F.broadcast(plan) if seen["n"] <= 100_000 else plan, same & (F.col("g") == F.col("g_"))).drop("s", "g_")
    per = F.when(F.col("full"), F.lit(float(MOST_COPIES))).otherwise(F.col("left") * F.col("g") / F.col("rest"))
    known = known.withColumn("expected", F.when(F.col("size") > 0, F.coalesce(per, F.lit(0.0))).otherwise(0.0)).withColumn("whole", F.floor("expected"))
    p = F.col("expected") - F.col("whole")
    known = known.withColumn("rank", F.when(p > 0, (F.col("u") / (1 - F.col("u"))) / (p / (1 - p))))
    cells = F.greatest(F.lit(1.0), F.ceil(F.col("n") / F.lit(float(CELL_ROWS))))
    known = known.withColumn("cell", F.floor(F.col("rank") / (1 + F.col("rank")) * cells).cast("long"))
    ranked = scratch.table(known.select("doc_id", "source", "size", "source_size", "target", "whole", "rank", "cell", *carry), "ranks")
    scratch.release(rows, classes, goal, plan)

    per_cell = ranked.groupBy("source", "cell").agg(
        F.sum(F.when(F.col("rank").isNotNull(), F.col("size"))).alias("words"), F.sum(F.col("size") * F.col("whole")).alias("certain"), F.first("target").alias("target")
    )
    by_source = Window.partitionBy("source")
    upto = by_source.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    per_cell = (
        per_cell.withColumn("need", F.col("target") - F.sum("certain").over(by_source))
        .withColumn("done", F.coalesce(F.sum("words").over(upto), F.lit(0)))
        .withColumn("open", (F.col("done") < F.col("need")) & (F.col("done") + F.col("words") > F.col("need")))
    )
    states = per_cell.where("cell IS NOT NULL").select(F.col("source").alias("s"), F.col("cell").alias("c"), "need", "done", "open", (F.col("done") + F.col("words") <= F.col("need")).alias("all_in"))
    states, seen = scratch.counted(states, "cells")
    joined = ranked.join(F.broadcast(states) if seen["n"] <= 1_000_000 else states, same & (F.col("cell") == F.col("c")), "left").drop("s", "c")
    in_order = Window.partitionBy("source", "cell").orderBy("rank", "doc_id", "size", *carry).rowsBetween(Window.unboundedPreceding, -1)
    met = joined.where("open").withColumn("so_far", F.col("done") + F.coalesce(F.sum("size").over(in_order), F.lit(0)))
    met = met.withColumn("more", (F.col("so_far") + F.col("size") / 2 <= F.col("need")).cast("long")).drop("so_far")
    rest = joined.where(~F.coalesce(F.col("open"), F.lit(False))).withColumn("more", F.coalesce(F.col("all_in"), F.lit(False)).cast("long"))
    copies = F.col("whole") + F.col("more")
    return met.unionByName(rest).select(F.col("doc_id").alias(key), "size", "source_size", "target", (copies * F.col("size")).cast("long").alias("taken"), copies.cast("long").alias("copies"), *carry)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with the same columns.

    Each row is met by its place in the files, so rows may repeat a key.
    """
    name = unused(docs)
    scratch = Scratch(spark, "stage")
    rows = located(docs, scratch, name)
    chosen = mix(rows, scratch=scratch, row=name).where("copies > 0").select(F.col("row_id").alias(name), F.sequence(F.lit(1), F.col("copies").cast("int")).alias("copies"))
    copies = unused(rows, "copies")
    found = rows.join(chosen.withColumnRenamed("copies", copies), name).drop(name)
    return found.withColumn(copies, F.explode(copies)).drop(copies)


ORACLE = r"""
WITH counted AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    (CAST(CAST(concat('0x', substr(md5(concat('0|', coalesce(CAST(doc_id AS VARCHAR), 'null'))), 1, 13)) AS BIGINT) AS DOUBLE) + 5e-1) / 4503599627370496e0 AS u
  FROM documents),
docs AS (SELECT *, greatest(24 - (length(bin(size)) - 1), 1) AS g FROM counted),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n FROM docs GROUP BY source),
weighted AS (
  SELECT *, 3 * source_size AS cap,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM sources),
filled AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0) AS DOUBLE)
      / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS DOUBLE) AS per
  FROM weighted
  WINDOW b AS (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goals AS (
  SELECT source AS s, source_size, CASE WHEN CAST(cap AS DOUBLE) / weight < per THEN CAST(cap AS DOUBLE) ELSE max(per) OVER () * weight END AS target
  FROM filled),
classes AS (SELECT source, g, CAST(sum(size) AS BIGINT) AS w FROM docs GROUP BY source, g),
rates AS (
  SELECT source, g, target - 3 * coalesce(sum(w) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS "left",
    sum(g * w) OVER (f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM classes JOIN goals ON source IS NOT DISTINCT FROM s WINDOW f AS (PARTITION BY source ORDER BY g DESC)),
judged AS (SELECT *, "left" * g >= 3e0 * CAST(rest AS DOUBLE) AS "full" FROM rates),
chosen AS (SELECT *, max(CASE WHEN NOT "full" AND rest > 0 THEN g END) OVER (PARTITION BY source) AS top FROM judged),
plan AS (
  SELECT source AS cs, g AS cg, "full", max(CASE WHEN g = top THEN "left" END) OVER (PARTITION BY source) AS l,
    CAST(max(CASE WHEN g = top THEN rest END) OVER (PARTITION BY source) AS DOUBLE) AS r
  FROM chosen),
known AS (
  SELECT docs.*, source_size, target, CASE WHEN size > 0 THEN coalesce(CASE WHEN "full" THEN 3e0 ELSE l * g / r END, 0e0) ELSE 0e0 END AS expected
  FROM docs JOIN goals ON source IS NOT DISTINCT FROM s JOIN plan ON source IS NOT DISTINCT FROM cs AND g = cg),
ranked AS (
  SELECT *, floor(expected) AS whole, expected - floor(expected) AS p,
    CASE WHEN expected > floor(expected) THEN (u / (1e0 - u)) / ((expected - floor(expected)) / (1e0 - (expected - floor(expected)))) END AS rank
  FROM known),
placed AS (
  SELECT *, target - sum(size * whole) OVER (PARTITION BY source) AS need,
    coalesce(sum(CASE WHEN rank IS NOT NULL THEN size END) OVER (PARTITION BY source ORDER BY rank NULLS LAST, doc_id, size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS so_far
  FROM ranked),
taken AS (
  SELECT *, CAST(whole AS BIGINT) + CASE WHEN rank IS NOT NULL AND so_far + size / 2e0 <= need THEN 1 ELSE 0 END AS copies FROM placed)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM taken
"""
