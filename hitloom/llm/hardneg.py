"""Hard-negative mining with Four-Russians scoring.

Vectors become integers. For a block of anchors and each group of eight
dimensions a table holds the sums of all 256 subsets of the anchors'
components. A candidate is its bit planes (two's complement) packed to one byte
per group and plane; its score with every anchor of the block is, from the top
plane down, twice the score so far plus the table rows its bytes point at. The
sums are exact integers.

Candidates are dealt to parts by their identifier, and the anchors (the stated
query set) go to every part in blocks. A part's candidates stay as packed bytes
while anchors stream past, and only the best of a part leave it; a second
aggregation merges the parts. Positives come first, then a second pass finds
the negatives whose scores lie in the window of each positive.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hitloom.llm.common import read
from hitloom.runtime import Scratch, ship

#: Candidates of a part: a 64th of all between these bounds.
LEAST_PART, LARGEST_PART = 4096, 262_144
#: Anchors of a block, whose tables take 256 sums for each group of eight dimensions, and candidates scored at once.
ANCHORS, CHUNK = 128, 4096
LONG = 2**63


def planes(v: np.ndarray) -> np.ndarray:
    """Packed bit planes of integers (n, d) in two's complement: bytes (groups, planes, n), the sign's plane last."""
    n, d = v.shape
    if not v.size:
        return np.zeros((0, 1, n), np.uint8)
    bits = max(int(v.max()).bit_length(), (~int(v.min())).bit_length()) + 1
    wide = np.zeros((n, -(-d // 8) * 8), v.dtype)
    wide[:, :d] = v
    out = np.empty((wide.shape[1] // 8, bits, n), np.uint8)
    for j in range(bits):
        plane = ((wide >> j) & 1).astype(np.uint8).reshape(n, -1, 8)
        out[:, j] = np.packbits(plane, axis=2, bitorder="little")[:, :, 0].T
    return out


def tables(a: np.ndarray, groups: int) -> np.ndarray:
    """Subset sums (groups, 256, anchors) of anchors (anchors, d); dimensions beyond ``d`` are 0."""
    wide = np.zeros((len(a), groups * 8), a.dtype)
    wide[:, : min(a.shape[1], groups * 8)] = a[:, : groups * 8]
    out = np.zeros((groups, 256, len(a)), a.dtype)
    for i in range(8):
        out[:, 1 << i : 2 << i] = out[:, : 1 << i] + wide.reshape(len(a), groups, 8).transpose(1, 2, 0)[:, i, None]
    return out


def scores(table: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """Scores (n, anchors): lookups added, shifted from plane to plane; the sign's plane counts negative."""
    groups, bits, n = packed.shape
    total = np.zeros((n, table.shape[2]), table.dtype)
    for j in range(bits - 1, -1, -1):
        if j < bits - 1:
            total += total
        for g in range(groups):
            rows = table[g].take(packed[g, j], axis=0)
            total = total - rows if j == bits - 1 else np.add(total, rows, out=total)
    return total


def fitting(*bounds: int) -> type:
    """The narrowest integer type that holds all of ``bounds``; Python's integers beyond 64 bits."""
    top = max(bounds, default=0)
    return np.int32 if top < 2**30 else np.int64 if top < 2**61 else object


def integers(vectors: list[list[float]]) -> np.ndarray:
    """floor(256 * x), rows of different lengths filled up with zeros."""
    d = max(map(len, vectors), default=0)
    out = np.zeros((len(vectors), d))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    out = np.floor(256 * out)
    top = np.abs(out).max(initial=0)
    if top < 2**61:
        return out.astype(fitting(int(top)))
    return np.frompyfunc(int, 1, 1)(out)


def best(score: np.ndarray, ids: np.ndarray, mask: np.ndarray, k: int) -> Iterator[tuple[int, list[int]]]:
    """For each row of ``score`` (anchors, n) the places of its ``k`` best columns under ``mask``, best first, ties by smaller id."""
    n = score.shape[1]
    rank = np.empty(n, np.int64)
    rank[np.argsort(ids, kind="stable")] = np.arange(n - 1, -1, -1)
    shift = n.bit_length()
    kind = fitting(int(np.abs(score).max(initial=0)) << (shift + 1)) if score.size else np.int64
    kind = np.int64 if kind is np.int32 else kind
    keys = (score.astype(kind) << shift) + rank.astype(kind)
    place = np.empty(n, np.int64)
    place[rank] = np.arange(n)
    for i in range(len(keys)):
        left = keys[i][mask[i]]
        if len(left) > k:
            left = np.partition(left, len(left) - k)[-k:] if kind is np.int64 else np.sort(left)[-k:]
        yield i, [int(place[int(v) & ((1 << shift) - 1)]) for v in np.sort(left)[::-1]]


class Part:
    """Candidates of one part, scored chunk by chunk against blocks of anchors."""

    def __init__(self, ids: list[int], labels: list[int], vectors: list[np.ndarray]):
        self.ids, self.labels = np.array(ids, np.int64), np.array(labels, np.int64)
        d = max(v.shape[1] for v in vectors)
        v = np.concatenate([np.pad(v, ((0, 0), (0, d - v.shape[1]))) for v in vectors])
        order = np.argsort(self.labels, kind="stable")
        self.ids, self.labels, v = self.ids[order], self.labels[order], v[order]
        self.top = int(np.abs(v).max(initial=0)) + 1
        self.packed = planes(v)

    def score(self, anchors: np.ndarray, start: int, stop: int) -> np.ndarray:
        groups = self.packed.shape[0]
        used = anchors[:, : groups * 8]
        bound = (int(np.abs(used).max(initial=0)) + 1) * self.top * 2 * max(1, groups * 8)
        table = tables(used.astype(fitting(bound)), groups)
        got = scores(table, self.packed[:, :, start:stop]).T
        return np.clip(got, 1 - LONG, LONG - 1).astype(np.int64) if got.dtype == object else got

    def positives(self, anchors: list[dict], v: np.ndarray, k: int) -> Iterator[tuple]:
        """(anchor_id, positive_id, positive_score): the best of the anchors' own labels."""
        labels = np.array([a["label"] for a in anchors], np.int64)
        for label in np.unique(labels):
            rows = np.flatnonzero(labels == label)
            lo, hi = np.searchsorted(self.labels, [label, label + 1]) if label < LONG - 1 else (np.searchsorted(self.labels, label), len(self.labels))
            own = np.array([anchors[i]["vec_id"] for i in rows], np.int64)
            for start in range(lo, hi, CHUNK):
                stop = min(start + CHUNK, hi)
                got = self.score(v[rows], start, stop)
                mask = self.ids[None, start:stop] != own[:, None]
                for i, places in best(got, self.ids[start:stop], mask, k):
                    for p in places:
                        yield int(own[i]), int(self.ids[start + p]), int(got[i, p])

    def negatives(self, anchors: list[dict], v: np.ndarray, k: int) -> Iterator[tuple]:
        """(anchor_id, positive_id, positive_score, negative_id, negative_score): the best of other labels in each positive's window."""
        labels = np.array([a["label"] for a in anchors], np.int64)
        most = max(len(a["positives"]) for a in anchors)
        for start in range(0, len(self.ids), CHUNK):
            got = self.score(v, start, start + CHUNK)
            ids, other = self.ids[start : start + CHUNK], self.labels[None, start : start + CHUNK] != labels[:, None]
            for slot in range(most):
                rows = [i for i, a in enumerate(anchors) if slot < len(a["positives"])]
                score = [anchors[i]["positives"][slot]["score"] for i in rows]
                low, high = (np.array([f(s) for s in score], np.int64)[:, None] for f in (lambda s: -(-30 * s // 100), lambda s: 90 * s // 100))
                sub = got[rows]
                mask = other[rows] & (sub >= low) & (sub <= high)
                for i, places in best(sub, ids, mask, k):
                    for p in places:
                        yield anchors[rows[i]]["vec_id"], anchors[rows[i]]["positives"][slot]["id"], score[i], int(ids[p]), int(sub[i, p])


def streamed(find: Callable[[Part, list[dict], np.ndarray], Iterator[tuple]], schema: pa.Schema) -> Callable:
    """A task over rows sorted by (part, kind): the candidates of a part are packed, then its anchors stream past."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, part, waiting, anchors = None, None, ([], [], []), []

        def flush() -> list[tuple]:
            return list(find(part, anchors, integers([a["embedding"] for a in anchors]))) if anchors and part else []

        out: list[tuple] = []
        for batch in batches:
            rows = batch.to_pylist()
            fresh: list[dict] = []

            def take() -> None:
                if fresh:
                    waiting[0].extend(r["vec_id"] for r in fresh)
                    waiting[1].extend(r["label"] for r in fresh)
                    waiting[2].append(integers([r["embedding"] for r in fresh]))
                    fresh.clear()

            for r in rows:
                if r["part"] != number:
                    take()
                    out.extend(flush())
                    number, part, waiting, anchors = r["part"], None, ([], [], []), []
                if r["kind"] == 0:
                    fresh.append(r)
                    continue
                take()
                if part is None and waiting[0]:
                    part, waiting = Part(*waiting), ([], [], [])
                anchors.append(r)
                if len(anchors) == ANCHORS:
                    out.extend(flush())
                    anchors = []
            take()
            if out:
                yield pa.record_batch([pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                out = []
        out.extend(flush())
        if out:
            yield pa.record_batch([pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


def scored(candidates: DataFrame, anchors: DataFrame, parts: int, find: Callable, schema: pa.Schema) -> DataFrame:
    """Every anchor against every candidate, in blocks: rows of ``schema`` from each part."""
    columns = ["part", "kind", "vec_id", "label", "embedding", "positives"]
    nothing = F.lit(None).cast("array<struct<score:bigint,id:bigint>>")
    rows = candidates.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")).withColumn("kind", F.lit(0)).withColumn("positives", nothing)
    asked = anchors if "positives" in anchors.columns else anchors.withColumn("positives", nothing)
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("kind", F.lit(1))
    dealt = rows.select(columns).unionByName(asked.select(columns)).repartition(parts, "part").sortWithinPartitions("part", "kind")
    ddl = ", ".join(f"{f.name} long" for f in schema)
    return dealt.mapInArrow(streamed(find, schema), ddl)


def first(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def hard_negatives(df: DataFrame, anchor: Column | None = None, positives: int = 5, negatives: int = 10) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for rows (vec_id, embedding, label) of ``df``.

    ``anchor`` is the condition of the query set (vec_id divisible by 100).
    Rows with a null identifier, label or vector, or a component that is null
    or not finite take no part; of rows with one identifier the smallest by
    (label, vector) does. Missing components of shorter vectors count as 0, an
    empty vector scores 0 everywhere. Scores are summed exactly at any size;
    one beyond the range of a long counts as the nearest long. Other columns are
    not read; anchors without positives, and positives without a row in their
    window, give no rows.
    """
    spark = df.sparkSession
    ship(spark)
    scratch = Scratch(spark, "hardneg")
    real = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double") * 256) < float("inf"), F.lit(False)))
    rows = df.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").where(real)
    rows = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>"))
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("r")).select("vec_id", "r.label", "r.embedding")
    rows, seen = scratch.counted(rows, "vectors")
    parts = max(1, -(-seen["n"] // min(max(seen["n"] // 64, LEAST_PART), LARGEST_PART)))
    asked = rows.where(F.col("vec_id") % 100 == 0 if anchor is None else anchor)

    long = lambda *names: pa.schema([(n, pa.int64()) for n in names])
    found = scored(rows, asked, parts, lambda part, a, v: part.positives(a, v, positives), long("anchor_id", "positive_id", "positive_score"))
    found = first(found, ["anchor_id"], [F.desc("positive_score"), F.col("positive_id")], positives)
    found = found.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct(F.col("positive_score").alias("score"), F.col("positive_id").alias("id"))).alias("positives"))
    asked = scratch.table(asked.join(found, "vec_id"), "anchors")

    names = ("anchor_id", "positive_id", "positive_score", "negative_id", "negative_score")
    mined = scored(rows, asked, parts, lambda part, a, v: part.negatives(a, v, negatives), long(*names))
    mined = first(mined, ["anchor_id", "positive_id"], [F.desc("negative_score"), F.col("negative_id")], negatives)
    return mined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    return hard_negatives(rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))))


ORACLE = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM rows a JOIN rows b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id)::INTEGER AS rank,
  s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY rank <= 10
"""
