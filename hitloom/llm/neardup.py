"""MinHash near-duplicate detection by a chosen-path set similarity join.

A document is the set of its distinct word shingles. Equal sets are one set
from the start. Each of ``trees`` independent trees branches every set
recursively: a node's path names ``BRANCH`` signature coordinates, each the
minwise token of the set under a hash function of its own, and the set goes to
the child of each token. Two sets of similarity t share a given child with
probability t, so with two branches a pair at the threshold survives in one
tree with probability 1 - q, q being the smaller root of q = (1 - t + t q)^2,
and the number of trees follows from the target recall.

Nodes of up to ``SMALL`` sets are compared exhaustively. In a larger node every
set is compared with one pivot; what is linked already needs no comparison, so
only nodes whose sets lie in several components go on. A node of which a good
part resembles its pivot would keep together however far it branched: there,
and in what is large on the last level, the sets outside the node's largest
component are compared with all others in blocks of bounded bytes. A block
counts common shingles along its inverted index and returns only links that
join two components, never its pairs. No bucket is capped. Candidates pass a
size test that is exact and, outside blocks, a sketch test whose chance to lose
a pair is below 1e-8; every link is confirmed on the full sets.

What is shuffled: one narrow row per set, tree and branch on the first level,
and signatures of sets in large nodes on the further ones. Shingle sets are
made only for documents of candidate pairs. Components come from alternating
star steps; all state stays in the cluster.
"""

from __future__ import annotations

import math
from functools import reduce
from hashlib import blake2b

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hitloom.llm.common import Recent, map_rows, read
from hitloom.llm.exact_dedup import located, unused
from hitloom.operators.components import connected_components
from hitloom.runtime import Scratch, ship

#: Signature coordinates named by one node, and levels of a tree.
BRANCH, LEVELS = 2, 3
#: Sets of a node that are compared exhaustively.
SMALL = 12
#: Share of a large node that must resemble its pivot for the node to be compared in blocks at once.
DENSE = 0.2
#: Bytes of shingle sets on one side of a block.
BLOCK = 1 << 20
#: Sketch: two bits of each of 128 coordinates of their own.
SKETCH = 128
#: Identifiers of candidate documents that one broadcast may hold.
BROADCAST_IDS = 2_000_000


def trees_for(threshold: float, recall: float) -> int:
    """Trees after which a pair at the threshold is met with probability ``recall``."""
    miss = 1 - threshold
    a, b, c = threshold**2, 2 * threshold * miss - 1, miss**2
    q = (-b - math.sqrt(b * b - 4 * a * c)) / (2 * a)
    return max(1, math.ceil(math.log(1 - recall) / math.log(q))) if q > 0 else 1


def coordinates(trees: int) -> int:
    return trees * sum(BRANCH**k for k in range(1, LEVELS + 1))


class Shingler:
    """Sorted distinct 64-bit hashes of the word shingles of a text."""

    MIX = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, width: int):
        self.width = width
        self.words = Recent(lambda w: int.from_bytes(blake2b(w, digest_size=8).digest(), "little"))

    def __call__(self, text: str | None) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        if not words:
            return np.empty(0, np.uint64)
        h = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        n = max(1, len(h) - self.width + 1)
        out = np.full(n, len(h) if len(h) < self.width else self.width, np.uint64)
        for k in range(min(self.width, len(h))):
            out = (out ^ h[k : k + n]) * self.MIX
            out ^= out >> np.uint64(29)
        return np.unique(out)


def hash_family(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and offsets of ``n`` hash functions on 32-bit values."""
    rng = np.random.default_rng(20_240_229)
    return rng.integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, n, dtype=np.uint32)


def minwise(s: np.ndarray, mul: np.ndarray, add: np.ndarray) -> np.ndarray:
    """Smallest hash of the set for each function, in blocks of bounded memory."""
    low = (s ^ (s >> np.uint64(32))).astype(np.uint32)
    best = np.full(len(mul), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 1024):
        best = np.minimum(best, (low[at : at + 1024, None] * mul + add).min(axis=0))
    return best


def signatures(docs: DataFrame, key: str, text: str, width: int, coords: int, row: str | None = None) -> DataFrame:
    """Per row: doc_id, n (set size), k1 and k2 (identity of the set), sig (minwise tokens), s1 to s4 (sketch), and ``row`` if given."""

    def make():
        shingle = Shingler(width)
        mul, add = hash_family(coords + SKETCH)

        def run(c):
            out = [[] for _ in range(9)]
            for key_, text_ in zip(*c[:2], strict=True):
                s = shingle(text_)
                low = minwise(s, mul, add)
                digest = blake2b(s.tobytes(), digest_size=16).digest()
                # tokens keep their best 32 bits mixed, so that a path's hash is of the whole token
                bits = (low[coords:] * np.uint32(0x85EBCA6B)) >> np.uint32(16)
                planes = np.packbits(np.stack([bits & 1, (bits >> 1) & 1]).astype(np.uint8), axis=1).view(">i8").ravel()
                values = [key_, len(s), *np.frombuffer(digest, "<i8").tolist(), low[:coords].tobytes(), *planes.tolist()]
                for column, v in zip(out, values, strict=True):
                    column.append(v)
            return [*out, *c[2:]]

        return run

    schema = "doc_id bigint, n bigint, k1 bigint, k2 bigint, sig binary, s1 bigint, s2 bigint, s3 bigint, s4 bigint"
    carry = [row] if row else []
    return map_rows(docs.select(F.col(key).cast("long"), text, *carry), make, ", ".join([schema, *(f"`{c}` string" for c in carry)]))


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """Rows ``(doc_id, s)`` with the sorted set as little-endian 64-bit values."""

    def make():
        shingle = Shingler(width)
        return lambda c: [c[0], [shingle(t).tobytes() for t in c[1]]]

    return map_rows(docs, make, "doc_id bigint, s binary")


def confirm(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, sa, sb) whose sets meet 100 * intersection >= percent * union."""

    def make():
        def run(c):
            a, b = [], []
            for i, j, x, y in zip(*c, strict=True):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                both = len(x) + len(y)
                inter = both - len(np.unique(np.concatenate([x, y])))
                if both and 100 * inter >= percent * (both - inter):
                    a.append(i)
                    b.append(j)
            return [a, b]

        return run

    return map_rows(pairs.select("a", "b", "sa", "sb"), make, "a bigint, b bigint")


def _token(coordinate: int) -> Column:
    return F.substring("sig", 4 * coordinate + 1, 4)


def _may_match(percent: int) -> Column:
    """Exact size test and sketch test on sides a and b of a join."""
    x, y = F.least("a.n", "b.n"), F.greatest("a.n", "b.n")
    miss = lambda i: F.bit_count(F.col(f"a.s{i}").bitwiseXOR(F.col(f"b.s{i}")).bitwiseOR(F.col(f"a.s{i + 2}").bitwiseXOR(F.col(f"b.s{i + 2}"))))
    p = 0.75 * (1 - percent / 100)
    most = math.ceil(SKETCH * p + 6.5 * math.sqrt(SKETCH * p * (1 - p)))
    return (100 * x >= percent * y) & (miss(1) + miss(2) <= most)


class _Join:
    """One run of the join over a table of distinct sets."""

    def __init__(self, texts: DataFrame, sets: DataFrame, width: int, percent: int, trees: int, scratch: Scratch):
        self.texts, self.sets, self.width, self.percent, self.trees, self.scratch = texts, sets, width, percent, trees, scratch
        self.narrow = ["doc_id", "n", "s1", "s2", "s3", "s4"]

    def first_level(self) -> DataFrame:
        nodes = [F.struct(F.lit(t * BRANCH + j).alias("place"), F.xxhash64(F.lit(t * BRANCH + j), _token(self.coordinate(t, 0, j))).alias("node")) for t in range(self.trees) for j in range(BRANCH)]
        return self.sets.select("doc_id", F.explode(F.array(*nodes)).alias("at")).select("at.place", "at.node", "doc_id")

    def coordinate(self, tree: int, level: int, branch: int) -> int:
        """Of the ``branch``-th child on ``level`` of a tree; every branch of a level and tree has its own."""
        return tree * sum(BRANCH**k for k in range(1, LEVELS + 1)) + sum(BRANCH**k for k in range(1, level + 1)) + branch

    def next_level(self, rows: DataFrame, level: int) -> DataFrame:
        """Children of the rows' nodes: ``place`` tells the tree and the branches taken so far."""
        signed = rows.select("place", "node", "doc_id").join(self.sets, "doc_id")
        wide = BRANCH**level  # branches taken in one tree so far
        child = None
        for place in range(self.trees * wide):
            tree, taken = divmod(place, wide)
            own = F.array(*[
                F.struct(F.lit(tree * wide * BRANCH + taken * BRANCH + j).alias("place"), F.xxhash64("node", F.lit(j), _token(self.coordinate(tree, level, taken * BRANCH + j))).alias("node"))
                for j in range(BRANCH)
            ])
            child = F.when(F.col("place") == place, own) if child is None else child.when(F.col("place") == place, own)
        return signed.select("doc_id", F.explode(child).alias("at")).select("at.place", "at.node", "doc_id")

    def shared(self, rows: DataFrame) -> DataFrame:
        """Rows of nodes with two sets or more, with the node's size and pivot and the set's size and sketch.

        Most nodes hold one set: only three numbers a row are shuffled to find
        that out, and what is left meets its sketch.
        """
        pivot = F.min_by("doc_id", F.xxhash64("doc_id", "place"))
        counts = rows.groupBy("place", "node").agg(F.count("*").alias("size"), pivot.alias("pivot")).where("size > 1")
        return rows.join(counts, ["place", "node"]).join(self.sets.select(*self.narrow), "doc_id")

    def small_pairs(self, small: DataFrame) -> DataFrame:
        """All pairs of small nodes."""
        a, b = small.alias("a"), small.alias("b")
        same = (F.col("a.place") == F.col("b.place")) & (F.col("a.node") == F.col("b.node")) & (F.col("a.doc_id") < F.col("b.doc_id"))
        return a.join(b, same & _may_match(self.percent)).select(F.col("a.doc_id").alias("a"), F.col("b.doc_id").alias("b"))

    def star(self, large: DataFrame) -> DataFrame:
        """Rows of large nodes with the node's pivot and whether the two may be linked."""
        centre = large.where("doc_id = pivot").alias("a")
        near = F.when(F.col("b.doc_id") == F.col("a.doc_id"), True).otherwise(_may_match(self.percent))
        return large.alias("b").join(centre, ["place", "node"]).select("place", "node", *(F.col(f"b.{c}") for c in [*self.narrow, "pivot"]), near.alias("near"))

    def links(self, pairs: DataFrame) -> DataFrame:
        """Confirm candidates on the full sets."""
        pairs, seen = self.scratch.counted(pairs, "candidates")
        if not seen["n"]:
            return pairs
        ids = pairs.select(F.col("a").alias("doc_id")).unionAll(pairs.select("b")).distinct()
        texts = self.texts.join(F.broadcast(ids) if 2 * seen["n"] <= BROADCAST_IDS else ids, "doc_id", "left_semi")
        made = self.scratch.table(shingle_sets(texts, self.width), "sets")
        # a repeated identifier would repeat its set
        both = pairs.join(made.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")), "a").join(made.select(F.col("doc_id").alias("b"), F.col("s").alias("sb")), "b")
        out = self.scratch.table(confirm(both, self.percent), "links")
        self.scratch.release(made, pairs)
        return out

    def run(self) -> DataFrame:
        rows = self.scratch.table(self.first_level(), "level")
        found: list[DataFrame] = []
        for level in range(LEVELS):
            shared, seen = self.scratch.counted(self.shared(rows), "nodes", large=F.count_if(F.col("size") > SMALL))
            pairs = self.small_pairs(shared.where(F.col("size") <= SMALL))
            self.scratch.release(rows)
            if not seen["large"]:
                found.append(self.links(pairs.distinct()))
                break
            star = self.scratch.table(self.star(shared.where(F.col("size") > SMALL)), "stars")
            ends = F.least("doc_id", "pivot").alias("a"), F.greatest("doc_id", "pivot").alias("b")
            found.append(self.links(pairs.unionAll(star.where("near AND doc_id <> pivot").select(*ends)).distinct()))
            self.scratch.release(shared)
            labels = self.scratch.table(connected_components(reduce(DataFrame.unionAll, found).distinct(), scratch=self.scratch), "components")
            marked = star.join(labels.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
            marked = self.scratch.table(marked, "marked")
            nodes = marked.groupBy("place", "node").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.avg(F.col("near").cast("int")).alias("share"))
            last = level + 1 == LEVELS
            nodes = nodes.where("lo < hi").select("place", "node", (F.lit(last) | (F.col("share") >= DENSE)).alias("dense"))
            nodes, seen = self.scratch.counted(nodes, "open", dense=F.count_if("dense"))
            if seen["dense"]:
                found.append(self.block_links(marked.join(nodes.where("dense"), ["place", "node"], "left_semi")))
            self.scratch.release(star)
            if seen["n"] == seen["dense"]:
                break
            rows = self.scratch.table(self.next_level(marked.join(nodes.where("NOT dense"), ["place", "node"], "left_semi"), level + 1), "level")
        return reduce(DataFrame.unionAll, found).distinct()

    def block_links(self, rows: DataFrame) -> DataFrame:
        """Links between components of a node, found by comparing all but its largest component with all, in blocks."""
        parts = rows.groupBy("place", "node", "component").agg(F.count("*").alias("m"), F.sum("n").alias("shingles"))
        whole = parts.groupBy("place", "node").agg(F.max(F.struct("m", "component", "shingles")).alias("t"), F.sum("shingles").alias("shingles"))
        blocks = lambda c: F.greatest(F.lit(1), F.ceil(8 * c / F.lit(float(BLOCK)))).cast("int")
        nodes = whole.select("place", "node", F.col("t.component").alias("top"), blocks(F.col("shingles")).alias("nb"), blocks(F.col("shingles") - F.col("t.shingles")).alias("na"))
        known, seen = self.scratch.counted(rows.select("place", "node", "doc_id", "component").join(nodes, ["place", "node"]), "blocks")
        ids = known.select("doc_id").distinct()
        few = seen["n"] <= BROADCAST_IDS
        made = self.scratch.table(shingle_sets(self.texts.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi"), self.width), "sets")
        at = lambda n: F.pmod(F.xxhash64("doc_id", "place"), F.col(n)).cast("int")
        upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
        a = known.where("component <> top").withColumn("side", F.lit(0)).withColumn("i", at("na")).withColumn("j", F.explode(upto("nb")))
        b = known.withColumn("side", F.lit(1)).withColumn("j", at("nb")).withColumn("i", F.explode(upto("na")))
        keys = ["place", "node", "i", "j"]
        both = a.select(*keys, "side", "doc_id", "component").unionByName(b.select(*keys, "side", "doc_id", "component")).join(made, "doc_id")
        percent = self.percent
        ship(rows.sparkSession)
        found = both.groupBy(*keys).applyInPandas(lambda block: compare_block(block, percent), "a bigint, b bigint")
        out = self.scratch.table(found, "links")
        self.scratch.release(made, known)
        return out


def compare_block(block, percent: int):
    """Links of side 0 with side 1 that join two components of the block, exact on the full sets."""
    import pandas as pd

    left, right = block[block.side == 0], block[block.side == 1]
    sets = [np.frombuffer(s, "<u8") for s in right.s]
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    tokens = np.concatenate(sets) if len(sets) else np.empty(0, np.uint64)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    own = dict.fromkeys([*left.component, *right.component])
    parent = {c: c for c in own}

    def top(c):
        while parent[c] != c:
            parent[c] = c = parent[parent[c]]
        return c

    components, ids, links = right.component.to_numpy(), right.doc_id.to_numpy(), []
    for doc, component, s in zip(left.doc_id, left.component, left.s, strict=True):
        x = np.frombuffer(s, "<u8")
        first, end = np.searchsorted(tokens, x), np.searchsorted(tokens, x, "right")
        n = end - first
        spots = np.repeat(first - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        common = np.bincount(owner[spots], minlength=len(sets))
        for y in np.flatnonzero(100 * common >= percent * (len(x) + size - common)):
            here, there = top(component), top(components[y])
            if here != there:
                parent[max(here, there)] = min(here, there)
                links.append((min(doc, ids[y]), max(doc, ids[y])))
    return pd.DataFrame(links, columns=["a", "b"], dtype="int64")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80, recall: float = 0.99999, row: str | None = None) -> DataFrame:
    """One row for each row of ``docs``: key, n_shingles, component_id, kept, and ``row_id`` if ``row`` names a string that tells rows apart.

    Words are as in the contract, shingles have ``width`` words (a shorter text
    is one shingle), sets are linked at 100 * intersection >= percent * union,
    and a component's id is its smallest key; ``kept`` marks that document.
    Null and empty texts have no shingles and are linked with nothing; repeated
    rows and equal texts are in one component. Rows with a null key form no
    link and have a null component. Rows that share a key but not the text are
    told apart and linked like others. Other columns are not read. An empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    trees = trees_for(percent / 100, recall)
    carry = ["row_id"] if row else []
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), *(F.col(row).alias(c) for c in carry))
    made = scratch.table(signatures(texts, "doc_id", "text", width, coordinates(trees), *carry), "signatures")
    full = made.where("n > 0 AND doc_id IS NOT NULL")
    groups = scratch.table(full.groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("rep")), "groups")
    sets = scratch.table(made.drop(*carry).join(groups.select(F.col("rep").alias("doc_id"), "k1", "k2"), ["doc_id", "k1", "k2"], "left_semi").dropDuplicates(["doc_id", "k1", "k2"]), "sets")
    if not sets.groupBy("doc_id").count().where("count > 1").isEmpty():
        return _apart(texts, key, width, percent, recall, carry)
    links = _Join(texts.drop(*carry), sets.drop("k1", "k2"), width, percent, trees, scratch).run()
    labels = scratch.table(connected_components(links, scratch=scratch), "components")
    scratch.release(sets)
    named = groups.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("k1", "k2", F.coalesce("component", "rep").alias("component"))
    rows = made.select("doc_id", "n", "k1", "k2", *carry)
    linked = rows.where("n > 0 AND doc_id IS NOT NULL").join(named, ["k1", "k2"]).select("doc_id", "n", "component", *carry)
    alone = rows.where("n = 0 OR doc_id IS NULL").select("doc_id", "n", F.col("doc_id").alias("component"), *carry)
    return linked.unionAll(alone).select(F.col("doc_id").alias(key), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True)).alias("kept"), *carry)


def _apart(texts: DataFrame, key: str, width: int, percent: int, recall: float, carry: list[str]) -> DataFrame:
    """Where one key stands for different texts, each (key, text) is a document of its own until components are named."""
    own = texts.withColumn("v", F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text")))
    own = Scratch(texts.sparkSession, "apart").table(own, "texts")
    found = near_duplicates(own, "v", "text", width, percent, recall).select("v", "n_shingles", F.col("component_id").alias("c")).dropDuplicates(["v"])
    rows = own.select("doc_id", "v", *carry).join(found, "v")
    least = rows.groupBy("c").agg(F.min("doc_id").alias("component_id"))
    named = rows.join(least, "c").select("doc_id", "n_shingles", "component_id", *carry)
    alone = near_duplicates(own.where("v IS NULL").select(F.col("v").alias("doc_id"), "text", *carry), "doc_id", "text", width, percent, recall, *carry)
    both = named.unionAll(alone.select("doc_id", "n_shingles", "component_id", *carry))
    return both.select(F.col("doc_id").alias(key), "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), *carry)


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), width=3, percent=85)


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates (five words, 0.8), with the same columns.

    Of a group the row with the smallest key stays; of several rows with that
    key (repeated rows, or texts that are linked) the one whose place in the
    files is the smallest string. Rows without words or without a key stay.
    """
    name = unused(docs)
    rows = located(docs, Scratch(spark, "stage"), name)
    alone = F.when((F.col("n_shingles") == 0) | F.col("component_id").isNull(), F.col("row_id"))
    kept = near_duplicates(rows, row=name).where("kept").groupBy("component_id", alone.alias("alone")).agg(F.min("row_id").alias(name))
    return rows.join(kept.select(name), name, "left_semi").drop(name)


ORACLE = r"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, concat_ws(' ', w[i], w[i + 1], w[i + 2]) AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM docs WHERE len(w) > 0)),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS MATERIALIZED (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles AS x JOIN shingles AS y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL) AS p
  JOIN sizes AS u ON u.doc_id = p.a JOIN sizes AS v ON v.doc_id = p.b WHERE 100 * p.c >= 85 * (u.n + v.n - p.c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
found AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT docs.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, docs.doc_id = component_id AS kept
FROM docs JOIN found ON found.a = docs.doc_id LEFT JOIN sizes ON sizes.doc_id = docs.doc_id
"""
