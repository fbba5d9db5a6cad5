"""Prefix trie of conversations by truncation peeling.

Each conversation becomes a chain of prefix digests, one for each number of
first turns. Peeling starts at the longest conversation: those that end at the
present depth are merged with the nodes that survived from below, each node is
finished, its last turn is stripped, and the stripped nodes are regrouped by
the prefix left. A node is thus discovered and aggregated in the same pass.

Deep levels are peeled inside tasks and shallow ones by grouping in Spark.
Every conversation has a cut: the least of the depths 1, 2, 4, ... whose
prefix has at most ``GROUP`` turns below it. Conversations with the same prefix
at their cut lie in one task, which peels down to the cut; a prefix that a
third of all conversations share is cut deeper. Above the cuts each level is
one aggregation with partial sums. Equal conversations are one row from the
start.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hitloom.llm.common import map_rows, read
from hitloom.runtime import Scratch, ship

#: Bytes of a prefix digest.
ID = 16
#: Turns of one group that a task may peel at once; a conversation counts for ``LONG`` at most.
GROUP, LONG = 100_000, 1000
#: Identifiers that lie side by side in one row while the lists of ends are built.
CELL = 4096
#: Copies of a parent that its children are dealt to.
DEAL = 32
NOTHING = hashlib.sha256(b"").hexdigest()

NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def own_turns(df: DataFrame) -> DataFrame:
    """One row per conversation: conv_id and its turns in order, each as (digest of role and text, bytes of the text)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)), 1, ID)
    rows = df.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long"), F.struct("turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("size")).alias("t"))
    return rows.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["digest"], t["size"])).alias("turns"))


def rebuilt_turns(own: DataFrame, family: int = 5, most: int = 8) -> DataFrame:
    """Every conversation with the first h turns of the first of its family before its own turns from the h-th on."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)
    heads = own.select(F.col("conv_id").alias("first"), F.slice("turns", 1, most).alias("head"))
    rows = own.withColumn("first", F.col("conv_id") - F.col("conv_id") % family).join(heads, "first", "left")
    none = F.slice("turns", 1, 0)
    turns = F.concat(F.coalesce(F.slice("head", 1, h.cast("int")), none), F.slice("turns", h.cast("int") + 1, F.greatest(F.size("turns"), F.lit(1))))
    return rows.select("conv_id", turns.alias("turns"))


def chains(convs: DataFrame) -> DataFrame:
    """conv_id, id (digest of the whole), chain (digests of all prefixes, one after the other), sizes."""

    def make():
        def run(columns):
            ids, chain, sizes = [], [], []
            for turns in columns[1]:
                at, out = b"", []
                for t in turns:
                    at = hashlib.blake2b(at + t["digest"], digest_size=ID).digest()
                    out.append(at)
                ids.append(at)
                chain.append(b"".join(out))
                sizes.append([t["size"] for t in turns])
            return [columns[0], ids, chain, sizes]

        return run

    return map_rows(convs, make, "conv_id long, id binary, chain binary, sizes array<long>")


def ended(members: DataFrame) -> DataFrame:
    """Equal conversations as one row: id, chain, sizes, conv_id (smallest), n, sha (of the ascending ids).

    Ids are brought together in cells first and the digest runs over the cells
    of a conversation in order, so that no list of members is ever whole.
    """
    ids = F.concat_ws(",", F.transform(F.sort_array(F.collect_list("conv_id")), lambda v: v.cast("string")))
    cells = members.groupBy("id", F.expr(f"conv_id div {CELL}").alias("cell")).agg(
        F.first("chain").alias("chain"), F.first("sizes").alias("sizes"), F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n"), ids.alias("ids")
    )
    schema = "id binary, chain binary, sizes array<long>, conv_id long, n long, sha string"
    arrow = pa.schema([("id", pa.binary()), ("chain", pa.binary()), ("sizes", pa.list_(pa.int64())), ("conv_id", pa.int64()), ("n", pa.int64()), ("sha", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                if last and last["id"] == row["id"]:
                    last["sha"].update(b"," + row["ids"].encode())
                    last["n"] += row["n"]
                    continue
                if last:
                    done.append(last)
                last = {k: row[k] for k in ("id", "chain", "sizes", "conv_id", "n")} | {"sha": hashlib.sha256(row["ids"].encode())}
            if done:
                yield pa.RecordBatch.from_pylist([d | {"sha": d["sha"].hexdigest()} for d in done], schema=arrow)
        if last:
            yield pa.RecordBatch.from_pylist([last | {"sha": last["sha"].hexdigest()}], schema=arrow)

    return cells.repartition("id").sortWithinPartitions("id", "cell").mapInArrow(run, schema)


def prefix(depth: Column | int) -> Column:
    """Digest of the first ``depth`` turns (the root's is empty)."""
    depth = F.lit(depth) if isinstance(depth, int) else depth
    return F.when(depth < 1, F.lit(b"")).otherwise(F.col("chain").substr(ID * (depth - 1) + 1, F.lit(ID)))


def with_cut(convs: DataFrame, scratch: Scratch, longest: int, group: int) -> DataFrame:
    """``convs`` with the depth ``cut``, null for those that end above every cut."""
    weight = F.sum(F.least(F.size("sizes"), F.lit(LONG))).alias("weight")
    depths = [2**i for i in range(max(longest, 1).bit_length())]
    tries = convs.select("sizes", F.explode(F.filter(F.array(*map(F.lit, depths)), lambda d: d <= F.size("sizes"))).alias("cut"), "chain")
    large, seen = scratch.counted(tries.groupBy("cut", prefix(F.col("cut")).alias("at")).agg(weight).where(F.col("weight") > group).select("cut", "at"), "large", deepest=F.max("cut"))
    out, stop = convs.withColumn("cut", F.lit(None).cast("int")), seen["deepest"] or 0
    for d in depths:
        free = F.col("cut").isNull() & (F.size("sizes") >= d)
        if d > stop:  # no prefix of this depth is too large
            return out.withColumn("cut", F.when(free, d).otherwise(F.col("cut")))
        here = large.where(F.col("cut") == d).select("at", F.lit(True).alias("large"))
        out = out.withColumn("at", prefix(d)).join(here, "at", "left").withColumn("cut", F.when(free & F.col("large").isNull(), d).otherwise(F.col("cut"))).drop("at", "large")
    return out


def peel(rows: list[dict]) -> Iterator[tuple]:
    """Nodes of one group down to its cut: finished ones with their parent, those at the cut with id, chain and sizes."""
    cut = rows[0]["cut"]
    ends = defaultdict(list)
    for r in rows:
        ends[len(r["sizes"])].append(r)
    alive: dict[bytes, list] = {}  # id: conv_id, n, children, leaves, saved, sha, a row with this prefix
    below: list[tuple] = []
    for depth in range(max(ends), cut - 1, -1):
        for r in ends.get(depth, ()):
            node = alive.setdefault(r["id"], [r["conv_id"], 0, 0, 0, 0, NOTHING, r])
            node[0], node[1], node[5] = min(node[0], r["conv_id"]), node[1] + r["n"], r["sha"]
        for node in alive.values():
            node[3] = node[3] or 1
            node[4] += (node[1] - 1) * node[6]["sizes"][depth - 1]
        for parent, node in below:
            yield (node[0], depth + 1, alive[parent][0], *node[1:6], None, None, None)
        if depth == cut:
            break
        below, left = [], {}
        for node in alive.values():
            parent = node[6]["chain"][ID * (depth - 2) : ID * (depth - 1)]
            up = left.setdefault(parent, [node[0], 0, 0, 0, 0, NOTHING, node[6]])
            up[0], up[1], up[2], up[3], up[4] = min(up[0], node[0]), up[1] + node[1], up[2] + 1, up[3] + node[3], up[4] + node[4]
            below.append((parent, node))
        alive = left
    for key, node in alive.items():
        yield (node[0], cut, None, *node[1:6], key, node[6]["chain"][: ID * cut], node[6]["sizes"][:cut])


LOCAL = NODE + ", id binary, chain binary, sizes array<long>"


def peeled(convs: DataFrame) -> DataFrame:
    """Peel all groups down to their cuts: columns of ``NODE`` and, at the cut, id, chain and sizes."""
    arrow = pa.schema([*((c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in NODE.split(", ")), ("id", pa.binary()), ("chain", pa.binary()), ("sizes", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, out = [], []
        for batch in batches:
            for row in batch.to_pylist():
                if group and group[0]["at"] != row["at"]:
                    out.extend(peel(group))
                    group = []
                group.append(row)
                if len(out) > 5000:
                    yield pa.record_batch([pa.array(v, type=f.type) for v, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)
                    out = []
        if group:
            out.extend(peel(group))
        if out:
            yield pa.record_batch([pa.array(v, type=f.type) for v, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    return convs.withColumn("at", prefix(F.col("cut"))).repartition("at").sortWithinPartitions("at").mapInArrow(run, LOCAL)


def trie(convs: DataFrame, group: int = GROUP) -> DataFrame:
    """Nodes of the trie over ``convs`` (conv_id, turns: array of (digest, size)), with the columns of ``NODE``.

    Every conversation, a turnless one too, is a member of the root, which
    exists as soon as there is a conversation; no conversations give no rows.
    """
    spark = convs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "trie")
    members = scratch.table(chains(convs), "chains")
    whole, seen = scratch.counted(ended(members), "ended", longest=F.max(F.size("sizes")))
    if not seen["n"]:
        return spark.createDataFrame([], NODE)
    cuts, cut_at = scratch.counted(with_cut(whole, scratch, seen["longest"], group), "cuts", deepest=F.max("cut"), uncut=F.max(F.when(F.col("cut").isNull(), F.size("sizes"))))
    local = scratch.table(peeled(cuts.where("cut IS NOT NULL")), "peeled")

    def level(rows: DataFrame, d: int) -> DataFrame:
        """Nodes of depth ``d`` from the stripped nodes below and the conversations that end here."""
        size = F.lit(0) if d == 0 else F.element_at(F.first("sizes"), d)
        return rows.groupBy("id").agg(
            F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs"), F.sum("child").alias("n_children"),
            F.greatest(F.sum("leaves"), F.lit(1)).alias("n_leaves"), (F.sum("saved") + (F.sum("n") - 1) * size).alias("saved_tokens"),
            F.coalesce(F.max("sha"), F.lit(NOTHING)).alias("ends_sha256"), F.first("chain").alias("chain"), F.first("sizes").alias("sizes"),
        ).withColumn("depth", F.lit(d).cast("long"))

    def stripped(nodes: DataFrame, d: int) -> DataFrame:
        """Nodes of depth ``d`` without their last turn."""
        return nodes.select(
            prefix(d - 1).alias("id"), F.col("chain").substr(1, ID * (d - 1)).alias("chain"), F.slice("sizes", 1, d - 1).alias("sizes"), "conv_id", F.col("n_convs").alias("n"),
            F.lit(1).cast("long").alias("child"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"), F.lit(None).cast("string").alias("sha"),
        )

    zero = F.lit(0).cast("long")
    at_cut = local.where("id IS NOT NULL").drop("parent_conv_id")
    upper, above = [at_cut], None
    for d in range(max((cut_at["deepest"] or 0) - 1, cut_at["uncut"] or 0), -1, -1):
        rows = cuts.where(F.col("cut").isNull() & (F.size("sizes") == d)).select("id", "chain", "sizes", "conv_id", "n", zero.alias("child"), zero.alias("leaves"), zero.alias("saved"), "sha")
        rows = rows.unionByName(stripped(at_cut.where(F.col("depth") == d + 1), d + 1))
        above = scratch.table(level(rows if above is None else rows.unionByName(stripped(above, d + 1)), d), f"level{d}")
        upper.append(above)

    # children of the nodes above the cuts look their parents up; the children of one parent are dealt to many tasks
    names = [c.split()[0] for c in NODE.split(", ")]
    nodes = upper[0].select("id", "chain", *(c for c in names if c != "parent_conv_id"))
    for u in upper[1:]:
        nodes = nodes.unionByName(u.select(nodes.columns))
    parents = nodes.select(F.col("id").alias("up"), F.col("conv_id").alias("parent_conv_id"), F.explode(F.sequence(F.lit(0), F.lit(DEAL - 1))).alias("share"))
    linked = nodes.withColumn("up", F.when(F.col("depth") > 0, prefix(F.col("depth").cast("int") - 1))).withColumn("share", F.pmod(F.xxhash64("id"), F.lit(DEAL)).cast("int"))
    linked = linked.join(parents, ["up", "share"], "left")
    return local.where("id IS NULL").select(names).unionByName(linked.select(names))


def conversation_trie(df: DataFrame) -> DataFrame:
    """Trie of conversations (conv_id, turn, role, text) as they are.

    Turns are ordered by ``turn`` (null first; equal numbers by the digest of
    role and text), a null role or text is empty, rows without conv_id take no
    part, repeated rows are turns of their own, other columns are not read.
    """
    return trie(own_turns(df))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of rebuilt conversations; cases as in :func:`conversation_trie`."""
    return trie(rebuilt_turns(own_turns(read(spark, sf_dir, "conversations"))))


#: DuckDB has no crc32: its table-free form runs over the digits of the identifier.
ORACLE = """
WITH RECURSIVE crc(conv_id, s, i, c) AS (
  SELECT conv_id, conv_id::VARCHAR, 0, 4294967295::BIGINT FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)
  UNION ALL
  SELECT conv_id, s, i + 1, list_reduce(list_prepend(xor(c, ascii(s[i + 1])::BIGINT), [1, 2, 3, 4, 5, 6, 7, 8]::BIGINT[]),
    lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384::BIGINT) ELSE a // 2 END) FROM crc WHERE i < length(s)),
heads AS (SELECT conv_id, xor(c, 4294967295::BIGINT) % 9 AS h FROM crc WHERE i = length(s)),
own AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k, {'r': coalesce(role, ''), 't': coalesce(text, '')} AS v
  FROM conversations WHERE conv_id IS NOT NULL),
rebuilt AS (
  SELECT g.conv_id, o.k, o.v FROM heads g JOIN own o ON o.conv_id = g.conv_id - g.conv_id % 5 AND o.k <= g.h
  UNION ALL SELECT g.conv_id, g.h + o.k, o.v FROM heads g JOIN own o ON o.conv_id = g.conv_id AND o.k > g.h),
turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY k) AS d, v FROM rebuilt),
prefixes AS (SELECT conv_id, d, v.t AS last, list(v) OVER (PARTITION BY conv_id ORDER BY d) AS p FROM turns
  UNION ALL SELECT conv_id, 0, '', [] FROM heads),
members AS (SELECT *, min(conv_id) OVER (PARTITION BY d, p) AS node, max(d) OVER (PARTITION BY conv_id) AS len FROM prefixes),
nodes AS (
  SELECT node, d, count(*) AS n_convs, (count(*) - 1) * strlen(any_value(last)) AS saved,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE len = d), '')) AS ends_sha256, max(len) = d AS leaf
  FROM members GROUP BY node, d),
up AS (SELECT conv_id, d, node FROM members),
subtree AS (
  SELECT a.node, a.d, count(*) FILTER (WHERE n.leaf) AS n_leaves, sum(n.saved) AS saved_tokens, count(*) FILTER (WHERE n.d = a.d + 1) AS n_children
  FROM nodes n JOIN up a ON a.conv_id = n.node AND a.d <= n.d GROUP BY a.node, a.d)
SELECT n.node AS conv_id, n.d AS depth, p.node AS parent_conv_id, n.n_convs, s.n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN subtree s ON s.node = n.node AND s.d = n.d LEFT JOIN up p ON p.conv_id = n.node AND p.d = n.d - 1
"""
