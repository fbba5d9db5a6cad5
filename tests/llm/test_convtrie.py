import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from hitloom.llm import convtrie as T


def brute(convs):
    """Nodes of {conv_id: [(role, text), ...]}."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved, out = {}, {}, set()
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0)
        ends = ",".join(str(c) for c in sorted(c for c in members[p] if len(convs[c]) == len(p)))
        out.add((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def in_order(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        own[c].append((t is not None, t or 0, r or "", x or ""))
    return {c: [v[2:] for v in sorted(rows)] for c, rows in own.items() if c is not None}


def rebuild(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    return out


def check(df, want):
    got = df.collect()
    assert df.columns == [c.split()[0] for c in T.NODE.split(", ")]
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    check(T.op13_conversation_trie(spark, sf_dir), brute(rebuild(in_order(rows))))


@pytest.mark.parametrize("group", [1, 40, 100_000])
def test_cuts_at_any_depth(spark, group):
    """Random conversations over few turns, with copies, a hot first turn and one very long conversation."""
    rng = random.Random(group)
    own = {c: [("u", "hot")] * (c % 3 == 0) + [("ua"[rng.random() < 0.5], "xyzé"[rng.randrange(4)] * rng.randrange(3)) for _ in range(rng.randrange(1, 7))] for c in rng.sample(range(10**6), 150)}
    own |= {c: [("u", "hot"), ("a", "same")] for c in range(5000, 9200, 37)}
    own[7] = own[2] = [("u", str(i % 7)) for i in range(18)]
    own[3] = own[7][:17]
    rows = [(c, i, r, x) for c, turns in own.items() for i, (r, x) in enumerate(turns)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    check(T.trie(T.own_turns(df), group), brute(own))


def test_cases(spark):
    rows = [(5, None, None, None), (5, 1, "u", "a"), (6, None, "u", "b"), (7, 0, "u", "a"), (None, 0, "u", "a"), (8, 2, "u", "a"), (8, 1, None, None), (9, 1, "", "z" * 100_000), (-3, 1, "u", "a"), (-3, 1, "u", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("id", F.lit(1)).withColumn("depth", F.lit("x"))
    check(T.conversation_trie(df), brute(in_order(rows)))
    check(T.trie(T.rebuilt_turns(T.own_turns(df.where("conv_id > 0 OR conv_id IS NULL")))), brute(rebuild({c: t for c, t in in_order(rows).items() if c > 0})))
    check(T.conversation_trie(df.limit(0)), set())


def test_only_turnless(spark):
    """A conversation whose own turns all lie before its head, without the first of its family."""
    c = next(c for c in range(1, 100) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    df = spark.createDataFrame([(c, 0, "u", "a")], "conv_id long, turn long, role string, text string")
    check(T.trie(T.rebuilt_turns(T.own_turns(df))), brute({c: []}))
