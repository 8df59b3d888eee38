"""Prefix trie against one built from whole tuples in plain Python."""

import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from wattline.llm import keyed, prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth long, weight string, n int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    turns = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            turns.setdefault(c, []).append((turn, role or "", text or ""))

    def tie(t):
        return (t[0] is not None, t[0] or 0, hashlib.sha256(f"{len(t[1].encode())}:{t[1]}{t[2]}".encode()).hexdigest())

    for c in turns:
        turns[c] = [t[1:] for t in sorted(turns[c], key=tie)]
    seqs = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        # The remainder has the sign of the number, as in SQL.
        seqs[c] = tuple(turns.get(c - int(math.fmod(c, 20)), [])[:h] + own[h:])
    members = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)

    def cost(p):
        return (len(members[p]) - 1) * len(re.findall("[^\\x20\\x09-\\x0D]+", p[-1][1])) if p else 0

    out = []
    for p in members:
        below, stack = [], [p]
        while stack:
            x = stack.pop()
            below.append(x)
            stack += children.get(x, [])
        ends = ",".join(str(c) for c in sorted(members[p]) if len(seqs[c]) == len(p))
        out.append((
            min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(children.get(p, [])),
            sum(x not in children for x in below), sum(map(cost, below)), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return out


def table():
    rng, rows = random.Random(3), []

    def conversation(c, texts):
        rows.extend((c, i, "user" if i % 2 else "assistant", t, 9, "x", 1) for i, t in enumerate(texts))

    for c in range(70):
        conversation(c, [f"t{rng.randint(0, 1)} " * rng.randint(1, 2) for _ in range(rng.randint(1, 6))])
    for c in range(100, 130):
        conversation(c, ["the same opening", "b c", "d\x0be"])
    conversation(200, [f"long {i}" for i in range(700)])
    conversation(203, [f"long {i}" for i in range(700)] + ["more"])
    conversation(-7, ["below zero", "x"])
    rows += [(300, None, "user", "no turn", 0, "x", 1), (300, 1, None, "no role", 0, "x", 1), (300, 2, "user", None, 0, "x", 1)]
    rows += [(301, 1, "user", "tie a", 0, "x", 1), (301, 1, "user", "tie b", 0, "x", 1), (301, 1, "user", "tie b", 0, "x", 1)]
    rows += [(None, 0, "user", "nobody's", 0, "x", 1), (None, None, None, None, None, None, None), (302, 0, "", "words " * 40_000, 0, "x", 1)]
    return rows


def result(df):
    return sorted(map(repr, (tuple(r) for r in df.select(*COLUMNS).collect())))


def test_every_node_agrees_with_a_trie_of_whole_tuples(spark):
    rows = table()
    got = prefix_trie.trie(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert result(got) == sorted(map(repr, brute(rows)))


def test_chunks_pieces_and_hot_keys_change_nothing(spark, monkeypatch):
    rows = table()
    plain = keyed.join_per_key
    monkeypatch.setattr(prefix_trie, "join_per_key", lambda *a: plain(*a, part=1 / 50, least=1))
    monkeypatch.setattr(prefix_trie, "IDS_PER_PIECE", 4)
    assert result(prefix_trie.trie(spark.createDataFrame(rows, SCHEMA), chunk=16)) == sorted(map(repr, brute(rows)))


@pytest.mark.parametrize("rows", [[], [(None, 1, "user", "x", 0, "", 0)]])
def test_no_conversation_gives_no_node(spark, rows):
    assert prefix_trie.trie(spark.createDataFrame(rows, SCHEMA)).count() == 0


def test_conversations_without_turns_are_the_root(spark):
    rows = [(1, 0, "user", "x", 0, "", 0)]
    got = prefix_trie.trie(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(repr, ((r["conv_id"], r["depth"], r["n_convs"]) for r in got))) == sorted(map(repr, ((x[0], x[1], x[3]) for x in brute(rows))))


def test_join_per_key_and_numbers(spark):
    rows = spark.range(5000).withColumn("k", F.when(F.col("id") < 3000, F.lit(0)).otherwise(F.col("id") % 50))
    per = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    got = keyed.join_per_key(rows, per, ["k"], "n")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.join(per.drop("n"), "k").collect()))
    numbered = keyed.number_in_order(rows.withColumn("o", -F.col("id")), [F.col("o")]).collect()
    assert all(r["idx"] == 4999 - r["id"] for r in numbered)
