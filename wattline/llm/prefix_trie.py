"""Prefix trie of conversations by collapsing whole sequences.

A conversation is a sequence of turns. Equal sequences are one weighted sequence; a sequence is a leaf unless
an anti-join finds it among the proper prefixes of others; nodes are grouped sums over the weighted prefixes.

A prefix is identified by its depth and the exclusive or of 120 bits of SHA-256 of each (place, role, text).
That is associative, so a prefix of a long conversation is the mark of the chunks before it and the turns of
its own chunk: no task holds more than a chunk of a conversation, and no pair of a turn and an ancestor is made.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import shuffle_partitions, staged
from .keyed import CRC32, join_per_key, number_in_order

CHUNK_TURNS = 512
#: Ids of members are joined to texts of at most this many ids before one task hashes them in order.
IDS_PER_PIECE = 4096
WORD = "[^\\x20\\x09-\\x0D]+"
KEY = ["depth", "k1", "k2"]


def _bits(digest: Column, first: int) -> Column:
    return F.conv(F.substring(digest, first, 15), 16, 10).cast("long")


def _empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def turns_in_order(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, digest, words): turns of each conversation numbered from 0 by turn, null first.

    Null role or text becomes empty. Ties of turn are ordered by digest. Rows without conv_id belong to no
    conversation.
    """
    role, text = _empty(F.col("role")), _empty(F.col("text"))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256).alias("digest"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"), F.monotonically_increasing_id().alias("row"),
    )
    turns = staged(turns, "turns")
    placed = number_in_order(turns, [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("digest"), F.col("row")], "at")
    per = placed.groupBy("conv_id").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    with_first = join_per_key(placed, per, ["conv_id"], "n")
    return with_first.select("conv_id", (F.col("at") - F.col("first")).alias("place"), "digest", "words")


def rebuild(turns: DataFrame, family: int = 20, borrowed: int = 4) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations as (conv_id, place, digest, words), and per conversation (conv_id, length).

    The first h turns of conversation c - c % family, as many as there are, then c's own turns after its first
    h, with h = crc32(decimal c) % borrowed. Of every conversation c is asked for, also if nothing remains.
    """
    turns = staged(turns, "placed-turns")
    per = staged(turns.groupBy("conv_id").agg(F.count("*").alias("n")), "conversations")
    h = F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % borrowed
    asked = per.select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("base"))
    first = per.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    asked = asked.join(first, "base", "left").withColumn("k", F.least("h", F.coalesce("base_n", F.lit(0))))
    asked = staged(asked.select("conv_id", "n", "h", "k", "base"), "asked")
    own = join_per_key(turns, asked.select("conv_id", "n", "h", "k"), ["conv_id"], "n").where("place >= h")
    own = own.select("conv_id", (F.col("place") - F.col("h") + F.col("k")).alias("place"), "digest", "words")
    heads = turns.where(F.col("place") < borrowed - 1).withColumnRenamed("conv_id", "base")
    lent = heads.join(asked.select("conv_id", "base", "k"), "base").where("place < k")
    rebuilt = own.unionByName(lent.select("conv_id", "place", "digest", "words"))
    length = F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    return rebuilt, asked.select("conv_id", length.alias("length"))


def prefixes(rebuilt: DataFrame, chunk: int = CHUNK_TURNS) -> DataFrame:
    """One row per conversation and depth from 1: its mark, its parent's mark, words of its last turn and before it."""
    mark = F.sha2(F.concat("place", F.lit(":"), "digest"), 256)
    marked = rebuilt.withColumn("m", mark).select(
        "conv_id", "place", "words", _bits(F.col("m"), 1).alias("m1"), _bits(F.col("m"), 16).alias("m2"),
        F.floor(F.col("place") / chunk).alias("chunk"),
    )
    marked = staged(marked, "marked")
    sums = marked.groupBy("conv_id", "chunk").agg(F.bit_xor("m1").alias("c1"), F.bit_xor("m2").alias("c2"), F.sum("words").alias("cw"))
    before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    carried = sums.select(
        "conv_id", "chunk", *[F.coalesce(f(c).over(before), none).alias(c) for f, c in ((F.bit_xor, "c1"), (F.bit_xor, "c2"), (F.sum, "cw"))]
    )
    inside = Window.partitionBy("conv_id", "chunk").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    both = marked.join(carried, ["conv_id", "chunk"])
    k1, k2 = F.col("c1").bitwiseXOR(F.bit_xor("m1").over(inside)), F.col("c2").bitwiseXOR(F.bit_xor("m2").over(inside))
    run = both.select("conv_id", "place", "words", "m1", "m2", k1.alias("k1"), k2.alias("k2"), (F.col("cw") + F.sum("words").over(inside)).alias("through"))
    return run.select(
        "conv_id", (F.col("place") + 1).alias("depth"), "k1", "k2", F.col("k1").bitwiseXOR(F.col("m1")).alias("p1"),
        F.col("k2").bitwiseXOR(F.col("m2")).alias("p2"), "words", (F.col("through") - F.col("words")).alias("words_before"),
    )


def sequence_ends(rebuilt_prefixes: DataFrame, lengths: DataFrame) -> DataFrame:
    """(conv_id, depth, k1, k2, total): each conversation's whole sequence as a mark, and its words."""
    none = F.lit(0).cast("long")
    last = rebuilt_prefixes.groupBy("conv_id").agg(
        F.max_by(F.struct("k1", "k2", (F.col("words_before") + F.col("words")).alias("total")), "depth").alias("end")
    )
    ends = lengths.join(last, "conv_id", "left").select(
        "conv_id", F.col("length").alias("depth"), F.coalesce("end.k1", none).alias("k1"), F.coalesce("end.k2", none).alias("k2"),
        F.coalesce("end.total", none).alias("total"),
    )
    return staged(ends, "sequence-ends")


def end_lists(ends: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256): SHA-256 of the member ids of each whole sequence, ascending, joined by commas.

    Ids are first joined to pieces by value, each of at most IDS_PER_PIECE ids; the pieces of a sequence then
    pass one task in order, which holds a hash and one piece.
    """
    piece = F.floor(F.col("conv_id") / IDS_PER_PIECE)
    pieces = ends.groupBy(*KEY, piece.alias("piece")).agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
    pieces = pieces.select(*KEY, "piece", F.array_join(F.col("ids").cast("array<string>"), ",").alias("text"))
    dealt = pieces.repartition(shuffle_partitions(ends.sparkSession), *KEY).sortWithinPartitions(*KEY, "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, h = None, None
        for b in batches:
            out = []
            keys = list(zip(*[b.column(i).to_pylist() for i in range(3)]))
            for key, text in zip(keys, b.column(4)):
                if key != now:
                    if now is not None:
                        out.append((*now, h.hexdigest()))
                    now, h = key, hashlib.sha256()
                else:
                    h.update(b",")
                h.update(text.as_buffer())
            if out:
                yield _record(out)
        if now is not None:
            yield _record([(*now, h.hexdigest())])

    return dealt.mapInArrow(run, "depth long, k1 long, k2 long, ends_sha256 string")


def _record(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [*KEY, "ends_sha256"])


def trie(conversations: DataFrame, family: int = 20, borrowed: int = 4, chunk: int = CHUNK_TURNS) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Input columns are conv_id, turn, role, text; others are ignored. Null role or text counts as empty, a null
    turn comes first, ties of turn are ordered by digest, repeated rows are turns of their own, rows without
    conv_id belong to no conversation. The root has depth 0, no text and all conversations, also those that
    have no turn left. An empty table gives no rows.
    """
    rebuilt, lengths = rebuild(turns_in_order(conversations), family, borrowed)
    every = staged(prefixes(rebuilt, chunk), "prefixes")
    ends = sequence_ends(every, lengths)
    # Equal sequences collapse into one with a weight, named after its smallest conversation.
    seqs = ends.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("weight"), F.max("total").alias("total"))
    seqs = staged(seqs, "sequences")
    # Prefixes of one conversation for each sequence. Every one also has the root, a row of its own.
    held = join_per_key(every, seqs.select("conv_id", "weight", "total", F.col("depth").alias("length")).withColumn("n", F.col("length")), ["conv_id"], "n")
    none = F.lit(0).cast("long")
    root = seqs.select(
        "conv_id", none.alias("depth"), none.alias("k1"), none.alias("k2"), none.alias("p1"), none.alias("p2"), none.alias("words"),
        none.alias("words_before"), "weight", "total", F.col("depth").alias("length"),
    )
    held = staged(held.unionByName(root), "weighted-prefixes")
    inner = held.where("depth < length").select(*KEY).distinct()
    leaves = staged(seqs.join(inner, KEY, "left_anti").select(*KEY, "conv_id", F.lit(1).cast("long").alias("leaf")), "leaves")
    # A leaf counts for all prefixes of its sequence.
    per_leaf = leaves.select("conv_id", "leaf", (F.col("depth") + 1).alias("n"))
    leafward = join_per_key(held.select("conv_id", *KEY), per_leaf, ["conv_id"], "n").groupBy(*KEY).agg(F.sum("leaf").alias("n_leaves"))
    nodes = held.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), F.sum("weight").alias("n_convs"), F.min("p1").alias("p1"), F.min("p2").alias("p2"),
        F.min("words_before").alias("words_before"), F.sum(F.col("weight") * (F.col("total") - F.col("words_before"))).alias("all_words"),
    )
    nodes = staged(nodes.join(leafward, KEY), "nodes")
    # Words of a subtree, each node once: a node belongs to the sequence of its smallest conversation, and the
    # nodes of a sequence are the deepest of its path, from depth ``from`` on.
    owned = nodes.groupBy("conv_id").agg(F.min(F.struct("depth", "words_before")).alias("o"))
    owned = owned.select("conv_id", F.col("o.depth").alias("from"), F.col("o.words_before").alias("words_till"))
    owned = seqs.select("conv_id", (F.col("depth") + 1).alias("n")).join(owned, "conv_id")
    path = join_per_key(held.select("conv_id", *KEY, "words_before", "total"), owned, ["conv_id"], "n")
    once = F.col("total") - F.greatest("words_before", F.when(F.col("depth") < F.col("from"), F.col("words_till")).otherwise(none))
    own_words = path.groupBy(*KEY).agg(F.sum(once).alias("node_words"))
    parent = [(F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")]
    children = nodes.where("depth > 0").groupBy(*parent).agg(F.count("*").alias("n_children"))
    out = nodes.join(own_words, KEY, "left").join(children, KEY, "left").join(end_lists(ends), KEY, "left").select(
        "conv_id", *KEY, "p1", "p2", "n_convs", F.coalesce("n_children", none).alias("n_children"), "n_leaves",
        (F.col("all_words") - F.coalesce("node_words", none)).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )
    out = staged(out, "trie")
    above = out.where("n_children > 0").select(
        F.col("depth").alias("pd"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"),
        F.col("n_children").alias("n"),
    )
    below = join_per_key(out.where("depth > 0").withColumn("pd", F.col("depth") - 1), above, ["pd", "p1", "p2"], "n")
    top = out.where("depth = 0").withColumns({"pd": F.lit(-1).cast("long"), "parent_conv_id": F.lit(None).cast("long")})
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return below.select(*cols).unionByName(top.select(*cols))


SQL = f"""
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS place,
         {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS t,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words
  FROM conversations WHERE conv_id IS NOT NULL
), asked AS (SELECT conv_id, conv_id - conv_id % 20 AS base, ({CRC32.format(x="conv_id")} % 4)::BIGINT AS h FROM (SELECT DISTINCT conv_id FROM turns)
), lent AS (
  SELECT a.conv_id, t.place, t.t, t.words FROM asked a JOIN turns t ON t.conv_id = a.base WHERE t.place < a.h
), rebuilt AS (
  SELECT * FROM lent UNION ALL
  SELECT a.conv_id, t.place - a.h + (SELECT count(*) FROM lent l WHERE l.conv_id = a.conv_id), t.t, t.words
  FROM asked a JOIN turns t ON t.conv_id = a.conv_id WHERE t.place >= a.h
), paths AS (
  SELECT conv_id, place + 1 AS depth, words, list(t) OVER (PARTITION BY conv_id ORDER BY place) AS path FROM rebuilt
  UNION ALL SELECT conv_id, 0, 0, [] FROM asked
), ends AS (
  SELECT p.conv_id, p.path, p.depth FROM paths p JOIN (SELECT conv_id, max(depth) AS depth FROM paths GROUP BY 1) USING (conv_id, depth)
), nodes AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words, path[:depth - 1] AS above
  FROM paths GROUP BY path, depth
), families AS (SELECT above, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1
), closed AS (SELECT path, depth, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256 FROM ends GROUP BY 1, 2
), full_nodes AS (
  SELECT n.*, coalesce(f.n_children, 0) AS n_children FROM nodes n LEFT JOIN families f ON f.above = n.path
), below AS (
  SELECT x.path, count(*) FILTER (WHERE y.n_children = 0) AS n_leaves, sum((y.n_convs - 1) * y.words)::BIGINT AS saved_tokens
  FROM (SELECT n.path AS own, unnest(list_transform(range(0, depth + 1), lambda d: path[:d])) AS path FROM nodes n) x
  JOIN full_nodes y ON y.path = x.own GROUP BY x.path
)
SELECT n.conv_id, n.depth::BIGINT AS depth, CASE WHEN n.depth > 0 THEN u.conv_id END AS parent_conv_id, n.n_convs, n.n_children,
       b.n_leaves, b.saved_tokens, coalesce(c.ends_sha256, sha256('')) AS ends_sha256
FROM full_nodes n JOIN below b ON b.path = n.path LEFT JOIN nodes u ON u.path = n.above LEFT JOIN closed c ON c.path = n.path
"""
