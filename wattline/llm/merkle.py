"""Merkle manifest of a table: stored levels of parent-linked node rows, and proofs climbed by a recursive query.

Every source is a tree over its rows in ascending doc_id; runs of three consecutive nodes get one parent. The
roots of the sources are the leaves of one more tree. Levels are built bottom up, one grouped join of runs each,
and stored as node rows: where the node is, its siblings to the left and right, and where its parent is.

A proof climbs from its own leaf to the root in a recursive query that joins the stored rows once per level: it
folds the hash and appends the place whose siblings it met. A node is met by all leaves below it, at the top by all
of a table. So each node row is stored once per block of neighbouring leaves that it covers, and a key of the climb
holds at most a block, whatever the tree's height. Spark shuffles every row of a recursion twice per level; so the
rows carry places, and the siblings at these places are put in from the stored rows of the block at the end.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import new_path, shuffle_partitions, staged
from .keyed import CRC32, join_per_key, number_in_order

ARITY = 3
#: Leaves that climb by the same copy of a node.
BLOCK = 81
#: Blocks listed in one row before the list is spread.
SPREAD = 50_000
#: Levels of the tree over the sources follow those of any source.
TOP = 100
#: A place is level * LEVEL + number of the first leaf below it, so places on a path ascend.
LEVEL = 1 << 48


def _field(c: Column) -> Column:
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_hash(text: Column, doc_id: str, source: str, lang: str, n_chars: str) -> Column:
    return F.sha2(F.concat(*[_field(F.col(c)) for c in (doc_id, source, lang, n_chars)], _field(text)), 256)


def without_newlines(text: Column) -> Column:
    return F.replace(text, F.lit("\n"), F.lit(""))


def _hex(c: Column) -> Column:
    return F.lower(F.hex(c))


def leaves(docs: DataFrame, doc_id: str, source: str, lang: str, n_chars: str, text: str, tampered: Column) -> DataFrame:
    """(g, doc_id, no_source, source, leaf, tampered_leaf): rows numbered by source (null first) and doc_id."""
    own = leaf_hash(F.col(text), doc_id, source, lang, n_chars)
    crc = F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8"))
    changed = leaf_hash(F.when(F.coalesce(crc % 2 == 0, F.lit(False)), tampered).otherwise(F.col(text)), doc_id, source, lang, n_chars)
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(source).isNull().alias("no_source"), F.coalesce(F.col(source), F.lit("")).alias("source"),
        F.unhex(own).alias("leaf"), F.unhex(changed).alias("tampered_leaf"), F.monotonically_increasing_id().alias("row"),
    )
    order = [F.col("no_source").desc(), F.col("source"), F.col("doc_id").asc_nulls_first(), F.col("leaf"), F.col("row")]
    return number_in_order(staged(rows, "leaf-hashes"), order, "g").drop("row")


def _runs(level: DataFrame, tree: list[str]) -> DataFrame:
    """Runs of up to three consecutive nodes (at, first, last, hash) as (run, nodes, hash), nodes in order."""
    node = F.struct("at", "first", "last", "hash")
    runs = level.groupBy(*tree, F.floor(F.col("at") / ARITY).alias("run")).agg(F.array_sort(F.collect_list(node)).alias("nodes"))
    hashes = F.array_join(F.transform("nodes", lambda n: _hex(n["hash"])), "")
    return runs.withColumn("hash", F.unhex(F.sha2(hashes, 256)))


def _linked(runs: DataFrame, parent_level: Column, parent_first: Column) -> DataFrame:
    """Node rows of the nodes in runs: where it is, which leaves it covers, its siblings, its parent."""
    parts = runs.select("*", parent_level.alias("parent_level"), parent_first.alias("parent_first"), F.posexplode("nodes").alias("i", "node"))

    def siblings(to_left: bool) -> Column:
        return F.array_join(F.transform(F.filter("nodes", lambda n: (n["at"] < F.col("node.at")) if to_left else (n["at"] > F.col("node.at"))), lambda n: _hex(n["hash"])), "")

    return parts.select(
        F.col("level"), F.col("node.first").alias("first"), F.col("node.last").alias("last"), siblings(True).alias("left"),
        siblings(False).alias("right"), "parent_level", "parent_first",
    )


def _tree(level: DataFrame, start: int, tree: list[str], rounds: int, above: int | None) -> tuple[list[DataFrame], DataFrame]:
    """Node rows of every level from ``start`` up, and the last node (first, last, hash) of each tree.

    ``level`` has (tree, size, at, first, last, hash). Trees of one node have no rows. Parents that are the last
    of their tree are placed at level ``above``, or at the next level where that is None.
    """
    rows, done, k = [], [level.where("size = 1")], start
    level = level.where("size > 1")
    for _ in range(rounds):
        runs = staged(_runs(level, [*tree, "size"]), "merkle-level").withColumn("level", F.lit(k))
        rest = F.ceil(F.col("size") / ARITY)
        next_level = F.lit(k + 1) if above is None else F.when(rest == 1, F.lit(above)).otherwise(F.lit(k + 1))
        rows.append(_linked(runs, next_level, F.col("nodes")[0]["first"]))
        up = runs.select(
            *tree, rest.alias("size"), F.col("run").alias("at"), F.col("nodes")[0]["first"].alias("first"),
            F.element_at("nodes", -1)["last"].alias("last"), "hash",
        )
        done.append(up.where("size = 1"))
        level, k = up.where("size > 1"), k + 1
    last = done[0].select(*tree, "first", "last", "hash")
    for d in done[1:]:
        last = last.unionByName(d.select(*tree, "first", "last", "hash"))
    return rows, last


def _height(n: int) -> int:
    h = 0
    while n > 1:
        n, h = -(-n // ARITY), h + 1
    return h


def build(rows: DataFrame) -> tuple[DataFrame | None, DataFrame, bytes | None, int]:
    """Node rows, subroots by source as (no_source, source, start, size, hash), the root and its place.

    ``rows`` are numbered leaves. Node rows are None where there is nothing to climb.
    """
    sources = staged(rows.groupBy("no_source", "source").agg(F.min("g").alias("start"), F.count("*").alias("size")), "sources")
    tallest = sources.agg(F.max("size")).first()[0]
    if tallest is None:
        return None, sources.withColumn("hash", F.lit(None).cast("binary")), None, 0
    # (no_source, source) is now named by the number of its first leaf.
    placed = join_per_key(rows, sources.withColumn("n", F.col("size")), ["no_source", "source"], "n")
    level = placed.select("start", "size", (F.col("g") - F.col("start")).alias("at"), F.col("g").alias("first"), F.col("g").alias("last"), F.col("leaf").alias("hash"))
    linked, subroots = _tree(staged(level, "merkle-leaves"), 0, ["start"], _height(tallest), TOP)
    subroots = staged(subroots, "subroots")
    ordered = staged(number_in_order(subroots, [F.col("start")], "at"), "ordered-subroots")
    n = ordered.count()
    top = ordered.select(F.lit(n).cast("long").alias("size"), F.lit(0).alias("all"), "at", "first", "last", "hash")
    upper, root = _tree(top, TOP, ["all"], _height(n), None)
    all_rows = None
    for part in [*linked, *upper]:
        place, parent = (F.col(l).cast("long") * LEVEL + F.col(f) for l, f in (("level", "first"), ("parent_level", "parent_first")))
        part = part.select(place.alias("place"), "first", "last", "left", "right", parent.alias("parent"))
        all_rows = part if all_rows is None else all_rows.unionByName(part)
    per_source = sources.join(subroots.select("start", "hash"), "start")
    return all_rows, per_source, bytes(root.first()["hash"]), (TOP + _height(n)) * LEVEL


def _per_block(nodes: DataFrame, block: int) -> DataFrame:
    """Node rows once for every block of leaves that they cover; long lists of blocks are spread first."""
    low, high = F.floor(F.col("first") / block), F.floor(F.col("last") / block)
    coarse = nodes.withColumns({"b0": low, "b1": high}).withColumn("part", F.explode(F.sequence(F.floor(F.col("b0") / SPREAD), F.floor(F.col("b1") / SPREAD))))
    from_, to = F.greatest("b0", F.col("part") * SPREAD), F.least("b1", (F.col("part") + 1) * SPREAD - 1)
    return coarse.withColumn("block", F.explode(F.sequence(from_, to))).drop("b0", "b1", "part", "first", "last")


def _store(nodes: DataFrame, block: int) -> str:
    """Write node rows as a table bucketed and sorted by what the climb joins on, so that only climbers move."""
    spark, n = nodes.sparkSession, shuffle_partitions(nodes.sparkSession)
    table, by = f"merkle_nodes_{uuid.uuid4().hex}", ["block", "place"]
    dealt = _per_block(nodes, block).repartition(n, *by)
    dealt.write.format("parquet").option("path", new_path(spark, "merkle-nodes")).bucketBy(n, *by).sortBy(*by).saveAsTable(table)
    return table


def climb(spark: SparkSession, start: DataFrame, nodes: DataFrame, root: int, block: int = BLOCK) -> DataFrame:
    """(g, folded, siblings): every leaf's hash folded up to the place ``root``, and the siblings met, lowest first.

    ``start`` has (g, place, hash): where each leaf begins to climb and with which hash. The recursive query makes
    one row per leaf and level.
    """
    table, view = _store(nodes, block), f"merkle_start_{uuid.uuid4().hex}"
    start.createOrReplaceTempView(view)
    # Spark stops a recursion at a million rows unless told otherwise; here its rows are leaves times levels.
    limit, before = "spark.sql.cteRecursionRowLimit", spark.conf.get("spark.sql.cteRecursionRowLimit")
    spark.conf.set(limit, "-1")
    try:
        paths = spark.sql(f"""
            WITH RECURSIVE climb(g, place, hash) AS (
              SELECT g, place, hash FROM {view}
              UNION ALL
              SELECT c.g, n.parent, unhex(sha2(concat(n.left, lower(hex(c.hash)), n.right), 256))
              FROM climb c JOIN {table} n ON c.g DIV {block} = n.block AND c.place = n.place
            )
            SELECT g, first(if(place = {root}, hash, NULL), true) AS folded, array_sort(collect_list(if(place < {root}, place, NULL))) AS path
            FROM climb GROUP BY g""")
        paths = staged(paths.withColumn("block", F.expr(f"g DIV {block}")), "merkle-paths")
        met = F.map_from_entries(F.collect_list(F.struct("place", F.unhex(F.concat("left", "right")))))
        blocks = spark.read.table(table).groupBy("block").agg(met.alias("met"))
        proofs = paths.join(blocks, "block", "left")
        return staged(proofs.select("g", "folded", F.transform("path", lambda p: F.element_at("met", p)).alias("siblings")), "proofs")
    finally:
        spark.conf.set(limit, before)
        spark.catalog.dropTempView(view)
        spark.sql(f"DROP TABLE IF EXISTS {table}")


def manifest(
    docs: DataFrame, doc_id: str = "doc_id", source: str = "source", lang: str = "lang", n_chars: str = "n_chars", text: str = "text",
    tampered: Column | None = None, block: int = BLOCK,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, leaf, subroot, root, proof_sha256, siblings, folded_root, verified.

    ``tampered`` is the text that rows whose crc32(decimal doc_id) is even are folded with (default: the text
    without its newlines). siblings holds the proof itself, per level the hashes of the run's other nodes, left
    to right, as bytes. Nulls are part of a leaf's hash. Rows without source are a source of their own that comes
    first; rows without doc_id come first in their source and are not tampered with; rows with equal source and
    doc_id are ordered by leaf, and repeated rows are leaves of their own. A source of one row has its leaf as
    subroot, a table of one source has its subroot as root. An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    changed = without_newlines(F.col(text)) if tampered is None else tampered
    rows = staged(leaves(docs, doc_id, source, lang, n_chars, text, changed), "numbered-leaves")
    nodes, sources, root, top = build(rows)
    root_hex = root.hex() if root else None
    per = sources.select("no_source", "source", F.col("hash").alias("subroot"), F.col("size").alias("n"), (F.col("size") == 1).alias("alone"))
    rows = staged(join_per_key(rows, per, ["no_source", "source"], "n"), "leaves-and-subroots")
    if nodes is None:
        proofs = rows.select("g", F.col("tampered_leaf").alias("folded"), F.lit(None).cast("array<binary>").alias("siblings"))
    else:
        begin = F.when(F.col("alone"), F.lit(TOP * LEVEL)).otherwise(F.lit(0))
        start = rows.select("g", (begin + F.col("g")).alias("place"), F.col("tampered_leaf").alias("hash"))
        proofs = climb(spark, start, nodes, top, block)
    joined = rows.join(proofs, "g")
    proof = F.array_join(F.transform(F.coalesce("siblings", F.array()), _hex), "")
    return joined.select(
        "doc_id", _hex(F.col("leaf")).alias("leaf"), _hex(F.col("subroot")).alias("subroot"), F.lit(root_hex).cast("string").alias("root"),
        F.sha2(proof, 256).alias("proof_sha256"), "siblings", _hex(F.col("folded")).alias("folded_root"),
        (_hex(F.col("folded")) == F.lit(root_hex)).alias("verified"),
    )


def _sql_leaf(text: str) -> str:
    parts = [f"coalesce(octet_length(encode({x}::VARCHAR))::VARCHAR || ':' || {x}::VARCHAR, '-')" for x in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(parts)})"


SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, t, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST) - 1 AS pos, count(*) OVER (PARTITION BY t) AS size, leaf, tampered
  FROM (SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) AS t, {_sql_leaf("text")} AS leaf,
               {_sql_leaf("CASE WHEN " + CRC32.format(x="doc_id") + " % 2 = 0 THEN replace(text, chr(10), '') ELSE text END")} AS tampered FROM documents)
), source_levels(t, level, pos, size, hash) AS (
  SELECT t, 0, pos, size, leaf FROM leaves
  UNION ALL
  SELECT t, level + 1, pos // 3, (size + 2) // 3, sha256(string_agg(hash, '' ORDER BY pos)) FROM source_levels WHERE size > 1 GROUP BY t, level, pos // 3, size
), subroots AS (SELECT t, level, hash, row_number() OVER (ORDER BY t) - 1 AS pos, count(*) OVER () AS size FROM source_levels WHERE size = 1
), top_levels(level, pos, size, hash) AS (
  SELECT 100, pos, size, hash FROM subroots
  UNION ALL
  SELECT level + 1, pos // 3, (size + 2) // 3, sha256(string_agg(hash, '' ORDER BY pos)) FROM top_levels WHERE size > 1 GROUP BY level, pos // 3, size
), placed AS (
  SELECT t, level, pos, hash, size FROM source_levels WHERE size > 1 UNION ALL SELECT 0, level, pos, hash, size FROM top_levels WHERE size > 1
), nodes AS (
  SELECT t, level, pos, size,
         coalesce(string_agg(hash, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lefts,
         coalesce(string_agg(hash, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rights
  FROM placed WINDOW w AS (PARTITION BY t, level, pos // 3 ORDER BY pos)
), links AS (
  SELECT n.t, n.level, n.pos, lefts, rights,
         CASE WHEN n.t > 0 AND n.size <= 3 THEN 0 ELSE n.t END AS next_t,
         CASE WHEN n.t > 0 AND n.size <= 3 THEN 100 ELSE n.level + 1 END AS next_level,
         CASE WHEN n.t > 0 AND n.size <= 3 THEN s.pos ELSE n.pos // 3 END AS next_pos
  FROM nodes n LEFT JOIN subroots s ON s.t = n.t
), climb(leaf_t, leaf_pos, t, level, pos, hash, proof) AS (
  SELECT l.t, l.pos, CASE WHEN l.size = 1 THEN 0 ELSE l.t END, CASE WHEN l.size = 1 THEN 100 ELSE 0 END, CASE WHEN l.size = 1 THEN s.pos ELSE l.pos END, l.tampered, ''
  FROM leaves l JOIN subroots s ON s.t = l.t
  UNION ALL
  SELECT c.leaf_t, c.leaf_pos, k.next_t, k.next_level, k.next_pos, sha256(k.lefts || c.hash || k.rights), c.proof || k.lefts || k.rights
  FROM climb c JOIN links k ON k.t = c.t AND k.level = c.level AND k.pos = c.pos
), done AS (SELECT leaf_t, leaf_pos, max_by(hash, level) AS folded_root, max_by(proof, level) AS proof FROM climb GROUP BY 1, 2
), root AS (SELECT hash FROM top_levels WHERE size = 1)
SELECT l.doc_id, l.leaf, s.hash AS subroot, r.hash AS root, sha256(d.proof) AS proof_sha256, d.folded_root, d.folded_root = r.hash AS verified
FROM leaves l JOIN subroots s ON s.t = l.t JOIN done d ON d.leaf_t = l.t AND d.leaf_pos = l.pos CROSS JOIN root r
"""
