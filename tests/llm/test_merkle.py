"""Merkle manifest against a tree built in plain Python."""

import hashlib
import zlib

import pytest

from wattline.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, g long, level int, first string, hash string"
COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def leaf(doc_id, source, lang, n, text):
    out = b""
    for v in (doc_id, source, lang, n, text):
        b = str(v).encode()
        out += b"-" if v is None else str(len(b)).encode() + b":" + b
    return sha(out)


def tree(hashes):
    """The root, and for every leaf its (left, right) siblings level by level."""
    paths, at, level = [[] for _ in hashes], list(range(len(hashes))), hashes
    while len(level) > 1:
        for i, p in enumerate(at):
            r = p // 3 * 3
            paths[i].append(("".join(level[r:p]), "".join(level[p + 1 : r + 3])))
            at[i] = p // 3
        level = [sha("".join(level[r : r + 3])) for r in range(0, len(level), 3)]
    return level[0], paths


def brute(rows):
    by = {}
    for d, text, lang, source, n, *_ in rows:
        odd = d is None or text is None or zlib.crc32(str(d).encode()) % 2
        changed = text if odd else text.replace("\n", "")
        by.setdefault(source, []).append((d, leaf(d, source, lang, n, text), leaf(d, source, lang, n, changed)))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        by[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = {s: tree([x[1] for x in by[s]]) for s in order}
    root, above = tree([trees[s][0] for s in order])
    out = []
    for s, up in zip(order, above):
        for (d, own, changed), path in zip(by[s], trees[s][1]):
            fold = changed
            for left, right in path + up:
                fold = sha(left + fold + right)
            out.append((d, own, trees[s][0], root, sha("".join(a + b for a, b in path + up)), fold, fold == root))
    return out


def table():
    sources = [None, "", "a", "ab", "ä", "z"]
    rows = [(i * 7 % 101, f"text {i}\nmore" if i % 3 else f"plain {i}", "en" if i % 2 else None, sources[i % 4], i, 0, 0, "x", "h") for i in range(90)]
    rows += [(500, "alone", "de", "z", 1, 0, 0, "x", "h"), (501, "pair\n", "de", "ä", 1, 0, 0, "x", "h"), (502, None, None, "ä", None, 0, 0, None, None)]
    rows += [rows[3], rows[3], (None, "no\nid", None, "a", None, 0, 0, None, None), (None, None, None, None, None, 0, 0, None, None)]
    rows += [(7, "tie a", "en", "a", 1, 0, 0, "x", "h"), (7, "tie b", "en", "a", 1, 0, 0, "x", "h"), (600, "line\n" * 60_000, "en", "ab", 1, 0, 0, "x", "h")]
    return rows


def result(df):
    return sorted(map(repr, (tuple(r) for r in df.select(*COLUMNS).collect())))


@pytest.mark.parametrize("block", [merkle.BLOCK, 4])
def test_every_column_agrees_with_a_tree_in_plain_python(spark, monkeypatch, block):
    monkeypatch.setattr(merkle, "SPREAD", 3)
    rows = table()
    df = merkle.manifest(spark.createDataFrame(rows, SCHEMA).repartition(3), block=block)
    assert result(df) == sorted(map(repr, brute(rows)))
    assert {r["verified"] for r in df.collect()} == {True, False}
    own = df.select("proof_sha256", "siblings").first()
    assert sha("".join(s.hex() for s in own["siblings"] or [])) == own["proof_sha256"]


@pytest.mark.parametrize("n", [1, 4])
def test_small_trees(spark, n):
    one = [(i, "x\n", "en", "s", 1, 0, 0, "", "") for i in range(n)]
    each = [(i, "x\n", "en", f"s{i}", 1, 0, 0, "", "") for i in range(n)]
    for rows in (one, each)[: 1 + (n > 1)]:
        assert result(merkle.manifest(spark.createDataFrame(rows, SCHEMA))) == sorted(map(repr, brute(rows)))


def test_empty_table_and_settings_left_alone(spark):
    limit = spark.conf.get("spark.sql.cteRecursionRowLimit")
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).count() == 0
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == limit
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("merkle_")]
