"""The near-duplicate stage of the pipeline against brute force."""

import random

from wattline.llm import near


def edited(rng, words, share):
    return [f"new{rng.randrange(10**6)}" if rng.random() < share else w for w in words]


def test_near_stage_removes_similar_texts(spark):
    """Against brute force over five-word shingles, on copies around similarity 0.8, chains among them."""
    import corpus_pipeline

    rng = random.Random(3)
    texts = []
    for i in range(60):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(30, 300))]
        texts.append(base)
        for share in (0.005, 0.015, 0.03, 0.06):
            texts.append(edited(rng, texts[-1] if i % 2 else base, share))
    texts = [" ".join(t) for t in texts] + ["short one", "Short  one", "", None]
    order = list(range(len(texts)))
    rng.shuffle(order)
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in ((t or "").lower().split() for t in texts)]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    pairs = 0
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                pairs += 1
                parent[root(i)] = root(j)
    want = {}
    for i in range(len(texts)):
        want[root(i)] = min(want.get(root(i), 10**9), order[i])
    docs = spark.createDataFrame([(order[i], t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near(spark, docs.repartition(3), "unused")
    assert pairs > 150 and {r["doc_id"] for r in got.collect()} == set(want.values())


def test_near_stage_on_one_large_group(spark):
    rng = random.Random(4)
    base = [f"w{rng.randrange(3000)}" for _ in range(200)]
    rows = []
    for i in range(300):
        words = list(base)
        words[rng.randrange(200)] = f"new{i}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "__row long, text string")
    assert near.groups(df).select("group").distinct().count() == 1
    assert near.groups(df.limit(0)).count() == 0


def test_a_block_returns_a_forest_of_links():
    """Near copies around similarity 0.8 to each other: the same groups as all pairs, at most one link a row."""
    import numpy as np
    import pyarrow as pa

    rng = random.Random(5)
    base = [f"w{rng.randrange(3000)}" for _ in range(150)]
    sets = [near.shingles(" ".join(edited(rng, base, rng.choice((0.005, 0.02, 0.05)))).encode()) for _ in range(120)]
    asks = [i >= 80 for i in range(120)]
    columns = [[7] * 120, [0] * 120, asks, list(range(120)), list(range(120)), [s.tobytes() for s in sets]]
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary()]
    rows = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["key", "block", "asks", "node", "root", "s"])
    got = [(u, v) for b in near._meet(iter([rows.slice(0, 30), rows.slice(30)])) for u, v in zip(*(c.to_pylist() for c in b.columns))]

    def merged(links):
        group = list(range(120))
        for u, v in links:
            group = [group[v] if g == group[u] else g for g in group]
        first = {}
        return [first.setdefault(g, i) for i, g in enumerate(group)]

    similar = [(i, j) for i in range(120) for j in range(i) if not (asks[i] and asks[j]) and near.similarity(sets[i], sets[j]) >= near.LEAST]
    assert len(similar) > 300 and len(got) < 120 and set(got) <= set(similar) and merged(got) == merged(similar)
    assert np.unique(merged(got)).size > 1


def test_near_stage_asks_the_fingerprints_first(spark, monkeypatch):
    """The components of op4's operator are candidates; a link that the shingle sets do not bear out is none."""
    from pyspark.sql import Window, functions as F

    import corpus_pipeline

    asked, real = [], near.simhash.classes

    def all_one(docs, *columns, **more):
        asked.append(real(docs, *columns, **more).columns)
        return docs.select(F.col("id").alias("doc_id"), F.lit("0").alias("fingerprint"), F.min("id").over(Window.partitionBy()).alias("component_id"))

    monkeypatch.setattr(near.simhash, "classes", all_one)
    texts = ["a b c d e f g h i j k l", "A b c d e f g h i j k l", "m n o p q r s t u v w x", None]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near(spark, docs, "unused").select("doc_id").collect()
    assert {r["doc_id"] for r in kept} == {0, 2, 3}
    assert asked == [["doc_id", "fingerprint", "component_id"]]


def test_stage_rows_are_numbered_without_writing_texts(spark, tmp_path, monkeypatch):
    import corpus_pipeline

    spark.range(50).selectExpr("id AS doc_id", "concat('text ', id) AS text").repartition(4).write.parquet(f"{tmp_path}/d")
    written, real = [], corpus_pipeline.staged
    monkeypatch.setattr(corpus_pipeline, "staged", lambda df, name: written.append(name) or real(df, name))
    docs = spark.read.parquet(f"{tmp_path}/d")
    rows = corpus_pipeline._same_rows(docs)
    assert not written and sorted(rows.collect()) == sorted(rows.select("doc_id", "text", "__row").collect())
    assert rows.select("__row").distinct().count() == 50
    twice = corpus_pipeline._same_rows(docs.unionByName(docs))
    assert written == ["stage-rows"] and twice.select("__row").distinct().count() == 100
    few = corpus_pipeline._same_rows(docs.limit(0))
    assert few.count() == 0
