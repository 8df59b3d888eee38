"""Corpus operators against brute force on small tables with nulls, empty texts, ties and repeated rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattline.llm import (
    components, exact_dedup, fingerprints, golay, langid, language_model, line_dedup, mixing, packing, sharding, simhash,
    tokens, toxicity,
)
from wattline.llm.common import new_path
from wattline.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, shard int, key string"
RNG = random.Random(5)
WORDS = ["".join(RNG.choice("abcdefgh") for _ in range(RNG.randint(2, 7))) for _ in range(300)]


def prose(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


def corpus():
    """Columns size, shard and key clash with names the operators use."""
    texts = [prose(RNG.randint(5, 120)) for _ in range(120)]
    texts += [texts[0]] * 3 + [texts[1].replace(" ", "\n", 2)] + [None, "", "   ", "word", "A b", prose(20_000)]
    texts += [texts[2] + "\nThe very same line here\n x ", "other\n  THE VERY SAME LINE HERE\nThe very same line here"]
    rows = [(i, t, "en" if i % 3 else "de", f"s{i % 4}" if i % 7 else None, 0, "x", 9, "k") for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, "no id at all", None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return rows


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_golay_is_perfect():
    d = golay.decoder()
    assert (np.bincount(d) == 2048).all()
    words = np.random.default_rng(1).integers(0, 1 << 23, 500).astype(np.int32)
    near = golay.near_indices(words)
    for w, row in zip(words, near):
        assert set(row[row >= 0]) == {int(d[w])} | {int(d[w ^ (1 << b)]) for b in range(23)}


def brute_components(fps):
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(fps))]


def test_simhash_finds_every_link(spark, docs, none):
    got = simhash.classes(docs).collect()
    assert len(got) == len(ROWS) and simhash.classes(none).count() == 0
    fps = [int(r["fingerprint"], 16) for r in got]
    roots = brute_components(fps)
    smallest = defaultdict(list)
    for r, k in zip(got, roots):
        if r["doc_id"] is not None:
            smallest[k].append(r["doc_id"])
    for r, k in zip(got, roots):
        assert r["component_id"] == (min(smallest[k]) if smallest[k] else None)
    assert all(r["fingerprint"] == "0" * 16 for r in got if r["doc_id"] in (124, 125, 126))


def test_links_in_large_groups(spark):
    """Chains and stars within a few bits, in blocks smaller than the group."""
    rng = np.random.default_rng(3)
    fps = {0}
    for _ in range(600):
        x = int(rng.choice(sorted(fps))) if rng.random() < 0.9 else int(rng.integers(1 << 62))
        fps.add(x ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(1, 4), replace=False)))
    fps = sorted(fps)
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    got = dict(components.components(simhash.links(df, block=50)).collect())
    roots = brute_components(fps)
    groups = defaultdict(set)
    for x, k in zip(fps, roots):
        groups[k].add(got.get(x, x))
    assert all(len(g) == 1 for g in groups.values()) and len(set.union(*groups.values())) == len(groups)


def test_exact_dedup_and_the_index(spark, docs, none):
    got = exact_dedup.dedupe_once(docs).collect()
    texts = defaultdict(list)
    for r in ROWS:
        texts[r[1] or ""].append(r[0])
    sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in texts.items()}
    assert len(got) == len(ROWS) and exact_dedup.dedupe_once(none).count() == 0
    for r in got:
        ids = sha[r["text_sha256"]]
        known = [i for i in ids if i is not None]
        assert r["group_size"] == len(ids) and r["keep_id"] == (max(known) if known else None)
    assert sum(r["kept"] for r in got) == len(texts)
    index = exact_dedup.DigestIndex(spark, new_path(spark, "test-index"))
    first = exact_dedup.dedupe(docs.where("doc_id < 60"), index).where("kept").count()
    again = exact_dedup.dedupe(docs, index)
    assert first + again.where("kept").count() == len(texts)
    assert exact_dedup.dedupe(docs, index).where("kept").count() == 0


@pytest.mark.parametrize("batches", [1, 5])
def test_line_dedup(spark, docs, none, batches):
    got = line_dedup.dedupe_lines(docs, batches=batches).collect()
    assert line_dedup.dedupe_lines(none).count() == 0
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").lower()
    order = lambda i: 2**63 if i is None else i
    first = {}
    for r in ROWS:
        for line in (r[1] or "").split("\n"):
            first[key(line)] = min(first.get(key(line), 2**63), order(r[0]))
    want = Counter()
    for r in ROWS:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or first[key(x)] >= order(r[0])]
        want[(r[0], len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())] += 1
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in got) == want


def test_mix_meets_targets(spark, docs, none):
    got = mixing.mix(docs).collect()
    assert len(got) == len(ROWS) and mixing.mix(none).count() == 0
    assert sorted(map(tuple, mixing.mix(docs.repartition(7)).drop("row").collect()), key=str) == sorted((tuple(r)[1:] for r in got), key=str)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sum(r["size"] for r in got) == sum(size(r[1]) for r in ROWS)
    by = defaultdict(list)
    for r in got:
        by[r["source"]].append(r)
        assert 0 <= r["taken"] <= 2 * r["size"]
    order = sorted(by, key=lambda s: (s is None, s or ""))
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    sizes = {s: by[s][0]["source_size"] for s in order}
    low, high = 0.0, 1e9
    for _ in range(200):
        mid = (low + high) / 2
        if sum(min(mid * weights[s], 2 * sizes[s]) for s in order) < 1.5 * sum(sizes.values()):
            low = mid
        else:
            high = mid
    for s in order:
        assert abs(by[s][0]["target"] - min(low * weights[s], 2 * sizes[s])) < 1e-3
        assert sizes[s] == sum(r["size"] for r in by[s])
        longest = sorted(r["size"] for r in by[s])[-1]
        assert abs(sum(r["taken"] for r in by[s]) - by[s][0]["target"]) <= longest / 2 + 1


def test_flight_keeps_totals():
    sizes = sorted((RNG.randint(0, 500) for _ in range(400)), reverse=True)
    p0 = 0.37
    pi = mixing._flight([p0] * 400, [(1 / p0, s / p0) for s in sizes], random.Random(1), 2)
    assert sum(0 < p < 1 for p in pi) <= 2
    assert abs(sum(pi) - 400 * p0) < 1e-6 and abs(sum(p * s for p, s in zip(pi, sizes)) - p0 * sum(sizes)) < 1e-3


def test_encoder_is_the_tokenizer():
    e = tokens.EncoderCache.of(tokenizer_path())
    odd = ["", "don't I'LL \x1c x\x7f \x85 q\xa0r", "É é İ ΣΑΣ 日本 12a a1 ½", "<|endoftext|>", "a.b c, D. !?'s"]
    for t in odd + [r[1] or "" for r in ROWS]:
        assert e.ids(t.encode()).tolist() == e.words.tokenizer.encode(t, add_special_tokens=False).ids


def test_packing_covers_every_token(spark, docs, none):
    got = packing.pack_documents(docs, tokenizer_path(), block_tokens=5000).collect()
    assert packing.pack_documents(none, tokenizer_path()).count() == 0
    e = tokens.EncoderCache.of(tokenizer_path())
    sequences = defaultdict(list)
    pieces = Counter()
    for r in got:
        sequences[r["sequence_id"]].append(r)
        pieces[r["doc_id"]] += r["length"]
    want = Counter()
    for r in ROWS:
        want[r[0]] += len(e.ids((r[1] or "").encode(), 1))
    assert pieces == want
    ids = e.ids(ROWS[7][1].encode(), 1)
    for r in got:
        if r["doc_id"] == 7:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    for s in sequences.values():
        s.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in s] == [sum(x["length"] for x in s[:i]) for i in range(len(s))]
        total = sum(r["length"] for r in s)
        assert total <= 2048 and total & (total - 1) == 0


def test_sharding_is_balanced(spark, docs, none):
    small = docs.where("length(coalesce(text, '')) < 2000")
    got = sharding.shard_documents(small, slack=0.5).collect()
    assert len(got) == small.count() and sharding.shard_documents(none).count() == 0
    load, slots, where = Counter(), defaultdict(list), defaultdict(set)
    for r in got:
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        where[r["text_crc32"]].add(r["shard"])
    mean = sum(load.values()) / 8
    assert max(load.values()) <= 1.5 * mean
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in where.values())
    sizes = Counter(len((r[1] or "").encode()) + 1 for r in ROWS if len(r[1] or "") < 2000)
    assert Counter(r["size"] for r in got) == sizes


def test_a_group_larger_than_a_shard_is_split(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 2000, "same " * 10).otherwise(F.repeat(F.col("id").cast("string"), 10)).alias("text"))
    load = Counter()
    for r in sharding.shard_documents(rows).collect():
        load[r["shard"]] += r["size"]
    assert len(load) == 8 and max(load.values()) < 1.2 * sum(load.values()) / 8


def jaccard(a, b):
    keys = set(a) | set(b)
    return sum(min(a[k], b[k]) for k in keys) / max(1, sum(max(a[k], b[k]) for k in keys))


def test_fingerprints_agree_as_often_as_jaccard(spark, docs, none):
    unique = docs.dropDuplicates(["doc_id", "text"])
    got = fingerprints.fingerprint_edits(docs).collect()
    assert len(got) == len(ROWS) and fingerprints.fingerprint_edits(none).count() == 0
    rows = {(r["doc_id"], r["text"] or "") for r in unique.where("doc_id IS NOT NULL").collect()}
    texts = dict(rows)
    ids = sorted(texts)
    bag = lambda t: Counter(t.split())
    miss = []
    for r in got:
        if r["doc_id"] is None or r["doc_id"] == ids[-1]:
            continue
        t, nxt = texts[r["doc_id"]], texts[ids[ids.index(r["doc_id"]) + 1]]
        k = len(t) // 4
        edited = t[: len(t) - k] + nxt[:k]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        if t.split() and edited.split():
            miss += [r["near_edited"] - jaccard(bag(t), bag(edited))]
            if nxt.split():
                miss += [r["near_next"] - jaccard(bag(t), bag(nxt))]
    assert abs(np.mean(miss)) < 0.02 and np.std(miss) < 0.08
    by_text = defaultdict(set)
    for r in got:
        if r["doc_id"] is not None:
            by_text[texts[r["doc_id"]]].add(r["fingerprint"])
    assert all(len(s) == 1 for s in by_text.values())


def test_language_evidence(spark, none):
    rows = []
    for i in range(400):
        lang = "de" if i % 4 == 0 else "en"
        text = " ".join(RNG.choice(["und", "der", "nicht", "schön", "straße"] if lang == "de" else ["the", "and", "this", "other", "thing"]) for _ in range(12))
        rows.append((i, text if i > 20 else "xqv", lang if i % 10 else None, f"www.{lang}.example.org"))
    rows += [(400, None, None, None), (401, "123 !!", "en", "h"), (402, "", "de-AT", "x.de")]
    df = spark.createDataFrame(rows, "id long, t string, tag string, host string")
    got = {r["id"]: r for r in langid.identify(df).collect()}
    assert len(got) == len(rows)
    assert all(got[i]["language"] == ("de" if i % 4 == 0 else "en") for i in range(400) if i > 20 or i % 10)
    assert not any(got[i]["kept"] for i in (400, 401, 402))
    empty = none.select(F.col("doc_id").alias("id"), F.col("text").alias("t"), F.col("lang").alias("tag"), F.col("source").alias("host"))
    assert langid.identify(empty).count() == 0
    html = '<html class="a" lang="fr-CA"><script>var x</script><p>Bon&nbsp;jour</p></html>'
    page = spark.createDataFrame([(html, "https://u@a.b.example.fr:80/x")], "html string, url string")
    r = page.select(langid.declared_in(F.col("html")), langid.visible_text(F.col("html")), langid.host_of(F.col("url"))).first()
    assert r[0] == "fr-CA" and r[1].split() == ["Bon", "jour"] and r[2] == "a.b.example.fr"


def test_toxicity_learns_and_locates(spark, none):
    rows, labels = [], []
    for i in range(600):
        toxic = i % 5 == 0
        parts = [prose(8) for _ in range(4)]
        if toxic:
            parts[2] += f" stupid{RNG.choice('abc')} " + prose(2)
        rows.append((i, ". ".join(parts)))
        labels.append((i, int(toxic)))
    rows += [(600, None), (601, ""), (None, "stupida")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame(labels + [(7, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.score(df, toxicity.train(df, lab)).collect()
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 600 and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert np.mean([r["predicted"] == (r["doc_id"] % 5 == 0) for r in held]) > 0.98
    texts = dict(rows)
    assert all("stupid" in texts[r["doc_id"]][r["worst_start"] : r["worst_start"] + r["worst_length"]] for r in held if r["predicted"])
    assert [r["score"] for r in got if r["doc_id"] in (600, 601)] == [0.0, 0.0]
    assert toxicity.score(none, toxicity.train(none, lab.limit(0))).count() == 0


def test_language_model_is_normalised_and_beats_counts(spark, docs, none):
    rows = []
    for i in range(300):
        a = i % 2
        rows.append((i, " ".join(RNG.choice(WORDS[:40] if a else WORDS[40:80]) for _ in range(60))))
    rows += [(300, None), (301, ""), (None, "Unseen wordsx")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    how = language_model.Config(words=64, classes=8, common=128, batch=128)
    got = language_model.score(df, how).collect()
    counts = Counter()
    for i, t in rows:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1:
            counts.update((t or "").lower().split() + ["\n"])
    total, distinct = sum(counts.values()), len(counts)
    texts = dict(rows)
    for r in got:
        w = (texts[r["doc_id"]] or "").lower().split() + ["\n"]
        base = sum(np.log10((counts[x] + 0.5) / (total + 0.5 * (distinct + 1))) for x in w)
        assert abs(base - r["base_score"]) < 1e-6 and r["n_tokens"] == len(w) and r["n_known"] == sum(counts[x] > 0 for x in w)
        assert r["train_tokens"] == total
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert language_model.score(none).count() == 0
    vocab = language_model.Vocabulary([1, 2, 3, 4, 5], [9, 5, 4, 3, 2], 30, 8, language_model.Config(words=4, classes=2))
    p = language_model.initial(vocab, how)
    s = language_model.Scorer(language_model.initial(vocab, language_model.Config(words=4, classes=2)), 4, language_model.Config(words=4, classes=2))
    ctx = np.zeros((4, 4), dtype=np.int32)
    assert abs((10 ** s.log10(ctx, np.arange(4))).sum() - 1) < 1e-3 and p


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    docs = spark.createDataFrame(ROWS, SCHEMA).select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "unused")
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        if name == "exact_dedup":
            assert docs.count() == before.select("text").distinct().count()
        if name != "packing":
            assert docs.columns == before.columns
    assert docs.where("length > 0").count() == docs.count() > 0
