"""Toxicity by multiple-instance learning: only documents are labelled, sentences are scored.

A sentence is toxic with probability sigmoid(bias + the scores of its words); a document is clean only if all of its
sentences are (noisy-or). The parameters are fitted to document labels on a bounded sample; every text is
scored whole, and the sentences that carry the score are located.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import exp, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import id_fold

SENTENCE = re.compile(r"[^.!?\n]+")
EDGES = "\"'()[]{}<>.,;:!?*#%&$-_|"
MOST_WORDS = 500_000


@dataclass(frozen=True)
class Fit:
    """Bounds of the training sample (documents of each class, characters of one document) and of the search."""

    toxic: int = 2_500
    clean: int = 5_500
    max_chars: int = 20_000
    buckets: int = 1 << 18
    rounds: int = 150
    rate: float = 0.15
    ridge: float = 1e-5


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float


def features(word: bytes | str, buckets: int) -> tuple[int, ...]:
    """Buckets of a word, of its beginnings of three to six letters and of its ending."""
    w = word.strip(EDGES).lower()
    parts = ("=" + w, "<3" + w[:3], "<4" + w[:4], "<5" + w[:5], "<6" + w[:6], ">4" + w[-4:])
    return tuple(zlib.crc32(p.encode()) % buckets for p in parts)


def _sentences(text: str) -> Iterator[tuple[int, int, list[str]]]:
    for m in SENTENCE.finditer(text):
        words = m.group().split()
        if words:
            yield m.start(), m.end() - m.start(), words


def fit(texts: list[str], toxic: list[int], weights: list[float], how: Fit = Fit()) -> Model:
    """Gradient descent (Adam) on the noisy-or likelihood of document labels.

    Weights are kept at 0 or more: words are evidence for a toxic sentence, never against one, so a long
    sentence cannot outvote an insult.
    """
    vocab: dict[str, int] = {}
    token, sentence_of, doc_of = [], [], []
    for d, text in enumerate(texts):
        for _, _, words in _sentences(text):
            token += [vocab.setdefault(w, len(vocab)) for w in words]
            sentence_of += [len(doc_of)] * len(words)
            doc_of.append(d)
    if not token or len(set(toxic)) < 2:
        return Model(np.zeros(how.buckets, dtype=np.float32), 20.0 if set(toxic) == {1} else -20.0)
    tok, sent, doc = (np.array(x, dtype=np.int32) for x in (token, sentence_of, doc_of))
    token = sentence_of = doc_of = None
    feats = np.array([features(w, how.buckets) for w in vocab], dtype=np.int32)
    y, weight = np.array(toxic, dtype=bool), np.array(weights, dtype=np.float64)
    n_sent, n_docs = len(doc), len(texts)
    theta, bias = np.zeros(how.buckets), -6.0
    m, v, mb, vb = np.zeros(how.buckets), np.zeros(how.buckets), 0.0, 0.0
    scale = weight / weight.sum()
    for t in range(1, how.rounds + 1):
        word_score = theta[feats].sum(axis=1)
        z = bias + np.bincount(sent, weights=word_score[tok], minlength=n_sent)
        p = 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))
        odds = np.bincount(doc, weights=np.logaddexp(0.0, z), minlength=n_docs)
        clean = np.exp(-odds)
        pull = np.where(y, -clean / np.maximum(1.0 - clean, 1e-9), 1.0) * scale
        g = p * pull[doc]
        g_word = np.bincount(tok, weights=g[sent], minlength=len(feats))
        grad = np.bincount(feats.ravel(), weights=np.repeat(g_word, feats.shape[1]), minlength=how.buckets) + how.ridge * theta
        g_bias = g.sum()
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        mb, vb = 0.9 * mb + 0.1 * g_bias, 0.999 * vb + 0.001 * g_bias**2
        fix1, fix2 = 1 - 0.9**t, 1 - 0.999**t
        theta -= how.rate * (m / fix1) / (np.sqrt(v / fix2) + 1e-7)
        np.maximum(theta, 0.0, out=theta)
        bias -= how.rate * (mb / fix1) / (np.sqrt(vb / fix2) + 1e-7)
    return Model(theta.astype(np.float32), float(bias))


def train(
    docs: DataFrame, labels: DataFrame, how: Fit = Fit(), doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
) -> Model:
    """Fit on labelled documents outside the held-out fold (id remainder 0).

    The sample takes up to ``how.toxic`` and ``how.clean`` labelled ids in the order of their hash, and
    of their texts those of at most ``how.max_chars`` characters; both are bounds of the fit only.
    Classes are weighted back to their share. Null texts, labels and ids are not used for the fit.
    """
    per = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & (id_fold(doc_id, 5) != 0))
    per = per.groupBy(F.col(doc_id).alias("id")).agg(F.max(label).cast("int").alias("y")).where("y IN (0, 1)")
    counts = {r["y"]: r["n"] for r in per.groupBy("y").agg(F.count("*").alias("n")).collect()}
    order = [F.xxhash64("id"), F.col("id")]
    picked = per.where("y = 1").orderBy(*order).limit(how.toxic).unionByName(per.where("y = 0").orderBy(*order).limit(how.clean))
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t")).where(F.char_length("t") <= how.max_chars)
    # At most toxic + clean ids, a fixed bound.
    sample = sorted((r["id"], r["t"], r["y"]) for r in rows.join(F.broadcast(picked), "id").collect())
    taken = {y: max(1, sum(r[2] == y for r in sample)) for y in (0, 1)}
    weights = [counts[y] / taken[y] for _, _, y in sample]
    return fit([t for _, t, _ in sample], [y for _, _, y in sample], weights, how)


class _WordScores(dict):
    def __init__(self, model: Model):
        super().__init__()
        self.theta, self.buckets = model.weights.tolist(), len(model.weights)

    def __missing__(self, word: str) -> float:
        theta = self.theta
        score = self[word] = sum([theta[f] for f in features(word, self.buckets)])
        return score


def _softplus(z: float) -> float:
    return z if z > 30 else log1p(exp(z))


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", offending: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: doc_id, score, predicted, n_sentences, worst_start, worst_length, worst_score, spans.

    score is the noisy-or over all sentences of the whole text, 0 where there is none (null, empty or
    blank text). worst_* locate the likeliest sentence by code points (null without one); spans lists
    (start, length, probability) of all sentences at ``offending`` or more. Rows without doc_id and
    repeated rows are scored each. Other columns are ignored; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one number per bucket, a fixed size
    schema = (
        "doc_id long, score double, predicted int, n_sentences long, worst_start long, worst_length long, "
        "worst_score double, spans array<struct<start: long, length: long, probability: double>>"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _WordScores(shared.value)
        bias, get = shared.value.bias, words.__getitem__
        kinds = [pa.int64(), pa.float64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
        span = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("probability", pa.float64())]))
        names = [c.split()[0] for c in schema.split(", ")][:7] + ["spans"]
        for b in batches:
            rows = []
            for d, t in zip(b.column(0).to_pylist(), b.column(1)):
                odds, n, best, spans = 0.0, 0, (-1e9, None, None), []
                for start, length, sentence in _sentences(t.as_py() or ""):
                    z = bias + sum(map(get, sentence))
                    odds += _softplus(z)
                    n += 1
                    if z > best[0]:
                        best = (z, start, length)
                    if (p := 1 - exp(-_softplus(z))) >= offending:
                        spans.append({"start": start, "length": length, "probability": p})
                total = 1 - exp(-odds)
                rows.append((d, total, int(total >= 0.5), n, best[1], best[2], 1 - exp(-_softplus(best[0])) if n else None, spans))
                if len(words) > MOST_WORDS:
                    words.clear()
            cols = list(zip(*rows)) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [*kinds, span])], names)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("t"))
    return rows.mapInArrow(run, schema)
