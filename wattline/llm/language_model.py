"""Scoring texts with a log-bilinear neural language model trained by noise-contrastive estimation.

Word counts cover the whole training corpus and stay distributed. The commonest words form the model's
vocabulary, everything else is one class of rare words inside which counts decide. The context is the
sum of the position-wise scaled vectors of the last words; a word's class and the word within its class
each have a bilinear score, normalised over all classes and all words of the class by batched matrix
products. Training runs on every core in parallel, each on its own documents, and the parameters are
averaged after each round.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import id_fold, staged

END_KEY = "\n"  # no word holds white space, so this stands for the end of a text
MOST_WORDS = 400_000
#: Rows of a class that one matrix product takes.
PIECE = 16
#: Rows whose scores are computed at a time, so that they stay in the processor's cache.
CACHED = 2048


@dataclass(frozen=True)
class Config:
    """words: size of the model's vocabulary; common: words whose counts are sent to every task. Both are bounds."""

    words: int = 4096
    classes: int = 64
    common: int = 1 << 16
    size: int = 24
    context: int = 4
    #: Every position of the training texts is visited once, in one of so many rounds.
    rounds: int = 1
    noise: int = 20
    batch: int = 512
    rate: float = 0.1
    folds: int = 5
    held_out: int = 1


def word_hash(word: bytes) -> int:
    """XXH64 with seed 42 as a signed number."""
    h = xxhash.xxh64_intdigest(word, 42)
    return h - (1 << 64) if h >> 63 else h


END = word_hash(END_KEY.encode())


def _count(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        ends = 0

        def out() -> pa.RecordBatch:
            hashes = [END, *map(word_hash, counts)]
            return pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), pa.array([ends, *counts.values()], pa.int64())], ["h", "n"])

        for b in batches:
            for t in b.column(0):
                counts.update((t.as_py() or b"").lower().split())
                ends += 1
            if len(counts) > MOST_WORDS:
                yield out()
                counts.clear()
                ends = 0
        if ends or counts:
            yield out()

    return rows.select("t").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("c"))


class Vocabulary:
    """Common words by hash: number (0 is the end of a text, then by falling count) and counts."""

    def __init__(self, hashes: list[int], counts: list[int], total: int, distinct: int, how: Config):
        self.number = {h: i for i, h in enumerate(hashes)}
        c = np.array(counts, dtype=np.float64)
        self.total, self.distinct = total, distinct
        self.base = np.log10((c + 0.5) / (total + 0.5 * (distinct + 1)))
        self.counts = c
        words = min(how.words - 1, len(hashes))
        #: The last number of the model stands for all rare words.
        self.rare = words
        rare_total, rare_distinct = max(0.0, total - c[:words].sum()), max(0, distinct - words)
        self.rare_log = math.log10(rare_total + 0.5 * (rare_distinct + 1))
        self.within_rare = np.log10(c + 0.5) - self.rare_log
        self.unigram = np.concatenate([c[:words], [rare_total]]) + 0.5


class Layout:
    """Classes of model words: bands of like frequency, so that a class holds words / classes of them."""

    def __init__(self, n: int, classes: int):
        self.width = max(1, -(-n // classes))
        self.n, self.classes = n, -(-n // self.width)


def initial(vocab: Vocabulary, how: Config) -> dict[str, np.ndarray]:
    """Parameters that reproduce word frequencies: vectors small, biases from counts."""
    lay = Layout(vocab.rare + 1, how.classes)
    rng = np.random.default_rng(7)
    slots = lay.classes * lay.width
    p = np.zeros(slots)
    p[: lay.n] = vocab.unigram / vocab.unigram.sum()
    per = p.reshape(lay.classes, lay.width).sum(axis=1)
    with np.errstate(divide="ignore"):
        bias = np.maximum(np.log(p) - np.log(np.repeat(per, lay.width)), -60.0)
    small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
    return {
        "context": small(slots, how.size), "scale": np.ones((how.context, how.size), dtype=np.float32) / how.context,
        "word": small(slots, how.size) * 0.1, "word_bias": bias.astype(np.float32),
        "class": small(lay.classes, how.size) * 0.1, "class_bias": np.log(per).astype(np.float32),
    }


def pack_parameters(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def unpack_parameters(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def _order(index: np.ndarray, most: int) -> np.ndarray:
    """Stable order of indices below ``most``; short ones are sorted by their digits."""
    return np.argsort(index.astype(np.uint16) if most <= 1 << 16 else index, kind="stable")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.minimum(x, 30, out=x)
    np.maximum(x, -30, out=x)
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1.0
    return np.reciprocal(x, out=x)


class Trainer:
    """Noise-contrastive training with AdaGrad: a word is told from ``noise`` words drawn by frequency.

    A class or word and its bias share a row, so that ``p`` holds views of one table each; a context has 1 for the bias.
    """

    def __init__(self, p: dict[str, np.ndarray], vocab: Vocabulary, how: Config, seed: int):
        self.how, self.rng = how, np.random.default_rng(seed)
        self.lay = Layout(vocab.rare + 1, how.classes)
        slots = self.lay.classes * self.lay.width
        prob = np.zeros(slots)
        prob[: self.lay.n] = vocab.unigram / vocab.unigram.sum()
        per = prob.reshape(self.lay.classes, self.lay.width)
        class_p = per.sum(axis=1)
        self.class_cdf = np.cumsum(class_p)
        in_class = per / class_p[:, None]
        #: A class's distribution begins at its number, so that one search serves all classes.
        self.in_cdf = (np.cumsum(in_class, axis=1) + np.arange(self.lay.classes)[:, None]).ravel()
        self.expected = {
            "class": np.log(how.noise * np.maximum(class_p, 1e-12).astype(np.float32)),
            "word": np.log(how.noise * np.maximum(in_class.ravel(), 1e-12).astype(np.float32)),
        }
        self.rows = {x: _even(np.concatenate([p[x], p[f"{x}_bias"][:, None]], axis=1)) for x in ("class", "word")}
        self.rows |= {x: _even(p[x]) for x in ("context", "scale")}
        self.seen = {k: np.full_like(v, 1e-2) for k, v in self.rows.items()}
        size = how.size
        self.p = {x: v[:, :size] for x, v in self.rows.items()} | {f"{x}_bias": self.rows[x][:, size] for x in ("class", "word")}

    def _step(self, name: str, grad: np.ndarray, index: np.ndarray) -> None:
        seen = self.seen[name].take(index, axis=0)
        seen += grad * grad
        self.seen[name][index] = seen
        np.sqrt(seen, out=seen)
        grad *= self.how.rate
        grad /= seen
        self.rows[name][index] = self.rows[name].take(index, axis=0) - grad

    def step(self, context: np.ndarray, word: np.ndarray) -> None:
        """One batch. Noise is shared: by all for the class, by the words of a class within it.

        The words of a class are dealt to pieces of ``PIECE`` rows, the last one filled up with zeros, so that all
        classes are one product of matrices.
        """
        k, width, n, slots = self.how.noise, self.lay.width, len(word), len(self.rows["word"])
        order = _order(word, slots)
        word, context = word.take(order), context.take(order, axis=0)
        scale = self.rows["scale"]
        vectors = self.rows["context"].take(context.ravel(), axis=0).reshape(*context.shape, scale.shape[1])
        size = self.how.size
        q = np.zeros((n, self.rows["word"].shape[1]), dtype=np.float32)
        np.einsum("ijk,jk->ik", vectors[:, :, :size], scale[:, :size], out=q[:, :size])
        q[:, size] = 1.0
        cls = word // width
        starts = np.flatnonzero(np.concatenate([[True], cls[1:] != cls[:-1]]))
        present, sizes = cls[starts], np.diff(starts, append=n)
        noise = np.minimum(np.searchsorted(self.class_cdf, self.rng.random(k)), self.lay.classes - 1)
        drawn = self.rng.random((len(present), k)) + present[:, None]
        inside = np.minimum(np.searchsorted(self.in_cdf, drawn.ravel()).reshape(drawn.shape), present[:, None] * width + width - 1)

        rows = self.rows["class"]
        own, other = rows.take(cls, axis=0), rows.take(noise, axis=0)
        g = _sigmoid(np.einsum("ij,ij->i", q, own) - self.expected["class"].take(cls)) - 1.0
        g_noise = _sigmoid(q @ other.T - self.expected["class"].take(noise))
        dq = g[:, None] * own
        dq += g_noise @ other
        class_index, class_rows = np.concatenate([cls, noise]), np.concatenate([g[:, None] * q, g_noise.T @ q])

        rows = self.rows["word"]
        own = rows.take(word, axis=0)
        h = _sigmoid(np.einsum("ij,ij->i", q, own) - self.expected["word"].take(word)) - 1.0
        dq += h[:, None] * own
        pieces = -(-sizes // PIECE)
        first = np.cumsum(pieces) - pieces
        place = np.arange(n) + np.repeat(first * PIECE - starts, sizes)
        inside = np.repeat(inside, pieces, axis=0)
        other = rows.take(inside.ravel(), axis=0).reshape(*inside.shape, -1)
        asked = np.zeros((len(inside) * PIECE, q.shape[1]), dtype=np.float32)
        asked[place] = q
        asked = asked.reshape(len(inside), PIECE, -1)
        h_noise = np.matmul(asked, other.transpose(0, 2, 1))
        h_noise -= self.expected["word"].take(inside)[:, None, :]
        h_noise = _sigmoid(h_noise)
        dq += np.matmul(h_noise, other).reshape(-1, q.shape[1]).take(place, axis=0)
        # Rows that fill a piece up are zero, so their share of these products is zero too.
        to_noise = np.matmul(h_noise.transpose(0, 2, 1), asked).reshape(-1, q.shape[1])

        self._add("class", class_index, class_rows)
        self._add("word", np.concatenate([word, inside.ravel()]), np.concatenate([h[:, None] * q, to_noise]))
        dq = _even(dq[:, :size])
        to_scale = np.einsum("ik,ijk->jk", dq, vectors)
        self._add("context", context.ravel(), (dq[:, None, :] * scale).reshape(-1, scale.shape[1]))
        self._step("scale", to_scale, np.arange(len(scale)))

    def _add(self, name: str, index: np.ndarray, rows: np.ndarray) -> None:
        """A step by the sum of ``rows`` for each different index. Two numbers side by side are added up as one."""
        order = _order(index, len(self.rows[name]))
        index = index.take(order)
        starts = np.flatnonzero(np.concatenate([[True], index[1:] != index[:-1]]))
        total = np.add.reduceat(rows.take(order, axis=0).view(np.complex64), starts, axis=0).view(np.float32)
        self._step(name, total, index.take(starts))


def _even(rows: np.ndarray) -> np.ndarray:
    """An even number of columns, a last one of zeros where needed."""
    out = np.zeros((len(rows), rows.shape[1] + rows.shape[1] % 2), dtype=np.float32)
    out[:, : rows.shape[1]] = rows
    return out


class _Numbers(dict):
    """Word -> its number if common, otherwise its hash moved out of the range of numbers."""

    def __init__(self, number: dict[int, int]):
        super().__init__()
        self.number = number

    def __missing__(self, word: bytes) -> int:
        h = word_hash(word)
        n = self.number.get(h)
        if n is None:
            n = h if not 0 <= h < len(self.number) else -h - 1
        self[word] = n
        return n


def contexts(ids: np.ndarray, width: int) -> np.ndarray:
    """(n, width): the last ``width`` words before each, end markers before the first; nearest first."""
    padded = np.concatenate([np.zeros(width, dtype=ids.dtype), ids])
    return np.stack([padded[width - 1 - i : len(padded) - 1 - i] for i in range(width)], axis=1)


def train(rows: DataFrame, vocab: Vocabulary, how: Config) -> tuple[dict[str, np.ndarray], int]:
    """Parameters and positions visited. Training is parallel, over all of ``rows`` (t); only parameters, in at most 16
    sums a round, reach the driver.
    """
    spark = rows.sparkSession
    p, all_visited = initial(vocab, how), 0
    names = spark.sparkContext.broadcast(vocab)
    for round_ in range(how.rounds):
        sent = spark.sparkContext.broadcast(p)

        def run(batches: Iterator[pa.RecordBatch], round_=round_, sent=sent) -> Iterator[pa.RecordBatch]:
            part = TaskContext.get().partitionId()
            words = _Numbers(names.value.number)
            trainer, rare = Trainer(sent.value, names.value, how, 1000 * round_ + part), names.value.rare
            held, held_n, done = [], 0, 0
            for b in batches:
                for t in b.column(0):
                    tokens = (t.as_py() or b"").lower().split()
                    ids = np.fromiter(map(words.__getitem__, tokens), np.int64, len(tokens))
                    ids = np.append(np.where((ids < 0) | (ids > rare), rare, ids), 0).astype(np.int32)
                    seen = np.arange(round_, len(ids), how.rounds)
                    if len(seen):
                        held.append((contexts(ids, how.context)[seen], ids[seen]))
                        held_n += len(seen)
                    if held_n >= 16 * how.batch:
                        done += _visit(trainer, held, how)
                        held, held_n = [], 0
                if len(words) > MOST_WORDS:
                    words.clear()
            if held:
                done += _visit(trainer, held, how)
            flat = pack_parameters(trainer.p).astype("<f4").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([done]), pa.array([flat], pa.binary())], ["part", "n", "p"])

        workers = max(1, min(rows.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism))
        done = rows.select("t").coalesce(workers).mapInArrow(run, "part long, n long, p binary")
        done = done.where("n > 0").repartition(min(16, workers), F.col("part") % 16).sortWithinPartitions("part")
        sums = sorted(done.mapInArrow(_weighted_sum, "part long, n long, p binary").collect())
        visited = sum(r["n"] for r in sums)
        if not visited:
            continue
        all_visited += visited
        mean = sum(np.frombuffer(r["p"], dtype="<f8") for r in sums) / visited
        p = unpack_parameters(mean, p)
    return p, all_visited


def _visit(trainer: Trainer, held: list, how: Config) -> int:
    context, word = np.concatenate([c for c, _ in held]), np.concatenate([w for _, w in held])
    order = trainer.rng.permutation(len(word))
    for at in range(0, len(order), how.batch):
        pick = order[at : at + how.batch]
        trainer.step(context[pick], word[pick])
    return len(word)


def _weighted_sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n, first = None, 0, 0
    for b in batches:
        for part, k, flat in zip(*(c.to_pylist() for c in b.columns)):
            values = k * np.frombuffer(flat, dtype="<f4").astype(np.float64)
            total, first, n = (values, part, k) if total is None else (total + values, first, n + k)
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([first]), pa.array([n]), pa.array([total.tobytes()], pa.binary())], ["part", "n", "p"])


class Scorer:
    """Normalised log10 probabilities of model words in context."""

    def __init__(self, p: dict[str, np.ndarray], n: int, how: Config):
        self.lay, self.how = Layout(n, how.classes), how
        self.by_place = p["context"][None, :, :] * p["scale"][:, None, :]
        self.cls = np.ascontiguousarray(p["class"].T)
        self.cls_bias = p["class_bias"]
        w = self.lay.width
        self.words = [np.ascontiguousarray(p["word"][c * w : (c + 1) * w].T) for c in range(self.lay.classes)]
        self.bias = p["word_bias"].reshape(self.lay.classes, w)

    def log10(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        cls = word // self.lay.width
        q, out = np.empty((len(word), self.cls.shape[0]), dtype=np.float32), np.empty(len(word), dtype=np.float32)
        for at in range(0, len(word), CACHED):
            near = context[at : at + CACHED]
            part = self.by_place[0].take(near[:, 0], axis=0)
            for i in range(1, context.shape[1]):
                part += self.by_place[i].take(near[:, i], axis=0)
            q[at : at + CACHED] = part
            out[at : at + CACHED] = _log_share(part @ self.cls + self.cls_bias, cls[at : at + CACHED])
        order = _order(cls, self.lay.classes)
        ends = np.searchsorted(cls.take(order), np.arange(self.lay.classes + 1))
        for c in range(self.lay.classes):
            mine = order[ends[c] : ends[c + 1]]
            for at in range(0, len(mine), CACHED):
                part = mine[at : at + CACHED]
                inside = q.take(part, axis=0) @ self.words[c] + self.bias[c]
                out[part] += _log_share(inside, word.take(part) - c * self.lay.width)
        return out.astype(np.float64) / math.log(10)


def _log_share(scores: np.ndarray, picked: np.ndarray) -> np.ndarray:
    """Natural logarithm of each row's softmax at ``picked``; ``scores`` is overwritten."""
    own = scores[np.arange(len(picked)), picked]
    np.exp(scores, out=scores)
    return own - np.log(scores @ np.ones(scores.shape[1], dtype=np.float32))


def score(docs: DataFrame, how: Config = Config(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are words (A-Z lower-cased) and one end per text; null text counts as empty and has the end
    only. Counts and training use all texts outside the held-out fold, scores cover every whole text. base_score
    is the add-one-half unigram score, score the model's; a rare word scores its class in context plus its smoothed
    share of the class. Rows without doc_id are in fold 0; repeated rows count and are scored each. Without any
    training text all words are unknown. Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("t"))
    rows = rows.withColumn("held_out", id_fold("doc_id", how.folds) == how.held_out)
    learned = rows.where(~F.col("held_out"))
    counts = staged(_count(learned), "word-counts")
    total, distinct = counts.agg(F.sum("c"), F.count("*")).first()
    total, distinct = total or 0, distinct or 0
    end = counts.where(F.col("h") == END).agg(F.sum("c")).first()[0] or 0
    top = counts.where(F.col("h") != END).orderBy(F.desc("c"), "h").limit(how.common - 1).collect()  # a fixed bound
    vocab = Vocabulary([END, *(r["h"] for r in top)], [end, *(r["c"] for r in top)], total, distinct, how)
    p, _ = train(learned, vocab, how)
    model = spark.sparkContext.broadcast((vocab, p))
    common = len(vocab.number)
    schema = (
        "doc_id long, held_out boolean, n_tokens long, known long, base double, score double, n_rare long, "
        "rare array<long>"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab_, p_ = model.value
        words, scorer = _Numbers(vocab_.number), Scorer(p_, vocab_.rare + 1, how)
        for b in batches:
            for at in range(0, b.num_rows, 64):
                yield part(b.slice(at, 64), words, vocab_, scorer)
            if len(words) > MOST_WORDS:
                words.clear()

    def part(b: pa.RecordBatch, words: _Numbers, v: Vocabulary, scorer: Scorer) -> pa.RecordBatch:
        cols: list[list] = [[] for _ in range(6)]
        all_ids, all_contexts, lengths = [], [], []
        for t in b.column(1):
            tokens = (t.as_py() or b"").lower().split()
            ids = np.append(np.fromiter(map(words.__getitem__, tokens), np.int64, len(tokens)), 0)
            rare = (ids < 0) | (ids >= common)
            near = ids[~rare]
            model_ids = np.where(rare | (ids > v.rare), v.rare, ids).astype(np.int32)
            fixed = v.within_rare[near[near >= v.rare]].sum()
            known = int((v.counts[near] > 0).sum())
            for c, x in zip(cols, (len(ids), known, float(v.base[near].sum()), fixed, int(rare.sum()), ids[rare])):
                c.append(x)
            all_ids.append(model_ids)
            lengths.append(len(ids))
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        logs = []
        for ids in all_ids:
            all_contexts.append(contexts(ids, how.context))
        flat, ctx = np.concatenate(all_ids), np.concatenate(all_contexts)
        for at in range(0, len(flat), 1 << 15):
            logs.append(scorer.log10(ctx[at : at + (1 << 15)], flat[at : at + (1 << 15)]))
        neural = np.add.reduceat(np.concatenate(logs), starts) + np.array(cols[3])
        ends = np.concatenate([[0], np.cumsum(cols[4])]).astype(np.int32)
        rare_lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(cols[5])))
        arrays = [b.column(0), b.column(2), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64()), pa.array(neural, pa.float64()), pa.array(cols[4], pa.int64()), rare_lists]
        return pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in schema.split(", ")[:7]] + ["rare"])

    near = rows.select("doc_id", "t", "held_out").mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id())
    near = staged(near, "scored")
    rare = near.select("row", F.explode("rare").alias("h")).join(counts, "h", "left").withColumn("c", F.coalesce("c", F.lit(0).cast("long")))
    sums = rare.groupBy("row").agg(F.sum(F.log10(F.col("c") + 0.5)).alias("logs"), F.sum((F.col("c") > 0).cast("long")).alias("more"))
    out = near.drop("rare").join(sums, "row", "left")
    logs, more = F.coalesce("logs", F.lit(0.0)), F.coalesce("more", F.lit(0).cast("long"))
    base_norm = math.log10(total + 0.5 * (distinct + 1))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + more).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + logs - F.col("n_rare") * base_norm).alias("base_score"),
        (F.col("score") + logs - F.col("n_rare") * vocab.rare_log).alias("score"),
    )
