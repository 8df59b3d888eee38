"""A training step against the same step written out class by class, and its cost in calls."""

import sys
from dataclasses import replace

import numpy as np

from wattline.llm import language_model as lm


def vocabulary(how, n=300):
    counts = (10_000 / np.arange(1, n + 1)).astype(int).tolist()
    return lm.Vocabulary(list(range(n)), counts, sum(counts) + 500, n + 200, how)


def batch(vocab, how, n, seed):
    rng = np.random.default_rng(seed)
    draw = lambda *shape: np.minimum((vocab.rare + 1) * rng.random(shape) ** 2, vocab.rare).astype(np.int32)
    return draw(n, how.context), draw(n)


def written_out(p, seen, lay, prob, rng, how, context, word):
    """Parameters after one step, from sums over the words of each class."""
    order = np.argsort(word, kind="stable")
    word, context, k = word[order], context[order], how.noise
    q = (p["context"][context] * p["scale"]).sum(axis=1)
    per = prob.reshape(lay.classes, lay.width)
    class_p, in_class = per.sum(axis=1), per / per.sum(axis=1, keepdims=True)
    grad, dq = {x: np.zeros_like(v) for x, v in p.items()}, np.zeros_like(q)

    def contrast(name, rows, real, noise, share):
        def add(i, at, g):
            grad[name][at] += g * q[i]
            grad[f"{name}_bias"][at] += g
            dq[i] += g * p[name][at]

        for i, at in zip(rows, real):
            s = q[i] @ p[name][at] + p[f"{name}_bias"][at] - np.log(k * max(share[at], 1e-12))
            add(i, at, 1 / (1 + np.exp(-s)) - 1)
            for z in noise:
                s = q[i] @ p[name][z] + p[f"{name}_bias"][z] - np.log(k * max(share[z], 1e-12))
                add(i, z, 1 / (1 + np.exp(-s)))

    cls = word // lay.width
    contrast("class", range(len(word)), cls, np.minimum(np.searchsorted(np.cumsum(class_p), rng.random(k)), lay.classes - 1), class_p)
    for c in np.unique(cls):
        rows = np.flatnonzero(cls == c)
        noise = np.minimum(np.searchsorted(np.cumsum(in_class[c]), rng.random(k)), lay.width - 1) + c * lay.width
        contrast("word", rows, word[rows], noise, in_class.ravel())
    for i, at in enumerate(context):
        for j, c in enumerate(at):
            grad["context"][c] += dq[i] * p["scale"][j]
            grad["scale"][j] += dq[i] * p["context"][c]
    for x in p:
        seen[x] += grad[x] ** 2
        p[x] -= how.rate * grad[x] / np.sqrt(seen[x])


def test_a_step_is_that_of_each_class_by_itself():
    for size in (6, 7):
        how = replace(lm.Config(), words=100, classes=9, size=size, noise=5, batch=60)
        vocab = vocabulary(how)
        start = lm.initial(vocab, how)
        trainer = lm.Trainer(start, vocab, how, 3)
        p = {x: v.astype(np.float64) for x, v in start.items()}
        seen, rng = {x: np.full_like(v, 1e-2) for x, v in p.items()}, np.random.default_rng(3)
        prob = np.zeros(trainer.lay.classes * trainer.lay.width)
        prob[: trainer.lay.n] = vocab.unigram / vocab.unigram.sum()
        for i in range(4):
            context, word = batch(vocab, how, 60, i)
            trainer.step(context, word)
            written_out(p, seen, trainer.lay, prob, rng, how, context, word)
        for x, v in p.items():
            assert np.allclose(trainer.p[x], v, atol=2e-3), x


def test_calls_of_a_step_do_not_grow_with_the_classes():
    def calls(classes):
        how = replace(lm.Config(), words=256, classes=classes)
        vocab = vocabulary(how)
        trainer, seen = lm.Trainer(lm.initial(vocab, how), vocab, how, 1), []
        rows = batch(vocab, how, 512, 1)
        sys.setprofile(lambda frame, event, arg: seen.append(1) if event in ("call", "c_call") else None)
        try:
            trainer.step(*rows)
        finally:
            sys.setprofile(None)
        return len(seen)

    assert calls(64) < 1.2 * calls(2)
