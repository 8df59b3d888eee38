"""A small recurrent regressor in NumPy: one LSTM layer, a hidden layer, early stopping, best parameters restored."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class RecurrentParams:
    steps: int = 6
    hidden: int = 32
    head: int = 16
    dropout: float = 0.15
    rate: float = 1e-3
    epochs: int = 60
    patience: int = 6
    validation_fraction: float = 0.15
    min_validation_rows: int = 8
    min_fit_rows: int = 16
    short_epochs: int = 10
    seed: int = 42


class Scaler:
    """Mean and deviation of the rows it was fitted on; missing values become the mean."""

    def __init__(self, x: np.ndarray):
        with np.errstate(all="ignore"):
            n = np.maximum(np.isfinite(x).sum(axis=0), 1)
            clean = np.where(np.isfinite(x), x, 0.0)
            self.mean = clean.sum(axis=0) / n
            self.std = np.sqrt((np.where(np.isfinite(x), x - self.mean, 0.0) ** 2).sum(axis=0) / n)
        self.std[self.std < 1e-12] = 1.0

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.where(np.isfinite(x), (x - self.mean) / self.std, 0.0).astype(np.float32)


def sequences(x: np.ndarray, steps: int) -> np.ndarray:
    """(rows, steps, columns): each row with the rows before it; what lies before the first row is zero."""
    padded = np.concatenate([np.zeros((steps - 1, x.shape[1]), x.dtype), x])
    return np.lib.stride_tricks.sliding_window_view(padded, steps, axis=0).transpose(0, 2, 1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1.0)


class Network:
    """Gates of the LSTM are in the order input, forget, cell, output."""

    def __init__(self, columns: int, p: RecurrentParams):
        rng, h = np.random.default_rng(p.seed), p.hidden
        uniform = lambda bound, *shape: rng.uniform(-bound, bound, shape).astype(np.float32)
        a, b, c = h**-0.5, h**-0.5, p.head**-0.5
        self.w = {
            "wx": uniform(a, columns, 4 * h), "wh": uniform(a, h, 4 * h), "b": uniform(a, 4 * h),
            "w1": uniform(b, h, p.head), "b1": uniform(b, p.head), "w2": uniform(c, p.head, 1), "b2": uniform(c, 1),
        }
        self.p, self.rng = p, rng

    def forward(self, x: np.ndarray, train: bool = False) -> tuple[np.ndarray, list]:
        w, h = self.w, self.p.hidden
        state = cell = np.zeros((len(x), h), np.float32)
        tape = []
        for t in range(x.shape[1]):
            z = x[:, t] @ w["wx"] + state @ w["wh"] + w["b"]
            i, f, o = _sigmoid(z[:, :h]), _sigmoid(z[:, h : 2 * h]), _sigmoid(z[:, 3 * h :])
            g = np.tanh(z[:, 2 * h : 3 * h])
            before, prior = cell, state
            cell = f * cell + i * g
            out = np.tanh(cell)
            state = o * out
            tape.append((i, f, g, o, before, prior, out))
        hidden = np.maximum(state @ w["w1"] + w["b1"], 0.0)
        keep = (self.rng.random(hidden.shape) >= self.p.dropout) / (1.0 - self.p.dropout) if train else 1.0
        dropped = (hidden * keep).astype(np.float32)
        return (dropped @ w["w2"] + w["b2"])[:, 0], [tape, state, hidden, keep, dropped]

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean squared error and its gradients by backpropagation through the steps."""
        w, h = self.w, self.p.hidden
        pred, (tape, last, hidden, keep, dropped) = self.forward(x, train=True)
        error = (pred - y).astype(np.float32)
        d = (2.0 / len(y) * error)[:, None].astype(np.float32)
        grad = {k: np.zeros_like(v) for k, v in w.items()}
        grad["w2"], grad["b2"] = dropped.T @ d, d.sum(axis=0)
        back = (d @ w["w2"].T) * keep * (hidden > 0)
        back = back.astype(np.float32)
        grad["w1"], grad["b1"] = last.T @ back, back.sum(axis=0)
        ds, dc = back @ w["w1"].T, np.zeros((len(y), h), np.float32)
        for t in range(x.shape[1] - 1, -1, -1):
            i, f, g, o, before, prior, out = tape[t]
            dc = dc + ds * o * (1.0 - out**2)
            dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dc * i * (1 - g**2), ds * out * o * (1 - o)], axis=1)
            grad["wx"] += x[:, t].T @ dz
            grad["wh"] += prior.T @ dz
            grad["b"] += dz.sum(axis=0)
            ds, dc = dz @ w["wh"].T, dc * f
        return float(np.mean(error**2)), grad


def fit(x: np.ndarray, y: np.ndarray, p: RecurrentParams = RecurrentParams()) -> tuple[Network, dict]:
    """Train on scaled sequences in time order. The last rows decide when to stop and which parameters stay.

    A sample too small for such a tail trains a fixed few epochs.
    """
    net, n = Network(x.shape[2], p), len(y)
    tail = max(int(n * p.validation_fraction), p.min_validation_rows)
    checked = n - tail >= p.min_fit_rows
    cut = n - tail if checked else n
    best, kept, waited, epochs, stopped = float("inf"), None, 0, 0, False
    m = {k: np.zeros_like(v) for k, v in net.w.items()}
    v = {k: np.zeros_like(a) for k, a in net.w.items()}
    for epochs in range(1, (p.epochs if checked else min(p.epochs, p.short_epochs)) + 1):
        _, grad = net.gradients(x[:cut], y[:cut])
        for k, g in grad.items():
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            net.w[k] = net.w[k] - (p.rate * (m[k] / (1 - 0.9**epochs)) / (np.sqrt(v[k] / (1 - 0.999**epochs)) + 1e-8)).astype(np.float32)
        if not checked:
            continue
        loss = float(np.mean((net.forward(x[cut:])[0] - y[cut:]) ** 2))
        if loss < best:
            best, kept, waited = loss, {k: a.copy() for k, a in net.w.items()}, 0
        else:
            waited += 1
            if waited >= p.patience:
                stopped = True
                break
    if kept is not None:
        net.w = kept
    return net, {"epochs": epochs, "stopped": stopped, "best_loss": best if checked else None, "validation_rows": tail if checked else 0}
