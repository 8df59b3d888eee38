"""State maps of an ordered fold over one chunk.

Both ordered folds of a backtest (the position ramp and the equity curve) move a number by a
monotone, piecewise linear step. The effect of a whole chunk on an unknown start state is again
such a map, so chunks can be summarised in parallel, chained by a few numbers per chunk, and then
replayed in parallel from known start states. A map is a pair (xs, ys) of breakpoints; beyond the
last breakpoint it continues with slope 1, before the first it is constant.
"""

from __future__ import annotations

import numpy as np


def evaluate(xs, ys, x: float) -> float:
    if x >= xs[-1]:
        return float(ys[-1] + (x - xs[-1]))
    return float(np.interp(x, xs, ys))


def after(xs: np.ndarray, ys: np.ndarray, step, knots) -> tuple[np.ndarray, np.ndarray]:
    """Compose ``step`` after the map; ``knots`` are the states at which ``step`` bends."""
    add_x, add_y = [], []
    for knot in knots:
        j = int(np.searchsorted(ys, knot, side="right"))
        if j == 0:
            continue
        if j == len(ys):
            if knot > ys[-1]:
                add_x.append(xs[-1] + (knot - ys[-1]))
                add_y.append(knot)
        elif ys[j - 1] < knot < ys[j]:
            part = (knot - ys[j - 1]) / (ys[j] - ys[j - 1])
            add_x.append(xs[j - 1] + part * (xs[j] - xs[j - 1]))
            add_y.append(knot)
    if add_x:
        xs, ys = np.append(xs, add_x), np.append(ys, add_y)
        order = np.argsort(xs, kind="stable")
        xs, ys = xs[order], ys[order]
    ys = np.array([step(y) for y in ys])
    if len(xs) > 2:
        slope = np.diff(ys) / np.maximum(np.diff(xs), 1e-300)
        keep = np.concatenate([[True], slope[1:] != slope[:-1], [True]])
        xs, ys = xs[keep], ys[keep]
    return xs, ys


def ramp_step(state: float, target: float, max_change: float, limit: float) -> float:
    move = min(max(target - state, -max_change), max_change)
    return min(max(state + move, -limit), limit)


def ramp_path(targets, start: float, max_change: float, limit: float) -> np.ndarray:
    """Positions after each target, the start state first."""
    out = np.empty(len(targets) + 1)
    out[0] = state = start
    for i, target in enumerate(targets):
        state = ramp_step(state, target, max_change, limit)
        out[i + 1] = state
    return out


def ramp_map(targets, max_change: float, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Map of the whole chunk on [-limit, limit].

    The two extreme start states usually meet within a few rows, and then the map is one number.
    """
    low, high = -limit, limit
    for i, target in enumerate(targets):
        low = ramp_step(low, target, max_change, limit)
        high = ramp_step(high, target, max_change, limit)
        if low == high:
            end = float(ramp_path(targets[i + 1 :], low, max_change, limit)[-1])
            return np.array([-limit, limit]), np.array([end, end])
    xs, ys = np.array([-limit, limit]), np.array([-limit, limit])
    for target in targets:
        xs, ys = after(
            xs, ys, lambda y, t=target: ramp_step(y, t, max_change, limit), (target - max_change, target + max_change)
        )
    return xs, ys


def equity_step(equity: float, pnl: float, floor: float, cap: float) -> tuple[float, float]:
    """One period: the return is clipped to +-cap and equity never falls below the floor."""
    r = min(max(pnl / equity, -cap), cap)
    return max(equity * (1.0 + r), floor), r


def equity_path(pnl, start: float, floor: float, cap: float) -> tuple[np.ndarray, np.ndarray]:
    """(equity after each period with the start first, clipped return of each period)."""
    equity, returns = np.empty(len(pnl) + 1), np.empty(len(pnl))
    equity[0] = state = start
    for i, p in enumerate(pnl):
        state, returns[i] = equity_step(state, p, floor, cap)
        equity[i + 1] = state
    return equity, returns


def equity_map(pnl, floor: float, cap: float) -> tuple[np.ndarray, np.ndarray]:
    """Map of the whole chunk on [floor, infinity)."""
    xs, ys = np.array([floor]), np.array([floor])
    for p in pnl:
        if p == 0:
            continue
        knots = [abs(p) / cap] if p > 0 else [abs(p) / cap, floor / (1.0 - cap)]
        xs, ys = after(xs, ys, lambda y, p=p: equity_step(y, p, floor, cap)[0], knots)
    return xs, ys
