"""Chunk maps agree with the plain ordered fold from any start state."""

import numpy as np
from hypothesis import given, settings, strategies as st

from wattline.functions import maps

unit = st.floats(-1, 1, allow_nan=False)


@settings(max_examples=200, deadline=None)
@given(st.lists(unit, max_size=30), unit, st.sampled_from([0.05, 0.35, 2.5]))
def test_ramp_map(targets, start, change):
    xs, ys = maps.ramp_map(targets, change, 1.0)
    want = maps.ramp_path(targets, start, change, 1.0)[-1]
    assert abs(maps.evaluate(xs, ys, start) - want) < 1e-9


def test_ramp_map_that_never_meets():
    targets = [1.0, -1.0] * 20
    for start in np.linspace(-1, 1, 41):
        xs, ys = maps.ramp_map(targets, 0.1, 1.0)
        assert abs(maps.evaluate(xs, ys, start) - maps.ramp_path(targets, start, 0.1, 1.0)[-1]) < 1e-9


@settings(max_examples=200, deadline=None)
@given(st.lists(st.floats(-300, 300, allow_nan=False), max_size=25), st.floats(1e-6, 500))
def test_equity_map(pnl, start):
    floor, cap = 1e-6, 1 - 1e-6
    xs, ys = maps.equity_map(pnl, floor, cap)
    want = maps.equity_path(pnl, start, floor, cap)[0][-1]
    got = max(maps.evaluate(xs, ys, start), floor)
    assert abs(got - want) <= 1e-6 * max(1.0, want)
