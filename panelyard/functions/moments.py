"""Means and centred cross sums of groups of rows, put together by the pairwise update.

A state is (n, mean, cross) with shapes (...), (..., d) and (..., d, d). States are only ever
added, never subtracted, so groups on very different scales do not cancel.
"""

from __future__ import annotations

import numpy as np

State = tuple[np.ndarray, np.ndarray, np.ndarray]


def merge(a: State, b: State) -> State:
    n = a[0] + b[0]
    known = np.where(n > 0, n, 1.0)
    gap = b[1] - a[1]
    mean = np.where((a[0] > 0)[..., None], a[1] + gap * (b[0] / known)[..., None], b[1])
    both = (a[0] * b[0] / known)[..., None, None]
    return n, mean, a[2] + b[2] + both * gap[..., :, None] * gap[..., None, :]


def running(state: State, axis: int) -> State:
    """States of the first 0, 1, ... groups along ``axis``."""
    parts = [tuple(np.zeros_like(np.take(s, 0, axis=axis)) for s in state)]
    for t in range(state[0].shape[axis]):
        parts.append(merge(parts[-1], tuple(np.take(s, t, axis=axis) for s in state)))
    return tuple(np.stack(s, axis=axis) for s in zip(*parts))


def outside(state: State, axis: int, before: np.ndarray, after: np.ndarray) -> State:
    """For each fold, the state of the first ``before`` groups and those from ``after`` on."""
    forward = running(state, axis)
    backward = running(tuple(np.flip(s, axis) for s in state), axis)
    total = state[0].shape[axis]
    return merge(
        tuple(np.take(s, before, axis=axis) for s in forward),
        tuple(np.take(s, total - after, axis=axis) for s in backward),
    )
