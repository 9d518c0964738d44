"""E8 lattice points: decoding and nearest neighbouring points, on arrays of 8-dimensional rows."""

from __future__ import annotations

from functools import lru_cache
from itertools import product

import numpy as np


def _even(x: np.ndarray) -> np.ndarray:
    """Nearest points of D8 (integers with an even sum)."""
    near = np.rint(x)
    off = x - near
    worst = np.abs(off).argmax(1)
    rows = np.flatnonzero(near.sum(1) % 2)
    w = worst[rows]
    near[rows, w] += np.where(off[rows, w] >= 0, 1, -1)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest E8 points, doubled to integers: the nearer of D8 and D8 shifted by one half."""
    a, b = _even(x), _even(x - 0.5) + 0.5
    first = ((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1)
    return (2 * np.where(first[:, None], a, b)).astype(np.int64)


@lru_cache(maxsize=1)
def shortest() -> np.ndarray:
    """The 240 shortest vectors of E8, doubled: two entries +-1, or all entries +-1/2 with an even number of minus signs."""
    out = []
    for i in range(8):
        for j in range(i):
            for s, t in product((2, -2), repeat=2):
                v = [0] * 8
                v[i], v[j] = s, t
                out.append(v)
    out += [list(v) for v in product((1, -1), repeat=8) if v.count(-1) % 2 == 0]
    return np.array(out)


def neighbours(x: np.ndarray, home: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` points next to the home point that are nearest to x, doubled; shape (rows, count, 8)."""
    steps = shortest()
    residue = 2 * x - home
    # |residue - step|^2 ranks as -2 residue.step, since all steps have one length
    order = np.argpartition(-(residue @ steps.T), count, axis=1)[:, :count]
    return home[:, None] + steps[order]
