"""Anchors of byte strings: positions that any two equal strings of a given length have in common.

A string of ``length`` bytes has ``length - size + 1`` windows of ``size`` bytes; the one with the smallest hash (the
first, if several) is its anchor. Equal strings have equal anchors at equal places.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    return np.cumprod(np.full(n, _BASE, np.uint64)), np.cumprod(np.full(n, _INVERSE, np.uint64))


def prefix_hashes(data: np.ndarray, up: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all prefixes: entry i belongs to the first i bytes."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= _MIX
    h ^= h >> np.uint64(32)
    h *= _MIX
    return h ^ (h >> np.uint64(32))


def window_hashes(prefix: np.ndarray, down: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    return mixed((prefix[stop] - prefix[start]) * down[start])


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Positions of the first smallest value in each window of ``width``."""
    n = len(values)
    pad = -n % width
    full = np.concatenate([values, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(full, 1).ravel()
    behind = np.minimum.accumulate(full[:, ::-1], 1)[:, ::-1].ravel()
    least = np.minimum(behind[: n - width + 1], ahead[width - 1 : n])
    # where the smallest value changes its place: from there on the next window with another least value
    order = np.flatnonzero(values[: n] == _holding(values, least, width))
    return order


def _holding(values: np.ndarray, least: np.ndarray, width: int) -> np.ndarray:
    """For each position the largest least value of the windows that hold it: equal to its own value where it is some window's least."""
    n, m = len(values), len(least)
    spread = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    pad = -len(spread) % width
    full = np.concatenate([spread, np.zeros(pad, np.uint64)]).reshape(-1, width)
    ahead = np.maximum.accumulate(full, 1).ravel()
    behind = np.maximum.accumulate(full[:, ::-1], 1)[:, ::-1].ravel()
    return np.maximum(behind[:n], ahead[width - 1 : width - 1 + n])
