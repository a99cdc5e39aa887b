"""Random numbers from hashes of row keys: the same on every retry of a task."""

from __future__ import annotations

import math

import numpy as np


def mixed(u: np.ndarray) -> np.ndarray:
    """64-bit numbers spread over all their bits."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        u = (u ^ (u >> np.uint64(shift))) * np.uint64(factor)
    return u ^ (u >> np.uint64(31))


def poisson_counts(keys, replicas: int):
    """Poisson(1) counts of each replica from hashes of row keys, one row per key: the same on every retry of a task."""
    # Probabilities until a term no longer shows in the sum.
    chances = [math.exp(-1) / math.factorial(k) for k in range(19)]
    u = keys.astype(np.uint64)[:, None] + np.arange(1, replicas + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return np.searchsorted(np.cumsum(chances), (mixed(u) >> np.uint64(11)) / 2.0**53, side="right").astype(np.float64)
