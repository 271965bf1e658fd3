"""Reproducible random numbers keyed by seed, row index or row content.

The generators follow their published definitions (the JDK's linear congruential generator, its
polar Gaussian and its SplittableRandom), so that seeded draws are the same on every partitioning.
"""

from __future__ import annotations

import math

import numpy as np

MASK48 = (1 << 48) - 1
MASK64 = (1 << 64) - 1
#: Fixed values of the published generators.
LCG_MULTIPLIER, LCG_INCREMENT = 0x5DEECE66D, 0xB
GOLDEN = 0x9E3779B97F4A7C15
MIX_1, MIX_2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


class JavaRandom:
    """``java.util.Random``."""

    def __init__(self, seed: int):
        self.state = (seed ^ LCG_MULTIPLIER) & MASK48
        self.spare: float | None = None

    def bits(self, n: int) -> int:
        self.state = (self.state * LCG_MULTIPLIER + LCG_INCREMENT) & MASK48
        value = self.state >> (48 - n)
        return value - (1 << n) if n == 32 and value >= 1 << 31 else value

    def next_int(self, bound: int | None = None) -> int:
        if bound is None:
            return self.bits(32)
        r = self.bits(31)
        if bound & (bound - 1) == 0:
            return (bound * r) >> 31
        while r - r % bound + bound - 1 >= 1 << 31:
            r = self.bits(31)
        return r % bound

    def next_double(self) -> float:
        return ((self.bits(26) << 27) + self.bits(27)) * 2.0**-53

    def next_gaussian(self) -> float:
        if self.spare is not None:
            value, self.spare = self.spare, None
            return value
        while True:
            a, b = 2 * self.next_double() - 1, 2 * self.next_double() - 1
            s = a * a + b * b
            if 0 < s < 1:
                m = math.sqrt(-2 * math.log(s) / s)
                self.spare = b * m
                return a * m


def permutation(n: int, seed: int) -> list[int]:
    """A seeded Fisher-Yates permutation of 0..n-1."""
    out, rng = list(range(n)), JavaRandom(seed)
    for size in range(n, 1, -1):
        k = rng.next_int(size)
        out[size - 1], out[k] = out[k], out[size - 1]
    return out


def take_random(rows: list, n: int, seed: int) -> list:
    """n rows of a seeded permutation; all rows, in that order, if there are no more."""
    order = permutation(len(rows), seed)
    return [rows[i] for i in order[:n]]


def _finalise(z: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = (z ^ (z >> np.uint64(30))) * np.uint64(MIX_1)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(MIX_2)
        return z ^ (z >> np.uint64(31))


def row_uniform(features: np.ndarray, weights: np.ndarray, seed: int) -> np.ndarray:
    """A number in [0, 1) for each row, from the bits of its coordinates and weight."""
    h = _finalise(np.full(len(features), (seed + GOLDEN) & MASK64, np.uint64))
    for k in range(features.shape[1]):
        h = _finalise(h ^ np.ascontiguousarray(features[:, k], np.float64).view(np.uint64))
    h = _finalise(h ^ np.ascontiguousarray(weights, np.float64).view(np.uint64))
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53


class SplittableRandom:
    """``java.util.SplittableRandom`` with the default increment."""

    def __init__(self, seed: int):
        self.state = seed & MASK64

    def next_long(self) -> int:
        self.state = (self.state + GOLDEN) & MASK64
        z = ((self.state ^ (self.state >> 30)) * MIX_1) & MASK64
        z = ((z ^ (z >> 27)) * MIX_2) & MASK64
        return z ^ (z >> 31)

    def next_double(self) -> float:
        return (self.next_long() >> 11) * 2.0**-53


def geometric_skips(seed: int, partition: int, probability: float, stream: int):
    """How many rows to pass over before each kept one, of one of several independent Bernoulli streams."""
    start = ((seed * GOLDEN) ^ ((stream + 1) * MIX_1) ^ ((partition + 1) * MIX_2)) & MASK64
    rng = SplittableRandom(start)
    while True:
        if probability >= 1:
            yield 0
            continue
        if probability <= 0:
            return
        u = rng.next_double()
        while u <= 0:
            u = rng.next_double()
        yield math.floor(math.log(u) / math.log1p(-probability))


def inclusion_probability(target: int, n: int, margin: float = 1.3) -> float:
    return 1.0 if n <= 0 else min(1.0, margin * target / n)


def _lcg_step(state: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (state * np.uint64(LCG_MULTIPLIER) + np.uint64(LCG_INCREMENT)) & np.uint64(MASK48)


class JavaRandoms:
    """Many ``java.util.Random`` at once: one state for each seed."""

    def __init__(self, seeds: np.ndarray):
        self.state = (seeds.astype(np.uint64) ^ np.uint64(LCG_MULTIPLIER)) & np.uint64(MASK48)
        self.spare = np.full(len(seeds), np.nan)

    def next_double(self, at: np.ndarray) -> np.ndarray:
        a = _lcg_step(self.state[at])
        b = _lcg_step(a)
        self.state[at] = b
        return (((a >> np.uint64(22)) << np.uint64(27)) + (b >> np.uint64(21))).astype(np.float64) * 2.0**-53

    def next_gaussian(self, at: np.ndarray) -> np.ndarray:
        out = self.spare[at].copy()
        self.spare[at] = np.nan
        left = np.flatnonzero(np.isnan(out))
        while len(left):
            rows = at[left]
            a, b = 2 * self.next_double(rows) - 1, 2 * self.next_double(rows) - 1
            s = a * a + b * b
            good = (s > 0) & (s < 1)
            m = np.sqrt(-2 * np.log(s[good]) / s[good])
            out[left[good]] = a[good] * m
            self.spare[rows[good]] = b[good] * m
            left = left[~good]
        return out


def mixture_points(index: np.ndarray, seed: int) -> np.ndarray:
    """Rows of the five-mode mixture in three dimensions; row i depends on (seed, i) alone."""
    with np.errstate(over="ignore"):
        seeds = np.uint64(seed & MASK64) + index.astype(np.uint64) * np.uint64(GOLDEN)
    rng, every = JavaRandoms(seeds), np.arange(len(index))
    mode = rng.next_double(every)
    out = np.empty((len(index), 3))
    far = np.flatnonzero(mode < 0.05)
    for k in range(3):
        out[far, k] = rng.next_double(far) * 2000 - 1000
    # (upper end, centres, spreads) of the Gaussian modes
    low = 0.05
    for high, centre, spread in ((0.30, (0, 0, 0), (5, 5, 5)), (0.55, (5, 5, 5), (5, 5, 5)), (0.70, (100, 50, 50), (40, 2, 2)), (2.0, (200, 200, 200), (1, 1, 1))):
        own = np.flatnonzero((mode >= low) & (mode < high))
        for k in range(3):
            out[own, k] = rng.next_gaussian(own) * spread[k] + centre[k]
        low = high
    return out
