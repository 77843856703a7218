"""HyperMinHash sketches: per bucket the leading-zero count and mantissa bits of the least hash."""

from __future__ import annotations

import functools

import numpy as np

SEEDS = 4
BUCKETS = 64  # of one seed
REGISTERS = SEEDS * BUCKETS
MANTISSA = 10
VALUE_BITS = 58
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    h = h ^ np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` code points."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    wide = codes.astype(np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        h = (h + wide[k : k + n] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return h


@functools.cache
def _probes() -> np.ndarray:
    """For each register the order in which it looks for a filled bucket of its own seed."""
    rng = np.random.default_rng(20)
    return np.stack([rng.permutation(BUCKETS) + BUCKETS * (k // BUCKETS) for k in range(REGISTERS)]).T


def sketch(hashes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Registers of ``n`` sets as uint16 (n, REGISTERS); empty buckets take over a filled one's register.

    The takeover looks at the buckets in an order that depends on the register alone, so two sets agree in a register
    with the probability of their similarity also where buckets are empty. A set without elements is all ones.
    """
    least = np.full(n * REGISTERS, EMPTY, dtype=np.uint64)
    for s in range(SEEDS):
        h = mix(hashes, s)
        at = owner * REGISTERS + s * BUCKETS + (h >> np.uint64(VALUE_BITS)).astype(np.int64)
        np.minimum.at(least, at, h & np.uint64((1 << VALUE_BITS) - 1))
    empty = least == EMPTY
    value = np.where(empty, np.uint64(1), np.maximum(least, np.uint64(1)))
    top = np.floor(np.log2(value.astype(np.float64))).astype(np.int64)
    over = (np.uint64(1) << top.astype(np.uint64)) > value  # rounding up near a power of two
    top -= over
    zeros = np.minimum(VALUE_BITS - 1 - top, 63).astype(np.uint64)
    down = np.maximum(top - MANTISSA, 0).astype(np.uint64)
    registers = ((zeros << np.uint64(MANTISSA)) | ((value >> down) & np.uint64((1 << MANTISSA) - 1))).astype(np.uint16)
    registers[empty] = 0xFFFF
    out, gap = registers.reshape(n, REGISTERS), empty.reshape(n, REGISTERS).copy()
    filled = ~gap
    for probe in _probes():
        if not gap.any():
            break
        take = gap & filled[:, probe]
        rows, cols = np.nonzero(take)
        out[rows, cols] = out[rows, probe[cols]]
        gap &= ~take
    return out


def expected_collisions(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Registers of two sets of these sizes that agree by chance."""
    big, small = np.maximum(n, m).astype(float), np.maximum(np.minimum(n, m), 1).astype(float)
    ratio = big / small
    return REGISTERS * 0.169919487159739 * (4 * ratio / (1 + ratio) ** 2) / (1 << MANTISSA)


def similarity(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard estimates of pairs of sketches, corrected for chance collisions."""
    by_chance = expected_collisions(n, m)
    return np.clip(((a == b).sum(axis=1) - by_chance) / (REGISTERS - by_chance), 0, 1)
