"""Weighted MinHash by throwing darts (DartMinHash).

Every element owns an endless strip of the plane, weight across and rank upwards.
Hashed darts fall on it evenly; those below the element's weight hit, and each hit
belongs to one of ``k`` coordinates.  The signature keeps the hit of lowest rank per
coordinate.  Two sets agree in a coordinate with the odds of their weighted Jaccard
similarity, and a set costs about ``k log k`` darts however many elements it has.
"""

from __future__ import annotations

import numpy as np

from . import ragged

_STEP = np.uint64(0x9E3779B97F4A7C15)
_UNIT = 2.0**-53
# Darts thrown in one array operation.
_BLOCK = 1 << 20


def _unit(x: np.ndarray) -> np.ndarray:
    """Numbers above 0 and up to 1."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1.0) * _UNIT


def _throw(
    seeds: np.ndarray, widths: np.ndarray, limits: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Darts of regions with a rank below the region's limit: region, rank, dart.

    Along the rank a region's darts are a Poisson process with its width as rate.
    """
    regions, ranks, darts = [], [], []
    expected = limits * widths
    size = np.maximum(2, 2 ** np.ceil(np.log2(np.maximum(expected, 1)))).astype(np.int64)
    for block in np.unique(size):
        of_size = np.flatnonzero(size == block)
        step = max(1, _BLOCK // int(block))
        for low in range(0, len(of_size), step):
            left = of_size[low : low + step]
            at = np.zeros(len(left))
            turn = 0
            while len(left):
                number = np.arange(turn + 1, turn + int(block) + 1, dtype=np.uint64) * _STEP
                dart = ragged.mix(seeds[left][:, None] + number[None, :])
                gaps = -np.log(_unit(dart)) / widths[left][:, None]
                rank = at[:, None] + np.cumsum(gaps, axis=1)
                below = rank < limits[left][:, None]
                where = np.nonzero(below)
                regions.append(left[where[0]])
                ranks.append(rank[where])
                darts.append(dart[where])
                more = below[:, -1]
                left, at, turn = left[more], rank[more, -1], turn + int(block)
    if not regions:
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.uint64)
    return np.concatenate(regions), np.concatenate(ranks), np.concatenate(darts)


def _regions(
    elements: np.ndarray, weights: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Weight strips [0,1), [1,2), [2,4), [4,8) ... below each element's weight."""
    strips = 1 + np.maximum(0, np.ceil(np.log2(np.maximum(weights, 1e-300)))).astype(np.int64)
    owner = np.repeat(np.arange(len(elements)), strips)
    strip = np.arange(len(owner)) - np.repeat(np.cumsum(strips) - strips, strips)
    low = np.where(strip == 0, 0.0, 2.0 ** (strip - 1))
    width = np.maximum(low, 1.0)
    seeds = ragged.mix(elements[owner] ^ ragged.mix(strip + 1))
    return owner, low, width, seeds


def signatures(
    elements: np.ndarray, weights: np.ndarray, offsets: np.ndarray, k: int
) -> np.ndarray:
    """A row of ``k`` numbers for each set of hashed, distinct elements with positive weights.

    A set without elements gets a row of zeros.  Weights far below 1 cost more darts; scale
    all sets by the same number then.
    """
    rows = len(offsets) - 1
    out = np.zeros((rows, k), np.uint64)
    total = np.add.reduceat(np.append(weights, 0.0), offsets[:-1]) if rows else np.zeros(0)
    left = np.flatnonzero(np.diff(offsets) > 0)
    thrown = k * (np.log(k) + 2.0)
    while len(left):
        lengths = np.diff(offsets)[left]
        picked = ragged.gather(np.arange(len(elements)), offsets[left], lengths)
        row = np.repeat(np.arange(len(left)), lengths)
        weight = weights[picked].astype(np.float64)
        owner, low, width, seeds = _regions(elements[picked], weight)
        limits = (thrown / total[left])[row[owner]]
        region, rank, dart = _throw(seeds, width, limits)
        spot = ragged.mix(dart + _STEP)
        element = owner[region]
        partly = low + width > weight[owner]  # elsewhere every dart hits
        if partly.any():
            hit = low[region] + width[region] * (1.0 - _unit(spot)) < weight[element]
            rank, dart, spot, element = rank[hit], dart[hit], spot[hit], element[hit]
        slot = row[element] * k + (spot % np.uint64(k)).astype(np.int64)
        first = np.full(len(left) * k, np.inf)
        np.minimum.at(first, slot, rank)
        wins = rank == first[slot]
        found = np.zeros(len(left) * k, np.uint64)
        found[slot[wins]] = dart[wins]
        out[left] = found.reshape(-1, k)
        # A coordinate without a dart: more darts, which leave the earliest as they are.
        left = left[np.isinf(first.reshape(-1, k)).any(axis=1)]
        thrown *= 2
    return out


def band_keys(signature: np.ndarray, rows_per_band: int) -> np.ndarray:
    """One hash for each band of neighbouring coordinates, the band's number included."""
    sets, k = signature.shape
    bands = signature.reshape(sets, k // rows_per_band, rows_per_band)
    keys = np.tile(ragged.mix(np.arange(1, bands.shape[1] + 1)), (sets, 1))
    for r in range(rows_per_band):
        keys = ragged.mix((keys ^ bands[:, :, r]).ravel()).reshape(keys.shape)
    return keys
