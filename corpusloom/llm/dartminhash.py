"""DartMinHash: sparse weighted minwise hashing by throwing hashed darts.

Every element owns a strip of the plane, as wide as its weight, that runs along
the axis of ranks.  Hashes decide where darts lie on the strip, about one to a
unit of area, and which of the k coordinates a dart belongs to.  A set keeps, for
every coordinate, its dart of lowest rank: two sets keep the same one with a
probability of their weighted Jaccard similarity.  Only darts of rank up to
about k ln k / W are looked at, with W the set's weight, so a set costs
O(elements + k log k) and not O(elements x k).
"""

from __future__ import annotations

import numpy as np

from .wordhash import mix64

_U = np.float64(2.0**-64)
#: Ranks are cut at powers of two from 2**LOW on; the first cell runs from 0.
LOW = -20
_tables: dict[int, np.ndarray] = {}


def _poisson_table(log_mean: int) -> np.ndarray:
    """Cumulative probabilities of a Poisson number with mean 2**log_mean."""
    if log_mean not in _tables:
        mean = 2.0**log_mean
        top = int(mean + 12 * np.sqrt(mean) + 24)
        logs = np.arange(top) * np.log(mean) - mean - np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, top)))])
        _tables[log_mean] = np.cumsum(np.exp(logs))
    return _tables[log_mean]


def _throw(elements: np.ndarray, weights: np.ndarray, strip: int, cell: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Darts of all elements in one cell: (index of the element, rank, name of the dart).

    ``strip`` s holds the weights from 2**s - 1 to 2**(s+1) - 1; ``cell`` c the
    ranks from 2**(LOW+c-1) to 2**(LOW+c), or from 0 for c = 0.
    """
    lo, hi = (0.0, 2.0**LOW) if cell == 0 else (2.0 ** (LOW + cell - 1), 2.0 ** (LOW + cell))
    seed = np.uint64(((strip * 131 + cell + 1) * 0xC2B2AE3D27D4EB4F) & (2**64 - 1))
    base = mix64(elements ^ seed)
    number = np.searchsorted(_poisson_table(strip + (LOW if cell == 0 else LOW + cell - 1)), mix64(base) * _U, "right")
    who = np.repeat(np.arange(len(elements)), number)
    nth = np.arange(len(who)) - np.repeat(np.cumsum(number) - number, number)
    name = mix64(base[who] + (nth.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95))
    rank = lo + (hi - lo) * (mix64(name ^ np.uint64(0x2545F4914F6CDD1D)) * _U)
    weight = weights[who]
    full = float(2 ** (strip + 1) - 1)
    if (weight < full).any():
        place = (2.0**strip - 1) + 2.0**strip * (mix64(name ^ np.uint64(0x8CB92BA72F3D8DD7)) * _U)
        inside = place < weight
        who, rank, name = who[inside], rank[inside], name[inside]
    return who, rank, name


def signatures(elements: np.ndarray, weights: np.ndarray, bounds: np.ndarray, k: int) -> np.ndarray:
    """Signatures (sets x k, uint64) of the sets that ``bounds`` cuts out of ``elements``.

    Sets must not be empty, weights must be positive.
    """
    n = len(bounds) - 1
    of = np.repeat(np.arange(n), np.diff(bounds))
    mass = np.bincount(of, weights=weights, minlength=n)
    # a cell above which no more darts are needed, for each set: with 2 more nats than k ln k asks for
    last = np.ceil(np.log2(k * (np.log(k) + 2.0) / np.maximum(mass, 1e-300))).astype(int) - LOW
    last = np.maximum(last, 0)
    best = np.full(n * k, np.inf)
    out = np.zeros(n * k, np.uint64)
    done = np.full(n, -1)  # cells up to this one have been thrown
    strips = np.floor(np.log2(np.maximum(weights, 1.0) + 1) - 1e-12).astype(int)
    top_strip = int(strips.max(initial=0))
    while True:
        for strip in range(top_strip + 1):
            has = weights > 2.0**strip - 1
            for cell in range(int(last.max(initial=0)) + 1):
                use = has & (last[of] >= cell) & (done[of] < cell)
                if not use.any():
                    continue
                at = np.flatnonzero(use)
                who, rank, name = _throw(elements[at], weights[at], strip, cell)
                where = of[at][who] * k + (mix64(name ^ np.uint64(0x589965CC75374CC3)) % np.uint64(k)).astype(np.int64)
                np.minimum.at(best, where, rank)
                mine = rank == best[where]
                out[where[mine]] = name[mine]
        done = last.copy()
        short = np.isinf(best.reshape(n, k)).any(axis=1)
        if not short.any():
            return out.reshape(n, k)
        last = np.where(short, last + 1, last)  # twice the ranks for sets with an empty coordinate


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key (signed) for each of ``bands`` runs of ``rows`` coordinates."""
    cut = sig[:, : bands * rows].reshape(len(sig), bands, rows)
    odd = mix64(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)
    return mix64((cut * odd).sum(axis=2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
