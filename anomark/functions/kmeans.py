"""One-dimensional Lloyd k-means with a warm start.

``warm_step`` handles one window; ``lloyd_windows`` runs many windows at once, for
``anomark.functions.lanes``.

Semantics (those of ``scipy.cluster.vq.kmeans`` called with an array of seeds):
  * assign each value to the nearest centroid, the lowest index on ties;
  * record the mean absolute distance;
  * replace every centroid by the mean of its members (sum left to right, then divide) and
    drop centroids without members, keeping the order of the rest;
  * stop when the mean distance changed by at most ``tol`` from the previous round (the
    first round always continues); return the centroids after the last update. Each round
    lowers the squared error or changes nothing, so there is no cap on the rounds.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np

Centroids = list[float]
State = tuple[Centroids, float]  # (centroids, first value of the window just evaluated)


def first_distinct(values: Sequence[float], k: int) -> Centroids:
    """The first ``k`` distinct values in order of first appearance (seeds of a cold start)."""
    seen: list[float] = []
    for v in values:
        if v not in seen:
            seen.append(v)
            if len(seen) == k:
                break
    return seen


def _two(values: Sequence[float], a: float, b: float) -> tuple[list[float], list[int], float]:
    """``_assigned`` to two centroids."""
    sa = sb = total = 0.0
    na = nb = 0
    for v in values:
        x, y = abs(v - a), abs(v - b)
        if y < x:
            sb += v
            nb += 1
            total += y
        else:
            sa += v
            na += 1
            total += x
    return [sa, sb], [na, nb], total


def _three(values: Sequence[float], a: float, b: float, c: float) -> tuple[list[float], list[int], float]:
    """``_assigned`` to three centroids."""
    sa = sb = sc = total = 0.0
    na = nb = nc = 0
    for v in values:
        x, y, z = abs(v - a), abs(v - b), abs(v - c)
        if y < x:
            if z < y:
                sc += v
                nc += 1
                total += z
            else:
                sb += v
                nb += 1
                total += y
        elif z < x:
            sc += v
            nc += 1
            total += z
        else:
            sa += v
            na += 1
            total += x
    return [sa, sb, sc], [na, nb, nc], total


def _assigned(values: Sequence[float], cent: Sequence[float]) -> tuple[list[float], list[int], float]:
    """(sum and number of the values nearest to each centroid, sum of distances)."""
    sums = [0.0] * len(cent)
    counts = [0] * len(cent)
    total = 0.0
    for v in values:
        best = 0
        best_d = abs(v - cent[0])
        for j in range(1, len(cent)):
            d = abs(v - cent[j])
            if d < best_d:
                best_d = d
                best = j
        sums[best] += v
        counts[best] += 1
        total += best_d
    return sums, counts, total


def lloyd_1d(values: Sequence[float], seeds: Sequence[float], tol: float) -> Centroids:
    cent = list(seeds)
    n = len(values)
    prev_avg = math.inf
    while True:
        k = len(cent)
        sums, counts, total = _three(values, *cent) if k == 3 else _two(values, *cent) if k == 2 else _assigned(values, cent)
        avg = total / n
        cent = [s / m for s, m in zip(sums, counts) if m > 0]
        if not abs(prev_avg - avg) > tol:  # also ends on a change that is undefined
            return cent
        prev_avg = avg


def lloyd_windows(values: np.ndarray, seeds: np.ndarray, tol: float) -> np.ndarray:
    """``lloyd_1d`` of many windows at once: values (n, W) and seeds (n, K), both filled up with NaN.

    Sums run over the window's places in order, so every result equals ``lloyd_1d``'s bit for bit;
    a centroid without members becomes NaN in its place.
    """
    cent = seeds.astype(float)
    filled = ~np.isnan(values)
    full = bool(filled.all())
    size = filled.sum(axis=1)
    before = np.full(len(values), np.inf)
    live = np.arange(len(values))
    with np.errstate(invalid="ignore", divide="ignore"):
        while len(live):
            v, c = values[live], cent[live]
            gap = np.abs(v[:, :, None] - c[:, None, :])
            gap[np.isnan(gap)] = np.inf
            best = gap.argmin(axis=2)
            near = gap.min(axis=2)
            if not full:
                there = filled[live]
                v, near = np.where(there, v, 0.0), np.where(there, near, 0.0)
            sums, counts, total = np.zeros_like(c), np.zeros_like(c), np.zeros(len(live))
            rows = np.arange(len(live))
            for w in range(v.shape[1]):
                sums[rows, best[:, w]] += v[:, w]
                counts[rows, best[:, w]] += 1 if full else there[:, w]
                total += near[:, w]
            cent[live] = np.where(counts > 0, sums / counts, np.nan)
            mean = total / size[live]
            moved = np.abs(before[live] - mean) > tol
            before[live] = mean
            live = live[moved]
    return cent


def warm_step(
    state: State | None,
    values: Sequence[float],
    k: int,
    tol: float,
) -> tuple[Centroids, State, bool]:
    """Cluster one window given the key's carried state.

    Returns (centroids, next state, skipped). Seeds: first window of the key -> first ``k``
    distinct values; later windows -> the previous centroids, plus the incoming (last) value
    when fewer than ``k`` centroids are left. The run is skipped, and the previous centroids
    reused, when the incoming value equals the previous window's outgoing (first) value or
    one of the previous centroids. These seed and skip rules are fixed by the method.
    """
    skipped = False
    if state is None:
        cent = lloyd_1d(values, first_distinct(values, k), tol)
    else:
        prev, outgoing = state
        incoming = values[-1]
        if outgoing == incoming or incoming in prev:
            cent = prev
            skipped = True
        elif len(prev) < k:
            cent = lloyd_1d(values, prev + [incoming], tol)
        else:
            cent = lloyd_1d(values, prev, tol)
    return cent, (cent, values[0]), skipped


def nearest_label(value: float, centroids: Sequence[float]) -> int:
    """Label rule of the detector: nearest centroid, the larger centroid on an exact tie."""
    dists = [abs(c - value) for c in centroids]
    m = min(dists)
    best = max(c for c, d in zip(centroids, dists) if d == m)
    return list(centroids).index(best)
