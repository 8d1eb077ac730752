"""The warm-start fold, labels and chain test of many keys at once, one vector step a window place.

A lane is one run of windows that depend on each other: a (machine, property), or one chunk of it. A task's rows come
sorted by (step, lane), where step is the row's place in its lane, and say whether their lane goes on. So the rows of one
step are those of the step before that go on, in the same order: a lane keeps its slot in the state matrix without a
look-up. ``Lanes`` holds the state (centroids, filled up with NaN, and the first value of the last window) and evaluates
the windows of one step in one go; ``Ring`` holds the last W events' values of each lane.

Every operation runs in the order of the one-window kernels (``warm_step``, ``anomark.functions.markov``), so results
are theirs bit for bit. A handful of rows is evaluated by those kernels, since numpy's calls would cost more.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

import numpy as np

from anomark.functions.kmeans import lloyd_windows, warm_step
from anomark.functions.markov import first_anomaly, labels_of, transition_probabilities

FEW = 12


def padded(rows: list[list[float]], width: int | None = None) -> np.ndarray:
    """Lists as rows of a matrix, filled up with NaN."""
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    out = np.full((len(rows), max(int(sizes.max(initial=0)), width or 0)), np.nan)
    if len(rows):
        out[np.arange(out.shape[1]) < sizes[:, None]] = np.concatenate([np.asarray(r, float) for r in rows])
    return out


def from_arrow(column) -> np.ndarray:
    """A list column (no nulls) as rows of a matrix, filled up with NaN."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    width = int(sizes.max(initial=0))
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.full((len(sizes), width), np.nan)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def compact(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows with their NaNs moved behind the others, and the place that each entry came from."""
    gone = np.isnan(values)
    order = np.argsort(gone, axis=1, kind="stable")
    return np.take_along_axis(values, order, axis=1), order


def first_distinct_rows(values: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The first k[i] distinct values of each row in order of appearance, filled up with NaN."""
    seeds = np.full((len(values), max(int(k.max(initial=1)), 1)), np.nan)
    found = np.zeros(len(values), np.int64)
    rows = np.arange(len(values))
    for w in range(values.shape[1]):
        v = values[:, w]
        new = ~np.isnan(v) & (found < k) & ~(seeds == v[:, None]).any(axis=1)
        seeds[rows[new], found[new]] = v[new]
        found += new
    return seeds


def nearest_labels(values: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Label of every value: nearest centroid, the larger one on an exact tie; anything where the value is NaN."""
    with np.errstate(invalid="ignore"):
        gap = np.abs(centroids[:, None, :] - values[:, :, None])
        gap[np.isnan(gap)] = np.inf
        tied = np.where(gap == gap.min(axis=2)[:, :, None], centroids[:, None, :], -np.inf)
        tied[np.isnan(tied)] = -np.inf
        return (centroids[:, None, :] == tied.max(axis=2)[:, :, None]).argmax(axis=2)


def first_anomalies(values: np.ndarray, centroids: np.ndarray, threshold: np.ndarray, n_transitions: int):
    """(found, index, probability) of each row's first chain of transitions below its threshold.

    ``values`` and ``centroids`` are filled up with NaN at the end.
    """
    rows = np.arange(len(values))
    steps = (~np.isnan(values)).sum(axis=1) - 1
    width = centroids.shape[1]
    labels = nearest_labels(values, centroids)
    counts = np.zeros((len(values), width, width))
    for t in range(values.shape[1] - 1):
        counts[rows, labels[:, t], labels[:, t + 1]] += t < steps
    out_of = counts.sum(axis=2)
    alone = (~np.isnan(centroids)).sum(axis=1) == 1
    found = np.zeros(len(values), bool)
    index = np.zeros(len(values), np.int64)
    prob = np.ones(len(values))
    p: list[np.ndarray] = []
    with np.errstate(invalid="ignore", divide="ignore"):
        for i in range(1, values.shape[1]):
            a, b = labels[:, i - 1], labels[:, i]
            p.append(np.where(alone, 1.0, counts[rows, a, b] / out_of[rows, a]))
            if i <= n_transitions:
                now, at = prob * p[-1], 0
            else:
                gone = p[i - n_transitions - 1]
                now, at = np.where(gone != p[-1], prob / gone * p[-1], prob), i - n_transitions
            active = (i <= steps) & ~found
            prob = np.where(active, now, prob)
            hit = active & (prob < threshold)
            index[hit] = at
            found |= hit
    return found, index, prob


@dataclass
class Found:
    """Results of the windows of one step, row by row."""

    centroids: np.ndarray
    skipped: np.ndarray
    found: np.ndarray | None = None
    index: np.ndarray | None = None
    prob: np.ndarray | None = None


class Lanes:
    """State of the lanes of one task, by slot."""

    def __init__(self, tol: float, n_transitions: int | None = None):
        self.tol, self.n = tol, n_transitions
        self.centroids = np.full((0, 1), np.nan)
        self.gone = np.empty(0)  # first value of the lane's last window
        self.begun = np.empty(0, bool)
        self._step, self._at = 0, 0
        self._slots = np.empty(0, np.int64)
        self._next: list[np.ndarray] = []

    def slots(self, step: int, goes_on: np.ndarray) -> np.ndarray:
        """Slots of the next rows of ``step``; every row of a step is asked for, in order."""
        if step != self._step:
            self._slots = np.concatenate(self._next) if self._next else np.empty(0, np.int64)
            self._step, self._at, self._next = step, 0, []
        if step == 1:
            slots = np.arange(self._at, self._at + len(goes_on))
            self._grow(len(slots))
        else:
            slots = self._slots[self._at : self._at + len(goes_on)]
        self._at += len(goes_on)
        self._next.append(slots[goes_on])
        return slots

    def _grow(self, more: int) -> None:
        self.centroids = np.concatenate((self.centroids, np.full((more, self.centroids.shape[1]), np.nan)))
        self.gone = np.concatenate((self.gone, np.full(more, np.nan)))
        self.begun = np.concatenate((self.begun, np.zeros(more, bool)))

    def begin(self, slots: np.ndarray, centroids: np.ndarray, gone: np.ndarray) -> None:
        """Lanes that start from a carried state."""
        self._widen(centroids.shape[1])
        self.centroids[slots] = np.nan
        self.centroids[slots, : centroids.shape[1]] = centroids
        self.gone[slots], self.begun[slots] = gone, True

    def _widen(self, width: int) -> None:
        have = self.centroids.shape[1]
        if width > have:
            self.centroids = np.concatenate((self.centroids, np.full((len(self.centroids), width - have), np.nan)), axis=1)

    def evaluate(self, slots: np.ndarray, values: np.ndarray, k: np.ndarray, threshold: np.ndarray | None = None) -> Found:
        """Windows of these lanes: values filled up with NaN at the end, at least one in each row."""
        self._widen(int(k.max(initial=1)))
        if len(slots) < FEW:
            return self._one_by_one(slots, values, k, threshold)
        size = (~np.isnan(values)).sum(axis=1)
        rows = np.arange(len(slots))
        first, last = values[:, 0], values[rows, size - 1]
        before, begun = self.centroids[slots], self.begun[slots]
        held = (~np.isnan(before)).sum(axis=1)
        skipped = begun & ((self.gone[slots] == last) | (before == last[:, None]).any(axis=1))
        seeds = before.copy()
        add = np.flatnonzero(begun & ~skipped & (held < k))
        seeds[add, held[add]] = last[add]
        cold = np.flatnonzero(~begun)
        if len(cold):
            start = first_distinct_rows(values[cold], k[cold])
            seeds[cold] = np.nan
            seeds[cold, : start.shape[1]] = start
        run = np.flatnonzero(~skipped)
        now = before
        if len(run):
            now = before.copy()
            now[run] = compact(lloyd_windows(values[run], seeds[run], self.tol))[0]
        self.centroids[slots], self.gone[slots], self.begun[slots] = now, first, True
        out = Found(now, skipped)
        if threshold is not None:
            out.found, out.index, out.prob = first_anomalies(values, now, threshold, self.n)
        return out

    def _one_by_one(self, slots, values, k, threshold) -> Found:
        kept, skips, chains = [], [], []
        for row, slot in enumerate(slots.tolist()):
            v = values[row][~np.isnan(values[row])].tolist()
            c = self.centroids[slot]
            state = (c[~np.isnan(c)].tolist(), float(self.gone[slot])) if self.begun[slot] else None
            cent, (_, gone), skipped = warm_step(state, v, int(k[row]), self.tol)
            kept.append(cent)
            skips.append(skipped)
            self._widen(len(cent))
            self.centroids[slot] = np.nan
            self.centroids[slot, : len(cent)] = cent
            self.gone[slot], self.begun[slot] = gone, True
            if threshold is not None:
                p = transition_probabilities(labels_of(v, cent), len(cent))
                chains.append(first_anomaly(p, float(threshold[row]), self.n))
        out = Found(padded(kept, self.centroids.shape[1]), np.array(skips, bool))
        if threshold is not None:
            out.found = np.array([f for f, _, _ in chains], bool)
            out.index = np.array([i or 0 for _, i, _ in chains], np.int64)
            out.prob = np.array([p for _, _, p in chains])
        return out


class Ring:
    """The last ``size`` events' values of each lane, and the labels of their events."""

    def __init__(self, size: int):
        self.size = size
        self.values = np.full((0, size, 1), np.nan)
        self._labels: dict[int, list[tuple[np.ndarray, tuple]]] = {}

    def push(self, step: int, slots: np.ndarray, values: np.ndarray, *labels) -> None:
        """The next event of these lanes: its values filled up with NaN, and label columns."""
        lanes, _, width = self.values.shape
        if step == 1 and slots[-1] >= lanes:
            self.values = np.concatenate((self.values, np.full((int(slots[-1]) + 1 - lanes, self.size, width), np.nan)))
        if values.shape[1] > width:
            more = np.full((len(self.values), self.size, values.shape[1] - width), np.nan)
            self.values = np.concatenate((self.values, more), axis=2)
        place = step % self.size
        self.values[slots, place] = np.nan
        self.values[slots, place, : values.shape[1]] = values
        if self._labels.get(step) is None:
            self._labels.pop(step - self.size, None)
            self._labels[step] = []
        self._labels[step].append((slots, labels))

    def windows(self, step: int, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of the windows that end with ``step``, filled up with NaN at the end, and the step each value is of."""
        order = np.arange(step - self.size + 1, step + 1)
        held = self.values[slots][:, order % self.size].reshape(len(slots), -1)
        steps = np.broadcast_to(np.repeat(order, self.values.shape[2]), held.shape)
        if np.isnan(held).any():
            held, came_from = compact(held)
            steps = np.take_along_axis(steps, came_from, axis=1)
            used = int((~np.isnan(held)).sum(axis=1).max(initial=1))
            held, steps = held[:, : max(used, 1)], steps[:, : max(used, 1)]
        return held, steps

    def labels(self, step: int, slot: int) -> tuple:
        """Labels of the lane's event of that step."""
        for slots, labels in self._labels[step]:
            at = int(np.searchsorted(slots, slot))
            if at < len(slots) and slots[at] == slot:
                return tuple(c[at].as_py() for c in labels)
        raise KeyError(slot)


class ListRing:
    """``Ring`` for lanes whose events may hold any number of values."""

    def __init__(self, size: int):
        self.size = size
        self._events: dict[int, deque] = {}

    def push(self, step: int, slots: np.ndarray, values: np.ndarray, *labels) -> None:
        for row, slot in enumerate(slots.tolist()):
            v = values[row][~np.isnan(values[row])]
            self._events.setdefault(slot, deque(maxlen=self.size)).append((step, v, tuple(c[row].as_py() for c in labels)))

    def windows(self, step: int, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        held = [self._events[s] for s in slots.tolist()]
        values = padded([np.concatenate([v for _, v, _ in events]) for events in held], 1)
        steps = np.zeros(values.shape, np.int64)
        for row, events in enumerate(held):
            came_from = np.concatenate([np.full(len(v), at) for at, v, _ in events])
            steps[row, : len(came_from)] = came_from
        return values, steps

    def labels(self, step: int, slot: int) -> tuple:
        return next(labels for at, _, labels in self._events[slot] if at == step)
