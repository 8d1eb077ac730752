"""Per-window Markov chain test in plain Python, for the streaming state processor.

Same semantics and the same order of floating-point operations as the native column
expressions of ``anomark.operators.markov``: the batch and stream results agree bit for bit.
"""

from __future__ import annotations

from collections.abc import Sequence

from anomark.functions.kmeans import nearest_label


def labels_of(values: Sequence[float], centroids: Sequence[float]) -> list[int]:
    return [nearest_label(v, centroids) for v in values]


def transition_probabilities(labels: Sequence[int], n_centroids: int) -> list[float]:
    pairs = list(zip(labels[:-1], labels[1:]))
    if n_centroids == 1:
        return [1.0] * len(pairs)
    out = []
    for a, b in pairs:
        both = sum(1 for x in pairs if x == (a, b))
        src = sum(1 for x in pairs if x[0] == a)
        out.append(float(both) / float(src))
    return out


def first_anomaly(p: Sequence[float], threshold: float, n_transitions: int) -> tuple[bool, int | None, float]:
    """(found, index, probability): first run of N transitions below the threshold."""
    L = len(p)
    n = min(n_transitions, L)
    prob = 1.0
    for i in range(1, L + 1):
        if i <= n:
            prob = prob * p[i - 1]
            idx = 0
        else:
            start = i - n
            p_out, p_in = p[start - 1], p[i - 1]
            if p_out != p_in:
                prob = prob / p_out * p_in
            idx = start
        if prob < threshold:
            return True, idx, prob
    return False, None, prob
