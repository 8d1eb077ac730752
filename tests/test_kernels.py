"""Pure-Python kernels: label tie rule, k-means details, chain test (FIXTURES M2-M6)."""

import pytest

from anomark.functions.kmeans import first_distinct, lloyd_1d, nearest_label, warm_step
from anomark.functions.markov import first_anomaly, labels_of, transition_probabilities


def test_m2_label_tie_takes_larger_centroid():
    assert nearest_label(5.0, [1.0, 9.0]) == 1
    assert nearest_label(5.0, [9.0, 1.0]) == 0


def test_kmeans_assignment_tie_takes_lowest_index():
    # 5 is equidistant from 1 and 9: Lloyd assigns it to the first centroid
    assert lloyd_1d([1.0, 9.0, 9.0, 5.0], [1.0, 9.0], 1e-5) == [3.0, 9.0]


def test_kmeans_drops_empty_cluster_and_keeps_order():
    assert lloyd_1d([1.0, 1.0, 2.0], [100.0, 1.0, 2.0], 1e-5) == [1.0, 2.0]


def test_first_distinct_keeps_first_appearance_order():
    assert first_distinct([5.0, 3.0, 5.0, 1.0, 3.0], 3) == [5.0, 3.0, 1.0]
    assert first_distinct([2.0, 2.0], 3) == [2.0]


def test_warm_step_skip_rules():
    cent, state, skipped = warm_step(None, [1.0, 9.0, 1.0, 1.0], 2, 1e-5)
    assert cent == [1.0, 9.0] and state == ([1.0, 9.0], 1.0) and not skipped
    # incoming 9 is a centroid -> skip, outgoing value still replaced
    cent, state, skipped = warm_step(state, [9.0, 1.0, 1.0, 9.0], 2, 1e-5)
    assert skipped and cent == [1.0, 9.0] and state[1] == 9.0
    # incoming equals the previous outgoing value -> skip
    cent, state, skipped = warm_step(([2.0], 7.0), [3.0, 7.0], 3, 1e-5)
    assert skipped and cent == [2.0]
    # fewer than K centroids: the incoming value is appended as a seed
    cent, state, skipped = warm_step(([1.0], 0.0), [1.0, 1.0, 8.0], 2, 1e-5)
    assert not skipped and cent == [1.0, 8.0]


def test_m3_later_run_reports_index_and_divided_product():
    labels = [0, 0, 0, 1, 0]
    p = transition_probabilities(labels, 2)
    assert p == pytest.approx([2 / 3, 2 / 3, 1 / 3, 1.0])
    found, idx, prob = first_anomaly(p, 0.3, 2)
    assert found and idx == 1
    assert prob == (2 / 3 * (2 / 3)) / (2 / 3) * (1 / 3)


def test_m4_single_centroid_has_probability_one():
    p = transition_probabilities(labels_of([4.0, 4.0, 4.0], [4.0]), 1)
    assert p == [1.0, 1.0]
    assert first_anomaly(p, 1.0, 5) == (False, None, 1.0)


def test_m5_chain_length_is_clipped():
    assert first_anomaly([0.5, 0.5], 0.3, 5) == (True, 0, 0.25)
    assert first_anomaly([], 0.3, 5) == (False, None, 1.0)


def test_m6_threshold_test_is_strict():
    p = transition_probabilities([0, 1, 0, 0], 2)
    assert p == [0.5, 1.0, 0.5]
    assert first_anomaly(p, 0.5, 1)[0] is False


def test_first_run_reports_partial_product():
    found, idx, prob = first_anomaly([0.1, 0.9, 0.9], 0.2, 3)
    assert (found, idx, prob) == (True, 0, 0.1)


def test_windows_at_once_equal_one_by_one():
    import random

    import numpy as np

    from anomark.functions.kmeans import first_distinct, lloyd_windows

    rng = random.Random(2)
    for digits in (0, 1, 6):
        values = [[round(rng.uniform(-5, 5), digits) for _ in range(10)] for _ in range(200)]
        seeds = [first_distinct(v, rng.randint(1, 4)) for v in values]
        padded = np.array([s + [np.nan] * (4 - len(s)) for s in seeds])
        got = [c[~np.isnan(c)].tolist() for c in lloyd_windows(np.array(values), padded, 1e-5)]
        assert got == [lloyd_1d(v, s, 1e-5) for v, s in zip(values, seeds)]


def test_a_value_meets_each_centroid_once(spark):
    """Nearest centroid, the larger one on a tie, the first of equal ones; one pass over the centroids a value."""
    from anomark.operators.clustering import label_values

    rows = [([1.0, 2.0, 3.0, 9.0], [4.0, 2.0, 0.0]), ([5.0, 5.5], [6.0, 5.0, 5.0]), ([7.0], [7.5]), ([1e308, -1e308], [-1.7e308, 1.7e308])]
    found = label_values(spark.createDataFrame(rows, "values array<double>, centroids array<double>"))
    assert [r.labels for r in found.collect()] == [[1, 1, 0, 0], [1, 0], [0], [1, 0]]
    assert "filter(" not in found._jdf.queryExecution().analyzed().toString()
