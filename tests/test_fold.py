"""The split fold: exact for every tail option, rounds bounded by states and not by chunks."""

import logging
import random

import numpy as np
import pyarrow as pa
import pytest

from anomark.config import DetectorConfig
from anomark.functions import lanes
from anomark.functions.kmeans import lloyd_1d, lloyd_windows, warm_step
from anomark.functions.markov import first_anomaly, labels_of, transition_probabilities
from anomark.plans.detect import detection_stages
from anomark.session import checkpoint_dir
from tests.helpers import build_inputs, simulate

PARAMS = {"d": (3, 0.1)}


def centroids(spark, events, cfg):
    rows = detection_stages(*build_inputs(spark, events, PARAMS), cfg).chains.collect()
    return sorted((r.machine_id, r.window_no, r.centroids, r.skipped) for r in rows)


def test_two_level_sensor_needs_few_rounds(spark, caplog):
    rng = random.Random(4)
    events = [("A", {"d": float(rng.randint(0, 1))}) for _ in range(300)]
    cfg = DetectorConfig(window_size=4, num_transitions=2)
    want = centroids(spark, events, cfg.with_(fold_chunk_events=None))
    with caplog.at_level(logging.INFO, "anomark.fold"):
        got = centroids(spark, events, cfg.with_(fold_chunk_events=5))
    assert got == want
    rounds = [r for r in caplog.records if "fold round" in r.message]
    assert 1 <= len(rounds) <= 8  # 60 chunks; a walk that knew no transfers of other rounds would need up to 59


def test_file_tail_of_a_split_key(spark):
    events = [("A", {"d": float(v)}) for v in (0, 1, 1, 0, 1, 0, 0, 1, 1, 1, 0, 1, 0, 0, 1, 0)] + [("B", {"d": 1.0}), ("B", {"d": 0.0})]
    cfg = DetectorConfig(window_size=4, num_transitions=2, tail="file")
    assert centroids(spark, events, cfg.with_(fold_chunk_events=4)) == centroids(spark, events, cfg.with_(fold_chunk_events=None))


def test_tail_counts_events_of_machines_without_a_clustered_property(spark):
    events = [("A", {"d": float(v % 3)}) for v in range(6)] + [("B", {"e": 1.0})]
    g, o, machines, mp = build_inputs(spark, events, {"d": (2, 0.1), "e": (2, 0.1)})
    cfg = DetectorConfig(window_size=4, num_transitions=2, tail="file", properties=("d",))
    assert detection_stages(g, o, machines, mp, cfg).windows.count() == 2


def test_tail_needs_lag():
    with pytest.raises(ValueError):
        DetectorConfig(lag=0, tail="file")


def test_stateful_property_without_parameters_is_left_out(spark):
    g, o, machines, mp = build_inputs(spark, [("A", {"d": float(v), "e": 1.0}) for v in range(6)], {"d": (2, 0.1), "e": (None, 0.1)})
    rows = detection_stages(g, o, machines, mp, DetectorConfig(window_size=4)).chains.collect()
    assert {r.property_id for r in rows} == {"d"}


def test_checkpoint_folder_must_be_named():
    class Context:
        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_dir(Session())


def random_events(rng, digits):
    """Values of one property a machine: repeated levels, missing ones, several an event."""
    out = []
    for _ in range(rng.randint(1, 60)):
        n = rng.choice([1, 1, 1, 1, 0, 2])
        out.append([round(rng.uniform(-3, 3), digits) for _ in range(n)])
    return out


@pytest.mark.parametrize("digits", [0, 1, 6])
@pytest.mark.parametrize("ring", [lanes.Ring, lanes.ListRing])
@pytest.mark.parametrize("few", [0, 12])
def test_lanes_equal_one_window_at_a_time(digits, ring, few, monkeypatch):
    """All keys of a task stepped at once: centroids, skips, chains and labels bit for bit those of the scalar kernels."""
    monkeypatch.setattr(lanes, "FEW", few)
    rng = random.Random(digits)
    W, N, threshold = 7, 3, 0.1
    keys = [random_events(rng, digits) for _ in range(50)]
    ks = np.array([rng.randint(1, 4) for _ in keys])
    want = {}
    for key, events in enumerate(keys):
        state = None
        for t in range(W - 1, len(events)):
            window = [(v, s) for s in range(t - W + 1, t + 1) for v in events[s]]
            if window:
                values = [v for v, _ in window]
                cent, state, skipped = warm_step(state, values, int(ks[key]), 1e-5)
                hit, index, prob = first_anomaly(transition_probabilities(labels_of(values, cent), len(cent)), threshold, N)
                want[key, t] = (cent, skipped, hit, prob, f"{key}/{window[index][1]}" if hit else None)
    held, runs, got = ring(W), lanes.Lanes(1e-5, N), {}
    for t in range(max(map(len, keys))):
        live = [k for k, events in enumerate(keys) if len(events) > t]
        for at in range(0, len(live), 21):  # a step may come in several batches
            part = live[at : at + 21]
            slots = runs.slots(t + 1, np.array([len(keys[k]) > t + 1 for k in part]))
            assert slots.tolist() == part
            held.push(t + 1, slots, lanes.padded([keys[k][t] for k in part], 1), pa.array([f"{k}/{t}" for k in part]))
            if t + 1 < W:
                continue
            values, steps = held.windows(t + 1, slots)
            use = np.flatnonzero(~np.isnan(values[:, 0]))
            found = runs.evaluate(slots[use], values[use], ks[slots[use]], np.full(len(use), threshold))
            for row, i in enumerate(use.tolist()):
                c = found.centroids[row]
                label = held.labels(int(steps[i, found.index[row]]), part[i])[0] if found.found[row] else None
                got[part[i], t] = (c[~np.isnan(c)].tolist(), bool(found.skipped[row]), bool(found.found[row]), float(found.prob[row]), label)
    assert got == want and len(want) > 500


def test_events_with_many_values(spark):
    """A lane whose events hold more values than the matrix takes is kept as lists; the others are not touched."""
    rng = random.Random(8)
    events = [(m, {"d": [float(rng.randint(0, 3)) for _ in range(20 if m == "A" and t % 5 == 0 else 1)]}) for t in range(40) for m in "ABC"]
    cfg = DetectorConfig(window_size=4, num_transitions=2)
    want = simulate([(m, p) for m, p in events], PARAMS, 4, 2)
    got = detection_stages(*build_inputs(spark, events, PARAMS), cfg.with_(fold_chunk_events=6)).anomalies.orderBy("anomaly_no").collect()
    assert [(r.machine_id, r.property_id, r.timestamp_id, r.probability) for r in got] == want and want


@pytest.mark.parametrize("value", [float("nan"), float("inf"), float("-inf")])
def test_undefined_values_end(spark, value):
    """The detector leaves them out; the kernels end on them."""
    numbers = [1.0, 2.0, 1.0, 5.0, 2.0, 1.0, 1.0, 5.0, 2.0, 2.0]
    with_it = [("A", {"d": [v, value] if i == 4 else v}) for i, v in enumerate(numbers)]
    cfg = DetectorConfig(window_size=4, num_transitions=2)
    assert centroids(spark, with_it, cfg) == centroids(spark, [("A", {"d": v}) for v in numbers], cfg)
    lloyd_1d([1.0, value, 2.0, 3.0], [1.0, 2.0], 1e-5)
    lloyd_windows(np.array([[1.0, value, 2.0, 3.0]]), np.array([[1.0, 2.0]]), 1e-5)
    lloyd_1d([1e308, 1e308, -1e308], [1e308, -1e308], 1e-5)


def test_walk_goes_through_many_keys_in_one_task(spark):
    """Each walk begins with its key's first chunk, takes known transfers and guesses the others, without a call a key."""
    from anomark.operators.fold import _walk

    state = lambda x: ([float(x)], 0.5)
    st = "struct<c:array<double>,o:double>"
    ends = spark.createDataFrame(
        [(f"M{m}", "p", c, state(10 * m + c)) for m in range(40) for c in range(3)], f"machine_id string, property_id string, chunk bigint, spec_end {st}"
    )
    transfers = spark.createDataFrame(
        [("M1", "p", 1, state(10), state(99), 1), ("M2", "p", 1, state(7), state(98), 1)],
        f"machine_id string, property_id string, chunk bigint, need_in {st}, end {st}, round int",
    )
    walked = _walk(ends, transfers)
    found = {(r.machine_id, r.chunk): (r.need_in.c[0], r.known) for r in walked.collect()}
    assert len(found) == 80 and found["M0", 1] == (0.0, False) and found["M0", 2] == (1.0, False)
    assert found["M1", 1] == (10.0, True) and found["M1", 2] == (99.0, False)
    assert found["M2", 1] == (20.0, False) and found["M2", 2] == (98.0, False)
    assert "FlatMapGroups" not in walked._jdf.queryExecution().toString()
