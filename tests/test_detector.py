"""Batch detector on hand-worked cases (FIXTURES M1, M7-M11) and against a brute-force model."""

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from anomark.config import DetectorConfig
from anomark.operators.anomalies import dedupe_first
from anomark.operators.output import anomalies_to_triples
from anomark.plans.detect import detection_stages
from tests.helpers import build_inputs, simulate

M1 = [("A", {"d": v}) for v in (1, 9, 1, 1, 9, 9, 5)]
M1_CFG = DetectorConfig(window_size=4, num_transitions=2)
M1_PARAMS = {"d": (2, 0.6)}


def run(spark, events, params, cfg):
    return detection_stages(*build_inputs(spark, events, params), cfg)


def test_split_fold_equals_sequential_fold(spark):
    events = [("A", {"d": float(v)}) for v in (1, 9, 1, 1, 9, 9, 5, 2, 8, 8, 3, 7, 1, 1, 6, 9, 4, 4, 2, 9, 5)]
    seq = run(spark, events, M1_PARAMS, M1_CFG.with_(fold_chunk_events=None)).chains
    split = run(spark, events, M1_PARAMS, M1_CFG.with_(fold_chunk_events=4)).chains
    a = sorted((r.window_no, r.centroids, r.skipped) for r in seq.collect())
    b = sorted((r.window_no, r.centroids, r.skipped) for r in split.collect())
    assert a == b and len(a) == 17


def test_m1_full_detector(spark):
    st_ = run(spark, M1, M1_PARAMS, M1_CFG)
    rows = st_.anomalies.orderBy("anomaly_no").collect()
    assert [(r.anomaly_no, r.timestamp_id, r.probability) for r in rows] == [
        (0, "T0", 0.5), (1, "T1", 0.5), (2, "T2", 0.5)]
    cents = [r.centroids for r in st_.chains.orderBy("window_no").collect()]
    assert cents == [[1.0, 9.0]] * 3
    skipped = [r.skipped for r in st_.chains.orderBy("window_no").collect()]
    assert skipped == [False, True, True]


def test_m1_lag0_evaluates_last_window(spark):
    st_ = run(spark, M1, M1_PARAMS, M1_CFG.with_(lag=0))
    chains = st_.chains.orderBy("window_no").collect()
    assert chains[-1].centroids == [3.0, 9.0]
    assert [r.timestamp_id for r in st_.anomalies.orderBy("anomaly_no").collect()] == ["T0", "T1", "T2", "T3"]


def test_m7_interleaved_machines_are_independent(spark):
    alone = run(spark, M1, M1_PARAMS, M1_CFG).chains.select("window_no", "centroids").collect()
    mixed = []
    for a, b in zip(M1, [("B", {"d": v}) for v in (4, 4, 7, 2, 8, 1, 1)]):
        mixed += [a, b]
    got = run(spark, mixed, M1_PARAMS, M1_CFG).chains.where("machine_id = 'A'").select("window_no", "centroids")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, alone))


def test_m8_missing_property(spark):
    events = [("A", {"d": 1, "e": 5}), ("A", {"d": 2}), ("A", {"d": 3}), ("A", {"d": 4, "e": 6}),
              ("A", {"d": 5}), ("A", {"d": 6}), ("A", {"d": 7}), ("A", {"d": 8}), ("A", {"d": 9})]
    w = run(spark, events, {"d": (2, 0.01), "e": (2, 0.01)}, M1_CFG).windows
    e = {r.window_no: r.values for r in w.where("property_id = 'e'").collect()}
    # window 1 = events 1-4: two values of e; window 4 = events 4-7: one; windows 5.. none
    assert e == {1: [5.0, 6.0], 2: [6.0], 3: [6.0], 4: [6.0]}
    assert w.where("property_id = 'd'").count() == 5


def test_m9_tail_options(spark):
    events = [("A", {"d": 1}), ("A", {"d": 9}), ("A", {"d": 5})]
    none = run(spark, events, M1_PARAMS, M1_CFG).windows
    ref = run(spark, events, M1_PARAMS, M1_CFG.with_(tail="reference")).windows.collect()
    assert none.count() == 0
    assert [(r.window_no, r.values) for r in ref] == [(1, [1.0, 9.0])]
    # 'file': the last event of the stream is never dispatched
    full = run(spark, M1, M1_PARAMS, M1_CFG.with_(tail="file")).windows
    assert full.count() == 2


def test_m10_first_report_wins_across_windows_and_machines(spark):
    rows = [("A", "d", "T3", "t3", 0.1, 1, 5), ("A", "d", "T3", "t3", 0.2, 2, 6), ("B", "d", "T3", "t3", 0.05, 1, 7)]
    df = spark.createDataFrame(rows, "machine_id string, property_id string, timestamp_id string, "
                                     "timestamp_value string, probability double, window_no bigint, trigger_seq bigint")
    out = dedupe_first(df).collect()
    assert [(r.machine_id, r.probability, r.trigger_seq) for r in out] == [("A", 0.1, 5)]


def test_m11_output_triples(spark):
    a = spark.createDataFrame([(0, "Machine_59", "_59_5", "Timestamp_7", "2017-01-01T00:00:00", 1e-05)],
                              "anomaly_no bigint, machine_id string, property_id string, timestamp_id string, "
                              "timestamp_value string, probability double")
    lines = [r.value for r in anomalies_to_triples(a, "http://sys").orderBy("ord").collect()]
    assert len(lines) == 7
    assert lines[0].startswith("<http://sys#Anomaly_0> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type>")
    assert '"1e-05"^^<http://www.w3.org/2001/XMLSchema#double>' in lines[4]
    assert lines[6].endswith('"2017-01-01T00:00:00"^^<http://www.w3.org/2001/XMLSchema#dateTime> .')


def test_empty_events_still_move_the_window(spark):
    events = [("A", {"d": 1}), ("A", {}), ("A", {"d": 9}), ("A", {"d": 1}), ("A", {"d": 2}), ("A", {"d": 3})]
    w = run(spark, events, M1_PARAMS, M1_CFG).windows.orderBy("window_no").collect()
    assert [(r.window_no, r.values) for r in w] == [(1, [1.0, 9.0, 1.0]), (2, [9.0, 1.0, 2.0])]


@settings(max_examples=6, deadline=None)
@given(
    st.lists(st.tuples(st.sampled_from("AB"), st.integers(0, 4), st.integers(0, 3)), min_size=6, max_size=40),
    st.integers(2, 3),
)
def test_matches_sequential_model(spark, raw, k):
    events = [(m, {"d": float(v), "e": float(w)}) for m, v, w in raw]
    params = {"d": (k, 0.3), "e": (2, 0.3)}
    # chunks of 4 events: the split fold (speculative chunks + fix-up rounds) is exercised
    cfg = DetectorConfig(window_size=4, num_transitions=2, fold_chunk_events=4)
    got = run(spark, events, params, cfg).anomalies.orderBy("anomaly_no").collect()
    want = simulate(events, params, 4, 2)
    assert [(r.machine_id, r.property_id, r.timestamp_id, r.probability) for r in got] == want
