"""How often the streams and the rejects read what they work on."""

import random

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.datasource import CaseInsensitiveDict

from anomark.config import DetectorConfig
from anomark.functions.markov import first_anomaly
from anomark.operators.rejects import observation_rejects
from anomark.session import scratch_path
from anomark.sources.triples import END_OF_STREAM, render_observation_triples
from anomark.streaming import stage_b
from anomark.streaming.files import caught_up, listed, located
from anomark.streaming.stage_a import start_stage_a
from anomark.streaming.lines import LineReader
from anomark.streaming.stage_b import COLUMNS, FirstReport, MachineDetector
from tests.helpers import build_inputs


def test_rejects_read_observations_once(spark):
    groups = spark.createDataFrame([("M1", "G0"), (None, "G1"), ("M9", "G2"), (None, "G1")], "machine_id string, group_id string")
    observations = spark.createDataFrame(
        [("M1", "G0", "p", "1", 1.0), ("M1", "G0", "p", "x", None), ("M1", "G0", "p", "NaN", None), ("M1", "G0", "p", None, None),
         ("M1", "G0", "q", "x", None), ("M1", "G0", None, "1", 1.0), ("M1", "G0", "z", "1", 1.0), ("M2", "G3", "p", "1", 1.0),
         ("M9", "G2", "p", "x", None), (None, "G1", "p", "x", None)],
        "machine_id string, group_id string, property_id string, raw_value string, value double")
    # M1 is named twice, M2 has no model, r says nothing of being stateful
    machines = spark.createDataFrame([("M1", "A"), ("M1", "A"), ("M2", None), (None, "A")], "machine_id string, model_id string")
    properties = spark.createDataFrame([("A", "p", True), ("A", "q", False), ("A", "r", None)], "model_id string, property_id string, stateful boolean")
    found = observation_rejects(groups, observations, machines, properties)
    got = sorted((r.reason, r.item) for r in found.collect())
    want = [("group without machine", "G1")] * 2 + [("unknown machine", "G2")] + [("value is not finite", "G0/p")] * 2
    want += [("value is not numeric", "G0/p")] * 4 + [("unknown property", "G0")] + [("unknown property", "G0/z"), ("unknown property", "G3/p")]
    assert got == sorted(want)
    path = scratch_path(spark, "rejects-once")
    observations.write.parquet(path)
    plan = observation_rejects(groups, spark.read.parquet(path), machines, properties)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 1


class Held:
    """State in a dictionary that refuses to be read entry by entry."""

    def __init__(self):
        self.kept = {}

    def iterator(self):
        return iter(list(self.kept.items()))

    def updateValue(self, key, value):
        self.kept[key] = value

    def getValue(self, key):
        raise AssertionError("one call an entry")

    containsKey = getValue

    def exists(self):
        return bool(self.kept)

    def get(self):
        return self.kept[()]

    def update(self, value):
        self.kept[()] = value


def test_state_is_read_as_a_whole():
    values = [1.0, 9.0, 1.0, 1.0, 9.0, 9.0, 5.0, 1.0, 9.0, 9.0, 1.0, 9.0, 1.0, 1.0, 9.0]
    rows = pd.DataFrame({
        "seq_file": "s", "seq_line": range(len(values)), "timestamp_id": [f"T{i}" for i in range(len(values))], "timestamp_value": "t",
        "obs": [[{"obs_pos": 0, "property_id": "d", "value": v}] for v in values], "forced": False,
        "params": [{"d": {"k": 2, "t": 0.6}}] * len(values),
    })

    def run(cuts):
        detector = MachineDetector(DetectorConfig(window_size=4, num_transitions=2))
        detector.events, detector.folds, detector.count = Held(), Held(), Held()
        out = []
        for lo, hi in zip(cuts, cuts[1:]):
            part = rows.iloc[lo:hi].iloc[::-1]  # in any order, in several frames
            out += [f for f in detector.handleInputRows(("A",), iter([part.iloc[:2], part.iloc[2:]]), None)]
        assert all(len(f) for f in out) and detector.count.get() == (len(values),)
        return [tuple(r) for f in out for r in f.itertuples(index=False)]

    assert run([0, 3, 9, len(values)]) == run([0, len(values)]) != []


def test_micro_batch_is_assembled_once(spark):
    """The rejects and the events of a micro-batch come from the groups and observations that it has written."""
    groups, obs, machines, mp = build_inputs(spark, [("A", {"d": float(v)}) for v in (1, 9, 1, 9)] + [("X", {"d": 1.0})], {"d": (2, 0.6)})
    machines = machines.where("machine_id <> 'X'")
    groups = groups.withColumn("cycle", F.lit("C0"))
    obs = obs.join(groups.select("group_id", "seq"), "group_id").withColumn("raw_value", F.col("value").cast("string"))
    lines = render_observation_triples(groups, obs)
    src, out, ckpt = (scratch_path(spark, n) for n in ("once-text", "once-events", "once-ckpt"))
    lines.coalesce(1).sortWithinPartitions("seq.line").select("value").write.text(f"{src}/a")
    spark.range(1).select(F.lit(END_OF_STREAM).alias("value")).write.text(f"{src}/b")
    caught_up(start_stage_a(spark, src, machines, mp, out, ckpt))
    folders = {f.path.split("/")[-3] for f in listed(located(out)[0], f"{located(out)[1]}/_observations") if f.path.endswith(".parquet")}
    assert folders == {"_observations"}
    assert spark.read.parquet(f"{out}/_observations/batch_id=*").count() == 5
    assert [(r.reason, r["item"]) for r in spark.read.parquet(f"{out}/_rejects/batch_id=*").collect() if r.reason == "unknown machine"]
    assert spark.read.parquet(f"{out}/batch_id=*").where("size(obs) = 1").count() == 4


def test_line_source_heeds_its_options():
    """Spark hands a source its options in lower case."""
    options = dict(CaseInsensitiveDict({"path": "p", "maxBytesPerTrigger": "1000", "splitBytes": "10", "record": None}))
    reader = LineReader(options)
    assert (reader.most, reader.split) == (1000, 10)


def test_reports_of_a_bucket():
    """Many reports under one key: the first of each counts, in any order and over calls, with missing names too."""
    of = lambda *rows: pd.DataFrame(rows, columns=COLUMNS)
    row = lambda tid, line, machine="A", window=1: (machine, "d", tid, "t", 0.5, window, "s", line)
    report = FirstReport()
    report.reported = Held()
    report.reported.containsKey = lambda k: k in report.reported.kept
    call = lambda *frames: sorted((r.timestamp_id or "", r.machine_id or "", r.trigger_line) for f in report.handleInputRows((3,), iter(frames), None) for r in f.itertuples())
    assert call(of(row("T2", 9), row("T1", 5), row("T2", 7, "B")), of(row("T2", 7, "A", 2), row(None, 8, None), row(None, 8, "C"))) == [("", "C", 8), ("T1", "A", 5), ("T2", "A", 7)]
    assert call(of(row("T1", 1), row("T3", 9))) == [("T3", "A", 9)]
    assert call(of(row(None, 1))) == []


def test_chains_of_many_windows_are_tested_at_once(monkeypatch):
    """Windows that are tested together give what each gives alone, whatever their size and however many values an event has."""
    rng = random.Random(5)
    n = 120
    obs = [[{"obs_pos": k, "property_id": rng.choice("dxe"), "value": float(rng.randint(0, 6))} for k in range(rng.randint(0, 3))] for _ in range(n)]
    rows = pd.DataFrame({
        "seq_file": "s", "seq_line": range(n), "timestamp_id": [f"T{i}" for i in range(n)], "timestamp_value": "t", "obs": obs,
        "forced": False, "params": [{"d": {"k": 3, "t": 0.4}, "e": {"k": 1, "t": 0.4}, "x": {"k": 4, "t": 0.5}}] * n,
    })
    calls = []
    monkeypatch.setattr(stage_b, "first_anomaly", lambda *a: calls.append(a) or first_anomaly(*a))

    def run(waiting, few):
        monkeypatch.setattr(stage_b, "WAITING", waiting)
        monkeypatch.setattr(stage_b, "FEW", few)
        detector = MachineDetector(DetectorConfig(window_size=6, num_transitions=2, properties=("d", "e", "x")))
        detector.events, detector.folds, detector.count = Held(), Held(), Held()
        return [tuple(r) for f in detector.handleInputRows(("A",), iter([rows]), None) for r in f.itertuples(index=False)]

    alone = run(1, 10**6)
    assert len(alone) > 10 and calls
    calls.clear()
    assert run(50, 12) == run(1 << 16, 12) == alone
    assert len(calls) < n
