"""Parts of the streams: ordered source, typed state, state in tables, reports over machines, triple sink."""

import os
import random

import pytest
from pyspark.sql import functions as F

from anomark.config import DetectorConfig
from anomark.operators.output import anomalies_to_triples
from anomark.plans.detect import detection_stages
from anomark.session import scratch_path
from anomark.streaming.files import caught_up, located, register
from anomark.streaming.lines import LineReader, OrderedLines
from anomark.streaming.stage_b import start_stage_b, start_triple_sink
from anomark.streaming.tables import start_table_detector
from anomark.streaming.triple_sink import TripleWriter
from tests.helpers import build_inputs

PARAMS = {"d": (2, 0.6)}
CFG = DetectorConfig(window_size=4, num_transitions=2)


def folder(spark, name):
    """A local path under the tests' checkpoint folder."""
    path = located(scratch_path(spark, name))[1]
    os.makedirs(path)
    return path


def event_rows(groups, obs):
    nested = obs.groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("obs_pos", "property_id", "value"))).alias("obs"))
    return groups.join(nested, "group_id", "left").select(
        "machine_id", F.struct(F.lit("s").alias("file"), F.col("seq").alias("line")).alias("seq"),
        "group_id", "timestamp_id", "timestamp_value", "obs", F.lit(False).alias("forced"),
    )


def reports(rows):
    return sorted((r.anomaly_no, r.machine_id, r.property_id, r.timestamp_id, r.probability, r.window_no) for r in rows.collect())


def in_folders(rows, src, cuts):
    for k, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
        rows.where((F.col("seq.line") >= lo) & (F.col("seq.line") < hi)).write.parquet(f"{src}/batch_id={k}")


@pytest.mark.parametrize("most, split", [(100, 7), (37, 1000), (10**6, 64)])
def test_lines_of_any_cut(spark, most, split):
    """Whatever micro-batches and ranges are, each line comes once, in order, at its byte."""
    rng = random.Random(most)
    path, want = folder(spark, "lines"), []
    for k in range(4):
        lines = ["é" * rng.randrange(0, 30) for _ in range(rng.randrange(0, 40))]
        with open(f"{path}/f{k}.txt", "w", encoding="utf-8") as f:
            f.write("".join(x + "\n" for x in lines) + ("no newline" if k in (1, 3) else ""))
        want += lines + (["no newline"] if k == 1 else [])  # the last file's may still grow
    open(f"{path}/_hidden", "w").write("not read\n")
    reader = LineReader({"path": path, "maxBytesPerTrigger": most, "splitBytes": split})
    at, got, batches = reader.initialOffset(), [], 0
    while (end := dict(reader.latestOffset())) != at:
        rows = [r for part in reader.partitions(at, end) for b in reader.read(part) for r in b.to_pylist()]
        assert sum(len(r["value"].encode()) + 1 for r in rows) <= most + 61
        got += rows
        at, batches = end, batches + 1
    assert [r["value"] for r in got] == want
    assert [(r["file"], r["line"]) for r in got] == sorted((r["file"], r["line"]) for r in got)
    assert batches > 5 or most > 1000
    for r in got[:20]:
        assert open(r["file"], "rb").read()[r["line"] :].startswith(r["value"].encode())


def test_restart_goes_on_behind_the_last_batch(spark):
    path, out, ckpt = (folder(spark, n) for n in ("restart-in", "restart-out", "restart-ckpt"))
    register(spark, OrderedLines)

    def run():
        rows = (
            spark.readStream.format("ordered_lines").option("path", path).option("maxBytesPerTrigger", 200)
            .option("record", f"{ckpt}/at").load()
        )
        caught_up(rows.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{ckpt}/c").start())
        return [r["value"] for r in spark.read.parquet(f"{out}/rows").orderBy("file", "line").collect()]

    want = []
    for k in range(2):
        lines = [f"{k} {i}" for i in range(100)]
        with open(f"{path}/f{k}", "w") as f:
            f.write("".join(x + "\n" for x in lines))
        want += lines
        assert run() == want


def test_one_machine_in_bounded_batches(spark):
    """A machine that has all events: typed state over restarts and state in tables, cut in chunks, both equal the batch."""
    rng = random.Random(11)
    events = [("A", {"d": float(rng.choice([1, 1, 9, rng.randint(0, 9)])), "e": float(rng.randint(0, 2))}) for _ in range(160)]
    params = {"d": (3, 0.4), "e": (2, 0.45)}
    groups, obs, machines, mp = build_inputs(spark, events, params)
    want = reports(detection_stages(groups, obs, machines, mp, CFG).anomalies)
    assert len(want) > 10
    rows = event_rows(groups, obs).cache()
    src = scratch_path(spark, "one-machine")
    in_folders(rows, src, [0, 3, 50, 51, 120, 160])
    out, ckpt = scratch_path(spark, "one-tables"), scratch_path(spark, "one-tables-ckpt")
    cfg = CFG.with_(fold_chunk_events=8)
    caught_up(start_table_detector(spark, src, machines, mp, out, ckpt, cfg))
    assert reports(spark.read.parquet(out)) == want
    out, ckpt = scratch_path(spark, "one-typed"), scratch_path(spark, "one-typed-ckpt")
    caught_up(start_stage_b(spark, src, machines, mp, out, ckpt, CFG, ordered=True))
    assert reports(spark.read.parquet(out)) == want
    # the state can be read: the last W events by slot, one fold a property, the number of events
    state = lambda operator, name: spark.read.format("statestore").option("operatorId", operator).option("stateVarName", name).load(ckpt)
    found = {name: state(o, name).collect() for o in (0, 1) for name in ("events", "folds", "count") if o == operator_of(spark, ckpt)}
    assert sorted(r["user_map_key"]["slot"] for r in found["events"]) == [0, 1, 2, 3]
    assert sorted(r["user_map_key"]["property_id"] for r in found["folds"]) == ["d", "e"]
    assert [r["value"]["n"] for r in found["count"]] == [160]


def operator_of(spark, ckpt):
    """Number of the operator keyed by machine."""
    rows = spark.read.format("state-metadata").load(ckpt).select("operatorId", "operatorProperties").distinct().collect()
    return next(r["operatorId"] for r in rows if "folds" in (r["operatorProperties"] or ""))


def test_machines_that_share_a_timestamp(spark):
    """A report counts once by (property, timestamp id), over machines and micro-batches."""
    values = (1, 9, 1, 1, 9, 9, 5, 1, 9, 9, 1, 9, 1, 1, 9)
    events = [(m, {"d": float(v)}) for v in values for m in "AB"]
    groups, obs, machines, mp = build_inputs(spark, events, PARAMS)
    shared = lambda df: df.withColumn("timestamp_id", F.regexp_replace("timestamp_id", "[0-9]+$", ""))
    number = F.floor(F.col("seq") / 2).cast("string")
    groups = groups.withColumn("timestamp_id", F.concat(F.lit("T"), number))
    obs = shared(obs).drop("timestamp_id").join(groups.select("group_id", "timestamp_id"), "group_id")
    want = reports(detection_stages(groups, obs, machines, mp, CFG).anomalies)
    src = scratch_path(spark, "shared-ids")
    in_folders(event_rows(groups, obs), src, [0, 11, 19, 30])
    for start in (start_stage_b, start_table_detector):
        out, ckpt = scratch_path(spark, "shared-out"), scratch_path(spark, "shared-ckpt")
        more = {"ordered": True} if start is start_stage_b else {}
        caught_up(start(spark, src, machines, mp, out, ckpt, CFG, **more))
        assert reports(spark.read.parquet(out)) == want
    assert len({t for _, _, _, t, _, _ in want}) == len(want) > 1


def test_triple_sink(spark):
    """Lines of several micro-batches in order; a micro-batch that is committed again replaces what it had written."""
    events = [("A", {"d": v}) for v in (1, 9, 1, 1, 9, 9, 5, 1, 9, 9, 1, 9, 1, 1, 9)]
    anomalies = detection_stages(*build_inputs(spark, events, PARAMS), CFG).anomalies.cache()
    lines = [r["value"] for r in anomalies_to_triples(anomalies, "http://x").orderBy("anomaly_no", "ord").collect()]
    src, ckpt = scratch_path(spark, "sink-in"), scratch_path(spark, "sink-ckpt")
    out = folder(spark, "sink-out")
    for k in range(2):
        anomalies.where(F.floor(F.col("anomaly_no") % 5 / 3) == k).repartition(3).write.parquet(f"{src}/batch_id={k}")
        start_triple_sink(spark, src, out, ckpt, "http://x").awaitTermination()

    def written():
        names = sorted(n for n in os.listdir(out) if n.startswith("anomalies-"))
        return [x for n in names for x in open(f"{out}/{n}").read().splitlines()]

    assert written() == lines and len(lines) == 7 * anomalies.count() > 7
    # the second micro-batch again, in one task now, as after a crash before Spark's own record; an aborted one leaves nothing
    writer = TripleWriter({"path": out})
    again = [{"anomaly_no": r["anomaly_no"], "lines": lines[7 * r["anomaly_no"] : 7 * r["anomaly_no"] + 7]}
             for r in anomalies.where(F.floor(F.col("anomaly_no") % 5 / 3) == 1).collect()]
    writer.commit([writer.write(iter(again)), None], 1)
    assert written() == lines
    before = sorted(os.listdir(f"{out}/_staged"))
    writer.abort([writer.write(iter(again)), None], 2)
    assert sorted(os.listdir(f"{out}/_staged")) == before and written() == lines
