"""Stream = batch: stage B over event rows fed in two micro-batches equals the batch detector."""

from pyspark.sql import functions as F

from anomark.config import DetectorConfig
from anomark.plans.detect import detection_stages
from anomark.session import scratch_path
from anomark.streaming.stage_b import start_stage_b
from tests.helpers import build_inputs

EVENTS = [("A", {"d": v}) for v in (1, 9, 1, 1, 9, 9, 5)] + [("B", {"d": v}) for v in (2, 2, 8, 3, 8, 1)]
ORDER = [0, 7, 1, 8, 2, 9, 3, 10, 4, 11, 5, 12, 6]  # machines interleaved in the stream
PARAMS = {"d": (2, 0.6)}
CFG = DetectorConfig(window_size=4, num_transitions=2)


def test_stream_equals_batch(spark):
    events = [EVENTS[i] for i in ORDER]
    groups, obs, machines, mp = build_inputs(spark, events, PARAMS)
    batch = detection_stages(groups, obs, machines, mp, CFG).anomalies
    want = sorted((r.machine_id, r.timestamp_id, r.probability, r.anomaly_no) for r in batch.collect())

    rows = groups.join(
        obs.groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("obs_pos", "property_id", "value"))).alias("obs")),
        "group_id", "left",
    ).select(
        "machine_id", F.struct(F.lit("s").alias("file"), F.col("seq").alias("line")).alias("seq"),
        "group_id", "timestamp_id", "timestamp_value", "obs",
    )
    src, out, ckpt = (scratch_path(spark, n) for n in ("test-stream-src", "test-stream-out", "test-stream-ckpt"))
    # two arrivals, two incremental runs on one checkpoint: state carries across the restart
    for c, cond in enumerate(("seq.line < 6", "seq.line >= 6")):
        rows.where(cond).repartition(3).write.parquet(f"{src}/chunk={c}")
        start_stage_b(spark, src, machines, mp, out, ckpt, CFG).awaitTermination()
    got = sorted((r.machine_id, r.timestamp_id, r.probability, r.anomaly_no) for r in spark.read.parquet(out).collect())
    assert got == want and len(want) > 0


def test_lost_offset_record_stops_the_query(spark):
    import pytest
    from pyspark.errors import StreamingQueryException

    groups, obs, machines, mp = build_inputs(spark, EVENTS, PARAMS)
    rows = groups.join(
        obs.groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("obs_pos", "property_id", "value"))).alias("obs")),
        "group_id", "left",
    ).select(
        "machine_id", F.struct(F.lit("s").alias("file"), F.col("seq").alias("line")).alias("seq"),
        "group_id", "timestamp_id", "timestamp_value", "obs",
    )
    src, out, other, ckpt = (scratch_path(spark, n) for n in ("lost-src", "lost-out", "lost-other", "lost-ckpt"))
    rows.where("seq.line < 6").write.parquet(f"{src}/chunk=0")
    start_stage_b(spark, src, machines, mp, out, ckpt, CFG).awaitTermination()
    rows.where("seq.line >= 6").write.parquet(f"{src}/chunk=1")
    with pytest.raises(StreamingQueryException):
        start_stage_b(spark, src, machines, mp, other, ckpt, CFG).awaitTermination()


def test_unfinished_group_is_carried(spark):
    from anomark.streaming.stage_a import complete_groups

    rows = [("f", 0, "G0", "type", "MoldingMachineObservationGroup"), ("f", 1, "G0", "machine", "M"),
            ("f", 2, "G1", "type", "MoldingMachineObservationGroup"), ("f", 3, "G1", "machine", "M")]
    triples = spark.createDataFrame(rows, "file string, line long, s string, p string, o string").select(
        F.struct("file", "line").alias("seq"), "s", "p", "o")
    done, carry = complete_groups(triples, ended=False)
    assert [r.s for r in done.collect()] == ["G0", "G0"] and [r.s for r in carry.collect()] == ["G1", "G1"]
    done, carry = complete_groups(triples, ended=True)
    assert done.count() == 4 and carry.count() == 0
    done, carry = complete_groups(triples.where("p = 'machine'"), ended=False)
    assert done.count() == 0 and carry.count() == 2
