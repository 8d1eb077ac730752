"""Stage B with its state in tables: a machine of any share of the stream is spread over tasks.

Each micro-batch of events is detected by the batch operators, with the state that the one before has left as two tables, one
version a batch id: ``tails`` (the last W events of each machine, numbered) and ``folds`` (the warm start of each machine and
property). A machine's events are numbered by ranges, its windows cut into chunks of ``cfg.fold_chunk_events`` events and folded
as in ``anomark.operators.fold``: all chunks in parallel, the first from the carried state, the others made exact by known
transfers. So no task reads more than a chunk of a machine, whatever its share of the micro-batch is. Reports are counted once by
(property, timestamp id) over all machines and micro-batches (``_reported``). A version is deleted when the next but one is written;
a retried micro-batch reads the version before its own and overwrites what it had written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anomark.config import DetectorConfig
from anomark.operators.anomalies import abnormal_windows, dedupe_first
from anomark.operators.fold import split_detect
from anomark.operators.metadata import machine_properties
from anomark.operators.sequence import position_within
from anomark.operators.windows import lane_events_from_events, stream_tail
from anomark.session import stored
from anomark.streaming.batches import OrderedEvents
from anomark.streaming.files import prune, register
from anomark.streaming.stage_b import number_batch

EVENT = ["machine_id", "group_seq", "seq", "timestamp_id", "timestamp_value", "obs"]


def advance(
    events: DataFrame, tails: DataFrame | None, folds: DataFrame | None, machine_props: DataFrame, cfg: DetectorConfig
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One micro-batch: (abnormal windows, tails, folds after it). Runs Spark jobs.

    events: rows of stage A. tails(EVENT columns), folds(machine_id, property_id, st) are those of the micro-batch before."""
    new = position_within(events, ["machine_id"], ["seq"], "place")
    if tails is None:
        rows = new.withColumn("group_seq", F.col("place")).withColumn("since", F.lit(0).cast("bigint"))
    else:
        last = tails.groupBy("machine_id").agg(F.max("group_seq").alias("since"))
        rows = new.join(last, "machine_id", "left").withColumn("since", F.coalesce("since", F.lit(0).cast("bigint")))
        rows = rows.withColumn("group_seq", F.col("place") + F.col("since"))
    forced = rows.where("forced").select("machine_id", "group_seq", "seq")
    rows = rows.select(*EVENT, "since")
    if tails is not None:  # the windows that end in the new events reach back to the old ones
        rows = rows.unionByName(tails.join(last, "machine_id").select(*EVENT, "since"))
    rows = stored(rows, "stream-rows")
    tail = None
    if cfg.tail == "reference" and not forced.isEmpty():
        tail = stream_tail(forced)
    step = cfg if tail is not None else cfg.with_(tail="none")
    lanes = lane_events_from_events(rows, machine_props, "since")
    chains = stored(split_detect(lanes, step, tail, folds, keep_state=True), "stream-chains")
    ended = chains.groupBy("machine_id", "property_id").agg(F.max_by("st", "group_seq").alias("st"))
    if folds is not None:
        ended = ended.unionByName(folds.join(ended, ["machine_id", "property_id"], "left_anti"))
    newest = rows.groupBy("machine_id").agg(F.max("group_seq").alias("n"))
    kept = rows.join(newest, "machine_id").where(F.col("group_seq") > F.col("n") - cfg.window_size).select(EVENT)
    if tails is not None:  # machines without a new event
        kept = kept.unionByName(tails.join(newest, "machine_id", "left_anti").select(EVENT))
    return abnormal_windows(chains), kept, ended


def start_table_detector(
    spark: SparkSession,
    events_dir: str,
    machines: DataFrame,
    model_properties: DataFrame,
    out_dir: str,
    checkpoint: str,
    cfg: DetectorConfig = DetectorConfig(),
):
    """Start the detector on stage A's folders, one a micro-batch; ``files.caught_up`` runs it over all that are there.

    Writes numbered anomalies, one folder a batch id, like ``start_stage_b``."""
    register(spark, OrderedEvents)
    base = out_dir.rstrip("/")
    mprops = machine_properties(machines, model_properties, cfg)
    events = spark.readStream.format("ordered_events").option("path", events_dir).option("record", f"{base}/_read").load()

    def run(batch: DataFrame, batch_id: int) -> None:
        tails = folds = None
        if batch_id:
            tails, folds = (spark.read.parquet(f"{base}/{t}/batch_id={batch_id - 1}") for t in ("_tails", "_folds"))
        found, tails, folds = advance(batch, tails, folds, mprops, cfg)
        tails.write.mode("overwrite").parquet(f"{base}/_tails/batch_id={batch_id}")
        folds.write.mode("overwrite").parquet(f"{base}/_folds/batch_id={batch_id}")
        first = dedupe_first(found)
        if batch_id:
            earlier = spark.read.parquet(f"{base}/_reported").where(F.col("batch_id") < batch_id).select("property_id", "timestamp_id")
            first = first.join(earlier, ["property_id", "timestamp_id"], "left_anti")
        first = stored(first, "stream-first")
        number_batch(spark, first, batch_id, base)
        first.select("property_id", "timestamp_id").write.mode("overwrite").parquet(f"{base}/_reported/batch_id={batch_id}")
        for name in ("_tails", "_folds"):
            prune(base, name, batch_id)

    return events.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).start()
