"""Stage B: event rows -> anomalies by two stateful operators with typed state.

1. ``MachineDetector``, keyed by machine. In stream order, every incoming event first evaluates the window of the machine's
   previous W events (if it holds W), then enters the window: the same count window with ``lag=1`` as the batch detector. State:
   ``events``, a map of W slots with the last W events (an event rewrites its slot only); ``folds``, a map from property to the
   warm start of its k-means (only properties of evaluated windows are rewritten); ``count``. It does not grow with the stream.
2. ``FirstReport``, keyed by buckets of (property, timestamp id): of the reports of all machines and micro-batches the first counts.
   Its state is a map with one position for each anomaly that has been reported.

Both keep their state in RocksDB, and it can be read through the state data source. For a machine whose share of a micro-batch
is too large for one task see ``anomark.streaming.tables``.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from anomark.config import DetectorConfig
from anomark.functions.kmeans import warm_step
from anomark.functions.lanes import FEW, first_anomalies, padded
from anomark.functions.markov import first_anomaly, labels_of, transition_probabilities
from anomark.operators.metadata import machine_properties
from anomark.operators.output import triple_lines
from anomark.operators.sequence import number_rows
from anomark.streaming.batches import OrderedEvents
from anomark.streaming.files import prune, register
from anomark.streaming.triple_sink import AnomalyTriples

ANOMALY_SCHEMA = (
    "machine_id string, property_id string, timestamp_id string, timestamp_value string, "
    "probability double, window_no bigint, trigger_file string, trigger_line bigint"
)
COLUMNS = [c.split()[0] for c in ANOMALY_SCHEMA.split(", ")]
EVENT_STATE = "timestamp_id string, timestamp_value string, properties array<string>, values array<double>"
WAITING = 1 << 16  # values of the windows whose chains are tested in one go
BUCKETS = 256  # keys of the reports: fixed, since the state is kept by them
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def in_stream_order(frames: list[pd.DataFrame]) -> dict[str, list]:
    """Columns of a key's rows as lists, by position in the stream (a missing one last)."""
    columns = {c: [v for f in frames for v in f[c].tolist()] for c in frames[0].columns}
    places = [(f is None or f != f, f, at is None or at != at, at) for f, at in zip(columns["seq_file"], columns["seq_line"])]
    clean = [(a, "" if a else f, b, 0 if b else at) for a, f, b, at in places]
    order = sorted(range(len(clean)), key=clean.__getitem__)
    return columns if order == list(range(len(order))) else {c: [v[i] for i in order] for c, v in columns.items()}


class Series:
    """The values of each property of ``params`` in a window, in stream order: (value, timestamp id, timestamp value)."""

    def __init__(self, params: dict):
        self.params, self.held, self.order = params, {}, []

    def add(self, event: tuple) -> None:
        tid, tval, properties, numbers = event
        for p, v in zip(properties, numbers):
            if p in self.held:
                self.held[p].append((v, tid, tval))
            elif p in self.params:
                self.held[p] = deque([(v, tid, tval)])
                self.order = sorted(self.held)

    def drop(self, event: tuple) -> None:
        """Leave out the window's first event."""
        for p in event[2]:
            if p in self.held:
                self.held[p].popleft()

    def __iter__(self) -> Iterator[tuple[str, deque]]:
        return ((p, self.held[p]) for p in self.order if self.held[p])


class MachineDetector(StatefulProcessor):
    def __init__(self, cfg: DetectorConfig):
        self.cfg = cfg

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.events = handle.getMapState("events", "slot int", EVENT_STATE)
        self.folds = handle.getMapState("folds", "property_id string", "centroids array<double>, gone double")
        self.count = handle.getValueState("count", "n bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        W = self.cfg.window_size
        new = in_stream_order(list(rows))
        known = new["params"][0]
        params = {} if known is None else {p: (int(v["k"]), float(v["t"])) for p, v in dict(known).items()}
        if self.cfg.properties:
            params = {p: v for p, v in params.items() if p in self.cfg.properties}
        # the maps are read as a whole: a call of its own for each entry costs more than the entries
        slots = {slot: event for (slot,), event in self.events.iterator()}
        n = self.count.get()[0] if slots else 0
        folds = {p: (list(centroids), gone) for (p,), (centroids, gone) in self.folds.iterator()} if n else {}
        window = deque(slots[i % W] for i in range(max(0, n - W), n))
        series = Series(params)
        for event in window:
            series.add(event)
        begun, out, touched, waiting, values = n, [], set(), [], 0
        columns = ("seq_file", "seq_line", "timestamp_id", "timestamp_value", "obs", "forced")
        for seq_file, seq_line, tid, tval, observed, last in zip(*(new[c] for c in columns)):
            forced = self.cfg.tail == "reference" and bool(last) and len(window) > 0
            if len(window) == W or forced:
                at = (max(1, n - W + 1), seq_file, int(seq_line))
                for p, held in series:
                    k, threshold = params[p]
                    numbers = [v for v, _, _ in held]
                    touched.add(p)
                    centroids, folds[p], _ = warm_step(folds.get(p), numbers, k, self.cfg.kmeans_tol)
                    waiting.append((p, numbers, centroids, threshold, list(held), at))
                    values += len(numbers)
                series.drop(window.popleft())
                if values >= WAITING:
                    out += self._hits(key[0], waiting)
                    waiting, values = [], 0
            obs = [] if observed is None else sorted((int(o["obs_pos"]), o["property_id"], float(o["value"])) for o in observed)
            window.append((tid, tval, [p for _, p, _ in obs], [v for _, _, v in obs]))
            series.add(window[-1])
            n += 1
        out += self._hits(key[0], waiting)
        for back, event in enumerate(reversed(list(window)[-min(len(window), n - begun) :])):
            self.events.updateValue(((n - 1 - back) % W,), event)
        for p in touched:
            self.folds.updateValue((p,), folds[p])
        self.count.update((n,))
        if out:
            yield pd.DataFrame(out, columns=COLUMNS)

    def _hits(self, machine: str, waiting: list[tuple]) -> list[tuple]:
        """Rows of the windows (property, values, centroids, threshold, observations, place) whose chain crosses the threshold.

        Clusters depend on the window before, chains do not: those of many windows are tested in one go."""
        if len(waiting) < FEW:
            tested = [
                first_anomaly(transition_probabilities(labels_of(numbers, centroids), len(centroids)), threshold, self.cfg.num_transitions)
                for _, numbers, centroids, threshold, _, _ in waiting
            ]
        else:
            _, numbers, centroids, threshold, _, _ = zip(*waiting)
            found = first_anomalies(padded(numbers), padded(centroids), np.asarray(threshold), self.cfg.num_transitions)
            tested = zip(*(x.tolist() for x in found))
        return [
            (machine, p, *held[index][1:], probability, *at)
            for (p, _, _, _, held, at), (found, index, probability) in zip(waiting, tested) if found
        ]

    def close(self) -> None:
        pass


class FirstReport(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.reported = handle.getMapState("reported", "property_id string, timestamp_id string", "file string, line bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first: dict[tuple, tuple] = {}
        for frame in rows:
            for row in zip(*([None if v != v else v for v in frame[c].tolist()] for c in COLUMNS)):
                machine, p, tid, _, _, window_no, file, line = row
                place = (file is None, file or "", line, machine is None, machine or "", window_no)  # a missing one last
                if (p, tid) not in first or place < first[p, tid][0]:
                    first[p, tid] = (place, row)
        out = []
        for report, (_, row) in first.items():
            if not self.reported.containsKey(report):
                self.reported.updateValue(report, (str(row[6]), int(row[7])))
                out.append(row)
        if out:
            yield pd.DataFrame(out, columns=COLUMNS)

    def close(self) -> None:
        pass


def stage_b(
    events: DataFrame,
    machines: DataFrame,
    model_properties: DataFrame,
    cfg: DetectorConfig = DetectorConfig(),
) -> DataFrame:
    """Streaming anomalies (unnumbered, each reported once) from a stream of event rows."""
    mp = machine_properties(machines, model_properties, cfg)
    # (K, threshold) of every stateful property, one map per machine, joined to the stream
    # (stream-static join; Spark broadcasts it by its bytes or shuffles): nothing goes through the driver
    per_machine = mp.groupBy("machine_id").agg(
        F.map_from_entries(F.collect_list(F.struct(
            "property_id", F.struct(F.col("num_clusters").alias("k"), F.col("prob_threshold").alias("t"))
        ))).alias("params")
    )
    flat = events.select(
        "machine_id", F.col("seq.file").alias("seq_file"), F.col("seq.line").alias("seq_line"),
        "timestamp_id", "timestamp_value", "obs", F.coalesce("forced", F.lit(False)).alias("forced"),
    ).join(per_machine, "machine_id", "left")
    found = flat.groupBy("machine_id").transformWithStateInPandas(MachineDetector(cfg), ANOMALY_SCHEMA, "append", "none")
    # a key of its own for each report costs more than the report
    found = found.withColumn("bucket", F.pmod(F.xxhash64("property_id", "timestamp_id"), F.lit(BUCKETS)).cast("int"))
    return found.groupBy("bucket").transformWithStateInPandas(FirstReport(), ANOMALY_SCHEMA, "append", "none")


def number_batch(spark: SparkSession, found: DataFrame, batch_id: int, base: str) -> None:
    """Write a micro-batch's anomalies (trigger_seq as a position) numbered after those of earlier batches, in output order.

    ``_next/batch_id=`` holds the number that the next batch starts from; a batch after the first that cannot read its
    predecessor's stops the query."""
    offset = 0
    if batch_id:
        offset = spark.read.schema("n bigint").parquet(f"{base}/_next/batch_id={batch_id - 1}").first()["n"]
    numbered = number_rows(found, ["trigger_seq", "property_id"], "anomaly_no", start=offset)
    numbered.write.mode("overwrite").parquet(f"{base}/batch_id={batch_id}")
    found.agg((F.count("*") + offset).alias("n")).write.mode("overwrite").parquet(f"{base}/_next/batch_id={batch_id}")
    prune(base, "_next", batch_id)


def start_stage_b(
    spark: SparkSession,
    events_dir: str,
    machines: DataFrame,
    model_properties: DataFrame,
    out_dir: str,
    checkpoint: str,
    cfg: DetectorConfig = DetectorConfig(),
    ordered: bool = False,
):
    """Start stage B into numbered anomaly folders (one per batch id).

    ``ordered``: the events are stage A's folders, taken one a micro-batch in their order; ``files.caught_up`` runs the query over
    all that are there. Otherwise ``events_dir`` holds any Parquet files, all new ones of which are one arrival: the query takes
    them with ``availableNow`` and ends. A micro-batch's anomalies are written once before they are numbered, so the state
    operators run once. The state needs RocksDB, which is set for the session if it names no other store."""
    from anomark.streaming.stage_a import EVENT_SCHEMA

    named = spark.conf.get(PROVIDER, "")
    if not named or named.endswith("HDFSBackedStateStoreProvider"):
        spark.conf.set(PROVIDER, ROCKSDB)
    base = out_dir.rstrip("/")
    if ordered:
        register(spark, OrderedEvents)
        events = spark.readStream.format("ordered_events").option("path", events_dir).option("record", f"{base}/_read").load()
    else:
        events = spark.readStream.schema(EVENT_SCHEMA).option("recursiveFileLookup", "true").parquet(events_dir)
    anomalies = stage_b(events, machines, model_properties, cfg)

    def sink(batch: DataFrame, batch_id: int) -> None:
        raw = f"{base}/_raw/batch_id={batch_id}"
        # by report, not by bucket: reports of events that share a position are numbered in the order they are written in
        report, parts = ["property_id", "timestamp_id"], int(spark.conf.get("spark.sql.shuffle.partitions"))
        batch.repartition(parts, *report).sortWithinPartitions(*report).write.mode("overwrite").parquet(raw)
        found = spark.read.schema(batch.schema).parquet(raw)
        position = F.struct(F.col("trigger_file").alias("file"), F.col("trigger_line").alias("line"))
        number_batch(spark, found.withColumn("trigger_seq", position).drop("trigger_file", "trigger_line"), batch_id, base)
        prune(base, "_raw", batch_id)

    writer = anomalies.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return writer.start() if ordered else writer.trigger(availableNow=True).start()


def start_triple_sink(spark: SparkSession, anomalies_dir: str, out_dir: str, checkpoint: str, system_uri: str):
    """Start a stream of stage B's numbered anomalies into N-Triples text (``anomark.streaming.triple_sink``), with ``availableNow``."""
    register(spark, AnomalyTriples)
    schema = spark.read.parquet(anomalies_dir).drop("batch_id").schema
    rows = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(anomalies_dir)
    lines = rows.select("anomaly_no", triple_lines(system_uri).alias("lines"))
    return (
        lines.writeStream.format("anomaly_triples").option("path", out_dir).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
