"""Per-machine sliding count windows (W events, slide 1) over long-format observations.

A window counts the machine's *events*, not its observations: window ``w`` holds the events
``w .. w+W-1`` of the machine and, per stateful property, every value observed in them. With
``lag=1`` the window is evaluated when the machine's event ``w+W`` is dispatched, so the last
full window of each machine is never evaluated; ``lag=0`` evaluates every full window.

Plan: one anchor row per (event, stateful property of the machine's model) plus one row per
observation, shuffled once on (machine, property); a range frame over ``group_seq`` gathers
the values of the last W events and the sequence number of the next event. That exchange is
also the partitioning the warm-start fold needs, so windows and fold share one shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from anomark.config import DetectorConfig
from anomark.operators.sequence import position_within

OBS_STRUCT = "struct<group_seq:bigint,obs_pos:bigint,value:double,timestamp_id:string,timestamp_value:string>"


def sequence_events(groups: DataFrame) -> DataFrame:
    """Add ``group_seq``: 1-based position of each event within its machine, in ``seq`` order."""
    return position_within(groups, ["machine_id"], ["seq"], "group_seq")


def attach_group_seq(observations: DataFrame, ranked_groups: DataFrame) -> DataFrame:
    """Give observations the ``group_seq`` of their event (join on the group id)."""
    if "group_seq" in observations.columns:
        return observations
    return observations.join(
        ranked_groups.select("machine_id", "group_id", "group_seq"), ["machine_id", "group_id"]
    )


def stream_tail(ranked_groups: DataFrame) -> DataFrame:
    """One row: the machine, position and sequence number of the stream's last event."""
    last = F.max_by(F.struct("machine_id", "group_seq", "seq"), F.col("seq"))
    return ranked_groups.agg(last.alias("t")).select(
        F.col("t.machine_id").alias("tail_machine"),
        F.col("t.group_seq").alias("tail_group_seq"),
        F.col("t.seq").alias("tail_seq"),
    )


def _obs_struct(group_seq, obs_pos, value, ts_id, ts_val):
    return F.struct(
        group_seq.cast("bigint").alias("group_seq"),
        obs_pos.cast("bigint").alias("obs_pos"),
        value.cast("double").alias("value"),
        ts_id.cast("string").alias("timestamp_id"),
        ts_val.cast("string").alias("timestamp_value"),
    )


def window_rows(ranked_groups: DataFrame, observations: DataFrame, machine_props: DataFrame) -> DataFrame:
    """Rows for ``windows_from_rows`` from separate events and long-format observations:
    one anchor row per (event, stateful property of its machine) plus one row per value."""
    seq_type = ranked_groups.schema["seq"].dataType
    anchors = ranked_groups.select("machine_id", "group_seq", "seq").join(
        machine_props.select("machine_id", "property_id", "num_clusters", "prob_threshold"),
        "machine_id",
    )
    obs_rows = observations.select(
        "machine_id",
        "property_id",
        "group_seq",
        F.lit(None).cast(seq_type).alias("seq"),
        F.lit(None).cast("int").alias("num_clusters"),
        F.lit(None).cast("double").alias("prob_threshold"),
        _obs_struct(F.col("group_seq"), F.col("obs_pos"), F.col("value"), F.col("timestamp_id"),
                    F.col("timestamp_value")).alias("obs"),
        F.lit(False).alias("is_anchor"),
    )
    anchor_rows = anchors.select(
        "machine_id", "property_id", "group_seq", "seq", "num_clusters", "prob_threshold",
        F.lit(None).cast(OBS_STRUCT).alias("obs"),
        F.lit(True).alias("is_anchor"),
    )
    return anchor_rows.unionByName(obs_rows)


def window_rows_from_events(events: DataFrame, machine_props: DataFrame) -> DataFrame:
    """Rows for ``windows_from_rows`` in one pass over events that carry their values.

    events: (machine_id, group_seq, seq, timestamp_id, timestamp_value,
             obs array<struct<obs_pos, property_id, value>>), one row per event.
    Each event meets the property list of its machine once and
    yields its anchor row and its values of that property: no union of two scans.
    """
    seq_type = events.schema["seq"].dataType
    grid = events.join(
        machine_props.select("machine_id", "property_id", "num_clusters", "prob_threshold"), "machine_id"
    )
    row_t = (f"struct<is_anchor:boolean,seq:{seq_type.simpleString()},num_clusters:int,"
             f"prob_threshold:double,obs:{OBS_STRUCT}>")
    anchor = F.struct(
        F.lit(True).alias("is_anchor"), F.col("seq").alias("seq"), F.col("num_clusters").alias("num_clusters"),
        F.col("prob_threshold").alias("prob_threshold"), F.lit(None).cast(OBS_STRUCT).alias("obs"),
    ).cast(row_t)
    values = F.transform(
        F.filter("obs", lambda o: (o["property_id"] == F.col("property_id")) & o["value"].isNotNull()),
        lambda o: F.struct(
            F.lit(False).alias("is_anchor"), F.lit(None).cast(seq_type).alias("seq"),
            F.lit(None).cast("int").alias("num_clusters"), F.lit(None).cast("double").alias("prob_threshold"),
            _obs_struct(F.col("group_seq"), o["obs_pos"], o["value"], F.col("timestamp_id"),
                        F.col("timestamp_value")).alias("obs"),
        ).cast(row_t),
    )
    rows = grid.select(
        "machine_id", "property_id", "group_seq",
        F.explode(F.concat(F.array(anchor), values)).alias("r"),
    )
    return rows.select(
        "machine_id", "property_id", "group_seq", "r.seq", "r.num_clusters", "r.prob_threshold", "r.obs", "r.is_anchor"
    )


def lane_events(rows: DataFrame) -> DataFrame:
    """Anchor and value rows (``window_rows``) as one row per event and property, for ``fold.lane_rows``."""
    keys = ["machine_id", "property_id", "group_seq"]
    gathered = rows.groupBy(*keys).agg(
        F.max("seq").alias("seq"), F.max("num_clusters").alias("num_clusters"), F.max("prob_threshold").alias("prob_threshold"),
        F.array_sort(F.collect_list("obs")).alias("obs"),
    )
    return gathered.where(F.col("num_clusters").isNotNull()).select(
        *keys, "seq", "num_clusters", "prob_threshold", F.col("obs.value").alias("vals"),
        F.col("obs")[0]["timestamp_id"].alias("timestamp_id"), F.col("obs")[0]["timestamp_value"].alias("timestamp_value"),
    )


def lane_events_from_events(events: DataFrame, machine_props: DataFrame, *keep: str) -> DataFrame:
    """``lane_events`` in one pass over events that carry their values (``window_rows_from_events``), with ``keep`` columns."""
    grid = events.join(
        machine_props.select("machine_id", "property_id", "num_clusters", "prob_threshold"), "machine_id"
    )
    own = F.filter("obs", lambda o: (o["property_id"] == F.col("property_id")) & o["value"].isNotNull())
    return grid.select(
        "machine_id", "property_id", "group_seq", "seq", "num_clusters", "prob_threshold",
        F.transform(F.array_sort(own), lambda o: o["value"]).alias("vals"), "timestamp_id", "timestamp_value", *keep,
    )


def sliding_windows(
    ranked_groups: DataFrame,
    observations: DataFrame,
    machine_props: DataFrame,
    cfg: DetectorConfig = DetectorConfig(),
) -> DataFrame:
    """Windows of every (machine, stateful property) that hold at least one value.

    ranked_groups  (machine_id, group_id, seq, group_seq), one row per event, also events
                   without any stateful value: they still move the window
    observations   (machine_id, group_seq, obs_pos, property_id, value, timestamp_id,
                   timestamp_value); only stateful, numeric values
    machine_props  (machine_id, property_id, num_clusters, prob_threshold); small

    See ``windows_from_rows`` for the result.
    """
    tail = stream_tail(ranked_groups) if cfg.tail != "none" else None
    return windows_from_rows(window_rows(ranked_groups, observations, machine_props), cfg, tail)


def windows_from_rows(
    rows: DataFrame,
    cfg: DetectorConfig = DetectorConfig(),
    tail: DataFrame | None = None,
    only: DataFrame | None = None,
) -> DataFrame:
    """Windows from anchor and value rows (``window_rows`` / ``window_rows_from_events``).

    Returns (machine_id, property_id, chunk, window_no, group_seq [last event of the window],
    trigger_seq, num_clusters, prob_threshold, obs array<struct> in event order, values
    array<double>), hash-partitioned on (machine_id, property_id, chunk) and sorted by
    group_seq inside each partition. ``chunk`` numbers runs of ``cfg.fold_chunk_events``
    events of a machine (always 0 when chunking is off): a hot machine is spread over tasks.
    ``tail`` is ``stream_tail`` of all events, needed for ``cfg.tail``; ``only`` holds the
    (machine_id, property_id, chunk) to build windows of, by default all.
    """
    W = cfg.window_size
    if cfg.tail != "none" and tail is None:
        raise ValueError("cfg.tail needs the stream's last event: pass stream_tail(all events)")
    C = cfg.fold_chunk_events
    g = F.col("group_seq")
    if C:
        # A window belongs to the chunk of its last event. Values are also sent to the next
        # chunk when a window of that chunk still reaches back to them, and the first anchor
        # of a chunk is also sent to the previous one as its "next event": every frame is
        # complete inside its own chunk.
        chunk_of = lambda x: F.floor((x - F.lit(1)) / F.lit(C)).cast("bigint")
        chunks = F.when(
            F.col("is_anchor"), F.array_distinct(F.array(chunk_of(g), chunk_of(F.greatest(g - F.lit(1), F.lit(1)))))
        ).otherwise(F.array_distinct(F.array(chunk_of(g), chunk_of(g + F.lit(W - 1)))))
        rows = rows.withColumn("chunk", F.explode(chunks)).withColumn(
            "is_anchor", F.col("is_anchor") & (F.col("chunk") == chunk_of(g))
        )
    else:
        rows = rows.withColumn("chunk", F.lit(0).cast("bigint"))
    if only is not None:
        rows = rows.join(only, ["machine_id", "property_id", "chunk"], "left_semi")
    rows = rows.repartition("machine_id", "property_id", "chunk")

    by_key = Window.partitionBy("machine_id", "property_id", "chunk").orderBy("group_seq")
    framed = rows.select(
        "*",
        F.collect_list("obs").over(by_key.rangeBetween(-(W - 1), 0)).alias("frame"),
        F.min("seq").over(by_key.rangeBetween(1, 1)).alias("next_seq"),
    ).where(F.col("is_anchor"))

    keep = F.col("group_seq") >= F.lit(W)
    if cfg.lag == 1:
        keep = keep & F.col("next_seq").isNotNull()
        trigger = F.col("next_seq")
    else:
        trigger = F.col("seq")

    if cfg.lag == 1 and cfg.tail != "none":
        framed = framed.crossJoin(F.broadcast(tail))
        if cfg.tail == "file":
            keep = keep & (F.col("next_seq") != F.col("tail_seq"))
        else:  # 'reference': the last machine's short window is flushed too
            short = (
                (F.col("machine_id") == F.col("tail_machine"))
                & (F.col("group_seq") == F.col("tail_group_seq") - 1)
                & (F.col("group_seq") >= 1)
                & (F.col("group_seq") < F.lit(W))
            )
            keep = keep | short

    windows = framed.where(keep & (F.size("frame") > 0)).select(
        "machine_id",
        "property_id",
        "chunk",
        F.greatest(F.lit(1), F.col("group_seq") - F.lit(W - 1)).cast("bigint").alias("window_no"),
        "group_seq",
        trigger.alias("trigger_seq"),
        "num_clusters",
        "prob_threshold",
        F.array_sort("frame").alias("obs"),
    )
    return windows.withColumn("values", F.transform("obs", lambda o: o["value"]))
