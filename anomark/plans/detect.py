"""Batch anomaly detection: observations -> windows -> warm k-means -> Markov chain -> anomalies.

Shuffles of the plan (all on fine-grained or split keys):
  1. range exchange on (machine, seq) to number each machine's events (hot machines split), written once
  2. hash exchange on (machine, property, chunk): windows, fold, labels, chain test in one pass over the events
  3. hash exchange on (property, timestamp id) of the abnormal windows only (map-side min)
  4. range exchange of the de-duplicated anomalies for their global numbering
Metadata joins are left to Spark, which broadcasts by measured bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anomark.config import DetectorConfig
from anomark.functions.numbers import is_finite
from anomark.operators.anomalies import abnormal_windows, dedupe_first, number_anomalies
from anomark.operators.fold import split_detect
from anomark.operators.metadata import machine_properties
from anomark.operators.windows import (
    attach_group_seq,
    lane_events,
    lane_events_from_events,
    sequence_events,
    stream_tail,
    window_rows,
    window_rows_from_events,
    windows_from_rows,
)


class DetectionStages:
    """Intermediate DataFrames of the detector. ``chains`` (and what follows from it) is built
    on first use: with the split fold it runs Spark jobs, which a caller that only needs the
    windows should not pay for."""

    def __init__(self, ranked_groups, machine_props, observations, rows, events, cfg):
        self.ranked_groups = ranked_groups
        self.machine_props = machine_props
        self.observations = observations
        self._cfg = cfg
        self._events = events
        # the stream's last event comes from all events, also those without a clustered property
        self._tail = stream_tail(ranked_groups) if cfg.tail != "none" else None
        self.windows = windows_from_rows(rows, cfg, self._tail)
        self._chains = None

    @property
    def chains(self) -> DataFrame:
        if self._chains is None:
            self._chains = split_detect(self._events, self._cfg, self._tail)
        return self._chains

    @property
    def abnormal(self) -> DataFrame:
        return abnormal_windows(self.chains)

    @property
    def anomalies(self) -> DataFrame:
        return number_anomalies(dedupe_first(self.abnormal))


def detection_stages(
    groups: DataFrame,
    observations: DataFrame,
    machines: DataFrame,
    model_properties: DataFrame,
    cfg: DetectorConfig = DetectorConfig(),
    ranked_groups: DataFrame | None = None,
) -> DetectionStages:
    """All intermediate DataFrames of the batch detector (lazy until ``chains``).

    groups        (machine_id, group_id, seq, ...): one row per event, in any order
    observations  (machine_id, group_id, obs_pos, property_id, value, timestamp_id,
                  timestamp_value[, group_seq])
    """
    ranked = ranked_groups if ranked_groups is not None else sequence_events(groups)
    mprops = machine_properties(machines, model_properties, cfg)
    obs = observations.join(mprops.select("machine_id", "property_id"), ["machine_id", "property_id"], "left_semi")
    obs = obs.where(is_finite(F.col("value")))
    obs = attach_group_seq(obs, ranked)
    rows = window_rows(ranked, obs, mprops)
    return DetectionStages(ranked, mprops, obs, rows, lane_events(rows), cfg)


def detect_anomalies(
    groups: DataFrame,
    observations: DataFrame,
    machines: DataFrame,
    model_properties: DataFrame,
    cfg: DetectorConfig = DetectorConfig(),
) -> DataFrame:
    """Numbered, de-duplicated anomalies:
    (anomaly_no, machine_id, property_id, timestamp_id, timestamp_value, probability,
    window_no, trigger_seq)."""
    return detection_stages(groups, observations, machines, model_properties, cfg).anomalies


def event_stages(events: DataFrame, cfg: DetectorConfig = DetectorConfig()) -> DetectionStages:
    """Detection stages on the ``events`` table (see ``anomark.sources.events``).

    Events are numbered per machine once; groups and the long-format observations are both
    projected from the numbered rows, so observations carry ``group_seq`` without a join back.
    """
    from anomark.sources.events import (
        groups_from_events,
        machines_from_events,
        model_properties_from_events,
        observations_from_events,
    )

    from anomark.sources.events import nested_events

    keyed = events.select(
        "*",
        F.concat(F.lit("Machine_"), F.col("user_id").cast("string")).alias("machine_id"),
        F.col("event_id").alias("seq"),
    )
    ranked_events = sequence_events(keyed).drop("machine_id", "seq")
    ranked_groups = groups_from_events(ranked_events, keep=("group_seq",))
    observations = observations_from_events(ranked_events, keep=("group_seq",))
    mprops = machine_properties(machines_from_events(events), model_properties_from_events(events), cfg)
    # one pass: each numbered event carries its values into the window stage
    nested = nested_events(ranked_events)
    rows, lanes = window_rows_from_events(nested, mprops), lane_events_from_events(nested, mprops)
    return DetectionStages(ranked_groups, mprops, observations, rows, lanes, cfg)
