"""Anomaly rows: first-wins de-duplication and emission numbering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anomark.operators.sequence import number_rows

ANOMALY_COLUMNS = [
    "machine_id",
    "property_id",
    "timestamp_id",
    "timestamp_value",
    "probability",
    "window_no",
    "trigger_seq",
]


def abnormal_windows(detected: DataFrame) -> DataFrame:
    """One row per (window, property) whose chain crossed the threshold."""
    return detected.where(F.col("chain.found")).select(
        "machine_id",
        "property_id",
        F.col("abnormal_timestamp_id").alias("timestamp_id"),
        F.col("abnormal_timestamp_value").alias("timestamp_value"),
        F.col("chain.prob").alias("probability"),
        "window_no",
        "trigger_seq",
    )


def dedupe_first(anomalies: DataFrame) -> DataFrame:
    """Keep the first report per (property, timestamp id) in dispatch order.

    The machine is not part of the key. Written as an aggregate on the struct ordered by
    dispatch position, so the map side keeps one candidate per key before the shuffle
    (a hot key costs one row per task, not all its reports).
    """
    first = F.min(F.struct("trigger_seq", "machine_id", "window_no", "timestamp_value", "probability"))
    return anomalies.groupBy("property_id", "timestamp_id").agg(first.alias("f")).select(
        F.col("f.machine_id").alias("machine_id"),
        "property_id",
        "timestamp_id",
        F.col("f.timestamp_value").alias("timestamp_value"),
        F.col("f.probability").alias("probability"),
        F.col("f.window_no").alias("window_no"),
        F.col("f.trigger_seq").alias("trigger_seq"),
    )


def number_anomalies(anomalies: DataFrame, offset: int = 0) -> DataFrame:
    """``anomaly_no`` = emission order: dispatch position of the trigger, then property id."""
    numbered = number_rows(anomalies, ["trigger_seq", "property_id"], "anomaly_no", start=offset)
    return numbered.select("anomaly_no", *ANOMALY_COLUMNS)
