"""Machine metadata: stateful filter, property allow-list, per-property parameters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anomark.config import DetectorConfig


def machine_properties(
    machines: DataFrame,
    model_properties: DataFrame,
    cfg: DetectorConfig = DetectorConfig(),
) -> DataFrame:
    """(machine_id, property_id, num_clusters, prob_threshold) of every stateful property that
    has both parameters (the others: ``anomark.operators.rejects``).

    The allow-list of ``cfg.properties`` is applied here, before any window is evaluated.
    """
    props = model_properties.where(F.col("stateful") & F.col("num_clusters").isNotNull() & F.col("prob_threshold").isNotNull())
    props = allow_properties(props, cfg.properties)
    return machines.join(props, "model_id").select(
        "machine_id", "property_id", "num_clusters", "prob_threshold"
    )


def allow_properties(df: DataFrame, properties: Sequence[str]) -> DataFrame:
    """Keep only the listed property ids; an empty list keeps all."""
    if not properties:
        return df
    return df.where(F.col("property_id").isin(list(properties)))


def filter_stateful(observations: DataFrame, machines: DataFrame, model_properties: DataFrame) -> DataFrame:
    """Keep observations whose property is declared stateful for the machine's model.

    Unknown properties are dropped like non-stateful ones. How the metadata side travels is
    left to Spark, which broadcasts by bytes and splits a hot machine's side of a sort-merge join.
    """
    stateful = machines.join(model_properties.where(F.col("stateful")), "model_id").select(
        "machine_id", "property_id"
    )
    return observations.join(stateful, ["machine_id", "property_id"], "left_semi")


def with_property_params(observations: DataFrame, machines: DataFrame, model_properties: DataFrame) -> DataFrame:
    """Attach model_id, num_clusters, prob_threshold to observations (machine -> model -> property)."""
    params = machines.join(model_properties, "model_id").select(
        "machine_id", "model_id", "property_id", "num_clusters", "prob_threshold", "stateful"
    )
    return observations.join(params, ["machine_id", "property_id"])
