"""Sensor-event view of the ``events`` table.

Mapping (one event = one observation group):
  machine            'Machine_' || user_id, model 'MachineModel_' || (user_id % 5)
  order, group id    event_id, 'ObservationGroup_' || event_id
  timestamp          'Timestamp_' || event_id, ts as xsd:dateTime text
  property _<m>_0    value            stateful, K = 3,           threshold 0.005
  property _<m>_1    props.k          stateful, K = 2 + m % 3,   threshold 0.005
  property _<m>_2    event_type       not stateful
with m = user_id % 5. These rows only feed the detector input of the right schema; the
detector does all of its work on them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anomark.functions.numbers import finite_double
from anomark.functions.text import python_float_text

TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"

# Fixed parameters of the mapping above.
NUM_MODELS = 5
VALUE_CLUSTERS = 3
THRESHOLD = 0.005


def model_no(user: Column) -> Column:
    return F.pmod(user, F.lit(NUM_MODELS))


def machine_id(user: Column) -> Column:
    return F.concat(F.lit("Machine_"), user.cast("string"))


def property_id(user: Column, j: int) -> Column:
    return F.concat(F.lit("_"), model_no(user).cast("string"), F.lit(f"_{j}"))


def groups_from_events(events: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """observation_groups(machine_id, seq, group_id, timestamp_id, timestamp_value, cycle)."""
    e = F.col("event_id")
    return events.select(
        *keep,
        machine_id(F.col("user_id")).alias("machine_id"),
        e.alias("seq"),
        F.concat(F.lit("ObservationGroup_"), e.cast("string")).alias("group_id"),
        F.concat(F.lit("Timestamp_"), e.cast("string")).alias("timestamp_id"),
        F.date_format("ts", TS_FORMAT).alias("timestamp_value"),
        F.concat(F.lit("Cycle_"), e.cast("string")).alias("cycle"),
    )


def _obs_array(user: Column) -> Column:
    k_text = F.get_json_object("props", "$.k")
    return F.array(
        F.struct(F.lit(0).cast("bigint").alias("obs_pos"), property_id(user, 0).alias("property_id"),
                 python_float_text(F.col("value")).alias("raw_value")),
        F.struct(F.lit(1).cast("bigint").alias("obs_pos"), property_id(user, 1).alias("property_id"),
                 k_text.alias("raw_value")),
        F.struct(F.lit(2).cast("bigint").alias("obs_pos"), property_id(user, 2).alias("property_id"),
                 F.col("event_type").alias("raw_value")),
    )


def observations_from_events(events: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """observations in long format, one row per (event, property), ``value`` null if raw_value is no finite number."""
    user = F.col("user_id")
    e = F.col("event_id")
    base = events.select(
        *keep,
        machine_id(user).alias("machine_id"),
        e.alias("seq"),
        F.concat(F.lit("ObservationGroup_"), e.cast("string")).alias("group_id"),
        F.concat(F.lit("Timestamp_"), e.cast("string")).alias("timestamp_id"),
        F.date_format("ts", TS_FORMAT).alias("timestamp_value"),
        F.explode(_obs_array(user)).alias("o"),
    )
    return base.select(
        *keep,
        "machine_id", "seq", "group_id", "timestamp_id", "timestamp_value",
        "o.obs_pos", "o.property_id", "o.raw_value",
        finite_double(F.col("o.raw_value")).alias("value"),
    )


def machines_from_events(events: DataFrame) -> DataFrame:
    """machines(machine_id, model_id): one row per distinct user."""
    users = events.select("user_id").distinct()
    return users.select(
        machine_id(F.col("user_id")).alias("machine_id"),
        F.concat(F.lit("MachineModel_"), model_no(F.col("user_id")).cast("string")).alias("model_id"),
    )


def model_properties_from_events(events: DataFrame) -> DataFrame:
    """model_properties(model_id, property_id, num_clusters, prob_threshold, stateful)."""
    models = events.select(model_no(F.col("user_id")).alias("m")).distinct()
    m = F.col("m")
    props = F.array(
        F.struct(F.lit(0).alias("j"), F.lit(VALUE_CLUSTERS).alias("k"), F.lit(THRESHOLD).alias("t"), F.lit(True).alias("s")),
        F.struct(F.lit(1).alias("j"), (F.lit(2) + F.pmod(m, F.lit(3))).cast("int").alias("k"),
                 F.lit(THRESHOLD).alias("t"), F.lit(True).alias("s")),
        F.struct(F.lit(2).alias("j"), F.lit(None).cast("int").alias("k"), F.lit(None).cast("double").alias("t"),
                 F.lit(False).alias("s")),
    )
    return models.select("m", F.explode(props).alias("p")).select(
        F.concat(F.lit("MachineModel_"), m.cast("string")).alias("model_id"),
        F.concat(F.lit("_"), m.cast("string"), F.lit("_"), F.col("p.j").cast("string")).alias("property_id"),
        F.col("p.k").cast("int").alias("num_clusters"),
        F.col("p.t").cast("double").alias("prob_threshold"),
        F.col("p.s").alias("stateful"),
    )


def nested_events(events: DataFrame) -> DataFrame:
    """One row per event with its numeric values nested:
    (machine_id, group_seq, seq, timestamp_id, timestamp_value,
     obs array<struct<obs_pos, property_id, value>>). Needs ``group_seq``."""
    user = F.col("user_id")
    e = F.col("event_id")
    obs = F.transform(
        _obs_array(user),
        lambda o: F.struct(
            o["obs_pos"].alias("obs_pos"), o["property_id"].alias("property_id"),
            finite_double(o["raw_value"]).alias("value"),
        ),
    )
    return events.select(
        machine_id(user).alias("machine_id"),
        "group_seq",
        e.alias("seq"),
        F.concat(F.lit("Timestamp_"), e.cast("string")).alias("timestamp_id"),
        F.date_format("ts", TS_FORMAT).alias("timestamp_value"),
        obs.alias("obs"),
    )
