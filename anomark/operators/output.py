"""Anomalies as N-Triples text, and the wide per-event export."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anomark.functions.text import python_float_text

# Fixed vocabulary of the result triples (must equal the original output for parity).
RDF_TYPE = "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>"
MACHINE_PRED = "<http://www.agtinternational.com/ontologies/I4.0#machine>"
IOT_NS = "http://www.agtinternational.com/ontologies/IoTCore#"
RESULT_NS = "http://www.agtinternational.com/ontologies/DEBSAnalyticResults#"
WMM_NS = "http://www.agtinternational.com/ontologies/WeidmullerMetadata#"
XSD_DOUBLE = "<http://www.w3.org/2001/XMLSchema#double>"
XSD_DATETIME = "<http://www.w3.org/2001/XMLSchema#dateTime>"


def _iri(ns: str, local) -> F.Column:
    return F.concat(F.lit(f"<{ns}"), local, F.lit(">"))


def triple_lines(system_uri: str) -> F.Column:
    """The lines of an anomaly in output order, as one array without nulls."""
    return F.array_compact(_lines(system_uri))


def anomalies_to_triples(anomalies: DataFrame, system_uri: str) -> DataFrame:
    """Seven N-Triples lines per anomaly, in output order: (anomaly_no, ord, value).

    Needs (anomaly_no, machine_id, property_id, timestamp_id, timestamp_value, probability).
    The probability literal is written as Python writes a float; a missing timestamp text
    omits the last line.
    """
    out = anomalies.select("anomaly_no", F.posexplode(_lines(system_uri)).alias("ord", "value"))
    return out.where(F.col("value").isNotNull()).select(
        F.col("anomaly_no").cast("bigint").alias("anomaly_no"), F.col("ord").cast("int").alias("ord"), "value"
    )


def _lines(system_uri: str) -> F.Column:
    sys_ns = f"{system_uri}#"
    anomaly = _iri(sys_ns, F.concat(F.lit("Anomaly_"), F.col("anomaly_no").cast("string")))
    ts = _iri(sys_ns, F.col("timestamp_id"))

    def triple(s, p, o):
        return F.concat(s, F.lit(" "), p, F.lit(" "), o, F.lit(" ."))

    return F.array(
        triple(anomaly, F.lit(RDF_TYPE), F.lit(f"<{RESULT_NS}Anomaly>")),
        triple(anomaly, F.lit(MACHINE_PRED), _iri(WMM_NS, F.col("machine_id"))),
        triple(anomaly, F.lit(f"<{RESULT_NS}inAbnormalDimension>"), _iri(WMM_NS, F.col("property_id"))),
        triple(anomaly, F.lit(f"<{RESULT_NS}hasTimeStamp>"), ts),
        triple(
            anomaly,
            F.lit(f"<{RESULT_NS}hasProbabilityOfObservedAbnormalSequence>"),
            F.concat(F.lit('"'), python_float_text(F.col("probability")), F.lit(f'"^^{XSD_DOUBLE}')),
        ),
        triple(ts, F.lit(RDF_TYPE), F.lit(f"<{IOT_NS}Timestamp>")),
        triple(
            ts,
            F.lit(f"<{IOT_NS}ValueLiteral>"),
            F.concat(F.lit('"'), F.col("timestamp_value"), F.lit(f'"^^{XSD_DATETIME}')),
        ),
    )


def write_triples(lines: DataFrame, path: str) -> None:
    """Text files of (anomaly_no, ord, value) lines: read in the order of their names they are in
    output order, and the lines of one anomaly stand together in one file."""
    lines.repartitionByRange("anomaly_no").sortWithinPartitions("anomaly_no", "ord").select("value").write.text(path)


def write_wide_csv(wide: DataFrame, path: str) -> None:
    """CSV files of the wide export, each with a header line."""
    wide.write.option("header", True).csv(path)


def wide_export(observations: DataFrame, properties: Sequence[str] | None = None) -> DataFrame:
    """One row per event: machine_id, timestamp_id, then one value column per property.

    Values are aligned by property name (a property missing from an event is null; of several
    values the first in the event). Pass the property list (from metadata) to avoid the extra job that discovers pivot values.
    """
    grouped = observations.groupBy("machine_id", "timestamp_id")
    pivoted = grouped.pivot("property_id", list(properties) if properties is not None else None)
    return pivoted.agg(F.min_by("value", "obs_pos"))
