"""Named queries over a folder of the test tables (used by ``__spark_entry__`` and the bench).

Each takes (spark, data_dir) and returns a DataFrame whose column names and types match the
DuckDB oracle of the same name. Sensor events come from the ``events`` table through
``anomark.sources.events``; every query runs on the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anomark.config import DetectorConfig
from anomark.operators.anomalies import number_anomalies, dedupe_first, abnormal_windows
from anomark.operators.clustering import cold_kmeans, label_values, seed_values, warm_kmeans
from anomark.operators.markov import (
    detect_first_anomaly,
    transition_matrix,
    transition_pairs,
    transition_probabilities,
)
from anomark.operators.output import anomalies_to_triples
from anomark.plans.detect import event_stages
from anomark.sources.tables import load_table

SYSTEM_URI = "http://example.org/anomark"


def _events(spark: SparkSession, data_dir: str) -> DataFrame:
    return load_table(spark, data_dir, "events")


def _stages(spark, data_dir, cfg=DetectorConfig()):
    return event_stages(_events(spark, data_dir), cfg)


def q_sliding_windows(spark: SparkSession, data_dir: str) -> DataFrame:
    w = _stages(spark, data_dir).windows
    return w.select(
        "machine_id", "property_id", "window_no", "trigger_seq", F.posexplode("obs").alias("pos", "o")
    ).select(
        "machine_id", "property_id", "window_no", "trigger_seq",
        F.col("pos").cast("bigint").alias("pos"),
        F.col("o.value").alias("value"),
        F.col("o.timestamp_id").alias("timestamp_id"),
    )


def q_tail_flush(spark: SparkSession, data_dir: str) -> DataFrame:
    w = _stages(spark, data_dir, DetectorConfig(tail="reference")).windows
    return w.select(
        "machine_id", "property_id", "window_no", "trigger_seq",
        F.size("values").cast("bigint").alias("n_values"),
        F.round(F.aggregate("values", F.lit(0.0), lambda a, v: a + v), 6).alias("sum_values"),
    )


def q_seed_values(spark: SparkSession, data_dir: str) -> DataFrame:
    s = seed_values(_stages(spark, data_dir).windows)
    return s.select(
        "machine_id", "property_id", "window_no", F.posexplode("seeds").alias("seed_no", "seed")
    ).withColumn("seed_no", F.col("seed_no").cast("bigint"))


def _centroid_rows(df: DataFrame) -> DataFrame:
    return df.select(
        "machine_id", "property_id", "window_no", F.posexplode("centroids").alias("centroid_no", "centroid")
    ).select(
        "machine_id", "property_id", "window_no",
        F.col("centroid_no").cast("bigint").alias("centroid_no"),
        F.round("centroid", 9).alias("centroid"),
    )


def q_cold_kmeans(spark: SparkSession, data_dir: str) -> DataFrame:
    return _centroid_rows(cold_kmeans(_stages(spark, data_dir).windows))


FOLDED = ["machine_id", "property_id", "chunk", "window_no", "group_seq", "num_clusters", "values"]


def q_warm_kmeans(spark: SparkSession, data_dir: str) -> DataFrame:
    return _centroid_rows(warm_kmeans(_stages(spark, data_dir).windows.select(*FOLDED), partitioned=True))


def q_warm_kmeans_split(spark: SparkSession, data_dir: str) -> DataFrame:
    """The warm-start fold with every key cut into chunks of 4 W events: speculative chunks
    plus fix-up rounds (two rounds on the sf0.01 events) give the sequential fold's centroids."""
    cfg = DetectorConfig(fold_chunk_events=4 * DetectorConfig().window_size)
    return _centroid_rows(warm_kmeans(_stages(spark, data_dir, cfg).windows.select(*FOLDED), cfg, partitioned=True))


def _seed_labels(spark, data_dir) -> DataFrame:
    """Labels against each window's seeds (fixed centroids): isolates OP-18..21 from the fold."""
    s = seed_values(_stages(spark, data_dir).windows).withColumn("centroids", F.col("seeds"))
    return label_values(s)


def q_label_values(spark: SparkSession, data_dir: str) -> DataFrame:
    l = _seed_labels(spark, data_dir)
    return l.select(
        "machine_id", "property_id", "window_no", F.posexplode("labels").alias("pos", "label")
    ).withColumn("pos", F.col("pos").cast("bigint"))


def q_transition_matrix(spark: SparkSession, data_dir: str) -> DataFrame:
    l = _seed_labels(spark, data_dir).transform(transition_pairs).transform(transition_probabilities)
    m = transition_matrix(l)
    return m.select(
        "machine_id", "property_id", "window_no",
        F.col("src").cast("int").alias("src"), F.col("dst").cast("int").alias("dst"),
        F.round("p_cell", 12).alias("p"),
    )


def q_chain_anomalies(spark: SparkSession, data_dir: str) -> DataFrame:
    l = _seed_labels(spark, data_dir).transform(transition_pairs).transform(transition_probabilities)
    d = detect_first_anomaly(l).where(F.col("chain.found"))
    return d.select(
        "machine_id", "property_id", "window_no", "trigger_seq",
        F.col("chain.idx").cast("int").alias("abnormal_index"),
        F.round("chain.prob", 9).alias("probability"),
        F.col("abnormal_timestamp_id").alias("timestamp_id"),
    )


def _anomaly_rows(a: DataFrame) -> DataFrame:
    return a.select(
        "anomaly_no", "machine_id", "property_id", "timestamp_id", "timestamp_value",
        F.round("probability", 9).alias("probability"), "window_no", "trigger_seq",
    )


def q_anomalies(spark: SparkSession, data_dir: str) -> DataFrame:
    return _anomaly_rows(_stages(spark, data_dir).anomalies)


def _window_sums(w: DataFrame) -> DataFrame:
    return w.select(
        "machine_id", "property_id", "window_no", "trigger_seq",
        F.size("values").cast("bigint").alias("n_values"),
        F.round(F.aggregate("values", F.lit(0.0), lambda a, v: a + v), 6).alias("sum_values"),
    )


SHORT_WINDOW = 128  # more events than a machine of the test tables has


def q_tail_flush_short(spark: SparkSession, data_dir: str) -> DataFrame:
    """The last machine's window is flushed at the stream's end although it never filled."""
    return _window_sums(_stages(spark, data_dir, DetectorConfig(window_size=SHORT_WINDOW, tail="reference")).windows)


def q_tail_file(spark: SparkSession, data_dir: str) -> DataFrame:
    """The stream's last event is never dispatched."""
    return _window_sums(_stages(spark, data_dir, DetectorConfig(tail="file")).windows)


TWO_MODELS = ("_0_0", "_1_0")


def q_tail_allow_list(spark: SparkSession, data_dir: str) -> DataFrame:
    """The stream's last event is that of all events, also where only some properties are clustered."""
    return _window_sums(_stages(spark, data_dir, DetectorConfig(tail="file", properties=TWO_MODELS)).windows)


SPLIT = 4 * DetectorConfig().window_size


def q_anomalies_split(spark: SparkSession, data_dir: str) -> DataFrame:
    """The detector with every machine cut into chunks: the same anomalies."""
    return _anomaly_rows(_stages(spark, data_dir, DetectorConfig(fold_chunk_events=SPLIT)).anomalies)


def q_warm_kmeans_discrete(spark: SparkSession, data_dir: str) -> DataFrame:
    """The split fold on a sensor with three levels, whose runs may never meet their speculative run."""
    levels = _events(spark, data_dir).withColumn("value", F.pmod(F.floor("value"), F.lit(3)).cast("double"))
    cfg = DetectorConfig(fold_chunk_events=SPLIT)
    return _centroid_rows(warm_kmeans(event_stages(levels, cfg).windows.select(*FOLDED), cfg, partitioned=True))


VALUE_PROPERTIES = tuple(f"_{m}_0" for m in range(5))


def q_property_allow_list(spark: SparkSession, data_dir: str) -> DataFrame:
    """Only the ``value`` property of every model is clustered."""
    return _anomaly_rows(_stages(spark, data_dir, DetectorConfig(properties=VALUE_PROPERTIES)).anomalies)


def q_anomaly_triples(spark: SparkSession, data_dir: str) -> DataFrame:
    return anomalies_to_triples(_stages(spark, data_dir).anomalies, SYSTEM_URI)


QUERIES = {
    "sliding_windows": q_sliding_windows,
    "tail_flush": q_tail_flush,
    "tail_flush_short": q_tail_flush_short,
    "tail_file": q_tail_file,
    "tail_allow_list": q_tail_allow_list,
    "seed_values": q_seed_values,
    "cold_kmeans": q_cold_kmeans,
    "warm_kmeans": q_warm_kmeans,
    "warm_kmeans_split": q_warm_kmeans_split,
    "warm_kmeans_discrete": q_warm_kmeans_discrete,
    "anomalies_split": q_anomalies_split,
    "label_values": q_label_values,
    "transition_matrix": q_transition_matrix,
    "chain_anomalies": q_chain_anomalies,
    "anomalies": q_anomalies,
    "property_allow_list": q_property_allow_list,
    "anomaly_triples": q_anomaly_triples,
}


# ---------------------------------------------------------------------------------------------
# N-Triples path: events rendered as triples text, then parsed and assembled by the library.

_RENDERED: dict[tuple[str, str], DataFrame] = {}


def _event_blocks(spark: SparkSession, data_dir: str) -> DataFrame:
    """What the lines of the events are made of, written once per session and folder."""
    from anomark.session import stored
    from anomark.sources.events import groups_from_events, observations_from_events
    from anomark.sources.triples import event_blocks

    key = (spark.sparkContext.applicationId, data_dir)
    if key not in _RENDERED:
        ev = _events(spark, data_dir)
        _RENDERED[key] = stored(event_blocks(groups_from_events(ev), observations_from_events(ev)), "rendered")
    return _RENDERED[key]


def _event_triples(spark: SparkSession, data_dir: str) -> DataFrame:
    """The events as lines, which are rendered where they are read."""
    from anomark.sources.triples import block_lines

    return block_lines(_event_blocks(spark, data_dir))


def prepare(spark: SparkSession, data_dir: str) -> None:
    """Write the rows whose text stands in for triple files, so that a clock need not count it."""
    _event_blocks(spark, data_dir)


def count_windows(spark: SparkSession, data_dir: str) -> int:
    return _stages(spark, data_dir).windows.count()


def _metadata_triples(spark: SparkSession, data_dir: str):
    from anomark.sources.events import machines_from_events, model_properties_from_events
    from anomark.sources.triples import render_metadata_triples

    ev = _events(spark, data_dir)
    return render_metadata_triples(machines_from_events(ev), model_properties_from_events(ev))


def q_parse_triples(spark: SparkSession, data_dir: str) -> DataFrame:
    from anomark.sources.triples import parse_triples, valid_triples

    t = valid_triples(parse_triples(_event_triples(spark, data_dir)))
    return t.select(F.col("seq.line").alias("line"), "s_ns", "s", "p_ns", "p", "o_ns", "o", "is_literal")


def _metadata_rows(machines: DataFrame, model_properties: DataFrame) -> DataFrame:
    return machines.join(model_properties, "model_id").select(
        "machine_id", "model_id", "property_id", "num_clusters", "prob_threshold", "stateful"
    )


def _stored_triples(spark, lines, name):
    """Parse once into the shared checkpoint folder: every assembly join reads the same rows."""
    from anomark.session import scratch_path
    from anomark.sources.triples import parse_and_store

    return parse_and_store(spark, lines, scratch_path(spark, name))[0]


def _parsed_metadata(spark, data_dir):
    from anomark.operators.assembly import build_metadata

    return build_metadata(_stored_triples(spark, _metadata_triples(spark, data_dir), "metadata-triples"))


def q_build_metadata(spark: SparkSession, data_dir: str) -> DataFrame:
    return _metadata_rows(*_parsed_metadata(spark, data_dir))


def q_metadata_shared(spark: SparkSession, data_dir: str) -> DataFrame:
    """Metadata in which all models share a property, each with parameters of its own."""
    from anomark.operators.assembly import build_metadata
    from anomark.sources.events import machines_from_events, model_properties_from_events
    from anomark.sources.triples import render_metadata_triples

    ev = _events(spark, data_dir)
    own = model_properties_from_events(ev)
    number = F.regexp_extract("model_id", "[0-9]+", 0).cast("int")
    shared = own.select("model_id").distinct().select(
        "model_id", F.lit("_shared").alias("property_id"), (number + 2).alias("num_clusters"),
        ((number + 1) / 1000).alias("prob_threshold"), (number != 3).alias("stateful"),
    )
    lines = render_metadata_triples(machines_from_events(ev), own.unionByName(shared))
    return _metadata_rows(*build_metadata(_stored_triples(spark, lines, "shared-triples")))


def q_metadata_roundtrip(spark: SparkSession, data_dir: str) -> DataFrame:
    """Metadata parsed from triples, saved as a snapshot in the shared folder, loaded back."""
    return _metadata_rows(*_snapshot(spark, *_parsed_metadata(spark, data_dir)))


def _snapshot(spark, machines, model_properties):
    """Metadata as a run reads it: saved in the shared folder once, loaded by every step and micro-batch."""
    from anomark.session import scratch_path
    from anomark.sources.metadata_store import load_metadata, save_metadata

    path = scratch_path(spark, "metadata")
    save_metadata(machines, model_properties, path)
    return load_metadata(spark, path)


def _assembled(spark, data_dir, mode):
    from anomark.operators.assembly import assemble_observations

    return assemble_observations(_stored_triples(spark, _event_triples(spark, data_dir), "observation-triples"), mode)


def _observation_rows(obs: DataFrame) -> DataFrame:
    return obs.select("machine_id", "group_id", "timestamp_id", "timestamp_value", "property_id", "raw_value", "value")


def q_assemble_observations(spark: SparkSession, data_dir: str) -> DataFrame:
    return _observation_rows(_assembled(spark, data_dir, "by_edges")[1])


def q_assemble_by_position(spark: SparkSession, data_dir: str) -> DataFrame:
    return _observation_rows(_assembled(spark, data_dir, "by_position")[1])


def q_triples_anomalies(spark: SparkSession, data_dir: str) -> DataFrame:
    """The whole detector from text: metadata and observation triples -> anomalies."""
    from anomark.plans.detect import detection_stages

    machines, model_properties = _parsed_metadata(spark, data_dir)
    groups, obs = _assembled(spark, data_dir, "by_edges")
    st = detection_stages(groups.where(F.col("machine_id").isNotNull()), obs, machines, model_properties)
    a = st.anomalies
    return a.select(
        "anomaly_no", "machine_id", "property_id", "timestamp_id", "timestamp_value",
        F.round("probability", 9).alias("probability"), "window_no",
    )


def q_stateful_filter(spark: SparkSession, data_dir: str) -> DataFrame:
    from anomark.operators.metadata import filter_stateful
    from anomark.sources.events import machines_from_events, model_properties_from_events, observations_from_events

    ev = _events(spark, data_dir)
    kept = filter_stateful(observations_from_events(ev), machines_from_events(ev), model_properties_from_events(ev))
    return kept.select("machine_id", "group_id", "property_id", "value")


def q_property_params(spark: SparkSession, data_dir: str) -> DataFrame:
    from anomark.operators.metadata import with_property_params
    from anomark.sources.events import machines_from_events, model_properties_from_events, observations_from_events

    ev = _events(spark, data_dir)
    p = with_property_params(observations_from_events(ev), machines_from_events(ev), model_properties_from_events(ev))
    return p.select("machine_id", "group_id", "property_id", "model_id", "num_clusters", "prob_threshold", "stateful")


STATEFUL_PROPERTIES = tuple(f"_{m}_{j}" for m in range(5) for j in range(2))


def q_wide_export(spark: SparkSession, data_dir: str) -> DataFrame:
    from anomark.operators.metadata import filter_stateful
    from anomark.operators.output import wide_export
    from anomark.sources.events import machines_from_events, model_properties_from_events, observations_from_events

    ev = _events(spark, data_dir)
    kept = filter_stateful(observations_from_events(ev), machines_from_events(ev), model_properties_from_events(ev))
    return wide_export(kept, STATEFUL_PROPERTIES)


def _text_folder(spark: SparkSession, data_dir: str) -> str:
    """The observation lines as compressed text files in stream order, in the shared folder."""
    from anomark.session import scratch_path
    from anomark.sources.triples import block_lines

    path = scratch_path(spark, "triples-text")
    blocks = _event_blocks(spark, data_dir)
    block_lines(blocks, in_order=True).select("value").write.option("compression", "gzip").text(path)
    return path


def q_scan_triples(spark: SparkSession, data_dir: str) -> DataFrame:
    """N-Triples files scanned and parsed."""
    from anomark.sources.triples import parse_triples, read_triples, valid_triples

    t = valid_triples(parse_triples(read_triples(spark, _text_folder(spark, data_dir))))
    return t.select("s_ns", "s", "p_ns", "p", "o_ns", "o", "is_literal")


def q_anomaly_sink(spark: SparkSession, data_dir: str) -> DataFrame:
    """Anomaly triples written as text in output order and read again."""
    from anomark.operators.output import write_triples
    from anomark.session import scratch_path

    path = scratch_path(spark, "anomaly-text")
    write_triples(anomalies_to_triples(_stages(spark, data_dir).anomalies, SYSTEM_URI), path)
    return spark.read.text(path)


def q_wide_csv(spark: SparkSession, data_dir: str) -> DataFrame:
    """The wide export written as CSV and read again."""
    from anomark.operators.output import write_wide_csv
    from anomark.session import scratch_path

    path = scratch_path(spark, "wide-csv")
    wide = q_wide_export(spark, data_dir)
    write_wide_csv(wide, path)
    return spark.read.schema(wide.schema).option("header", True).csv(path)


def _faulty(ev: DataFrame):
    """Stand-in input: groups and observations of ``events`` with faults, and lines that are no triples."""
    from anomark.sources.events import groups_from_events, observations_from_events

    every = lambda n: F.col("seq") % n == 0
    groups = groups_from_events(ev).withColumn(
        "machine_id", F.when(every(7), F.lit(None)).when(every(19), F.lit("Machine_unknown")).otherwise(F.col("machine_id"))
    )
    first = F.col("obs_pos") == 0
    undefined = F.get(F.array(F.lit("NaN"), F.lit("Infinity"), F.lit("-Infinity")), (F.col("seq") % 3).cast("int"))
    obs = observations_from_events(ev).withColumn("raw_value", F.when(every(11) & first, F.lit("n/a")).when(every(23) & first, undefined).otherwise(F.col("raw_value")))
    obs = obs.withColumn("property_id", F.when(every(13) & first, F.lit("_unknown")).otherwise(F.col("property_id")))
    bad = groups.where(every(17)).select(F.col("seq"), F.concat(F.lit("<broken> line "), F.col("seq").cast("string")).alias("value"))
    return groups, obs, bad


def q_rejects(spark: SparkSession, data_dir: str) -> DataFrame:
    """Everything that a run over faulty lines and incomplete metadata leaves out, with its reason."""
    from anomark.operators.assembly import assemble_observations
    from anomark.operators.rejects import all_rejects
    from anomark.session import scratch_path
    from anomark.sources.events import machines_from_events, model_properties_from_events
    from anomark.sources.triples import parse_and_store, render_observation_triples

    ev = _events(spark, data_dir)
    groups, obs, bad = _faulty(ev)
    lines = render_observation_triples(groups, obs).where("value IS NOT NULL").select("seq", "value").unionByName(
        bad.select(F.struct(F.lit("broken").alias("file"), F.col("seq").alias("line")).alias("seq"), "value")
    )
    triples, unread = parse_and_store(spark, lines, scratch_path(spark, "faulty-triples"))
    found, values = assemble_observations(triples)
    properties = model_properties_from_events(ev).withColumn(
        "num_clusters", F.when(F.col("property_id") != "_4_1", F.col("num_clusters"))
    )
    return all_rejects(unread, found, values, machines_from_events(ev), properties)


QUERIES.update(
    {
        "scan_triples": q_scan_triples,
        "anomaly_sink": q_anomaly_sink,
        "wide_csv": q_wide_csv,
        "rejects": q_rejects,
        "parse_triples": q_parse_triples,
        "build_metadata": q_build_metadata,
        "metadata_roundtrip": q_metadata_roundtrip,
        "metadata_shared": q_metadata_shared,
        "assemble_observations": q_assemble_observations,
        "assemble_by_position": q_assemble_by_position,
        "triples_anomalies": q_triples_anomalies,
        "stateful_filter": q_stateful_filter,
        "property_params": q_property_params,
        "wide_export": q_wide_export,
    }
)


# ---------------------------------------------------------------------------------------------
# Streaming: event rows / triple files written in stream order, consumed with availableNow.

STREAM_CHUNKS = 4


def _chunk_of(col, lo, hi, n=STREAM_CHUNKS):
    """Contiguous chunk number of ``col`` in [lo, hi] (the chunks cover every row)."""
    span = (hi - lo) // n + 1
    return F.floor((col - F.lit(lo)) / F.lit(span)).cast("int")


def _event_rows(ev: DataFrame) -> DataFrame:
    from anomark.sources.events import groups_from_events, observations_from_events

    g = groups_from_events(ev).select(
        "machine_id", F.struct(F.lit("events").alias("file"), F.col("seq").alias("line")).alias("seq"),
        "group_id", "timestamp_id", "timestamp_value",
    )
    o = observations_from_events(ev).where(F.col("value").isNotNull()).groupBy("group_id").agg(
        F.array_sort(F.collect_list(F.struct("obs_pos", "property_id", "value"))).alias("obs")
    )
    return g.join(o, "group_id", "left")


def _stream_result(spark: SparkSession, out_dir: str) -> DataFrame:
    a = spark.read.parquet(out_dir)
    return a.select(
        F.col("anomaly_no").cast("bigint").alias("anomaly_no"), "machine_id", "property_id", "timestamp_id",
        "timestamp_value", F.round("probability", 9).alias("probability"),
        F.col("window_no").cast("bigint").alias("window_no"), F.col("trigger_seq.line").alias("trigger_seq"),
    )


def q_stream_equals_batch(spark: SparkSession, data_dir: str) -> DataFrame:
    """Stage B over the event rows, fed in four micro-batches in stream order."""
    from anomark.session import scratch_path
    from anomark.sources.events import machines_from_events, model_properties_from_events
    from anomark.streaming.stage_b import start_stage_b

    ev = _events(spark, data_dir)
    lo, hi = ev.agg(F.min("event_id"), F.max("event_id")).first()
    rows = _event_rows(ev).withColumn("chunk", _chunk_of(F.col("seq.line"), lo, hi))
    src, out, ckpt = (scratch_path(spark, n) for n in ("stream-events", "stream-anomalies", "stream-ckpt"))
    machines, model_properties = _snapshot(spark, machines_from_events(ev), model_properties_from_events(ev))
    for c in range(STREAM_CHUNKS):
        # a chunk arrives, then the query runs incrementally on the same checkpoint: one
        # micro-batch per chunk, state restored from the checkpoint at every restart
        rows.where(F.col("chunk") == c).drop("chunk").write.parquet(f"{src}/chunk={c:05d}")
        start_stage_b(spark, src, machines, model_properties, out, ckpt).awaitTermination()
    return _stream_result(spark, out)


def _stream_run(spark: SparkSession, data_dir: str, start, cfg: DetectorConfig = DetectorConfig(), arrivals: int = 2) -> str:
    """Folder of the anomalies of the events given as text: N-Triples files -> stage A -> ``start`` (a form of stage B).

    Files and arrivals are cut inside observation groups, stage A takes a third of an arrival a micro-batch, and the
    end-of-stream line comes last. After each arrival both queries are started again from their checkpoints."""
    from anomark.session import scratch_path
    from anomark.sources.triples import END_OF_STREAM
    from anomark.streaming.files import caught_up
    from anomark.streaming.stage_a import start_stage_a

    lines = _event_triples(spark, data_dir)
    lo, hi, size = lines.agg(F.min("seq.line"), F.max("seq.line"), F.sum(F.octet_length("value") + 1)).first()
    lines = lines.withColumn("chunk", _chunk_of(F.col("seq.line"), lo, hi, arrivals))
    txt, evdir, out = (scratch_path(spark, n) for n in ("stream-triples", "stream-events", "stream-anomalies"))
    ckpt_a, ckpt_b = scratch_path(spark, "ckpt-a"), scratch_path(spark, "ckpt-b")
    machines, model_properties = _snapshot(spark, *_parsed_metadata(spark, data_dir))
    end = spark.range(1).select(F.lit(END_OF_STREAM).alias("value"))
    for c in range(arrivals + 1):
        if c < arrivals:
            arrival = lines.where(F.col("chunk") == c).repartitionByRange(3, "seq.line").sortWithinPartitions("seq.line").select("value")
        else:
            arrival = end
        arrival.write.text(f"{txt}/chunk={c:05d}")
        caught_up(start_stage_a(spark, txt, machines, model_properties, evdir, ckpt_a, cfg, max_bytes=size // (3 * arrivals)))
        caught_up(start(spark, evdir, machines, model_properties, out, ckpt_b, cfg))
    return out


def _typed(*args):
    from anomark.streaming.stage_b import start_stage_b

    return start_stage_b(*args, ordered=True)


def q_stream_anomalies(spark: SparkSession, data_dir: str) -> DataFrame:
    """Text to anomalies as two streams, the second with typed state by machine."""
    return _stream_result(spark, _stream_run(spark, data_dir, _typed, arrivals=2)).drop("trigger_seq")


def q_stream_tables(spark: SparkSession, data_dir: str) -> DataFrame:
    """Text to anomalies as two streams, the second with its state in tables and every machine cut into chunks of 20 events."""
    from anomark.streaming.tables import start_table_detector

    cfg = DetectorConfig(fold_chunk_events=2 * DetectorConfig().window_size)
    return _stream_result(spark, _stream_run(spark, data_dir, start_table_detector, cfg, 2)).drop("trigger_seq")


def q_stream_triples(spark: SparkSession, data_dir: str) -> DataFrame:
    """Text to text: the stream's anomalies as N-Triples files, by the streaming sink."""
    from anomark.session import scratch_path
    from anomark.streaming.stage_b import start_triple_sink

    found = _stream_run(spark, data_dir, _typed, arrivals=1)
    out, ckpt = scratch_path(spark, "stream-text"), scratch_path(spark, "ckpt-text")
    start_triple_sink(spark, found, out, ckpt, SYSTEM_URI).awaitTermination()
    return spark.read.text(out)


def q_stream_tail(spark: SparkSession, data_dir: str) -> DataFrame:
    """Windows too long for all machines: only the last machine's short window is evaluated, when the end-of-stream line comes."""
    cfg = DetectorConfig(window_size=SHORT_WINDOW, tail="reference")
    return _stream_result(spark, _stream_run(spark, data_dir, _typed, cfg, 1)).drop("trigger_seq")


QUERIES.update(
    {
        "stream_equals_batch": q_stream_equals_batch,
        "stream_anomalies": q_stream_anomalies,
        "stream_tables": q_stream_tables,
        "stream_triples": q_stream_triples,
        "stream_tail": q_stream_tail,
    }
)
