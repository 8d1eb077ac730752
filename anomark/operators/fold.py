"""Exact warm-start fold with hot keys split into chunks.

The centroids of a window depend on the state left by the previous window of the same
(machine, property), so a key is a sequential chain. When a key is long, its windows are cut
into chunks of ``fold_chunk_events`` events (``windows_from_rows`` does the cut) and folded as
follows:

1. speculative pass, all chunks in parallel: each chunk starts cold, as if its first window
   were the key's first; the state after every window is kept.
2. a table of transfers (chunk, incoming state) -> end state. A walk along each key's chunks
   takes known transfers and guesses the end of a chunk whose transfer is not known yet; every
   unknown (chunk, incoming state) it comes by is run, all chunks of a round in parallel. A run
   goes window by window from that state until its state equals the speculative one after the
   same window; from there on the speculative results hold (the fold is deterministic).
3. when a walk meets known transfers only, it is the sequential fold, and each chunk's results
   are those of its run from the state the walk gave it.

Keys and chunks are the lanes of a task: its rows are sorted by (place in lane, lane), and each place
is one vector step over all lanes (``anomark.functions.lanes``). ``lane_rows`` gives the detector one
row per event, not per window: the last W events' values are held in the task, so no frame of W
events is built, shuffled or sent to Python.

A chunk is run at most once per distinct incoming state. A sensor with few levels has few
states, so the rounds are bounded by their number and not by the number of chunks; on other
values runs meet their speculative run within a few windows. The result equals the sequential
fold bit for bit. Everything written goes to the shared checkpoint folder; a walk sees one
small row per chunk of a key.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from anomark.config import DetectorConfig
from anomark.functions.lanes import Lanes, ListRing, Ring, from_arrow
from anomark.session import stored

KEY = ["machine_id", "property_id", "chunk"]
log = logging.getLogger("anomark.fold")
STATE = T.StructType([T.StructField("c", T.ArrayType(T.DoubleType())), T.StructField("o", T.DoubleType())])
CHAIN = T.StructType([T.StructField("found", T.BooleanType()), T.StructField("idx", T.IntegerType()), T.StructField("prob", T.DoubleType())])

# what the detector keeps of a window; nothing W times the size of the input is written
NARROW = ["machine_id", "property_id", "chunk", "window_no", "group_seq", "trigger_seq",
          "centroids", "skipped", "chain", "abnormal_timestamp_id", "abnormal_timestamp_value"]
FROM_ROW = NARROW[:6]
WIDE = 8  # events with more values of a property are held as lists, not in the matrix of all lanes


def _lists(matrix: np.ndarray) -> pa.Array:
    """Rows filled up with NaN as a list column."""
    there = ~np.isnan(matrix)
    offsets = np.concatenate(([0], np.cumsum(there.sum(axis=1)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix[there]))


def _states(column: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
    return from_arrow(column.field("c")), column.field("o").to_numpy(zero_copy_only=False)


def _equal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of two matrices filled up with NaN are equal."""
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1])), constant_values=np.nan) for x in (a, b))
    return ((a == b) | (np.isnan(a) & np.isnan(b))).all(axis=1)


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, int, pa.RecordBatch]]:
    """(wide, step, rows) in order, each of one step."""
    for batch in batches:
        if not batch.num_rows:
            continue
        step = batch.column("step").to_numpy()
        wide = batch.column("wide").to_numpy(zero_copy_only=False)
        edges = np.flatnonzero((np.diff(step) != 0) | (wide[1:] != wide[:-1])) + 1
        for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(step)]):
            yield bool(wide[lo]), int(step[lo]), batch.slice(lo, hi - lo)


def _in_lanes(rows: DataFrame, placed: bool = False) -> DataFrame:
    """Rows of each partition in order of (place in lane, lane); ``placed``: they have ``step`` and ``goes_on``."""
    if not placed:
        lane = Window.partitionBy(*KEY).orderBy("group_seq")
        rows = rows.withColumns({"step": F.row_number().over(lane), "goes_on": F.lead(F.lit(True)).over(lane).isNotNull()})
    return rows.sortWithinPartitions("wide", "step", *KEY)


class _Runs:
    """The lanes of one task, step by step; in a second run lanes begin from ``need_in`` and stop where they meet ``spec``."""

    def __init__(self, cfg: DetectorConfig, again: bool, chain: bool):
        self.lanes = Lanes(cfg.kmeans_tol, cfg.num_transitions if chain else None)
        self.again, self.met = again, np.empty(0, bool)  # a first run may begin from ``need_in`` too

    def slots(self, step: int, rows: pa.RecordBatch) -> np.ndarray:
        slots = self.lanes.slots(step, rows.column("goes_on").to_numpy(zero_copy_only=False).astype(bool))
        if step == 1:
            self.met = np.concatenate((self.met, np.zeros(len(slots), bool)))
        if step == 1 and "need_in" in rows.schema.names:
            carried = rows.column("need_in")
            known = np.flatnonzero(carried.is_valid().to_numpy(zero_copy_only=False))
            if len(known):
                self.lanes.begin(slots[known], *_states(carried.take(pa.array(known))))
        return slots

    def windows(self, rows: pa.RecordBatch, slots: np.ndarray, values: np.ndarray, threshold: np.ndarray | None):
        """(row numbers evaluated, results, columns st and met of these)."""
        use = np.flatnonzero(~np.isnan(values[:, 0])) if values.shape[1] else np.empty(0, np.int64)
        if self.again:
            use = use[~self.met[slots[use]]]
        if not len(use):
            return use, None, []
        k = rows.column("num_clusters").to_numpy(zero_copy_only=False)[use].astype(np.int64)
        found = self.lanes.evaluate(slots[use], values[use], k, None if threshold is None else threshold[use])
        gone = self.lanes.gone[slots[use]]
        more = [pa.StructArray.from_arrays([_lists(found.centroids), pa.array(gone)], names=["c", "o"])]
        if self.again:
            spec = rows.column("spec").take(pa.array(use))
            met = spec.is_valid().to_numpy(zero_copy_only=False)
            centroids, first = _states(spec.filter(pa.array(met)))
            met[met] = _equal(found.centroids[met], centroids) & (gone[met] == first)
            self.met[slots[use]] = met
            more.append(pa.array(met))
        return use, found, more


def _more_fields(again: bool) -> list[T.StructField]:
    return [T.StructField("st", STATE), *([T.StructField("met", T.BooleanType())] if again else [])]


def fold_windows(windows: DataFrame, cfg: DetectorConfig, again: bool = False) -> DataFrame:
    """Windows with their ``values`` -> also centroids, skipped, st (state after the window).

    Every (machine, property, chunk) starts cold. ``again``: it starts from ``need_in``, stops where its state
    is ``spec``, the state of an earlier run, and only the windows up to there are returned, with ``met``."""
    names = [c for c in windows.columns if c != "spec"]
    out = T.StructType([
        *(windows.schema[c] for c in names),
        T.StructField("centroids", T.ArrayType(T.DoubleType())), T.StructField("skipped", T.BooleanType()), *_more_fields(again),
    ])

    def run(batches):
        runs, now = None, None
        for wide, step, rows in _steps(batches):
            if wide != now:
                runs, now = _Runs(cfg, again, False), wide
            use, found, more = runs.windows(rows, runs.slots(step, rows), from_arrow(rows.column("values")), None)
            if found is None:
                continue
            kept = rows.select(names).take(pa.array(use))
            yield pa.RecordBatch.from_arrays([*kept.columns, _lists(found.centroids), pa.array(found.skipped), *more], names=out.names)

    flagged = windows.withColumn("wide", F.lit(False))
    return _in_lanes(flagged.repartition(*KEY) if again else flagged).mapInArrow(run, out)


def lane_rows(
    events: DataFrame,
    cfg: DetectorConfig,
    tail: DataFrame | None = None,
    only: DataFrame | None = None,
    carried: DataFrame | None = None,
) -> DataFrame:
    """One row per event and property -> rows of the lanes, hash-partitioned on (machine, property, chunk).

    events: (machine_id, property_id, group_seq, seq, num_clusters, prob_threshold, vals array<double>, timestamp_id,
    timestamp_value), a row for every event of a machine and every property of it, with or without values. A window
    belongs to the chunk of its last event; an event is also sent to the chunks whose windows reach back to it, and
    a chunk's first one to the chunk before, whose last window it triggers. ``ends`` marks the last event of a window
    that is evaluated. ``tail`` and ``only`` as in ``windows_from_rows``.

    A stream's micro-batch also has ``since``: a machine's events up to this number were there before, and only windows
    that a later event triggers are evaluated. ``carried`` (machine_id, property_id, st) is the state that the fold goes on
    from, given to a key's first chunk as ``need_in``.
    """
    W, C = cfg.window_size, cfg.fold_chunk_events
    if cfg.tail != "none" and tail is None:
        raise ValueError("cfg.tail needs the stream's last event: pass stream_tail(all events)")
    g = F.col("group_seq")
    if C:
        chunk_of = lambda x: F.floor((x - F.lit(1)) / F.lit(C)).cast("bigint")
        chunks = F.array_distinct(F.array(chunk_of(g), chunk_of(g + F.lit(W - 1)), chunk_of(F.greatest(g - F.lit(1), F.lit(1)))))
        rows = events.withColumn("chunk", F.explode(chunks)).withColumn("own", F.col("chunk") == chunk_of(g))
    else:
        rows = events.withColumn("chunk", F.lit(0).cast("bigint")).withColumn("own", F.lit(True))
    if only is not None:
        rows = rows.join(only, KEY, "left_semi")
    rows = rows.repartition(*KEY)
    if carried is not None:
        first = chunk_of(F.greatest("since", F.lit(1))) if C else F.lit(0)
        rows = rows.join(carried.withColumnRenamed("st", "carried"), ["machine_id", "property_id"], "left")
        rows = rows.withColumn("need_in", F.when(F.col("chunk") == first, F.col("carried"))).repartition(*KEY)
    lane = Window.partitionBy(*KEY).orderBy("group_seq")
    rows = rows.withColumns({
        "step": F.row_number().over(lane),
        "goes_on": F.lead(F.lit(True)).over(lane).isNotNull(),
        "next_seq": F.lead("seq").over(lane),
        "wide": F.max(F.size("vals")).over(Window.partitionBy(*KEY)) > WIDE,
    })
    ends = g >= F.lit(W)
    if cfg.lag == 1:
        ends = ends & F.col("next_seq").isNotNull()
    if cfg.lag == 1 and cfg.tail != "none":
        rows = rows.crossJoin(F.broadcast(tail))
        if cfg.tail == "file":
            ends = ends & (F.col("next_seq") != F.col("tail_seq"))
        else:  # 'reference': the last machine's short window is flushed too
            ends = ends | (
                (F.col("machine_id") == F.col("tail_machine")) & (g == F.col("tail_group_seq") - 1) & (g >= 1) & (g < F.lit(W))
            )
    if "since" in events.columns:
        ends = ends & (g >= F.col("since"))
    return rows.select(
        *KEY, F.greatest(F.lit(1), g - F.lit(W - 1)).cast("bigint").alias("window_no"), "group_seq",
        F.col("next_seq" if cfg.lag == 1 else "seq").alias("trigger_seq"), "num_clusters", "prob_threshold", "vals",
        "timestamp_id", "timestamp_value", F.coalesce(F.col("own") & ends, F.lit(False)).alias("ends"), "step", "goes_on", "wide",
        *(["need_in"] if carried is not None else []),
    )


def fold_events(rows: DataFrame, cfg: DetectorConfig, again: bool = False) -> DataFrame:
    """``lane_rows`` -> NARROW columns and st of every window with a value: fold, labels and chain test in one pass.

    ``again`` as in ``fold_windows``; ``need_in`` is returned as well."""
    carried = [rows.schema["need_in"]] if again else []
    out = T.StructType([
        *(rows.schema[c] for c in FROM_ROW), T.StructField("centroids", T.ArrayType(T.DoubleType())),
        T.StructField("skipped", T.BooleanType()), T.StructField("chain", CHAIN),
        T.StructField("abnormal_timestamp_id", T.StringType()), T.StructField("abnormal_timestamp_value", T.StringType()),
        *carried, *_more_fields(again),
    ])

    def run(batches):
        runs, ring, now = None, None, None
        for wide, step, rows in _steps(batches):
            if wide != now:
                runs, ring, now = _Runs(cfg, again, True), (ListRing if wide else Ring)(cfg.window_size), wide
            slots = runs.slots(step, rows)
            ring.push(step, slots, from_arrow(rows.column("vals")), rows.column("timestamp_id"), rows.column("timestamp_value"))
            ends = np.flatnonzero(rows.column("ends").to_numpy(zero_copy_only=False))
            if not len(ends):
                continue
            part, at = rows.take(pa.array(ends)), slots[ends]
            values, steps = ring.windows(step, at)
            threshold = part.column("prob_threshold").to_numpy(zero_copy_only=False)
            use, found, more = runs.windows(part, at, values, threshold)
            if found is None:
                continue
            kept = part.select([*FROM_ROW, *(f.name for f in carried)]).take(pa.array(use))
            stamps = [
                ring.labels(int(steps[use[i], found.index[i]]), int(at[use[i]])) if hit else (None, None)
                for i, hit in enumerate(found.found.tolist())
            ]
            chain = pa.StructArray.from_arrays(
                [pa.array(found.found), pa.array(found.index, pa.int32(), mask=~found.found), pa.array(found.prob)], names=["found", "idx", "prob"]
            )
            yield pa.RecordBatch.from_arrays(
                [*kept.columns[:6], _lists(found.centroids), pa.array(found.skipped), chain,
                 pa.array([t for t, _ in stamps], pa.string()), pa.array([v for _, v in stamps], pa.string()), *kept.columns[6:], *more],
                names=out.names,
            )

    return _in_lanes(rows.repartition(*KEY) if again else rows, placed=True).mapInArrow(run, out)


def _walk(ends: DataFrame, transfers: DataFrame) -> DataFrame:
    """(key, need_in, known) of every chunk after a key's first, by the walk of step 2."""
    known = transfers.groupBy(*KEY).agg(
        F.array_sort(F.collect_list(F.struct("round", "need_in", "end"))).alias("known")
    )
    # a task has whole keys, chunk after chunk: many short walks cost no call each
    rows = ends.join(known, KEY, "left").repartition(*KEY[:2]).sortWithinPartitions(*KEY)
    schema = T.StructType([ends.schema[c] for c in KEY] + [T.StructField("need_in", STATE), T.StructField("known", T.BooleanType())])
    state_type = pa.struct([("c", pa.list_(pa.float64())), ("o", pa.float64())])

    def plain(state):
        return None if state is None else (tuple(state["c"]), state["o"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            at, needs, sure = [], [], []
            for place, row in enumerate(batch.to_pylist()):
                if key != (row["machine_id"], row["property_id"]):
                    key, state = (row["machine_id"], row["property_id"]), row["spec_end"]
                    continue
                runs = row["known"] or []
                end = next((r["end"] for r in runs if plain(r["need_in"]) == plain(state)), None)
                at.append(place)
                needs.append(state)
                sure.append(end is not None)
                if end is None:
                    end = runs[-1]["end"] if runs else row["spec_end"]
                state = end
            if at:
                kept = batch.select(KEY).take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(needs, state_type), pa.array(sure)], names=schema.names)

    return rows.mapInArrow(walk, schema)


def split_fold(
    rows: DataFrame, cfg: DetectorConfig, columns: list[str], fixed: list[str], fold, rows_of, keep_state: bool = False
) -> DataFrame:
    """``columns`` of every window after the exact fold. Runs Spark jobs eagerly.

    fold(rows, cfg, again) runs lanes; rows_of(chunks, spec) gives the rows of the given chunks again, with their places
    in the lane where ``fold`` needs them; ``fixed`` are the columns that a second run changes. ``keep_state``: with ``st``."""
    given = [*columns, "st"] if keep_state else columns
    fixed = [*fixed, "st"] if keep_state else fixed
    spec = stored(fold(rows, cfg).select(*columns, "st"), "fold-spec")
    if spec.where(F.col("chunk") > 0).isEmpty():
        return spec.select(given)  # no key spans two chunks: the speculative pass is the fold
    ends = stored(spec.groupBy(*KEY).agg(F.max_by("st", "group_seq").alias("spec_end")), "fold-ends")
    transfers = ends.where("false").select(*KEY, F.col("spec_end").alias("need_in"), F.col("spec_end").alias("end"), F.lit(0).alias("round"))
    fixes: DataFrame | None = None
    rounds = 0
    while True:
        plan = stored(_walk(ends, transfers), "fold-plan")
        todo = plan.where(~F.col("known")).select(*KEY, "need_in")
        if todo.isEmpty():
            break
        rounds += 1
        states = spec.select(*KEY, "group_seq", F.col("st").alias("spec"))
        again = rows_of(todo.select(*KEY), spec).join(todo, KEY).join(states, [*KEY, "group_seq"], "left")
        run = stored(fold(again, cfg, True).select(*columns, "need_in", "st", "met"), "fold-fix")
        last = run.groupBy(*KEY).agg(F.max_by(F.struct("met", "st"), "group_seq").alias("l"), F.first("need_in").alias("need_in"))
        found = last.join(ends, KEY).select(
            *KEY, "need_in", F.when(F.col("l.met"), F.col("spec_end")).otherwise(F.col("l.st")).alias("end"), F.lit(rounds).alias("round")
        )
        transfers = stored(transfers.unionByName(found), "fold-transfers")
        fixes = run if fixes is None else fixes.unionByName(run)
        log.info("fold round %d: %d windows run again", rounds, run.count())
    if fixes is None:
        return spec.select(given)
    sure = plan.select(*KEY, F.col("need_in").alias("true_in"))
    latest = fixes.join(sure, KEY).where(F.col("need_in").eqNullSafe(F.col("true_in"))).select(
        *KEY, "window_no", F.struct(*fixed).alias("fixed")
    )
    merged = spec.join(latest, [*KEY, "window_no"], "left")
    return merged.select(
        *(F.when(F.col("fixed").isNotNull(), F.col("fixed")[c]).otherwise(F.col(c)).alias(c) if c in fixed else F.col(c) for c in given)
    )


def split_warm_kmeans(windows: DataFrame, cfg: DetectorConfig) -> DataFrame:
    """Exact warm-start fold of chunked windows: all their columns, centroids and skipped."""
    columns = [*windows.columns, "centroids", "skipped"]
    again = lambda chunks, spec: spec.select(*windows.columns).join(chunks, KEY, "left_semi")
    return split_fold(windows, cfg, columns, columns[-2:], fold_windows, again)


def split_detect(
    events: DataFrame,
    cfg: DetectorConfig,
    tail: DataFrame | None = None,
    carried: DataFrame | None = None,
    keep_state: bool = False,
) -> DataFrame:
    """Exact per-window detection results (NARROW columns) of events (``lane_rows``), hot keys split in chunks."""
    if not cfg.fold_chunk_events:
        whole = fold_events(lane_rows(events, cfg, tail, carried=carried), cfg)
        return whole if keep_state else whole.drop("st")
    held: list[DataFrame] = []

    def rows_of(chunks: DataFrame, _spec: DataFrame) -> DataFrame:
        if not held:
            held.append(stored(events, "fold-events"))
        return lane_rows(held[0], cfg, tail, only=chunks)

    return split_fold(lane_rows(events, cfg, tail, carried=carried), cfg, NARROW, NARROW[6:], fold_events, rows_of, keep_state)
