"""Seeds, cold and warm-started k-means per window, and nearest-centroid labels.

The warm start makes a window's centroids depend on the whole history of its
(machine, property) key, so the fold is sequential within a key and parallel over keys
(``anomark.operators.fold``). Everything else here is native Spark expressions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from anomark.config import DetectorConfig
from anomark.functions.kmeans import first_distinct, lloyd_windows
from anomark.operators.markov import bind

KEY = ["machine_id", "property_id"]


def seed_values(windows: DataFrame) -> DataFrame:
    """Cold-start seeds: the first ``num_clusters`` distinct values in order of appearance."""
    return bind(windows, "seeds", F.slice(F.array_distinct("values"), 1, F.col("num_clusters")))


def cold_kmeans(windows: DataFrame, cfg: DetectorConfig = DetectorConfig()) -> DataFrame:
    """Lloyd k-means on every window independently, seeded by ``seed_values`` (no carry-over).

    Windows are independent here, so this is a plain Arrow-batched map with no shuffle.
    """
    tol = cfg.kmeans_tol
    schema = T.StructType(windows.schema.fields + [T.StructField("centroids", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for batch in batches:
            vals = batch.column("values").to_pylist()
            ks = batch.column("num_clusters").to_pylist()
            by_length: dict[int, list[int]] = {}
            for i, v in enumerate(vals):
                by_length.setdefault(len(v), []).append(i)
            cents: list = [None] * len(vals)
            for rows in by_length.values():
                seeds = [first_distinct(vals[i], ks[i]) for i in rows]
                width = max(map(len, seeds))
                padded = np.array([x + [np.nan] * (width - len(x)) for x in seeds])
                found = lloyd_windows(np.array([vals[i] for i in rows]), padded, tol)
                for i, c in zip(rows, found):
                    cents[i] = c[~np.isnan(c)].tolist()
            yield batch.append_column("centroids", pa.array(cents, pa.list_(pa.float64())))

    return windows.mapInArrow(run, schema)


def warm_kmeans(
    windows: DataFrame,
    cfg: DetectorConfig = DetectorConfig(),
    partitioned: bool = False,
) -> DataFrame:
    """Append ``centroids`` and ``skipped`` to every window, carrying state window to window.

    ``partitioned=True`` tells that ``windows`` is already hash-partitioned on
    (machine_id, property_id), as ``sliding_windows`` returns it, so no second shuffle is
    planned; the sort by ``group_seq`` is then satisfied by the window operator's own order.
    With ``cfg.fold_chunk_events`` set, long keys come cut into chunks and the exact split
    fold of ``anomark.operators.fold`` runs instead (eagerly: it iterates).
    """
    if "chunk" in windows.columns and cfg.fold_chunk_events:
        from anomark.operators.fold import split_warm_kmeans

        return split_warm_kmeans(windows, cfg)
    from anomark.operators.fold import fold_windows

    rows = windows if "chunk" in windows.columns else windows.withColumn("chunk", F.lit(0).cast("bigint"))
    folded = fold_windows(rows if partitioned else rows.repartition(*KEY), cfg)
    return folded.select(*windows.columns, "centroids", "skipped")


def nearest_label(value: Column, centroids: Column) -> Column:
    """Index of the nearest centroid; on an exact tie the centroid with the larger value."""
    def nearer(best: Column, c: Column) -> Column:
        gap, least = F.abs(c - value), F.abs(best - value)
        return F.when((gap < least) | ((gap == least) & (c > best)), c).otherwise(best)

    found = F.aggregate(F.slice(centroids, 2, F.size(centroids)), F.get(centroids, F.lit(0)), nearer)
    return (F.array_position(centroids, found) - F.lit(1)).cast("int")


def label_values(df: DataFrame, centroids_col: str = "centroids") -> DataFrame:
    """Append ``labels`` array<int>: the label of every value of the window."""
    return bind(df, "labels", F.transform("values", lambda v: nearest_label(v, F.col(centroids_col))))
