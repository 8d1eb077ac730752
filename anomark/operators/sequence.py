"""Exact, skew-proof row positions: position within a key, and global numbering.

A window ``row_number() over (partition by key order by seq)`` sends a whole key to one task,
and one machine may hold a third of all events. Here the rows are dealt by range on (key, order)
once, which cuts a hot key into several ranges, and written with the number of their range.
Rows are numbered inside (key, range); a table of (key, range) counts, which has one row per key
and one more per range, gives every range its exact offset. The written rows are read by all that
follows, so the ranges are fixed whatever task is run again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from anomark.session import stored

_RANGE = "__anomark_range"
_LOC = "__anomark_loc"
_CNT = "__anomark_cnt"
_OFF = "__anomark_off"


def position_within(
    df: DataFrame,
    key_cols: Sequence[str],
    order_cols: Sequence[str],
    out: str,
    start: int = 1,
    ranges: int | None = None,
) -> DataFrame:
    """Add ``out`` = position of the row inside its key, ordered by ``order_cols``.

    The order must be unique within a key, which makes the numbering deterministic. Writes the
    rows once; ``ranges`` defaults to the session's shuffle partitions.
    """
    keys = list(key_cols)
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = stored(df.repartitionByRange(n, *keys, *order_cols).withColumn(_RANGE, F.spark_partition_id()), "numbering")
    local = Window.partitionBy(*keys, _RANGE).orderBy(*order_cols)
    numbered = held.withColumn(_LOC, F.row_number().over(local))
    counts = held.groupBy(*keys, _RANGE).agg(F.count(F.lit(1)).alias(_CNT))
    before = (Window.partitionBy(*keys) if keys else Window).orderBy(_RANGE).rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = counts.select(*keys, _RANGE, F.coalesce(F.sum(_CNT).over(before), F.lit(0)).alias(_OFF))
    return (
        numbered.join(offsets, [*keys, _RANGE])
        .withColumn(out, (F.col(_LOC) + F.col(_OFF) + F.lit(start - 1)).cast("bigint"))
        .drop(_RANGE, _LOC, _OFF)
    )


def number_rows(df: DataFrame, order_cols: Sequence[str], out: str, start: int = 0, ranges: int | None = None) -> DataFrame:
    """Add ``out`` = global position in ``order_cols`` order, without a single-task window
    over the rows (only the per-range counts meet in one task)."""
    return position_within(df, [], order_cols, out, start=start, ranges=ranges)
