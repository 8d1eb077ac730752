"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import math
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anomark.session import scratch_path, ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    # what only this write needed (its shuffle files) can go now: Spark drops it when the JVM collects its handles
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def in_few(df: DataFrame, rows: int, each: int = 2000) -> DataFrame:
    """``df`` in tasks of about ``each`` of its ``rows`` at least, two a core or more: tasks over a handful of rows cost more than their rows.

    Many rows stay in as many tasks as they come in."""
    return df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / each)))


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    ship_package(df.sparkSession)
    return df.mapInArrow(fn, schema)


def utf8(column: str) -> F.Column:
    """Text as UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")


def task_count(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def vocabulary() -> tuple[str, str]:
    """The byte-level BPE vocabulary as a tokenizer file and as a rank file."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def piece_model() -> str:
    """The SentencePiece model file."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")
