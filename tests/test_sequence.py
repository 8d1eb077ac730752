"""Skew-proof numbering equals a single-task row_number, also with one hot key."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from anomark.operators.sequence import number_rows, position_within


def test_position_within_hot_key(spark):
    n = 20000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 50).cast("string")).alias("k"),
        (F.col("id") * 7919 % 1000003).alias("seq"),
    )
    got = position_within(df, ["k"], ["seq"], "pos", ranges=13)
    want = df.withColumn("pos2", F.row_number().over(Window.partitionBy("k").orderBy("seq")))
    j = got.join(want, ["k", "seq"])
    assert j.count() == n
    assert j.where(F.col("pos") != F.col("pos2")).count() == 0


def test_number_rows_global(spark):
    df = spark.range(5000).select((F.col("id") * 31 % 5003).alias("seq"))
    got = number_rows(df, ["seq"], "no", ranges=9)
    rows = got.orderBy("seq").collect()
    assert [r.no for r in rows] == list(range(5000))
