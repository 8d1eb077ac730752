"""Output float text equals Python's float repr (the text the original output carried)."""

import math
import random

from pyspark.sql import functions as F

from anomark.functions.text import python_float_text


def test_python_float_text_matches_repr(spark):
    rng = random.Random(7)
    values = [0.0, -0.0, 1.0, 0.1, 1e-05, 0.0001, 0.001, 2.5e-07, 1e16, 1e15, 123456789.0, 0.005,
              float("inf"), float("-inf"), float("nan"), 5e-324, 1.7976931348623157e308]
    for _ in range(3000):
        e = rng.randint(-12, 18)
        values.append(rng.choice([1, -1]) * rng.random() * 10.0 ** e)
        values.append(round(rng.random(), rng.randint(1, 6)))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double")
    got = {r.i: r.t for r in df.select("i", python_float_text(F.col("x")).alias("t")).collect()}
    bad = [(v, got[i]) for i, v in enumerate(values) if got[i] != repr(v)]
    assert not bad, bad[:10]
