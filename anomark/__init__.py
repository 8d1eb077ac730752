"""anomark: sliding-window Markov anomaly detection for sensor events on Spark.

Every public operator is a plain ``DataFrame -> DataFrame`` function, usable alone or
through ``df.transform``. The end-to-end batch plan lives in ``anomark.plans.detect``, the
Structured Streaming form in ``anomark.streaming``.
"""

from anomark.config import DetectorConfig

__all__ = ["DetectorConfig"]
