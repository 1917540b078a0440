"""Batches that go to Python workers."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Of a batch that goes to a Python worker. Texts are long, and a worker holds a batch several times over.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """From now on the session sends Python workers batches of a bounded size, if its own bound is larger."""
    now = spark.conf.get(_BATCH, None)
    if now is None or not now.rstrip("b").isdigit() or not 0 < int(now.rstrip("b")) <= BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
