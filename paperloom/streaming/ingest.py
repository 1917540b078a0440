"""Text rows that arrive as files, through the same operators as batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.candidates import amount_candidates, looks_like_bill
from ..operators.structure import with_blocks


def documents(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def analysed(texts: DataFrame) -> DataFrame:
    """texts with blocks, amounts and bill_like. Row by row, so that no state is kept."""
    return with_blocks(texts).withColumn("amounts", amount_candidates(F.col("text"))).withColumn("bill_like", looks_like_bill(F.col("text")))


def write(texts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """All that is there now, once each, to Parquet; a run after a failure goes on from the checkpoint."""
    return texts.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
