"""Storing what is read more than once, and broadcasting behind a check of the size."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.batches import small_batches
from ..functions.stored import discard, stored

__all__ = ["discard", "forget", "if_small", "small", "small_batches", "stored", "stored_few"]

#: Of narrow rows, for one partition of a table that was stored.
PART_ROWS = 50_000


def stored_few(table: DataFrame) -> DataFrame:
    """table, stored, and read again in as few partitions as its rows need: each one would write files of its own in every
    shuffle that follows. For narrow rows, of which there may be few after a join over many partitions."""
    made = table.transform(stored)
    return made.coalesce(max(1, -(-made.count() // PART_ROWS)))


def forget(spark: SparkSession) -> None:
    """Lets go of the shuffles of steps whose results are stored: Spark deletes their files once the driver's JVM has collected what
    refers to them, which on a large heap may be long after."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Of a table that is broadcast: its most rows, and bytes of texts and arrays.
ROWS, BYTES = 100_000, 32 << 20


def small(table: DataFrame, rows: int = ROWS, most: int = BYTES) -> bool:
    """Whether a table has at most so many rows, and at most so many bytes in columns whose values vary in size."""
    wide = [f"coalesce(octet_length(`{f.name}`), 0)" if f.dataType.simpleString() in ("string", "binary") else f"coalesce(octet_length(to_json(struct(`{f.name}`))), 0)" for f in table.schema if f.dataType.simpleString() in ("string", "binary") or isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    got = table.limit(rows + 1).agg(F.count("*").alias("n"), F.sum(F.expr(" + ".join(wide) or "0")).alias("size")).first()
    return got["n"] <= rows and (got["size"] or 0) <= most


def if_small(table: DataFrame, rows: int = ROWS) -> DataFrame:
    """table, to be broadcast if it is small; else as it is, for a shuffled join. Read twice: table should be stored."""
    return F.broadcast(table) if small(table, rows) else table
