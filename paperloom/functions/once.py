"""Columns that are worked out once a row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with costly columns that are worked out once a row, however often they are used afterwards: without the generator
    between, filters and selections would have them written out in full at every use."""
    made = F.array(F.struct(*(c.alias(k) for k, c in columns.items())))
    return rows.select("*", F.explode(made).alias("__once")).select("*", "__once.*").drop("__once")


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then of a value that is worked out once, inside an expression."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def spread(rows: DataFrame) -> DataFrame:
    """rows of a scan, over all cores, for work that costs much more than moving them. A scan that has as many parts already, as any
    large table's, stays as it is."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


#: Rows of costly work, such as an invoice's extraction, for one task.
PART_ROWS = 25_000


def dealt(rows: DataFrame, n: int) -> DataFrame:
    """Some n narrow rows for costly work, in parts of a bounded number of rows and over all cores: parts by bytes, as of a scan or a join, are as few as
    the cores and so take longer the more rows there are."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // PART_ROWS)))
