"""Exact ranks without a task that gets a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

PER_BUCKET, PER_PART = 1000, 1000


def ranked(rows: DataFrame, group: list[str], by: Column, ties: list[str], name: str = "rank", of: str | None = None) -> DataFrame:
    """rows with their rank from 0 within the group, in the order of ``by`` (0 to below 1, evenly spread), then of ``ties``.

    by is cut into buckets of about a thousand rows, and these into parts of a thousand buckets. A group's part counts, summed up, give
    each part its first rank, a part's bucket counts each bucket's, and ranks are only counted within a bucket: the one window over a
    whole group has a row for a million rows. of: a column for the group's rows, too. Read twice: rows should be stored."""
    n = rows.count()
    buckets = max(1, -(-n // PER_BUCKET))
    cut = rows.withColumn("__by", by).withColumn("__bucket", F.floor(F.col("__by") * buckets).cast("int"))
    keys = [*(F.col(g) for g in group), F.col("__bucket")]
    counts = cut.groupBy(*keys).agg(F.count("*").alias("__n"))
    counts = counts.withColumn("__part", F.floor(F.col("__bucket") / PER_PART).cast("int"))
    parts = counts.groupBy(*group, "__part").agg(F.sum("__n").alias("__rows"))
    all_, inside, sofar = Window.partitionBy(*group), Window.partitionBy(*group, "__part").orderBy("__bucket"), (Window.unboundedPreceding, -1)
    parts = parts.select(*(F.col(g).alias(f"__p{i}") for i, g in enumerate(group)), F.col("__part").alias("__p"), F.coalesce(F.sum("__rows").over(all_.orderBy("__part").rowsBetween(*sofar)), F.lit(0)).alias("__begin"), F.sum("__rows").over(all_).alias("__of"))
    both = F.col("__part") == F.col("__p")
    for i, g in enumerate(group):
        both = both & F.col(g).eqNullSafe(F.col(f"__p{i}"))
    before = counts.withColumn("__first", F.coalesce(F.sum("__n").over(inside.rowsBetween(*sofar)), F.lit(0))).join(parts, both)
    before = before.select(*(F.col(g).alias(f"__g{i}") for i, g in enumerate(group)), F.col("__bucket").alias("__b"), (F.col("__begin") + F.col("__first")).alias("__first"), "__of")
    same = F.col("__bucket") == F.col("__b")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    place = F.row_number().over(Window.partitionBy(*group, "__bucket").orderBy("__by", *ties))
    out = cut.join(before, same).withColumn(name, F.col("__first") + place - 1)
    if of:
        out = out.withColumn(of, F.col("__of"))
    return out.drop("__by", "__bucket", "__b", "__first", "__of", "__n", *(f"__g{i}" for i in range(len(group))))
