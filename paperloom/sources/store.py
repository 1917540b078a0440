"""The chunk store and tables that are edited in place: Parquet folders, parted by bucket.

A store is a folder of versions, each whole: ``v00000007/bucket_of_64=5/...``. A build writes its version beside the others under a name that no reader
looks at, and one rename by the file system makes it the newest; only then are older ones deleted. A build that dies leaves the store as it
was, and its folder to the next build, which removes it. Readers take the newest version when they begin.

Buckets and write tasks follow from the measured bytes. Within a file rows are sorted by source, in row groups of bounded
size, and Parquet's bloom filters tell the groups that don't hold a source, so that reading one source of many reads few groups.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.stored import discard, stored

#: Of a bucket (a folder), of a file, and of a row group.
BUCKET_BYTES, FILE_BYTES, GROUP_BYTES = 1 << 30, 128 << 20, 8 << 20
MOST_BUCKETS = 4096
#: The bucket column's name says how many there are, so that a store of any size is read as it was written.
_BUCKET, _ERRORS, _VERSION = "bucket_of_", "_errors", re.compile(r"v(\d{8})")


def _bucket(source: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(source, F.lit(""))), F.lit(buckets)).cast("int")


def _files(spark: SparkSession, path: str):
    """The path's file system, and what makes a path of a name."""
    context = spark.sparkContext
    make = context._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(context._jsc.hadoopConfiguration()), make


def versions(spark: SparkSession, path: str) -> list[int]:
    """The store's whole versions, in order."""
    files, make = _files(spark, path)
    folder = make(path)
    names = [f.getPath().getName() for f in files.listStatus(folder)] if files.exists(folder) else []
    return sorted(int(m[1]) for n in names if (m := _VERSION.fullmatch(n)))


def newest(spark: SparkSession, path: str) -> str:
    """The folder of the newest version."""
    if not (all_ := versions(spark, path)):
        raise FileNotFoundError(f"no store in {path}")
    return f"{path}/v{all_[-1]:08d}"


def measured(rows: DataFrame) -> int:
    """The bytes of a table's values, about: those that vary in size by their own, 8 for others."""
    size = {"string": "octet_length(`{0}`)", "binary": "octet_length(`{0}`)", "array<float>": "4 * size(`{0}`)", "array<double>": "8 * size(`{0}`)"}
    each = [f"coalesce({size.get(f.dataType.simpleString(), '8').format(f.name.replace('`', '``'))}, 0)" for f in rows.schema]
    return rows.agg(F.sum(F.expr(" + ".join(each)))).first()[0] or 0


def _sized(path_rows: DataFrame, key: str, group_bytes: int):
    """A writer with row groups of bounded size and bloom filters on the key."""
    return path_rows.write.option("parquet.block.size", group_bytes).option(f"parquet.bloom.filter.enabled#{key}", "true").option(f"parquet.bloom.filter.expected.ndv#{key}", 100_000).option("parquet.bloom.filter.adaptive.enabled", "true")


def build(chunks: DataFrame, path: str, buckets: int | None = None, errors: DataFrame | None = None, *, file_bytes: int = FILE_BYTES, group_bytes: int = GROUP_BYTES) -> None:
    """Writes a new version of the store. A source's chunks are in one bucket, so that reading one source reads one folder; a bucket's chunks
    are dealt to as many tasks as its bytes need, by page and index, so that a large source isn't one task. errors: (source, error) of what couldn't be read.

    The chunks are stored first, so that what measures them doesn't embed them again."""
    spark = chunks.sparkSession
    made = stored(chunks)
    size = measured(made)
    buckets = buckets or max(1, min(MOST_BUCKETS, -(-size // BUCKET_BYTES)))
    name = f"{_BUCKET}{buckets}"
    salts = max(1, -(-size // (buckets * file_bytes)))
    place = [c for c in ("page", "chunk_index") if c in made.columns]
    dealt = made.withColumn(name, _bucket(F.col("source"), buckets)).withColumn("__salt", F.pmod(F.xxhash64(*place), F.lit(salts)) if place else F.lit(0))
    dealt = dealt.repartition(buckets * salts, name, "__salt").sortWithinPartitions(name, "source", *place).drop("__salt")
    files, make = _files(spark, path)
    _remove_unfinished(files, make, path)
    staged = f"{path}/_staged-{uuid.uuid4().hex}"
    _sized(dealt, "source", group_bytes).partitionBy(name).parquet(staged)
    if errors is not None:
        errors.select("source", "error").write.parquet(f"{staged}/{_ERRORS}")
    _swap(spark, path, staged)
    discard(made)


def _remove_unfinished(files, make, path: str) -> None:
    for f in files.listStatus(make(path)) if files.exists(make(path)) else ():
        if f.getPath().getName().startswith("_staged-"):
            files.delete(f.getPath(), True)


def _swap(spark: SparkSession, path: str, staged: str) -> None:
    """Makes what is staged the newest version by one rename, then deletes the others."""
    files, make = _files(spark, path)
    old = versions(spark, path)
    new = make(f"{path}/v{old[-1] + 1 if old else 1:08d}")
    if files.exists(new) or not files.rename(make(staged), new):
        raise RuntimeError(f"could not rename {staged}: another build may have finished meanwhile")
    for v in old:
        files.delete(make(f"{path}/v{v:08d}"), True)


def read(spark: SparkSession, path: str, source: str | None = None) -> DataFrame:
    """The store's chunks, or those of one source; others' folders aren't read, and of its folder only row groups that may hold it."""
    chunks = spark.read.parquet(newest(spark, path))
    name = next(c for c in chunks.columns if c.startswith(_BUCKET))
    if source is not None:
        chunks = chunks.where(F.col(name) == _bucket(F.lit(source), int(name.removeprefix(_BUCKET)))).where(F.col("source") == source)
    return chunks.drop(name)


def errors(spark: SparkSession, path: str) -> DataFrame:
    """(source, error) of the files that couldn't be read when the store was built."""
    return spark.read.schema("source string, error string").parquet(f"{newest(spark, path)}/{_ERRORS}")


def wipe(spark: SparkSession, path: str) -> bool:
    """Removes the store, wherever it is; whether there was one."""
    files, make = _files(spark, path)
    return bool(files.delete(make(path), True))


def create(rows: DataFrame, path: str, key: str = "id", buckets: int | None = None) -> None:
    """Writes a table that is edited in place: Parquet, parted by the bucket of its key. It mustn't be there yet."""
    buckets = buckets or max(1, min(MOST_BUCKETS, -(-measured(rows) // FILE_BYTES)))
    name = f"{_BUCKET}{buckets}"
    _sized(rows.withColumn(name, _bucket(F.col(key), buckets)).repartition(name).sortWithinPartitions(name, key), key, GROUP_BYTES).partitionBy(name).parquet(path)


def table(spark: SparkSession, path: str) -> DataFrame:
    """A table that was written by ``create``."""
    rows = spark.read.parquet(path)
    return rows.drop(next(c for c in rows.columns if c.startswith(_BUCKET)))


def edit(spark: SparkSession, path: str, keys: DataFrame, change, key: str = "id") -> int:
    """Rewrites the buckets of a table that hold one of the keys by ``change`` (rows in, rows out), and no others; how many these are.

    Spark overwrites the touched partitions alone (dynamic partition overwrite). A bucket that has lost all its rows has nothing to be overwritten with,
    so that its folder is deleted. An edit that dies half way is done again as a whole: changes have to be such that twice is as good as once."""
    rows = spark.read.parquet(path)
    name = next(c for c in rows.columns if c.startswith(_BUCKET))
    buckets = int(name.removeprefix(_BUCKET))
    touched = sorted(r[0] for r in keys.select(_bucket(F.col(key), buckets)).distinct().collect())
    there = [b for b in touched if _exists(spark, f"{path}/{name}={b}")]
    if not there:
        return 0
    held = stored(change(rows.where(F.col(name).isin(there)).drop(name)).withColumn(name, _bucket(F.col(key), buckets)))
    left = {r[0] for r in held.select(name).distinct().collect()}
    _sized(held.repartition(name).sortWithinPartitions(name, key), key, GROUP_BYTES).mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(name).parquet(path)
    files, make = _files(spark, path)
    for b in there:
        if b not in left:
            files.delete(make(f"{path}/{name}={b}"), True)
    discard(held)
    return len(there)


def _exists(spark: SparkSession, path: str) -> bool:
    files, make = _files(spark, path)
    return bool(files.exists(make(path)))
