"""The store: rebuilt beside the old one, read by row group, and tables edited by bucket."""

import json
import os
import signal
import subprocess
import sys
import time
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from paperloom.functions.stored import stored
from paperloom.operators import bills
from paperloom.sources import store

from .conftest import ROOT

KILLED = """
import sys, time
from pyspark.sql import SparkSession, functions as F
from paperloom.sources import store
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", sys.argv[2]).getOrCreate()

@F.udf("string")
def slow(i):
    time.sleep(0.05)
    return "new"

chunks = spark.range(3).selectExpr("'new' AS source", "cast(id as int) AS chunk_index")
build_write = store._sized

def half(rows, *how):
    # The write itself takes long, so that it can be killed in its middle.
    many = spark.range(0, 2000, 1, 200).select(F.lit("new").alias("source"), F.col("id").cast("int").alias("chunk_index"), slow("id").alias("page_content"), F.lit(0).alias(rows.columns[-1]))
    return build_write(many, *how)

store._sized = half
print("building", flush=True)
store.build(chunks, sys.argv[1])
"""


def chunks(spark, names, n=3):
    return spark.createDataFrame([(s, 1, i, f"{s} {i}") for s in names for i in range(n)], "source string, page int, chunk_index int, page_content string")


def test_a_killed_build_leaves_the_old_store(spark, tmp_path):
    path = str(tmp_path / "s")
    store.build(chunks(spark, "ab"), path)
    before = sorted(map(tuple, store.read(spark, path).collect()))
    child = subprocess.Popen([sys.executable, "-c", KILLED, path, str(tmp_path / "c")], env=os.environ | {"PYTHONPATH": f"{ROOT}{os.pathsep}{os.environ['PYTHONPATH']}"}, stdout=subprocess.PIPE, text=True, start_new_session=True)
    end = time.time() + 120
    while time.time() < end and not (parts := list(Path(path).glob("_staged-*/**/*.parquet"))):
        time.sleep(0.1)
    os.killpg(child.pid, signal.SIGKILL)
    child.wait()
    assert parts and list(Path(path).glob("_staged-*")), "the build was killed in the middle of its write"
    assert sorted(map(tuple, store.read(spark, path).collect())) == before
    store.build(chunks(spark, "c"), path)
    assert {r.source for r in store.read(spark, path).collect()} == {"c"}
    assert [p.name for p in Path(path).iterdir()] == ["v00000002"]


def test_a_build_that_fails_leaves_the_old_store(spark, tmp_path):
    path = str(tmp_path / "s")
    store.build(chunks(spark, "ab"), path, errors=spark.createDataFrame([("x", "torn")], "source string, error string"))
    broken = chunks(spark, "c").withColumn("page_content", F.expr("raise_error('no')").cast("string"))
    with pytest.raises(Exception, match="no"):
        store.build(broken, path)
    assert store.read(spark, path).count() == 6 and store.errors(spark, path).count() == 1
    # A reader that began before goes on reading what it found, while it is there; a new one finds the new version.
    store.build(chunks(spark, "d"), path)
    assert store.read(spark, path, "d").count() == 3 and store.versions(spark, path) == [2]


def test_sizes_follow_from_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "BUCKET_BYTES", 20_000)
    rows = spark.range(2000).selectExpr("concat('s', id % 50) AS source", "cast(id as int) AS chunk_index", "repeat('x', 40) AS page_content")
    assert 2000 * 50 < store.measured(rows) < 2000 * 60
    store.build(rows, str(tmp_path / "s"), file_bytes=10_000)
    folders = list((tmp_path / "s" / "v00000001").glob("bucket_of_6=*"))
    files = [len(list(f.glob("*.parquet"))) for f in folders]
    assert len(folders) == 6 and max(files) == 2 and sum(files) > 8
    store.build(rows.limit(5), str(tmp_path / "s"))
    assert len(list((tmp_path / "s" / "v00000002").glob("bucket_of_1=*/*.parquet"))) == 1


def groups_that_may_hold(folder, source):
    """Row groups of a folder, and those whose least and greatest source have it between."""
    all_, may = 0, 0
    for f in Path(folder).rglob("*.parquet"):
        meta = pq.ParquetFile(f).metadata
        column = meta.schema.names.index("source")
        for g in range(meta.num_row_groups):
            s = meta.row_group(g).column(column).statistics
            all_, may = all_ + 1, may + (s.min <= source <= s.max)
    return all_, may


def scanned(rows):
    """Rows that the scan of a query gave on, after its row groups were chosen."""
    rows.collect()
    nodes, n = [rows._jdf.queryExecution().executedPlan()], 0
    while nodes:
        node = nodes.pop()
        if node.nodeName().startswith("Scan parquet"):
            n += node.metrics().apply("numOutputRows").value()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            nodes.append(node.executedPlan())
        nodes += [node.children().apply(k) for k in range(node.children().size())]
    return n


def test_one_source_reads_few_row_groups(spark, tmp_path):
    """A store of 40,000 chunks of 4000 sources in one bucket: by order and bloom filters one row group of many is read."""
    rows = spark.range(40_000).selectExpr("concat('source number ', xxhash64(id % 4000)) AS source", "1 AS page", "cast(id as int) AS chunk_index", "sha2(cast(id as string), 512) AS page_content")
    path = str(tmp_path / "s")
    store.build(rows, path, buckets=1, group_bytes=64 << 10)
    one = rows.first().source
    folder = store.newest(spark, path)
    all_, may = groups_that_may_hold(folder, one)
    assert all_ >= 20 and may <= 2
    read = store.read(spark, path, one)
    assert read.count() == 10 and 10 <= scanned(read) <= 40_000 * 3 / all_
    # A source that isn't there: between others by order, but in no group's bloom filter, so that no group is read.
    gone = store.read(spark, path, one + "x")
    assert gone.count() == 0 and groups_that_may_hold(folder, one + "x")[1] >= 1 and scanned(gone) == 0


def bill_rows(spark, n=200):
    texts = spark.range(n).selectExpr("concat('f', id) AS source", "concat('Invoice\nFrom: Acme\nCategory: Telecom\nDue date: 2025-04-03\nAmount due: $', id, '.50\n') AS text")
    return stored(bills.extract(texts))


def seen(path):
    return {str(f): f.stat().st_mtime_ns for f in Path(path).rglob("*.parquet")}


def test_edits_touch_their_buckets_alone(spark, tmp_path):
    path = str(tmp_path / "bills")
    made = bill_rows(spark)
    store.create(made, path, buckets=16)
    assert sorted(map(str, store.table(spark, path).select(*made.columns).collect())) == sorted(map(str, made.collect()))
    ids = [r.id for r in made.orderBy("id").limit(3).collect()]
    patches = spark.createDataFrame([(ids[0], json.dumps({"amount": 7, "vendor": " B "})), (ids[1], json.dumps({"category": "Nope", "amount": 1})), ("gone", "{}")], "id string, changes string")
    deleted = spark.createDataFrame([(ids[2],)], "id string")
    before = seen(path)
    n = bills.edit_stored(spark, path, patches, deleted)
    after = seen(path)
    buckets = lambda files: {f.split("bucket_of_16=")[1].split("/")[0] for f in files}
    assert 1 <= len(buckets({f for f, _ in set(before.items()) ^ set(after.items())})) == n <= 4
    wanted = sorted(map(str, bills.delete(bills.patch(made, patches), deleted).collect()))
    assert sorted(map(str, store.table(spark, path).select(*made.columns).collect())) == wanted and len(wanted) == 199
    bills.edit_stored(spark, path, patches, deleted)
    assert sorted(map(str, store.table(spark, path).select(*made.columns).collect())) == wanted
    assert bills.edit_stored(spark, path) == 0


def test_a_bucket_that_loses_all_rows(spark, tmp_path):
    path = str(tmp_path / "bills")
    made = bill_rows(spark, 6)
    store.create(made, path, buckets=64)
    one = made.first()
    bills.edit_stored(spark, path, deleted=spark.createDataFrame([(one.id,)], "id string"))
    assert {r.id for r in store.table(spark, path).collect()} == {r.id for r in made.collect()} - {one.id}
    assert bills.edit_stored(spark, path, deleted=spark.createDataFrame([(one.id,)], "id string")) == 0
