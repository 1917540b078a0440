"""Model calls that are done once: answers kept by prompt, a task that dies asks nothing again, and progress can be watched.

An answers folder has three parts. ``table`` holds the answers of finished runs, a row for each prompt. A run's ``journal`` holds what its tasks
have been told so far: after every few answers a task puts a small file there, under the number of its part, so that its next attempt
begins by reading what the last one left. ``status`` says what the run has to do. When the run is over its answers become rows of the table and its journal goes; what
a run that died has left is taken into the table by the next one.

A prompt's key is a hash of the model and its settings, the prompt and the schema. Prompts that are alike are asked once. A prompt that fails, after
some tries, has an error; errors aren't kept, so that the next run asks again. Tasks ask several prompts at a time.

The journal is written by the workers themselves: the folder has to be of a file system that Arrow opens by its address, and that all machines share.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.stored import discard, stored
from .providers import Generator

#: Prompts of one task, of a journal's file, and asked at a time; tries of one prompt, and seconds before the second, doubled each time.
PER_TASK, PER_FILE, AT_ONCE, TRIES, WAIT = 256, 16, 8, 3, 0.5
_ROW = "key string, answer string, error string"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _names(files: fs.FileSystem, path: str, kind=fs.FileType.File, deep: bool = False) -> list[str]:
    return sorted(f.path for f in files.get_file_info(fs.FileSelector(path, recursive=deep, allow_not_found=True)) if f.type == kind and not f.base_name.startswith("_"))


def _lines(files: fs.FileSystem, name: str) -> list[dict]:
    with files.open_input_stream(name) as f:
        return [json.loads(x) for x in f.read().decode().splitlines()]


def _put(files: fs.FileSystem, name: str, text: str) -> None:
    """A file that is there as a whole or not at all: readers leave out names that begin with '_'."""
    folder, _, last = name.rpartition("/")
    files.create_dir(folder)
    with files.open_output_stream(f"{folder}/_{last}") as f:
        f.write(text.encode())
    files.move(f"{folder}/_{last}", name)


def _ask(model: Generator, prompt: str, schema: str | None, tries: int, wait: float) -> tuple[str | None, str | None]:
    for k in range(tries):
        try:
            return model.generate(prompt, json.loads(schema) if schema else None), None
        except Exception as e:  # noqa: BLE001  one prompt's failure is its row's
            error = f"{type(e).__name__}: {e}"
        if k + 1 < tries:
            time.sleep(wait * 2**k)
    return None, error


def _journal(spark: SparkSession, path: str) -> DataFrame:
    """(key, answer, error, run) of what stands in a folder's journals."""
    files, root = _open(path)
    if not _names(files, f"{root}/journal", deep=True):
        return spark.createDataFrame([], f"{_ROW}, run string")
    rows = spark.read.schema(_ROW).option("recursiveFileLookup", "true").json(f"{path}/journal")
    return rows.withColumn("run", F.regexp_extract(F.input_file_name(), "/journal/([^/]+)/", 1))


def _table(spark: SparkSession, path: str) -> DataFrame:
    files, root = _open(path)
    names = _names(files, f"{root}/table")
    return spark.read.schema("key string, answer string").parquet(f"{path}/table") if names else spark.createDataFrame([], "key string, answer string")


def settle(spark: SparkSession, path: str) -> None:
    """Takes all that stands in journals into the table, and removes them."""
    files, root = _open(path)
    runs = _names(files, f"{root}/journal", fs.FileType.Directory)
    if not runs:
        return
    rows = _journal(spark, path).where("error is null").groupBy("key").agg(F.first("answer").alias("answer"))
    rows.join(_table(spark, path).select("key"), "key", "left_anti").write.mode("append").parquet(f"{path}/table")
    for run in runs:
        files.delete_dir(run)


def answered(rows: DataFrame, model: Generator, path: str, *, prompt: str = "prompt", schema: str | None = None, per_task: int = PER_TASK, per_file: int = PER_FILE, at_once: int = AT_ONCE, tries: int = TRIES, wait: float = WAIT) -> DataFrame:
    """rows with answer and error. Only prompts that the folder has no answer to are asked, each once, ``at_once`` at a time in a task."""
    spark = rows.sparkSession
    settle(spark, path)
    name = f"{type(model).__module__}.{type(model).__qualname__} {getattr(model, '__dict__', {})!r}"
    schemas = F.col(schema) if schema else F.lit(None).cast("string")
    key = F.sha2(F.to_json(F.array(F.lit(name), F.col(prompt), F.coalesce(schemas, F.lit("")))), 256)
    keyed = stored(rows.withColumn("__key", F.when(F.col(prompt).isNotNull(), key)).withColumn("__schema", schemas))
    wanted = keyed.where("__key is not null").groupBy("__key").agg(F.first(prompt).alias("prompt"), F.first("__schema").alias("schema"))
    known = _table(spark, path).join(wanted.select(F.col("__key").alias("key")), "key", "left_semi").select("key", "answer", F.lit(None).cast("string").alias("error")).transform(stored)
    new = wanted.join(known.select("key"), F.col("__key") == F.col("key"), "left_anti")
    total = new.count()
    run_id = uuid.uuid4().hex
    files, root = _open(path)
    _put(files, f"{root}/status.json", json.dumps({"run": run_id, "total": total, "known": known.count(), "state": "running"}))
    # Stored, so that a part has the same prompts at every attempt.
    dealt = stored(new.select("__key", "prompt", "schema").repartition(max(1, -(-total // per_task)), "__key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _open(path)
        folder = f"{root}/journal/{run_id}/{TaskContext.get().partitionId():06d}"
        done = {x["key"]: x for name in _names(files, folder) for x in _lines(files, name)}
        with ThreadPoolExecutor(at_once) as pool:
            for b in batches:
                open_ = [x for x in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True) if x[0] not in done]
                for low in range(0, len(open_), per_file):
                    some = open_[low : low + per_file]
                    told = pool.map(lambda x: _ask(model, x[1], x[2], tries, wait), some)
                    got = [{"key": k, "answer": a, "error": e} for (k, _, _), (a, e) in zip(some, told, strict=True)]
                    _put(files, f"{folder}/{uuid.uuid4().hex}.json", "".join(json.dumps(x) + "\n" for x in got))
                    done |= {x["key"]: x for x in got}
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in done.values()], pa.string()) for c in ("key", "answer", "error")], names=["key", "answer", "error"])

    try:
        made = stored(dealt.mapInArrow(run, _ROW))
    except Exception:
        _put(files, f"{root}/status.json", json.dumps({"run": run_id, "total": total, "known": known.count(), "state": "failed"}))
        raise
    failed = made.where("error is not null").count()
    # Before the journal goes, so that who watches never sees less than before.
    _put(files, f"{root}/status.json", json.dumps({"run": run_id, "total": total, "known": known.count(), "state": "done", "done": total, "failed": failed}))
    settle(spark, path)
    answers = made.unionByName(known).withColumnRenamed("key", "__answered")
    discard(dealt)
    return keyed.join(answers, F.col("__key") == F.col("__answered"), "left").select(*rows.columns, "answer", "error")


def progress(path: str) -> dict | None:
    """total, done, failed, known (answers that were there before) and state (running, done, failed) of the last run in a folder; None without one.

    While a run goes on its journal is counted; a prompt that failed is done too. Needs no session: any process may watch."""
    files, root = _open(path)
    if files.get_file_info(f"{root}/status.json").type == fs.FileType.NotFound:
        return None
    (status,) = _lines(files, f"{root}/status.json")
    if "done" not in status:
        rows: dict[str, bool] = {}
        try:
            for name in _names(files, f"{root}/journal/{status['run']}", deep=True):
                rows |= {x["key"]: x["error"] is not None for x in _lines(files, name)}
        except FileNotFoundError:  # the run has just ended
            return progress(path)
        if json.dumps(_lines(files, f"{root}/status.json")[0]) != json.dumps(status):
            return progress(path)
        status |= {"done": len(rows), "failed": sum(rows.values())}
    return {k: status[k] for k in ("total", "done", "failed", "known", "state")}
