"""Model calls: each prompt asked once whatever fails, answers kept, progress watched."""

import json
import threading
import time
import uuid

import pytest
from pyspark import TaskContext

from paperloom.plans import answers, app, providers


class Counting:
    """Leaves a file for each call; fails where it is told to."""

    def __init__(self, log, **how):
        self.log, self.how = str(log), how

    def generate(self, prompt, schema=None):
        from pathlib import Path

        (Path(self.log) / f"{prompt.replace(' ', '_')}-{uuid.uuid4().hex}").write_text("")
        time.sleep(self.how.get("slow", 0))
        if prompt in self.how.get("broken", ()):
            raise RuntimeError("gone")
        if prompt == self.how.get("kills") and TaskContext.get() is None:
            pass
        return f"{prompt}!" if schema is None else json.dumps(schema)


def calls(log):
    out = {}
    for f in log.iterdir():
        name = f.name.rpartition("-")[0].replace("_", " ")
        out[name] = out.get(name, 0) + 1
    return out


@pytest.fixture
def log(tmp_path):
    (tmp_path / "log").mkdir()
    return tmp_path / "log"


def test_a_prompt_is_asked_once_ever(spark, tmp_path, log):
    path, model = str(tmp_path / "answers"), Counting(log)
    rows = spark.createDataFrame([(i, f"p {i % 30}" if i % 7 else None) for i in range(90)], "id int, prompt string")
    for k in range(2):
        got = {r.id: (r.answer, r.error) for r in answers.answered(rows, model, path, per_task=4, per_file=3).collect()}
        assert got == {i: (f"p {i % 30}!" if i % 7 else None, None) for i in range(90)}
        assert set(calls(log).values()) == {1} and len(calls(log)) == 30
        assert answers.progress(path) == {"total": 0 if k else 30, "done": 0 if k else 30, "failed": 0, "known": 30 if k else 0, "state": "done"}
    more = spark.createDataFrame([(1, "p 1"), (2, "new")], "id int, prompt string")
    assert answers.answered(more, model, path).count() == 2 and calls(log)["new"] == 1 and sum(calls(log).values()) == 31
    # Another model, or one with other settings, is asked anew, and so is a prompt with a schema.
    assert answers.answered(more, Counting(log, slow=0.001), path).count() == 2 and sum(calls(log).values()) == 33
    assert answers.answered(more.selectExpr("*", "'{}' AS s"), model, path, schema="s").first().answer == "{}"


def test_failures_are_tried_again_and_not_kept(spark, tmp_path, log):
    path = str(tmp_path / "answers")
    rows = spark.createDataFrame([("a",), ("b",)], "prompt string")
    got = {r.prompt: (r.answer, r.error) for r in answers.answered(rows, Counting(log, broken=("b",)), path, tries=3, wait=0.01).collect()}
    assert got == {"a": ("a!", None), "b": (None, "RuntimeError: gone")} and calls(log) == {"a": 1, "b": 3}
    assert answers.progress(path) == {"total": 2, "done": 2, "failed": 1, "known": 0, "state": "done"}
    answers.answered(rows, Counting(log, broken=("b",)), path, tries=2, wait=0.01).count()
    assert calls(log) == {"a": 1, "b": 5}


def test_a_task_that_dies_asks_nothing_again(tmp_path, log):
    """A worker is killed once, in the middle of its prompts: in a session with retries the second attempt goes on where the first was."""
    import os
    import subprocess
    import sys

    program = """
import json, os, signal, sys
from pathlib import Path
sys.path.insert(0, "tests")
from pyspark.sql import SparkSession
from paperloom.plans import answers
from tests.test_answers import Counting

class Deadly(Counting):
    def generate(self, prompt, schema=None):
        out = super().generate(prompt, schema)
        once = Path(self.log).parent / "killed"
        if prompt == "p 17" and not once.exists():
            # What was asked with it is in no journal yet; here that is nothing, as one prompt is asked at a time.
            once.write_text("")
            os.kill(os.getpid(), signal.SIGKILL)
        return out

spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", sys.argv[2] + "/c").getOrCreate()
rows = spark.createDataFrame([(f"p {i}",) for i in range(40)], "prompt string")
got = answers.answered(rows, Deadly(sys.argv[1]), sys.argv[2] + "/answers", per_task=100, per_file=1, at_once=1)
assert sorted(r.answer for r in got.collect()) == sorted(f"p {i}!" for i in range(40))
print("over", answers.progress(sys.argv[2] + "/answers"))
"""
    from .conftest import ROOT

    done = subprocess.run([sys.executable, "-c", program, str(log), str(tmp_path)], cwd=ROOT, env=os.environ | {"PYTHONPATH": f"{ROOT}{os.pathsep}{os.environ['PYTHONPATH']}"}, capture_output=True, text=True, timeout=300)
    assert "over {'total': 40, 'done': 40, 'failed': 0, 'known': 0, 'state': 'done'}" in done.stdout, done.stderr[-2000:]
    assert (tmp_path / "killed").exists()
    # The prompt in whose call the worker died was asked twice; no other was.
    assert calls(log) == {f"p {i}": 1 + (i == 17) for i in range(40)}


def test_what_a_dead_run_was_told_is_kept(spark, tmp_path, log):
    path = str(tmp_path / "answers")
    rows = spark.createDataFrame([("a",), ("b",)], "prompt string")
    answers.answered(rows.where("prompt = 'a'"), Counting(log), path).count()
    key = spark.read.parquet(f"{path}/table").first().key
    other = tmp_path / "other"
    answers._put(*answers._open(f"{other}/journal/dead/000000/x.json"), json.dumps({"key": key, "answer": "kept", "error": None}) + "\n")
    got = {r.prompt: r.answer for r in answers.answered(rows, Counting(log), str(other)).collect()}
    assert got == {"a": "kept", "b": "b!"} and calls(log) == {"a": 1, "b": 1} and not list((other / "journal").glob("*"))


def test_progress_is_watched(spark, tmp_path, log):
    path, seen = str(tmp_path / "answers"), []
    rows = spark.createDataFrame([(f"p {i}",) for i in range(60)], "prompt string")
    assert answers.progress(path) is None
    work = threading.Thread(target=lambda: answers.answered(rows, Counting(log, slow=0.05, broken=("p 3",)), path, per_task=15, per_file=2, at_once=2, tries=1).count())
    work.start()
    while work.is_alive():
        if state := answers.progress(path):
            seen.append(state)
        time.sleep(0.05)
    work.join()
    seen.append(answers.progress(path))
    done = [s["done"] for s in seen]
    assert done == sorted(done) and 0 < done[len(done) // 2] and len(set(done)) > 3 and all(s["total"] == 60 for s in seen)
    assert seen[-1] == {"total": 60, "done": 60, "failed": 1, "known": 0, "state": "done"} and seen[0]["state"] == "running"


def test_a_scan_goes_on(spark, tmp_path, log):
    (tmp_path / "docs").mkdir()
    for k in range(6):
        (tmp_path / "docs" / f"{k}.txt").write_text(f"Invoice {k}\nFrom: Acme\nDue date: 2025-04-03\nAmount due: $1{k}.50\n")
    store, path = str(tmp_path / "store"), str(tmp_path / "answers")
    app.index(spark, str(tmp_path / "docs"), store, providers.HashedEmbedder())
    first = app.scan_bills(spark, store, providers.EchoGenerator(), answers=path).collect()
    assert sorted(map(str, first)) == sorted(map(str, app.scan_bills(spark, store, providers.EchoGenerator()).collect()))
    assert answers.progress(path)["total"] == 6
    app.scan_bills(spark, store, providers.EchoGenerator(), answers=path).collect()
    assert answers.progress(path) == {"total": 0, "done": 0, "failed": 0, "known": 6, "state": "done"}
