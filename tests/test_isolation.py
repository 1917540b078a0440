import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from .conftest import ROOT

SAYS = "import __spark_entry__ as e; names = {*e.queries(), *e.oracle_sql()}; assert len(names) > 30 and not any(n.startswith('op') or n == 'pipeline' for n in names), names"


@pytest.mark.parametrize("gone", [[], ["corpus_pipeline.py"]])
def test_the_rest_stands_without_the_training_text_part(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "spark-warehouse"))
    for name in ("paperloom/llm", "tests/llm"):
        shutil.rmtree(copy / name, ignore_errors=True)
    for name in gone:
        (copy / name).unlink(missing_ok=True)
    # All of the environment stands but for the path, which leads to the copy alone.
    rest = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and Path(p).resolve() != ROOT]
    run = lambda *args: subprocess.run([sys.executable, *args], cwd=copy, env=os.environ | {"PYTHONPATH": os.pathsep.join([str(copy), *rest])}, capture_output=True, text=True, timeout=900)
    tests = ["-m", "pytest", "-q", "-p", "no:cacheprovider"]
    some = ["tests/test_structure.py", "tests/test_candidates.py", "tests/test_queries.py::test_entry"]
    for args in (["-c", SAYS], [*tests, "--collect-only", "tests"], *([] if gone else [[*tests, *some]])):
        done = run(*args)
        assert done.returncode == 0, done.stdout + done.stderr
        assert str(ROOT / "paperloom") not in done.stdout
