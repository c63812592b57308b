"""The entry point stands without the training-data operators, in whatever part their files are gone."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
LISTS = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print('NAMES', *q)"


def _names(at: Path) -> set[str]:
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-B", "-c", LISTS], cwd=at, env=env, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr[-800:]
    return set(said.stdout.rpartition("NAMES")[2].split())


@pytest.mark.parametrize("gone", [["foldwright/llm", "tests/llm"], ["foldwright/llm", "tests/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_queries_without_the_operators(tmp_path, gone):
    at = tmp_path / "copy"
    shutil.copytree(ROOT, at, ignore=shutil.ignore_patterns(".git", "__pycache__", "*.pyc"))
    for g in gone:
        if (at / g).is_dir():
            shutil.rmtree(at / g)
        elif (at / g).exists():
            (at / g).unlink()
    names = _names(at)
    assert {"kfold_assign", "target_encode_kfold"} <= names and "pipeline" not in names
    assert any(n.startswith("op1_") for n in names) == (at / "foldwright/llm").is_dir()
