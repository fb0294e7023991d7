"""The entry module imports and answers without the corpus operators."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"
ASK = f"""
import __spark_entry__ as entry
from tallyforge.session import local_session
names = set(entry.queries())
assert "red_flags" in names and "pipeline" not in names and not any(n.startswith("op") for n in names), names
assert set(entry.oracle_sql()) <= names
spark = local_session(cores=2, shuffle_partitions=2, memory="1g")
print("rows", entry.queries()["row_counts"](spark, "{SF}").count())
"""


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables absent")
@pytest.mark.parametrize("without_pipeline", [False, True])
def test_entry_without_the_corpus_operators(tmp_path, without_pipeline):
    left_out = shutil.ignore_patterns("llm", ".git", "__pycache__", *(["corpus_pipeline.py"] if without_pipeline else []))
    shutil.copytree(ROOT, tmp_path / "copy", ignore=left_out)
    env = {**os.environ, "PYTHONPATH": ""}
    done = subprocess.run([sys.executable, "-c", ASK], cwd=tmp_path / "copy", env=env, capture_output=True, text=True,
                          timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "rows 14" in done.stdout
