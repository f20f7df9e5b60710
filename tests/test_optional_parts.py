"""The library without its optional part: the entry imports, its own queries stay."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

import pytest

TOP = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
COUNT = "import __spark_entry__ as e; q = e.queries(); print(len(q), sum(n.startswith('op') or n == 'pipeline' for n in q))"


@pytest.mark.parametrize("pipeline_stays", [True, False])
def test_entry_without_the_optional_folders(tmp_path, pipeline_stays):
    skip = shutil.ignore_patterns("llm", "__pycache__")
    shutil.copytree(os.path.join(TOP, "ownergraph"), tmp_path / "ownergraph", ignore=skip)
    shutil.copy(os.path.join(TOP, "__spark_entry__.py"), tmp_path)
    pipeline = os.path.join(TOP, "corpus_pipeline.py")
    if pipeline_stays and os.path.exists(pipeline):
        shutil.copy(pipeline, tmp_path)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", COUNT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120
    )
    assert done.returncode == 0, done.stderr
    from ownergraph.plans.catalogue import QUERIES

    assert done.stdout.split() == [str(len(QUERIES)), "0"]
