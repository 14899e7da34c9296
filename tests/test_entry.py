"""The library without its training-data part."""

import os
import shutil
import subprocess
import sys
from types import SimpleNamespace

import pytest

from tessera.operators import shared

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LOOK = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 100 and set(o) <= set(q); print(any(n.startswith('op') and n[2].isdigit() for n in q), 'pipeline' in q)"


def _copy(to, *without):
    skip = shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache")
    shutil.copytree(ROOT, to, ignore=skip)
    for path in without:
        shutil.rmtree(to / path, ignore_errors=True) if (to / path).is_dir() else os.path.exists(to / path) and os.remove(to / path)
    return to


def _run(folder, *args):
    env = {**os.environ, "PYTHONPATH": str(folder)}
    return subprocess.run([sys.executable, *args], cwd=folder, env=env, capture_output=True, text=True, timeout=300)


@pytest.mark.skipif(not os.path.isdir(os.path.join(ROOT, "tests", "llm")), reason="runs where all is there")
@pytest.mark.parametrize("without", [("tessera/llm", "tests/llm"), ("tessera/llm", "tests/llm", "corpus_pipeline.py")])
def test_without_the_training_data_part(tmp_path, without):
    folder = _copy(tmp_path / "repo", *without)
    # A deleted folder may leave its caches behind.
    (folder / "tessera/llm/__pycache__").mkdir(parents=True)
    found = _run(folder, "-c", LOOK)
    assert found.returncode == 0 and found.stdout.split() == ["False", "False"], found.stderr
    tests = _run(folder, "-m", "pytest", "tests", "-q", "--collect-only")
    assert tests.returncode == 0, tests.stdout + tests.stderr
    assert _run(folder, "-m", "pytest", "tests/test_physical.py", "-q", "-x").returncode == 0


def test_a_cluster_needs_a_shared_folder():
    unset = SimpleNamespace(get=lambda name, default=None: default)
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            shared.shared_folder(SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(master=master)))
