import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

# Names that a copy of the repository gives, one per line.
LIST = "import __spark_entry__ as e; print(*e.queries(), sep='\\n'); assert set(e.oracle_sql()) <= set(e.queries())"


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_the_training_data_operators(tmp_path, pipeline):
    left_out = [".git", "__pycache__", "llm"] + ([] if pipeline else ["corpus_pipeline.py"])
    copy = shutil.copytree(ROOT, tmp_path / "copy", ignore=shutil.ignore_patterns(*left_out))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", LIST], cwd=copy, env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    names = done.stdout.split()
    assert "remediation_stats" in names
    assert not any(n.startswith("op") and n[2:3].isdigit() or n == "pipeline" for n in names)
