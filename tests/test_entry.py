"""The entry module imports whichever optional parts are there."""
import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("without", [["llm"], ["llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_import_without_optional_parts(tmp_path, without):
    shutil.copytree(os.path.join(ROOT, "depotlens"), tmp_path / "depotlens",
                    ignore=shutil.ignore_patterns("__pycache__", *without))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if name not in without and os.path.exists(os.path.join(ROOT, name)):
            shutil.copy(os.path.join(ROOT, name), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print('\\n'.join(q))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert run.returncode == 0, run.stderr
    names = run.stdout.split()
    assert "demand_forecast" in names
    if without:
        assert "pipeline" not in names
    if "llm" in without:
        assert not any(n.startswith("op") and n[2].isdigit() for n in names)
