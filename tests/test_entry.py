"""The driver's contract, with and without the training-data folders."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_flagship(spark):
    import __spark_entry__ as e

    rows = e.entry(spark).collect()
    assert rows and set(e.oracle_sql()) <= set(e.queries())


def test_works_without_the_training_data_folders(tmp_path):
    (tmp_path / "quirefold").mkdir()
    for p in (ROOT / "quirefold").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "quirefold" / p.name).symlink_to(p)
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    code = "import __spark_entry__ as e; assert len(e.queries()) > 40 and not any(k.startswith('op') or k == 'pipeline' for k in e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
