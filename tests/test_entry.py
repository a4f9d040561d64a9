"""The entry module with and without the training-data package."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def names(folder):
    code = "import __spark_entry__ as e; print(*e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"
    done = subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"}, check=True)
    return done.stdout.split()


def test_library_stands_alone(tmp_path):
    for name in ("weftline", "__spark_entry__.py"):
        source = ROOT / name
        (shutil.copytree if source.is_dir() else shutil.copy)(source, tmp_path / name)
    shutil.rmtree(tmp_path / "weftline" / "llm", ignore_errors=True)
    found = names(tmp_path)
    assert len(found) > 90 and not any(n.startswith("op") for n in found)
    assert set(found) <= set(names(ROOT))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
