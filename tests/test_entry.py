"""The entry module."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = str(Path(__file__).resolve().parents[1])


def test_imports_without_a_session():
    code = "import __spark_entry__ as e; assert len(e.queries()) >= len(e.oracle_sql()) > 100"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_flagship_gives_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0
