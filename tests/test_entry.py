"""The entry module works with and without the text operators."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_every_sql_has_a_query() -> None:
    assert not set(entry.oracle_sql()) - set(entry.queries())


def test_imports_without_the_subpackage(tmp_path: Path) -> None:
    shutil.copytree(ROOT / "chainmark", tmp_path / "chainmark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries())"], cwd=tmp_path, capture_output=True, text=True)
    n, has = said.stdout.split()
    assert int(n) > 50 and has == "False"
