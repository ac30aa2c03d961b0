"""The entry module with and without the parts that may be absent."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
SAY = "import __spark_entry__ as e; print(' '.join(e.queries())); assert set(e.oracle_sql()) <= set(e.queries())"


def _copy(to: Path) -> Path:
    skip = shutil.ignore_patterns("llm", "__pycache__")
    shutil.copytree(ROOT / "factorspark", to / "factorspark", ignore=skip)
    shutil.copy(ROOT / "__spark_entry__.py", to)
    return to


def _names(at: Path) -> list[str]:
    run = subprocess.run([sys.executable, "-c", SAY], cwd=at, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr
    return run.stdout.split()


def test_imports_without_the_subpackage(tmp_path):
    names = _names(_copy(tmp_path))
    assert "op_s7_bars" in names and "pipeline" not in names and not any(n[2].isdigit() for n in names)


def test_a_fault_inside_the_subpackage_shows(tmp_path):
    (_copy(tmp_path) / "factorspark/llm").mkdir()
    (tmp_path / "factorspark/llm/__init__.py").write_text("import no_such_module_anywhere\n")
    with pytest.raises(AssertionError, match="no_such_module_anywhere"):
        _names(tmp_path)


def test_imports_beside_a_left_over_pipeline(tmp_path):
    (_copy(tmp_path) / "corpus_pipeline.py").write_text("from factorspark.llm import simhash\n")
    assert "pipeline" not in _names(tmp_path)
