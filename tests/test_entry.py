"""The entry imports anywhere: without Spark's jars, and without the optional subpackage."""

import pathlib
import shutil
import subprocess
import sys

ROOT = pathlib.Path(__file__).resolve().parents[1]
NAMES = """
import pyspark
pyspark.__file__ = "/nowhere/__init__.py"  # as where the jars lie elsewhere
import __spark_entry__ as entry
assert set(entry.oracle_sql()) <= set(entry.queries())
print(*entry.queries())
"""


def names(folder) -> set[str]:
    found = subprocess.run([sys.executable, "-c", NAMES], cwd=folder, capture_output=True, text=True)
    assert found.returncode == 0, found.stderr
    return set(found.stdout.split())


def test_imports_without_jars():
    assert "extract_keywords" in names(ROOT)


def test_imports_without_the_subpackage(tmp_path):
    shutil.copytree(ROOT / "lexiloom", tmp_path / "lexiloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path)
    found = names(tmp_path)
    assert "extract_keywords" in found and not {n for n in found if n.startswith("op") or n == "pipeline"}
