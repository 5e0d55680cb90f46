"""The rest stands without the subpackage for training data."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
ENTRY = """
import __spark_entry__ as e, echofold
names = set(e.queries())
assert "p5_found" in names and not any(n.startswith("p") and n[1].isdigit() and not n.startswith("p5") for n in names), names
assert set(e.oracle_sql()) <= names
"""


def copied(tmp_path):
    shutil.copytree(ROOT, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "*.json"))
    return tmp_path / "copy"


def run(root, *args):
    return subprocess.run([sys.executable, *args], cwd=root, capture_output=True, text=True, timeout=600, env=os.environ | {"PYTHONPATH": str(root), "PYTHONDONTWRITEBYTECODE": "1"})


def test_without_the_subpackage(tmp_path):
    root = copied(tmp_path)
    shutil.rmtree(root / "echofold/llm", ignore_errors=True)
    shutil.rmtree(root / "tests/llm", ignore_errors=True)
    done = run(root, "-c", ENTRY)
    assert done.returncode == 0, done.stderr
    done = run(root, "-m", "pytest", "tests", "--collect-only", "-q", "-p", "no:cacheprovider")
    assert done.returncode == 0, done.stdout
    done = run(root, "-m", "pytest", "tests/test_extract.py", "tests/test_properties.py", "-q", "-p", "no:cacheprovider")
    assert done.returncode == 0, done.stdout


def test_a_broken_import_is_an_error(tmp_path):
    root = copied(tmp_path)
    if not (root / "echofold/llm").exists():
        return
    (root / "echofold/llm/queries.py").write_text("import no_such_module\n")
    assert "no_such_module" in run(root, "-c", "import __spark_entry__").stderr
