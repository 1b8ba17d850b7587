"""The entry module with and without the training-data part."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
CODE = """
import __spark_entry__ as e
q = e.queries()
assert set(e.oracle_sql()) <= set(q)
print(len(q), sum(n == "pipeline" or (n.startswith("op") and n[2].isdigit()) for n in q))
"""


def copy(folder, *without):
    shutil.copytree(ROOT, folder, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for w in without:
        p = folder / w
        shutil.rmtree(p, ignore_errors=True) if p.is_dir() else p.unlink(missing_ok=True)
    return subprocess.run([sys.executable, "-c", CODE], cwd=folder, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"})


@pytest.mark.parametrize("without", [("vectrill/llm", "tests/llm"), ("vectrill/llm", "tests/llm", "corpus_pipeline.py")])
def test_entry_without_the_subpackage(tmp_path, without):
    got = copy(tmp_path / "repo", *without)
    assert got.returncode == 0, got.stderr
    total, ours = map(int, got.stdout.split())
    assert total > 100 and ours == 0


def test_a_broken_import_is_an_error(tmp_path):
    if not (ROOT / "vectrill/llm").exists():
        pytest.skip("the subpackage is absent")
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    module = tmp_path / "repo/vectrill/llm/queries.py"
    module.write_text("import no_such_module\n" + module.read_text().replace("from __future__ import annotations", ""))
    got = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path / "repo", capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"})
    assert got.returncode != 0 and "no_such_module" in got.stderr
