"""The entry point with and without the training-data subpackage."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def names(folder: str, before: str = "") -> set[str]:
    code = f"import sys, warnings; warnings.simplefilter('ignore'); {before}\nimport __spark_entry__ as e\nprint(*e.queries())\nassert set(e.oracle_sql()) <= set(e.queries())"
    done = subprocess.run([sys.executable, "-c", code], cwd=folder, env=os.environ | {"PYTHONPATH": folder}, capture_output=True, text=True, check=True)
    return set(done.stdout.split())


@pytest.mark.parametrize("missing", ["ahocorasick", "sentencepiece", "meridia.llm.queries", "meridia.llm"])
def test_base_queries_survive_a_missing_import(missing):
    found = names(ROOT, f"sys.modules[{missing!r}] = None")
    assert {"score_b", "average_precision", "tfidf"} <= found and not any(n.startswith("op4") for n in found)


def test_base_queries_survive_an_empty_folder(tmp_path):
    for name in ("__spark_entry__.py", "meridia"):
        copy = shutil.copytree if os.path.isdir(f"{ROOT}/{name}") else shutil.copy
        copy(f"{ROOT}/{name}", tmp_path / name)
    if (tmp_path / "meridia/llm").exists():
        shutil.rmtree(tmp_path / "meridia/llm")
    (tmp_path / "meridia/llm/__pycache__").mkdir(parents=True)
    assert "score_b" in names(str(tmp_path))
