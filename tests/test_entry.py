"""The entry must work without the training-data operators, and must not hide what they lack."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parents[1]


def _run(folder, code):
    return subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "HOME": str(folder)})


def test_entry_without_the_training_data_operators(tmp_path):
    shutil.copytree(ROOT / "lexiforge", tmp_path / "lexiforge", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    done = _run(tmp_path, code)
    assert done.returncode == 0, done.stderr
    if (ROOT / "corpus_pipeline.py").exists():
        shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
        done = _run(tmp_path, code)
        assert done.returncode == 0, done.stderr


def test_missing_packages_are_not_hidden(tmp_path):
    shutil.copytree(ROOT / "lexiforge", tmp_path / "lexiforge", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    (tmp_path / "corpus_pipeline.py").write_text("import a_package_that_is_not_there\n")
    done = _run(tmp_path, "import __spark_entry__")
    assert "a_package_that_is_not_there" in done.stderr
