"""The library without the corpus part."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
COUNT = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries())"


def run(folder):
    done = subprocess.run([sys.executable, "-B", "-c", COUNT], cwd=folder, capture_output=True, text=True)
    return done.returncode, done.stdout.split(), done.stderr


def test_entry_without_the_corpus_part(tmp_path):
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "viewtide", tmp_path / "viewtide", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code, said, errors = run(tmp_path)
    assert code == 0, errors
    assert int(said[0]) >= 156 - 6 and said[2] == "False"


def test_a_broken_corpus_part_is_not_hidden(tmp_path):
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "viewtide", tmp_path / "viewtide", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_module\n")
    code, _, errors = run(tmp_path)
    assert code != 0 and "no_such_module" in errors


def test_nothing_else_imports_the_corpus_part():
    for path in (ROOT / "viewtide").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "viewtide.llm" not in path.read_text() and "corpus_pipeline" not in path.read_text(), path
