"""Without the corpus package the rest imports and registers its queries."""

import shutil
import subprocess
import sys
from pathlib import Path

TOP = Path(__file__).resolve().parents[1]


def test_the_rest_imports_without_the_corpus_package(tmp_path):
    skip = shutil.ignore_patterns("llm", "__pycache__", ".git", "*.json")
    for keep_pipeline in (True, False):
        copy = tmp_path / f"copy{keep_pipeline}"
        shutil.copytree(TOP, copy, ignore=skip)
        if not keep_pipeline:
            (copy / "corpus_pipeline.py").unlink(missing_ok=True)
        code = "import __spark_entry__ as e; q = e.queries(); assert 'reconcile_full' in q and 'pipeline' not in q and not any(n.startswith('op') and n[2].isdigit() for n in q); print(len(q), len(e.oracle_sql()))"
        done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=120)
        assert done.returncode == 0, done.stderr
