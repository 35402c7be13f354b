import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


def names(where: Path) -> tuple[list[str], list[str]]:
    code = "import __spark_entry__ as e; print(*e.queries()); print(*e.oracle_sql())"
    out = subprocess.run([sys.executable, "-c", code], cwd=where, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": f"{where}:{':'.join(sys.path)}"})
    assert out.returncode == 0, out.stderr
    queries, sql = out.stdout.splitlines()[-2:]
    return queries.split(), sql.split()


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_the_llm_folders(tmp_path, pipeline):
    skip = ["llm", ".git", "__pycache__"] + ([] if pipeline else ["corpus_pipeline.py"])
    shutil.copytree(ROOT, tmp_path / "copy", ignore=shutil.ignore_patterns(*skip))
    queries, sql = names(tmp_path / "copy")
    assert "knn_cosine" in queries and "pipeline" not in queries and not [q for q in queries if q.startswith("op")]
    assert set(sql) <= set(queries)


def test_every_sql_has_its_query():
    queries, sql = names(ROOT)
    assert set(sql) <= set(queries)
