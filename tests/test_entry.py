from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parent.parent


def test_every_oracle_has_a_query(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    df = __spark_entry__.queries()["task_reason"](spark, "/root/testdata/sf0.001")
    assert df.columns == ["task_id", "reason", "tip"] and df.count() == 1500


def test_nothing_else_imports_the_corpus_subpackage():
    for path in ROOT.glob("lantern/**/*.py"):
        if "llm" not in path.parts:
            assert "lantern.llm" not in path.read_text(), path


def test_entry_works_without_the_corpus_subpackage(tmp_path):
    for name in ("__spark_entry__.py", "lantern"):
        _copy(ROOT / name, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') for n in q) and 'pipeline' not in q; print(len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path), "PYTHONDONTWRITEBYTECODE": "1"})
    assert done.returncode == 0, done.stderr


def _copy(source: Path, to: Path) -> None:
    if source.is_file():
        to.write_text(source.read_text())
    for path in source.rglob("*.py"):
        if "llm" not in path.relative_to(source).parts:
            (to / path.relative_to(source)).parent.mkdir(parents=True, exist_ok=True)
            (to / path.relative_to(source)).write_text(path.read_text())
