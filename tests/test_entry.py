"""The driver's entry: names, the smoke query, and what is left when the corpus operators are removed."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from leafspine.plans import registered

ROOT = Path(__file__).resolve().parents[1]


def test_names():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(registered.QUERIES) <= set(queries) and set(sql) <= set(queries)


@pytest.mark.skipif(not Path(entry.SMOKE_DIR).exists(), reason="the tables aren't here")
def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["doc_id", "chapter_index", "title", "level", "word_count", "paragraph_count"] and rows.count() > 200


def test_without_corpus_operators(tmp_path):
    shutil.copytree(ROOT / "leafspine", tmp_path / "leafspine", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), len(e.oracle_sql()), [n for n in q if n.startswith('op') or n == 'pipeline'])"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    assert out.stdout.strip() == f"{len(registered.QUERIES)} {len(set(entry.oracle_sql()) & set(registered.QUERIES))} []"


def test_broken_operators_are_reported(tmp_path):
    shutil.copytree(ROOT / "leafspine", tmp_path / "leafspine", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    (tmp_path / "leafspine" / "llm").mkdir()
    (tmp_path / "leafspine" / "llm" / "__init__.py").write_text("")
    (tmp_path / "leafspine" / "llm" / "queries.py").write_text("import a_module_that_is_not_there")
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; e.queries()"], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True, timeout=120)
    assert out.returncode and "a_module_that_is_not_there" in out.stderr
