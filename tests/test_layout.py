import re
from pathlib import Path

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

from tarnflow.plans.dialect import rewrite
from tarnflow.sources.catalog import like
from tarnflow.sources.partitioned import split_predicates

ROOT = Path(__file__).resolve().parents[1]


def test_only_the_entry_point_knows_the_training_operators():
    for path in [*ROOT.glob("tarnflow/**/*.py"), ROOT / "bench.py"]:
        if "llm" not in path.parts:
            assert not re.search(r"(import|from)\s+\S*(\bllm\b|corpus_pipeline)", path.read_text()), path


def test_the_entry_point_stands_without_them(tmp_path):
    """Without the folder, or without a library that it needs, the other queries stay."""
    import os
    import shutil
    import subprocess
    import sys

    for part in ("tarnflow", "__spark_entry__.py", "corpus_pipeline.py"):
        source = ROOT / part
        if source.is_dir():
            shutil.copytree(source, tmp_path / part, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        elif part == "__spark_entry__.py":
            shutil.copy(source, tmp_path / part)
    check = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 150 and set(e.oracle_sql()) <= set(q) and not [n for n in q if n.startswith('op') and n[2].isdigit() or n == 'pipeline']"
    subprocess.run([sys.executable, "-c", check], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    broken = tmp_path / "tarnflow" / "llm"
    broken.mkdir()
    (broken / "__init__.py").write_text("")
    (broken / "queries.py").write_text("import a_library_that_is_not_there\n")
    subprocess.run([sys.executable, "-c", check], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def test_no_local_checkpoints():
    for path in [*ROOT.glob("tarnflow/**/*.py"), *ROOT.glob("*.py")]:
        assert "localCheckpoint" not in path.read_text(), path


@settings(max_examples=300, deadline=None)
@given(st.text("aAb_%", max_size=6), st.text("aAb_%", max_size=6))
def test_like_is_sql_ilike(name, pattern):
    want = duckdb.execute("SELECT ? ILIKE ?", [name, pattern]).fetchone()[0]
    assert like(pattern)(name) == want


@settings(max_examples=300, deadline=None)
@given(st.text("a':;,|()1 ", max_size=12))
def test_texts_pass_the_rewrites_unharmed(text):
    literal = "'" + text.replace("'", "''") + "'"
    assert rewrite(f"SELECT {literal} AS x") == f"SELECT {literal} AS x"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab =1", min_size=1, max_size=5).filter(str.strip), max_size=5), st.sampled_from(";|,"))
def test_predicates_split_where_they_were_joined(parts, sep):
    assert split_predicates(sep.join(parts)) == [p.strip() for p in parts]
