import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from tessera import queries as Q
from tests import duck

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_against_sql(spark, small, name):
    if name in ("pk_candidates", "relationships", "fk_candidates_ranked", "inclusion_coverage", "cardinality"):
        small = small.replace("0.001", "0.01")
    duck.same(Q.QUERIES[name](spark, small), Q.ORACLES[name], small)


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLES)))
def test_others_run(spark, small, name):
    assert Q.QUERIES[name](spark, small).count() > 0


def test_sketches_are_near(spark, small):
    for r in Q.inclusion_sketch(spark, small).collect():
        assert r.coverage > 0.9


def test_entry_without_the_training_data_operators(tmp_path):
    shutil.copytree(ROOT / "tessera", tmp_path / "tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert not any(n.startswith('op') or n == 'pipeline' for n in q) and len(q) > 50; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
    (tmp_path / "tessera" / "llm").mkdir()
    (tmp_path / "tessera" / "llm" / "__init__.py").write_text("")
    (tmp_path / "tessera" / "llm" / "registry.py").write_text("import no_such_module")
    assert subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, capture_output=True).returncode  # a broken one isn't passed over


def test_nothing_else_imports_the_training_data_operators():
    for p in (ROOT / "tessera").rglob("*.py"):
        if "llm" not in p.parts:
            assert "tessera.llm" not in p.read_text() and "import llm" not in p.read_text() and ".llm " not in p.read_text()
