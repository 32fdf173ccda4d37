"""Every registered query runs; those with SQL agree with it. The entry module works without the corpus operators."""

import subprocess
import sys
from pathlib import Path

import oracle
import pytest

from paperflow.plans import catalogue

ROOT = Path(__file__).resolve().parents[1]


@pytest.fixture(scope="module")
def con(sf):
    return oracle.database(sf)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf, con, name):
    if name in catalogue.ORACLE_SQL:
        assert oracle.difference(spark, con, catalogue.QUERIES[name], catalogue.ORACLE_SQL[name], sf) is None
    else:
        catalogue.QUERIES[name](spark, sf).count()


def test_entry_without_corpus_operators(tmp_path):
    for p in ROOT.glob("paperflow/**/*.py"):
        if "llm" not in p.parts:
            to = tmp_path / p.relative_to(ROOT)
            to.parent.mkdir(parents=True, exist_ok=True)
            to.write_text(p.read_text())
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert 'a5_rule_frequency' in q and 'pipeline' not in q and not [n for n in q if n.startswith('op')]; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
