import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from quarry.plans import registry

ROOT = Path(__file__).resolve().parents[1]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(v):
    if v is None or v != v:
        return "none"
    return f"{v:.9f}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def oracle(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_its_sql(spark, sf, oracle, name):
    got = registry.QUERIES[name](spark, sf).toPandas()
    if name not in registry.ORACLE_SQL:
        assert len(got) > 0
        return
    want = oracle.execute(registry.ORACLE_SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = lambda d: sorted(tuple(map(normal, r)) for r in d[cols].values.tolist())
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_imports_without_the_optional_parts(tmp_path):
    """A copy without the corpus subpackage still registers the other queries."""
    import shutil

    shutil.copytree(ROOT / "quarry", tmp_path / "quarry", ignore=lambda d, names: [n for n in names if n in ("llm", "__pycache__")])
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and not any(k.startswith('op') for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"}, timeout=120)
