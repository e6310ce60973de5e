"""Every registered query against its SQL twin, on the smallest tables."""

import importlib.util
import math
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from tagloom.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return c


def plain(x):
    return repr(round(float(x), 9)) if isinstance(x, float) and not math.isnan(x) else str(x)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    out = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in out.description]
    assert sorted(names) == cols
    want = sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in out.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry_points():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(QUERIES) <= set(e.queries())


def test_entry_points_without_the_subpackage(tmp_path):
    """A copy without the training-data operators still names and imports every other query."""
    root = Path(importlib.util.find_spec("__spark_entry__").origin).parent
    shutil.copytree(root / "tagloom", tmp_path / "tagloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    for left in (["corpus_pipeline.py"], []):
        for name in left:
            if (root / name).exists():
                shutil.copy(root / name, tmp_path)
        code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
        out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"}, capture_output=True, text=True, check=True)
        assert out.stdout.split() == [str(len(QUERIES)), str(len(ORACLE_SQL))]
        (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
