"""The entry module with and without the optional subpackage, and the catalog against its SQL."""

import glob
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

from tephra import queries as catalog

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"


def test_works_without_the_subpackage(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; n = e.queries(); assert 'kv_latest' in n and 'pipeline' not in n and not any(x.startswith('op') for x in n); assert set(e.oracle_sql()) <= set(n)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return round(float(v), 6) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = catalog.QUERIES[name](spark, SF)
    other = con.execute(catalog.ORACLE_SQL[name])
    names, order = sorted(df.columns), [c[0] for c in other.description]
    assert names == sorted(order)
    mine = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)
    assert mine == sorted((tuple(plain(r[order.index(n)]) for n in names) for r in other.fetchall()), key=repr)
