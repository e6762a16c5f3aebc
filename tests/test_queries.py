"""Registered library queries against DuckDB on the smallest tables, and the entry's guard."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from heliograph.plans import catalogue, decisions

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def rounded(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return [rounded(x) for x in v] if isinstance(v, list) else v


def rows(values, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(rounded(r[i]) for i in order) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(decisions.queries()))
def test_matches_duckdb(spark, con, sf_dir, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    got = rows([tuple(r) for r in df.collect()], df.columns)
    if name in catalogue.ORACLES:
        want = con.sql(catalogue.ORACLES[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert got == rows(want.fetchall(), want.columns)
    else:
        assert got


def test_imports_without_the_optional_parts(tmp_path):
    root = Path(__file__).resolve().parents[1]
    script = "import __spark_entry__ as e; assert 'timeline_page' in e.queries(); assert not any(n.startswith('op1_') for n in e.queries()); e.oracle_sql()"
    for item in ("__spark_entry__.py", "heliograph"):
        subprocess.run(["cp", "-r", str(root / item), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "heliograph" / "llm")], check=True)
    subprocess.run([sys.executable, "-c", script], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"} | {k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"})
