"""Every query with SQL against DuckDB on the smallest tables; the others must run."""

import datetime
import glob
import math
import os

import duckdb
import pytest

from basketry.plans.registry import FLAGSHIP, ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    cursor = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = [tuple(plain(row[names.index(c)]) for c in columns) for row in cursor.fetchall()]
    assert ordered(got) == ordered(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, sf, name):
    QUERIES[name](spark, sf).collect()


def test_flagship_plan_prunes_and_filters(spark, sf):
    plan = QUERIES[FLAGSHIP](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "PushedFilters: [" in plan


def test_entry_imports_without_the_corpus_operators(tmp_path):
    import shutil
    import subprocess
    import sys

    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{repo}/basketry", tmp_path / "basketry", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{repo}/__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    assert int(out.stdout.split()[0]) == len(QUERIES)


@pytest.mark.parametrize("name", ["b1_candidate_fold", "b11_multi_store"])
def test_every_basket_is_served(spark, sf, duck, name):
    got = {r[0] for r in QUERIES[name](spark, sf).select("basket_id").distinct().collect()}
    assert got == {x for (x,) in duck.execute("SELECT DISTINCT l_orderkey FROM lineitem").fetchall()}


def test_name_similarity_has_every_pair(spark, sf, duck):
    got = {(r["name"], r["other"]) for r in QUERIES["t19_name_similarity"](spark, sf).collect()}
    assert got == set(duck.execute("SELECT DISTINCT a.p_name, b.p_name FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_name <= b.p_name").fetchall())
