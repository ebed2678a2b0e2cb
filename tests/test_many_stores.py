"""Queries over stores and files against their SQL where store numbers have four and more digits."""

import os

import duckdb
import pytest
from test_oracle import ordered, plain

from basketry.plans.registry import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def folder(sf, tmp_path_factory):
    """The smallest tables with their suppliers four times: as they are, with 4 digits, and twice with 5 digits of which three may be alike."""
    out = str(tmp_path_factory.mktemp("many"))
    con = duckdb.connect()
    for name in ("nation", "part", "supplier", "lineitem"):
        more = {"supplier": "s_suppkey", "lineitem": "l_suppkey"}.get(name)
        rows = f"SELECT * FROM '{sf}/{name}.parquet'" if more is None else f"SELECT * REPLACE ({more} + x AS {more}) FROM '{sf}/{name}.parquet', (VALUES (0), (1000), (12340), (12350)) t(x)"
        con.execute(f"COPY ({rows}) TO '{out}/{name}.parquet' (FORMAT parquet)")
    return out


@pytest.mark.parametrize("name", ["f16_f17_regional_files", "s1_s6_feed_source", "s7_file_facts"])
def test_equals_sql(spark, folder, name):
    con = duckdb.connect()
    for x in os.listdir(folder):
        con.execute(f"CREATE VIEW {x[:-8]} AS SELECT * FROM '{folder}/{x}'")
    df = QUERIES[name](spark, folder)
    got = [tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()]
    cursor = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    want = [tuple(plain(row[names.index(c)]) for c in sorted(df.columns)) for row in cursor.fetchall()]
    assert sorted(names) == sorted(df.columns) and want and ordered(got) == ordered(want)
