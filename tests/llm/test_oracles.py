"""Registered queries against their SQL on the driver's smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from plumbline.llm import queries

DIR = "/root/testdata/sf0.001"


def rows(frame):
    cols = sorted(frame.columns)
    return cols, sorted(tuple("" if pd.isna(x) else f"{x:.12g}" if isinstance(x, float) else str(x) for x in r) for r in frame[cols].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DIR}/{f}'")
    assert rows(queries.queries()[name](spark, DIR).toPandas()) == rows(con.execute(queries.oracle_sql()[name]).df())


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == sorted(range(1, 14))
