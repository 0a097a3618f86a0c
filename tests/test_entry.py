"""The driver's contract, and every query with SQL against DuckDB on the smallest tables."""

import glob
import importlib.util
import math
import os
import re

import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    if importlib.util.find_spec("reportforge.llm"):
        assert {n.split("_")[0] for n in entry.queries() if re.match(r"op\d", n)} == {f"op{i}" for i in range(1, 14)} and "pipeline" in entry.queries()


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def plain(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    v = v.item() if hasattr(v, "item") else v
    return round(v, 6) if isinstance(v, float) else str(v)[:10] if hasattr(v, "year") else v


def rows(frame):
    return sorted((tuple(plain(v) for v in r) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if not re.match(r"op\d", n)])
def test_against_duckdb(spark, name):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    got, want = entry.queries()[name](spark, SF).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert all(p == q or (isinstance(p, (int, float)) and isinstance(q, (int, float)) and abs(p - q) <= 2e-6) for p, q in zip(x, y, strict=True)), (x, y)
