"""Every registered query with SQL against DuckDB on the smallest tables."""

import math
import os
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__
from edulens.plans import analytics, guidance, records, rules, scoring

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
PLANS = (analytics, scoring, records, rules, guidance)
NAMES = sorted(n for m in PLANS for n in m.S)
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    return v


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, SF)
    order = sorted(df.columns)
    got = sorted(str([plain(r[c]) for c in order]) for r in df.collect())
    cur = duck.execute(__spark_entry__.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == order
    want = sorted(str([plain(r[names.index(c)]) for c in order]) for r in cur.fetchall())
    assert got == want


def test_entry_runs(spark):
    assert __spark_entry__.entry(spark).count() > 0
