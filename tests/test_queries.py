"""Every registered query against its SQL twin, on the smallest tables."""
import datetime
import math
import os

import duckdb
import pytest

import __spark_entry__ as driver

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def _plain(v):
    if v is None or isinstance(v, (bool, int)):
        return v
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (datetime.date, str)):
        return str(v)
    return "nan" if math.isnan(v) else float(v) + 0.0


@pytest.mark.parametrize("name", sorted(driver.queries()))
def test_query(spark, duck, name):
    df = driver.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(_plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    sql = driver.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    cur = duck.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted((tuple(_plain(r[i]) for i in at) for r in cur.fetchall()), key=repr)


def test_entry_is_lazy_and_has_rows(spark):
    assert driver.entry(spark).columns == ["release", "state", "class", "segments", "length_km", "mean_segment_m", "pct_named"]


def test_every_twin_has_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.parametrize("name, column", [("scope_groups_every_month", "release"), ("comparable_pairs_every_month", "release_b"), ("scope_files_every_month", "release")])
def test_scopes_of_every_month_hold_december(spark, name, column):
    assert driver.queries()[name](spark, DATA).where(f"substring({column}, 6, 2) = '12'").count() > 0
