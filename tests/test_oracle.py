"""Every registered query against its SQL oracle on the given tables."""

import datetime
import math
import os
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry_point
from changegate.plans import catalogue
from changegate.plans.views import TABLES

SF_DIR = f"/root/testdata/sf{os.environ.get('CHANGEGATE_TEST_SF', '0.001')}"


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, Decimal):
        return round(float(value), 6)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF_DIR}/{t}.parquet'")
    yield con
    con.close()


def test_every_query_has_an_oracle():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)
    assert set(catalogue.QUERIES) <= set(entry_point.queries()) and set(catalogue.ORACLES) <= set(entry_point.oracle_sql())


def test_entry_is_the_flagship(spark):
    result = entry_point.entry(spark)
    assert {"run_key", "score", "final_decision", "status"} <= set(result.columns) and result.count() > 0


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_matches_oracle(spark, duck, name):
    result = entry_point.queries()[name](spark, SF_DIR)
    columns = sorted(result.columns)
    assert not any("array" in t or "struct" in t or "map" in t for _, t in result.dtypes)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in result.collect()), key=repr)
    cursor = duck.execute(entry_point.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in order) for r in cursor.fetchall()), key=repr)
    assert got == want
