"""Every query of the catalogue against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from evidentia.plans import catalogue

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def plain(value):
    return f"{value:.9g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_rows(spark, duck, name):
    found = catalogue.QUERIES[name](spark, DIR)
    answer = duck.execute(catalogue.ORACLES[name])
    columns = [c[0] for c in answer.description]
    assert sorted(columns) == sorted(found.columns)
    want = sorted(tuple(plain(r[columns.index(c)]) for c in sorted(columns)) for r in answer.fetchall())
    assert sorted(tuple(plain(r[c]) for c in sorted(columns)) for r in found.collect()) == want


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, DIR).count() > 0


def test_every_event_has_a_position(spark):
    events = catalogue.event_report(spark, DIR).count()
    assert catalogue.event_order_all_weeks(spark, DIR).count() == events
    assert catalogue.sectioned_report_order_all_weeks(spark, DIR).count() == events
