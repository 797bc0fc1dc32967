"""The driver contract, and each query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from airgrid.plans import queries as plans

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


def _plain(rows, columns):
    return sorted(tuple("" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v) for v in (r[c] for c in columns)) for r in rows)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query_equals_sql(spark, name):
    got = plans.QUERIES[name](spark, SF)
    rows = [r.asDict() for r in got.collect()]
    assert rows
    if name in plans.SQL:
        with duckdb.connect() as db:
            for f in glob.glob(f"{SF}/*.parquet"):
                db.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
            want = db.sql(plans.SQL[name])
            columns = sorted(want.columns)
            assert sorted(got.columns) == columns
            assert _plain(rows, columns) == _plain([dict(zip(want.columns, r, strict=True)) for r in want.fetchall()], columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["view_guide_json", "xmltv_document"])
def test_all_airings_are_in(spark, name):
    rows = entry.queries()[name](spark, SF).collect()
    told = sum(r["body"].count('"start":') for r in rows) if "json" in name else sum("<programme " in r["value"] for r in rows)
    assert told == plans._programs(spark, SF).count()
