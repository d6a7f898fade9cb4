"""Every registered query against its DuckDB oracle on sf0.001 (the driver uses sf0.01)."""

import pytest

from tests.conftest import SF_SMALL
from wattline.plans.parity import compare, duck
from wattline.plans.queries import ORACLE, QUERIES


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_oracle(spark, con, name):
    r = compare(spark, name, SF_SMALL, con)
    assert r["spark_rows"] > 0
    if name in ORACLE:
        assert r["columns_match"], r
        assert r["exact"], r


def test_entry_contract(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    assert df.dtypes == [("date", "timestamp_ntz"), ("productiongroup", "string"), ("quantitykwh", "double")]
    assert set(QUERIES) <= set(E.oracle_sql()) <= set(E.queries())  # every key of this library has a SQL oracle


def test_queries_ignore_the_callers_time_zone(spark, con):
    key = "spark.sql.session.timeZone"
    spark.conf.set(key, "America/New_York")
    try:
        for name in ("daily_by_group", "utc_january", "hourly_all_areas", "series_arrays", "axis_dates"):
            r = compare(spark, name, SF_SMALL, con)
            assert r["exact"], r
        assert spark.conf.get(key) == "America/New_York"
    finally:
        spark.conf.set(key, "UTC")


def test_queries_built_from_threads_keep_utc(spark, con):
    from concurrent.futures import ThreadPoolExecutor
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        names = ["daily_by_group", "utc_january", "lenient_time", "axis_dates"] * 2
        with ThreadPoolExecutor(4) as pool:
            frames = list(pool.map(lambda n: (n, QUERIES[n](spark, SF_SMALL)), names))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    from wattline.plans.parity import _rows
    for n, df in frames:
        assert _rows(df.toPandas(), None) == _rows(con.sql(ORACLE[n]).df(), None), n


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_result_column_names_are_unique(spark, name):
    cols = QUERIES[name](spark, SF_SMALL).columns
    assert len(cols) == len(set(cols)), cols
