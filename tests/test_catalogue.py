import duckdb
import pytest

import __spark_entry__ as driver
from siftstone.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in ("part", "events", "documents", "pages"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", ["detect_language", "skip_paths", "package_name", "import_merge", "unknown_packages", "nearest_package", "phantom_members", "unsafe_scan", "line_filters", "exit_code", "custom_rule"])
def test_query_equals_its_sql(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = con.execute(catalogue.ORACLE_SQL[name])
    names = [x[0] for x in want.description]
    assert sorted(names) == columns
    key = lambda r: repr(tuple(round(v, 9) if isinstance(v, float) else v for v in r))
    assert sorted(key(r[c] for c in columns) for r in df.collect()) == sorted(key(dict(zip(names, r))[c] for c in columns) for r in want.fetchall())


def test_entry_has_findings(spark):
    assert driver.entry(spark).limit(5).count() == 5


def test_every_query_with_sql_is_registered():
    assert set(catalogue.ORACLE_SQL) <= set(catalogue.QUERIES) <= set(driver.queries())
