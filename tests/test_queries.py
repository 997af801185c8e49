"""Every registered query against its SQL counterpart, and what its plan may contain."""

import duckdb
import pytest

import __spark_entry__ as entry
import check
from frostline.workload import registered

SF_DIR = "/root/testdata/sf0.001"
QUERIES = {name: entry.queries()[name] for name in registered.QUERIES}
ORACLES = {name: entry.oracle_sql()[name] for name in registered.ORACLES}
# These run Python on bodies and files; everything else stays in the JVM.
BYTES = {"copy_objects", "object_checksums_streamed", "probe_objects"}


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for name in check.TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def test_every_query_has_a_counterpart():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", QUERIES)
def test_same_rows_as_sql(spark, con, name):
    frame = QUERIES[name](spark, SF_DIR)
    result = con.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(frame.columns) == sorted(columns)
    assert check.rows_of(frame.columns, frame.collect()) == check.rows_of(columns, result.fetchall())
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    if name not in BYTES:
        assert "Python" not in plan and "MapInPandas" not in plan and "MapInArrow" not in plan


def test_entry_has_rows(spark):
    frame = entry.entry(spark)
    assert frame.columns == ["handle", "path", "size", "atime", "age_days", "reg_id"]
    assert frame.count() > 0
