"""Filters and columns reach the files; hot keys are split."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from frostline.functions.settings import Settings
from frostline import constants as C
from frostline.plans import discover
from frostline.reports import events as event_reports
from frostline.reports import reconcile
from frostline.sources.catalog import read_catalog, scan_catalog
from frostline.workload import fixtures

AS_OF = fixtures.AS_OF
SF_DIR = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """The derived tables as files, as they are in real use."""
    root = tmp_path_factory.mktemp("stored")

    def table(name):
        folder = root / name
        if not folder.exists():
            fixtures.table(spark, SF_DIR, name).write.parquet(str(folder))
        return spark.read.parquet(str(folder))

    table.root = root
    return table


def test_catalog_scan_is_pushed_down_and_pruned(spark, stored):
    stored("catalog_snapshot")
    scan = scan_catalog(read_catalog(spark, f"{stored.root}/catalog_snapshot"), AS_OF, 60).select("handle", "size")
    plan = plan_of(scan)
    assert "EqualTo(element_type,FILE)" in plan and "LessThan(atime," in plan
    assert "ReadSchema: struct<handle:string,size:bigint,atime:timestamp_ntz,element_type:string>" in plan


def test_source_paths_reach_the_scan(spark, stored):
    settings = Settings(C.DEFAULT_CONFIG | {"source_paths": "/tenant/src1"})
    plan = plan_of(discover.cold_files(stored("catalog_snapshot"), settings, AS_OF))
    assert "StringStartsWith(parent_path,/tenant/src1/)" in plan


def test_reports_read_only_their_columns(stored):
    plan = plan_of(event_reports.by_type(stored("lifecycle_events")))
    assert "ReadSchema: struct<event_type:string,event_timestamp:timestamp_ntz>" in plan
    plan = plan_of(event_reports.failure_count_recent(stored("lifecycle_events"), AS_OF))
    assert "GreaterThan(event_timestamp,2024-01-30T00:00)" in plan


def test_audit_scan_is_pushed_down(spark, stored):
    from frostline.reports import audit
    from frostline.sources.audit import read_audit

    stored("audit_table")
    log = read_audit(spark, f"{stored.root}/audit_table")
    plan = plan_of(audit.audit_for_path(log, "/tenant/src1/%", AS_OF, operations=("GetObject",)))
    assert "GreaterThanOrEqual(timestamp,2024-01-31T00:00)" in plan
    assert "StringStartsWith(object_path,/tenant/src1/)" in plan and "EqualTo(operation,GetObject)" in plan


def test_one_registry_join_serves_discovery(stored):
    settings = Settings(C.DEFAULT_CONFIG | {"source_paths": ""})
    chosen = discover.candidates(stored("catalog_snapshot"), stored("asset_registry"), settings, AS_OF, "run", 500)
    plan = plan_of(chosen)
    assert plan.count("FileScan") == 2 and "TakeOrderedAndProject" in plan


def test_windows_are_split_by_time_also_after_a_shuffle_by_key(spark, stored):
    """Rows already partitioned by the key alone must still be spread over slices."""
    events = stored("lifecycle_events").repartition("element_handle")
    plan = plan_of(reconcile.state_replay(events))
    assert "hashpartitioning(element_handle" in plan
    windows = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "_slice" in line]
    assert any("REPARTITION_BY_COL" in line for line in windows)


def test_digests_not_bodies_are_shuffled(spark):
    tables = [fixtures.table(spark, SF_DIR, n) for n in ("source_objects", "dest_objects")]
    from frostline.sources.objects import body_digests

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = reconcile.checksum_verify(*map(body_digests, tables))
        lines = plan_of(joined).splitlines()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    first_exchange = [i for i, line in enumerate(lines) if "Exchange" in line][0]
    assert any("md5(" in line for line in lines[first_exchange:])


def test_shared_folder_must_be_named_on_a_cluster(monkeypatch):
    from frostline.sources import shared

    class Conf(dict):
        def get(self, key, default=None):
            return dict.get(self, key, default)

    class Session:
        conf = Conf({"spark.master": "yarn"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(Session())
    Session.conf["spark.checkpoint.dir"] = "hdfs://shared/folder/"
    assert shared.shared_dir(Session()) == "hdfs://shared/folder"


def test_repeated_builds_give_the_same_ids(stored):
    settings = Settings(C.DEFAULT_CONFIG | {"source_paths": ""})

    def ids():
        chosen = discover.candidates(stored("catalog_snapshot"), stored("asset_registry"), settings, AS_OF, "run")
        made = discover.discover_events(chosen, settings, AS_OF, "run")
        return sorted(r[0] for r in made.select("event_id").collect())

    first = ids()
    assert first == ids() and len(set(first)) == len(first)
    assert fixtures.AS_OF == datetime(2024, 1, 31) and F is not None


def test_versions_are_reduced_before_the_shuffle(stored):
    from frostline.operators import latest

    lines = plan_of(latest.current_registry(stored("asset_registry"))).splitlines()
    exchange = next(i for i, line in enumerate(lines) if "Exchange hashpartitioning(element_handle" in line)
    assert any("WindowGroupLimit" in line and "Partial" in line for line in lines[exchange:])


def scans(spark, job, folder):
    """How often a job reads each row of a folder."""
    reads = spark.sparkContext.accumulator(0)
    rows = spark.read.parquet(folder)

    def counted(batches):
        for batch in batches:
            reads.add(len(batch))
            yield batch

    job(rows.mapInPandas(counted, rows.schema)).collect()
    return reads.value / rows.count()


def test_inputs_of_running_values_are_read_once(spark, stored):
    """Events for the replay; events and the audit log for the witnesses."""
    for name in ("lifecycle_events", "audit_table"):
        stored(name)
    events, audit = f"{stored.root}/lifecycle_events", f"{stored.root}/audit_table"
    assert scans(spark, reconcile.state_replay, events) == 1

    def witnessed(events_read=None, audit_read=None):
        return reconcile.audit_corroborate(
            events_read or stored("lifecycle_events"), audit_read or stored("audit_table"), C.COPY_COMPLETED,
            ("GetObject",), "1 HOUR",
        )

    assert scans(spark, lambda rows: witnessed(events_read=rows), events) == 1
    assert scans(spark, lambda rows: witnessed(audit_read=rows), audit) == 1
