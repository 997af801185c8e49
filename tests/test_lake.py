"""The owned tables: creation, batches, versions, compaction, configuration."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from frostline import constants as C
from frostline import schemas
from frostline.functions import times
from frostline.functions.settings import load_settings
from frostline.plans import config
from frostline.plans import registry as changes
from frostline.sources import lake as tables

T0 = datetime(2024, 1, 1, 2)


def assets(spark, *rows):
    """Registry rows from (handle, location, change time, md5)."""
    types = {f.name: f.dataType for f in schemas.ASSET_REGISTRY.fields}
    data = []
    for handle, location, changed, md5 in rows:
        row = dict.fromkeys(types)
        row |= {
            "element_handle": handle, "registration_id": f"reg-{handle}", "original_path": f"/t/b/{handle}",
            "original_bucket": "b", "current_location": location, "last_state_change": changed, "source_md5": md5,
        }
        data.append(tuple(row.values()))
    return spark.createDataFrame(data, schemas.ASSET_REGISTRY)


def locations(df):
    return {r.element_handle: r.current_location for r in df.collect()}


def test_schemas_have_the_contract_columns():
    assert len(schemas.ASSET_REGISTRY) == 22
    assert len(schemas.LIFECYCLE_EVENTS) == 19
    assert len(schemas.OFFLOAD_CONFIG) == 5
    assert len(schemas.CONFIG_CHANGE_LOG) == 7
    assert len(C.EVENT_TYPES) == len(set(C.EVENT_TYPES)) == 13


def test_ensure_tables_is_idempotent(lake):
    before = {r.table_name for r in lake.list_tables().collect()}
    lake.ensure_tables()
    assert {r.table_name for r in lake.list_tables().collect()} == before
    assert {tables.REGISTRY, tables.EVENTS, tables.CONFIG, tables.CHANGE_LOG} <= before
    for name, schema in ((tables.REGISTRY, schemas.ASSET_REGISTRY), (tables.EVENTS, schemas.LIFECYCLE_EVENTS)):
        stored = lake.table(name).schema
        assert [(f.name, f.dataType) for f in stored.fields[: len(schema)]] == [
            (f.name, f.dataType) for f in schema.fields
        ]


def test_a_batch_replaces_itself_and_nothing_else(spark, lake):
    lake.write_batch(tables.REGISTRY, assets(spark, ("a", "LOCAL", T0, None)), "r1", "discover")
    lake.write_batch(tables.REGISTRY, assets(spark, ("b", "LOCAL", T0, None)), "r2", "discover")
    lake.write_batch(tables.REGISTRY, assets(spark, ("c", "LOCAL", T0, None)), "r2", "discover")
    assert locations(lake.registry()) == {"a": "LOCAL", "c": "LOCAL"}
    assert lake.batch(tables.REGISTRY, "r2", "discover").count() == 1


def test_a_batch_that_comes_out_empty_replaces_itself_too(spark, lake):
    rows = assets(spark, ("a", "LOCAL", T0, None))
    lake.write_batch(tables.REGISTRY, rows, "r1", "discover")
    lake.write_batch(tables.REGISTRY, rows, "r2", "discover")
    lake.write_batch(tables.REGISTRY, rows.limit(0), "r1", "discover")
    assert [r.batch_run for r in lake.table(tables.REGISTRY).collect()] == ["r2"]
    event = dict.fromkeys(schemas.LIFECYCLE_EVENTS.names)
    days = [tuple((event | {"event_id": str(i), "event_timestamp": T0 + timedelta(days=i)}).values()) for i in (0, 1)]
    events = spark.createDataFrame(days, schemas.LIFECYCLE_EVENTS)
    lake.write_batch(tables.EVENTS, events, "r1", "discover")
    lake.write_batch(tables.EVENTS, events.limit(0), "r1", "discover")
    assert lake.table(tables.EVENTS).count() == 0


def events_on(spark, *days):
    event = dict.fromkeys(schemas.LIFECYCLE_EVENTS.names)
    rows = [tuple((event | {"event_id": str(i), "event_timestamp": day}).values()) for i, day in enumerate(days)]
    return spark.createDataFrame(rows, schemas.LIFECYCLE_EVENTS)


@pytest.mark.parametrize("run", ["r1", "manual:2024-01-01T02:00", "it's 100% a\\b=c"])
def test_a_rerun_leaves_no_earlier_date_and_no_odd_run_behind(spark, lake, run):
    lake.write_batch(tables.EVENTS, events_on(spark, T0), "other", "discover")
    lake.write_batch(tables.EVENTS, events_on(spark, T0, T0 + timedelta(days=1), None), run, "discover")
    lake.write_batch(tables.EVENTS, events_on(spark, T0 + timedelta(days=1), T0 + timedelta(days=2)), run, "discover")
    kept = lake.batch(tables.EVENTS, run, "discover")
    assert {r.event_timestamp for r in kept.collect()} == {T0 + timedelta(days=1), T0 + timedelta(days=2)}
    lake.write_batch(tables.EVENTS, events_on(spark, T0).limit(0), run, "discover")
    assert kept.sparkSession.table(f"{lake.database}.{tables.EVENTS}").count() == 1


def test_a_rerun_computes_its_rows_once(spark, lake):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    rows = events_on(spark, T0)
    lake.write_batch(tables.EVENTS, rows, "r1", "discover")
    lake.write_batch(tables.EVENTS, rows.mapInPandas(counted, rows.schema), "r1", "discover")
    assert seen.value == 1


def test_elements_without_a_handle_stay_apart(spark, lake):
    rows = assets(spark, ("a", "LOCAL", T0, None), ("b", "LOCAL", T0, None)).withColumn("element_handle", F.lit(None).cast("string"))
    lake.write_batch(tables.REGISTRY, rows, "r1", "discover")
    assert lake.registry().count() == 2


def test_versions_and_views(spark, lake):
    lake.write_batch(tables.REGISTRY, assets(spark, ("a", "LOCAL", T0, None), ("b", "LOCAL", T0, None)), "r1", "discover")
    later = T0 + timedelta(days=1)
    update = spark.createDataFrame(
        [("a", "BOTH", "bucket", None), ("ghost", "BOTH", "bucket", None)],
        "element_handle string, current_location string, current_aws_bucket string, source_md5 string",
    )
    new = changes.update_state(lake.registry(), update, times.ntz(later))
    assert [r.element_handle for r in changes.unknown_handles(lake.registry(), update).collect()] == ["ghost"]
    lake.write_batch(tables.REGISTRY, new, "r1", "offload")
    assert locations(lake.registry()) == {"a": "BOTH", "b": "LOCAL"}
    row = lake.registry().where("element_handle = 'a'").first()
    assert (row.current_aws_bucket, row.source_md5, row.last_state_change) == ("bucket", None, later)
    assert row.original_path == "/t/b/a"
    assert locations(lake.registry("r1", ("offload",))) == {"a": "LOCAL", "b": "LOCAL"}
    assert lake.table(tables.REGISTRY).count() == 3


def test_null_does_not_overwrite(spark):
    current = assets(spark, ("a", "BOTH", T0, "md5"))
    update = spark.createDataFrame(
        [("a", "LOCAL_DELETED", None)], "element_handle string, current_location string, source_md5 string"
    )
    row = changes.update_state(current, update, times.ntz(T0)).first()
    assert (row.current_location, row.source_md5) == ("LOCAL_DELETED", "md5")


def test_retry_forgets_assets_with_a_mismatch(spark, lake):
    lake.write_batch(tables.REGISTRY, assets(spark, ("a", "LOCAL", T0, None), ("b", "LOCAL", T0, None)), "r1", "discover")
    events = spark.createDataFrame(
        [("a", C.CHECKSUM_MISMATCH), ("a", C.CHECKSUM_MISMATCH), ("b", C.COPY_FAILED)],
        "element_handle string, event_type string",
    )
    assert locations(changes.retry_reset(lake.registry(), events)) == {"b": "LOCAL"}
    gone = changes.retry_tombstones(lake.registry(), events, times.ntz(T0))
    lake.write_batch(tables.REGISTRY, gone, "r2", "retry")
    assert locations(lake.registry()) == {"b": "LOCAL"}


def test_manual_override(spark):
    current = assets(spark, ("a", "BOTH", T0, "m"), ("b", "BOTH", T0, "m"))
    rows = changes.manual_override(current, "a", times.ntz(T0)).collect()
    assert [(r.element_handle, r.current_location, r.source_md5) for r in rows] == [("a", "UNKNOWN", "m")]


def test_compaction_keeps_the_current_rows(spark, lake):
    lake.write_batch(tables.REGISTRY, assets(spark, ("a", "LOCAL", T0, None), ("b", "LOCAL", T0, None)), "r1", "discover")
    lake.write_batch(tables.REGISTRY, assets(spark, ("a", "BOTH", T0 + timedelta(1), "m")), "r1", "offload")
    before = sorted(map(tuple, lake.registry().collect()))
    lake.compact_registry("c1")
    assert sorted(map(tuple, lake.registry().collect())) == before
    assert lake.table(tables.REGISTRY).count() == 2
    lake.write_batch(tables.REGISTRY, assets(spark, ("b", "BOTH", T0 + timedelta(2), "m")), "r2", "offload")
    lake.compact_registry("c2")
    assert locations(lake.registry()) == {"a": "BOTH", "b": "BOTH"}
    assert lake.table(tables.REGISTRY).select("batch_run").distinct().count() == 1


def test_events_are_pruned_by_date(spark, lake):
    types = {f.name: f.dataType for f in schemas.LIFECYCLE_EVENTS.fields}
    rows = [tuple({**dict.fromkeys(types), "event_id": str(d), "event_timestamp": T0 + timedelta(days=d)}.values())
            for d in range(5)]
    lake.write_batch(tables.EVENTS, spark.createDataFrame(rows, schemas.LIFECYCLE_EVENTS), "r", "discover")
    recent = lake.events(since=T0 + timedelta(days=2))
    assert {r.event_id for r in recent.collect()} == {"3", "4"}
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan
    assert recent.columns == schemas.LIFECYCLE_EVENTS.names
    assert lake.table(tables.EVENTS).agg(F.min("event_date")).first()[0] == date(2024, 1, 1)


def test_seed_update_and_rollback(lake):
    config.seed(lake, T0)
    config.seed(lake, T0 + timedelta(days=1))
    seeded = load_settings(lake.config())
    assert dict(seeded.values) == C.DEFAULT_CONFIG
    assert lake.table(tables.CONFIG).count() == len(C.DEFAULT_CONFIG)

    when = T0 + timedelta(days=2)
    assert config.update(lake, "atime_threshold_days", "90", "admin", "policy", when)
    assert not config.update(lake, "atime_threshold_days", "90", "admin", "again", when + timedelta(hours=1))
    assert load_settings(lake.config()).threshold_days == 90
    log = lake.change_log().collect()
    assert [(r.config_key, r.old_value, r.new_value, r.changed_by, r.changed_at) for r in log] == [
        ("atime_threshold_days", "60", "90", "admin", when)
    ]
    row = lake.config().where("config_key = 'atime_threshold_days'").first()
    assert (row.updated_by, row.updated_at, row.change_reason) == ("admin", when, "policy")
    with pytest.raises(config.UnknownConfigKey):
        config.update(lake, "no_such_key", "1", "admin", "oops", when)

    assert config.rollback(lake, "atime_threshold_days", "admin", when + timedelta(days=1))
    assert load_settings(lake.config()).threshold_days == 60
    assert lake.change_log().count() == 2


def test_seeding_a_partly_filled_table_adds_only_what_is_missing(spark, lake):
    rows = spark.createDataFrame([("batch_size", "7", "x", T0, "y")], schemas.OFFLOAD_CONFIG)
    lake.write_batch(tables.CONFIG, rows, "manual", "config")
    config.seed(lake, T0 + timedelta(days=1))
    values = dict(load_settings(lake.config()).values)
    assert values == C.DEFAULT_CONFIG | {"batch_size": "7"}
    assert lake.table(tables.CONFIG).count() == len(C.DEFAULT_CONFIG)


def test_events_of_a_run_read_its_partitions_only(spark, lake):
    for run in ("r1", "r2"):
        rows = spark.range(500).select(
            *[F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.LIFECYCLE_EVENTS
              if f.name not in ("element_handle", "event_timestamp", "pipeline_run_id")],
            F.concat(F.lit("h"), F.lpad((F.col("id") * 7 % 500).cast("string"), 3, "0")).alias("element_handle"),
            F.lit(T0 if run == "r1" else T0 + timedelta(days=1)).cast("timestamp_ntz").alias("event_timestamp"),
            F.lit(run).alias("pipeline_run_id"),
        )
        lake.write_batch(tables.EVENTS, rows.repartition(2), run, "discover")
    found = lake.events(run="r2")
    assert {r.pipeline_run_id for r in found.select("pipeline_run_id").distinct().collect()} == {"r2"}
    assert found.count() == 500
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(batch_run" in plan
    # Inside a file, elements are in order.
    file = found.select(F.input_file_name().alias("f")).first().f
    handles = [r.element_handle for r in spark.read.parquet(file).select("element_handle").coalesce(1).collect()]
    assert len(handles) > 50 and handles == sorted(handles)


def test_of_two_snapshots_each_file_comes_once(spark, tmp_path):
    from frostline.sources import catalog

    folder = str(tmp_path / "catalog")

    def row(handle, name, atime=T0, parent="/t/a"):
        return (handle, parent, name, None, 1, atime, T0, T0, None, None, "FILE", None)

    first = [row("1", "same"), row("2", "read"), row("3", "gone"), row("4", "moved"), row(None, "nameless"), row(None, "other")]
    then = [row("1", "same"), row("2", "read", T0 + timedelta(1)), row("4", "moved", parent="/t/b"), row("5", "new"),
            row(None, "nameless"), row(None, "fresh")]
    early = catalog.write_snapshot(spark.createDataFrame(first, schemas.CATALOG), folder, T0)
    late = catalog.write_snapshot(spark.createDataFrame(then, schemas.CATALOG), folder, T0 + timedelta(hours=1))
    broken = tmp_path / "catalog" / "snapshot_ts=20990101T000000.000000"
    spark.createDataFrame(first, schemas.CATALOG).write.parquet(str(broken))
    (broken / "_SUCCESS").unlink()  # it died before its end
    assert catalog.snapshots(spark, folder) == [early, late]
    assert sorted(r.name for r in catalog.read_catalog(spark, folder).collect()) == sorted(r[2] for r in then)
    assert catalog.read_catalog(spark, folder, early).count() == 6
    with pytest.raises(ValueError):
        catalog.read_catalog(spark, folder, "never")
    got = catalog.snapshot_changes(catalog.read_catalog(spark, folder, early), catalog.read_catalog(spark, folder))
    assert {(r.handle, r.path, r.change, r.moved) for r in got.collect()} == {
        ("2", "/t/a/read", "CHANGED", False), ("3", "/t/a/gone", "REMOVED", False), ("4", "/t/b/moved", "CHANGED", True),
        ("5", "/t/a/new", "ADDED", False), (None, "/t/a/other", "REMOVED", False), (None, "/t/a/fresh", "ADDED", False),
    }


def rows_read(df):
    """Rows that the scan of a plan gave out, after row groups were passed over."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metrics().apply("numOutputRows").value()


@pytest.mark.parametrize("order", ["element_handle", "source_path"])
def test_an_absent_path_is_told_by_the_bloom_filter(spark, lake, order):
    """Paths are too many for a dictionary, and the absent one lies between them: ranges and dictionaries can't tell."""
    from frostline.reports import events as reports

    writer = tables.Lake(spark, lake.database, order={tables.EVENTS: order})
    rows = spark.range(60_000).select(
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.LIFECYCLE_EVENTS
          if f.name not in ("element_handle", "source_path", "event_timestamp")],
        F.col("id").cast("string").alias("element_handle"), F.lit(T0).cast("timestamp_ntz").alias("event_timestamp"),
        F.concat(F.lit("/tenant/"), F.sha2(F.col("id").cast("string"), 256)).alias("source_path"),
    )
    writer.write_batch(tables.EVENTS, rows.coalesce(1), "r", "discover")
    there = rows.where("id = 777").first().source_path
    found = lake.events().where(F.col("source_path") == there).select("element_handle")
    assert [r.element_handle for r in found.collect()] == ["777"] and rows_read(found) > 0
    absent = there[:-1] + ("0" if there[-1] != "0" else "1")
    assert rows_read(lake.events().where(F.col("source_path") == absent).select("element_handle")) == 0
    assert reports.lifecycle_by_source_path(lake.events(), there).count() == 1
    assert reports.lifecycle_by_source_path(lake.events(), absent).count() == 0
    spark.conf.set("spark.sql.parquet.filterPushdown", "false")
    try:
        assert rows_read(lake.events().where(F.col("source_path") == absent).select("element_handle")) == 60_000
    finally:
        spark.conf.unset("spark.sql.parquet.filterPushdown")


def test_contained_texts_are_found_by_postings(spark, lake):
    from frostline.reports import registry as reports

    indexed = tables.Lake(spark, lake.database, path_index=True)

    def batch(numbers, run, **changed):
        rows = spark.createDataFrame([(i,) for i in numbers], "i long").select(
            *[F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.ASSET_REGISTRY
              if f.name not in ("element_handle", "registration_id", "original_path", "current_location", "last_state_change")],
            F.format_string("h%06d", "i").alias("element_handle"), F.format_string("r%d", "i").alias("registration_id"),
            F.concat(F.lit("/tenant/ü_"), F.md5(F.col("i").cast("string"))).alias("original_path"),
            F.lit(changed.get("location", "LOCAL")).alias("current_location"),
            F.lit(changed.get("at", T0)).cast("timestamp_ntz").alias("last_state_change"),
        )
        indexed.write_batch(tables.REGISTRY, rows.repartitionByRange(8, "element_handle"), run, "discover")

    batch(range(4000), "r1")
    batch(range(100), "r2", location="BOTH", at=T0 + timedelta(days=1))
    path = next(r.original_path for r in indexed.registry().where("element_handle = 'h000042'").collect())
    for pattern in (path, f"*{path[10:20]}*", "ü_a", "/ten", "ab", "", "nowhere", "ü_0%"):
        for few in (1000, 0):
            got = sorted(map(tuple, reports.locate_indexed(indexed, pattern, few).collect()), key=str)
            assert got == sorted(map(tuple, reports.locate_contains(indexed.registry(), pattern).collect()), key=str), (pattern, few)
    narrow, wide = reports.locate_indexed(indexed, path[10:24]), reports.locate_contains(indexed.registry(), path[10:24])
    assert narrow.collect() == wide.collect() and len(narrow.collect()) == 1

    def rows_of_registry(df):
        """Rows that the scan of the registry gives out: row groups without the elements are passed over."""
        plan = df._jdf.queryExecution().executedPlan()
        df.collect()
        leaf = plan.finalPhysicalPlan() if "AdaptiveSparkPlan" in plan.nodeName() else plan
        leaves = leaf.collectLeaves()
        while "QueryStage" in leaves.apply(0).nodeName():
            leaves = leaves.apply(0).plan().collectLeaves()
        return leaves.apply(0).metrics().apply("numOutputRows").value()

    assert rows_of_registry(narrow) < rows_of_registry(wide) / 4
    indexed.compact_registry("c")
    assert reports.locate_indexed(indexed, path[10:24]).collect() == wide.collect()
    assert {r.batch_stage for r in indexed.table(tables.PATH_GRAMS).select("batch_stage").distinct().collect()} == {tables.COMPACTION}


def test_postings_of_one_reader_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(tables, "POSTINGS", 2000)
    rows = spark.range(0, 400, 1, 1).select(
        F.when(F.col("id") % 50 > 0, F.format_string("h%d", F.col("id") % 200)).alias("element_handle"),
        F.when(F.col("id") % 7 > 0, F.format_string("r%d", F.col("id") % 200)).alias("registration_id"),
        F.when(F.col("id") % 9 > 0, F.concat(F.lit("/tenant/"), F.col("id") % 300, F.lit("/"), F.col("id") % 300)).alias("original_path"),
    )
    rows = rows.unionByName(rows.limit(3)).unionByName(spark.createDataFrame([("h", "r", "ab"), ("h", "r", "")], rows.schema)).coalesce(1)
    wanted = {(path[at : at + 3], of, as_) for of, as_, path in rows.collect() if path for at in range(len(path) - 2)}
    grams = tables.path_grams(rows)
    of_task = [list(map(tuple, part)) for part in grams.rdd.glom().collect()]
    assert sorted(sum(of_task, []), key=str) == sorted(wanted, key=str)
    assert len(of_task) > 2 and max(map(len, of_task)) < 4000  # before: as many as shuffles have parts
    order = [set(p) for p in of_task if p]
    assert all(max(r[0] for r in a) <= min(r[0] for r in b) for a, b in zip(order, order[1:], strict=False))
    # No aggregate in the stage that reads the paths: below the first exchange there is only the scan.
    plan = grams._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("HashAggregate") and "HashAggregate" not in plan.rpartition("Exchange")[2]
    assert tables.path_grams(rows.limit(0)).count() == 0


def test_bucketed_registry_needs_no_exchange(spark, tmp_path):
    from uuid import uuid4

    lake = tables.Lake(spark, f"test_{uuid4().hex}", buckets=4)
    lake.ensure_tables(str(tmp_path / "bucketed"))
    lake.write_batch(tables.REGISTRY, assets(spark, *[(f"e{i}", "LOCAL", T0, None) for i in range(50)]), "r1", "discover")
    lake.write_batch(tables.REGISTRY, assets(spark, ("e7", "BOTH", T0 + timedelta(1), "m")), "r2", "offload")
    update = spark.createDataFrame([("e7", "LOCAL_DELETED"), ("e8", "BOTH")], "element_handle string, current_location string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        latest = lake.registry()
        assert "Exchange" not in latest._jdf.queryExecution().executedPlan().toString()
        updated = changes.update_state(latest, update, times.ntz(T0 + timedelta(2)))
        plan = updated._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Bucketed: true" in plan  # that of the changes
        assert locations(updated) == {"e7": "LOCAL_DELETED", "e8": "BOTH"}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert locations(lake.registry())["e7"] == "BOTH" and lake.registry().count() == 50
    lake.compact_registry("c")
    assert locations(lake.registry())["e7"] == "BOTH" and lake.table(tables.REGISTRY).count() == 50
