"""Whole runs over real files in a local folder."""

import hashlib
from datetime import datetime, timedelta

import pytest

from frostline import constants as C
from frostline import schemas
from frostline.functions.settings import Settings
from frostline.plans import config, discover, offload, purge, run
from frostline.reports import reconcile
from frostline.sources import lake as tables
from frostline.sources import objects
from frostline.sources.lake import Lake

NOW = datetime(2024, 5, 1, 2)


def write(path, body):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(body)


@pytest.fixture
def world(spark, lake, tmp_path):
    """A catalog with cold and warm files, and the objects of the cold ones."""
    rows = []
    for i in range(12):
        age = 100 + i if i < 9 else 10
        kind = "DIR" if i == 8 else "FILE"
        folder = "/tenant/projects" if i != 7 else "/tenant/projects2"
        rows.append((f"0x{i}", folder, f"f{i}.bin", None if i == 0 else "bin", 100 + i, NOW - timedelta(days=age),
                     NOW, NOW, None if i == 1 else "login", None if i == 2 else 420, kind, None))
    catalog = spark.createDataFrame(rows, schemas.CATALOG)
    source, dest = tmp_path / "source", tmp_path / "dest"
    for i in range(7):
        if i != 3:  # gone between discovery and copy
            write(source / "projects" / "tenant" / "projects" / f"f{i}.bin", f"body {i}".encode() * 1000)
    dest.mkdir()
    config.seed(lake, NOW - timedelta(days=300))
    config.update(lake, "source_paths", "/tenant/projects/, /tenant/media", "admin", "set up", NOW - timedelta(days=200))
    config.update(lake, "dry_run", "false", "admin", "go live", NOW - timedelta(days=200))
    return lake, catalog, str(source), str(dest)


def events_of(lake, run_id):
    rows = lake.events().where(f"pipeline_run_id = '{run_id}'").orderBy("event_timestamp", "element_handle").collect()
    return [(r.element_handle, r.event_type, r.success) for r in rows]


def snapshot(lake):
    everything = [lake.events(), lake.registry(), lake.table(tables.CANDIDATES)]
    return [sorted(map(str, df.collect())) for df in everything]


def test_run_copies_and_records(world):
    lake, catalog, source, dest = world
    run_id = run.run_all(lake, catalog, NOW, source, dest)
    assert run_id == "schedule-20240501-020000"
    by_file = {}
    for handle, kind, success in events_of(lake, run_id):
        by_file.setdefault(handle, []).append((kind, success))
    found = [f"0x{i}" for i in range(7)]
    assert sorted(by_file) == found
    copied = [
        (C.REGISTERED, True), (C.THRESHOLD_EVALUATED, True), (C.COPY_STARTED, None),
        (C.CHECKSUM_VERIFIED, True), (C.COPY_COMPLETED, True),
    ]
    assert by_file["0x0"] == copied
    assert by_file["0x3"] == copied[:3] + [(C.COPY_FAILED, False)]

    registry = {r.element_handle: r for r in lake.registry().collect()}
    assert sorted(registry) == found
    md5 = hashlib.md5(b"body 0" * 1000).hexdigest()
    row = registry["0x0"]
    assert (row.current_location, row.source_md5, row.destination_md5) == (C.BOTH, md5, md5)
    assert (row.current_aws_bucket, row.current_aws_key) == ("corp-cold-tier", "tenant/projects/f0.bin")
    assert (row.original_bucket, row.file_extension) == ("projects", "")
    assert registry["0x1"].owner_login == C.NO_LOGIN and registry["0x2"].nfs_mode_bits == 0
    assert registry["0x3"].current_location == C.LOCAL
    with open(f"{dest}/corp-cold-tier/tenant/projects/f0.bin", "rb") as copy:
        assert copy.read() == b"body 0" * 1000
    metadata = lake.table(tables.COPIES).where("handle = '0x0'").first().metadata
    assert metadata["source-source-md5"] == md5 and metadata["source-element-handle"] == "0x0"
    assert metadata["source-registration-id"] == row.registration_id
    assert reconcile.state_replay(lake.events()).where("NOT legal").count() == 0
    assert reconcile.registry_vs_replay(lake.registry(), lake.events()).where("NOT agrees").count() == 0
    assert reconcile.orphan_events(lake.events(), lake.registry()).count() == 0


def test_running_again_changes_nothing(world):
    lake, catalog, source, dest = world
    config.update(lake, "auto_delete_local", "true", "admin", "purge", NOW - timedelta(days=100))
    run.run_all(lake, catalog, NOW, source, dest)
    first = snapshot(lake)
    run.run_all(lake, catalog, NOW, source, dest)
    assert snapshot(lake) == first


@pytest.mark.parametrize(
    "table, stage", [(tables.EVENTS, "discover"), (tables.REGISTRY, "offload"), (tables.REGISTRY, "purge")]
)
def test_a_run_that_broke_off_is_completed_by_running_it_again(world, monkeypatch, table, stage):
    """Whatever was written before the failure, the second attempt ends like an undisturbed run."""
    lake, catalog, source, dest = world
    config.update(lake, "auto_delete_local", "true", "admin", "purge", NOW - timedelta(days=100))
    write_batch = Lake.write_batch
    broken = []

    def failing(self, name, rows, run_id, at):
        if (name, at) == (table, stage) and not broken:
            broken.append(name)
            raise OSError("executor lost")
        return write_batch(self, name, rows, run_id, at)

    monkeypatch.setattr(Lake, "write_batch", failing)
    try:
        run.run_all(lake, catalog, NOW, source, dest)
    except OSError:
        run.run_all(lake, catalog, NOW, source, dest)
    once = Lake(lake.spark, f"{lake.database}_once")
    once.ensure_tables(f"{source}/../once")
    once.write_batch(tables.CONFIG, lake.config(), "copy", "config")
    run.run_all(once, catalog, NOW, source, dest)
    assert snapshot(lake) == snapshot(once)


def test_next_run_retries_under_the_same_registration(world, tmp_path):
    lake, catalog, source, dest = world
    run.run_all(lake, catalog, NOW, source, dest)
    before = {r.element_handle: r.registration_id for r in lake.registry().collect()}
    write(tmp_path / "source/projects/tenant/projects/f3.bin", b"back")
    second = run.run_all(lake, catalog, NOW + timedelta(days=1), source, dest)
    assert [e[1] for e in events_of(lake, second)] == [
        C.THRESHOLD_EVALUATED, C.COPY_STARTED, C.CHECKSUM_VERIFIED, C.COPY_COMPLETED
    ]
    after = {r.element_handle: r for r in lake.registry().collect()}
    assert {h: r.registration_id for h, r in after.items()} == before
    assert after["0x3"].current_location == C.BOTH


def test_purge_needs_the_copy(world, tmp_path):
    lake, catalog, source, dest = world
    run.run_all(lake, catalog, NOW, source, dest)
    (tmp_path / "dest/corp-cold-tier/tenant/projects/f1.bin").unlink()
    config.update(lake, "auto_delete_local", "true", "admin", "purge", NOW + timedelta(hours=1))
    second = run.run_all(lake, catalog, NOW + timedelta(days=1), source, dest)
    purge_events = [e for e in events_of(lake, second) if "DELETE" in e[1]]
    assert ("0x1", C.LOCAL_DELETE_FAILED, False) in purge_events
    assert ("0x1", C.LOCAL_DELETE_REQUESTED, None) not in purge_events
    assert ("0x0", C.LOCAL_DELETE_REQUESTED, None) in purge_events and ("0x0", C.LOCAL_DELETED, True) in purge_events
    states = {r.element_handle: r.current_location for r in lake.registry().collect()}
    assert states["0x0"] == C.LOCAL_DELETED and states["0x1"] == C.BOTH
    failed = lake.events().where("event_type = 'LOCAL_DELETE_FAILED'").first()
    assert failed.error_message == (
        "AWS copy not found at s3://corp-cold-tier/tenant/projects/f1.bin, aborting local delete for safety"
    )


def test_dry_run_only_scans(world):
    lake, catalog, source, dest = world
    config.update(lake, "dry_run", "true", "admin", "look", NOW - timedelta(days=1))
    config.update(lake, "batch_size", "2", "admin", "look", NOW - timedelta(days=1))
    run_id = run.run_all(lake, catalog, NOW, source, dest)
    rows = lake.events().collect()
    assert {(r.event_type, r.registration_id, r.pipeline_run_id) for r in rows} == {(C.SCANNED, "dry-run", run_id)}
    assert len(rows) == 7
    assert lake.registry().count() == 0 and lake.table(tables.CANDIDATES).count() == 0


def test_batch_takes_the_longest_unused(world):
    lake, catalog, source, dest = world
    config.update(lake, "batch_size", "2", "admin", "small", NOW - timedelta(days=1))
    run.run_all(lake, catalog, NOW, source, dest)
    assert {r.handle for r in lake.table(tables.CANDIDATES).collect()} == {"0x5", "0x6"}


def test_what_a_batch_leaves_is_counted(world):
    lake, catalog, source, dest = world
    config.update(lake, "batch_size", "2", "admin", "small", NOW - timedelta(days=1))
    assert run.left_over(lake, catalog, NOW) == 7
    run.run_all(lake, catalog, NOW, source, dest)
    assert run.left_over(lake, catalog, NOW) == 5
    config.update(lake, "batch_size", "500", "admin", "large", NOW)
    run.run_all(lake, catalog, NOW + timedelta(hours=1), source, dest)
    assert run.left_over(lake, catalog, NOW) == 1  # the one whose source is gone


SETTINGS = Settings(C.DEFAULT_CONFIG | {"auto_delete_local": "true"})


def outcomes(spark, settings, *copies):
    manifest = spark.createDataFrame(
        [(h, f"reg-{h}", f"/t/b/{h}", 5, "b", "", "") for h, *_ in copies], schemas.MANIFEST
    )
    results = [(h, s, d, 5, status, error, None) for h, s, d, status, error in copies if status]
    return offload.with_outcome(manifest, spark.createDataFrame(results, schemas.COPY_RESULTS))


def test_offload_event_fields(spark):
    rows = outcomes(
        spark, SETTINGS, ("a", "x", "x", C.COPIED, None), ("b", "x", "y", C.MISMATCH, None),
        ("c", None, None, C.ERROR, "Network timeout"), ("d", None, None, None, None),
    )
    events = {(r.element_handle, r.event_type): r for r in
              offload.offload_events(rows, SETTINGS, NOW, "run").collect()}
    assert {k[1] for k in events if k[0] == "b"} == {C.COPY_STARTED, C.CHECKSUM_MISMATCH}
    mismatch = events["b", C.CHECKSUM_MISMATCH]
    assert (mismatch.success, mismatch.checksum_value, mismatch.error_message) == (
        False, "src=x dst=y", "Checksum mismatch after copy"
    )
    assert mismatch.destination_path is None and mismatch.file_size_bytes is None
    started, verified, done = (events["a", k] for k in (C.COPY_STARTED, C.CHECKSUM_VERIFIED, C.COPY_COMPLETED))
    assert (started.success, started.destination_path, started.file_size_bytes) == (None, "s3://corp-cold-tier/t/b/a", 5)
    assert (verified.destination_path, verified.file_size_bytes, verified.checksum_value) == (None, None, "x")
    assert (done.destination_path, done.file_size_bytes, done.checksum_value) == ("s3://corp-cold-tier/t/b/a", 5, "x")
    assert started.event_timestamp < verified.event_timestamp < done.event_timestamp
    assert events["c", C.COPY_FAILED].error_message == "Network timeout"
    assert events["d", C.COPY_FAILED].error_message == "no copy result"
    assert all(r.file_atime is None and r.triggered_by == "SCHEDULE" for r in events.values())
    assert len({r.event_id for r in events.values()}) == len(events)


def test_without_verification_the_source_digest_counts_twice(spark):
    quick = Settings(C.DEFAULT_CONFIG | {"verify_checksum": "false"})
    rows = outcomes(spark, quick, ("a", "x", None, C.COPIED, None))
    kinds = [r.event_type for r in offload.offload_events(rows, quick, NOW, "run").collect()]
    assert sorted(kinds) == [C.COPY_COMPLETED, C.COPY_STARTED]
    from test_lake import assets

    current = assets(spark, ("a", C.LOCAL, NOW, None))
    row = offload.registry_updates(current, rows, quick, NOW).first()
    assert (row.source_md5, row.destination_md5, row.current_location) == ("x", "x", C.BOTH)


def test_purge_is_off_by_default(spark):
    from test_lake import assets

    current = assets(spark, ("a", C.BOTH, NOW, "m"))
    probes = spark.createDataFrame([("a", C.FOUND, None)], schemas.PROBE_RESULTS)
    plan = purge.purge_plan(current, probes)
    kept = Settings(C.DEFAULT_CONFIG)
    assert purge.purge_events(plan, kept, NOW, "run").count() == 0
    assert purge.registry_updates(plan, kept, NOW).count() == 0
    assert purge.purge_events(plan, SETTINGS, NOW, "run").count() == 2


def test_files_without_handle_are_never_taken_for_offloaded(spark):
    """An anti join keeps what NOT IN loses as soon as one handle is NULL."""
    from test_lake import assets

    files = spark.createDataFrame([("a",), ("b",), (None,)], "handle string")
    registry = assets(spark, ("a", C.BOTH, NOW, None), (None, C.BOTH, NOW, None))
    kept = {r.handle for r in discover.not_offloaded(files, registry).collect()}
    assert kept == {"b", None}
    files.createOrReplaceTempView("files_seen")
    registry.createOrReplaceTempView("registry_seen")
    lost = spark.sql("SELECT * FROM files_seen WHERE handle NOT IN (SELECT element_handle FROM registry_seen)")
    assert lost.count() == 0


@pytest.mark.parametrize("table, stage", [
    (tables.REGISTRY, "discover"), (tables.EVENTS, "offload"), (tables.REGISTRY, "offload"), (tables.REGISTRY, "purge"),
])
def test_a_run_killed_between_two_writes_is_invisible(world, monkeypatch, table, stage):
    """Readers see the stages before it whole, and nothing of the one that died."""
    lake, catalog, source, dest = world
    config.update(lake, "auto_delete_local", "true", "admin", "purge", NOW - timedelta(days=100))
    write_batch = Lake.write_batch

    def killed(self, name, rows, run_id, at):
        if (name, at) == (table, stage):
            raise OSError("driver lost")
        return write_batch(self, name, rows, run_id, at)

    with monkeypatch.context() as patch:
        patch.setattr(Lake, "write_batch", killed)
        with pytest.raises(OSError):
            run.run_all(lake, catalog, NOW, source, dest)
    reader = Lake(lake.spark, lake.database)  # of another process
    stages = {"discover": [], "offload": ["discover"], "purge": ["discover", "offload"]}[stage]
    for name in (tables.EVENTS, tables.REGISTRY, tables.CANDIDATES, tables.COPIES, tables.PROBES):
        seen = {r.batch_stage for r in reader.table(name).select("batch_stage").distinct().collect()}
        assert seen <= set(stages), name
    assert {r.batch_stage for r in reader.table(tables.EVENTS).collect()} == set(stages)
    states = {r.current_location for r in reader.registry().collect()}
    assert states == {"discover": set(), "offload": {C.LOCAL}, "purge": {C.LOCAL, C.BOTH}}[stage]
    assert reconcile.registry_vs_replay(reader.registry(), reader.events()).where("NOT agrees").count() == 0
    assert lake.spark.table(f"{lake.database}.{tables.CANDIDATES}").count() > 0  # it had written something
    run.run_all(reader, catalog, NOW, source, dest)
    done = {r.current_location for r in reader.registry().collect()}
    assert done == {C.LOCAL, C.LOCAL_DELETED}
    rows = [lake.spark.table(f"{lake.database}.{n}").count() for n in (tables.EVENTS, tables.REGISTRY)]
    assert rows == [reader.table(n).count() for n in (tables.EVENTS, tables.REGISTRY)]  # and no leftovers


def test_earlier_rows_stay_while_a_batch_is_written_again(world):
    lake, catalog, source, dest = world
    run_id = run.run_all(lake, catalog, NOW, source, dest)
    reader, before = Lake(lake.spark, lake.database), snapshot(lake)
    with pytest.raises(OSError), lake.one_batch(run_id, "discover"):
        lake.write_batch(tables.EVENTS, lake.events().limit(1), run_id, "discover")
        assert lake.batch(tables.EVENTS, run_id, "discover").count() == 1  # the writer sees its own rows
        assert snapshot(reader) == before
        raise OSError("driver lost")
    assert snapshot(lake) == snapshot(reader) == before
    reader.drop_leftovers()
    assert snapshot(lake) == before
    assert lake.spark.table(f"{lake.database}.{tables.EVENTS}").count() == lake.events().count()


def test_lineage_survives_the_tables(spark, world):
    lake, catalog, source, dest = world
    run_id = run.run_all(lake, catalog, NOW, source, dest)
    assets = {r.element_handle: r for r in lake.registry().where("current_location = 'BOTH'").collect()}
    objects.publish_lineage(objects.read_lineage(spark, dest), dest, run_id)  # a batch replaces itself
    spark.sql(f"DROP DATABASE {lake.database} CASCADE")
    found = {r.metadata["source-element-handle"]: r for r in objects.read_lineage(spark, f"file:{dest}").collect()}
    assert set(found) == set(assets) == {f"0x{i}" for i in range(7) if i != 3}
    for handle, row in found.items():
        assert (row.aws_bucket, row.aws_key) == (assets[handle].current_aws_bucket, assets[handle].current_aws_key)
        assert row.metadata["source-source-md5"] == assets[handle].source_md5
        assert row.metadata["source-registration-id"] == assets[handle].registration_id


def test_lineage_that_was_not_published_is_not_read(spark, world, monkeypatch):
    _, _, _, dest = world
    assert objects.read_lineage(spark, dest).collect() == []
    rows = spark.createDataFrame([("b", "k", {"source-element-handle": "1"})], "aws_bucket string, aws_key string, metadata map<string,string>")
    objects.publish_lineage(rows, dest, "first")
    rows.write.parquet(f"{dest}/_lineage/rows/attempt=broken")
    assert objects.read_lineage(spark, dest).count() == 1
    objects.publish_lineage(rows, dest, "second")
    assert objects.read_lineage(spark, dest).count() == 2


def test_several_keys_change_together(world):
    lake, *_ = world
    config.update_all(lake, {"batch_size": "9", "dry_run": "false", "verify_checksum": "false"}, "admin", "x", NOW)
    values = {r.config_key: r.config_value for r in lake.config().collect()}
    assert (values["batch_size"], values["verify_checksum"]) == ("9", "false")
    logged = {r.config_key for r in lake.change_log().where("change_reason = 'x'").collect()}
    assert logged == {"batch_size", "verify_checksum"}
    with pytest.raises(config.UnknownConfigKey):
        config.update_all(lake, {"batch_size": "1", "odd": "1"}, "admin", "y", NOW)
    lake.compact_config("c")
    assert {r.config_key: r.config_value for r in lake.config().collect()} == values
    assert lake.table(tables.CONFIG).count() == len(values)
