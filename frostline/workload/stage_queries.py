"""Queries for the three stages, and for the object jobs.

The batch size limits discover_candidates, candidate_manifest and stage_discover, as it limits
a run. The other queries put every cold file through the stages.
"""

from datetime import datetime, timedelta
from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostline import constants as C
from frostline import schemas
from frostline.functions import times
from frostline.functions.settings import Settings
from frostline.operators import latest
from frostline.plans import config, discover, offload, purge, run
from frostline.plans import registry as changes
from frostline.reports import reconcile
from frostline.sources import lake as tables
from frostline.sources import objects
from frostline.sources.lake import Lake
from frostline.sources.shared import scratch_dir, written
from frostline.workload.fixtures import AS_OF, AS_OF_SQL
from frostline.workload.registered import query
from frostline.workload.registry_queries import CATALOG_SQL, COLD_SQL, OFFLOADED_SQL
from frostline.workload.config_queries import UUID_SQL

RUN = times.run_id(AS_OF)
SETTINGS = Settings(
    C.DEFAULT_CONFIG
    | {
        "source_paths": "/tenant/src1, /tenant/src2/y1,/tenant/src3",
        "dry_run": "false",
        "auto_delete_local": "true",
    },
    {"s3_endpoint": "", "cluster_name": "cluster-01"},
)

CAT, REG, COPIES, PROBES = "catalog_snapshot", "asset_registry", "copy_results", "probe_results"


def _id(*parts: str) -> str:
    return UUID_SQL.format(f"md5(concat_ws('|', {', '.join(parts)}))")


def _at(micros: int) -> str:
    return f"TIMESTAMP '2024-01-31 00:00:00.{micros:06d}'"


ROOTS_SQL = " OR ".join(
    f"parent_path = '{root}' OR starts_with(parent_path, '{root}/')"
    for root in ("/tenant/src1", "/tenant/src2/y1", "/tenant/src3")
)
COLD_FILES_SQL = f"SELECT {CATALOG_SQL} FROM catalog_snapshot WHERE {COLD_SQL} AND ({ROOTS_SQL})"
RUN_SQL = f"'{RUN}'"
REGISTRATION_SQL = _id(RUN_SQL, "c.handle", "'registration'")
CANDIDATES_SQL = f"""SELECT c.*, a.registration_id AS known, concat(c.parent_path, '/', c.name) AS path,
 coalesce(a.registration_id, {REGISTRATION_SQL}) AS reg_id,
 string_split(c.parent_path, '/')[3] AS bucket,
 CAST(floor((epoch_us({AS_OF_SQL}) - epoch_us(c.atime)) / 86400000000.0::DOUBLE) AS INT) AS age
 FROM cold_files c LEFT JOIN asset_registry a ON a.element_handle = c.handle
 WHERE a.element_handle IS NULL OR NOT a.{OFFLOADED_SQL}"""
ISO_SQL = """(strftime({0}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us({0}) % 1000000 = 0 THEN ''
 ELSE '.' || strftime({0}, '%f') END)"""

ALL = {"cold_files": COLD_FILES_SQL, "candidates": CANDIDATES_SQL}
BATCH = {"cold_files": COLD_FILES_SQL, "candidates": f"{CANDIDATES_SQL} ORDER BY c.atime, c.handle LIMIT 500"}


def _event_sql(rows: str, kind: str, micros: int, function: str, handle: str, registration: str, path: str,
               where: str = "TRUE", **fields: str) -> str:
    """SELECT of one event type in the columns of the event table."""
    snapshot = SETTINGS.snapshot().replace("'", "''")
    fields |= {
        "event_id": _id(RUN_SQL, handle, f"'{kind}'"),
        "element_handle": handle,
        "registration_id": registration,
        "event_type": f"'{kind}'",
        "event_timestamp": _at(micros),
        "source_path": path,
        "pipeline_run_id": RUN_SQL,
        "function_name": f"'{function}'",
        "triggered_by": "'SCHEDULE'",
        "config_snapshot": f"'{snapshot}'",
    }
    casts = {"bigint": "BIGINT", "string": "VARCHAR", "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN"}
    columns = ", ".join(
        f"CAST({fields.get(f.name, 'NULL')} AS {casts[f.dataType.simpleString()]}) AS {f.name}"
        for f in schemas.LIFECYCLE_EVENTS.fields
    )
    return f"SELECT {columns} FROM {rows} WHERE {where}"


# Discover

def _discover_event(kind, micros, registration="reg_id", where="TRUE", note="NULL", rows="candidates"):
    return _event_sql(rows, kind, micros, "discover", "handle", registration, "path", where, success="TRUE",
                      file_size_bytes="size", file_atime="atime", file_mtime="mtime", error_message=note)


DISCOVER_SQL = " UNION ALL ".join((
    _discover_event("REGISTERED", 0, where="known IS NULL"),
    _discover_event("THRESHOLD_EVALUATED", 1,
                    note=f"'atime=' || {ISO_SQL.format('atime')} || ', threshold=60d, age=' || age || 'd'"),
))


def _candidates(t, batch_size=None):
    return discover.candidates(t.catalog_snapshot, t.asset_registry, SETTINGS, AS_OF, RUN, batch_size)


@query("discover_candidates",
       "SELECT handle, path, size, atime, age AS age_days, reg_id FROM candidates", CAT, REG, extra=BATCH)
def _(t):
    chosen = discover.with_path(_candidates(t, SETTINGS.batch_size))
    age = times.days_since(F.col("atime"), times.ntz(AS_OF))
    return chosen.select(
        "handle", "path", "size", "atime", age.alias("age_days"), F.col("registration_id").alias("reg_id")
    )


MANIFEST_SQL = f"""SELECT handle, reg_id, path, size, bucket, {ISO_SQL.format('atime')} AS atime,
 {ISO_SQL.format('mtime')} AS mtime FROM candidates"""


@query("candidate_manifest", MANIFEST_SQL, CAT, REG, extra=ALL)
def _(t):
    return discover.manifest(_candidates(t))


@query("stage_discover", DISCOVER_SQL, CAT, REG, extra=ALL)
def _(t):
    return discover.discover_events(_candidates(t), SETTINGS, AS_OF, RUN)


@query("discover_events", DISCOVER_SQL, CAT, REG, extra=ALL)
def _(t):
    return discover.discover_events(_candidates(t), SETTINGS, AS_OF, RUN)


REGISTERED_SQL = """SELECT handle AS element_handle, reg_id AS registration_id, path AS original_path,
 bucket AS original_bucket, bucket AS original_view, name AS file_name, extension AS file_extension,
 size AS file_size_bytes, ctime AS file_ctime, mtime AS file_mtime, atime AS file_atime,
 login_name AS owner_uid, login_name AS owner_login, nfs_mode_bits, 'LOCAL' AS current_location,
 CAST(NULL AS VARCHAR) AS current_aws_bucket, CAST(NULL AS VARCHAR) AS current_aws_key,
 CAST(NULL AS VARCHAR) AS current_aws_region, {0} AS registered_at, {0} AS last_state_change,
 CAST(NULL AS VARCHAR) AS source_md5, CAST(NULL AS VARCHAR) AS destination_md5
 FROM candidates WHERE known IS NULL""".format(_at(0))


@query("register_assets", REGISTERED_SQL, CAT, REG, extra=ALL)
def _(t):
    return discover.registrations(_candidates(t), AS_OF)


@query("stage_discover_dry_run",
       _discover_event("SCANNED", 0, registration="'dry-run'",
                       note="'DRY_RUN: age=' || age || 'd, threshold=60d'"),
       CAT, REG, extra=ALL)
def _(t):
    return discover.dry_run_events(t.catalog_snapshot, t.asset_registry, SETTINGS, AS_OF, RUN)


@query("append_events", DISCOVER_SQL, CAT, REG, extra=ALL)
def _(t):
    """The events after a round trip through the event table."""
    lake = _new_lake(t.spark)
    rows = discover.discover_events(_candidates(t), SETTINGS, AS_OF, RUN)
    lake.write_batch(tables.EVENTS, rows, RUN, "discover")
    return lake.batch(tables.EVENTS, RUN, "discover")


def _new_lake(spark) -> Lake:
    """Empty tables in the shared folder."""
    lake = Lake(spark, f"frostline_{uuid4().hex}")
    lake.ensure_tables(scratch_dir(spark, "lake"))
    return lake


@query("ensure_tables",
       """SELECT 'asset_registry' AS table_name, count(*) AS n_rows FROM asset_registry
       UNION ALL SELECT 'lifecycle_events', count(*) FROM lifecycle_events
       UNION ALL SELECT 'offload_config', count(*) FROM config_versions
       UNION ALL SELECT 'config_change_log', count(*) FROM config_change_log""",
       REG, "lifecycle_events", "config_versions", "config_change_log")
def _(t):
    """The four owned tables, created twice over and loaded; rows per table."""
    lake = _new_lake(t.spark)
    lake.ensure_tables()
    loads = {
        tables.REGISTRY: t.asset_registry,
        tables.EVENTS: t.lifecycle_events,
        tables.CONFIG: t.config_versions,
        tables.CHANGE_LOG: t.config_change_log,
    }
    counts = []
    for name, rows in loads.items():
        lake.write_batch(name, rows, "load", "load")
        counts.append(lake.table(name).agg(F.lit(name).alias("table_name"), F.count("*").alias("n_rows")))
    return reduce(DataFrame.unionByName, counts)


# Offload

OUTCOMES_SQL = """SELECT m.handle, m.reg_id, m.path, m.size, ltrim(m.path, '/') AS key, c.source_md5,
 c.destination_md5, coalesce(c.status, 'ERROR') AS status,
 CASE WHEN coalesce(c.status, 'ERROR') = 'ERROR' THEN coalesce(c.error, 'no copy result') END AS error
 FROM candidates m LEFT JOIN copy_results c ON m.handle = c.handle"""
OFFLOAD = ALL | {"outcomes": OUTCOMES_SQL}
URI_SQL = "concat('s3://corp-cold-tier/', key)"


def _offload_event(kind, micros, where="TRUE", **fields):
    return _event_sql("outcomes", kind, micros, "offload_and_track", "handle", "reg_id", "path", where,
                      aws_bucket="'corp-cold-tier'", aws_key="key", **fields)


OFFLOAD_SQL = " UNION ALL ".join((
    _offload_event("COPY_STARTED", 2, destination_path=URI_SQL, file_size_bytes="size"),
    _offload_event("CHECKSUM_VERIFIED", 3, "status = 'COPIED'", success="TRUE", checksum_value="source_md5"),
    _offload_event("CHECKSUM_MISMATCH", 3, "status = 'MISMATCH'", success="FALSE",
                   error_message="'Checksum mismatch after copy'",
                   checksum_value="'src=' || source_md5 || ' dst=' || destination_md5"),
    _offload_event("COPY_COMPLETED", 4, "status = 'COPIED'", success="TRUE", checksum_value="source_md5",
                   destination_path=URI_SQL, file_size_bytes="size"),
    _offload_event("COPY_FAILED", 4, "status = 'ERROR'", success="FALSE", error_message="error"),
))


def _outcomes(t):
    return offload.with_outcome(discover.manifest(_candidates(t)), t.copy_results)


@query("stage_offload", OFFLOAD_SQL, CAT, REG, COPIES, extra=OFFLOAD)
def _(t):
    return offload.offload_events(_outcomes(t), SETTINGS, AS_OF, RUN)


COPIED_STATE_SQL = f"""SELECT r.* REPLACE ('BOTH' AS current_location, 'corp-cold-tier' AS current_aws_bucket,
 o.key AS current_aws_key, 'us-east-1' AS current_aws_region, {_at(4)} AS last_state_change,
 coalesce(o.source_md5, r.source_md5) AS source_md5,
 coalesce(o.destination_md5, r.destination_md5) AS destination_md5)
 FROM known_assets r JOIN outcomes o ON r.element_handle = o.handle WHERE o.status = 'COPIED'"""
STATES = OFFLOAD | {
    "known_assets": f"SELECT * FROM asset_registry UNION ALL {REGISTERED_SQL}",
    "copied": COPIED_STATE_SQL,
}


@query("update_state", "SELECT * FROM copied", CAT, REG, COPIES, extra=STATES)
def _(t):
    chosen = written(_candidates(t), "candidates")
    outcomes = offload.with_outcome(discover.manifest(chosen), t.copy_results)
    current = latest.current_registry(t.asset_registry.unionByName(discover.registrations(chosen, AS_OF)))
    return offload.registry_updates(current, outcomes, SETTINGS, AS_OF)


@query("offload_result",
       """SELECT handle, reg_id, path AS original_path, 'corp-cold-tier' AS aws_bucket, key AS aws_key, source_md5
       FROM outcomes WHERE status = 'COPIED'""", CAT, REG, COPIES, extra=OFFLOAD)
def _(t):
    return offload.offloaded(_outcomes(t), SETTINGS)


@query("offload_failures",
       """SELECT handle, CASE status WHEN 'MISMATCH' THEN 'checksum_mismatch' ELSE error END AS reason
       FROM outcomes WHERE status <> 'COPIED'""", CAT, REG, COPIES, extra=OFFLOAD)
def _(t):
    return offload.failed(_outcomes(t))


# Purge

PLAN_SQL = """SELECT r.*, coalesce(p.status = 'FOUND', FALSE) AS deletable, CASE
 WHEN p.status = 'NOT_FOUND' THEN 'AWS copy not found at s3://' || r.current_aws_bucket || '/' || r.current_aws_key
   || ', aborting local delete for safety'
 WHEN NOT coalesce(p.status = 'FOUND', FALSE) THEN coalesce(p.error, 'no look-up result') END AS reason
 FROM {0} r LEFT JOIN probe_results p ON r.element_handle = p.handle WHERE r.current_location = 'BOTH'"""
PURGE = {"plan": PLAN_SQL.format("asset_registry")}


def _purge_event(kind, micros, where, **fields):
    return _event_sql("plan", kind, micros, "verify_and_purge", "element_handle", "registration_id", "original_path",
                      where, aws_bucket="current_aws_bucket", aws_key="current_aws_key", **fields)


PURGE_SQL = " UNION ALL ".join((
    _purge_event("LOCAL_DELETE_REQUESTED", 5, "deletable"),
    _purge_event("LOCAL_DELETED", 6, "deletable", success="TRUE"),
    _purge_event("LOCAL_DELETE_FAILED", 6, "NOT deletable", success="FALSE", error_message="reason"),
))


def _plan(t):
    return purge.purge_plan(t.asset_registry, t.probe_results)


@query("stage_purge", PURGE_SQL, REG, PROBES, extra=PURGE)
def _(t):
    return purge.purge_events(_plan(t), SETTINGS, AS_OF, RUN)


@query("purge_plan",
       """SELECT element_handle, original_bucket, ltrim(original_path, '/') AS local_key, deletable, reason
       FROM plan""", REG, PROBES, extra=PURGE)
def _(t):
    return _plan(t).select("element_handle", "original_bucket", "local_key", "deletable", "reason")


@query("purge_result",
       """SELECT element_handle AS handle, original_path,
       's3://' || current_aws_bucket || '/' || current_aws_key AS aws_location FROM plan WHERE deletable""",
       REG, PROBES, extra=PURGE)
def _(t):
    return purge.purged(_plan(t))


@query("purge_failures", "SELECT element_handle AS handle, reason FROM plan WHERE NOT deletable",
       REG, PROBES, extra=PURGE)
def _(t):
    return purge.failed(_plan(t))


@query("manual_state_override",
       f"""SELECT * REPLACE ('UNKNOWN' AS current_location, {_at(6)} AS last_state_change) FROM asset_registry
       WHERE element_handle IN (SELECT handle FROM probe_results WHERE status = 'NOT_FOUND')
       AND current_location = 'BOTH'""", REG, PROBES)
def _(t):
    """Assets whose cold copy is gone, declared lost."""
    gone = t.probe_results.where(F.col("status") == C.NOT_FOUND).select(F.col("handle").alias("element_handle"))
    lost = purge.pending(t.asset_registry).join(gone, "element_handle", "left_semi")
    return changes.moved(lost, F.lit(C.UNKNOWN), times.plus_micros(AS_OF, 6))


# Whole runs

@query("tag_status",
       f"""SELECT handle, 'COPIED' AS offload_status, {_at(4)} AS tagged_at FROM outcomes WHERE status = 'COPIED'
       UNION ALL SELECT element_handle, 'PURGED', {_at(6)} FROM plan WHERE deletable""",
       CAT, REG, COPIES, PROBES, extra=OFFLOAD | PURGE)
def _(t):
    copied = offload.tags(_outcomes(t), SETTINGS, AS_OF)
    gone = purge.tags(_plan(t), AS_OF)
    return copied.select("handle", "offload_status", F.col("offload_timestamp").alias("tagged_at")).unionByName(
        gone.select("handle", "offload_status", F.col("purge_timestamp").alias("tagged_at"))
    )


@query("run_outcome",
       """SELECT 'offload' AS stage, count(CASE WHEN status = 'COPIED' THEN 1 END) AS succeeded,
       count(CASE WHEN status <> 'COPIED' THEN 1 END) AS failed FROM outcomes
       UNION ALL SELECT 'purge', count(CASE WHEN deletable THEN 1 END),
       count(CASE WHEN NOT deletable THEN 1 END) FROM plan""",
       CAT, REG, COPIES, PROBES, extra=OFFLOAD | PURGE)
def _(t):
    def counts(stage, rows, done):
        return rows.agg(
            F.lit(stage).alias("stage"),
            F.count(F.when(done, 1)).alias("succeeded"),
            F.count(F.when(~done, 1)).alias("failed"),
        )

    copied = counts("offload", _outcomes(t), F.col("status") == C.COPIED)
    return copied.unionByName(counts("purge", _plan(t), F.col("deletable")))


AFTER = STATES | {
    "after_offload": "SELECT * FROM copied UNION ALL SELECT * FROM known_assets"
                     " WHERE element_handle NOT IN (SELECT element_handle FROM copied)",
    "plan": PLAN_SQL.format("after_offload"),
}


@query("end_to_end_run",
       f"""SELECT a.element_handle, a.registration_id,
       CASE WHEN p.deletable THEN 'LOCAL_DELETED' ELSE a.current_location END AS current_location,
       a.current_aws_key, a.source_md5, a.registered_at,
       CASE WHEN p.deletable THEN {_at(6)} ELSE a.last_state_change END AS last_state_change
       FROM after_offload a LEFT JOIN plan p ON a.element_handle = p.element_handle""",
       CAT, REG, COPIES, PROBES, extra=AFTER)
def _(t):
    """The registry after the three stages ran on real tables, each stage from what the one before wrote."""
    lake = _new_lake(t.spark)
    lake.write_batch(tables.REGISTRY, t.asset_registry, "earlier", "discover")
    lake.write_batch(tables.CANDIDATES, discover.candidates(
        t.catalog_snapshot, lake.registry(), SETTINGS, AS_OF, RUN), RUN, "discover")
    chosen = lake.batch(tables.CANDIDATES, RUN, "discover")
    lake.write_batch(tables.REGISTRY, discover.registrations(chosen, AS_OF), RUN, "discover")

    outcomes = offload.with_outcome(discover.manifest(chosen), t.copy_results)
    lake.write_batch(
        tables.REGISTRY, offload.registry_updates(lake.registry(), outcomes, SETTINGS, AS_OF), RUN, "offload"
    )
    plan = purge.purge_plan(lake.registry(), t.probe_results)
    lake.write_batch(tables.REGISTRY, purge.registry_updates(plan, SETTINGS, AS_OF), RUN, "purge")
    return lake.registry().select(
        "element_handle", "registration_id", "current_location", "current_aws_key", "source_md5",
        "registered_at", "last_state_change",
    )


# A run over real objects: documents as files, with the configuration in the tables

RUN_SETTINGS = Settings(
    C.DEFAULT_CONFIG
    | {"source_paths": "/tenant", "dry_run": "false", "auto_delete_local": "true", "batch_size": "1000000000"},
    SETTINGS.bootstrap,
)


def _world(t):
    """Tables with an earlier run's registry and the configuration, and the roots of the two stores."""
    lake, root = _new_lake(t.spark), scratch_dir(t.spark, "stores")
    for folder, rows in (("source", t.document_sources), ("cold", t.document_copies)):
        written(objects.write_objects(rows, f"{root}/{folder}"), "staged")
    lake.write_batch(tables.REGISTRY, t.document_registry, "earlier", "offload")
    config.seed(lake, AS_OF - timedelta(days=9))
    changed = {k: v for k, v in RUN_SETTINGS.values.items() if v != C.DEFAULT_CONFIG[k]}
    config.update_all(lake, changed, "admin", "go live", AS_OF - timedelta(days=8))
    return lake, f"{root}/source", f"{root}/cold"


def _run(t):
    lake, source, cold = _world(t)
    run.run_all(lake, t.document_catalog, AS_OF, source, cold, RUN_SETTINGS.bootstrap, RUN)
    return lake, cold


DOCUMENT_RUN = {
    "catalog_snapshot": "SELECT * FROM document_catalog",
    "asset_registry": "SELECT * FROM document_registry",
    "cold_files": f"SELECT {CATALOG_SQL} FROM catalog_snapshot WHERE {COLD_SQL}",
    "candidates": CANDIDATES_SQL,
    "copy_results": """SELECT s.handle, md5(s.body) AS source_md5, md5(s.body) AS destination_md5, 'COPIED' AS status,
 CAST(NULL AS VARCHAR) AS error FROM document_sources s""",
    "outcomes": OUTCOMES_SQL,
} | {k: STATES[k] for k in ("known_assets", "copied")} | {
    "after_offload": AFTER["after_offload"],
    "probe_results": """SELECT element_handle AS handle, CASE WHEN element_handle IN (SELECT handle FROM document_copies)
 OR element_handle IN (SELECT element_handle FROM copied) THEN 'FOUND' ELSE 'NOT_FOUND' END AS status,
 CAST(NULL AS VARCHAR) AS error FROM after_offload""",
    "plan": AFTER["plan"],
}
DOCUMENT_TABLES = ("document_catalog", "document_registry", "document_sources", "document_copies")
EVENTS_SQL = " UNION ALL ".join((DISCOVER_SQL, OFFLOAD_SQL, PURGE_SQL)).replace(SETTINGS.snapshot(), RUN_SETTINGS.snapshot())


@query("whole_run",
       f"""SELECT 'event' AS record, element_handle, registration_id, event_type AS what, event_timestamp AS at,
       source_path AS path, destination_path AS place, file_size_bytes AS size, success, checksum_value AS checksum,
       CASE WHEN event_type <> 'COPY_FAILED' THEN error_message END AS note, config_snapshot FROM ({EVENTS_SQL})
       UNION ALL
       SELECT 'asset', a.element_handle, registration_id,
       CASE WHEN p.deletable THEN 'LOCAL_DELETED' ELSE a.current_location END,
       CASE WHEN p.deletable THEN {_at(6)} ELSE a.last_state_change END, a.original_path, a.current_aws_key,
       a.file_size_bytes, NULL, a.destination_md5, a.current_aws_bucket, NULL
       FROM after_offload a LEFT JOIN (SELECT element_handle, deletable FROM plan) p
       ON a.element_handle = p.element_handle""", *DOCUMENT_TABLES, extra=DOCUMENT_RUN)
def _(t):
    """Events and registry after discovery, copies of real objects, look-ups and purge, from the tables' configuration."""
    lake, _ = _run(t)
    none = F.lit(None)
    events = lake.events(run=RUN).select(
        F.lit("event").alias("record"), "element_handle", "registration_id", F.col("event_type").alias("what"),
        F.col("event_timestamp").alias("at"), F.col("source_path").alias("path"), F.col("destination_path").alias("place"),
        F.col("file_size_bytes").alias("size"), "success", F.col("checksum_value").alias("checksum"),
        # The text of a failure names the folder that the query wrote to.
        F.when(F.col("event_type") != C.COPY_FAILED, F.col("error_message")).alias("note"), "config_snapshot",
    )
    assets = lake.registry().select(
        F.lit("asset").alias("record"), "element_handle", "registration_id", F.col("current_location").alias("what"),
        F.col("last_state_change").alias("at"), F.col("original_path").alias("path"),
        F.col("current_aws_key").alias("place"), F.col("file_size_bytes").alias("size"),
        none.cast("boolean").alias("success"), F.col("destination_md5").alias("checksum"),
        F.col("current_aws_bucket").alias("note"), none.cast("string").alias("config_snapshot"),
    )
    return events.unionByName(assets)


LINEAGE_SQL = """SELECT handle AS element_handle, reg_id AS registration_id, path AS original_path,
 'cluster-01' AS source_cluster, '2024-01-31T00:00:00' AS offload_timestamp, source_md5,
 'INTELLIGENT_TIERING' AS aws_storage_class, 'corp-cold-tier' AS aws_bucket, key AS aws_key
 FROM outcomes WHERE status = 'COPIED'"""


def _lineage(spark, cold):
    return objects.read_lineage(spark, cold).select(
        *objects.metadata_fields(F.col("metadata"), "source"), "aws_bucket", "aws_key"
    )


@query("object_metadata_scan", LINEAGE_SQL, *DOCUMENT_TABLES, extra=DOCUMENT_RUN)
def _(t):
    """What a run left beside its copies, read after the tables are gone."""
    lake, cold = _run(t)
    t.spark.sql(f"DROP DATABASE {lake.database} CASCADE")
    return _lineage(t.spark, cold)


@query("rebuild_registry_from_dest",
       f"""SELECT element_handle, registration_id, original_path,
       regexp_extract(original_path, '[^/]*$') AS file_name, 'AWS' AS current_location,
       aws_bucket AS current_aws_bucket, aws_key AS current_aws_key, source_md5 FROM ({LINEAGE_SQL})
       WHERE element_handle NOT IN (SELECT handle FROM catalog_snapshot WHERE mtime >= TIMESTAMP '2023-06-01 00:05:00')""",
       *DOCUMENT_TABLES, extra=DOCUMENT_RUN)
def _(t):
    """The registry is lost but for the files registered since; the rest comes back from what lies with the copies."""
    lake, cold = _run(t)
    t.spark.sql(f"DROP DATABASE {lake.database} CASCADE")
    lake = _new_lake(t.spark)
    since = times.ntz(datetime(2023, 6, 1, 0, 5))
    files = t.document_catalog.where(F.col("mtime") >= since).withColumn("known_registration_id", F.lit(None).cast("string"))
    lake.write_batch(tables.REGISTRY, discover.registrations(files.withColumn("registration_id", F.col("handle")), AS_OF),
                     "since", "discover")
    return reconcile.rebuild_registry(_lineage(t.spark, cold), lake.registry())


# Objects as files in the shared folder, one per document

def _staged(t):
    """All bodies written as objects; handle, key and size of each, and the folder."""
    root = scratch_dir(t.spark, "objects")
    bodies = t.source_objects
    # A scan with a part for each core is spread already.
    partitions = 0 if bodies.rdd.getNumPartitions() >= t.spark.sparkContext.defaultParallelism else None
    staged = written(objects.write_objects(bodies, f"{root}/source", partitions), "staged")
    return staged, root


SIZE_SQL = "octet_length(encode(body))"


@query("copy_objects",
       f"""SELECT handle, md5(body) AS source_md5, md5(body) AS destination_md5, {SIZE_SQL} AS bytes_copied,
       'COPIED' AS status, CAST(NULL AS VARCHAR) AS error, md5(body) AS recorded_md5 FROM source_objects""",
       "source_objects")
def _(t):
    staged, root = _staged(t)
    jobs = staged.select(
        "handle", F.col("key").alias("source_key"), F.concat(F.lit("cold/"), F.col("key")).alias("dest_key"),
        "size", F.create_map(F.lit("source-source-md5"), F.lit("")).alias("metadata"),
    )
    copies = objects.copy_objects(jobs, f"{root}/source", f"{root}/cold", verify=True)
    return copies.withColumn("recorded_md5", F.col("metadata")["source-source-md5"]).drop("metadata")


@query("object_checksums_streamed",
       f"SELECT handle, md5(body) AS md5, {SIZE_SQL} AS size, CAST(NULL AS VARCHAR) AS error FROM source_objects",
       "source_objects")
def _(t):
    staged, root = _staged(t)
    return objects.file_digests(staged, f"{root}/source").select("handle", "md5", "size", "error")


@query("object_checksums_files",
       f"SELECT key, md5(body) AS md5, {SIZE_SQL} AS size FROM source_objects", "source_objects")
def _(t):
    staged, root = _staged(t)
    return objects.file_digests(staged, f"{root}/source").select("key", "md5", "size")


@query("probe_objects",
       """SELECT s.handle, CASE WHEN d.key IS NULL THEN 'NOT_FOUND' ELSE 'FOUND' END AS status,
       CAST(NULL AS VARCHAR) AS error FROM wanted s LEFT JOIN source_objects d ON s.key = d.key""",
       "source_objects", "dest_objects", extra={"wanted": "SELECT key AS handle, key FROM dest_objects"})
def _(t):
    _, root = _staged(t)
    wanted = t.dest_objects.select(F.col("key").alias("handle"), "key")
    return objects.probe_listed(wanted, f"{root}/source")
