"""Queries on the asset registry and the catalog."""

from datetime import timedelta
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import functions as F

from frostline import constants as C
from frostline.functions import ids, paths
from frostline.operators import latest, prefixes
from frostline.plans import discover
from frostline.reports import catalog, reconcile, registry
from frostline.sources import catalog as catalog_source
from frostline.sources import lake as tables
from frostline.sources.catalog import cold, is_file, scan_catalog
from frostline.sources.lake import Lake
from frostline.sources.shared import scratch_dir
from frostline.workload.fixtures import AS_OF, AS_OF_SQL
from frostline.workload.registered import query

ELEMENT = "0x" + "7".rjust(16, "0")
COLD_SQL = f"element_type = 'FILE' AND atime < {AS_OF_SQL} - INTERVAL '60' DAY"
OFFLOADED_SQL = "current_location IN ('AWS', 'BOTH', 'LOCAL_DELETED')"
ROOTS = ["/tenant/src1", "/tenant/src3"]
ROOTS_SQL = (
    "(parent_path = '/tenant/src1' OR starts_with(parent_path, '/tenant/src1/')"
    " OR parent_path = '/tenant/src3' OR starts_with(parent_path, '/tenant/src3/'))"
)
CATALOG_SQL = (
    "handle, parent_path, name, coalesce(extension, '') AS extension, size, atime, mtime, ctime,"
    " coalesce(nullif(login_name, ''), 'unknown') AS login_name, coalesce(nfs_mode_bits, 0) AS nfs_mode_bits"
)
# Buckets by path prefix; prefixes are not aligned to path segments, the longest one wins.
BUCKETS = {
    "/tenant/src1": "bucket-one",
    "/tenant/src10": "bucket-ten",
    "/tenant/src2/y1": "bucket-two-y1",
    "/tenant/src3": "bucket-three",
    "/tenant/src": "bucket-rest",
    "/tenant/src19/": "bucket-nineteen",
}
BUCKETS_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{p}', '{b}')" for p, b in BUCKETS.items()) + ") AS m(prefix, bucket)"
EVENT_HANDLES_SQL = "SELECT DISTINCT element_handle FROM lifecycle_events WHERE success = FALSE"


# Catalog

@query("scan_catalog", f"SELECT {CATALOG_SQL} FROM catalog_snapshot WHERE {COLD_SQL}", "catalog_snapshot")
def _(t):
    return scan_catalog(t.catalog_snapshot, AS_OF, 60)


@query("filter_cold", f"SELECT handle, atime FROM catalog_snapshot WHERE atime < {AS_OF_SQL} - INTERVAL '60' DAY",
       "catalog_snapshot")
def _(t):
    return t.catalog_snapshot.where(cold(AS_OF, 60)).select("handle", "atime")


@query("filter_files", "SELECT handle, element_type FROM catalog_snapshot WHERE element_type = 'FILE'",
       "catalog_snapshot")
def _(t):
    return t.catalog_snapshot.where(is_file()).select("handle", "element_type")


@query("filter_path_prefix", f"SELECT handle, parent_path FROM catalog_snapshot WHERE {ROOTS_SQL}",
       "catalog_snapshot")
def _(t):
    return t.catalog_snapshot.where(paths.under_any(F.col("parent_path"), ROOTS)).select("handle", "parent_path")


@query("filter_path_in",
       "SELECT handle, parent_path FROM catalog_snapshot WHERE parent_path IN ('/tenant/src1', '/tenant/src3/y2')",
       "catalog_snapshot")
def _(t):
    wanted = F.col("parent_path").isin("/tenant/src1", "/tenant/src3/y2")
    return t.catalog_snapshot.where(wanted).select("handle", "parent_path")


@query("discover_anti",
       f"SELECT handle, parent_path, atime FROM catalog_snapshot c WHERE {COLD_SQL} AND NOT EXISTS"
       f" (SELECT 1 FROM asset_registry a WHERE a.element_handle = c.handle AND {OFFLOADED_SQL})",
       "catalog_snapshot", "asset_registry")
def _(t):
    files = scan_catalog(t.catalog_snapshot, AS_OF, 60)
    return discover.not_offloaded(files, t.asset_registry).select("handle", "parent_path", "atime")


@query("tag_status_counts",
       "SELECT tag_offload_status, count(*) AS item_count FROM catalog_snapshot GROUP BY tag_offload_status",
       "catalog_snapshot")
def _(t):
    return catalog.tag_status_counts(t.catalog_snapshot)


@query("cold_count", f"SELECT count(*) AS cold_files FROM catalog_snapshot WHERE {COLD_SQL}", "catalog_snapshot")
def _(t):
    return catalog.cold_count(t.catalog_snapshot, AS_OF, 60)


@query("catalog_freshness", "SELECT count(*) AS items, max(mtime) AS last_updated FROM catalog_snapshot",
       "catalog_snapshot")
def _(t):
    return catalog.freshness(t.catalog_snapshot)


def _kept_snapshots(t):
    """Two snapshots in one folder, and the start of a third."""
    folder = scratch_dir(t.spark, "catalog")
    names = [catalog_source.write_snapshot(rows, folder, AS_OF - timedelta(days=ago))
             for rows, ago in ((t.catalog_earlier, 1), (t.catalog_later, 0))]
    return folder, names


@query("scan_latest_snapshot", f"SELECT {CATALOG_SQL} FROM catalog_later WHERE {COLD_SQL}", "catalog_later")
def _(t):
    folder, _ = _kept_snapshots(t)
    return scan_catalog(catalog_source.read_catalog(t.spark, folder), AS_OF, 60)


@query("catalog_changes",
       """SELECT coalesce(e.handle, l.handle) AS handle, coalesce(l.path, e.path) AS path,
       CASE WHEN e.handle IS NULL THEN 'ADDED' WHEN l.handle IS NULL THEN 'REMOVED' ELSE 'CHANGED' END AS change,
       coalesce(l.path <> e.path, FALSE) AS moved
       FROM (SELECT *, concat(parent_path, '/', name) AS path FROM catalog_earlier) e
       FULL JOIN (SELECT *, concat(parent_path, '/', name) AS path FROM catalog_later) l ON e.handle = l.handle
       WHERE e.handle IS NULL OR l.handle IS NULL OR e.path <> l.path OR e.atime <> l.atime""",
       "catalog_earlier", "catalog_later")
def _(t):
    folder, names = _kept_snapshots(t)
    return catalog_source.snapshot_changes(*[catalog_source.read_catalog(t.spark, folder, name) for name in names])


@query("catalog_vs_registry",
       """SELECT a.element_handle, a.original_path, c.atime AS catalog_atime, a.file_atime AS registry_atime,
       c.atime IS DISTINCT FROM a.file_atime AS atime_changed, c.atime > a.file_atime AS read_since,
       concat(c.parent_path, '/', c.name) <> a.original_path AS moved
       FROM asset_registry a JOIN catalog_later c ON a.element_handle = c.handle""",
       "catalog_later", "asset_registry")
def _(t):
    return reconcile.catalog_drift(t.asset_registry, t.catalog_later)


@query("tag_vs_registry",
       """SELECT tag_offload_status AS tag, current_location, count(*) AS files,
       tag_offload_status IS NOT DISTINCT FROM CASE WHEN current_location = 'BOTH' THEN 'COPIED'
         WHEN current_location IN ('LOCAL_DELETED', 'AWS') THEN 'PURGED' END AS consistent
       FROM catalog_snapshot c LEFT JOIN asset_registry a ON a.element_handle = c.handle
       GROUP BY tag_offload_status, current_location""",
       "catalog_snapshot", "asset_registry")
def _(t):
    return reconcile.tag_vs_registry(t.asset_registry, t.catalog_snapshot)


# Paths and keys

@query("full_path", "SELECT handle, concat(parent_path, '/', name) AS path FROM catalog_snapshot", "catalog_snapshot")
def _(t):
    return t.catalog_snapshot.select("handle", paths.full_path(F.col("parent_path"), F.col("name")).alias("path"))


@query("aws_key", "SELECT element_handle, ltrim(original_path, '/') AS aws_key FROM asset_registry", "asset_registry")
def _(t):
    return t.asset_registry.select("element_handle", paths.aws_key(F.col("original_path")).alias("aws_key"))


@query("s3_key",
       """SELECT element_handle, ltrim(CASE WHEN starts_with(original_path, '/tenant/src1')
       THEN substr(original_path, 13) ELSE original_path END, '/') AS key_below_root,
       ltrim(CASE WHEN starts_with(original_path, '/' || original_bucket)
       THEN substr(original_path, length(original_bucket) + 2) ELSE original_path END, '/') AS key_below_bucket
       FROM asset_registry""",
       "asset_registry")
def _(t):
    path = F.col("original_path")
    return t.asset_registry.select(
        "element_handle",
        paths.s3_key(path, F.lit("/tenant/src1")).alias("key_below_root"),
        paths.s3_key(path, F.concat(F.lit("/"), F.col("original_bucket"))).alias("key_below_bucket"),
    )


@query("dest_uri",
       "SELECT element_handle, 's3://' || current_aws_bucket || '/' || current_aws_key AS uri FROM asset_registry",
       "asset_registry")
def _(t):
    return t.asset_registry.select(
        "element_handle", paths.dest_uri(F.col("current_aws_bucket"), F.col("current_aws_key")).alias("uri")
    )


@query("resolve_bucket_view",
       """SELECT handle, coalesce(nullif(split_part(trim(parent_path, '/'), '/', 2), ''),
       split_part(trim(parent_path, '/'), '/', 1)) AS bucket FROM catalog_snapshot""",
       "catalog_snapshot")
def _(t):
    return t.catalog_snapshot.select("handle", paths.bucket_segment(F.col("parent_path")).alias("bucket"))


BUCKET_SQL = """SELECT c.handle, (SELECT arg_max(m.bucket, length(m.prefix)) FROM buckets m
 WHERE starts_with(c.parent_path, m.prefix)) AS bucket FROM catalog_snapshot c"""


@query("bucket_from_path", BUCKET_SQL, "catalog_snapshot", extra={"buckets": BUCKETS_SQL})
def _(t):
    return t.catalog_snapshot.select("handle", paths.mapped_bucket(F.col("parent_path"), BUCKETS).alias("bucket"))


@query("bucket_from_mapping_table", BUCKET_SQL, "catalog_snapshot", extra={"buckets": BUCKETS_SQL})
def _(t):
    mapping = t.spark.createDataFrame(pa.table({"prefix": list(BUCKETS), "bucket": list(BUCKETS.values())}))
    files = t.catalog_snapshot.select("handle", "parent_path")
    return prefixes.assign_buckets(files, "parent_path", mapping).drop("parent_path")


# Registry

@query("scan_registry",
       "SELECT element_handle, registration_id, original_path, current_location FROM asset_registry"
       " WHERE current_location = 'LOCAL'",
       "asset_registry")
def _(t):
    return registry.by_location(
        t.asset_registry, C.LOCAL, ["element_handle", "registration_id", "original_path", "current_location"]
    )


@query("filter_offloaded", f"SELECT element_handle, current_location FROM asset_registry WHERE {OFFLOADED_SQL}",
       "asset_registry")
def _(t):
    return discover.offloaded(t.asset_registry).select("element_handle", "current_location")


@query("offloaded_handles", f"SELECT DISTINCT element_handle FROM asset_registry WHERE {OFFLOADED_SQL}",
       "asset_registry")
def _(t):
    return registry.offloaded_handles(t.asset_registry)


@query("already_offloaded",
       f"SELECT handle AS element_handle FROM catalog_snapshot WHERE handle IN"
       f" (SELECT element_handle FROM asset_registry WHERE {OFFLOADED_SQL})",
       "catalog_snapshot", "asset_registry")
def _(t):
    handles = t.catalog_snapshot.select(F.col("handle").alias("element_handle"))
    return registry.already_offloaded(handles, t.asset_registry)


@query("pending_purge", "SELECT * FROM asset_registry WHERE current_location = 'BOTH'", "asset_registry")
def _(t):
    return registry.pending_purge(t.asset_registry)


LOCATE_SQL = """SELECT element_handle, original_path, current_location, current_aws_bucket, current_aws_key,
 current_aws_region, source_md5, destination_md5, registered_at, last_state_change FROM asset_registry"""


@query("locate_by_handle", f"{LOCATE_SQL} WHERE element_handle = '{ELEMENT}'", "asset_registry")
def _(t):
    return registry.locate_by_handle(t.asset_registry, ELEMENT)


@query("locate_many", f"{LOCATE_SQL} WHERE element_handle IN ({EVENT_HANDLES_SQL})",
       "asset_registry", "lifecycle_events")
def _(t):
    return registry.locate_by_handle(t.asset_registry, t.lifecycle_events.where(~F.col("success")))


@query("locate_by_path",
       """SELECT element_handle, original_path, current_location, current_aws_bucket, current_aws_key, source_md5,
       registered_at, last_state_change FROM asset_registry WHERE original_path LIKE '/tenant/src1%.pdf'
       ORDER BY last_state_change DESC""",
       "asset_registry")
def _(t):
    return registry.locate_by_path(t.asset_registry, "/tenant/src1%.pdf")


@query("locate_contains",
       """SELECT element_handle, original_path, current_location, current_aws_bucket, current_aws_key, source_md5
       FROM asset_registry WHERE contains(coalesce(original_path, ''), '.xlsx')""",
       "asset_registry")
def _(t):
    return registry.locate_contains(t.asset_registry, "*.xlsx")


@query("locate_contains_indexed",
       """SELECT element_handle, original_path, current_location, current_aws_bucket, current_aws_key, source_md5
       FROM asset_registry WHERE contains(coalesce(original_path, ''), '_77')""",
       "asset_registry")
def _(t):
    """By the postings that a batch of the registry brings along, loaded in ranges of elements: few readers may have all."""
    lake = Lake(t.spark, f"frostline_{uuid4().hex}", path_index=True)
    lake.ensure_tables(scratch_dir(t.spark, "lake"))
    loaded = t.asset_registry.repartitionByRange("element_handle", "registration_id")
    lake.write_batch(tables.REGISTRY, loaded, "load", "load")
    return registry.locate_indexed(lake, "*_77*")


@query("purged_by_path",
       """SELECT element_handle, file_name, file_size_bytes, original_path, current_aws_bucket, current_aws_key,
       registered_at, last_state_change, source_md5 FROM asset_registry
       WHERE original_path LIKE '/tenant/%' AND current_location = 'LOCAL_DELETED'""",
       "asset_registry")
def _(t):
    return registry.purged_by_path(t.asset_registry, "/tenant/%")


@query("recently_offloaded",
       """SELECT element_handle, file_name, current_location, last_state_change FROM asset_registry
       WHERE current_location = 'BOTH' ORDER BY last_state_change DESC, element_handle LIMIT 20""",
       "asset_registry")
def _(t):
    return registry.recently_offloaded(t.asset_registry, 20)


INTEGRITY_SQL = """SELECT element_handle, original_path, source_md5, destination_md5, current_location,
 last_state_change FROM asset_registry"""


@query("integrity_mismatch", f"{INTEGRITY_SQL} WHERE source_md5 <> destination_md5", "asset_registry")
def _(t):
    return registry.integrity_mismatch(t.asset_registry)


@query("integrity_suspect",
       f"{INTEGRITY_SQL} WHERE {OFFLOADED_SQL} AND (source_md5 IS DISTINCT FROM destination_md5 OR source_md5 IS NULL)",
       "asset_registry")
def _(t):
    return registry.integrity_suspect(t.asset_registry)


@query("assets_by_location",
       """SELECT current_location, count(*) AS asset_count, CAST(sum(file_size_bytes) AS BIGINT) AS total_bytes,
       min(registered_at) AS earliest_registered, max(last_state_change) AS latest_change
       FROM asset_registry GROUP BY current_location""",
       "asset_registry")
def _(t):
    return registry.by_location_summary(t.asset_registry)


@query("assets_by_location_gb",
       """SELECT current_location, count(*) AS file_count,
       CAST(sum(file_size_bytes) AS DOUBLE) / 1073741824.0::DOUBLE AS size_gb,
       CAST(sum(file_size_bytes) AS DOUBLE) / 1073741824.0::DOUBLE / 1024.0::DOUBLE AS size_tb
       FROM asset_registry GROUP BY current_location""",
       "asset_registry")
def _(t):
    return registry.by_location_sizes(t.asset_registry)


@query("stats_locations",
       """SELECT coalesce(nullif(current_location, ''), 'UNKNOWN') AS location, count(*) AS asset_count,
       round(CAST(sum(coalesce(file_size_bytes, 0)) AS DOUBLE) / 1073741824.0::DOUBLE, 2) AS size_gb
       FROM asset_registry GROUP BY 1""",
       "asset_registry")
def _(t):
    return registry.stats_locations(t.asset_registry)


@query("total_offloaded_gb",
       f"""SELECT round(CAST(sum(file_size_bytes) AS DOUBLE) / 1073741824.0::DOUBLE, 2) AS total_gb,
       count(DISTINCT element_handle) AS unique_files FROM asset_registry WHERE {OFFLOADED_SQL}""",
       "asset_registry")
def _(t):
    return registry.total_offloaded(t.asset_registry)


@query("total_copied_gb",
       """SELECT round(CAST(sum(file_size_bytes) AS DOUBLE) / 1073741824.0::DOUBLE, 2) AS total_gb,
       count(DISTINCT element_handle) AS unique_files FROM asset_registry
       WHERE current_location IN ('BOTH', 'LOCAL_DELETED')""",
       "asset_registry")
def _(t):
    return registry.total_offloaded(t.asset_registry, (C.BOTH, C.LOCAL_DELETED))


@query("offloaded_by_path",
       f"""SELECT original_path, count(*) AS file_count,
       round(CAST(sum(file_size_bytes) AS DOUBLE) / 1073741824.0::DOUBLE, 2) AS gb,
       max(last_state_change) AS last_offload FROM asset_registry WHERE {OFFLOADED_SQL} GROUP BY original_path""",
       "asset_registry")
def _(t):
    return registry.offloaded_by_path(t.asset_registry)


@query("registered_count", "SELECT count(*) AS registered FROM asset_registry", "asset_registry")
def _(t):
    return registry.registered_count(t.asset_registry)


@query("recommended_batch_size",
       """SELECT round(avg_mb, 6) AS avg_mb,
       CAST(greatest(1, floor(2000.0::DOUBLE / nullif(avg_mb * 4, 0))) AS BIGINT) AS batch_size FROM (SELECT
       CAST(sum(file_size_bytes) AS DOUBLE) / count(file_size_bytes) / 1048576.0::DOUBLE AS avg_mb
       FROM asset_registry)""",
       "asset_registry")
def _(t):
    return registry.recommended_batch_size(t.asset_registry, memory_gb=4, verify=True)


# Versions of the registry: its rows, and the state that every event left behind.
VERSIONS_SQL = """SELECT element_handle, registration_id, current_location, last_state_change FROM asset_registry
 UNION ALL SELECT element_handle, registration_id, CASE event_type WHEN 'REGISTERED' THEN 'LOCAL'
 WHEN 'COPY_COMPLETED' THEN 'BOTH' ELSE 'LOCAL_DELETED' END, event_timestamp FROM lifecycle_events
 WHERE event_type IN ('REGISTERED', 'COPY_COMPLETED', 'LOCAL_DELETED')"""


@query("current_registry",
       """SELECT element_handle, registration_id, current_location, last_state_change FROM (SELECT *, row_number()
       OVER (PARTITION BY element_handle ORDER BY last_state_change DESC, registration_id DESC) AS rn
       FROM versions) WHERE rn = 1""",
       "asset_registry", "lifecycle_events", extra={"versions": VERSIONS_SQL})
def _(t):
    moves = t.lifecycle_events.select(
        "element_handle", "registration_id",
        reconcile.state_after(F.col("event_type")).alias("current_location"),
        F.col("event_timestamp").alias("last_state_change"),
    ).where(F.col("current_location").isNotNull())
    rows = t.asset_registry.select(*moves.columns)
    return latest.current_registry(rows.unionByName(moves))


DIGEST_SQL = "md5(concat_ws('|', pipeline_run_id, element_handle, event_type))"


@query("new_id",
       f"""SELECT event_id AS row_id, substr(d, 1, 8) || '-' || substr(d, 9, 4) || '-' || substr(d, 13, 4) || '-'
       || substr(d, 17, 4) || '-' || substr(d, 21, 12) AS new_id
       FROM (SELECT event_id, {DIGEST_SQL} AS d FROM lifecycle_events)""", "lifecycle_events")
def _(t):
    new_id = ids.event_id(F.col("pipeline_run_id"), F.col("element_handle"), F.col("event_type"))
    return t.lifecycle_events.select(F.col("event_id").alias("row_id"), new_id.alias("new_id"))
