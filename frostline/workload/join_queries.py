"""Queries that join or cross-check several tables."""

from pyspark.sql import functions as F

from frostline import constants as C
from frostline.functions.times import ntz
from frostline.operators import latest
from frostline.plans import registry as changes
from frostline.reports import reconcile
from frostline.sources import objects
from frostline.workload.fixtures import AS_OF, AS_OF_SQL
from frostline.workload.registered import query

REG, EV, V = "asset_registry", "lifecycle_events", "config_versions"
NOW_SQL = """SELECT arg_max(config_value, (updated_at, config_value)) AS config_value FROM config_versions
 WHERE config_key = 'atime_threshold_days'"""
THEN_SQL = "json_extract_string(e.config_snapshot, '$.atime_threshold_days')"


@query("stale_threshold",
       f"""SELECT element_handle, original_path, event_timestamp, threshold_at_offload, config_value AS current_threshold
       FROM (SELECT element_handle, event_timestamp, {THEN_SQL} AS threshold_at_offload
             FROM lifecycle_events e WHERE event_type = 'COPY_COMPLETED') copied
       JOIN current_value ON threshold_at_offload <> config_value
       JOIN asset_registry USING (element_handle)""", REG, EV, V, extra={"current_value": NOW_SQL})
def _(t):
    return reconcile.stale_threshold(t.asset_registry, t.lifecycle_events, t.config_versions)


@query("stale_threshold_scalar",
       f"""SELECT element_handle, original_path, event_timestamp, threshold_at_offload, config_value AS current_threshold
       FROM (SELECT element_handle, event_timestamp, {THEN_SQL} AS threshold_at_offload
             FROM lifecycle_events e WHERE event_type = 'COPY_COMPLETED') copied
       JOIN current_value ON threshold_at_offload <> config_value
       JOIN asset_registry USING (element_handle)""",
       REG, EV, V, extra={"current_value": NOW_SQL})
def _(t):
    """The current value as a scalar subquery: it is computed once, and then filters the copies before the join."""
    return t.spark.sql(
        """WITH copied AS (
          SELECT element_handle, event_id, event_timestamp,
            get_json_object(config_snapshot, '$.atime_threshold_days') AS threshold_at_offload
          FROM {events} WHERE event_type = 'COPY_COMPLETED'),
        judged AS (
          SELECT *, (SELECT max(config_value) FROM {config} WHERE config_key = 'atime_threshold_days') AS current_threshold
          FROM copied)
        SELECT element_handle, original_path, event_timestamp, threshold_at_offload, current_threshold
        FROM judged JOIN {registry} USING (element_handle) WHERE threshold_at_offload <> current_threshold
        ORDER BY event_timestamp DESC, event_id""",
        registry=t.asset_registry, events=t.lifecycle_events, config=latest.current_config(t.config_versions),
    )


WITNESS_SQL = """SELECT e.event_id, e.element_handle, e.source_path, e.event_timestamp,
 count(a.timestamp) AS witnesses, min(a.timestamp) AS first_witness, max(a.timestamp) AS last_witness
 FROM lifecycle_events e LEFT JOIN audit_table a ON a.object_path = e.source_path
 AND a.operation IN ({operations}) AND a.timestamp BETWEEN e.event_timestamp - INTERVAL '{span}'
 AND e.event_timestamp + INTERVAL '{span}'
 WHERE e.event_type = '{kind}' GROUP BY ALL"""


@query("audit_corroborate",
       WITNESS_SQL.format(operations="'GetObject'", span="1 DAY", kind="COPY_COMPLETED"), EV, "audit_table")
def _(t):
    return reconcile.audit_corroborate(
        t.lifecycle_events, t.audit_table, C.COPY_COMPLETED, ("GetObject",), "1 DAY"
    )


@query("audit_corroborate_deletes",
       WITNESS_SQL.format(operations="'DeleteObject'", span="3 DAY", kind="LOCAL_DELETED"), EV, "audit_table")
def _(t):
    return reconcile.audit_corroborate(
        t.lifecycle_events, t.audit_table, C.LOCAL_DELETED, ("DeleteObject",), "3 DAY"
    )


@query("uncorroborated_copies",
       """SELECT e.event_id, e.element_handle, e.source_path, e.event_timestamp FROM lifecycle_events e
       WHERE e.event_type = 'COPY_COMPLETED' AND NOT EXISTS (SELECT 1 FROM audit_table a
       WHERE a.object_path = e.source_path AND a.operation = 'GetObject'
       AND a.timestamp BETWEEN e.event_timestamp - INTERVAL '1 DAY' AND e.event_timestamp + INTERVAL '1 DAY')""",
       EV, "audit_table")
def _(t):
    seen = reconcile.audit_corroborate(
        t.lifecycle_events, t.audit_table, C.COPY_COMPLETED, ("GetObject",), "1 DAY"
    )
    return reconcile.uncorroborated(seen)


MISMATCHED_SQL = "SELECT element_handle FROM lifecycle_events WHERE event_type = 'CHECKSUM_MISMATCH'"


@query("retry_set", f"SELECT * FROM asset_registry WHERE element_handle IN ({MISMATCHED_SQL})", REG, EV)
def _(t):
    return changes.retry_set(t.asset_registry, t.lifecycle_events)


@query("retry_reset", f"SELECT * FROM asset_registry WHERE element_handle NOT IN ({MISMATCHED_SQL})", REG, EV)
def _(t):
    return changes.retry_reset(t.asset_registry, t.lifecycle_events)


@query("orphan_events",
       """SELECT event_id, element_handle, registration_id, event_type, event_timestamp FROM lifecycle_events e
       WHERE registration_id IS DISTINCT FROM 'dry-run' AND NOT EXISTS (SELECT 1 FROM registry_with_gaps a
       WHERE a.element_handle = e.element_handle AND a.registration_id = e.registration_id)""", "registry_with_gaps", EV)
def _(t):
    return reconcile.orphan_events(t.lifecycle_events, t.registry_with_gaps)


@query("layer_reconcile",
       """SELECT path, in_registry, in_catalog, in_destination, audit_reads, audit_writes, location, handle,
       one_handle, md5_agrees, CASE
       WHEN NOT in_registry AND in_destination THEN 'REGISTRY_LOST'
       WHEN claimed AND NOT in_destination THEN 'COPY_LOST'
       WHEN claimed AND NOT coalesce(md5_agrees, FALSE) THEN 'COPY_DIFFERS'
       WHEN claimed AND audit_reads = 0 THEN 'NOT_WITNESSED'
       WHEN claimed THEN 'CONFIRMED'
       WHEN in_destination THEN 'COPY_NOT_RECORDED'
       WHEN in_registry THEN 'LOCAL_ONLY'
       WHEN in_catalog THEN 'NOT_TIERED' ELSE 'AUDIT_ONLY' END AS verdict
       FROM (SELECT coalesce(r.original_path, c.path, d.original_path, a.object_path) AS path,
         r.original_path IS NOT NULL AS in_registry, c.path IS NOT NULL AS in_catalog,
         d.original_path IS NOT NULL AS in_destination,
         coalesce(a.reads, 0) AS audit_reads, coalesce(a.writes, 0) AS audit_writes,
         r.current_location AS location,
         least(r.element_handle, c.handle, d.element_handle) AS handle,
         least(r.element_handle, c.handle, d.element_handle)
           = greatest(r.element_handle, c.handle, d.element_handle) AS one_handle,
         r.destination_md5 = d.source_md5 AS md5_agrees,
         r.original_path IS NOT NULL AND coalesce(r.current_location IN ('AWS', 'BOTH', 'LOCAL_DELETED'), FALSE)
           AS claimed
         FROM asset_registry r
         FULL JOIN (SELECT *, concat(parent_path, '/', name) AS path FROM catalog_earlier) c
           ON c.path = r.original_path
         FULL JOIN dest_with_extras d ON d.original_path = coalesce(r.original_path, c.path)
         FULL JOIN (SELECT object_path,
             CAST(sum(CASE WHEN operation = 'GetObject' THEN 1 ELSE 0 END) AS BIGINT) AS reads,
             CAST(sum(CASE WHEN operation = 'PutObject' THEN 1 ELSE 0 END) AS BIGINT) AS writes
             FROM audit_table GROUP BY object_path) a
           ON a.object_path = coalesce(r.original_path, c.path, d.original_path))""",
       REG, "catalog_earlier", "dest_with_extras", "audit_table")
def _(t):
    return reconcile.layer_reconcile(t.asset_registry, t.catalog_earlier, t.audit_table, t.dest_with_extras)


# Checksums of object bodies

@query("md5", "SELECT handle, md5(body) AS md5 FROM source_objects", "source_objects")
def _(t):
    return t.source_objects.select("handle", F.md5("body").alias("md5"))


@query("object_checksums", "SELECT handle, key, md5(body) AS md5 FROM source_objects", "source_objects")
def _(t):
    return objects.body_digests(t.source_objects)


@query("checksum_verify",
       """SELECT s.handle, s.key, md5(s.body) AS source_md5, md5(d.body) AS destination_md5,
       CASE WHEN d.key IS NULL THEN 'MISSING' WHEN md5(s.body) = md5(d.body) THEN 'VERIFIED' ELSE 'MISMATCH' END
       AS status FROM source_objects s LEFT JOIN dest_objects d ON s.key = d.key""",
       "source_objects", "dest_objects")
def _(t):
    return reconcile.checksum_verify(
        objects.body_digests(t.source_objects), objects.body_digests(t.dest_objects)
    )


# State by history

STATE_SQL = """SELECT event_id, element_handle, event_type, event_timestamp, CASE event_type
 WHEN 'REGISTERED' THEN 'LOCAL' WHEN 'COPY_COMPLETED' THEN 'BOTH' WHEN 'LOCAL_DELETED' THEN 'LOCAL_DELETED'
 WHEN 'RECALLED' THEN 'RECALLED' END AS to_state FROM lifecycle_events"""


@query("state_replay",
       """SELECT *, coalesce((from_state IS NULL AND to_state = 'LOCAL') OR (from_state, to_state) IN (
       ('LOCAL', 'BOTH'), ('BOTH', 'LOCAL_DELETED'), ('LOCAL_DELETED', 'RECALLED'), ('RECALLED', 'BOTH'),
       ('BOTH', 'AWS')), FALSE) AS legal FROM (
       SELECT *, lag(to_state) OVER (PARTITION BY element_handle ORDER BY event_timestamp, event_id) AS from_state
       FROM states WHERE to_state IS NOT NULL)""", EV, extra={"states": STATE_SQL})
def _(t):
    return reconcile.state_replay(t.lifecycle_events)


LAST_SQL = """SELECT element_handle, to_state AS replayed_location FROM (SELECT *, row_number() OVER (
 PARTITION BY element_handle ORDER BY event_timestamp DESC, event_id DESC) AS rn FROM states
 WHERE to_state IS NOT NULL) WHERE rn = 1"""


@query("registry_vs_replay",
       """SELECT coalesce(a.element_handle, r.element_handle) AS element_handle, current_location, replayed_location,
       current_location IS NOT DISTINCT FROM replayed_location AS agrees
       FROM asset_registry a FULL JOIN replayed r ON a.element_handle = r.element_handle""",
       REG, EV, extra={"states": STATE_SQL, "replayed": LAST_SQL})
def _(t):
    return reconcile.registry_vs_replay(t.asset_registry, t.lifecycle_events)
