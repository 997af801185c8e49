"""Queries on lifecycle events and on the audit log."""

from datetime import datetime

from pyspark.sql import functions as F

from frostline import constants as C
from frostline.functions import notes, settings, times
from frostline.reports import audit, events
from frostline.sources.shared import scratch_dir
from frostline.streaming import alerts
from frostline.workload import fixtures
from frostline.workload.fixtures import AS_OF, AS_OF_SQL
from frostline.workload.registered import query
from frostline.workload.registry_queries import ELEMENT

E_ = "lifecycle_events"
RUN = "schedule-2024-01-30"
SOURCE_PATH = "/tenant/src7/y3/f_7.txt"


def _last(hours: int) -> str:
    return f"event_timestamp > {AS_OF_SQL} - INTERVAL '{hours}' HOUR"


@query("scan_events",
       """SELECT event_type, event_timestamp, source_path, destination_path, success, checksum_value, error_message
       FROM lifecycle_events WHERE element_handle IN
       (SELECT element_handle FROM asset_registry WHERE current_location = 'LOCAL')""", E_, "asset_registry")
def _(t):
    still_local = t.asset_registry.where(F.col("current_location") == C.LOCAL)
    return events.of_element(t.lifecycle_events, still_local)


HISTORY_SQL = ", ".join(events.HISTORY)


@query("lifecycle_history", f"SELECT {HISTORY_SQL} FROM lifecycle_events WHERE element_handle = '{ELEMENT}'", E_)
def _(t):
    return events.lifecycle_history(t.lifecycle_events, ELEMENT)


@query("lifecycle_histories",
       f"""SELECT element_handle, {HISTORY_SQL} FROM lifecycle_events WHERE element_handle IN
       (SELECT element_handle FROM asset_registry WHERE current_location = 'LOCAL_DELETED')""",
       E_, "asset_registry")
def _(t):
    gone = t.asset_registry.where(F.col("current_location") == C.LOCAL_DELETED)
    return events.lifecycle_histories(t.lifecycle_events, gone)


@query("lifecycle_by_source_path",
       f"""SELECT event_id, event_type, event_timestamp, source_path, success, error_message
       FROM lifecycle_events WHERE source_path = '{SOURCE_PATH}'""", E_)
def _(t):
    return events.lifecycle_by_source_path(t.lifecycle_events, SOURCE_PATH)


@query("history_status",
       """SELECT event_id, event_type, event_timestamp,
       CASE success WHEN TRUE THEN 'OK' WHEN FALSE THEN 'FAIL' ELSE '--' END AS status FROM lifecycle_events""", E_)
def _(t):
    return events.history_status(t.lifecycle_events)


FAILED_SQL = """SELECT event_id, element_handle, event_type, event_timestamp, source_path, error_message,
 pipeline_run_id FROM lifecycle_events WHERE success = FALSE ORDER BY event_timestamp DESC, event_id"""


@query("failed_events", f"{FAILED_SQL} LIMIT 100", E_)
def _(t):
    return events.failed_events(t.lifecycle_events, 100)


@query("failed_events_all", FAILED_SQL, E_)
def _(t):
    return events.failed_events(t.lifecycle_events)


@query("failures_recent",
       f"""SELECT event_id, event_timestamp, event_type, source_path, error_message FROM lifecycle_events
       WHERE success = FALSE AND {_last(24)} ORDER BY event_timestamp DESC, event_id LIMIT 20""", E_)
def _(t):
    return events.failures_recent(t.lifecycle_events, AS_OF, limit=20)


BY_TYPE_SQL = """SELECT event_id, element_handle, source_path, checksum_value, error_message, event_timestamp
 FROM lifecycle_events WHERE event_type = '{kind}' ORDER BY event_timestamp DESC, event_id"""


def _register_failures():
    for name, kind, limit in (
        ("failed_by_type", C.COPY_FAILED, 10),
        ("failed_checksums", C.CHECKSUM_MISMATCH, None),
        ("failed_deletes", C.LOCAL_DELETE_FAILED, 10),
    ):
        sql = BY_TYPE_SQL.format(kind=kind) + (f" LIMIT {limit}" if limit else "")
        query(name, sql, E_)(lambda t, kind=kind, limit=limit: events.failed_by_type(t.lifecycle_events, kind, limit))


_register_failures()


@query("recent_scans",
       """SELECT event_id, event_type, event_timestamp, source_path, error_message FROM lifecycle_events
       WHERE event_type IN ('REGISTERED', 'SCANNED') ORDER BY event_timestamp DESC, event_id LIMIT 20""", E_)
def _(t):
    return events.recent_scans(t.lifecycle_events, 20)


@query("run_events",
       f"""SELECT event_type, event_timestamp, element_handle, source_path, success, error_message
       FROM lifecycle_events WHERE pipeline_run_id = '{RUN}'""", E_)
def _(t):
    return events.run_events(t.lifecycle_events, RUN)


CONFIG_AT_SQL = """SELECT event_id, element_handle, event_type, event_timestamp,
 json_extract_string(config_snapshot, '$.atime_threshold_days') AS threshold,
 json_extract_string(config_snapshot, '$.auto_delete_local') AS auto_delete,
 json_extract_string(config_snapshot, '$.target_aws_bucket') AS bucket,
 json_extract_string(config_snapshot, '$.verify_checksum') AS verify_checksum
 FROM lifecycle_events WHERE event_type = '{kind}'"""


@query("config_at_evaluation", CONFIG_AT_SQL.format(kind="THRESHOLD_EVALUATED"), E_)
def _(t):
    return events.config_at_event(t.lifecycle_events, C.THRESHOLD_EVALUATED)


@query("config_at_offload", CONFIG_AT_SQL.format(kind="COPY_COMPLETED"), E_)
def _(t):
    return events.config_at_event(t.lifecycle_events, C.COPY_COMPLETED)


@query("json_field",
       """SELECT event_id, json_extract_string(config_snapshot, '$.atime_threshold_days') AS threshold,
       json_extract_string(config_snapshot, '$.no_such_key') AS absent FROM lifecycle_events""", E_)
def _(t):
    snapshot = F.col("config_snapshot")
    return t.lifecycle_events.select(
        "event_id",
        settings.json_field(snapshot, "atime_threshold_days").alias("threshold"),
        settings.json_field(snapshot, "no_such_key").alias("absent"),
    )


@query("events_by_type",
       """SELECT event_type, count(*) AS event_count, min(event_timestamp) AS earliest,
       max(event_timestamp) AS latest FROM lifecycle_events GROUP BY event_type""", E_)
def _(t):
    return events.by_type(t.lifecycle_events)


@query("stats_events",
       """SELECT coalesce(nullif(event_type, ''), 'UNKNOWN') AS event_type, count(*) AS event_count
       FROM lifecycle_events GROUP BY 1""", E_)
def _(t):
    return events.stats_events(t.lifecycle_events)


def _register_recent():
    for name, hours in (("events_by_type_recent", 24), ("events_by_type_last_hour", 1)):
        sql = f"""SELECT event_type, count(*) AS event_count, max(event_timestamp) AS latest
        FROM lifecycle_events WHERE {_last(hours)} GROUP BY event_type"""
        query(name, sql, E_)(lambda t, hours=hours: events.by_type_recent(t.lifecycle_events, AS_OF, hours))
    for name, hours in (("failure_count_recent", 24), ("failure_count_last_hour", 1)):
        sql = f"SELECT count(*) AS failures FROM lifecycle_events WHERE success = FALSE AND {_last(hours)}"
        query(name, sql, E_)(lambda t, hours=hours: events.failure_count_recent(t.lifecycle_events, AS_OF, hours))


_register_recent()

ERRORS_SQL = """SELECT event_type, count(*) AS error_count, max(event_timestamp) AS last_error
 FROM lifecycle_events WHERE success = FALSE{recent} GROUP BY event_type"""


@query("errors_by_type", ERRORS_SQL.format(recent=f" AND {_last(7 * 24)}"), E_)
def _(t):
    return events.errors_by_type(t.lifecycle_events, AS_OF)


@query("errors_by_type_ever", ERRORS_SQL.format(recent=""), E_)
def _(t):
    return events.errors_by_type(t.lifecycle_events)


@query("offload_volume_by_day",
       """SELECT CAST(CAST(event_timestamp AS DATE) AS VARCHAR) AS offload_date, count(*) AS files_offloaded,
       CAST(sum(file_size_bytes) AS BIGINT) AS bytes_offloaded FROM lifecycle_events
       WHERE event_type = 'COPY_COMPLETED' AND success = TRUE GROUP BY 1 ORDER BY 1 DESC LIMIT 30""", E_)
def _(t):
    days = events.offload_volume_by_day(t.lifecycle_events, 30)
    return days.withColumn("offload_date", F.col("offload_date").cast("string"))


@query("run_summary",
       """SELECT pipeline_run_id, count(*) AS total_events,
       count(CASE WHEN event_type = 'REGISTERED' THEN 1 END) AS discovered,
       count(CASE WHEN event_type = 'COPY_COMPLETED' THEN 1 END) AS copied,
       count(CASE WHEN success = FALSE THEN 1 END) AS failures
       FROM lifecycle_events GROUP BY pipeline_run_id""", E_)
def _(t):
    return events.run_summary(t.lifecycle_events)


@query("daily_dashboard",
       f"""SELECT CAST(CAST(event_timestamp AS DATE) AS VARCHAR) AS day, count(DISTINCT pipeline_run_id) AS runs,
       count(CASE WHEN event_type = 'REGISTERED' THEN 1 END) AS discovered,
       count(CASE WHEN event_type = 'COPY_COMPLETED' THEN 1 END) AS offloaded,
       count(CASE WHEN event_type = 'LOCAL_DELETED' THEN 1 END) AS purged,
       count(CASE WHEN success = FALSE THEN 1 END) AS errors
       FROM events_twice_a_day WHERE {_last(7 * 24)} GROUP BY 1""", "events_twice_a_day")
def _(t):
    days = events.daily_dashboard(t.events_twice_a_day, AS_OF)
    return days.withColumn("day", F.col("day").cast("string"))


# A run lasts from its first start to its last completion; both kinds of events count as copies.
STARTS_SQL = f"""SELECT pipeline_run_id, epoch_us(min(event_timestamp)) AS began, count(*) AS n FROM lifecycle_events
 WHERE event_type = 'COPY_STARTED' AND {_last(7 * 24)} GROUP BY pipeline_run_id"""
ENDS_SQL = f"""SELECT pipeline_run_id, epoch_us(max(event_timestamp)) AS ended, count(*) AS n FROM lifecycle_events
 WHERE event_type = 'COPY_COMPLETED' AND {_last(7 * 24)} GROUP BY pipeline_run_id"""


@query("copy_minutes_per_file",
       """SELECT coalesce(s.pipeline_run_id, e.pipeline_run_id) AS pipeline_run_id,
       coalesce(s.n, 0) + coalesce(e.n, 0) AS files_copied,
       round((ended - began) / 60e6 / (coalesce(s.n, 0) + coalesce(e.n, 0)), 2) AS avg_mins_per_file
       FROM starts s FULL JOIN ends e ON s.pipeline_run_id = e.pipeline_run_id
       ORDER BY 1 DESC LIMIT 10""", E_, extra={"starts": STARTS_SQL, "ends": ENDS_SQL})
def _(t):
    return events.copy_minutes_per_file(t.lifecycle_events, AS_OF, limit=10)


@query("copies_by_target",
       """SELECT aws_bucket, aws_key, count(*) AS copies FROM lifecycle_events
       WHERE event_type = 'COPY_COMPLETED' GROUP BY aws_bucket, aws_key
       ORDER BY copies DESC, aws_bucket, aws_key LIMIT 5""", E_)
def _(t):
    return events.copies_by_target(t.lifecycle_events, 5)


def _register_type_counts():
    for name, kind in (("event_type_count", C.SCANNED), ("mismatch_count", C.CHECKSUM_MISMATCH)):
        sql = f"SELECT count(*) AS event_count FROM lifecycle_events WHERE event_type = '{kind}'"
        query(name, sql, E_)(lambda t, kind=kind: events.event_type_count(t.lifecycle_events, kind))


_register_type_counts()


@query("missed_run_alert",
       f"""SELECT max(event_timestamp) AS latest_event,
       coalesce(max(event_timestamp) <= {AS_OF_SQL} - INTERVAL '25' HOUR, TRUE) AS missed
       FROM lifecycle_events WHERE event_timestamp <= {AS_OF_SQL}""", E_)
def _(t):
    return events.missed_run_alert(t.lifecycle_events, AS_OF)


# Scalar rules, over whole columns

@query("days_since",
       f"""SELECT event_id, CAST(floor((epoch_us({AS_OF_SQL} - INTERVAL '15' DAY) - epoch_us(event_timestamp))
       / 86400000000.0::DOUBLE) AS INT) AS days FROM lifecycle_events""", E_)
def _(t):
    moment = times.before(AS_OF, days=15)
    return t.lifecycle_events.select("event_id", times.days_since(F.col("event_timestamp"), moment).alias("days"))


ISO_SQL = """strftime({0}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us({0}) % 1000000 = 0 THEN ''
 ELSE '.' || strftime({0}, '%f') END"""
AGE_SQL = f"CAST(CAST(floor((epoch_us({AS_OF_SQL}) - epoch_us(event_timestamp)) / 86400000000.0::DOUBLE) AS INT) AS VARCHAR)"


@query("threshold_message",
       f"""SELECT event_id, 'atime=' || {ISO_SQL.format('event_timestamp')} || ', threshold=60d, age=' || {AGE_SQL}
       || 'd' AS note FROM lifecycle_events""", E_)
def _(t):
    at = F.col("event_timestamp")
    note = notes.threshold_note(at, 60, times.days_since(at, times.ntz(AS_OF)))
    return t.lifecycle_events.select("event_id", note.alias("note"))


@query("dry_run_message",
       f"SELECT event_id, 'DRY_RUN: age=' || {AGE_SQL} || 'd, threshold=60d' AS note FROM lifecycle_events", E_)
def _(t):
    age = times.days_since(F.col("event_timestamp"), times.ntz(AS_OF))
    return t.lifecycle_events.select("event_id", notes.dry_run_note(60, age).alias("note"))


@query("mismatch_message",
       "SELECT element_handle, 'src=' || source_md5 || ' dst=' || destination_md5 AS note FROM asset_registry",
       "asset_registry")
def _(t):
    note = notes.mismatch_note(F.col("source_md5"), F.col("destination_md5"))
    return t.asset_registry.select("element_handle", note.alias("note"))


@query("purge_abort_message",
       """SELECT element_handle, 'AWS copy not found at s3://' || current_aws_bucket || '/' || current_aws_key
       || ', aborting local delete for safety' AS note FROM asset_registry""", "asset_registry")
def _(t):
    note = notes.purge_abort_note(F.col("current_aws_bucket"), F.col("current_aws_key"))
    return t.asset_registry.select("element_handle", note.alias("note"))


@query("run_id", "SELECT event_id, 'schedule-' || strftime(event_timestamp, '%Y%m%d-%H%M%S') AS run_id FROM lifecycle_events",
       E_)
def _(t):
    return t.lifecycle_events.select("event_id", times.run_id_at(F.col("event_timestamp")).alias("run_id"))


# Audit log

AUDIT_SQL = "SELECT timestamp, protocol, operation, object_path, user_name, bytes FROM audit_table"
FROM, TO = datetime(2024, 1, 10), datetime(2024, 1, 20)


@query("scan_audit",
       f"""{AUDIT_SQL} WHERE object_path LIKE '/tenant/src1/%'
       AND timestamp BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00'""", "audit_table")
def _(t):
    return audit.audit_for_path(t.audit_table, "/tenant/src1/%", FROM, TO)


@query("audit_for_path",
       f"{AUDIT_SQL} WHERE object_path LIKE '%.pdf' AND operation IN ('GetObject', 'PutObject')", "audit_table")
def _(t):
    return audit.audit_for_path(t.audit_table, "%.pdf", operations=("GetObject", "PutObject"))


@query("scan_audit_recent",
       f"""{AUDIT_SQL} WHERE timestamp > {AS_OF_SQL} - INTERVAL '1' HOUR
       ORDER BY timestamp DESC, object_path, operation, protocol, user_name, bytes LIMIT 10""", "audit_table")
def _(t):
    return audit.audit_recent(t.audit_table, AS_OF, limit=10)


@query("audit_count_recent",
       f"""SELECT count(*) AS entries FROM audit_table WHERE timestamp > {AS_OF_SQL} - INTERVAL '1' HOUR
       AND operation LIKE '%GetObject%' AND object_path LIKE '%/f_1%'""", "audit_table")
def _(t):
    return audit.audit_count_recent(t.audit_table, AS_OF, operation="%GetObject%", path="%/f_1%")


@query("audit_entries_last_hour",
       f"SELECT count(*) AS entries FROM audit_table WHERE timestamp > {AS_OF_SQL} - INTERVAL '1' HOUR", "audit_table")
def _(t):
    return audit.audit_count_recent(t.audit_table, AS_OF)


# Alerts

@query("failure_alert_feed",
       """SELECT event_id, element_handle, event_type, event_timestamp, source_path, error_message, pipeline_run_id
       FROM lifecycle_events WHERE success = FALSE""", E_)
def _(t):
    """The event table read as a stream; the alerts that reached the sink."""
    schema = t.spark.read.parquet(f"{t.sf_dir}/events.parquet").schema
    stream = alerts.event_stream(t.spark, t.sf_dir, schema, name_pattern="events.parquet")
    folder = scratch_dir(t.spark, "alerts")
    failures = alerts.failure_alerts(fixtures.derive(stream, E_))
    alerts.deliver(failures, f"{folder}/out", f"{folder}/progress")
    return alerts.delivered(t.spark, f"{folder}/out", failures.schema)
