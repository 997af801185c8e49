"""Queries on configuration and its changes."""

from datetime import datetime

from pyspark.sql import functions as F

from frostline import constants as C
from frostline.functions.times import ntz
from frostline.operators import latest
from frostline.plans import config as changes
from frostline.reports import config
from frostline.workload.fixtures import AS_OF, AS_OF_SQL
from frostline.workload.registered import query

V, LOG = "config_versions", "config_change_log"
CURRENT_SQL = """SELECT config_key, config_value, updated_by, updated_at, change_reason FROM (
 SELECT *, row_number() OVER (PARTITION BY config_key ORDER BY updated_at DESC, config_value DESC) AS rn
 FROM config_versions) WHERE rn = 1"""
CURRENT = {"current": CURRENT_SQL}
# The default configuration.
DEFAULTS_SQL = """SELECT * FROM (VALUES
 ('atime_threshold_days', '60'), ('target_aws_bucket', 'corp-cold-tier'), ('target_aws_region', 'us-east-1'),
 ('target_aws_storage_class', 'INTELLIGENT_TIERING'), ('source_paths', '/tenant/projects,/tenant/media'),
 ('auto_delete_local', 'false'), ('dry_run', 'true'), ('batch_size', '500'), ('verify_checksum', 'true')
 ) AS d(config_key, config_value)"""
WITH_DEFAULTS = CURRENT | {"defaults": DEFAULTS_SQL}
KEY = "atime_threshold_days"


def _current(t):
    return latest.current_config(t.config_versions)


@query("current_config", "SELECT * FROM current", V, extra=CURRENT)
def _(t):
    return _current(t)


SEED_SQL = f"""SELECT config_key, config_value, 'system' AS updated_by, {AS_OF_SQL} AS updated_at,
 'Initial setup' AS change_reason FROM defaults WHERE config_key NOT IN (SELECT config_key FROM current)"""


@query("seed_config", SEED_SQL, V, extra=WITH_DEFAULTS)
def _(t):
    return changes.seed_rows(t.spark, _current(t), ntz(AS_OF))


def _seeded(t):
    return _current(t).unionByName(changes.seed_rows(t.spark, _current(t), ntz(AS_OF)))


SEEDED = WITH_DEFAULTS | {"seeded": f"SELECT * FROM current UNION ALL {SEED_SQL}"}


@query("config_list", "SELECT * FROM seeded ORDER BY config_key", V, extra=SEEDED)
def _(t):
    return config.config_list(_seeded(t))


@query("scan_config", "SELECT config_key, config_value FROM seeded", V, extra=SEEDED)
def _(t):
    return _seeded(t).select("config_key", "config_value")


@query("config_values_in",
       "SELECT config_key, config_value FROM seeded WHERE config_key IN ('source_paths', 'batch_size', 'dry_run')",
       V, extra=SEEDED)
def _(t):
    return config.config_values_in(_seeded(t), ["source_paths", "batch_size", "dry_run"])


@query("missing_config_keys",
       "SELECT config_key FROM defaults WHERE config_key NOT IN (SELECT config_key FROM current)", V,
       extra=WITH_DEFAULTS)
def _(t):
    return changes.missing_keys(t.spark, _current(t))


@query("unseeded_keys",
       "SELECT config_key, config_value FROM defaults WHERE config_key NOT IN"
       " (SELECT config_key FROM config_versions WHERE config_key IS NOT NULL)", V, extra=WITH_DEFAULTS)
def _(t):
    return changes.seed_rows(t.spark, t.config_versions, ntz(AS_OF)).select("config_key", "config_value")


@query("parse_config",
       """SELECT config_key, config_value, updated_at,
       CASE WHEN config_key IN ('atime_threshold_days', 'batch_size') THEN TRY_CAST(trim(config_value) AS INT) END
         AS int_value,
       CASE WHEN config_key IN ('auto_delete_local', 'dry_run', 'verify_checksum')
         THEN lower(config_value) = 'true' END AS bool_value,
       CASE WHEN config_key = 'source_paths' THEN array_to_string(
         list_transform(string_split(config_value, ','), lambda p: trim(p)), '|') END AS list_value
       FROM (SELECT config_key, config_value, updated_at FROM config_versions
       UNION ALL SELECT config_key, config_value, updated_at FROM seeded WHERE updated_by = 'system')""",
       V, extra=SEEDED)
def _(t):
    return config.typed_values(
        t.config_versions.unionByName(changes.seed_rows(t.spark, _current(t), ntz(AS_OF)))
    )


@query("scan_change_log",
       "SELECT config_key, old_value, new_value, changed_by, changed_at, change_reason FROM config_change_log", LOG)
def _(t):
    return config.change_log(t.config_change_log)


@query("config_changes", "SELECT * FROM config_change_log ORDER BY changed_at DESC, change_id LIMIT 50", LOG)
def _(t):
    return config.config_changes(t.config_change_log, 50)


@query("config_changes_for_key",
       f"""SELECT change_id, old_value, new_value, changed_by, changed_at, change_reason FROM config_change_log
       WHERE config_key = '{KEY}'""", LOG)
def _(t):
    return config.config_changes_for_key(t.config_change_log, KEY)


@query("config_changes_by_user",
       """SELECT change_id, config_key, old_value, new_value, changed_at, change_reason FROM config_change_log
       WHERE changed_by = 'admin1'""", LOG)
def _(t):
    return config.config_changes_by_user(t.config_change_log, "admin1")


ON_SQL = """SELECT config_key, arg_max(new_value, rn) AS config_value FROM (SELECT *,
 row_number() OVER (ORDER BY changed_at, change_id) AS rn FROM config_change_log
 WHERE changed_at <= TIMESTAMP '2024-01-17 00:00:00') GROUP BY config_key"""


@query("config_on_date", ON_SQL, LOG)
def _(t):
    return config.config_on(t.config_change_log, datetime(2024, 1, 17))


@query("config_as_of",
       f"""SELECT e.event_id, e.element_handle, e.event_timestamp, c.new_value AS config_value
       FROM lifecycle_events e ASOF LEFT JOIN (SELECT changed_at, arg_max(new_value, change_id) AS new_value
       FROM config_change_log WHERE config_key = '{KEY}' GROUP BY changed_at) c ON e.event_timestamp >= c.changed_at""",
       "lifecycle_events", LOG)
def _(t):
    return config.config_as_of(t.lifecycle_events, t.config_change_log, KEY)


# Requests for new values come from the change log itself: what each user last asked for per key.
REQUESTS_SQL = """SELECT config_key, new_value, 'admin' AS changed_by, 'again' AS change_reason FROM (
 SELECT *, row_number() OVER (PARTITION BY config_key ORDER BY changed_at, change_id) AS rn
 FROM config_change_log) WHERE rn = 1"""
CHANGED_SQL = """SELECT r.config_key, c.config_value AS old_value, r.new_value, r.changed_by, r.change_reason
 FROM requests r JOIN current c ON r.config_key = c.config_key WHERE c.config_value IS DISTINCT FROM r.new_value"""
ID_SQL = """md5(concat_ws('|', config_key, new_value, '2024-01-31 00:00:00'))"""
UUID_SQL = """substr({0}, 1, 8) || '-' || substr({0}, 9, 4) || '-' || substr({0}, 13, 4) || '-'
 || substr({0}, 17, 4) || '-' || substr({0}, 21, 12)"""
WITH_REQUESTS = CURRENT | {"requests": REQUESTS_SQL, "changed": CHANGED_SQL}


def _requests(t):
    first = t.config_change_log.groupBy("config_key").agg(
        F.min_by("new_value", F.struct("changed_at", "change_id")).alias("new_value")
    )
    return first.select(
        "config_key", "new_value", F.lit("admin").alias("changed_by"), F.lit("again").alias("change_reason")
    )


@query("config_update",
       f"""SELECT config_key, new_value AS config_value, changed_by AS updated_by, {AS_OF_SQL} AS updated_at,
       change_reason FROM changed""", V, LOG, extra=WITH_REQUESTS)
def _(t):
    return changes.change_rows(_current(t), _requests(t), ntz(AS_OF))[0]


@query("config_update_log",
       f"""SELECT {UUID_SQL.format(ID_SQL)} AS change_id, config_key, old_value, new_value, changed_by,
       {AS_OF_SQL} AS changed_at, change_reason FROM changed""", V, LOG, extra=WITH_REQUESTS)
def _(t):
    return changes.change_rows(_current(t), _requests(t), ntz(AS_OF))[1]


@query("config_rollback",
       """SELECT config_key, old_value AS new_value, 'admin' AS changed_by, 'rollback' AS change_reason FROM (
       SELECT *, row_number() OVER (PARTITION BY config_key ORDER BY changed_at DESC, change_id DESC) AS rn
       FROM config_change_log) WHERE rn = 1""", LOG)
def _(t):
    return changes.rollback_requests(t.config_change_log, F.lit("admin"))


STORED_SQL = """SELECT e.event_id, string_agg(c.config_key || '=' || c.config_value, ';' ORDER BY c.config_key) AS settings
       FROM (SELECT event_id, json_keys(config_snapshot) AS keys, config_snapshot FROM lifecycle_events
             WHERE config_snapshot IS NOT NULL) e,
       LATERAL (SELECT unnest(e.keys) AS config_key,
                json_extract_string(e.config_snapshot, '$.' || unnest(e.keys)) AS config_value) c
       GROUP BY e.event_id"""
# Every key's latest value at the end of each day. The values here need no escapes.
BUILT_SQL = """SELECT day, '{' || string_agg('"' || config_key || '": "' || config_value || '"', ', ' ORDER BY config_key)
 || '}' AS built FROM (
   SELECT d.day, v.config_key, arg_max(v.config_value, (v.updated_at, v.config_value)) AS config_value
   FROM (SELECT CAST(unnest(generate_series(min(updated_at)::DATE, max(updated_at)::DATE, INTERVAL 1 DAY)) AS DATE) AS day
         FROM config_versions) d
   JOIN config_versions v ON CAST(v.updated_at AS DATE) <= d.day GROUP BY d.day, v.config_key) GROUP BY day"""


@query("config_snapshot",
       """SELECT e.event_id, s.settings, b.built FROM lifecycle_events e LEFT JOIN stored s ON e.event_id = s.event_id
       LEFT JOIN built b ON b.day = least(CAST(e.event_timestamp AS DATE), (SELECT max(day) FROM built))""",
       "lifecycle_events", V, extra={"stored": STORED_SQL, "built": BUILT_SQL})
def _(t):
    """The snapshot that each event carries, and the one built from the configuration's versions."""
    return config.event_snapshots(t.lifecycle_events, t.config_versions)


@query("config_snapshot_by_day", "SELECT day, built AS snapshot FROM built", V, extra={"built": BUILT_SQL})
def _(t):
    return config.daily_snapshots(t.config_versions)
