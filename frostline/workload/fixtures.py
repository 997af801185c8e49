"""Tiering tables derived from the driver's tables, once for Spark and once as SQL.

Both sides share the same expressions, so that Spark and the SQL check see equal rows.
"""

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

AS_OF = datetime(2024, 1, 31)
AS_OF_SQL = "TIMESTAMP '2024-01-31 00:00:00'"


def handle(key: str) -> str:
    return f"concat('0x', lpad(CAST({key} AS STRING), 16, '0'))"


def folder(key: str) -> str:
    year = f"CASE WHEN {key} % 3 = 0 THEN '' ELSE concat('/y', CAST({key} % 4 AS STRING)) END"
    return f"concat('/tenant/src', CAST({key} % 20 AS STRING), {year})"


def file_name(key: str) -> str:
    end = f"CASE {key} % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.xlsx' WHEN 2 THEN '.mp4' ELSE '.txt' END"
    return f"concat('f_', CAST({key} AS STRING), {end})"


def path(key: str) -> str:
    return f"concat({folder(key)}, '/', {file_name(key)})"


def key_of(key: str) -> str:
    return f"regexp_replace({path(key)}, '^/+', '')"


def atime(key: str) -> str:
    return (
        f"{AS_OF_SQL} - INTERVAL '1' DAY * CAST({key} % 120 AS INT)"
        f" - INTERVAL '1' SECOND * CAST({key} % 86400 AS INT)"
    )


_KIND = "event_id % 13"
_COPIED = "c_custkey % 5 IN (1, 2, 3)"

_DOCUMENT_FOLDER = "concat('/tenant/', coalesce(source, 'none'), '/', coalesce(lang, 'none'))"
_DOCUMENT_NAME = "concat('d_', CAST(doc_id AS STRING), '.txt')"
_DOCUMENT_PATH = f"concat({_DOCUMENT_FOLDER}, '/', {_DOCUMENT_NAME})"
_DOCUMENT_KEY = f"regexp_replace({_DOCUMENT_PATH}, '^/+', '')"

# name: (driver table, filter, [(expression, column)])
TABLES = {
    "catalog_snapshot": (
        "orders",
        None,
        [
            (handle("o_orderkey"), "handle"),
            (folder("o_orderkey"), "parent_path"),
            (file_name("o_orderkey"), "name"),
            ("CASE o_orderkey % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'xlsx' WHEN 2 THEN 'mp4' ELSE NULL END", "extension"),
            ("CAST(round(o_totalprice * 100) AS BIGINT)", "size"),
            (atime("o_orderkey"), "atime"),
            ("o_orderdate", "mtime"),
            ("o_orderdate - INTERVAL '30' DAY", "ctime"),
            ("CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE concat('user', CAST(o_custkey % 50 AS STRING)) END",
             "login_name"),
            ("CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE 420 END", "nfs_mode_bits"),
            ("CASE WHEN o_orderkey % 13 = 0 THEN 'DIR' ELSE 'FILE' END", "element_type"),
            ("CASE o_orderkey % 5 WHEN 1 THEN 'COPIED' WHEN 2 THEN 'PURGED' ELSE NULL END", "tag_offload_status"),
        ],
    ),
    "asset_registry": (
        "customer",
        None,
        [
            (handle("c_custkey"), "element_handle"),
            ("concat('reg-', CAST(c_custkey AS STRING))", "registration_id"),
            (path("c_custkey"), "original_path"),
            ("concat('src', CAST(c_custkey % 20 AS STRING))", "original_bucket"),
            ("concat('src', CAST(c_custkey % 20 AS STRING))", "original_view"),
            (file_name("c_custkey"), "file_name"),
            ("CASE c_custkey % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'xlsx' WHEN 2 THEN 'mp4' ELSE 'txt' END",
             "file_extension"),
            ("CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE CAST(round(abs(c_acctbal) * 1000) AS BIGINT) END",
             "file_size_bytes"),
            ("TIMESTAMP '2023-01-01 00:00:00'", "file_ctime"),
            ("TIMESTAMP '2023-02-01 00:00:00'", "file_mtime"),
            (atime("c_custkey"), "file_atime"),
            ("concat('user', CAST(c_custkey % 50 AS STRING))", "owner_uid"),
            ("concat('user', CAST(c_custkey % 50 AS STRING))", "owner_login"),
            ("420", "nfs_mode_bits"),
            ("CASE c_custkey % 5 WHEN 1 THEN 'BOTH' WHEN 2 THEN 'LOCAL_DELETED' WHEN 3 THEN 'AWS' ELSE 'LOCAL' END",
             "current_location"),
            (f"CASE WHEN {_COPIED} THEN 'corp-cold-tier' ELSE NULL END", "current_aws_bucket"),
            (f"CASE WHEN {_COPIED} THEN {key_of('c_custkey')} ELSE NULL END", "current_aws_key"),
            (f"CASE WHEN {_COPIED} THEN 'us-east-1' ELSE NULL END", "current_aws_region"),
            ("TIMESTAMP '2024-01-01 02:00:00' + INTERVAL '1' SECOND * CAST(c_custkey % 2592000 AS INT)", "registered_at"),
            ("TIMESTAMP '2024-01-02 02:00:00' + INTERVAL '1' SECOND * CAST(c_custkey % 2592000 AS INT)", "last_state_change"),
            (f"CASE WHEN {_COPIED} THEN md5(CAST(c_custkey AS STRING)) ELSE NULL END", "source_md5"),
            (f"CASE WHEN {_COPIED} THEN CASE WHEN c_custkey % 97 = 0 THEN md5('bad')"
             " ELSE md5(CAST(c_custkey AS STRING)) END ELSE NULL END", "destination_md5"),
        ],
    ),
    "lifecycle_events": (
        "events",
        None,
        [
            ("CAST(event_id AS STRING)", "event_id"),
            (handle("user_id"), "element_handle"),
            (f"CASE WHEN {_KIND} = 12 THEN 'dry-run' WHEN event_id % 211 = 0 THEN 'reg-orphan'"
             " ELSE concat('reg-', CAST(user_id AS STRING)) END", "registration_id"),
            (f"CASE {_KIND} WHEN 0 THEN 'REGISTERED' WHEN 1 THEN 'THRESHOLD_EVALUATED' WHEN 2 THEN 'COPY_STARTED'"
             " WHEN 3 THEN 'CHECKSUM_VERIFIED' WHEN 4 THEN 'COPY_COMPLETED' WHEN 5 THEN 'LOCAL_DELETE_REQUESTED'"
             " WHEN 6 THEN 'LOCAL_DELETED' WHEN 7 THEN 'COPY_STARTED' WHEN 8 THEN 'COPY_COMPLETED'"
             " WHEN 9 THEN 'COPY_FAILED' WHEN 10 THEN 'CHECKSUM_MISMATCH' WHEN 11 THEN 'LOCAL_DELETE_FAILED'"
             " ELSE 'SCANNED' END", "event_type"),
            ("ts", "event_timestamp"),
            (path("user_id"), "source_path"),
            (f"CASE WHEN {_KIND} IN (2, 4, 7, 8) THEN concat('s3://corp-cold-tier', {path('user_id')})"
             " ELSE NULL END", "destination_path"),
            (f"CASE WHEN {_KIND} BETWEEN 2 AND 11 THEN 'corp-cold-tier' ELSE NULL END", "aws_bucket"),
            (f"CASE WHEN {_KIND} BETWEEN 2 AND 11 THEN {key_of('user_id')} ELSE NULL END", "aws_key"),
            (f"CASE WHEN {_KIND} IN (0, 1, 2, 4, 7, 8, 12) THEN CAST(round(value * 1000) AS BIGINT) ELSE NULL END",
             "file_size_bytes"),
            ("CAST(NULL AS TIMESTAMP)", "file_atime"),
            ("CAST(NULL AS TIMESTAMP)", "file_mtime"),
            ("concat('schedule-', CAST(CAST(ts AS DATE) AS STRING))", "pipeline_run_id"),
            (f"CASE WHEN {_KIND} IN (0, 1, 12) THEN 'discover' WHEN {_KIND} IN (5, 6, 11) THEN 'verify_and_purge'"
             " ELSE 'offload_and_track' END", "function_name"),
            ("'SCHEDULE'", "triggered_by"),
            (f"CASE WHEN {_KIND} IN (2, 5, 7) THEN NULL WHEN {_KIND} IN (9, 10, 11) THEN FALSE ELSE TRUE END",
             "success"),
            (f"CASE WHEN {_KIND} IN (1, 12) THEN concat('age=', CAST(user_id % 120 AS STRING), 'd')"
             f" WHEN {_KIND} = 9 THEN 'Network timeout' WHEN {_KIND} = 10 THEN 'Checksum mismatch after copy'"
             f" WHEN {_KIND} = 11 THEN 'AWS copy not found' ELSE NULL END", "error_message"),
            (f"CASE WHEN {_KIND} IN (3, 4, 8) THEN md5(CAST(user_id AS STRING)) ELSE NULL END", "checksum_value"),
            ("CASE WHEN event_id % 101 = 0 THEN NULL ELSE concat('{\"atime_threshold_days\": \"',"
             " CAST(30 * (1 + event_id % 3) AS STRING), '\", \"auto_delete_local\": \"',"
             " CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END,"
             " '\", \"target_aws_bucket\": \"corp-cold-tier\", \"verify_checksum\": \"true\"}') END",
             "config_snapshot"),
        ],
    ),
    "audit_table": (
        "lineitem",
        None,
        [
            ("TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' SECOND *"
             " CAST((l_partkey * 7919 + l_suppkey * 104729 + l_linenumber * 13) % 2592000 AS INT)", "timestamp"),
            ("CASE l_linenumber % 4 WHEN 0 THEN 'NFSv3' WHEN 1 THEN 'S3' WHEN 2 THEN 'SMB' ELSE 'S3' END",
             "protocol"),
            ("CASE l_linenumber % 5 WHEN 0 THEN 'DeleteObject' WHEN 1 THEN 'GetObject' WHEN 2 THEN 'PutObject'"
             " WHEN 3 THEN 'HeadObject' ELSE 'GetObject' END", "operation"),
            (path("l_orderkey"), "object_path"),
            ("concat('user', CAST(l_suppkey % 50 AS STRING))", "user_name"),
            ("CAST(round(l_extendedprice * 100) AS BIGINT)", "bytes"),
        ],
    ),
    "config_change_log": (
        "events",
        "event_type = 'signup'",
        [
            ("CAST(event_id AS STRING)", "change_id"),
            ("CASE event_id % 3 WHEN 0 THEN 'atime_threshold_days' WHEN 1 THEN 'batch_size' ELSE 'dry_run' END",
             "config_key"),
            ("CASE event_id % 3 WHEN 2 THEN 'true' ELSE CAST(30 * (1 + event_id % 4) AS STRING) END", "old_value"),
            ("CASE event_id % 3 WHEN 2 THEN 'false' ELSE CAST(30 * (2 + event_id % 4) AS STRING) END", "new_value"),
            ("concat('admin', CAST(user_id % 3 AS STRING))", "changed_by"),
            ("ts", "changed_at"),
            ("concat('reason ', event_type)", "change_reason"),
        ],
    ),
    # The versions of the configuration that those changes wrote.
    "config_versions": (
        "events",
        "event_type = 'signup'",
        [
            ("CASE event_id % 3 WHEN 0 THEN 'atime_threshold_days' WHEN 1 THEN 'batch_size' ELSE 'dry_run' END",
             "config_key"),
            ("CASE event_id % 3 WHEN 2 THEN 'false' ELSE CAST(30 * (2 + event_id % 4) AS STRING) END",
             "config_value"),
            ("concat('admin', CAST(user_id % 3 AS STRING))", "updated_by"),
            ("ts", "updated_at"),
            ("concat('reason ', event_type)", "change_reason"),
        ],
    ),
    "source_objects": (
        "documents",
        None,
        [
            (handle("doc_id"), "handle"),
            ("concat('tenant/', source, '/', lang, '/d_', CAST(doc_id AS STRING), '.txt')", "key"),
            ("text", "body"),
        ],
    ),
    "dest_objects": (
        "documents",
        None,
        [
            ("concat(CASE WHEN doc_id % 41 = 0 THEN 'misplaced/' ELSE '' END, 'tenant/', source, '/', lang, '/d_', CAST(doc_id AS STRING), '.txt')", "key"),
            ("CASE WHEN doc_id % 37 = 0 THEN concat(text, 'x') ELSE text END", "body"),
        ],
    ),
    # Documents as files on the local store.
    "document_catalog": (
        "documents",
        None,
        [
            (handle("doc_id"), "handle"),
            (_DOCUMENT_FOLDER, "parent_path"),
            (_DOCUMENT_NAME, "name"),
            ("'txt'", "extension"),
            ("CAST(length(hex(coalesce(text, ''))) / 2 AS BIGINT)", "size"),
            (atime("doc_id"), "atime"),
            ("TIMESTAMP '2023-06-01 00:00:00' + INTERVAL '1' SECOND * CAST(doc_id % 86400 AS INT)", "mtime"),
            ("TIMESTAMP '2023-05-01 00:00:00'", "ctime"),
            ("CASE WHEN doc_id % 7 = 0 THEN NULL ELSE concat('user', CAST(doc_id % 50 AS STRING)) END", "login_name"),
            ("CASE WHEN doc_id % 9 = 0 THEN NULL ELSE 420 END", "nfs_mode_bits"),
            ("CASE WHEN doc_id % 29 = 0 THEN 'DIR' ELSE 'FILE' END", "element_type"),
            ("CAST(NULL AS STRING)", "tag_offload_status"),
        ],
    ),
    # What earlier runs registered of them, copied or not.
    "document_registry": (
        "documents",
        "doc_id % 13 = 0",
        [
            (handle("doc_id"), "element_handle"),
            ("concat('reg-', CAST(doc_id AS STRING))", "registration_id"),
            (_DOCUMENT_PATH, "original_path"),
            ("coalesce(source, 'none')", "original_bucket"),
            ("coalesce(source, 'none')", "original_view"),
            (_DOCUMENT_NAME, "file_name"),
            ("'txt'", "file_extension"),
            ("CAST(length(hex(coalesce(text, ''))) / 2 AS BIGINT)", "file_size_bytes"),
            ("TIMESTAMP '2023-05-01 00:00:00'", "file_ctime"),
            ("TIMESTAMP '2023-06-01 00:00:00'", "file_mtime"),
            (atime("doc_id"), "file_atime"),
            ("concat('user', CAST(doc_id % 50 AS STRING))", "owner_uid"),
            ("concat('user', CAST(doc_id % 50 AS STRING))", "owner_login"),
            ("420", "nfs_mode_bits"),
            ("CASE WHEN doc_id % 39 = 0 THEN 'LOCAL' ELSE 'BOTH' END", "current_location"),
            ("CASE WHEN doc_id % 39 = 0 THEN NULL ELSE 'corp-cold-tier' END", "current_aws_bucket"),
            (f"CASE WHEN doc_id % 39 = 0 THEN NULL ELSE {_DOCUMENT_KEY} END", "current_aws_key"),
            ("CASE WHEN doc_id % 39 = 0 THEN NULL ELSE 'us-east-1' END", "current_aws_region"),
            ("TIMESTAMP '2024-01-02 02:00:00'", "registered_at"),
            ("TIMESTAMP '2024-01-02 02:00:01'", "last_state_change"),
            ("CASE WHEN doc_id % 39 = 0 THEN NULL ELSE md5(coalesce(text, '')) END", "source_md5"),
            ("CASE WHEN doc_id % 39 = 0 THEN NULL ELSE md5(coalesce(text, '')) END", "destination_md5"),
        ],
    ),
    # The objects that are there when a run begins: sources still to copy, and copies of earlier runs.
    "document_sources": (
        "documents",
        "doc_id % 11 <> 0",
        [
            (handle("doc_id"), "handle"),
            (f"concat(coalesce(source, 'none'), '/', {_DOCUMENT_KEY})", "key"),
            ("coalesce(text, '')", "body"),
        ],
    ),
    "document_copies": (
        "documents",
        "doc_id % 26 = 0 AND doc_id % 39 <> 0",
        [
            (handle("doc_id"), "handle"),
            (f"concat('corp-cold-tier/', {_DOCUMENT_KEY})", "key"),
            ("coalesce(text, '')", "body"),
        ],
    ),
    # Metadata of the objects in the cold store; some lie elsewhere, some differ from the registry.
    "dest_metadata": (
        "orders",
        None,
        [
            (handle("o_orderkey"), "element_handle"),
            ("concat('reg-', CAST(o_orderkey AS STRING))", "registration_id"),
            (f"concat(CASE WHEN o_orderkey % 5 IN (0, 4) OR o_orderkey % 41 = 0 THEN '/misplaced' ELSE '' END,"
             f" {path('o_orderkey')})", "original_path"),
            ("'cluster-01'", "source_cluster"),
            ("'2024-01-02T02:00:00'", "offload_timestamp"),
            ("CASE WHEN o_orderkey % 37 = 0 THEN md5('bad') ELSE md5(CAST(o_orderkey AS STRING)) END", "source_md5"),
            ("'INTELLIGENT_TIERING'", "aws_storage_class"),
            ("'corp-cold-tier'", "aws_bucket"),
            (key_of("o_orderkey"), "aws_key"),
        ],
    ),
    # What copying the files of the catalog gave, and whether their copies were found later.
    "copy_results": (
        "orders",
        None,
        [
            (handle("o_orderkey"), "handle"),
            ("CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE md5(CAST(o_orderkey AS STRING)) END", "source_md5"),
            ("CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 17 = 0 THEN md5('bad')"
             " ELSE md5(CAST(o_orderkey AS STRING)) END", "destination_md5"),
            ("CASE WHEN o_orderkey % 11 = 0 THEN 'ERROR' WHEN o_orderkey % 17 = 0 THEN 'MISMATCH' ELSE 'COPIED' END",
             "status"),
            ("CASE WHEN o_orderkey % 11 = 0 THEN 'Network timeout' ELSE NULL END", "error"),
        ],
    ),
    "probe_results": (
        "orders",
        None,
        [
            (handle("o_orderkey"), "handle"),
            ("CASE WHEN o_orderkey % 19 = 0 THEN 'NOT_FOUND' WHEN o_orderkey % 23 = 0 THEN 'ERROR' ELSE 'FOUND' END",
             "status"),
            ("CASE WHEN o_orderkey % 23 = 0 THEN 'Access denied' ELSE NULL END", "error"),
        ],
    ),
}


def _variant(base: str, name: str, condition: str | None = None, **changed: str) -> None:
    """The same table with some rows left out and some columns changed."""
    source, earlier, columns = TABLES[base]
    both = " AND ".join(f"({c})" for c in (earlier, condition) if c)
    TABLES[name] = (source, both or None, [(changed.get(column, expr), column) for expr, column in columns])


# The catalog a while before and after: files gone, new, read meanwhile, set back, or moved.
_variant("catalog_snapshot", "catalog_earlier", "o_orderkey % 37 <> 0")
_variant(
    "catalog_snapshot", "catalog_later", "o_orderkey % 31 <> 0",
    atime=f"CASE WHEN o_orderkey % 29 = 0 THEN {AS_OF_SQL} ELSE {atime('o_orderkey')}"
          " - INTERVAL '1' DAY * CAST(CASE WHEN o_orderkey % 23 = 0 THEN 200 ELSE 0 END AS INT) END",
    parent_path=f"CASE WHEN o_orderkey % 41 = 0 THEN '/tenant/moved' ELSE {folder('o_orderkey')} END",
)
# A registry that lost some of its rows.
_variant("asset_registry", "registry_with_gaps", "c_custkey % 31 <> 0")
# Two runs a day.
_variant(
    "lifecycle_events", "events_twice_a_day",
    pipeline_run_id="concat('schedule-', CAST(CAST(ts AS DATE) AS STRING), CASE WHEN event_id % 2 = 0 THEN '-am' ELSE '-pm' END)",
)
# Cold objects that were never recorded as copies.
_variant(
    "dest_metadata", "dest_with_extras",
    original_path="concat(CASE WHEN o_orderkey % 53 <> 0 AND (o_orderkey % 5 IN (0, 4) OR o_orderkey % 41 = 0)"
                  f" THEN '/misplaced' ELSE '' END, {path('o_orderkey')})",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table as DataFrame."""
    return derive(spark.read.parquet(f"{sf_dir}/{TABLES[name][0]}.parquet"), name)


def derive(rows: DataFrame, name: str) -> DataFrame:
    """A derived table from the rows of its driver table, which may be a stream."""
    _, condition, columns = TABLES[name]
    if condition:
        rows = rows.where(condition)
    return rows.selectExpr(*[f"{_spark(expr)} AS `{column}`" for expr, column in columns])


def _spark(expr: str) -> str:
    """Spark's names for zone-less timestamps."""
    return expr.replace("TIMESTAMP '", "TIMESTAMP_NTZ '").replace("AS TIMESTAMP)", "AS TIMESTAMP_NTZ)")


def sql(name: str) -> str:
    """The same table as a SELECT statement."""
    source, condition, columns = TABLES[name]
    selected = ", ".join(f"{expr} AS {column}" for expr, column in columns)
    where = f" WHERE {condition}" if condition else ""
    return f"SELECT {selected} FROM {source}{where}"


def with_tables(query: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """A query with the derived tables (and further named SELECTs) that it uses in front."""
    parts = {name: sql(name) for name in names} | (extra or {})
    ctes = ",\n".join(f"{name} AS ({text})" for name, text in parts.items())
    return f"WITH {ctes}\n{query}"
