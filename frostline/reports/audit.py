"""Reports on the protocol audit log."""

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostline.functions.times import ntz
from frostline.reports.common import since

COLUMNS = ("timestamp", "protocol", "operation", "object_path", "user_name", "bytes")
_ORDER = ("object_path", "operation", "protocol", "user_name", "bytes")


def audit_for_path(
    audit: DataFrame, pattern: str, start: datetime | None = None, end: datetime | None = None,
    operations: tuple[str, ...] = (),
) -> DataFrame:
    """Audit rows whose path fits a LIKE pattern, within a closed time range, by time."""
    rows = audit.where(F.col("object_path").like(pattern))
    if start is not None:
        rows = rows.where(F.col("timestamp") >= ntz(start))
    if end is not None:
        rows = rows.where(F.col("timestamp") <= ntz(end))
    if operations:
        rows = rows.where(F.col("operation").isin(*operations))
    return rows.select(*COLUMNS).orderBy("timestamp", *_ORDER)


def audit_recent(audit: DataFrame, as_of: datetime, hours: float = 1, limit: int | None = None) -> DataFrame:
    rows = audit.where(since("timestamp", as_of, hours=hours)).select(*COLUMNS)
    ordered = rows.orderBy(F.col("timestamp").desc(), *_ORDER)
    return ordered if limit is None else ordered.limit(limit)


def audit_count_recent(
    audit: DataFrame, as_of: datetime, hours: float = 1, operation: str = "%", path: str = "%"
) -> DataFrame:
    """Audit rows of the last hours, optionally of operations and paths that fit LIKE patterns."""
    rows = audit.where(since("timestamp", as_of, hours=hours))
    if operation != "%":
        rows = rows.where(F.col("operation").like(operation))
    if path != "%":
        rows = rows.where(F.col("object_path").like(path))
    return rows.agg(F.count("*").alias("entries"))
