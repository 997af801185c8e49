"""Reports on lifecycle events.

An event failed only if success is false; unknown success is no failure, and
error_message also holds notes on events that succeeded.
"""

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostline import constants as C
from frostline.functions import notes
from frostline.functions.settings import json_field
from frostline.functions.times import before, elapsed_micros, ntz
from frostline.reports.common import count_if, newest, of_elements, since

HISTORY = (
    "event_type", "event_timestamp", "source_path", "destination_path", "aws_bucket", "aws_key",
    "success", "checksum_value", "error_message", "pipeline_run_id", "function_name",
    "triggered_by", "config_snapshot",
)


def of_element(events: DataFrame, handles: str | DataFrame) -> DataFrame:
    """Events of an element, seven columns."""
    return of_elements(events, handles).select(
        "event_type", "event_timestamp", "source_path", "destination_path",
        "success", "checksum_value", "error_message",
    )


def lifecycle_history(events: DataFrame, handle: str) -> DataFrame:
    """Everything that happened to an element, oldest first."""
    return events.where(F.col("element_handle") == handle).orderBy("event_timestamp", "event_id").select(*HISTORY)


def lifecycle_histories(events: DataFrame, handles: DataFrame) -> DataFrame:
    """The histories of many elements, ordered by element and time."""
    return (
        of_elements(events, handles)
        .orderBy("element_handle", "event_timestamp", "event_id")
        .select("element_handle", *HISTORY)
    )


def lifecycle_by_source_path(events: DataFrame, path: str) -> DataFrame:
    return (
        events.where(F.col("source_path") == path)
        .orderBy("event_timestamp", "event_id")
        .select("event_id", "event_type", "event_timestamp", "source_path", "success", "error_message")
    )


def history_status(events: DataFrame) -> DataFrame:
    return events.select("event_id", "event_type", "event_timestamp", notes.outcome(F.col("success")).alias("status"))


def failures(events: DataFrame) -> DataFrame:
    return events.where(~F.col("success"))


def failed_events(events: DataFrame, limit: int | None = None) -> DataFrame:
    rows = failures(events).select(
        "event_id", "element_handle", "event_type", "event_timestamp",
        "source_path", "error_message", "pipeline_run_id",
    )
    return newest(rows, "event_timestamp", "event_id", limit)


def failures_recent(events: DataFrame, as_of: datetime, hours: float = 24, limit: int | None = None) -> DataFrame:
    rows = failures(events).where(since("event_timestamp", as_of, hours=hours)).select(
        "event_id", "event_timestamp", "event_type", "source_path", "error_message"
    )
    return newest(rows, "event_timestamp", "event_id", limit)


def failed_by_type(events: DataFrame, event_type: str, limit: int | None = None) -> DataFrame:
    rows = events.where(F.col("event_type") == event_type).select(
        "event_id", "element_handle", "source_path", "checksum_value", "error_message", "event_timestamp"
    )
    return newest(rows, "event_timestamp", "event_id", limit)


def recent_scans(events: DataFrame, limit: int | None = None) -> DataFrame:
    rows = events.where(F.col("event_type").isin(C.REGISTERED, C.SCANNED)).select(
        "event_id", "event_type", "event_timestamp", "source_path", "error_message"
    )
    return newest(rows, "event_timestamp", "event_id", limit)


def run_events(events: DataFrame, run_id: str) -> DataFrame:
    return (
        events.where(F.col("pipeline_run_id") == run_id)
        .orderBy("event_timestamp", "event_id")
        .select("event_type", "event_timestamp", "element_handle", "source_path", "success", "error_message")
    )


def config_at_event(events: DataFrame, event_type: str, handle: str | DataFrame | None = None) -> DataFrame:
    """Settings in force when an element was evaluated or copied."""
    rows = events if handle is None else of_elements(events, handle)
    snapshot = F.col("config_snapshot")
    return rows.where(F.col("event_type") == event_type).select(
        "event_id", "element_handle", "event_type", "event_timestamp",
        json_field(snapshot, "atime_threshold_days").alias("threshold"),
        json_field(snapshot, "auto_delete_local").alias("auto_delete"),
        json_field(snapshot, "target_aws_bucket").alias("bucket"),
        json_field(snapshot, "verify_checksum").alias("verify_checksum"),
    )


def by_type(events: DataFrame) -> DataFrame:
    return (
        events.groupBy("event_type")
        .agg(
            F.count("*").alias("event_count"),
            F.min("event_timestamp").alias("earliest"),
            F.max("event_timestamp").alias("latest"),
        )
        .orderBy(F.col("event_count").desc(), "event_type")
    )


def by_type_recent(events: DataFrame, as_of: datetime, hours: float = 24) -> DataFrame:
    return by_type(events.where(since("event_timestamp", as_of, hours=hours))).drop("earliest")


def stats_events(events: DataFrame) -> DataFrame:
    kind = F.coalesce(F.nullif(F.col("event_type"), F.lit("")), F.lit(C.UNKNOWN))
    return (
        events.groupBy(kind.alias("event_type"))
        .agg(F.count("*").alias("event_count"))
        .orderBy(F.col("event_count").desc(), "event_type")
    )


def errors_by_type(events: DataFrame, as_of: datetime | None = None, days: float = 7) -> DataFrame:
    """Failures by type, in the last days or (without as_of) ever."""
    rows = failures(events)
    if as_of is not None:
        rows = rows.where(since("event_timestamp", as_of, days=days))
    return (
        rows.groupBy("event_type")
        .agg(F.count("*").alias("error_count"), F.max("event_timestamp").alias("last_error"))
        .orderBy(F.col("error_count").desc(), "event_type")
    )


def failure_count_recent(events: DataFrame, as_of: datetime, hours: float = 24) -> DataFrame:
    """Number of failures in the last hours: an alert is due when it is not 0."""
    recent = failures(events).where(since("event_timestamp", as_of, hours=hours))
    return recent.agg(F.count("*").alias("failures"))


def offload_volume_by_day(events: DataFrame, limit: int | None = None) -> DataFrame:
    done = events.where((F.col("event_type") == C.COPY_COMPLETED) & F.col("success"))
    days = (
        done.groupBy(F.col("event_timestamp").cast("date").alias("offload_date"))
        .agg(F.count("*").alias("files_offloaded"), F.sum("file_size_bytes").alias("bytes_offloaded"))
        .orderBy(F.col("offload_date").desc())
    )
    return days if limit is None else days.limit(limit)


def run_summary(events: DataFrame, run_id: str | None = None) -> DataFrame:
    rows = events if run_id is None else events.where(F.col("pipeline_run_id") == run_id)
    return rows.groupBy("pipeline_run_id").agg(
        F.count("*").alias("total_events"),
        count_if(F.col("event_type") == C.REGISTERED).alias("discovered"),
        count_if(F.col("event_type") == C.COPY_COMPLETED).alias("copied"),
        count_if(~F.col("success")).alias("failures"),
    )


def daily_dashboard(events: DataFrame, as_of: datetime, days: int = 7) -> DataFrame:
    """Runs, files found, copied and released, and errors by day, newest day first."""
    recent = events.where(since("event_timestamp", as_of, days=days))
    return (
        recent.groupBy(F.col("event_timestamp").cast("date").alias("day"))
        .agg(
            F.count_distinct("pipeline_run_id").alias("runs"),
            count_if(F.col("event_type") == C.REGISTERED).alias("discovered"),
            count_if(F.col("event_type") == C.COPY_COMPLETED).alias("offloaded"),
            count_if(F.col("event_type") == C.LOCAL_DELETED).alias("purged"),
            count_if(~F.col("success")).alias("errors"),
        )
        .orderBy(F.col("day").desc())
    )


def copy_minutes_per_file(events: DataFrame, as_of: datetime, days: int = 7, limit: int | None = None) -> DataFrame:
    """Minutes from the first start to the last completion of a run, per copy event of the run.

    The count takes in both starts and completions.
    """
    started = F.min(F.when(F.col("event_type") == C.COPY_STARTED, F.col("event_timestamp")))
    ended = F.max(F.when(F.col("event_type") == C.COPY_COMPLETED, F.col("event_timestamp")))
    runs = (
        events.where(F.col("event_type").isin(C.COPY_STARTED, C.COPY_COMPLETED))
        .where(since("event_timestamp", as_of, days=days))
        .groupBy("pipeline_run_id")
        .agg(F.count("*").alias("files_copied"), started.alias("_from"), ended.alias("_to"))
    )
    minutes = elapsed_micros(F.col("_from"), F.col("_to")) / 1e6 / F.col("files_copied") / 60
    newest_first = runs.orderBy(F.col("pipeline_run_id").desc())
    return (
        (newest_first if limit is None else newest_first.limit(limit))
        .select("pipeline_run_id", "files_copied", F.round(minutes, 2).alias("avg_mins_per_file"))
    )


def copies_by_target(events: DataFrame, limit: int | None = None) -> DataFrame:
    targets = (
        events.where(F.col("event_type") == C.COPY_COMPLETED)
        .groupBy("aws_bucket", "aws_key")
        .agg(F.count("*").alias("copies"))
        .orderBy(F.col("copies").desc(), "aws_bucket", "aws_key")
    )
    return targets if limit is None else targets.limit(limit)


def event_type_count(events: DataFrame, event_type: str) -> DataFrame:
    return events.where(F.col("event_type") == event_type).agg(F.count("*").alias("event_count"))


def missed_run_alert(events: DataFrame, as_of: datetime, hours: float = 25) -> DataFrame:
    """Latest event, and whether it is so old that the scheduled run must have been missed."""
    latest = F.max("event_timestamp")
    late = F.coalesce(latest <= before(as_of, hours=hours), F.lit(True))
    return events.where(F.col("event_timestamp") <= ntz(as_of)).agg(latest.alias("latest_event"), late.alias("missed"))
