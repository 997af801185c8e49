"""Building lifecycle events."""

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frostline import constants as C
from frostline import schemas
from frostline.functions import ids, times

# Microseconds after the start of the run, so that sorting by time keeps the order of the steps.
STEP = {
    C.SCANNED: 0,
    C.REGISTERED: 0,
    C.THRESHOLD_EVALUATED: 1,
    C.COPY_STARTED: 2,
    C.CHECKSUM_VERIFIED: 3,
    C.CHECKSUM_MISMATCH: 3,
    C.COPY_COMPLETED: 4,
    C.COPY_FAILED: 4,
    C.LOCAL_DELETE_REQUESTED: 5,
    C.LOCAL_DELETED: 6,
    C.LOCAL_DELETE_FAILED: 6,
}

# Columns that one step of a stage may set; the others are the same for the whole stage.
_PER_STEP = (
    "destination_path", "aws_bucket", "aws_key", "file_size_bytes", "file_atime", "file_mtime",
    "success", "error_message", "checksum_value",
)


def step(event_type: str, as_of: datetime, when: Column | None = None, **fields: Column) -> Column:
    """One event of a file as a struct; NULL where `when` does not hold."""
    unknown = set(fields) - set(_PER_STEP)
    if unknown:
        raise ValueError(f"not event columns: {sorted(unknown)}")
    types = {f.name: f.dataType for f in schemas.LIFECYCLE_EVENTS.fields}
    values = [fields.get(name, F.lit(None)).cast(types[name]).alias(name) for name in _PER_STEP]
    event = F.struct(
        F.lit(event_type).alias("event_type"),
        times.plus_micros(as_of, STEP[event_type]).alias("event_timestamp"),
        *values,
    )
    return event if when is None else F.when(when, event)


def emit(
    files: DataFrame,
    steps: list[Column],
    run_id: str,
    function_name: str,
    snapshot: str,
    handle: str,
    registration: Column,
    path: str,
    triggered_by: str = C.SCHEDULE,
) -> DataFrame:
    """The events of all files: each row yields its non-NULL steps, in one pass over the files."""
    rows = files.select(
        F.col(handle).alias("element_handle"),
        registration.alias("registration_id"),
        F.col(path).alias("source_path"),
        F.explode(F.array_compact(F.array(*steps))).alias("e"),
    )
    constant = {
        "event_id": ids.event_id(F.lit(run_id), F.coalesce("element_handle", "registration_id"), F.col("e.event_type")),
        "pipeline_run_id": F.lit(run_id),
        "function_name": F.lit(function_name),
        "triggered_by": F.lit(triggered_by),
        "config_snapshot": F.lit(snapshot),
    }
    from_step = {"event_type", "event_timestamp", *_PER_STEP}
    return rows.select(
        *[
            (constant[n] if n in constant else F.col(f"e.{n}") if n in from_step else F.col(n)).alias(n)
            for n in schemas.LIFECYCLE_EVENTS.names
        ]
    )
