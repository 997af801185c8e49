"""Changes to the asset registry, as new versions of its rows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frostline import constants as C
from frostline import schemas

_UPDATABLE = ("current_aws_bucket", "current_aws_key", "current_aws_region", "source_md5", "destination_md5")


def update_state(current: DataFrame, changes: DataFrame, changed_at: Column) -> DataFrame:
    """New versions of the rows named in `changes` (one row per element_handle).

    current_location is set; the other columns of `changes` replace the old value unless NULL.
    Handles that the registry does not know are ignored.
    """
    updated = [c for c in _UPDATABLE if c in changes.columns]
    new = changes.select(
        "element_handle",
        F.col("current_location").alias("_location"),
        *[F.col(c).alias(f"_{c}") for c in updated],
    )
    joined = current.join(new, "element_handle")
    values = {c: F.coalesce(f"_{c}", c) for c in updated}
    values |= {"current_location": F.col("_location"), "last_state_change": changed_at}
    return joined.select(*[values.get(n, F.col(n)).alias(n) for n in schemas.ASSET_REGISTRY.names])


def unknown_handles(current: DataFrame, changes: DataFrame) -> DataFrame:
    """Handles that update_state ignores."""
    return changes.select("element_handle").join(current, "element_handle", "left_anti")


def moved(rows: DataFrame, location: Column, changed_at: Column) -> DataFrame:
    """New versions of registry rows that only change their location."""
    values = {"current_location": location, "last_state_change": changed_at}
    return rows.select(*[values.get(n, F.col(n)).alias(n) for n in schemas.ASSET_REGISTRY.names])


def manual_override(current: DataFrame, handle: str, changed_at: Column, location: str = C.UNKNOWN) -> DataFrame:
    """New version of one asset that an operator declares to be elsewhere, or lost."""
    return moved(current.where(F.col("element_handle") == handle), F.lit(location), changed_at)


def mismatched_handles(events: DataFrame) -> DataFrame:
    """Elements that ever had a checksum mismatch."""
    return events.where(F.col("event_type") == C.CHECKSUM_MISMATCH).select("element_handle").distinct()


def retry_set(current: DataFrame, events: DataFrame) -> DataFrame:
    """Registry rows to forget, so that the next run registers and copies the files anew."""
    return current.join(mismatched_handles(events), "element_handle", "left_semi")


def retry_reset(current: DataFrame, events: DataFrame) -> DataFrame:
    """The registry without the rows to retry."""
    return current.join(mismatched_handles(events), "element_handle", "left_anti")


def retry_tombstones(current: DataFrame, events: DataFrame, changed_at: Column) -> DataFrame:
    """Deleted versions of the rows to retry, for the versioned table."""
    rows = retry_set(current, events)
    return moved(rows, F.col("current_location"), changed_at).withColumn("is_deleted", F.lit(True))
