"""Verify and purge: release local files whose cold copy exists.

The deletion itself is left to a sink that follows the purge plan; this module looks at
the result of the look-up (`probes`) and records what happens.
"""

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostline import constants as C
from frostline.functions import notes, paths, times
from frostline.functions.settings import Settings
from frostline.plans import events, registry


def pending(current: DataFrame) -> DataFrame:
    """Every asset that lies in both places, whichever run copied it."""
    return current.where(F.col("current_location") == C.BOTH)


def purge_plan(current: DataFrame, probes: DataFrame) -> DataFrame:
    """Pending assets with the state of their cold copy and the local object to delete."""
    found = probes.select(F.col("handle").alias("element_handle"), "status", "error")
    root = F.concat(F.lit("/"), F.col("original_bucket"))
    uri_parts = F.col("current_aws_bucket"), F.col("current_aws_key")
    return (
        pending(current)
        .join(found, "element_handle", "left")
        .withColumn("local_key", paths.s3_key(F.col("original_path"), root))
        .withColumn("deletable", F.coalesce(F.col("status") == C.FOUND, F.lit(False)))
        .withColumn(
            "reason",
            F.when(F.col("status") == C.NOT_FOUND, notes.purge_abort_note(*uri_parts)).when(
                ~F.col("deletable"), F.coalesce("error", F.lit("no look-up result"))
            ),
        )
        .drop("status", "error")
    )


def purge_events(plan: DataFrame, settings: Settings, as_of: datetime, run_id: str) -> DataFrame:
    """LOCAL_DELETE_REQUESTED and LOCAL_DELETED, or LOCAL_DELETE_FAILED alone."""
    place = {"aws_bucket": F.col("current_aws_bucket"), "aws_key": F.col("current_aws_key")}
    steps = [
        events.step(C.LOCAL_DELETE_REQUESTED, as_of, F.col("deletable"), **place),
        events.step(C.LOCAL_DELETED, as_of, F.col("deletable"), success=F.lit(True), **place),
        events.step(
            C.LOCAL_DELETE_FAILED, as_of, ~F.col("deletable"),
            success=F.lit(False), error_message=F.col("reason"), **place,
        ),
    ]
    rows = plan if settings.flag("auto_delete_local") else plan.limit(0)
    return events.emit(
        rows, steps, run_id, C.PURGE, settings.snapshot(),
        "element_handle", F.col("registration_id"), "original_path",
    )


def registry_updates(plan: DataFrame, settings: Settings, as_of: datetime) -> DataFrame:
    """BOTH to LOCAL_DELETED for every deletable asset.

    The plan holds the current registry rows already, so no second look at the registry is needed.
    """
    rows = plan if settings.flag("auto_delete_local") else plan.limit(0)
    gone = rows.where("deletable")
    return registry.moved(gone, F.lit(C.LOCAL_DELETED), times.plus_micros(as_of, events.STEP[C.LOCAL_DELETED]))


def purged(plan: DataFrame) -> DataFrame:
    """Result list of the stage: the files released."""
    return plan.where("deletable").select(
        F.col("element_handle").alias("handle"), "original_path",
        paths.dest_uri(F.col("current_aws_bucket"), F.col("current_aws_key")).alias("aws_location"),
    )


def failed(plan: DataFrame) -> DataFrame:
    return plan.where(~F.col("deletable")).select(F.col("element_handle").alias("handle"), "reason")


def tags(plan: DataFrame, as_of: datetime) -> DataFrame:
    """Status tags after the purge: of the local object, and of its cold copy."""
    return plan.where("deletable").select(
        F.col("element_handle").alias("handle"),
        F.lit(C.TAG_PURGED).alias("offload_status"),
        F.lit("true").alias("source_purged"),
        times.plus_micros(as_of, events.STEP[C.LOCAL_DELETED]).alias("purge_timestamp"),
    )
