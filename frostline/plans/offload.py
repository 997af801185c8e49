"""Offload: record the copies of a manifest. The copying itself is sources.objects."""

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frostline import constants as C
from frostline.functions import notes, paths, times
from frostline.functions.settings import Settings
from frostline.plans import events, registry


def with_outcome(manifest: DataFrame, copies: DataFrame) -> DataFrame:
    """Manifest rows with the result of their copy; a row without one was not copied."""
    results = copies.select("handle", "source_md5", "destination_md5", "status", "error")
    return (
        manifest.join(results, "handle", "left")
        .withColumn("status", F.coalesce("status", F.lit(C.ERROR)))
        .withColumn(
            "error",
            F.when(F.col("status") == C.ERROR, F.coalesce("error", F.lit("no copy result"))),
        )
        .withColumn("key", paths.aws_key(F.col("path")))
    )


def offload_events(outcomes: DataFrame, settings: Settings, as_of: datetime, run_id: str) -> DataFrame:
    """COPY_STARTED per object, then what became of it. The success of a start is unknown."""
    bucket = F.lit(settings.bucket)
    uri = paths.dest_uri(bucket, F.col("key"))
    place = {"aws_bucket": bucket, "aws_key": F.col("key")}
    copied = F.col("status") == C.COPIED
    mismatch = F.col("status") == C.MISMATCH
    steps = [
        events.step(C.COPY_STARTED, as_of, destination_path=uri, file_size_bytes=F.col("size"), **place)
    ]
    if settings.flag("verify_checksum"):
        steps.append(
            events.step(
                C.CHECKSUM_VERIFIED, as_of, copied,
                success=F.lit(True), checksum_value=F.col("source_md5"), **place,
            )
        )
    steps += [
        events.step(
            C.CHECKSUM_MISMATCH, as_of, mismatch,
            success=F.lit(False), error_message=F.lit(C.MISMATCH_ERROR),
            checksum_value=notes.mismatch_note(F.col("source_md5"), F.col("destination_md5")), **place,
        ),
        events.step(
            C.COPY_COMPLETED, as_of, copied,
            destination_path=uri, success=F.lit(True), checksum_value=F.col("source_md5"),
            file_size_bytes=F.col("size"), **place,
        ),
        events.step(
            C.COPY_FAILED, as_of, F.col("status") == C.ERROR,
            success=F.lit(False), error_message=F.col("error"), **place,
        ),
    ]
    return events.emit(
        outcomes, steps, run_id, C.OFFLOAD, settings.snapshot(), "handle", F.col("reg_id"), "path"
    )


def registry_updates(current: DataFrame, outcomes: DataFrame, settings: Settings, as_of: datetime) -> DataFrame:
    """LOCAL to BOTH for every verified copy."""
    changes = outcomes.where(F.col("status") == C.COPIED).select(
        F.col("handle").alias("element_handle"),
        F.lit(C.BOTH).alias("current_location"),
        F.lit(settings.bucket).alias("current_aws_bucket"),
        F.col("key").alias("current_aws_key"),
        F.lit(settings.region).alias("current_aws_region"),
        "source_md5",
        _kept_md5(settings).alias("destination_md5"),
    )
    return registry.update_state(current, changes, times.plus_micros(as_of, events.STEP[C.COPY_COMPLETED]))


def _kept_md5(settings: Settings) -> Column:
    """Without verification the destination is taken to equal the source."""
    return F.col("destination_md5" if settings.flag("verify_checksum") else "source_md5")


def offloaded(outcomes: DataFrame, settings: Settings) -> DataFrame:
    """Result list of the stage: the objects copied."""
    return outcomes.where(F.col("status") == C.COPIED).select(
        "handle", "reg_id", F.col("path").alias("original_path"),
        F.lit(settings.bucket).alias("aws_bucket"), F.col("key").alias("aws_key"), "source_md5",
    )


def lineage(copies: DataFrame, settings: Settings, metadata_prefix: str = "source") -> DataFrame:
    """Place and metadata of the objects copied, for the manifest that is kept with them."""
    path = F.col("metadata")[f"{metadata_prefix}-original-path"]
    return copies.where(F.col("status") == C.COPIED).select(
        F.lit(settings.bucket).alias("aws_bucket"), paths.aws_key(path).alias("aws_key"), "metadata"
    )


def failed(outcomes: DataFrame) -> DataFrame:
    """Result list of the stage: the objects not copied, with the reason."""
    return outcomes.where(F.col("status") != C.COPIED).select(
        "handle", F.coalesce("error", F.lit("checksum_mismatch")).alias("reason")
    )


def tags(outcomes: DataFrame, settings: Settings, as_of: datetime) -> DataFrame:
    """Status tags of the local objects that now have a copy."""
    return outcomes.where(F.col("status") == C.COPIED).select(
        "handle",
        F.lit(C.TAG_COPIED).alias("offload_status"),
        paths.dest_uri(F.lit(settings.bucket), F.col("key")).alias("offload_destination"),
        times.plus_micros(as_of, events.STEP[C.COPY_COMPLETED]).alias("offload_timestamp"),
    )
