"""Discover: find cold files, register them, and record why."""

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostline import constants as C
from frostline import schemas
from frostline.functions import ids, notes, paths, times
from frostline.functions.settings import Settings
from frostline.operators.first_rows import first_rows
from frostline.plans import events
from frostline.sources.catalog import scan_catalog


def cold_files(catalog: DataFrame, settings: Settings, as_of: datetime) -> DataFrame:
    """Cold files below the source paths."""
    return scan_catalog(catalog, as_of, settings.threshold_days).where(
        paths.under_any(F.col("parent_path"), settings.source_paths)
    )


def offloaded(registry: DataFrame) -> DataFrame:
    """Registry rows of files that already have a cold copy."""
    return registry.where(F.col("current_location").isin(*C.OFFLOADED_LOCATIONS))


def not_offloaded(files: DataFrame, registry: DataFrame) -> DataFrame:
    """Files without a cold copy. A NULL handle is never offloaded."""
    done = offloaded(registry).select(F.col("element_handle").alias("handle"))
    return files.join(done, "handle", "left_anti")


def candidates(
    catalog: DataFrame,
    registry: DataFrame,
    settings: Settings,
    as_of: datetime,
    run_id: str,
    batch_size: int | None = None,
) -> DataFrame:
    """Files to offload, the longest unused first, at most batch_size of them (None: all).

    One join serves both questions to the registry: is there a cold copy already, and which
    id did the file get when it was registered in an earlier run. Such a file is tried again
    under that id.
    """
    known = registry.select(
        F.col("element_handle").alias("handle"),
        F.col("registration_id").alias("known_registration_id"),
        "current_location",
    )
    files = (
        cold_files(catalog, settings, as_of)
        .join(known, "handle", "left")
        .where(~F.coalesce(F.col("current_location").isin(*C.OFFLOADED_LOCATIONS), F.lit(False)))
        .drop("current_location")
        .withColumn(
            "registration_id",
            F.coalesce(
                "known_registration_id",
                ids.registration_id(run_id, F.col("handle"), paths.full_path(F.col("parent_path"), F.col("name"))),
            ),
        )
    )
    if batch_size is None:
        return files
    return first_rows(files, ["atime", "handle"], batch_size)


def with_path(files: DataFrame) -> DataFrame:
    return files.withColumn("path", paths.full_path(F.col("parent_path"), F.col("name")))


def registrations(selected: DataFrame, as_of: datetime) -> DataFrame:
    """Registry rows of the candidates that are seen for the first time."""
    bucket = paths.bucket_segment(F.col("parent_path"))
    now = times.plus_micros(as_of, events.STEP[C.REGISTERED])
    source = {
        "element_handle": F.col("handle"),
        "registration_id": F.col("registration_id"),
        "original_path": F.col("path"),
        "original_bucket": bucket,
        "original_view": bucket,
        "file_name": F.col("name"),
        "file_extension": F.col("extension"),
        "file_size_bytes": F.col("size"),
        "file_ctime": F.col("ctime"),
        "file_mtime": F.col("mtime"),
        "file_atime": F.col("atime"),
        "owner_uid": F.col("login_name"),
        "owner_login": F.col("login_name"),
        "nfs_mode_bits": F.col("nfs_mode_bits"),
        "current_location": F.lit(C.LOCAL),
        "registered_at": now,
        "last_state_change": now,
    }
    new = with_path(selected.where(F.col("known_registration_id").isNull()))
    return new.select(
        *[source.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.ASSET_REGISTRY.fields]
    )


def discover_events(selected: DataFrame, settings: Settings, as_of: datetime, run_id: str) -> DataFrame:
    """REGISTERED (first time only) and THRESHOLD_EVALUATED per candidate."""
    age = times.days_since(F.col("atime"), times.ntz(as_of))
    facts = {
        "file_size_bytes": F.col("size"),
        "file_atime": F.col("atime"),
        "file_mtime": F.col("mtime"),
        "success": F.lit(True),
    }
    note = notes.threshold_note(F.col("atime"), settings.threshold_days, age)
    steps = [
        events.step(C.REGISTERED, as_of, F.col("known_registration_id").isNull(), **facts),
        events.step(C.THRESHOLD_EVALUATED, as_of, error_message=note, **facts),
    ]
    return events.emit(
        with_path(selected), steps, run_id, C.DISCOVER, settings.snapshot(),
        "handle", F.col("registration_id"), "path",
    )


def dry_run_events(
    catalog: DataFrame, registry: DataFrame, settings: Settings, as_of: datetime, run_id: str
) -> DataFrame:
    """One SCANNED event per cold file without a cold copy; not limited by the batch size."""
    files = with_path(not_offloaded(cold_files(catalog, settings, as_of), registry))
    age = times.days_since(F.col("atime"), times.ntz(as_of))
    scanned = events.step(
        C.SCANNED, as_of,
        file_size_bytes=F.col("size"), file_atime=F.col("atime"), file_mtime=F.col("mtime"),
        success=F.lit(True), error_message=notes.dry_run_note(settings.threshold_days, age),
    )
    return events.emit(
        files, [scanned], run_id, C.DISCOVER, settings.snapshot(),
        "handle", F.lit(C.DRY_RUN_REGISTRATION), "path",
    )


def manifest(selected: DataFrame) -> DataFrame:
    """What the offload stage gets: one row per candidate."""
    return with_path(selected).select(
        "handle",
        F.col("registration_id").alias("reg_id"),
        "path",
        "size",
        paths.bucket_segment(F.col("parent_path")).alias("bucket"),
        times.iso_format(F.col("atime")).alias("atime"),
        times.iso_format(F.col("mtime")).alias("mtime"),
    )
