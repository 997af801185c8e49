"""Texts that events carry. Their formats are fixed values."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from frostline.functions import paths, times


def threshold_note(atime: Column, threshold_days: int, age_days: Column) -> Column:
    return F.concat(
        F.lit("atime="), times.iso_format(atime), F.lit(f", threshold={threshold_days}d, age="),
        age_days.cast("string"), F.lit("d"),
    )


def dry_run_note(threshold_days: int, age_days: Column) -> Column:
    return F.concat(
        F.lit("DRY_RUN: age="), age_days.cast("string"), F.lit(f"d, threshold={threshold_days}d")
    )


def mismatch_note(source_md5: Column, destination_md5: Column) -> Column:
    return F.concat(F.lit("src="), source_md5, F.lit(" dst="), destination_md5)


def purge_abort_note(bucket: Column, key: Column) -> Column:
    return F.concat(
        F.lit("AWS copy not found at "), paths.dest_uri(bucket, key),
        F.lit(", aborting local delete for safety"),
    )


def outcome(success: Column) -> Column:
    """OK, FAIL or -- for a success flag that may be unknown."""
    return F.when(success, "OK").when(~success, "FAIL").otherwise("--")
