"""Ids that come out the same on every evaluation, task retry and rerun."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_id(*parts: Column) -> Column:
    """Digest of the parts, shaped like a UUID.

    NULL and the separator are written out, so that different parts never make one text.
    """
    plain = (F.replace(F.replace(p, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")) for p in parts)
    digest = F.md5(F.concat_ws("|", *(F.coalesce(p, F.lit("\\N")) for p in plain)))
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat_ws("-", *(F.substring(digest, start, size) for start, size in cuts))


def registration_id(run_id: str, handle: Column, path: Column | None = None) -> Column:
    """Id of a file in a run. Files without a handle are told apart by their path."""
    if path is not None:
        handle = F.coalesce(handle, F.concat(F.lit("path:"), path))
    return stable_id(F.lit(run_id), handle, F.lit("registration"))


def event_id(run_id: Column, handle: Column, event_type: Column) -> Column:
    return stable_id(run_id, handle, event_type)


def change_id(key: Column, new_value: Column, changed_at: Column) -> Column:
    return stable_id(key, new_value, changed_at.cast("string"))
