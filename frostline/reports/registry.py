"""Reports on the asset registry."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostline import constants as C
from frostline.reports.common import gib, newest, of_elements
from frostline.sources import lake as tables


def by_location(registry: DataFrame, location: str, columns: list[str]) -> DataFrame:
    return registry.where(F.col("current_location") == location).select(*columns)


def offloaded_handles(registry: DataFrame) -> DataFrame:
    """Set of elements that have a cold copy."""
    return _offloaded(registry).select("element_handle").distinct()


def already_offloaded(handles: DataFrame, registry: DataFrame) -> DataFrame:
    """Those of the given handles that have a cold copy."""
    return handles.join(_offloaded(registry), "element_handle", "left_semi")


def pending_purge(registry: DataFrame) -> DataFrame:
    return registry.where(F.col("current_location") == C.BOTH)


def locate_by_handle(registry: DataFrame, handles: str | DataFrame) -> DataFrame:
    return of_elements(registry, handles).select(
        "element_handle", "original_path", "current_location", "current_aws_bucket",
        "current_aws_key", "current_aws_region", "source_md5", "destination_md5",
        "registered_at", "last_state_change",
    )


def locate_by_path(registry: DataFrame, pattern: str, limit: int | None = None) -> DataFrame:
    """Assets whose original path fits a LIKE pattern, latest change first."""
    found = registry.where(F.col("original_path").like(pattern)).select(
        "element_handle", "original_path", "current_location", "current_aws_bucket",
        "current_aws_key", "source_md5", "registered_at", "last_state_change",
    )
    return newest(found, "last_state_change", "element_handle", limit)


def locate_contains(registry: DataFrame, pattern: str) -> DataFrame:
    """Assets whose original path contains the pattern; its * and % count for nothing."""
    part = pattern.replace("*", "").replace("%", "")
    return registry.where(F.coalesce("original_path", F.lit("")).contains(part)).select(
        "element_handle", "original_path", "current_location",
        "current_aws_bucket", "current_aws_key", "source_md5",
    )


def locate_indexed(lake, pattern: str, few: int = 1000) -> DataFrame:
    """locate_contains on the tables of a lake that keeps the postings of its paths.

    The postings of the pattern's runs of three characters are read, those rows of the files that hold them; elements
    with all of them are looked up and their paths verified. Up to `few` of them reach the registry's files as literals,
    more by a join. Patterns under three characters, which have no run, look at every path.
    """
    part = pattern.replace("*", "").replace("%", "")
    grams = sorted({part[at : at + tables.GRAM] for at in range(len(part) - tables.GRAM + 1)})
    if not grams:
        return locate_contains(lake.registry(), pattern)
    holders = (
        lake.table(tables.PATH_GRAMS).where(F.col("gram").isin(*grams))
        .select("gram", "element_handle", "registration_id").distinct()
        .groupBy("element_handle", "registration_id").agg(F.count("*").alias("n")).where(F.col("n") == len(grams))
        .select("element_handle").distinct()
    )
    found = [row.element_handle for row in holders.limit(few + 1).collect()]
    if len(found) > few:
        of = holders.withColumnRenamed("element_handle", "of")
        rows = lake.registry().join(of, F.col("element_handle").eqNullSafe(F.col("of")), "left_semi")
    else:
        known = F.col("element_handle").isin(*[h for h in found if h is not None])
        rows = lake.registry().where(known | F.col("element_handle").isNull() if None in found else known)
    return locate_contains(rows, pattern)


def purged_by_path(registry: DataFrame, pattern: str) -> DataFrame:
    found = registry.where(
        F.col("original_path").like(pattern) & (F.col("current_location") == C.LOCAL_DELETED)
    ).select(
        "element_handle", "file_name", "file_size_bytes", "original_path", "current_aws_bucket",
        "current_aws_key", "registered_at", "last_state_change", "source_md5",
    )
    return newest(found, "last_state_change", "element_handle")


def recently_offloaded(registry: DataFrame, limit: int | None = None) -> DataFrame:
    both = by_location(registry, C.BOTH, ["element_handle", "file_name", "current_location", "last_state_change"])
    return newest(both, "last_state_change", "element_handle", limit)


def integrity(registry: DataFrame) -> DataFrame:
    """Registry rows with both digests and whether they agree; NULL where one is missing."""
    return registry.select(
        "element_handle", "original_path", "source_md5", "destination_md5",
        "current_location", "last_state_change",
        (F.col("source_md5") == F.col("destination_md5")).alias("intact"),
    )


def integrity_mismatch(registry: DataFrame) -> DataFrame:
    return integrity(registry).where(~F.col("intact")).drop("intact")


def integrity_suspect(registry: DataFrame) -> DataFrame:
    """Offloaded rows whose digests are not known to agree: different, or one missing."""
    differ = ~F.col("source_md5").eqNullSafe(F.col("destination_md5"))
    unknown = F.col("source_md5").isNull() & F.col("destination_md5").isNull()
    return integrity(_offloaded(registry).where(differ | unknown)).drop("intact")


def by_location_summary(registry: DataFrame) -> DataFrame:
    return registry.groupBy("current_location").agg(
        F.count("*").alias("asset_count"),
        F.sum("file_size_bytes").alias("total_bytes"),
        F.min("registered_at").alias("earliest_registered"),
        F.max("last_state_change").alias("latest_change"),
    )


def by_location_sizes(registry: DataFrame) -> DataFrame:
    """Files, GiB and TiB by location, largest first."""
    size = F.sum("file_size_bytes")
    return (
        registry.groupBy("current_location")
        .agg(F.count("*").alias("file_count"), gib(size).alias("size_gb"), (gib(size) / 1024.0).alias("size_tb"))
        .orderBy(F.col("size_tb").desc_nulls_last(), "current_location")
    )


def stats_locations(registry: DataFrame) -> DataFrame:
    """Assets and GiB by location, with UNKNOWN for no location and 0 for no size."""
    location = F.coalesce(F.nullif(F.col("current_location"), F.lit("")), F.lit(C.UNKNOWN))
    size = F.sum(F.coalesce("file_size_bytes", F.lit(0)))
    return (
        registry.groupBy(location.alias("location"))
        .agg(F.count("*").alias("asset_count"), F.round(gib(size), 2).alias("size_gb"))
        .orderBy("location")
    )


def total_offloaded(registry: DataFrame, locations: tuple[str, ...] = C.OFFLOADED_LOCATIONS) -> DataFrame:
    return registry.where(F.col("current_location").isin(*locations)).agg(
        F.round(gib(F.sum("file_size_bytes")), 2).alias("total_gb"),
        F.count_distinct("element_handle").alias("unique_files"),
    )


def offloaded_by_path(registry: DataFrame) -> DataFrame:
    return (
        _offloaded(registry)
        .groupBy("original_path")
        .agg(
            F.count("*").alias("file_count"),
            F.round(gib(F.sum("file_size_bytes")), 2).alias("gb"),
            F.max("last_state_change").alias("last_offload"),
        )
        .orderBy(F.col("gb").desc_nulls_last(), "original_path")
    )


def registered_count(registry: DataFrame) -> DataFrame:
    return registry.agg(F.count("*").alias("registered"))


def recommended_batch_size(
    registry: DataFrame, memory_gb: float, verify: bool, safety: float = 0.5
) -> DataFrame:
    """Files per run that fit the memory, from the average file size; at least one."""
    average_mb = F.sum("file_size_bytes").cast("double") / F.count("file_size_bytes") / (1024.0 * 1024.0)
    per_file = average_mb * 2 * (2 if verify else 1)
    return registry.agg(average_mb.alias("avg_mb"), per_file.alias("per_file_mb")).select(
        F.round("avg_mb", 6).alias("avg_mb"),
        F.greatest(F.lit(1), F.floor(F.lit(memory_gb * 1000 * safety) / F.nullif(F.col("per_file_mb"), F.lit(0.0))))
        .cast("bigint").alias("batch_size"),
    )


def _offloaded(registry: DataFrame) -> DataFrame:
    return registry.where(F.col("current_location").isin(*C.OFFLOADED_LOCATIONS))
