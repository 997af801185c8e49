"""Reports on the filesystem catalog."""

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostline.sources.catalog import cold, is_file


def tag_status_counts(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("tag_offload_status").agg(F.count("*").alias("item_count"))


def cold_count(catalog: DataFrame, as_of: datetime, days: int) -> DataFrame:
    return catalog.where(is_file() & cold(as_of, days)).agg(F.count("*").alias("cold_files"))


def freshness(catalog: DataFrame) -> DataFrame:
    return catalog.agg(F.count("*").alias("items"), F.max("mtime").alias("last_updated"))
