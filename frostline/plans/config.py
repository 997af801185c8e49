"""Seeding, changing and rolling back the configuration."""

from collections.abc import Mapping
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from frostline import constants as C
from frostline.functions import ids, times
from frostline.sources import lake as tables


class UnknownConfigKey(KeyError):
    """A change names a key that the configuration does not have."""


def key_value_rows(spark: SparkSession, values: Mapping[str, str]) -> DataFrame:
    """A parameter of a few rows as a DataFrame."""
    return spark.createDataFrame(
        pa.table({"config_key": list(values), "config_value": list(values.values())})
    )


def _keys(present: DataFrame) -> DataFrame:
    """Each key once: the versions of a key may be any number of rows."""
    return present.select("config_key").distinct()


def missing_keys(spark: SparkSession, present: DataFrame) -> DataFrame:
    """Required keys that the configuration lacks."""
    required = key_value_rows(spark, C.DEFAULT_CONFIG).select("config_key")
    return required.join(_keys(present), "config_key", "left_anti")


def seed_rows(spark: SparkSession, present: DataFrame, now: Column, defaults=None) -> DataFrame:
    """Config rows for the default keys that are not there yet."""
    wanted = key_value_rows(spark, defaults or C.DEFAULT_CONFIG)
    return wanted.join(_keys(present), "config_key", "left_anti").select(
        "config_key", "config_value",
        F.lit(C.SEED_USER).alias("updated_by"),
        now.alias("updated_at"),
        F.lit(C.SEED_REASON).alias("change_reason"),
    )


def change_rows(current: DataFrame, requests: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Config versions and change-log rows for requests (config_key, new_value, changed_by, change_reason).

    A request for the value a key already has changes nothing. Requests for unknown keys are
    in neither result, see unknown_requests.
    """
    known = current.select("config_key", F.col("config_value").alias("old_value"))
    changes = (
        requests.join(known, "config_key")
        .where(~F.col("old_value").eqNullSafe(F.col("new_value")))
        .withColumn("changed_at", now)
    )
    versions = changes.select(
        "config_key",
        F.col("new_value").alias("config_value"),
        F.col("changed_by").alias("updated_by"),
        F.col("changed_at").alias("updated_at"),
        "change_reason",
    )
    log = changes.select(
        ids.change_id(F.col("config_key"), F.col("new_value"), F.col("changed_at")).alias("change_id"),
        "config_key", "old_value", "new_value", "changed_by", "changed_at", "change_reason",
    )
    return versions, log


def unknown_requests(current: DataFrame, requests: DataFrame) -> DataFrame:
    return requests.join(current, "config_key", "left_anti")


def rollback_requests(log: DataFrame, changed_by: Column) -> DataFrame:
    """Requests that set every changed key back to the value before its last change."""
    previous = log.groupBy("config_key").agg(
        F.max_by("old_value", F.struct("changed_at", "change_id")).alias("new_value")
    )
    return previous.select(
        "config_key", "new_value", changed_by.alias("changed_by"), F.lit("rollback").alias("change_reason")
    )


def update(lake, key: str, value: str, changed_by: str, reason: str, now: datetime) -> bool:
    """Change one key and log the change. Returns whether the value was different."""
    current = lake.config()
    request = lake.spark.createDataFrame(
        pa.table({"config_key": [key], "new_value": [value], "changed_by": [changed_by], "change_reason": [reason]})
    )
    row = current.where(F.col("config_key") == key).select("config_value").first()
    if row is None:
        raise UnknownConfigKey(key)
    if row.config_value == value:
        return False
    versions, log = change_rows(current, request, times.ntz(now))
    batch = f"config-{now:%Y%m%d-%H%M%S-%f}-{key}"
    _publish(lake, versions, log, batch)
    return True


def update_all(lake, values: Mapping[str, str], changed_by: str, reason: str, now: datetime) -> None:
    """Change several keys and log the changes, all or none; keys that have their value already stay as they are."""
    requests = key_value_rows(lake.spark, values).select(
        "config_key", F.col("config_value").alias("new_value"), F.lit(changed_by).alias("changed_by"),
        F.lit(reason).alias("change_reason"),
    )
    current = lake.config()
    unknown = unknown_requests(current, requests).first()
    if unknown is not None:
        raise UnknownConfigKey(unknown.config_key)
    versions, log = change_rows(current, requests, times.ntz(now))
    _publish(lake, versions, log, f"config-{now:%Y%m%d-%H%M%S-%f}-several")


def _publish(lake, versions: DataFrame, log: DataFrame, batch: str) -> None:
    """Values and their log rows become visible together: a value without its log row would hide who changed it."""
    with lake.one_batch(batch, "config"):
        lake.write_batch(tables.CHANGE_LOG, log, batch, "config")
        lake.write_batch(tables.CONFIG, versions, batch, "config")


def rollback(lake, key: str, changed_by: str, now: datetime) -> bool:
    """Set one key back to the value before its last logged change."""
    history = lake.change_log().where(F.col("config_key") == key)
    request = rollback_requests(history, F.lit(changed_by)).first()
    if request is None:
        raise UnknownConfigKey(key)
    return update(lake, key, request.new_value, changed_by, request.change_reason, now)


def seed(lake, now: datetime) -> None:
    """Insert the defaults that are missing; safe to call at every start."""
    rows = seed_rows(lake.spark, lake.config(), times.ntz(now))
    lake.write_batch(tables.CONFIG, rows, f"seed-{now:%Y%m%d-%H%M%S}", "seed")
