"""Reports on configuration and its changes."""

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frostline.functions import settings
from frostline.functions.times import ntz
from frostline.operators import timeline
from frostline.reports.common import newest


def config_list(config: DataFrame) -> DataFrame:
    return config.orderBy("config_key")


def config_values_in(config: DataFrame, keys: list[str]) -> DataFrame:
    return config.where(F.col("config_key").isin(*keys)).select("config_key", "config_value")


def typed_values(config: DataFrame) -> DataFrame:
    """Values with their typed reading where the key has one."""
    key, value = F.col("config_key"), F.col("config_value")
    return config.select(
        "config_key", "config_value", "updated_at",
        settings.int_value(key, value).alias("int_value"),
        settings.bool_value(key, value).alias("bool_value"),
        F.array_join(settings.list_value(key, value), "|").alias("list_value"),
    )


def change_log(log: DataFrame) -> DataFrame:
    return log.select("config_key", "old_value", "new_value", "changed_by", "changed_at", "change_reason")


def config_changes(log: DataFrame, limit: int | None = None) -> DataFrame:
    return newest(log, "changed_at", "change_id", limit)


def config_changes_for_key(log: DataFrame, key: str) -> DataFrame:
    rows = log.where(F.col("config_key") == key).drop("config_key")
    return newest(rows, "changed_at", "change_id")


def config_changes_by_user(log: DataFrame, user: str) -> DataFrame:
    rows = log.where(F.col("changed_by") == user).drop("changed_by")
    return newest(rows, "changed_at", "change_id")


def config_on(log: DataFrame, moment: datetime) -> DataFrame:
    """Value of every key that had been changed by a moment."""
    return (
        log.where(F.col("changed_at") <= ntz(moment))
        .groupBy("config_key")
        .agg(F.max_by("new_value", F.struct("changed_at", "change_id")).alias("config_value"))
    )


def config_as_of(events: DataFrame, log: DataFrame, key: str) -> DataFrame:
    """Per event, the value that the log gives to a key at that time; NULL before its first change."""
    return timeline.value_at(
        events.select("event_id", "element_handle", "event_timestamp"), "event_timestamp",
        log.where(F.col("config_key") == key), "changed_at", "change_id", "new_value", "config_value",
    )


def daily_snapshots(versions: DataFrame) -> DataFrame:
    """day, snapshot: the configuration at the end of each day, from the first change to the last, as JSON.

    A key's last value of a day holds until the day before its next change; the days between are written out, so that
    the result has a row per key and day whatever the number of versions. Versions without a time are left out.
    """
    day = F.col("updated_at").cast("date")
    last = versions.where(F.col("updated_at").isNotNull()).groupBy("config_key", day.alias("day")).agg(
        F.max_by("config_value", F.struct("updated_at", "config_value")).alias("config_value")
    )
    following = F.lead("day").over(Window.partitionBy("config_key").orderBy("day"))
    end = last.agg(F.max("day").alias("end")).select("end").scalar()
    valid = last.withColumn("until", F.coalesce(F.date_sub(following, 1), end)).select(
        "config_key", "config_value", F.explode(F.sequence("day", "until")).alias("day")
    )
    return valid.groupBy("day").agg(settings.snapshot_text(F.col("config_key"), F.col("config_value")).alias("snapshot"))


def event_snapshots(events: DataFrame, versions: DataFrame) -> DataFrame:
    """event_id, settings, built: what an event recorded of the configuration, and the configuration of its day.

    settings: `key=value` of the recorded snapshot, joined by semicolons; NULL for events without one. built: NULL on
    days before the first change, and after the last the last one's.
    """
    entries = F.map_entries(F.from_json("config_snapshot", "map<string,string>"))
    pairs = F.transform(F.array_sort(entries), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    days = daily_snapshots(versions)
    newest = versions.agg(F.max(F.col("updated_at").cast("date")).alias("newest")).select("newest").scalar()
    rows = events.select(
        "event_id", F.array_join(pairs, ";").alias("settings"),
        F.least(F.col("event_timestamp").cast("date"), newest).alias("on_day"),
    )
    return rows.join(days, F.col("on_day") == F.col("day"), "left").select(
        "event_id", "settings", F.col("snapshot").alias("built")
    )
