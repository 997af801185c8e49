"""Current row per key of a table of versions."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_by(versions: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the one with the greatest order values.

    Spark turns the filter on the rank into a limit per key that each task applies before the
    shuffle, so that a key with very many versions sends at most one row per task.
    """
    newest_first = Window.partitionBy(*keys).orderBy(*[c.desc() for c in order])
    ranked = versions.withColumn("_rank", F.row_number().over(newest_first))
    return ranked.where(F.col("_rank") == 1).drop("_rank")


def current_registry(versions: DataFrame) -> DataFrame:
    """Live registry row per element; rows marked deleted hide the element.

    Elements without a handle are told apart by their registration.
    """
    order = [F.col("last_state_change"), F.col("registration_id")]
    versions = versions.withColumn("_own", F.when(F.col("element_handle").isNull(), F.col("registration_id")))
    keys = ["element_handle", "_own"]
    if "is_deleted" not in versions.columns:
        return latest_by(versions, keys, order).drop("_own")
    live = latest_by(versions, keys, [*order, F.col("is_deleted")]).drop("_own")
    return live.where(~F.col("is_deleted")).drop("is_deleted")


def current_config(versions: DataFrame) -> DataFrame:
    """Configuration row per key: the latest update wins."""
    return latest_by(versions, ["config_key"], [F.col("updated_at"), F.col("config_value")])
