"""Alerts on failures, taken from the event table as it grows.

Each call picks up what was added since the last one and stops (an available-now trigger),
so that the scheduler of the runs can also schedule the alerts.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frostline import schemas

ALERT_COLUMNS = (
    "event_id", "element_handle", "event_type", "event_timestamp",
    "source_path", "error_message", "pipeline_run_id",
)


def event_stream(
    spark: SparkSession, folder: str, schema: T.StructType = schemas.LIFECYCLE_EVENTS,
    files_per_batch: int = 1000, name_pattern: str = "*.parquet",
) -> DataFrame:
    """The files of an event table as a stream."""
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .option("pathGlobFilter", name_pattern)
        .option("recursiveFileLookup", "true")
        .parquet(folder)
    )


def failure_alerts(events: DataFrame) -> DataFrame:
    """Failed events; stateless, so that no late event is lost."""
    return events.where(~F.col("success")).select(*ALERT_COLUMNS)


def deliver(alerts: DataFrame, folder: str, checkpoint: str) -> None:
    """Append the alerts from new files to a folder and stop when all input is read.

    A file is read once. A batch of events that was run again comes in new files, though, and its
    alerts are appended again under the same event ids; `delivered` counts them once.
    """
    stream = (
        alerts.writeStream.format("parquet")
        .option("path", folder)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    stream.awaitTermination()


def delivered(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """The alerts in a folder, one per event."""
    return spark.read.schema(schema).parquet(folder).dropDuplicates(["event_id"])
