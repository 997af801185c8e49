"""Protocol audit log: one row per operation on a file or object."""

from pyspark.sql import DataFrame, SparkSession

from frostline import schemas


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """Audit log stored as Parquet, with the declared schema."""
    return spark.read.schema(schemas.AUDIT).parquet(path)
