"""The folder that all executors share, and tables written there to cut lineage."""

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


_own_folders: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder named by spark.checkpoint.dir; a local session without one gets its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    application = spark.conf.get("spark.app.id", "")
    if application not in _own_folders:
        _own_folders[application] = tempfile.mkdtemp(prefix="frostline-")
    return _own_folders[application]


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """New name below the shared folder."""
    return f"{shared_dir(spark)}/{purpose}-{uuid4().hex}"


# Spark's settings while a table is written: delete the shuffle files of a query when it ends, not when the driver happens
# to collect garbage; hand texts to Python in small batches. Either side holds a batch several times (as it is filled, as
# Arrow, as objects, and what is made of it), and idle workers keep what they once had beside the next stage's heap.
_WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
}


def written(rows: DataFrame, purpose: str) -> DataFrame:
    """The rows as a table in the shared folder: computed once, and safe from lost executors.

    Once they are there, nothing reads the shuffle files that they came from; jobs of many stages would fill the
    executors' disks with them.
    """
    spark = rows.sparkSession
    folder, before = scratch_dir(spark, purpose), {key: spark.conf.get(key, None) for key in _WRITING}
    for key, value in _WRITING.items():
        spark.conf.set(key, value)
    try:
        rows.write.parquet(folder)
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
    return spark.read.schema(rows.schema).parquet(folder)


def drop_written(table: DataFrame) -> None:
    """Delete a table that `written` made, once nothing that is still to be computed reads it."""
    files = table.inputFiles()
    if files:
        jvm, spark = table.sparkSession._jvm, table.sparkSession
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(files[0].rpartition("/")[0]))
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
