"""Filesystem catalog: one row per file or directory, as snapshots."""

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from frostline import constants as C
from frostline import schemas
from frostline.functions import times
from frostline.functions.paths import full_path

COLUMNS = (
    "handle", "parent_path", "name", "extension", "size",
    "atime", "mtime", "ctime", "login_name", "nfs_mode_bits",
)


SNAPSHOT = "snapshot_ts"


def write_snapshot(catalog: DataFrame, path: str, taken_at: datetime) -> str:
    """Keep a snapshot of the catalog in a folder beside the earlier ones; returns its name."""
    name = f"{taken_at:%Y%m%dT%H%M%S.%f}"
    catalog.select(*schemas.CATALOG.names).write.mode("overwrite").parquet(f"{path}/{SNAPSHOT}={name}")
    return name


def snapshots(spark: SparkSession, path: str) -> list[str]:
    """Names of the snapshots in a folder, the earliest first; such as were not written to their end don't count."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{SNAPSHOT}=*/_SUCCESS")
    files = pattern.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(pattern)
    return sorted(str(f.getPath().getParent().getName()).partition("=")[2] for f in files or [])


def read_catalog(spark: SparkSession, path: str, snapshot: str | None = None) -> DataFrame:
    """Catalog stored as Parquet, with the declared schema.

    Of a folder with snapshots one is read, the latest if none is named, so that each file comes once. The others'
    files aren't listed.
    """
    kept = snapshots(spark, path)
    if snapshot is not None and snapshot not in kept:
        raise ValueError(f"no such snapshot: {snapshot}")
    folder = f"{path}/{SNAPSHOT}={snapshot or kept[-1]}" if kept else path
    return spark.read.schema(schemas.CATALOG).parquet(folder)


def snapshot_changes(earlier: DataFrame, later: DataFrame) -> DataFrame:
    """handle, path, change (ADDED, REMOVED or CHANGED) and moved, for the files in which two snapshots differ.

    Files without a handle are told apart by their path. Rows are compared by a digest of 128 bits of all columns, in one
    aggregate over both snapshots: what is shuffled is a digest for each file, and no file is looked up in the other.
    """
    def side(rows: DataFrame, is_later: bool) -> DataFrame:
        path = full_path(F.col("parent_path"), F.col("name"))
        marks = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in schemas.CATALOG.names]
        digest = F.struct(F.xxhash64(*marks).alias("a"), F.xxhash64(F.lit(1), *reversed(marks)).alias("b"))
        facts = F.struct(path.alias("path"), digest.alias("digest"))
        own = {True: facts, False: F.lit(None).cast("struct<path:string,digest:struct<a:bigint,b:bigint>>")}
        return rows.select("handle", F.when(F.col("handle").isNull(), path).alias("_path"),
                           own[not is_later].alias("_earlier"), own[is_later].alias("_later"))

    both = side(earlier, False).unionByName(side(later, True)).groupBy("handle", "_path").agg(
        F.max("_earlier").alias("_earlier"), F.max("_later").alias("_later")
    )
    change = (
        F.when(F.col("_earlier").isNull(), "ADDED").when(F.col("_later").isNull(), "REMOVED")
        .when(F.col("_earlier.digest") != F.col("_later.digest"), "CHANGED")
    )
    return both.withColumn("change", change).where(F.col("change").isNotNull()).select(
        "handle", F.coalesce("_later.path", "_earlier.path").alias("path"), "change",
        F.coalesce(F.col("_later.path") != F.col("_earlier.path"), F.lit(False)).alias("moved"),
    )


def cold(as_of: datetime, days: int) -> Column:
    """Accessed strictly before as_of minus the threshold."""
    return F.col("atime") < times.before(as_of, days=days)


def is_file() -> Column:
    return F.col("element_type") == C.FILE


def scan_catalog(catalog: DataFrame, as_of: datetime, days: int) -> DataFrame:
    """Cold files with the ten columns that tiering needs.

    The defaults for missing values come after the filter, which thus reaches the scan.
    """
    return catalog.where(is_file() & cold(as_of, days)).select(
        *[_with_default(c) for c in COLUMNS]
    )


def _with_default(name: str) -> Column:
    value = F.col(name)
    if name == "extension":
        return F.coalesce(value, F.lit("")).alias(name)
    if name == "login_name":
        return F.coalesce(F.nullif(value, F.lit("")), F.lit(C.NO_LOGIN)).alias(name)
    if name == "nfs_mode_bits":
        return F.coalesce(value, F.lit(0)).alias(name)
    return value
