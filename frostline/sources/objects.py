"""Object bytes: digests, copies and look-ups.

Only these jobs touch bytes. Each returns one small row per object; everything after that
is relational. Objects are streamed in chunks, so that their size does not matter, and are
put under their final name in one step, so that a retried task leaves the same object.
Stores are pyarrow filesystems, named by URI or absolute path (a local folder, HDFS, S3).
"""

import hashlib
import re
import sys
from collections.abc import Iterator
from contextlib import suppress
from datetime import datetime
from uuid import uuid4

import pandas as pd
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from frostline import constants as C
from frostline import schemas
from frostline.functions import paths, times
from frostline.functions.settings import Settings
from frostline.sources.shared import written

# The task functions travel with their helpers, so that executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(C)

CHUNK_BYTES = 8 * 1024 * 1024
# Stores in which an object only appears when its writer closes it.
_ATOMIC_PUT = ("s3", "gcs", "abfs")

# Names of the metadata that a copied object carries, after a prefix.
METADATA_KEYS = (
    "element-handle",
    "registration-id",
    "original-path",
    "source-cluster",
    "offload-timestamp",
    "source-md5",
    "aws-storage-class",
)


def _store(root: str):
    from pyarrow import fs

    # Hadoop's spellings of the schemes.
    root = re.sub("^s3[an]://", "s3://", re.sub("^file:/(?!/)", "file:///", root))
    filesystem, base = fs.FileSystem.from_uri(root)
    return filesystem, base.rstrip("/")


def _below(base: str, key: str) -> str:
    if ".." in key.split("/"):
        raise ValueError(f"key leaves its root: {key}")
    return f"{base}/{key.lstrip('/')}"


def _chunks(filesystem, path: str) -> Iterator[bytes]:
    with filesystem.open_input_stream(path) as stream:
        while chunk := stream.read(CHUNK_BYTES):
            yield chunk


def _digest(filesystem, path: str) -> tuple[str, int]:
    md5, size = hashlib.md5(), 0
    for chunk in _chunks(filesystem, path):
        md5.update(chunk)
        size += len(chunk)
    return md5.hexdigest(), size


def _put(filesystem, path: str, chunks) -> None:
    """Write an object; a reader sees all of it or none, and a failure leaves nothing behind."""
    chunks = iter(chunks)
    first = next(chunks, b"")  # a source that cannot be read fails here, before anything is written
    if filesystem.type_name in _ATOMIC_PUT:
        target = path
    else:
        filesystem.create_dir(path.rpartition("/")[0], recursive=True)
        target = f"{path}.{uuid4().hex}.part"
    try:
        with filesystem.open_output_stream(target) as out:
            out.write(first)
            for chunk in chunks:
                out.write(chunk)
    except BaseException:
        with suppress(OSError):
            filesystem.delete_file(target)
        raise
    if target != path:
        filesystem.move(target, path)


def balanced(rows: DataFrame, partitions: int | None = None, least_bytes: int = 64 * 1024) -> DataFrame:
    """Deal objects (with a column size) out to tasks with nearly equal bytes.

    The mean load is the sum over `partitions`; an object counts least_bytes at least, for what opening it costs. Objects
    above half the mean load get a task each. The others are cut, in the order they come, where their running sum passes
    a multiple of the mean load, so that no task has more than 1.5 times that. Running sums are taken inside the parts
    that the rows come in, and from one sum per part. The order of the rows in a task is no one's business.
    """
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = written(
        rows.withColumn("_bytes", F.greatest(F.coalesce(F.col("size").cast("bigint"), F.lit(0)), F.lit(least_bytes)))
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_row", F.monotonically_increasing_id()),
        "loads",
    )
    load = max(1, -(-(parts.agg(F.sum("_bytes")).first()[0] or 0) // n))
    big = F.col("_bytes") * 2 > load
    small = F.when(big, F.lit(0)).otherwise(F.col("_bytes"))
    order = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.groupBy("_part").agg(F.sum(small).alias("_sum"), F.sum(big.cast("bigint")).alias("_n")).select(
        "_part", F.coalesce(F.sum("_sum").over(order), F.lit(0)).alias("_sum0"),
        F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_n0"),
    )  # one row for each part that the rows come in
    inside = Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = parts.withColumn("_small", F.sum(small).over(inside) - small).withColumn("_big", F.sum(big.cast("bigint")).over(inside))
    slots = running.join(before, "_part").withColumn(
        "_slot",
        F.when(big, F.lit(n) + F.col("_n0") + F.col("_big") - 1)
        .otherwise(F.floor((F.col("_sum0") + F.col("_small")) / load)).cast("int"),
    )
    # Fewer than 2n objects can each hold more than half of the n-th part of the bytes.
    return slots.repartitionById(3 * n, "_slot").select(*rows.columns)


def _spread(rows: DataFrame, partitions: int | None) -> DataFrame:
    """Spread objects over tasks by handle; a manifest alone would be one small partition."""
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "handle")


def read_bodies(spark: SparkSession, folder: str) -> DataFrame:
    """Objects below a folder as path, size and MD5; for objects up to 2 GB each.

    Spark's file sources do not list empty files; where those count, file_digests over a
    manifest gives a row for each object, empty, missing or of any size.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.col("length").alias("size"), F.md5("content").alias("md5"))


def _reached(root: str) -> bool:
    """Whether objects below a root can be streamed; some stores are open to Spark's readers only."""
    try:
        _store(root)
    except (ImportError, NotImplementedError, OSError, ValueError):
        return False
    return True


def file_digests(manifest: DataFrame, folder: str, whole_bytes: int = 256 * 1024 * 1024) -> DataFrame:
    """handle, key, md5, size, error: a row for each row of a manifest (handle, key) of objects below a folder.

    Tasks open and stream the objects that the manifest names. The folder is not listed: the driver would hold the listing
    whole, with a task for every few files. Only in stores that cannot be streamed Spark lists the files and reads those
    of up to whole_bytes. A file that cannot be read has its error.
    """
    if not _reached(folder):
        return _listed_digests(manifest, folder, whole_bytes)
    return _streamed_rows(written(manifest.select("handle", "key"), "digests"), folder)


def _listed_digests(manifest: DataFrame, folder: str, whole_bytes: int) -> DataFrame:
    """file_digests by Spark's reader; what it does not list (empty files, names that begin with _ or .) and larger files
    are streamed."""
    place = re.escape("/" + re.sub("^[a-z0-9]+:", "", folder).strip("/") + "/")
    # The bound is pushed into the source, which does not read larger files.
    listed = read_bodies(manifest.sparkSession, folder).where(F.col("size") <= whole_bytes)
    listed = listed.select(F.split("path", place, 2)[1].alias("of_key"), "md5", "size")
    wanted = manifest.select("handle", "key")
    found = written(wanted.join(listed, F.ltrim(F.col("key"), F.lit("/")) == F.col("of_key"), "left").drop("of_key"), "digests")
    read = found.where(F.col("md5").isNotNull()).withColumn("error", F.lit(None).cast("string"))
    rest = found.where(F.col("md5").isNull()).select("handle", "key")
    if not rest.limit(1).count():
        return read
    return read.unionByName(_streamed_rows(rest, folder))


def _streamed_rows(rows: DataFrame, folder: str) -> DataFrame:
    """Rows (handle, key) with md5, size and error of their objects, each streamed once however many rows name it."""
    streamed = stream_digests(rows.select(F.col("key").alias("handle"), "key").distinct(), folder)
    streamed = written(streamed.withColumnRenamed("handle", "of_key"), "streamed")
    return rows.join(streamed, F.col("key").eqNullSafe(F.col("of_key"))).drop("of_key")


def body_digests(objects: DataFrame, body: str = "body") -> DataFrame:
    """Replace a body column by its MD5."""
    return objects.select(*[c for c in objects.columns if c != body], F.md5(F.col(body)).alias("md5"))


def stream_digests(files: DataFrame, root: str, partitions: int | None = None) -> DataFrame:
    """MD5 of objects (handle, key) of any size, read in chunks."""

    def digest(batches):
        filesystem, base = _store(root)
        for batch in batches:
            rows = []
            for handle, key in zip(batch["handle"], batch["key"]):
                try:
                    md5, size = _digest(filesystem, _below(base, key))
                    rows.append((handle, md5, size, None))
                except (OSError, ValueError) as problem:
                    rows.append((handle, None, None, str(problem)))
            frame = pd.DataFrame(rows, columns=["handle", "md5", "size", "error"])
            yield frame.astype({"size": "Int64"})

    return _spread(files.select("handle", "key"), partitions).mapInPandas(
        digest, "handle string, md5 string, size bigint, error string"
    )


def write_objects(bodies: DataFrame, root: str, partitions: int | None = None) -> DataFrame:
    """Write text bodies (handle, key, body) as objects; returns handle, key and size.

    With 0 partitions the tasks that the bodies come in write them, and no shuffle holds them a second time.
    """

    def write(batches):
        filesystem, base = _store(root)
        for batch in batches:
            sizes = []
            for key, body in zip(batch["key"], batch["body"]):
                data = body.encode("utf-8")
                _put(filesystem, _below(base, key), [data])
                sizes.append(len(data))
            yield pd.DataFrame({"handle": batch["handle"], "key": batch["key"], "size": sizes})

    rows = bodies.select("handle", "key", "body")
    return (rows if partitions == 0 else _spread(rows, partitions)).mapInPandas(write, "handle string, key string, size bigint")


def object_metadata(
    prefix: str, handle: Column, reg_id: Column, path: Column, cluster: Column,
    offloaded_at: Column, source_md5: Column, storage_class: Column,
) -> Column:
    """Metadata of a copied object as a map."""
    values = (handle, reg_id, path, cluster, offloaded_at, source_md5, storage_class)
    names = (f"{prefix}-{key}" for key in METADATA_KEYS)
    return F.create_map(*[x for name, value in zip(names, values) for x in (F.lit(name), value)])


def metadata_fields(metadata: Column, prefix: str) -> list[Column]:
    """The entries of a metadata map as columns."""
    return [metadata[f"{prefix}-{key}"].alias(key.replace("-", "_")) for key in METADATA_KEYS]


def copy_jobs(
    manifest: DataFrame, settings: Settings, as_of: datetime, metadata_prefix: str = "source"
) -> DataFrame:
    """Source and destination keys of a manifest, with the metadata that does not need the body.

    The bucket is part of the key, so that a store root may hold several buckets.
    """
    root = F.concat(F.lit("/"), F.col("bucket"))
    cluster = settings.bootstrap.get("cluster_name", "unknown-cluster")
    return manifest.select(
        "handle",
        F.concat_ws("/", "bucket", paths.s3_key(F.col("path"), root)).alias("source_key"),
        F.concat_ws("/", F.lit(settings.bucket), paths.aws_key(F.col("path"))).alias("dest_key"),
        "size",
        object_metadata(
            metadata_prefix, F.col("handle"), F.col("reg_id"), F.col("path"), F.lit(cluster),
            times.iso_format(times.ntz(as_of)), F.lit(""), F.lit(settings.storage_class),
        ).alias("metadata"),
    )


def copy_objects(
    jobs: DataFrame, source_root: str, dest_root: str, verify: bool,
    metadata_prefix: str = "source", partitions: int | None = None,
) -> DataFrame:
    """Copy objects and, to verify, read the copies back. One COPY_RESULTS row per job.

    A failure of one object becomes its ERROR row; it does not stop the others. The copies are made by this call, once,
    and the results kept as a table; tasks get equal loads by the jobs' column size (without it, equal numbers).
    """

    def copy(batches):
        source, source_base = _store(source_root)
        dest, dest_base = _store(dest_root)

        def one(source_key, dest_key):
            md5, size = hashlib.md5(), 0

            def hashed():
                nonlocal size
                for chunk in _chunks(source, _below(source_base, source_key)):
                    md5.update(chunk)
                    size += len(chunk)
                    yield chunk

            target = _below(dest_base, dest_key)
            _put(dest, target, hashed())
            read_back = _digest(dest, target)[0] if verify else md5.hexdigest()
            status = C.COPIED if read_back == md5.hexdigest() else C.MISMATCH
            return md5.hexdigest(), read_back, size, status, None

        for batch in batches:
            rows = []
            for keys in zip(batch["source_key"], batch["dest_key"]):
                try:
                    rows.append(one(*keys))
                except (OSError, ValueError) as problem:
                    rows.append((None, None, None, C.ERROR, str(problem)))
            frame = pd.DataFrame(rows, columns=_RESULT_COLUMNS).astype({"bytes_copied": "Int64"})
            frame.insert(0, "handle", batch["handle"].to_numpy())
            frame["metadata_json"] = batch["metadata_json"].to_numpy()
            yield frame

    size = F.col("size") if "size" in jobs.columns else F.lit(0)
    packed = jobs.select("handle", "source_key", "dest_key", F.to_json("metadata").alias("metadata_json"), size.alias("size"))
    done = written(
        balanced(packed, partitions).drop("size").mapInPandas(
            copy,
            "handle string, source_md5 string, destination_md5 string, bytes_copied bigint, "
            "status string, error string, metadata_json string",
        ),
        "copies",
    )
    md5_key = f"{metadata_prefix}-source-md5"
    known = F.from_json("metadata_json", "map<string,string>")
    complete = F.transform_values(
        known, lambda key, value: F.when(key == md5_key, F.col("source_md5")).otherwise(value)
    )
    return done.withColumn("metadata", F.when(F.col("status") == C.COPIED, complete)).select(
        *schemas.COPY_RESULTS.names
    )


_RESULT_COLUMNS = ["source_md5", "destination_md5", "bytes_copied", "status", "error"]


# The lineage of copied objects, kept with them: a second source of truth beside the tables.
LINEAGE_DIR = "_lineage"
_LINEAGE = "aws_bucket string, aws_key string, metadata map<string,string>, attempt string"
_PUBLISHED = "batch string, attempt string, number bigint"


def _lineage_dir(root: str, part: str) -> str:
    """A folder of the lineage below a store's root, in Hadoop's spelling."""
    return f"{re.sub('^s3://', 's3a://', root).rstrip('/')}/{LINEAGE_DIR}/{part}"


def _published(spark: SparkSession, root: str) -> DataFrame | None:
    try:
        return spark.read.schema(_PUBLISHED).parquet(_lineage_dir(root, "published"))
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def publish_lineage(copies: DataFrame, root: str, batch: str) -> None:
    """Keep the metadata of copied objects (aws_bucket, aws_key, metadata) below their store's root, for a batch.

    The rows go into a folder of their own. One small file that names it is put in place last and in one step; it
    replaces what the batch published before, and readers follow these files only.
    """
    spark = copies.sparkSession
    earlier = _published(spark, root)
    number = 0 if earlier is None else earlier.where(F.col("batch") == batch).agg(F.max("number")).first()[0] or 0
    attempt = uuid4().hex
    copies.select("aws_bucket", "aws_key", "metadata").write.parquet(_lineage_dir(root, f"rows/attempt={attempt}"))
    record = spark.range(1).select(
        F.lit(batch).alias("batch"), F.lit(attempt).alias("attempt"), F.lit(number + 1).cast("bigint").alias("number")
    )
    record.coalesce(1).write.mode("append").parquet(_lineage_dir(root, "published"))


def read_lineage(spark: SparkSession, root: str) -> DataFrame:
    """aws_bucket, aws_key and metadata of the objects below a store's root, as published with them.

    An object that several batches copied has a row of each. Needs no table of the lake.
    """
    published = _published(spark, root)
    if published is None:
        return spark.createDataFrame([], _LINEAGE).drop("attempt")
    latest = published.groupBy("batch").agg(F.max_by("attempt", "number").alias("attempt")).select("attempt")
    rows = spark.read.schema(_LINEAGE).parquet(_lineage_dir(root, "rows"))
    return rows.join(latest, "attempt", "left_semi").drop("attempt")


def probe_jobs(pending: DataFrame) -> DataFrame:
    """Cold-store keys of registry rows."""
    return pending.select(
        F.col("element_handle").alias("handle"),
        F.concat_ws("/", "current_aws_bucket", "current_aws_key").alias("key"),
    )


def probe_listed(jobs: DataFrame, root: str) -> DataFrame:
    """Look up whether objects exist in a listing of a local or Hadoop folder. One PROBE_RESULTS row per job.

    Spark lists the folder in parallel and opens no file. Empty objects and names that begin with _ or . are not listed:
    what the listing lacks is looked up one by one.
    """
    spark = jobs.sparkSession
    place = re.escape("/" + re.sub("^[a-z0-9]+:", "", root).strip("/") + "/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    listed = files.select(F.split("path", place, 2)[1].alias("of_key")).distinct()
    wanted = jobs.select("handle", "key")
    found = written(wanted.join(listed, F.ltrim(F.lit("/"), F.col("key")) == F.col("of_key"), "left"), "listed")
    there = found.where(F.col("of_key").isNotNull()).select(
        "handle", F.lit(C.FOUND).alias("status"), F.lit(None).cast("string").alias("error")
    )
    rest = found.where(F.col("of_key").isNull()).select("handle", "key")
    return there.unionByName(probe_objects(rest, root)) if rest.limit(1).count() else there


def probe_objects(jobs: DataFrame, root: str, partitions: int | None = None) -> DataFrame:
    """Look up whether objects exist, one by one. One PROBE_RESULTS row per job."""

    def probe(batches):
        from pyarrow import fs

        filesystem, base = _store(root)
        for batch in batches:
            rows = []
            for handle, key in zip(batch["handle"], batch["key"]):
                try:
                    info = filesystem.get_file_info(_below(base, key))
                    there = info.type == fs.FileType.File
                    rows.append((handle, C.FOUND if there else C.NOT_FOUND, None))
                except (OSError, ValueError) as problem:
                    rows.append((handle, C.ERROR, str(problem)))
            yield pd.DataFrame(rows, columns=["handle", "status", "error"])

    return _spread(jobs.select("handle", "key"), partitions).mapInPandas(
        probe, "handle string, status string, error string"
    )
