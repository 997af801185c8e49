"""Cross-checks between registry, events, catalog, audit log and cold store."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frostline import constants as C
from frostline.functions import paths
from frostline.functions.settings import json_field
from frostline.operators import skew, timeline
from frostline.operators.latest import current_config
from frostline.sources.shared import written


def current_value(config: DataFrame, key: str) -> Column:
    """Value of one key as a scalar; NULL when the key is missing."""
    row = current_config(config.where(F.col("config_key") == key))
    return row.select("config_value").scalar()


def stale_threshold(registry: DataFrame, events: DataFrame, config: DataFrame) -> DataFrame:
    """Copies made under another access-time threshold than today's, newest first."""
    then = json_field(F.col("config_snapshot"), "atime_threshold_days")
    now = current_value(config, "atime_threshold_days")
    copies = (
        events.where(F.col("event_type") == C.COPY_COMPLETED)
        .select("event_id", "element_handle", "event_timestamp", then.alias("threshold_at_offload"))
        .where(F.col("threshold_at_offload") != now)
    )
    # Reduced to the rows and columns that matter before it meets the registry.
    return (
        skew.lookup(copies, registry.select("element_handle", "original_path"), ["element_handle"], "inner")
        .select(
            "element_handle", "original_path", "event_timestamp", "threshold_at_offload",
            now.alias("current_threshold"), "event_id",
        )
        .orderBy(F.col("event_timestamp").desc(), "event_id")
        .drop("event_id")
    )


def catalog_drift(registry: DataFrame, catalog: DataFrame) -> DataFrame:
    """Access time and path of an asset in the catalog against the registry."""
    now = catalog.select(
        F.col("handle").alias("element_handle"),
        F.col("atime").alias("catalog_atime"),
        paths.full_path(F.col("parent_path"), F.col("name")).alias("catalog_path"),
    )
    then = registry.select("element_handle", "original_path", F.col("file_atime").alias("registry_atime"))
    return then.join(now, "element_handle").select(
        "element_handle", "original_path", "catalog_atime", "registry_atime",
        (~F.col("catalog_atime").eqNullSafe(F.col("registry_atime"))).alias("atime_changed"),
        (F.col("catalog_atime") > F.col("registry_atime")).alias("read_since"),
        (F.col("catalog_path") != F.col("original_path")).alias("moved"),
    )


def tag_vs_registry(registry: DataFrame, catalog: DataFrame) -> DataFrame:
    """How many files have which tag in which registry state, and whether the two agree."""
    tags = catalog.select(F.col("handle").alias("element_handle"), F.col("tag_offload_status").alias("tag"))
    expected = F.when(F.col("current_location") == C.BOTH, C.TAG_COPIED).when(
        F.col("current_location").isin(C.LOCAL_DELETED, C.AWS), C.TAG_PURGED
    )
    return (
        tags.join(registry.select("element_handle", "current_location"), "element_handle", "left")
        .groupBy("tag", "current_location")
        .agg(F.count("*").alias("files"))
        .withColumn("consistent", F.col("tag").eqNullSafe(expected))
    )


def audit_corroborate(
    events: DataFrame, audit: DataFrame, event_type: str, operations: tuple[str, ...], within: str,
) -> DataFrame:
    """Per event of a type, the audit rows on its path within a time span before and after it.

    Returns the number of witnesses and the first and last of them. Events and log are each read once.
    """
    span = F.expr(f"INTERVAL {within}")
    # Kept as a table: what is sought in the log, the points in time and the result all start from it.
    claims = written(
        events.where(F.col("event_type") == event_type).select(
            "event_id", "element_handle", "source_path", "event_timestamp"
        ),
        "claims",
    )
    seen = audit.where(F.col("operation").isin(*operations)).select(
        F.col("object_path").alias("source_path"), F.col("timestamp").alias("seen_at")
    )
    probes = skew.classed(
        claims.select(
            "event_id", "source_path",
            (F.col("event_timestamp") - span).alias("low"),
            (F.col("event_timestamp") + span).alias("high"),
        ),
        ["source_path"],
    )
    # Most of the log may be about paths that nobody claims anything about.
    seen = skew.sieve(skew.classed(seen, ["source_path"]), probes)
    found = timeline.marks_between(probes, seen, "source_path", "event_id", "low", "high", "seen_at")
    return claims.join(found, "event_id", "left").select(
        "event_id", "element_handle", "source_path", "event_timestamp",
        F.coalesce("n_marks", F.lit(0)).cast("bigint").alias("witnesses"),
        F.col("first_mark").alias("first_witness"),
        F.col("last_mark").alias("last_witness"),
    )


def uncorroborated(corroborated: DataFrame) -> DataFrame:
    """Claims without any witness."""
    return corroborated.where(F.col("witnesses") == 0).select(
        "event_id", "element_handle", "source_path", "event_timestamp"
    )


def orphan_events(events: DataFrame, registry: DataFrame) -> DataFrame:
    """Events whose element and registration id are not in the registry together; dry runs aside."""
    real = events.where(~F.col("registration_id").eqNullSafe(C.DRY_RUN_REGISTRATION))
    known = registry.select("element_handle", "registration_id")
    return skew.lookup(real, known, ["element_handle", "registration_id"], "left_anti").select(
        "event_id", "element_handle", "registration_id", "event_type", "event_timestamp"
    )


def checksum_verify(source: DataFrame, destination: DataFrame) -> DataFrame:
    """Compare digests (key, handle, md5) of source objects with those of their copies (key, md5)."""
    copies = destination.select("key", F.col("md5").alias("destination_md5"))
    joined = source.select("key", "handle", F.col("md5").alias("source_md5")).join(copies, "key", "left")
    status = (
        F.when(F.col("destination_md5").isNull(), "MISSING")
        .when(F.col("source_md5") == F.col("destination_md5"), "VERIFIED")
        .otherwise("MISMATCH")
    )
    return joined.select("handle", "key", "source_md5", "destination_md5", status.alias("status"))


def layer_reconcile(
    registry: DataFrame, catalog: DataFrame, audit: DataFrame, destination: DataFrame
) -> DataFrame:
    """What each of the four independent records knows of every path, and a verdict.

    One aggregate over the union of the records: no record needs to have a path only once.
    destination has original_path, element_handle and source_md5 per cold object.
    """
    blank = {
        "handle": "string", "location": "string", "registry_md5": "string", "object_md5": "string",
        "in_registry": "int", "in_catalog": "int", "in_destination": "int", "reads": "bigint", "writes": "bigint",
    }

    def layer(rows: DataFrame, path: Column, **values: Column) -> DataFrame:
        return rows.select(
            path.alias("path"),
            *[values.get(n, F.lit(None)).cast(kind).alias(n) for n, kind in blank.items()],
        )

    one = F.lit(1)
    # The log is by far the longest record; sums alone are aggregated by hash, without a sort.
    accesses = audit.groupBy("object_path").agg(
        F.sum((F.col("operation") == "GetObject").cast("bigint")).alias("reads"),
        F.sum((F.col("operation") == "PutObject").cast("bigint")).alias("writes"),
    )
    records = (
        layer(registry, F.col("original_path"), handle=F.col("element_handle"), location=F.col("current_location"),
              registry_md5=F.col("destination_md5"), in_registry=one)
        .unionByName(layer(catalog, paths.full_path(F.col("parent_path"), F.col("name")),
                           handle=F.col("handle"), in_catalog=one))
        .unionByName(layer(destination, F.col("original_path"), handle=F.col("element_handle"),
                           object_md5=F.col("source_md5"), in_destination=one))
        .unionByName(layer(accesses, F.col("object_path"), reads=F.col("reads"), writes=F.col("writes")))
    )
    by_path = records.groupBy("path").agg(
        F.max("in_registry").isNotNull().alias("in_registry"),
        F.max("in_catalog").isNotNull().alias("in_catalog"),
        F.max("in_destination").isNotNull().alias("in_destination"),
        F.coalesce(F.sum("reads"), F.lit(0)).alias("audit_reads"),
        F.coalesce(F.sum("writes"), F.lit(0)).alias("audit_writes"),
        F.max("location").alias("location"),
        F.min("handle").alias("handle"),
        (F.min("handle") == F.max("handle")).alias("one_handle"),
        (F.max("registry_md5") == F.max("object_md5")).alias("md5_agrees"),
    )
    claimed = F.col("in_registry") & F.col("location").isin(*C.OFFLOADED_LOCATIONS)
    verdict = (
        F.when(~F.col("in_registry") & F.col("in_destination"), "REGISTRY_LOST")
        .when(claimed & ~F.col("in_destination"), "COPY_LOST")
        .when(claimed & ~F.coalesce("md5_agrees", F.lit(False)), "COPY_DIFFERS")
        .when(claimed & (F.col("audit_reads") == 0), "NOT_WITNESSED")
        .when(claimed, "CONFIRMED")
        .when(F.col("in_destination"), "COPY_NOT_RECORDED")
        .when(F.col("in_registry"), "LOCAL_ONLY")
        .when(F.col("in_catalog"), "NOT_TIERED")
        .otherwise("AUDIT_ONLY")
    )
    return by_path.withColumn("verdict", verdict)


def reconcile_summary(layers: DataFrame) -> DataFrame:
    return layers.groupBy("verdict").agg(F.count("*").alias("n_paths"))


def rebuild_registry(destination: DataFrame, registry: DataFrame) -> DataFrame:
    """Registry facts recovered from the metadata of cold objects that the registry does not know."""
    lost = destination.join(registry, "element_handle", "left_anti")
    return lost.select(
        "element_handle", "registration_id", "original_path",
        F.regexp_extract("original_path", "[^/]*$", 0).alias("file_name"),
        F.lit(C.AWS).alias("current_location"),
        F.col("aws_bucket").alias("current_aws_bucket"),
        F.col("aws_key").alias("current_aws_key"),
        "source_md5",
    )


def state_after(event_type: Column) -> Column:
    """Location that an event type leads to; NULL where it leads nowhere."""
    state = F.lit(None).cast("string")
    for kind, location in C.STATE_AFTER_EVENT.items():
        state = F.when(event_type == kind, location).otherwise(state)
    return state


def state_replay(events: DataFrame) -> DataFrame:
    """Every change of state with the state before it, and whether the move is allowed."""
    moves = (
        events.where(F.col("element_handle").isNotNull() & F.col("event_timestamp").isNotNull())
        .select(
            "event_id", "element_handle", "event_type", "event_timestamp",
            state_after(F.col("event_type")).alias("to_state"),
        )
        .where(F.col("to_state").isNotNull())
    )
    replayed = timeline.carry_last(
        moves, ["element_handle"], "event_timestamp", ["event_id"], F.col("to_state"), "from_state",
        inclusive=False,
    )
    legal = F.lit(False)
    for old, new in C.LEGAL_TRANSITIONS:
        legal = legal | (F.col("from_state").eqNullSafe(F.lit(old)) & (F.col("to_state") == new))
    return replayed.withColumn("legal", legal)


def replayed_state(events: DataFrame) -> DataFrame:
    """State of every element after its last change of state."""
    state = state_after(F.col("event_type"))
    return (
        events.withColumn("state", state)
        .where(F.col("state").isNotNull())
        .groupBy("element_handle")
        .agg(F.max_by("state", F.struct("event_timestamp", "event_id")).alias("replayed_location"))
    )


def registry_vs_replay(registry: DataFrame, events: DataFrame) -> DataFrame:
    """Registry state against the replayed one; elements known to one side only included."""
    kept = registry.select("element_handle", "current_location")
    return kept.join(replayed_state(events), "element_handle", "full_outer").withColumn(
        "agrees", F.col("current_location").eqNullSafe(F.col("replayed_location"))
    )
