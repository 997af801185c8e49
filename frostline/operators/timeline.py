"""Running values along time for keys of any size.

A window over a key puts all rows of that key into one task. Here the rows of hot keys are
cut into time slices: a window runs inside each slice, a small table holds one summary row
per hot key and slice, and what earlier (or later) slices contribute is joined back. The
results are those of the plain window, whatever the slices and whichever keys are cut.

The rows are shuffled by key and slice explicitly: rows that come in shuffled by the key
alone would satisfy the window as well, with all slices of a hot key in one task.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frostline.functions.times import elapsed_micros, time_slice
from frostline.operators import skew
from frostline.sources.shared import written

SLICE = "_slice"
# Rows of one key that a single task may sort.
HOT_ROWS = 1_000_000


def _tagged(rows: DataFrame, keys: Sequence[str], at: str, slice_seconds: int, hot_rows: int) -> tuple[DataFrame, bool]:
    """(rows with their time slice, whether any key is hot): the one place where the rows of an input are read.

    They are kept as a table, which the search for hot keys, the running values and the sums of slices all start from. The
    slice is NULL for keys that are not hot, which stay in one piece.
    """
    kept = written(skew.classed(rows, keys), "timeline")
    hot = written(skew.hot_classes(kept, hot_rows), "hot")
    sliced = F.when(F.col("_hot"), time_slice(F.col(at), slice_seconds))
    return skew.flag_hot(kept, hot, "_hot").withColumn(SLICE, sliced).drop("_hot", skew.CLASS), bool(hot.limit(1).count())


def carry_last(
    rows: DataFrame,
    keys: Sequence[str],
    at: str,
    tie: Sequence[str],
    value: Column,
    out: str,
    inclusive: bool = True,
    slice_seconds: int = 600,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add the last non-NULL value at (or, not inclusive, before) each row of its key.

    Rows of a key are ordered by `at` and then by `tie`, which must make the order total.
    Keys and times must not be NULL.
    """
    order = [F.col(c) for c in (at, *tie)]
    sliced, cut = _tagged(rows.withColumn("_value", value), keys, at, slice_seconds, hot_rows)
    group = [*keys, SLICE]
    upto = Window.currentRow if inclusive else -1
    inside = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, upto)
    local = sliced.repartition(*group).withColumn("_local", F.last("_value", ignorenulls=True).over(inside))
    if not cut:
        return local.withColumnRenamed("_local", out).drop("_value", SLICE)

    # A slice maps the value that it starts with to the one that it ends with: to its own last value, or, without one, to
    # the same. Such maps compose; the prefix over a key's slices composes them, one row for each.
    earlier = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        sliced.where(F.col(SLICE).isNotNull())
        .groupBy(*group)
        .agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.struct(*order))).alias("_end"))
        .select(*group, F.last("_end", ignorenulls=True).over(earlier).alias("_carried"))
    )
    return (
        local.join(carried, group, "left")
        .withColumn(out, F.coalesce("_local", "_carried"))
        .drop("_value", "_local", "_carried", SLICE)
    )


def marks_between(
    probes: DataFrame,
    marks: DataFrame,
    key: str,
    probe_id: str,
    low: str,
    high: str,
    mark_at: str,
    slice_seconds: int = 60,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Per probe, how many marks of its key lie in [low, high], with the first and the last.

    No pair of probe and mark is ever formed: a probe becomes two points on the time line
    of its key, and the counts of marks up to each point are subtracted.
    Returns probe_id, n_marks, first_mark and last_mark; probe_id must be unique.
    """
    probes, marks = skew.classed(probes, [key]), skew.classed(marks, [key])
    id_type = probes.schema[probe_id].dataType
    # At equal times a low point (0) sorts before the marks (1) and a high point (2) after them.
    ends = F.array(
        F.struct(F.col(low).alias("_at"), F.lit(0).alias("_side")),
        F.struct(F.col(high).alias("_at"), F.lit(2).alias("_side")),
    )
    points = (
        probes.select(key, skew.CLASS, probe_id, F.inline(ends))
        .unionByName(
            marks.select(
                key, skew.CLASS, F.lit(None).cast(id_type).alias(probe_id),
                F.col(mark_at).alias("_at"), F.lit(1).alias("_side"),
            )
        )
        .where(F.col(key).isNotNull() & F.col("_at").isNotNull())
    )
    sliced, cut = _tagged(points, [key], "_at", slice_seconds, hot_rows)
    sliced = sliced.withColumn("_mark", F.when(F.col("_side") == 1, F.col("_at")))
    group = [key, SLICE]
    # Both frames grow row by row; a frame that shrinks would be computed anew for every row.
    grow = (Window.unboundedPreceding, Window.currentRow)
    back = Window.partitionBy(*group).orderBy("_at", "_side").rowsBetween(*grow)
    ahead = Window.partitionBy(*group).orderBy(F.desc("_at"), F.desc("_side")).rowsBetween(*grow)
    # Marks leave the stream as soon as the running values are known.
    local = sliced.repartition(*group).select(
        *group, probe_id, "_side",
        F.count("_mark").over(back).alias("_upto"),
        F.max("_mark").over(back).alias("_prev"),
        F.min("_mark").over(ahead).alias("_next"),
    ).where(F.col("_side") != 1)
    if cut:
        earlier = Window.partitionBy(key).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
        later = Window.partitionBy(key).orderBy(F.desc(SLICE)).rowsBetween(Window.unboundedPreceding, -1)
        carried = (
            sliced.where(F.col(SLICE).isNotNull())
            .groupBy(*group)
            .agg(F.count("_mark").alias("_c"), F.min("_mark").alias("_min"), F.max("_mark").alias("_max"))
            .select(
                *group,
                F.sum("_c").over(earlier).alias("_n0"),
                F.max("_max").over(earlier).alias("_prev0"),
                F.min("_min").over(later).alias("_next0"),
            )
        )
        local = local.join(carried, group, "left").select(
            probe_id, "_side",
            (F.col("_upto") + F.coalesce("_n0", F.lit(0))).alias("_upto"),
            F.coalesce("_prev", "_prev0").alias("_prev"),
            F.coalesce("_next", "_next0").alias("_next"),
        )
    is_low, is_high = F.col("_side") == 0, F.col("_side") == 2
    counted = local.groupBy(probe_id).agg(
        (F.max(F.when(is_high, F.col("_upto"))) - F.max(F.when(is_low, F.col("_upto")))).alias("n_marks"),
        F.max(F.when(is_low, F.col("_next"))).alias("_first"),
        F.max(F.when(is_high, F.col("_prev"))).alias("_last"),
    )
    some = F.col("n_marks") > 0
    return counted.select(
        probe_id, "n_marks",
        F.when(some, F.col("_first")).alias("first_mark"),
        F.when(some, F.col("_last")).alias("last_mark"),
    )


# How many parts a slice with too many changes is cut into.
FINER = 1000
_LEVEL, _MICROS = "_level", "_micros"


def _finer(rows: DataFrame, dense: DataFrame, width: int) -> DataFrame:
    """Move the rows of dense slices into slices of a smaller width, counted from the start of their old one."""
    part = F.col(SLICE) + F.floor((F.col(_MICROS) - F.col(SLICE)) / width).cast("bigint") * width
    return (
        skew.lookup(rows, dense.withColumn("_dense", F.lit(True)), [SLICE, _LEVEL], "left")
        .withColumn(SLICE, F.when(F.col("_dense"), part).otherwise(F.col(SLICE)))
        .withColumn(_LEVEL, F.when(F.col("_dense"), F.col(_LEVEL) + 1).otherwise(F.col(_LEVEL)))
        .drop("_dense")
    )


def _slices(rows: DataFrame, at: str, steps: DataFrame, slice_seconds: int, most: int) -> tuple[DataFrame, DataFrame]:
    """(rows with their slice, slices): steps (at, value; one per time) put into slices of at most `most` steps.

    slices: SLICE, _inside (its steps in order), _start (struct of the last value before it). A slice is named by its
    first microsecond.
    """
    epoch, width = F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"), slice_seconds * 1_000_000

    def sliced(table, moment):
        micros = table.withColumn(_MICROS, elapsed_micros(epoch, F.col(moment)))
        start = F.col(_MICROS) - F.pmod(F.col(_MICROS), F.lit(width))
        return micros.withColumn(SLICE, start).withColumn(_LEVEL, F.lit(0))

    rows, steps, level, finer = sliced(rows, at), sliced(steps, "at"), 0, width
    while finer > 1:
        counts = steps.where(F.col(_LEVEL) == level).groupBy(SLICE, _LEVEL).agg(F.count("*").alias("_n"))
        if (counts.agg(F.max("_n")).first()[0] or 0) <= most:
            break
        dense = written(counts.where(F.col("_n") > most).select(SLICE, _LEVEL), "dense")
        level, finer = level + 1, -(-finer // FINER)
        rows, steps = _finer(rows, dense, finer), written(_finer(steps, dense, finer), "steps")

    per_slice = steps.groupBy(SLICE).agg(
        F.sort_array(F.collect_list(F.struct("at", "value"))).alias("_inside"),
        F.max_by(F.struct("value"), "at").alias("_end"),
    )
    used = rows.select(SLICE).where(F.col(SLICE).isNotNull()).distinct().join(per_slice, SLICE, "full_outer")
    # Ranges of slices, each with its own window; only one row per range goes through a window of all.
    ranged = written(used.repartitionByRange(SLICE).withColumn("_range", F.spark_partition_id()), "slices")
    before = (Window.unboundedPreceding, -1)
    inside = Window.partitionBy("_range").orderBy(SLICE).rowsBetween(*before)
    ends = ranged.groupBy("_range").agg(F.max_by("_end", F.when(F.col("_end").isNotNull(), F.col(SLICE))).alias("_last"))
    carried = ends.select(
        "_range", F.last("_last", ignorenulls=True).over(Window.orderBy("_range").rowsBetween(*before)).alias("_carried")
    )
    local = ranged.select("_range", SLICE, F.last("_end", ignorenulls=True).over(inside).alias("_local"))
    starts = local.join(F.broadcast(carried), "_range").select(SLICE, F.coalesce("_local", "_carried").alias("_start"))
    return rows.drop(_MICROS, _LEVEL), ranged.select(SLICE, "_inside").join(starts, SLICE)


def value_at(
    rows: DataFrame,
    at: str,
    changes: DataFrame,
    changed_at: str,
    tie: str,
    value: str,
    out: str,
    slice_seconds: int = 60,
    most_changes: int = 256,
) -> DataFrame:
    """Add the value set by the latest change at or before each row; NULL before the first.

    A table with one row per time slice in use holds the value that the slice starts with and the changes inside it
    (one per change time); rows look their slice up. A slice with more than most_changes changes is cut into finer
    ones, down to a microsecond. A slice may hold very many rows, such as all events of a run.
    """
    steps = (
        changes.groupBy(F.col(changed_at).alias("at"))
        .agg(F.max_by(value, tie).alias("value"))
        .where(F.col("at").isNotNull())
    )
    sliced, table = _slices(rows, at, written(steps, "changes"), slice_seconds, most_changes)
    upto = F.try_element_at(F.filter("_inside", lambda step: step["at"] <= F.col(at)), F.lit(-1))
    return (
        skew.lookup(sliced, table, [SLICE], "left")
        .withColumn("_upto", upto)
        .withColumn(out, F.when(F.col("_upto").isNotNull(), F.col("_upto.value")).otherwise(F.col("_start.value")))
        .drop(SLICE, "_inside", "_start", "_upto")
    )
