"""Joins and filters for rows whose keys may be very uneven."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Keys are put into this many classes. Tables with a row per class are broadcast: they stay
# within some tens of megabytes, however many keys there are.
CLASSES = 1 << 20
CLASS = "_class"


def classed(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add the class of the key, unless the rows have it already."""
    if CLASS in rows.columns:
        return rows
    return rows.withColumn(CLASS, F.pmod(F.xxhash64(*keys), F.lit(CLASSES)))


def lookup(rows: DataFrame, table: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join rows to a table in which each key occurs once; how is inner, left, left_semi or left_anti.

    Adaptive execution splits the partition of a hot key, but only where both sides are shuffled
    for the join itself. A table that comes out of an aggregate or a window is partitioned by the
    keys already and would be taken as it is. The digest as a further key calls for a shuffle of
    its own. Small tables are broadcast as in any join.
    """
    digest = F.xxhash64(*keys)
    return (
        rows.withColumn("_digest", digest)
        .join(table.withColumn("_digest", digest), [*keys, "_digest"], how)
        .drop("_digest")
    )


def sieve(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Drop most of the rows whose key is not among the wanted ones, and no others.

    Both sides are classed. What is broadcast has a fixed bound; with very many wanted keys
    nothing is dropped. The rows are not shuffled.
    """
    return rows.join(F.broadcast(wanted.select(CLASS).distinct()), CLASS, "left_semi")


def hot_classes(rows: DataFrame, limit: int) -> DataFrame:
    """The classes with more than `limit` rows; the keys of all others have at most that many."""
    return rows.groupBy(CLASS).agg(F.count("*").alias("_n")).where(F.col("_n") > limit).select(CLASS)


def flag_hot(rows: DataFrame, hot: DataFrame, out: str) -> DataFrame:
    """Add whether the class of a row is among the hot ones."""
    marked = F.broadcast(hot.withColumn(out, F.lit(True)))
    return rows.join(marked, CLASS, "left").withColumn(out, F.coalesce(out, F.lit(False)))
