"""The first rows of an order, however many are asked for."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frostline.sources.shared import written

# So many rows one task may hold and sort.
FEW = 100_000


def first_rows(rows: DataFrame, order: Sequence[str | Column], n: int) -> DataFrame:
    """The first n rows in an order, which should be total. A few are kept in one task, as Spark does for a sorted limit.

    More are taken from ranges of the order: whole ranges while they fit, and the first rows of the one that doesn't. Only
    one row for each range is looked at together.
    """
    if n <= FEW:
        return rows.orderBy(*order).limit(n)
    ranged = written(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = ranged.groupBy("_range").agg(F.count("*").alias("_n")).select(
        "_range", "_n", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")
    )
    used = ranged.join(before.where(F.col("_before") < n), "_range")
    fits = F.col("_before") + F.col("_n") <= n
    last = used.where(~fits).withColumn("_place", F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    return used.where(fits).select(*rows.columns).unionByName(
        last.where(F.col("_before") + F.col("_place") <= n).select(*rows.columns)
    )
