"""Longest-prefix mapping of paths with a mapping table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostline.operators import skew


def assign_buckets(paths: DataFrame, path: str, mapping: DataFrame) -> DataFrame:
    """Add the bucket of the longest prefix of the mapping (prefix, bucket), NULL where none fits.

    An equality join on the leading part of the path, once per prefix length in use; these are read from the
    mapping first. Paths are compared once each, however many rows share them.
    """
    lengths = [row.n for row in mapping.select(F.length("prefix").alias("n")).distinct().collect() if row.n is not None]
    if not lengths:
        return paths.withColumn("bucket", F.lit(None).cast("string"))
    distinct = paths.select(path).where(F.col(path).isNotNull()).distinct()
    sizes = F.array(*(F.lit(n) for n in sorted(lengths)))
    leads = distinct.select(
        path, F.explode(F.filter(sizes, lambda n: n <= F.length(path))).alias("_n")
    ).withColumn("prefix", F.expr(f"substring(`{path}`, 1, _n)"))
    best = (
        leads.join(mapping.select("prefix", "bucket"), "prefix")
        .groupBy(path)
        .agg(F.max_by("bucket", "_n").alias("bucket"))
    )
    return skew.lookup(paths, best, [path], "left")
