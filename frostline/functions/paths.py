"""Path and object-key expressions."""

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def full_path(parent: Column, name: Column) -> Column:
    """Parent and name joined by one slash; a trailing slash of the parent is not doubled."""
    return F.when(parent.endswith("/"), F.concat(parent, name)).otherwise(
        F.concat(parent, F.lit("/"), name)
    )


def aws_key(path: Column) -> Column:
    """Object key of a path in the cold store: the path without leading slashes."""
    return F.regexp_replace(path, "^/+", "")


def s3_key(path: Column, root: Column) -> Column:
    """Object key of a path below a bucket root.

    The root test is a plain prefix test, not aligned to path segments.
    """
    below_root = F.substring(path, F.length(root) + 1, F.length(path))
    return aws_key(F.when(path.startswith(root), below_root).otherwise(path))


def dest_uri(bucket: Column, key: Column) -> Column:
    return F.concat(F.lit("s3://"), bucket, F.lit("/"), key)


def bucket_segment(parent: Column) -> Column:
    """Bucket (and view) name of a directory: its second path segment, else its first."""
    segments = F.split(F.btrim(parent, F.lit("/")), "/")
    return F.coalesce(F.get(segments, 1), F.get(segments, 0))


def normalized_roots(paths: Sequence[str]) -> list[str]:
    """Configured source paths without blanks, empty entries and trailing slashes."""
    trimmed = (p.strip() for p in paths)
    return [p.rstrip("/") or "/" for p in trimmed if p]


def under_any(parent: Column, roots: Sequence[str]) -> Column:
    """True where the directory is one of the roots or lies below one.

    No roots means no path restriction.
    """
    tests = []
    for root in normalized_roots(roots):
        below = root if root.endswith("/") else root + "/"
        tests.append((parent == root) | parent.startswith(below))
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(True)


def mapped_bucket(path: Column, buckets: Mapping[str, str]) -> Column:
    """Bucket of the longest prefix that the path starts with; NULL where none does.

    One look-up for each length in use, in a map that is part of the plan. A mapping kept as a table is
    joined instead (operators.prefixes).
    """
    if not buckets:
        return F.lit(None).cast("string")
    table = F.create_map(*(F.lit(part) for pair in buckets.items() for part in pair))
    lengths = sorted({len(prefix) for prefix in buckets}, reverse=True)
    return F.coalesce(*(
        F.when(F.length(path) >= n, F.try_element_at(table, F.substring(path, 1, n))) for n in lengths
    ))
