"""Small pieces that several reports use."""

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frostline.functions import times
from frostline.operators import skew

GIB = 1024.0**3


def gib(size: Column) -> Column:
    """Bytes in GiB as DOUBLE."""
    return size.cast("double") / GIB


def newest(rows: DataFrame, at: str, tie: str, limit: int | None = None) -> DataFrame:
    """Newest first, ties in the order of the id; at most `limit` rows."""
    ordered = rows.orderBy(F.col(at).desc(), F.col(tie))
    return ordered if limit is None else ordered.limit(limit)


def since(column: str, as_of: datetime, **back: float) -> Column:
    """Strictly later than some time before as_of."""
    return F.col(column) > times.before(as_of, **back)


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def of_elements(rows: DataFrame, handles: str | DataFrame) -> DataFrame:
    """Rows of one element, or of all elements in a DataFrame with the column element_handle."""
    if isinstance(handles, str):
        return rows.where(F.col("element_handle") == handles)
    return skew.lookup(rows, handles.select("element_handle").distinct(), ["element_handle"], "left_semi")
