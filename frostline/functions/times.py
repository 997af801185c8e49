"""Time expressions on zone-less (UTC wall clock) timestamps.

All of them are independent of the session time zone.
"""

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F


def ntz(moment: datetime) -> Column:
    """Literal of a moment; aware datetimes are taken to UTC first."""
    if moment.tzinfo is not None:
        moment = moment.astimezone(timezone.utc).replace(tzinfo=None)
    return F.expr(f"TIMESTAMP_NTZ '{moment.isoformat(sep=' ')}'")


def before(as_of: datetime, **back: float) -> Column:
    """Literal of a moment some time before as_of; a literal reaches the scan as a filter."""
    return ntz(as_of - timedelta(**back))


def plus_micros(moment: datetime, micros: int) -> Column:
    return ntz(moment + timedelta(microseconds=micros))


def elapsed_micros(start: Column, end: Column) -> Column:
    """Microseconds from start to end as BIGINT."""
    gap = end - start
    days = F.extract(F.lit("DAY"), gap).cast("bigint")
    hours = F.extract(F.lit("HOUR"), gap).cast("bigint")
    minutes = F.extract(F.lit("MINUTE"), gap).cast("bigint")
    seconds = F.extract(F.lit("SECOND"), gap)
    return ((days * 24 + hours) * 60 + minutes) * 60_000_000 + (seconds * 1_000_000).cast("bigint")


def days_since(moment: Column, as_of: Column) -> Column:
    """Whole 24-hour periods from moment to as_of, rounded down also when negative."""
    gap = as_of - moment
    days = F.extract(F.lit("DAY"), gap).cast("int")
    return F.when(gap < F.make_dt_interval(days), days - 1).otherwise(days)


def iso_format(moment: Column) -> Column:
    """ISO 8601 text; the fraction has six digits and is left out when it is zero."""
    text = moment.cast("string")
    to_second = F.concat(F.substring(text, 1, 10), F.lit("T"), F.substring(text, 12, 8))
    fraction = F.substring(text, 21, 6)
    return F.when(fraction == "", to_second).otherwise(
        F.concat(to_second, F.lit("."), F.rpad(fraction, 6, "0"))
    )


def time_slice(moment: Column, seconds: int) -> Column:
    """Number of the time slice, `seconds` long, that holds the moment."""
    day = F.unix_date(moment.cast("date")).cast("bigint")
    second = ((day * 24 + F.hour(moment)) * 60 + F.minute(moment)) * 60 + F.second(moment)
    return F.floor(second / seconds).cast("bigint")


def run_id(as_of: datetime, prefix: str = "schedule") -> str:
    """Run id of a run started at as_of; prefix is `schedule` or `manual`."""
    return f"{prefix}-{as_of:%Y%m%d-%H%M%S}"


def run_id_at(moment: Column, prefix: str = "schedule") -> Column:
    """The same run id for a column of start times."""
    digits = F.regexp_replace(F.substring(moment.cast("string"), 1, 19), "[-:]", "")
    return F.concat(F.lit(prefix + "-"), F.replace(digits, F.lit(" "), F.lit("-")))
