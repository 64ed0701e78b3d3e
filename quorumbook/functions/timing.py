"""Time arithmetic on microseconds, independent of the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quorumbook.functions.rules import URGENT_SECONDS

SECOND = 1_000_000


# SQL for the microseconds since 1970 of a TIMESTAMP_NTZ column read as UTC.
MICROS_OF_NTZ = (
    "((unix_date(cast({column} as date)) * 86400L + hour({column}) * 3600 + minute({column}) * 60) * 1000000"
    " + cast(extract(second from {column}) * 1000000 as bigint))"
)


def micros_between(start: Column, end: Column) -> Column:
    return F.unix_micros(end) - F.unix_micros(start)


def seconds_left(deadline: Column, as_of: Column) -> Column:
    """Whole seconds until the deadline, rounded up, never below zero."""
    left = F.greatest(micros_between(as_of, deadline), F.lit(0).cast("bigint"))
    return F.floor((left + F.lit(SECOND - 1)) / SECOND).cast("bigint")


def countdown_text(seconds: Column) -> Column:
    minutes = F.floor(seconds / 60).cast("string")
    return F.concat(minutes, F.lit(":"), F.lpad((seconds % 60).cast("string"), 2, "0"))


def is_urgent(deadline: Column, as_of: Column) -> Column:
    return micros_between(as_of, deadline) <= URGENT_SECONDS * SECOND


def progress_percent(votes: Column, required: Column) -> Column:
    return F.least(F.lit(100.0), votes / required * 100)


def duration_parts(start: Column, end: Column) -> dict[str, Column]:
    """Days, hours and minutes of a time difference that is floored at zero."""
    minutes = F.floor(F.greatest(micros_between(start, end), F.lit(0).cast("bigint")) / (60 * SECOND))
    return {
        "days": F.floor(minutes / 1440).cast("bigint"),
        "hours": F.floor((minutes % 1440) / 60).cast("bigint"),
        "minutes": (minutes % 60).cast("bigint"),
    }
