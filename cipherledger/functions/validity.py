"""Certificates' validity: whole days, rounded down, and what is remarkable about them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SOON, LONG = 90, 398  # days


def days(start: Column, end: Column) -> Column:
    """Whole days from ``start`` to ``end``, rounded down, so an hour past the end is -1."""
    return F.floor((F.unix_timestamp(end) - F.unix_timestamp(start)) / 86400).cast("int")


def flags(not_before: Column, not_after: Column, now: Column) -> Column:
    """What a report says of a validity: expired, expiring soon, long-lived; an empty text for an ordinary one."""
    left, whole = days(now, not_after), days(not_before, not_after)
    ended = F.when(left < 0, F.concat(F.lit("EXPIRED "), (-left).cast("string"), F.lit("d ago"))).when(left <= SOON, F.concat(F.lit("EXPIRES IN "), left.cast("string"), F.lit("d")))
    lasting = F.when(whole > LONG, F.concat(F.lit("long-lived ("), whole.cast("string"), F.lit("d validity)")))
    return F.concat_ws(", ", ended, lasting)
