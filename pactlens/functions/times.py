"""Times as texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_time(at: Column) -> Column:
    """A time as ISO 8601 with a T and its offset, to the microsecond where it has a fraction; texts are read as times first, and those that are none give null."""
    t = at.try_cast("timestamp")
    form = lambda fraction: F.date_format(t, f"yyyy-MM-dd'T'HH:mm:ss{fraction}xxx")
    return F.when(F.date_trunc("second", t) == t, form("")).otherwise(form(".SSSSSS"))
