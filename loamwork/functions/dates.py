"""Dates as they are logged: several formats, ages and confidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accepted formats, tried in order after epoch seconds.
FORMATS = ("yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")


def parse_date(c: Column) -> Column:
    """A timestamp from epoch seconds or one of ``FORMATS``, else null. An offset is read but not applied: the wall time counts as UTC."""
    text = F.trim(c)
    number = F.when(text.rlike(r"^-?\d+(\.\d+)?$"), F.timestamp_seconds(text.try_cast("double")))
    wall = F.regexp_replace(text, r"(Z|[+-]\d{2}:\d{2})$", "")
    shaped = text.rlike(r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}:\d{2}(\.\d{1,6})?(Z|[+-]\d{2}:\d{2})?)?$")
    return F.coalesce(number, F.when(shaped, wall.try_cast("timestamp")))


def date_confidence(c: Column, lo: str, hi: str) -> Column:
    """'high' if the date lies in the inclusive range, else 'low'; null gives 'low'."""
    return F.when(c.between(F.lit(lo), F.lit(hi)), "high").otherwise("low")


def age_days(c: Column, today: Column) -> Column:
    return F.datediff(today, c.cast("date"))


def recency(age: Column, most: int = 30) -> Column:
    """100 for today or later, falling to 0 at ``most`` days; unknown gives 0."""
    return F.when(age.isNull(), 0).when(age <= 0, 100).when(age >= most, 0).otherwise((100 * (1 - age / most)).cast("int"))


def months_old(stamp: Column, year: int, month: int) -> Column:
    """Months between a yyyy-MM stamp and the given month."""
    y, m = F.split(stamp, "-")[0].cast("int"), F.split(stamp, "-")[1].cast("int")
    return F.lit(year * 12 + month) - (y * 12 + m)


def date_range(today: Column, days: int) -> Column:
    """Struct (first, last) of the ``days`` days up to today."""
    return F.struct(F.date_sub(today, days).alias("first"), today.cast("date").alias("last"))


def stale_stamps(text: Column, year: int, month: int, most: int) -> Column:
    """yyyy-MM stamps on lines that speak of 'verified' and are more than ``most`` months older than the given month."""
    stamps = F.flatten(F.transform(F.filter(F.split(text, "\n"), lambda x: x.rlike("(?i)verified")), lambda x: F.regexp_extract_all(x, F.lit(r"\b(20\d{2}-(?:0[1-9]|1[0-2]))\b"), 1)))
    return F.filter(stamps, lambda s: months_old(s, year, month) > most)
