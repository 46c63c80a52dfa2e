"""Listings: filtered, ordered and cut, with the count of all that the filter leaves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def where_equal(rows: DataFrame, **equal) -> DataFrame:
    """Rows whose columns have the values given; None asks for nothing."""
    for name, value in equal.items():
        if value is not None:
            rows = rows.where(F.col(name) == value)
    return rows


def listed(rows: DataFrame, *order: Column, limit: int, offset: int = 0, **equal) -> DataFrame:
    """A page of what the filter leaves: the filter comes first, then order, then limit."""
    return where_equal(rows, **equal).orderBy(*order).offset(offset).limit(limit)


def open_or_since(bookings: DataFrame, since: str, column: str = "booking_date") -> DataFrame:
    """Bookings since a day; those without a day, or marked ``offen``, always."""
    day = F.col(column)
    return bookings.where(day.isNull() | day.isin("", "offen") | (day >= since))


def latest(rows: DataFrame, time: str, n: int = 1, **equal) -> DataFrame:
    """The ``n`` newest rows of a kind."""
    return listed(rows, F.desc(time), F.col("run_id"), limit=n, **equal)
