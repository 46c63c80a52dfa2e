"""Column expressions over numbers and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def money(c: Column) -> Column:
    return c.cast("decimal(18,2)")


def total(c: Column) -> Column:
    """A sum of money that is 0 over nothing."""
    return money(F.coalesce(F.sum(c), F.lit(0)))


def ratio(a: Column, b: Column, digits: int = 4) -> Column:
    """a / b as a rounded double, 0 where b is 0 or null."""
    return F.coalesce(F.round(F.try_divide(a.cast("double"), b.cast("double")), digits), F.lit(0.0))


def even_ratio(a: Column, b: Column, digits: int = 4) -> Column:
    """a / b of decimals, rounded half to even; 0 where b is 0 or null."""
    return F.coalesce(F.bround(F.try_divide(a.cast("decimal(18,2)"), b.cast("decimal(18,2)")), digits), F.lit(0)).cast(f"decimal(28,{digits})")


def cents(c: Column) -> Column:
    return (c * 100).cast("bigint")


def month(c: Column) -> Column:
    return F.trunc(c, "MM")


def label(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM")


def rolling_start(ref: Column, months: int) -> Column:
    """First day of the earliest of ``months`` calendar months that end with that of ``ref``."""
    return F.add_months(F.trunc(ref, "MM"), -(months - 1))


def month_later(day: Column, months: Column) -> Column:
    """The same day ``months`` later, or the month's last one where it has no such day."""
    return F.add_months(day, months)


def relative_start(text: Column, today: Column, most: int = 3650) -> Column:
    """The day that ``YYYY-MM-DD``, ``-Nd`` or ``Nd`` names, N days before ``today``; null for anything else and for more than ``most`` days."""
    days = F.regexp_extract(text, r"^-?(\d{1,4})d$", 1).try_cast("int")
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd")).when(days <= most, F.date_sub(today, days))


def week_label(c: Column) -> Column:
    """ISO year and week, as 2026-W19."""
    return F.concat(F.extract(F.lit("YEAROFWEEK"), c).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(c).cast("string"), 2, "0"))


def period(kind: Column, days: Column, ref: Column) -> Column:
    """(label, start, end) of a report: the ISO week, the month before, a look back of 30 days; ``days`` overrides the length."""
    lookback = F.when(days.isNull(), F.date_sub(ref, 30)).when(kind == "anomaly", F.date_sub(ref, days)).otherwise(F.date_sub(ref, days - 1))
    week = F.trunc(ref, "WEEK")
    first = F.add_months(F.trunc(ref, "MM"), -1)
    usual = days.isNull()
    start = F.when(usual & (kind == "weekly"), week).when(usual & (kind == "monthly"), first).otherwise(lookback)
    end = F.when(usual & (kind == "weekly"), F.date_add(week, 6)).when(usual & (kind == "monthly"), F.last_day(first)).otherwise(ref)
    text = F.when(usual & (kind == "weekly"), week_label(ref)).when(usual & (kind == "monthly"), label(first)).otherwise(F.concat(start.cast("string"), F.lit("/"), end.cast("string")))
    return F.struct(text.alias("label"), start.alias("start"), end.alias("end"))


def parsed_period(text: Column) -> Column:
    """(start, end) of a label that ``period`` writes; nulls for anything else."""
    week = text.rlike(r"^\d{4}-W\d{2}$")
    year = F.left(text, F.lit(4)).try_cast("int")
    monday = F.date_add(F.trunc(F.make_date(year, F.lit(1), F.lit(4)), "WEEK"), (F.substr(text, F.lit(7), F.lit(2)).try_cast("int") - 1) * 7)
    first = F.try_to_date(F.when(text.rlike(r"^\d{4}-\d{2}$"), F.concat(text, F.lit("-01"))), "yyyy-MM-dd")
    ends = F.split(text, "/")
    span = text.rlike(r"^\d{4}-\d{2}-\d{2}/\d{4}-\d{2}-\d{2}$")
    return F.struct(
        F.when(week, monday).when(span, F.try_to_date(ends[0], "yyyy-MM-dd")).otherwise(first).alias("start"),
        F.when(week, F.date_add(monday, 6)).when(span, F.try_to_date(F.get(ends, 1), "yyyy-MM-dd")).otherwise(F.last_day(first)).alias("end"),
    )
