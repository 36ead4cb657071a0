"""Column expressions for dates and seasons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def season(month: Column) -> Column:
    """Meteorological season of the northern hemisphere; null for other months than 1 to 12."""
    return (
        F.when(month.isin(12, 1, 2), "Winter").when(month.isin(3, 4, 5), "Spring")
        .when(month.isin(6, 7, 8), "Summer").when(month.isin(9, 10, 11), "Autumn")
    )


def campaign_season(month: Column) -> Column:
    """Spring for April, Autumn for October, Other for other months, Unknown for null."""
    return F.when(month.isNull(), "Unknown").when(month == 4, "Spring").when(month == 10, "Autumn").otherwise("Other")


def safe_date(year: Column, month: Column, day: Column) -> Column:
    """A date, null where the parts make none (30 February)."""
    return F.try_make_timestamp(year.cast("int"), month.cast("int"), day.cast("int"), F.lit(0), F.lit(0), F.lit(0)).cast("date")


def day_of_year_date(year: Column, day: Column) -> Column:
    """A date from a year and the day in it."""
    return F.date_add(F.make_date(year.cast("int"), F.lit(1), F.lit(1)), day.cast("int") - 1)


def interval_start(date: Column, days: int) -> Column:
    """First day of the interval of so many days that a date lies in; intervals begin anew on 1 January."""
    return F.date_add(F.trunc(date, "year"), (F.floor((F.dayofyear(date) - 1) / days) * days).cast("int"))


def month_bin(date: Column, months: int) -> Column:
    """First day of the bin of so many months, counted from January 1970."""
    index = (F.year(date) - 1970) * 12 + F.month(date) - 1
    return F.add_months(F.lit("1970-01-01").cast("date"), (F.floor(index / months) * months).cast("int"))
