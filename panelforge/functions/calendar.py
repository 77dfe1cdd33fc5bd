"""Calendar columns: months as numbers, month ends, forecast years."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_number(d: Column) -> Column:
    return F.year(d) * 12 + F.month(d) - 1


def month_end(number: Column) -> Column:
    """The inverse of month_number, as the month's last day."""
    return F.last_day(F.make_date(F.floor(number / 12).cast("int"), (number % 12 + 1).cast("int"), F.lit(1)))


def next_month_end(d: Column) -> Column:
    return F.last_day(F.add_months(d, 1))


def forecast_year(formation: Column) -> Column:
    """The year a formation date forecasts: December forms for the next one."""
    return F.year(formation) + (F.month(formation) == 12).cast("int")


def is_month_end(d: Column) -> Column:
    return d == F.last_day(d)


def iso_text(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM-dd")


def parsed_date(text: Column) -> Column:
    """The date that an ISO text names; null for anything else."""
    return F.try_to_date(text, "yyyy-MM-dd") if hasattr(F, "try_to_date") else F.to_date(F.when(text.rlike(r"^\\d{4}-\\d{2}-\\d{2}$"), text))
