"""Day arithmetic on dates without times, and the window that ends at the injected analysis date."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

# Days of the named analysis periods.
PERIODS = {"3m": 90, "6m": 182, "12m": 365, "24m": 730}


@dataclass(frozen=True)
class Window:
    """Days from ``start`` to ``end``, both included."""

    end: date
    days: int

    @property
    def start(self) -> date:
        return self.end - timedelta(days=self.days - 1)

    def holds(self, day: Column) -> Column:
        return day.between(F.lit(self.start), F.lit(self.end))


def window(as_of: date, period: str = "12m", custom_days: int | None = None) -> Window:
    return Window(as_of, custom_days or PERIODS[period])


def epoch_day(day: Column) -> Column:
    return F.unix_date(day)


def weekday(day: Column) -> Column:
    """0 is Sunday."""
    return F.dayofweek(day) - 1


def is_weekend(day: Column) -> Column:
    return F.dayofweek(day).isin(1, 7)


def days_until(as_of: date, day: Column) -> Column:
    return F.datediff(day, F.lit(as_of))


def days_idle(last: Column, as_of: date) -> Column:
    """Days since ``last``, never negative; null if it was never seen."""
    return F.when(last.isNotNull(), F.greatest(F.datediff(F.lit(as_of), last), F.lit(0)))


def day_text(day: Column) -> Column:
    return F.date_format(day, "d MMM yyyy")


def month_text(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def every_day(first: Column, last: Column) -> Column:
    return F.explode(F.sequence(first, last))
