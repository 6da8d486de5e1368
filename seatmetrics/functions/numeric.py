"""Number rules shared by all operators, as column expressions.

Rounding goes half up on the binary product; a ceiling first rounds to nine places, so that 100 x 1.1 needs 110 and
not 111 seats. Null means that a source did not say, and stays null unless a rule names a value for it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Risk levels in ascending order.
RISKS = ("Low", "Moderate", "High", "Critical")


def finite(x: Column) -> Column:
    """Zero for what is not a number or infinite."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x)


def half_up(x: Column, places: int = 0) -> Column:
    scale = 10.0**places
    return F.floor(finite(x.cast("double")) * scale + 0.5).cast("double") / scale


def whole_up(x: Column) -> Column:
    """The least whole number that is not below ``x``, after rounding to nine places."""
    return F.ceil(F.round(finite(x.cast("double")), 9)).cast("bigint")


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return F.try_divide(a.cast("double"), F.when(b != 0, b.cast("double")))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x))


def or_zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def yearly_trend(slope: Column, mean: Column) -> Column:
    """Slope a day as a percentage of the mean a year; zero without a slope or a mean."""
    return or_zero(ratio(slope * 365 * 100, mean))


def risk_rank(risk: Column) -> Column:
    out = F.when(risk == RISKS[0], 0)
    for k, name in enumerate(RISKS[1:], 1):
        out = out.when(risk == name, k)
    return out


def worst(*risks: Column) -> Column:
    """The highest of several risks, of which any may be null; Low if all are."""
    rank = F.greatest(F.lit(0), *[F.coalesce(risk_rank(r), F.lit(0)) for r in risks])
    return F.element_at(F.array(*map(F.lit, RISKS)), rank + 1)


def share(x: Column, total: Column, places: int = 1) -> Column:
    """``x`` as a percentage of ``total``; zero if the total is not positive."""
    return F.when(total > 0, half_up(ratio(x, total) * 100, places)).otherwise(F.lit(0.0))
