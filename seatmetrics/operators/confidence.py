"""How far a row can be trusted: 100 points less a deduction for each weakness of its evidence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seatmetrics.functions.numeric import half_up, or_zero, ratio

# Least scores of the levels.
HIGH, MEDIUM = 80, 55


@dataclass(frozen=True)
class Context:
    """What holds for all rows; a rate of None is skipped."""

    window_days: int
    employee_rate: float | None = None
    feature_rate: float | None = None
    has_denials: bool = False
    has_forecast: bool = False


def level(score: Column) -> Column:
    return F.when(score >= HIGH, "High").when(score >= MEDIUM, "Medium").otherwise("Low")


def weight(level_name: Column) -> Column:
    return F.when(level_name == "High", 1.0).when(level_name == "Medium", 0.75).otherwise(0.5)


def _rate(rate: float | None, good: float, fair: float, some: int, much: int) -> int:
    return 0 if rate is None or rate >= good else some if rate >= fair else much


def deductions(observed: Column, price: Column, context: Context) -> list[tuple[str, Column]]:
    """(label, points) in the order of the checks."""
    cover = or_zero(ratio(observed, F.lit(context.window_days)))
    fixed = F.lit
    return [
        ("Observation period", F.when(observed >= 300, 0).when(observed >= 150, 10).when(observed >= 60, 22).otherwise(38)),
        ("Data completeness", F.when(cover >= 0.95, 0).when(cover >= 0.8, 8).otherwise(20)),
        ("Pricing", F.when(price.isNotNull(), 0).otherwise(18)),
        ("Employee mapping", fixed(_rate(context.employee_rate, 0.95, 0.85, 7, 16))),
        ("Feature mapping", fixed(_rate(context.feature_rate, 0.98, 0.9, 6, 14))),
        ("Denials", fixed(0 if context.has_denials else 6)),
        ("Forecast inputs", fixed(0 if context.has_forecast else 5)),
    ]


def confidence(rows: DataFrame, context: Context) -> DataFrame:
    """``rows`` (observed_days, unit_price) with confidence_score, confidence and the labels of what was good and what was not."""
    parts = deductions(F.col("observed_days"), F.col("unit_price"), context)
    total = parts[0][1]
    for _, points in parts[1:]:
        total = total + points
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.lit(100) - total)).cast("bigint")
    skipped = {label for label, rate in (("Employee mapping", context.employee_rate), ("Feature mapping", context.feature_rate)) if rate is None}
    good = F.array_compact(F.array(*[F.when(p == 0, F.lit(label)) for label, p in parts if label not in skipped]))
    bad = F.array_compact(F.array(*[F.when(p > 0, F.lit(label)) for label, p in parts]))
    return rows.withColumns({"confidence_score": score, "confidence": level(score), "strengths": good, "weaknesses": bad})


def summary(rows: DataFrame) -> DataFrame:
    mean = half_up(or_zero(F.avg("confidence_score")))
    counted = rows.agg(mean.cast("bigint").alias("score"), F.count(F.when(F.col("confidence") == "High", 1)).alias("high"), F.count(F.when(F.col("confidence") == "Low", 1)).alias("low"), F.count("*").alias("features"))
    return counted.withColumn("level", level(F.col("score")))
