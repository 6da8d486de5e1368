"""Recommended quantities, and what they mean in money."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seatmetrics.functions.dates import Window
from seatmetrics.functions.numeric import clamp, half_up, or_zero, ratio, whole_up
from seatmetrics.operators.demand import guarded_trend


@dataclass(frozen=True)
class Options:
    """The parameters of an analysis."""

    period: str = "12m"
    percentile: float = 0.95
    growth: float = 1.0
    safety: float = 1.1
    reclaim_days: int = 90
    escalation_pct: float = 0.0
    headcount_growth: float | None = 0.05


#: Sizing methods by name: the basis of a feature from its daily peaks. An own method is one more entry.
METHODS: dict[str, Callable[[Options], Column]] = {
    "percentile": lambda o: F.percentile("peak", F.lit(min(1.0, max(0.0, o.percentile)))),
    "maximum": lambda o: F.max("peak"),
}


def sized(basis: Column, entitled: Column, options: Options, extra: Column | None = None) -> list[Column]:
    """Columns basis, raw_recommended, recommended, quantity_delta, surplus and shortfall."""
    raw = basis * options.growth * options.safety + (extra if extra is not None else F.lit(0.0))
    recommended = whole_up(raw)
    delta = recommended - entitled
    zero = F.lit(0).cast("bigint")
    return [half_up(basis, 2).alias("basis"), half_up(raw, 4).alias("raw_recommended"), recommended.alias("recommended"), delta.alias("quantity_delta"), F.greatest(-delta, zero).alias("surplus"), F.greatest(delta, zero).alias("shortfall")]


def methodology(options: Options, method: str = "percentile") -> str:
    growth, safety = f"{options.growth:.2f}", f"{options.safety:.2f}"
    if method == "maximum":
        return f"Maximum observed daily peak × {growth} growth × {safety} safety, rounded up."
    return f"P{options.percentile * 100:g} of daily peaks × {growth} growth × {safety} safety, rounded up."


def explained(sizes: DataFrame, options: Options = Options(), method: str = "percentile") -> DataFrame:
    """``sizes`` with ``days`` as ``right_sizing`` gives them, each with how it was found, in words."""
    text = F.concat(F.lit(methodology(options, method)), F.lit(" Basis "), F.format_number("basis", 2), F.lit(" from "), F.format_number("days", 0), F.lit(" days."))
    return sizes.withColumn("methodology", text)


def right_sizing(daily: DataFrame, entitled: DataFrame, window: Window, options: Options = Options(), method: str = "percentile") -> DataFrame:
    """One row for each feature with peaks in the window; a feature without any has an unknown size and no row."""
    basis = METHODS.get(method, METHODS["percentile"])(options)
    peaks = daily.where(window.holds(F.col("date"))).groupBy("feature_id").agg(F.round(basis, 6).alias("_basis"))
    rows = peaks.join(entitled.select("feature_id", "entitled"), "feature_id")
    return rows.select("feature_id", "entitled", *sized(F.col("_basis"), F.col("entitled"), options))


def sensitivity(daily: DataFrame, entitled: DataFrame, window: Window, options: Options = Options()) -> DataFrame:
    """The recommendation under five variants of the assumptions and the difference to the base: one pass over the peaks."""
    variants = {"base": options, "p90": replace(options, percentile=0.9), "p99": replace(options, percentile=0.99), "growth_10": replace(options, growth=options.growth * 1.1), "no_safety": replace(options, safety=1.0)}
    points = sorted({v.percentile for v in variants.values()})
    many = F.expr(f"percentile(peak, array({', '.join(map(str, points))}))")
    peaks = daily.where(window.holds(F.col("date"))).groupBy("feature_id").agg(many.alias("p")).join(entitled.select("feature_id", "entitled"), "feature_id")

    def amount(o: Options) -> Column:
        return whole_up(F.round(F.col("p")[points.index(o.percentile)], 6) * o.growth * o.safety)

    rows = [F.struct(F.lit(name).alias("variant"), amount(o).alias("recommended")) for name, o in variants.items()]
    flat = peaks.select("feature_id", "entitled", amount(options).alias("base"), F.explode(F.array(*rows)).alias("v"))
    return flat.select("feature_id", "v.variant", "v.recommended", (F.col("v.recommended") - F.col("base")).alias("difference"), (F.col("v.recommended") - F.col("entitled")).alias("quantity_delta"))


def financials(rows: DataFrame) -> DataFrame:
    """``rows`` (entitled, recommended, unit_price) with costs; all of them null where no price is known."""
    price, delta = F.col("unit_price"), F.col("recommended") - F.col("entitled")
    current, future = half_up(F.col("entitled") * price, 2), half_up(F.col("recommended") * price, 2)
    priced = price.isNotNull()

    def known(x: Column) -> Column:
        return F.when(priced, x)

    saved = F.when(delta < 0, half_up(-delta * price, 2)).otherwise(F.lit(0.0))
    return rows.withColumns(
        {
            "current_cost": known(current),
            "recommended_cost": known(future),
            "opportunity": known(saved),
            "incremental": known(F.when(delta > 0, half_up(delta * price, 2)).otherwise(F.lit(0.0))),
            "savings_pct": known(half_up(ratio(saved, current) * 100, 1)),
        }
    )


def baseline(percentile: float) -> str:
    """The column of the metrics that a forecast starts from."""
    return "p99" if percentile >= 0.99 else "p95" if percentile >= 0.95 else "p90" if percentile >= 0.9 else "median"


def forecast(metrics: DataFrame, options: Options = Options(), horizon_days: int = 365) -> DataFrame:
    """Demand at the horizon from the guarded and clamped trend and the growth in heads; ``metrics`` also holds unit_price."""
    years = horizon_days / 365
    trend = clamp(or_zero(guarded_trend(F.col("observed_days"), F.col("trend_pct"))), -30, 50) / 100 * years
    heads = (options.headcount_growth or 0.0) * years
    combined = (1 + trend) * (1 + heads) - 1
    demand = half_up(F.col(baseline(options.percentile)) * (1 + combined), 2)
    rows = metrics.select("feature_id", "entitled", "unit_price", F.col("p95").alias("current_p95"), half_up(trend, 4).alias("trend_growth"), F.lit(heads).alias("headcount_growth"), half_up(combined, 4).alias("combined_growth"), combined.alias("_growth"), F.col(baseline(options.percentile)).alias("_baseline"), demand.alias("forecast_demand"))
    amount = whole_up(F.col("forecast_demand") * options.safety)
    rows = rows.withColumn("recommended", amount)
    delta = F.col("recommended") - F.col("entitled")
    return rows.withColumn("financial_impact", half_up(delta * F.col("unit_price"), 2))


def trend_note(metrics: DataFrame) -> Column:
    trend, days = metrics["trend_pct"], metrics["observed_days"]
    return F.when(days < 30, "no trend: too little history").when(trend > 50, "capped").when(trend < -30, "floored")


def forecast_curve(forecasts: DataFrame, months: int = 12) -> DataFrame:
    """Linear monthly points from now to the horizon."""
    rows = forecasts.select("feature_id", "_baseline", "_growth", F.explode(F.sequence(F.lit(0), F.lit(months))).alias("month_offset"))
    return rows.select("feature_id", "month_offset", half_up(F.col("_baseline") * (1 + F.col("_growth") * (F.col("month_offset") / 12)), 1).alias("demand"))


def forecast_spend(forecasts: DataFrame, escalation_pct: float = 0.0) -> DataFrame:
    cost = F.col("recommended") * F.col("unit_price") * (1 + escalation_pct / 100)
    return forecasts.agg(half_up(or_zero(F.sum(cost)), 2).alias("forecast_spend"), F.count("unit_price").alias("priced_features"))
