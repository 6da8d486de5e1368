"""Token pools: consumption, capacity, trend and risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seatmetrics.functions.dates import Window, month_text
from seatmetrics.functions.numeric import clamp, half_up, or_zero, ratio, yearly_trend


def token_risk(used_pct: Column, trend: Column) -> Column:
    return F.when(used_pct.isNull(), "Low").when(used_pct >= 95, "Critical").when(used_pct >= 85, "High").when((used_pct >= 70) | ((used_pct >= 60) & (trend > 15)), "Moderate").otherwise("Low")


def token_metrics(daily: DataFrame, features: DataFrame, window: Window, horizon_days: int = 365) -> DataFrame:
    """One row for each feature of ``features`` (feature_id, entitled: the pool) with token rows in the window."""
    inside = daily.where(window.holds(F.col("date"))).withColumn("at", F.row_number().over(W.partitionBy("feature_id").orderBy("date")) - 1)
    agg = inside.groupBy("feature_id").agg(
        F.count("*").alias("observed_days"), F.avg("token_hours").alias("mean"), F.max("token_hours").alias("max"), F.sum("token_hours").alias("used"),
        F.round(F.percentile("token_hours", F.lit(0.95)), 6).alias("p95"), F.regr_slope("token_hours", "at").alias("slope"), F.max("peak_tokens").cast("double").alias("peak_tokens"),
    )
    rows = agg.join(features.select("feature_id", "entitled"), "feature_id")
    trend = half_up(yearly_trend(F.col("slope"), F.col("mean")), 2)
    pool = F.when(F.col("entitled") > 0, half_up(F.col("entitled") * 24 * F.col("observed_days"), 2))
    used = half_up(ratio(F.col("used"), pool) * 100, 1)
    p95 = half_up(F.col("p95"), 2)
    return rows.select(
        "feature_id", "observed_days", half_up(F.col("mean"), 2).alias("mean_token_hours"), half_up(F.col("max"), 2).alias("peak_token_hours"), p95.alias("p95_token_hours"),
        pool.alias("available_token_hours"), used.alias("used_pct"), trend.alias("trend_pct"), half_up(p95 * (1 + clamp(trend, -50, 100) / 100 * (horizon_days / 365)), 2).alias("forecast_token_hours"),
        F.col("peak_tokens"), token_risk(used, trend).alias("risk"),
    )


def peak_token_draw(daily: DataFrame) -> DataFrame:
    return daily.groupBy("feature_id").agg(F.greatest(F.max("peak_tokens"), F.lit(0)).cast("bigint").alias("peak_tokens"))


def monthly_tokens(daily: DataFrame, window: Window) -> DataFrame:
    inside = daily.where(window.holds(F.col("date")))
    return inside.groupBy("feature_id", month_text(F.col("date")).alias("month")).agg(half_up(or_zero(F.sum("token_hours")), 1).alias("token_hours"))
