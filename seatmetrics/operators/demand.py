"""From observations to hourly concurrency, daily peaks and the distribution of peaks in a window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seatmetrics.functions.dates import Window, month_text, weekday
from seatmetrics.functions.numeric import half_up, or_zero, ratio, yearly_trend

#: A trend counts from so many observed days on.
TREND_DAYS = 30


def observations(usage: DataFrame) -> DataFrame:
    """``usage`` with what an observation says about demand: a peak stands in for a missing concurrency, a timestamp for a missing hour.

    A quantity counts checkouts and never stands in for concurrency. Hours are those of UTC.
    """

    def first(*names: str) -> Column:
        return F.coalesce(*[F.col(n) for n in names if n in usage.columns], F.lit(None))

    stamp = first("observed_at", "checkout_at").cast("timestamp_ntz")
    hour = F.coalesce(first("hour").cast("int"), F.hour(stamp))
    return usage.withColumns({"concurrent": first("concurrent", "peak").cast("double"), "hour": hour})


def observed_denials(usage: DataFrame) -> DataFrame:
    """Denials that a source states: its count, else one for each row that is flagged."""
    count = F.coalesce(F.col("denial_count"), F.when(F.col("denied"), 1.0).otherwise(0.0))
    rows = usage.withColumn("n", count).where(F.coalesce(F.col("denied"), F.lit(False)) | (F.col("n") > 0))
    return rows.select("feature_id", "date", F.coalesce("hour", F.lit(0)).alias("hour"), F.lower(F.trim("user")).alias("user"), F.col("n").alias("count"), F.col("concurrent").alias("concurrent_at_denial"))


def observed_activity(usage: DataFrame) -> DataFrame:
    """One row for each feature and user: last date, sessions and hours; rows without a user take no part.

    A checkout is a session, and a stated quantity counts as so many; a snapshot of an interval is none.
    """
    sessions = F.when(F.col("checkout_at").isNotNull(), 1.0).otherwise(F.coalesce("quantity", F.lit(0.0)))
    known = usage.where("user IS NOT NULL")
    return known.groupBy("feature_id", F.lower(F.trim("user")).alias("user")).agg(F.max("date").alias("last_used"), F.sum(sessions).alias("total_sessions"))


def hourly_concurrency(usage: DataFrame) -> DataFrame:
    """Largest reported concurrency for each feature, day and hour; rows without either take no part."""
    known = usage.where("concurrent IS NOT NULL AND hour IS NOT NULL")
    return known.groupBy("feature_id", "date", "hour").agg(F.max("concurrent").cast("double").alias("concurrent"))


def daily_rollup(usage: DataFrame) -> DataFrame:
    """Peak and mean of the hours, hours of use and distinct users of each feature and day.

    Every row counts for users and hours, also those without concurrency.
    """
    hours = hourly_concurrency(usage).groupBy("feature_id", "date").agg(F.max("concurrent").alias("peak"), F.avg("concurrent").alias("mean"))
    rows = usage.groupBy("feature_id", "date").agg(
        F.sum("duration_hours").alias("hours"),
        F.countDistinct(F.lower(F.trim("user"))).alias("unique_users"),
        F.count(F.when(F.col("concurrent").isNull(), 1)).alias("without_concurrency"),
    )
    joined = rows.join(hours, ["feature_id", "date"], "left")
    return joined.select(
        "feature_id", "date", or_zero(F.col("peak")).alias("peak"), half_up(or_zero(F.col("mean")), 3).alias("mean_concurrent"),
        half_up(or_zero(F.col("hours")), 2).alias("usage_hours"), "unique_users", "without_concurrency", F.col("peak").isNull().alias("daily_only"),
    )


def hourly_to_daily(hourly: DataFrame) -> DataFrame:
    """Peak, mean over observed hours and licence hours of each feature and day."""
    return hourly.groupBy("feature_id", "date").agg(F.max("concurrent").alias("peak"), half_up(F.avg("concurrent"), 3).alias("mean_concurrent"), F.sum("concurrent").alias("usage_hours"))


def concurrent_metrics(daily: DataFrame, entitled: DataFrame, window: Window, percentile: float | None = None) -> DataFrame:
    """Distribution of the daily peaks in the window against ``entitled`` (feature_id, entitled), one row for each of its features.

    One pass: all percentiles from one aggregate, the slope from the day's place in its series. ``percentile``: one
    more of them, as ``basis``.
    """
    shares = [0.5, 0.9, 0.95, 0.99] + ([min(1.0, max(0.0, percentile))] if percentile is not None else [])
    place = W.partitionBy("feature_id").orderBy("date")
    rows = daily.where(window.holds(F.col("date"))).join(entitled.select("feature_id", "entitled"), "feature_id", "right")
    rows = rows.withColumn("at", F.when(F.col("peak").isNotNull(), F.row_number().over(place) - 1))
    agg = rows.groupBy("feature_id", "entitled").agg(
        F.count("peak").alias("observed_days"), F.avg("peak").alias("mean"), F.percentile("peak", F.array(*map(F.lit, shares))).alias("p"),
        F.max("peak").alias("max"), F.min("peak").alias("min"), F.stddev_samp("peak").alias("sd"), F.regr_slope("peak", "at").alias("slope"),
        F.count(F.when((F.col("entitled") > 0) & (F.col("peak") >= F.col("entitled")), 1)).alias("saturation_days"),
    )

    def pick(k: int) -> Column:
        return or_zero(F.round(F.col("p")[k], 6))

    has = F.col("entitled") > 0
    return agg.select(
        "feature_id", "entitled", "observed_days", (F.lit(window.days) - F.col("observed_days")).alias("missing_days"),
        half_up(or_zero(F.col("mean")), 4).alias("mean_peak"), pick(0).alias("median"), pick(1).alias("p90"), pick(2).alias("p95"), pick(3).alias("p99"),
        or_zero(F.col("max")).alias("max_peak"), or_zero(F.col("min")).alias("min_peak"), half_up(or_zero(F.col("sd")), 4).alias("std_dev"),
        half_up(or_zero(ratio(F.col("sd"), F.col("mean"))), 4).alias("volatility"), half_up(yearly_trend(F.col("slope"), F.col("mean")), 2).alias("trend_pct"),
        F.when(has, half_up(ratio(pick(2), F.col("entitled")) * 100, 1)).otherwise(F.lit(0.0)).alias("utilization_pct"), "saturation_days",
        half_up(or_zero(ratio(F.col("saturation_days"), F.col("observed_days")) * 100), 1).alias("saturation_pct"), (F.col("entitled") - pick(2)).alias("available_capacity"),
        *([pick(4).alias("basis")] if percentile is not None else []),
    )


def capacity_risk(metrics: DataFrame) -> Column:
    """RECONSTRUCTED cut-offs: the published examples fix the order and some values, not these."""
    util, saturated = metrics["utilization_pct"], metrics["saturation_pct"]
    return F.when(metrics["entitled"] <= 0, "Low").when((saturated >= 10) | (util >= 100), "Critical").when(util >= 92, "High").when((util >= 80) | (metrics["max_peak"] >= metrics["entitled"]), "Moderate").otherwise("Low")


def guarded_trend(observed: Column, trend: Column) -> Column:
    """The trend, null below the least history."""
    return F.when(observed >= TREND_DAYS, trend)


def daily_series(daily: DataFrame, feature_id: str, window: Window) -> DataFrame:
    return daily.where((F.col("feature_id") == feature_id) & window.holds(F.col("date"))).orderBy("date")


def monthly_peaks(daily: DataFrame) -> DataFrame:
    month = month_text(F.col("date")).alias("month")
    return daily.groupBy("feature_id", month).agg(half_up(F.avg("peak"), 1).alias("mean_peak"), F.max("peak").alias("max_peak"))


def hourly_profile(hourly: DataFrame) -> DataFrame:
    """Mean concurrency in each of the 24 hours, zero for hours never seen."""
    grid = hourly.select("feature_id").distinct().withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    seen = hourly.groupBy("feature_id", "hour").agg(F.avg("concurrent").alias("mean"))
    return grid.join(seen, ["feature_id", "hour"], "left").select("feature_id", "hour", half_up(or_zero(F.col("mean")), 1).alias("mean_concurrent"))


def weekday_hour_grid(hourly: DataFrame) -> DataFrame:
    return hourly.groupBy("feature_id", weekday(F.col("date")).alias("weekday"), "hour").agg(half_up(F.avg("concurrent"), 1).alias("mean_concurrent"))


def user_activity(usage: DataFrame) -> DataFrame:
    """One row for each feature and user: last date, sessions (one for each row) and hours; rows without a user take no part."""
    known = usage.where("user IS NOT NULL")
    return known.groupBy("feature_id", F.lower(F.trim("user")).alias("user")).agg(F.max("date").alias("last_used"), F.count("*").alias("total_sessions"), half_up(or_zero(F.sum("duration_hours")), 2).alias("total_hours"))


def largest_entitlement(lines: DataFrame) -> DataFrame:
    """The largest of several served quantities of a feature, the first of equal ones: two servers report the same licences."""
    first = W.partitionBy("feature_id").orderBy(F.col("quantity").desc(), F.col("source_row"))
    return lines.withColumn("place", F.row_number().over(first)).where("place = 1").drop("place")


def coverage(usage: DataFrame) -> DataFrame:
    """Counts, distinct features and users, first and last date and days between, of one table of observations."""
    agg = usage.agg(
        F.count("*").alias("rows"), F.countDistinct("feature_id").alias("features"), F.countDistinct(F.lower(F.trim("user"))).alias("users"),
        F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.bool_or(F.col("concurrent").isNotNull()).alias("has_concurrency"),
        F.bool_or("denied").alias("has_denials"), F.bool_or(F.col("duration_hours").isNotNull()).alias("has_durations"),
    )
    return agg.withColumn("history_days", (F.datediff("last_date", "first_date") + 1).cast("bigint"))
