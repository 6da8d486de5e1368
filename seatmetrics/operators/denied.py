"""Denials: how many, when, to whom, and whether they show a lack of capacity. They never enter a recommended quantity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seatmetrics.functions.dates import Window
from seatmetrics.functions.numeric import half_up, or_zero, ratio


def denial_risk(d: dict[str, Column]) -> Column:
    """First rule that holds: refused by a rule, a burst of few users, then rates and days."""
    rule = (d["mean"].isNotNull()) & (d["entitled"] > 0) & (d["mean"] < d["entitled"] * 0.95)
    burst = (d["concentration"] >= 0.7) & (d["users"] <= 2)
    return F.when(rule | burst, "Low").when((d["rate"] >= 0.15) & (d["users"] >= 5), "Critical").when((d["rate"] >= 0.07) | ((d["users"] >= 8) & (d["days"] >= 5)), "High").when(d["days"] >= 2, "Moderate").otherwise("Low")


def denial_sums(denials: DataFrame, window: Window) -> DataFrame:
    """One row for each feature with denials in the window: counts, days, users, the worst day, the peak hour.

    Days and hours are counted by a first group-by, so a feature's denials need not meet in one task.
    """
    inside = denials.where(window.holds(F.col("date")))
    cells = inside.groupBy("feature_id", "date", "hour").agg(F.sum("count").alias("n"), F.sum("concurrent_at_denial").alias("s"), F.count("concurrent_at_denial").alias("k"))
    days = cells.groupBy("feature_id", "date").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("k").alias("k"))
    by_day = days.groupBy("feature_id").agg(F.sum("n").alias("total_denials"), F.count("*").alias("denial_days"), F.max("n").alias("worst"), F.min("date").alias("first_denial"), F.max("date").alias("last_denial"), F.sum("s").alias("s"), F.sum("k").alias("k"))
    hours = cells.where("hour BETWEEN 0 AND 23").groupBy("feature_id", "hour").agg(F.sum("n").alias("n"))
    peak = hours.groupBy("feature_id").agg(F.max_by("hour", F.struct(F.col("n"), -F.col("hour"))).alias("peak_hour"))
    users = inside.groupBy("feature_id").agg(F.countDistinct("employee_id").alias("distinct_users"))
    return by_day.join(peak, "feature_id", "left").join(users, "feature_id")


def mean_at_denial() -> Column:
    return F.when(F.col("k") > 0, half_up(ratio(F.col("s"), F.col("k")), 1))


def classified() -> Column:
    """The risk of a row that holds ``denial_sums``, entitled and observed_days; null without denials."""
    parts = {"mean": mean_at_denial(), "entitled": F.col("entitled"), "concentration": ratio(F.col("worst"), F.col("total_denials")), "users": F.col("distinct_users"), "days": F.col("denial_days"), "rate": or_zero(ratio(F.col("denial_days"), F.col("observed_days")))}
    return F.when(F.col("total_denials").isNotNull(), denial_risk(parts))


def denial_metrics(denials: DataFrame, features: DataFrame, window: Window) -> DataFrame:
    """One row for each feature of ``features`` (feature_id, entitled, observed_days) with denials in the window."""
    rows = denial_sums(denials, window).join(features.select("feature_id", "entitled", "observed_days"), "feature_id")
    concentration = half_up(ratio(F.col("worst"), F.col("total_denials")), 3)
    return rows.select("feature_id", "total_denials", "denial_days", "distinct_users", concentration.alias("concentration"), "peak_hour", "first_denial", "last_denial", mean_at_denial().alias("mean_concurrent_at_denial"), classified().alias("risk"))


def denials_by_hour(denials: DataFrame) -> DataFrame:
    """24 slots, also the empty ones."""
    slots = denials.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    return slots.join(denials.groupBy("hour").agg(F.sum("count").alias("n")), "hour", "left").select("hour", F.coalesce("n", F.lit(0)).cast("bigint").alias("denials"))


def denials_by_group(denials: DataFrame, people: DataFrame, group: str) -> DataFrame:
    """By a dimension of the people; whoever has none counts as unattributed."""
    named = denials.join(people.select("employee_id", F.col(group).alias("grp")), "employee_id", "left")
    return named.groupBy(F.coalesce("grp", F.lit("Unattributed")).alias("grp")).agg(F.sum("count").alias("denials")).orderBy(F.col("denials").desc(), "grp")
