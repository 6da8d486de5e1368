"""Named users: who uses an assigned seat, which seats could be taken back, and how many are needed."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seatmetrics.functions.dates import days_idle
from seatmetrics.functions.numeric import half_up, or_zero, share
from seatmetrics.operators.sizing import Options, sized

NAMED = ("named_user", "subscription")
# Buckets of the inactivity histogram with their last day.
BUCKETS = (("0–30 days", 30), ("31–60 days", 60), ("61–90 days", 90), ("91–180 days", 180), ("180+ days", None), ("Never used", None))


def is_candidate(as_of: date, threshold: int) -> Column:
    """An assigned seat never used, or idle for the threshold."""
    idle = days_idle(F.col("last_used"), as_of)
    return F.col("assigned") & (idle.isNull() | (idle >= threshold))


def named_user_metrics(activity: DataFrame, features: DataFrame, as_of: date, options: Options = Options()) -> DataFrame:
    """One row for each feature of ``features`` (feature_id, entitled, unit_price) with assigned seats."""
    idle = days_idle(F.col("last_used"), as_of)
    seats = activity.where("assigned").groupBy("feature_id").agg(
        F.count("*").alias("observed_users"), F.count(F.when(F.col("last_used").isNull(), 1)).alias("never_used"),
        *[F.count(F.when(idle <= d, 1)).alias(f"active{d}") for d in (30, 60, 90, 180)],
        F.count(F.when(is_candidate(as_of, options.reclaim_days), 1)).alias("reclaim_candidates"),
    )
    rows = features.select("feature_id", "entitled", "unit_price").join(seats, "feature_id")
    rows = rows.withColumn("assigned", F.when(F.col("entitled") > 0, F.col("entitled")).otherwise(F.col("observed_users")))
    rows = rows.withColumn("active_users", F.col("observed_users") - F.col("reclaim_candidates"))
    return rows.select(
        "feature_id", "assigned", "active_users", "never_used", "active30", "active60", "active90", "active180", "reclaim_candidates",
        half_up(F.col("reclaim_candidates") * F.col("unit_price"), 2).alias("reclaim_value"), share(F.col("active_users"), F.col("assigned")).alias("utilization_pct"),
        "observed_users", F.greatest(F.col("assigned") - F.col("observed_users"), F.lit(0).cast("bigint")).alias("seats_without_user"),
    )


def named_user_sizing(metrics: DataFrame, options: Options = Options()) -> DataFrame:
    """Active users with growth and buffer, plus seats whose holder was never observed."""
    columns = sized(F.col("active_users").cast("double"), F.col("assigned"), options, F.col("seats_without_user").cast("double"))
    return metrics.select("feature_id", F.col("assigned").alias("entitled"), *columns)


def reclaim_queue(activity: DataFrame, features: DataFrame, people: DataFrame, as_of: date, options: Options = Options()) -> DataFrame:
    """Seats to take back, never used ones first, then the longest idle."""
    named = features.where(F.col("license_model").isin(*NAMED)).select("feature_id", "unit_price")
    rows = activity.where(is_candidate(as_of, options.reclaim_days)).join(named, "feature_id")
    rows = rows.join(people.select("employee_id", "display_name", "department"), "employee_id", "left")
    out = rows.select("feature_id", "employee_id", "display_name", "department", "last_used", days_idle(F.col("last_used"), as_of).alias("idle_days"), F.col("unit_price").alias("annual_value"))
    return out


def reclaim_value(queue: DataFrame) -> DataFrame:
    return queue.agg(half_up(or_zero(F.sum("annual_value")), 2).alias("reclaim_value"), F.count("*").alias("seats"), F.count("annual_value").alias("priced_seats"))


def inactivity_histogram(activity: DataFrame, as_of: date) -> DataFrame:
    """Six buckets, also the empty ones."""
    idle = days_idle(F.col("last_used"), as_of)
    bucket = F.when(idle.isNull(), 5).when(idle <= 30, 0).when(idle <= 60, 1).when(idle <= 90, 2).when(idle <= 180, 3).otherwise(4)
    counts = activity.where("assigned").groupBy(bucket.alias("place")).count()
    names = activity.sparkSession.createDataFrame([(k, name) for k, (name, _) in enumerate(BUCKETS)], "place int, bucket string")
    return names.join(counts, "place", "left").select("place", "bucket", F.coalesce("count", F.lit(0)).cast("bigint").alias("seats"))
