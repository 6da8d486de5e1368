"""A made-up estate of any size, by formulas over row numbers: the same seed gives the same rows on any cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Share of the daily peak in use at each hour from midnight on.
SHAPE = (0.05, 0.05, 0.05, 0.05, 0.05, 0.1, 0.2, 0.45, 0.7, 0.9, 1.0, 0.95, 0.8, 0.9, 1.0, 0.95, 0.85, 0.6, 0.4, 0.25, 0.15, 0.1, 0.08, 0.05)


def uniform(*keys: Column, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the keys and the seed only."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 52)) / float(1 << 52)


def peaks(spark: SparkSession, features: int, days: int, p95: int = 275, low: int = 180, high: int = 314, seed: int = 7) -> DataFrame:
    """(feature_id, day, peak): for each of the made-up features the P95 of its days is exactly ``p95`` and the largest ``high``."""
    targets = spark.range(features).select(F.concat(F.lit("feature:"), F.col("id").cast("string")).alias("feature_id"), F.lit(low).alias("low"), F.lit(p95).alias("p95"), F.lit(high).alias("high"))
    return peaks_of(targets, days, seed)


def peaks_of(targets: DataFrame, days: int, seed: int = 7) -> DataFrame:
    """(feature_id, day, peak) for each row of ``targets`` (feature_id, low, p95, high): a series whose P95 and maximum are exactly these.

    Ranks by a hash decide which day gets which value: the top twentieth lies above, the two ranks around the
    percentile are equal to it, the rest climbs from ``low``.
    """
    grid = targets.withColumn("day", F.explode(F.sequence(F.lit(0), F.lit(days - 1))))
    place = F.row_number().over(W.partitionBy("feature_id").orderBy(uniform(F.col("feature_id"), F.col("day"), seed=seed), "day")) - 1
    at = int(0.95 * (days - 1))
    below, above = max(1, at), max(1, days - 1 - (at + 1))
    p95, low, high = F.col("p95"), F.col("low"), F.col("high")
    value = F.when(place < at, F.floor(low + (p95 - low) * (place / float(below)))).when(place <= at + 1, p95).otherwise(F.ceil(p95 + (high - p95) * ((place - at - 1) / float(above))))
    return grid.select("feature_id", "day", value.cast("double").alias("peak"))


def hourly(daily: DataFrame) -> DataFrame:
    """Each day's peak spread over 24 hours; its largest hour is the peak."""
    shape = F.array(*map(F.lit, SHAPE))
    rows = daily.select("*", F.posexplode(shape).alias("hour", "part"))
    return rows.withColumn("concurrent", F.floor(F.col("peak") * F.col("part") + 0.5)).drop("part", "peak")


def licence_hours(daily: DataFrame) -> DataFrame:
    return hourly(daily).groupBy("feature_id", "day").agg(F.sum("concurrent").alias("licence_hours"))


def people(spark: SparkSession, n: int, seed: int = 7) -> DataFrame:
    """Employees with a department, a site and a manager."""
    i = F.col("id")

    def pick(names: tuple[str, ...], salt: int) -> Column:
        return F.element_at(F.array(*map(F.lit, names)), (uniform(i, seed=seed + salt) * len(names)).cast("int") + 1)

    return spark.range(n).select(
        F.concat(F.lit("user:e"), F.lpad(i.cast("string"), 6, "0")).alias("employee_id"), pick(("Structures", "Fluids", "Controls", "Manufacturing"), 1).alias("department"),
        pick(("North", "South", "East"), 2).alias("location"), F.concat(F.lit("M"), (i % 40).cast("string")).alias("manager_key"), F.when(uniform(i, seed=seed + 3) < 0.05, "inactive").otherwise("active").alias("status"),
    )


def seats(spark: SparkSession, assigned: int, idle: int, as_of: str) -> DataFrame:
    """Seats of one named-user feature, of which exactly ``idle`` were last used more than 90 days ago."""
    i = F.col("id")
    ago = F.when(i < idle, 91 + (i % 200)).otherwise(i % 60)
    return spark.range(assigned).select(F.lit("feature:named").alias("feature_id"), i.alias("employee_id"), F.lit(True).alias("assigned"), F.date_sub(F.lit(as_of).cast("date"), ago.cast("int")).alias("last_used"), F.lit(1).cast("bigint").alias("total_sessions"), F.lit(1.0).alias("total_hours"))
