"""Who a username is and which spellings are one feature: equal keys only, never resemblance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seatmetrics.functions.text import feature_key, user_key


def _mode(rows: DataFrame, by: str, value: str) -> DataFrame:
    """The most frequent value of each group, the smallest of equally frequent ones."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(by, value).count()
    place = F.row_number().over(W.partitionBy(by).orderBy(F.col("count").desc(), value))
    return counts.withColumn("place", place).where("place = 1").select(by, F.col(value).alias(f"common_{value}"))


def feature_identities(rows: DataFrame) -> DataFrame:
    """``rows`` (feature, vendor) by normalized key: how many, the spellings, the commonest spelling and vendor."""
    keyed = rows.withColumn("feature_key", feature_key(F.col("feature"))).where("feature_key <> ''")
    out = keyed.groupBy("feature_key").agg(F.count("*").alias("observations"), F.array_join(F.array_sort(F.collect_set("feature")), "|").alias("spellings"))
    return out.join(_mode(keyed, "feature_key", "feature"), "feature_key", "left").join(_mode(keyed, "feature_key", "vendor"), "feature_key", "left")


def _claimants(people: DataFrame, column: str, basis: str) -> DataFrame:
    """Each key with how many people claim it, and the one who does if only one."""
    keyed = people.select(user_key(F.col(column)).alias("key"), "person_id").where("key IS NOT NULL AND key <> ''")
    return keyed.groupBy("key").agg(F.countDistinct("person_id").alias(f"n_{basis}"), F.min("person_id").alias(f"p_{basis}"))


def resolve_users(usage: DataFrame, people: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Each username with its person: by confirmed alias, username, employee code, then email.

    ``usage``: user, employee_code, source_row; ``people``: person_id, username, employee_code, email; ``confirmed``:
    raw, target. At the first step that anyone claims, one claimant settles it and several make it ambiguous. Usage is
    added up by (username, code) before the joins; the code of a username that decides is the first to resolve.
    """
    seen = usage.where("user IS NOT NULL").withColumn("key", user_key(F.col("user"))).where("key <> ''")
    pairs = seen.groupBy("key", user_key(F.col("employee_code")).alias("code")).agg(F.count("*").alias("n"), F.min("source_row").alias("first"))
    names, codes, mails = (_claimants(people, c, b) for c, b in (("username", "username"), ("employee_code", "code"), ("email", "email")))
    rows = pairs.join(names, "key", "left").join(codes.withColumnRenamed("key", "code"), "code", "left").join(mails, "key", "left")
    targets = confirmed.select(user_key(F.col("raw")).alias("key"), user_key(F.col("target")).alias("target"))
    via = names.select(F.col("key").alias("target"), F.col("p_username").alias("person"))
    agreed = targets.join(via, "target").groupBy("key").agg(F.min("person").alias("p_confirmed"))
    rows = rows.join(agreed, "key", "left")
    step = F.when(F.col("p_confirmed").isNotNull(), F.struct(F.lit("confirmed").alias("basis"), F.lit(1).cast("bigint").alias("n"), F.col("p_confirmed").alias("person")))
    for basis in ("username", "code", "email"):
        step = step.when(F.col(f"n_{basis}") > 0, F.struct(F.lit(basis).alias("basis"), F.col(f"n_{basis}").alias("n"), F.col(f"p_{basis}").alias("person")))
    rows = rows.withColumn("step", step)
    settled = F.col("step")["n"] == 1
    # The first observation that settles a username wins; else an ambiguous one; else none.
    rank = F.struct(F.when(settled, 0).when(F.col("step").isNotNull(), 1).otherwise(2), F.col("first"))
    best = rows.groupBy("key").agg(F.sum("n").alias("observations"), F.min_by("step", rank).alias("step"))
    status = F.when(F.col("step").isNull(), "unmatched").when(F.col("step")["n"] > 1, "ambiguous").when(F.col("step")["basis"] == "confirmed", "confirmed").otherwise("matched")
    one = status.isin("confirmed", "matched")
    return best.select("key", "observations", status.alias("status"), F.when(one, F.col("step")["basis"]).alias("basis"), F.when(one, F.col("step")["person"]).alias("person_id"))


def people_without_usage(people: DataFrame, users: DataFrame) -> DataFrame:
    return people.join(users.select(F.col("person_id")).where("person_id IS NOT NULL").distinct(), "person_id", "left_anti")


def unmatched(users: DataFrame) -> DataFrame:
    return users.where(F.col("status").isin("unmatched", "ambiguous"))
