"""From canonical rows to the feature grain: which source wins where several state a quantity, a model or a date."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seatmetrics.functions.numeric import half_up, or_zero, ratio
from seatmetrics.functions.text import feature_key, user_key
from seatmetrics.operators.demand import largest_entitlement


def identity_rows(usage: DataFrame, entitlements: DataFrame, contracts: DataFrame) -> DataFrame:
    """All three sources as (feature, vendor, source): a name is known if any of them states it; only usage carries demand."""
    def named(df: DataFrame, source: str) -> DataFrame:
        return df.select("feature", F.col("vendor") if "vendor" in df.columns else F.lit(None).cast("string").alias("vendor"), F.lit(source).alias("source"))

    return named(usage, "usage").unionByName(named(entitlements, "entitlements")).unionByName(named(contracts, "contracts"))


def observed_keys(usage: DataFrame, entitlements: DataFrame) -> DataFrame:
    """Keys that a contract line may be linked to: those of usage and entitlements."""
    return usage.select(feature_key(F.col("feature")).alias("feature_key")).unionByName(entitlements.select(feature_key(F.col("feature")).alias("feature_key"))).distinct()


def assemble(keys: DataFrame, entitlements: DataFrame, positions: DataFrame) -> DataFrame:
    """One row for each key: quantity from the largest entitlement, else the contract, else 0; model from the entitlement, else the contract, else concurrent; renewal from the contract, else the expiry.

    ``entitlements``: feature_id (the key), quantity, license_model, expires_on, source_row; ``positions``:
    position_key, quantity, unit_price, license_model, renewal_date.
    """
    served = largest_entitlement(entitlements).select(F.col("feature_id").alias("feature_key"), F.col("quantity").alias("served"), F.col("license_model").alias("served_model"), "expires_on")
    bought = positions.select(F.col("position_key").alias("feature_key"), F.col("quantity").alias("bought"), "unit_price", F.col("license_model").alias("bought_model"), "renewal_date")
    both = served.join(bought, "feature_key", "full_outer")
    stated = F.when(F.col("served_model") == "node_locked", "custom").when(F.col("served_model") != "unknown", F.col("served_model"))
    rows = keys.join(both, "feature_key", "left")
    return rows.select("feature_key", F.coalesce("served", "bought", F.lit(0)).cast("bigint").alias("entitled"), F.coalesce(stated, "bought_model", F.lit("concurrent")).alias("license_model"), "unit_price", F.coalesce("renewal_date", "expires_on").alias("renewal_date"), (F.col("served").isNotNull() & F.col("bought").isNotNull()).alias("both_sources"))


def alias_map(confirmations: DataFrame, kind: str) -> DataFrame:
    """(raw, target) of the confirmed entries of a kind, the latest for each raw value; targets are normalized as keys are.

    ``confirmations``: kind, raw_value, target, decision, decided_at.
    """
    target = feature_key(F.col("target")) if kind == "feature" else user_key(F.col("target"))
    rows = confirmations.where(F.col("kind") == kind).groupBy(F.lower(F.trim("raw_value")).alias("raw")).agg(F.max_by(F.struct(target.alias("target"), F.col("decision").alias("decision")), "decided_at").alias("x"))
    return rows.where("x.decision = 'confirmed'").select("raw", "x.target")


def confirmation_state(confirmations: DataFrame) -> DataFrame:
    """How many there are and when the latest was made: part of the key of an analysis."""
    return confirmations.agg(F.count("*").alias("confirmations"), F.max("decided_at").alias("latest"))


def evidence_record(portfolio: DataFrame) -> DataFrame:
    """A row's derivation as ordered (label, value) pairs."""
    def fact(label: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.struct(F.lit(label).alias("label"), value.cast("string").alias("value")))

    c = F.col
    facts = [fact("Licence model", c("license_model")), fact("Observed days", c("observed_days")), fact("P95 demand", c("p95").cast("bigint")), fact("Entitled", c("entitled")), fact("Recommended", F.when(c("sized"), c("recommended"))), fact("Risk", c("risk")), fact("Confidence", c("confidence"))]
    return portfolio.select("feature_id", F.posexplode(F.array_compact(F.array(*facts))).alias("place", "f")).select("feature_id", "place", "f.label", "f.value")


def page_figures(portfolio: DataFrame, renewals: DataFrame, as_of: date) -> DataFrame:
    """The figures at the heads of pages: dated spend within 90 days, exposed agreements, features at risk, seats to take back."""
    rows = portfolio.agg(F.count(F.when(F.col("risk").isin("High", "Critical"), 1)).alias("at_risk"), F.count(F.when(F.col("reclaim_candidates") > 0, 1)).alias("reclaim_features"), F.sum("reclaim_candidates").alias("seats"), half_up(or_zero(F.sum(F.abs(F.coalesce("opportunity", F.lit(0.0)) - F.coalesce("incremental", F.lit(0.0))))), 2).alias("decision_impact"))
    near = F.col("days_to_renewal").between(0, 90)
    agreements = renewals.agg(half_up(or_zero(F.sum(F.when(near, F.col("current_spend")))), 2).alias("spend_90"), F.count(F.when(F.col("capacity_exposure") > 0, 1)).alias("exposed"), F.count(F.when(F.col("days_to_renewal") < 0, 1)).alias("lapsed"))
    return rows.join(F.broadcast(agreements)).withColumn("as_of", F.lit(as_of))


def agreement_drivers(portfolio: DataFrame, activity: DataFrame, people: DataFrame, contract_id: str, by: str) -> DataFrame:
    """Hours on one agreement's features by a dimension, with their share."""
    own = portfolio.where(F.col("contract_id") == contract_id).select("feature_id")
    sums = activity.join(own, "feature_id").join(people.select("employee_id", F.col(by).alias("grp")).where("grp IS NOT NULL"), "employee_id").groupBy("grp").agg(F.sum("total_hours").alias("hours"))
    return sums.join(F.broadcast(sums.agg(F.sum("hours").alias("total")))).select("grp", "hours", half_up(or_zero(ratio(F.col("hours") * 100, F.col("total"))), 1).alias("share_pct"))


def user_export(activity: DataFrame, people: DataFrame, features: DataFrame) -> DataFrame:
    """Activity with the names of who and what, for an export."""
    who = people.select("employee_id", "display_name", "department", "location")
    return activity.join(who, "employee_id", "left").join(features.select("feature_id", "feature_name", "license_model"), "feature_id", "left")
