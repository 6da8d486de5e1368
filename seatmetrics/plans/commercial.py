"""Renewals, reconciliation, allocation of cost, managers: plans over the portfolio and the people."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seatmetrics.functions.dates import days_until
from seatmetrics.functions.numeric import half_up, or_zero, ratio
from seatmetrics.operators.confidence import level
from seatmetrics.operators.demand import guarded_trend
from seatmetrics.operators.seats import NAMED

# Cumulative windows of the renewal exposure, in days.
EXPOSURE = (30, 60, 90, 180, 365)
DIMENSIONS = ("department", "location", "region", "manager_key", "status")
#: What an activity weighs under each allocation method.
WEIGHTS = {
    "usage_duration": lambda: F.col("total_hours"),
    "assigned_users": lambda: F.when(F.col("assigned"), 1.0).otherwise(0.0),
    "proportional_activity": lambda: F.col("total_sessions").cast("double"),
    "token_consumption": lambda: F.col("total_hours"),
    "distinct_observed_users": lambda: F.when(used(), 1.0).otherwise(0.0),
}


#: What no activity carries any evidence for: nothing is allocated.
NO_METHOD = "none"


def _weight(method: str) -> Column:
    return F.lit(0.0) if method == NO_METHOD else WEIGHTS[method]()


def used() -> Column:
    return (F.col("total_sessions") > 0) | (F.col("total_hours") > 0) | F.col("last_used").isNotNull()


# ---- renewals ----------------------------------------------------------------------------------------------------


def stage(days: Column) -> Column:
    """Where a renewal is on its way, by the days that are left: the nearer the date, the later the stage."""
    return F.when(days <= 0, "renewed").when(days <= 30, "finalize").when(days <= 60, "negotiate").when(days <= 90, "recommend").when(days <= 120, "validate").otherwise("analyze")


def urgency(days: Column) -> Column:
    return F.when(days.isNull(), "unknown").when(days < 0, "lapsed").when(days <= 30, "critical").when(days <= 60, "high").when(days <= 90, "medium").otherwise("low")


def renewals(portfolio: DataFrame) -> DataFrame:
    """One row for each contract with features: sums of the priced ones, exposure, trend weighted by spend, confidence."""
    trend = guarded_trend(F.col("observed_days"), F.col("trend_pct"))
    weight = F.when(trend.isNotNull(), F.coalesce("current_cost", F.lit(1.0)))
    agg = portfolio.where("contract_id IS NOT NULL").groupBy("contract_id", "vendor_id", "vendor_name", "renewal_date", "days_to_renewal").agg(
        F.count("*").alias("items"), F.sum("current_cost").alias("cost"), F.sum("recommended_cost").alias("rec"), F.sum("opportunity").alias("opp"), F.sum("incremental").alias("inc"),
        F.count(F.when(F.col("risk").isin("High", "Critical"), 1)).alias("capacity_exposure"), F.sum(trend * weight).alias("tw"), F.sum(weight).alias("w"), F.avg("confidence_score").alias("c"),
    )
    score = half_up(F.col("c")).cast("bigint")
    return agg.select(
        "contract_id", "vendor_id", "vendor_name", "renewal_date", "days_to_renewal", stage(F.col("days_to_renewal")).alias("stage"), urgency(F.col("days_to_renewal")).alias("urgency"), "items",
        half_up(F.col("cost"), 2).alias("current_spend"), half_up(F.col("rec"), 2).alias("recommended_spend"), half_up(F.col("opp"), 2).alias("opportunity"), half_up(F.col("inc"), 2).alias("incremental"),
        "capacity_exposure", half_up(ratio(F.col("tw"), F.col("w")), 1).alias("trend_pct"), score.alias("confidence_score"), level(score).alias("confidence"),
    )


def renewal_exposure(lines: DataFrame) -> DataFrame:
    """Cumulative windows, then lapsed and undated lines: each line is counted in every window that reaches it."""
    days, cost = F.col("days_to_renewal"), F.col("current_cost")
    windows = [F.when((days >= 0) & (days <= w), F.lit(str(w))) for w in EXPOSURE]
    bucket = F.when(days.isNull(), F.array(F.lit("undated"))).when(days < 0, F.array(F.lit("lapsed"))).otherwise(F.array_compact(F.array(*windows)))
    names = lines.sparkSession.createDataFrame([(str(w),) for w in EXPOSURE] + [("lapsed",), ("undated",)], "bucket string")
    flat = lines.select(F.explode(bucket).alias("bucket"), cost.alias("cost"), "opportunity").groupBy("bucket").agg(F.count("*").alias("n"), F.sum("cost").alias("cost"), F.count(F.when(F.col("cost").isNull(), 1)).alias("unpriced"), F.sum("opportunity").alias("opp"))
    zero = F.lit(0).cast("bigint")
    return names.join(flat, "bucket", "left").select("bucket", F.coalesce("n", zero).alias("lines"), half_up(or_zero(F.col("cost")), 2).alias("annual_cost"), F.coalesce("unpriced", zero).alias("unpriced_lines"), half_up(or_zero(F.col("opp")), 2).alias("opportunity"))


def renewal_priority(rows: DataFrame) -> DataFrame:
    """Within 90 days first, then by spend and opportunity."""
    value = or_zero(F.col("current_spend")) + or_zero(F.col("opportunity"))
    return rows.select("contract_id", "days_to_renewal", (F.col("days_to_renewal") <= 90).alias("soon"), half_up(value, 2).alias("value")).orderBy(F.col("soon").desc(), F.col("value").desc(), "contract_id")


# ---- reconciliation ----------------------------------------------------------------------------------------------


def reconcile(rows: DataFrame, unresolved: Column | None = None) -> DataFrame:
    """``rows`` (feature_id, served_quantity, purchased_quantity, unit_price): state, difference and its value."""
    served, bought = F.col("served_quantity"), F.col("purchased_quantity")
    state = F.when(unresolved, "unresolved_identity") if unresolved is not None else F.when(F.lit(False), "")
    state = state.when(served.isNull() & bought.isNull(), "agree").when(served.isNull(), "contract_only").when(bought.isNull(), "entitlement_only").when(served == bought, "agree")
    state = state.when(bought > served, "contract_exceeds_entitlement").otherwise("entitlement_exceeds_contract")
    difference = served - bought
    return rows.select("feature_id", served.alias("served_quantity"), bought.alias("purchased_quantity"), state.alias("state"), difference.alias("difference"), half_up(F.abs(difference) * F.col("unit_price"), 2).alias("difference_value"))


#: Disagreements come first in a list of states.
STATE_ORDER = ("entitlement_exceeds_contract", "contract_exceeds_entitlement", "contract_only", "entitlement_only", "unresolved_identity", "agree")


def reconciliation_order(states: DataFrame) -> DataFrame:
    """``states`` with their rank: over-deployment, then over-purchase, then one source only, then the rest; larger values first."""
    place = {"contract_only": 2, "entitlement_only": 2, "unresolved_identity": 3, "agree": 4, "entitlement_exceeds_contract": 0, "contract_exceeds_entitlement": 1}
    rank = F.lit(4)
    for name in STATE_ORDER:
        rank = F.when(F.col("state") == name, place[name]).otherwise(rank)
    return states.select("feature_id", "state", rank.alias("rank"), "difference_value").orderBy("rank", F.coalesce("difference_value", F.lit(0.0)).desc(), "feature_id")


def reconciliation_summary(states: DataFrame) -> DataFrame:
    differ = F.col("state").isin("contract_exceeds_entitlement", "entitlement_exceeds_contract")
    return states.agg(
        F.count("*").alias("features"), F.count(F.when(F.col("state") == "agree", 1)).alias("agreeing"), F.count(F.when(differ, 1)).alias("disagreeing"),
        F.count(F.when(F.col("state") == "contract_only", 1)).alias("contract_only"), F.count(F.when(F.col("state") == "entitlement_only", 1)).alias("entitlement_only"),
        half_up(or_zero(F.sum(F.when(differ, F.col("difference_value")))), 2).alias("value_at_stake"), F.count(F.when(differ & F.col("difference_value").isNull(), 1)).alias("unpriced"),
        F.count(F.when(F.col("state") == "entitlement_exceeds_contract", 1)).alias("over_deployed"),
    )


# ---- allocation --------------------------------------------------------------------------------------------------


def _grouped_value(dimension: str) -> Column:
    return F.nullif(F.trim(F.col(dimension)), F.lit(""))


def allocate(activity: DataFrame, people: DataFrame, costs: DataFrame, dimension: str, method: str) -> DataFrame:
    """Each feature's cost shared among the values of a dimension by weight; the share of people without a value leaves.

    ``costs``: feature_id, current_cost, waste. Activity is added up by (feature, value) before anything meets, and a
    feature's total weight is a second group-by on those sums, so no task holds the rows of one feature.
    """
    weight = _weight(method)
    placed = activity.join(people.select("employee_id", _grouped_value(dimension).alias("grp")), "employee_id", "left")
    cells = placed.groupBy("feature_id", "grp").agg(
        F.sum(F.when(weight > 0, weight)).alias("weight"), F.sum("total_hours").alias("hours"), F.sum("total_sessions").alias("sessions"), F.count(F.when(F.col("assigned"), 1)).alias("assigned"),
        F.count(F.when(F.col("total_sessions") > 0, 1)).alias("active"), F.count(F.when(used(), 1)).alias("observed"),
    )
    full = cells.groupBy("feature_id").agg(F.sum("weight").alias("full"))
    rows = cells.where("grp IS NOT NULL").join(full, "feature_id").join(costs.select("feature_id", "current_cost", "waste"), "feature_id")
    part = ratio(F.col("weight"), F.col("full"))
    by_value = rows.groupBy("grp").agg(
        or_zero(F.sum(F.col("current_cost") * part)).alias("spend"), or_zero(F.sum(F.when(F.col("current_cost").isNotNull(), F.col("waste") * part))).alias("waste"),
        F.sum("hours").alias("hours"), F.sum("sessions").alias("sessions"), F.sum("assigned").alias("assigned_licenses"), F.sum("active").alias("active_users"), F.sum("observed").alias("observed_users"),
    )
    heads = people.where("status = 'active'").groupBy(_grouped_value(dimension).alias("grp")).agg(F.count("*").alias("headcount")).where("grp IS NOT NULL")
    total = by_value.agg(F.sum("spend").alias("total"))
    out = by_value.join(heads, "grp", "left").join(F.broadcast(total))
    head = F.coalesce("headcount", F.lit(0)).cast("bigint")
    return out.select(
        "grp", half_up(F.col("spend"), 2).alias("allocated_spend"), half_up(or_zero(ratio(F.col("spend") * 100, F.col("total"))), 1).alias("share_pct"), half_up(F.col("hours"), 1).alias("usage_hours"),
        "sessions", "assigned_licenses", "active_users", "observed_users", head.alias("headcount"), half_up(F.col("waste"), 2).alias("potential_waste"), half_up(ratio(F.col("spend"), head), 2).alias("cost_per_engineer"),
    )


def allocation_check(activity: DataFrame, people: DataFrame, costs: DataFrame, dimension: str, method: str) -> DataFrame:
    """One row: allocated + unallocated = allocatable, and what identities without a value took."""
    weight = _weight(method)
    placed = activity.where(weight > 0).join(people.select("employee_id", _grouped_value(dimension).alias("grp")), "employee_id", "left")
    sums = placed.groupBy("feature_id").agg(F.sum(weight).alias("full"), F.sum(F.when(F.col("grp").isNotNull(), weight)).alias("named"))
    rows = costs.where("current_cost IS NOT NULL").join(sums, "feature_id", "left")
    part = or_zero(ratio(F.col("named"), F.col("full")))
    return rows.agg(
        half_up(or_zero(F.sum(F.col("current_cost") * part)), 2).alias("allocated"), half_up(or_zero(F.sum(F.col("current_cost") * (1 - part))), 2).alias("unallocated"), half_up(or_zero(F.sum("current_cost")), 2).alias("allocatable"),
        half_up(or_zero(F.sum(F.when(F.col("full").isNotNull(), F.col("current_cost") * (1 - part)))), 2).alias("unresolved_identity_cost"), F.count(F.when(F.col("full").isNull(), 1)).alias("features_without_activity"),
    )


def automatic_method(activity: DataFrame, costs: DataFrame) -> str:
    """The best method that the evidence carries, or none: one row of flags decides on the driver."""
    flags = activity.agg(F.bool_or(F.col("total_hours") > 0).alias("hours"), F.bool_or(used()).alias("users"), F.bool_or("assigned").alias("seats")).collect()[0]
    return "usage_duration" if flags["hours"] else "distinct_observed_users" if flags["users"] else "assigned_users" if flags["seats"] else NO_METHOD


def drill_path(activity: DataFrame, people: DataFrame) -> DataFrame:
    """Hours by region, location and department with subtotals, in one pass."""
    named = activity.join(people.select("employee_id", "region", "location", "department"), "employee_id")
    return named.rollup("region", "location", "department").agg(F.sum("total_hours").alias("hours"), F.countDistinct("employee_id").alias("users"), F.grouping_id().cast("bigint").alias("level"))


# ---- managers ----------------------------------------------------------------------------------------------------


def manager_rollup(people: DataFrame, activity: DataFrame, features: DataFrame, as_of: date, reclaim_days: int = 90) -> DataFrame:
    """Reports, active reports, seats and seats to take back by manager: the key where there is one, else the name."""
    key = F.when(F.col("manager_key").isNotNull(), F.concat(F.lit("key:"), F.lower(F.trim("manager_key")))).otherwise(F.concat(F.lit("name:"), F.coalesce("manager_name", F.lit(""))))
    led = people.where("manager_key IS NOT NULL OR manager_name IS NOT NULL").withColumn("manager", key)
    # The least of texts needs a sort, so it is taken over the few names of a manager and not over all people.
    names = led.groupBy("manager", "manager_name", F.col("manager_key").isNotNull().alias("linked")).agg(F.count("*").alias("reports"))
    reports = names.groupBy("manager").agg(F.sum("reports").alias("reports"), F.min("manager_name").alias("manager_name"), F.bool_or("linked").alias("linked"))
    named = features.where(F.col("license_model").isin(*NAMED)).select("feature_id", "unit_price", F.lit(True).alias("named"))
    rows = activity.join(led.select("employee_id", "manager"), "employee_id").join(named, "feature_id", "left")
    seat = F.col("assigned") & F.coalesce("named", F.lit(False))
    idle = seat & (days_until(as_of, F.col("last_used")) <= -reclaim_days)
    # Distinct employees and features are counted over sums by (manager, employee) and (manager, feature), not by expanding every row.
    people_of = rows.groupBy("manager", "employee_id").agg(F.bool_or(used()).alias("used"), F.count(F.when(seat, 1)).alias("seats"), F.count(F.when(idle, 1)).alias("idle"), F.sum(F.when(idle, F.col("unit_price"))).alias("value"))
    acts = people_of.groupBy("manager").agg(F.count(F.when(F.col("used"), 1)).alias("active_reports"), F.sum("seats").alias("assigned_seats"), F.sum("idle").alias("reclaim_candidates"), F.sum("value").alias("value"))
    acts = acts.join(rows.select("manager", "feature_id").distinct().groupBy("manager").agg(F.count("*").alias("features_used")), "manager")
    zero = F.lit(0).cast("bigint")
    out = reports.join(acts, "manager", "left")
    counts = [F.coalesce(c, zero).alias(c) for c in ("active_reports", "features_used", "assigned_seats", "reclaim_candidates")]
    return out.select("manager", "manager_name", "linked", "reports", *counts, F.when(F.col("reclaim_candidates") > 0, half_up(F.col("value"), 2)).alias("reclaim_value"))


def vendor_spend(portfolio: DataFrame) -> DataFrame:
    return portfolio.groupBy("vendor_id", "vendor_name").agg(half_up(or_zero(F.sum("current_cost")), 2).alias("spend"), F.count("*").alias("features"))


def spend_shares(vendors: DataFrame) -> DataFrame:
    """``vendors`` (vendor_id, spend) with each one's share of the whole; unknown where nothing is spent."""
    total = vendors.agg(F.sum("spend").alias("total"))
    return vendors.join(F.broadcast(total)).select("vendor_id", "spend", half_up(ratio(F.col("spend") * 100, F.col("total")), 1).alias("share_pct"))


def positions_order(portfolio: DataFrame) -> DataFrame:
    """Positions by renewal date; those without a date last, the dearest of them first."""
    undated = F.col("renewal_date").isNull()
    return portfolio.select("feature_id", "renewal_date", "current_cost").orderBy(F.col("renewal_date").asc_nulls_last(), F.when(undated, or_zero(F.col("current_cost"))).desc(), "feature_id")


def demand_drivers(activity: DataFrame, people: DataFrame, by: str, top: int = 5) -> DataFrame:
    """The ``top`` values of a dimension by hours, with their share of all hours; a report, so the limit is its meaning."""
    sums = activity.join(people.select("employee_id", F.col(by).alias("grp")).where("grp IS NOT NULL"), "employee_id").groupBy("grp").agg(F.sum("total_hours").alias("hours"))
    total = sums.agg(F.sum("hours").alias("total"))
    return sums.join(F.broadcast(total)).select("grp", "hours", half_up(or_zero(ratio(F.col("hours") * 100, F.col("total"))), 1).alias("share_pct")).orderBy(F.col("hours").desc(), "grp").limit(top)


def cost_per_head(portfolio: DataFrame, people: DataFrame, activity: DataFrame) -> DataFrame:
    """Spend for each active employee and for each observed user."""
    spend = portfolio.agg(or_zero(F.sum("current_cost")).alias("spend"))
    heads = people.where("status = 'active'").agg(F.count("*").alias("engineers"))
    users = activity.where(used()).agg(F.countDistinct("employee_id").alias("users"))
    one = spend.join(F.broadcast(heads)).join(F.broadcast(users))
    return one.select(half_up(F.col("spend"), 2).alias("spend"), "engineers", "users", half_up(ratio(F.col("spend"), F.col("engineers")), 2).alias("cost_per_engineer"), half_up(ratio(F.col("spend"), F.col("users")), 2).alias("cost_per_active_user"))
