"""The portfolio: one row for each feature, composed from feature-grain results by equi-joins on the feature.

Evidence decides first: a feature without any usage, token or activity row keeps null metrics, and its recommended
quantity is what it has. No step collects rows or loops over features.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seatmetrics.functions.dates import days_until
from seatmetrics.functions.numeric import half_up, or_zero, ratio, worst
from seatmetrics.operators import confidence as trust
from seatmetrics.operators.demand import capacity_risk, concurrent_metrics
from seatmetrics.operators.denied import classified, denial_sums
from seatmetrics.operators.seats import NAMED, named_user_metrics
from seatmetrics.operators.sizing import Options, financials, right_sizing, sized
from seatmetrics.operators.tokens import token_metrics
from seatmetrics.sources.estate import Estate
from seatmetrics.sources.shared import settle

CONCURRENT = ("concurrent", "hybrid", "custom")
#: Dimension attributes that every row carries.
ATTRIBUTES = ("feature_id", "feature_name", "product_id", "vendor_id", "vendor_name", "license_model", "entitled", "served_quantity", "purchased_quantity", "unit_price", "contract_id", "renewal_date")


def commitment(rows: DataFrame) -> DataFrame:
    """Purchased and served side by side; the purchased side is never derived from the served one."""
    served = F.coalesce("served_quantity", F.when(F.col("entitled") > 0, F.col("entitled")))
    return rows.withColumns(
        {
            "purchased_commitment": half_up(F.col("purchased_quantity") * F.col("unit_price"), 2),
            "served_value": half_up(served * F.col("unit_price"), 2),
            "quantity_difference": served - F.col("purchased_quantity"),
        }
    )


def portfolio(estate: Estate, options: Options = Options()) -> DataFrame:
    window = estate.window(options.period)
    features = estate.features().select(*ATTRIBUTES)
    model = F.col("license_model")
    concurrent = features.where(model.isin(*CONCURRENT))
    by_day = estate.by_day(window, (*CONCURRENT, "token"))

    metrics = concurrent_metrics(by_day.select("feature_id", "date", "peak"), concurrent, window, options.percentile)
    metrics = metrics.withColumn("capacity", F.when(F.col("observed_days") > 0, capacity_risk(metrics)))
    metrics = metrics.select("feature_id", "observed_days", "p95", F.col("basis").alias("sizing_basis"), "max_peak", "trend_pct", "utilization_pct", "saturation_days", "capacity")
    seats = named_user_metrics(estate.activity(NAMED), features.where(model.isin(*NAMED)), estate.as_of, options).select("feature_id", "assigned", "active_users", "reclaim_candidates", "reclaim_value", "seats_without_user")
    tokens = token_metrics(by_day.select("feature_id", "date", "token_hours", "peak_tokens"), features.where(model == "token"), window).select("feature_id", F.col("used_pct").alias("token_used_pct"), F.col("risk").alias("token_risk"))
    denials = denial_sums(estate.denials(window), window)

    joined = features.join(metrics, "feature_id", "left").join(seats, "feature_id", "left").join(tokens, "feature_id", "left").join(denials, "feature_id", "left")
    # A row for each feature: kept, so that what follows, and the plans that branch over the portfolio, are planned over files.
    rows = settle(joined, "portfolio-parts")
    seen = F.coalesce(F.col("observed_days") > 0, F.lit(False)) | F.col("assigned").isNotNull() | F.col("token_risk").isNotNull()
    days = F.when(model.isin(*CONCURRENT), F.when(seen, F.col("observed_days"))).when((model == "token") | F.col("assigned").isNotNull(), F.lit(window.days))
    rows = rows.withColumns({"usage_evidence": F.when(seen, "observed").otherwise("not_supplied"), "observed_days": F.coalesce(days, F.lit(0)).cast("bigint")})
    rows = rows.withColumn("denial_risk", classified()).drop("denial_days", "distinct_users", "worst", "peak_hour", "first_denial", "last_denial", "s", "k")

    by_peaks, by_seats = sized(F.col("sizing_basis"), F.col("entitled"), options)[2], sized(F.col("active_users").cast("double"), F.col("entitled"), options, F.col("seats_without_user").cast("double"))[2]
    recommended = F.when(F.col("assigned").isNotNull(), by_seats).when(seen & model.isin(*CONCURRENT), by_peaks)
    rows = rows.withColumns({"sized": recommended.isNotNull(), "recommended": F.coalesce(recommended, F.col("entitled"))})
    rows = commitment(financials(rows))
    rows = rows.withColumns({"risk": worst(F.col("capacity"), F.col("denial_risk"), F.col("token_risk")), "days_to_renewal": days_until(estate.as_of, F.col("renewal_date"))})
    context = trust.Context(window.days, employee_rate=1.0, feature_rate=1.0, has_denials=True, has_forecast=options.headcount_growth is not None)
    return trust.confidence(rows, context).drop("sizing_basis", "strengths", "weaknesses")


#: Sums of money among the totals.
MONEY = ("annual_spend", "purchased_commitment", "commitment_gap", "recommended_spend", "opportunity", "incremental", "net_change")


def priced_totals(totals: DataFrame) -> DataFrame:
    """``totals`` with unknown instead of zero money where nothing carries a price."""
    evidence = (F.col("priced_features") > 0) | (F.col("purchased_priced") > 0)
    return totals.withColumns({c: F.when(evidence, F.col(c)) for c in MONEY})


def table_totals(rows: DataFrame) -> DataFrame:
    """The foot of a filtered table: rows, and sums that are unknown if none of the rows has a price."""
    any_priced = F.count("current_cost") > 0
    return rows.agg(F.count("*").alias("features"), *[F.when(any_priced, half_up(or_zero(F.sum(c)), 2)).alias(n) for c, n in (("current_cost", "cost"), ("opportunity", "opportunity"), ("incremental", "incremental"))])


def totals(rows: DataFrame) -> DataFrame:
    """One row of sums; vendors are added up first, so that the largest one needs no second pass."""
    by_vendor = rows.groupBy("vendor_id").agg(
        F.sum("current_cost").alias("spend"), F.sum("recommended_cost").alias("rec"), F.sum("opportunity").alias("opp"), F.sum("incremental").alias("inc"),
        F.sum("purchased_commitment").alias("bought"), F.count("purchased_commitment").alias("bought_n"), F.count("unit_price").alias("priced"), F.count("*").alias("n"),
    )
    agg = by_vendor.agg(*[or_zero(F.sum(c)).alias(c) for c in ("spend", "rec", "opp", "inc", "bought")], *[F.sum(c).alias(c) for c in ("bought_n", "priced", "n")], F.count("spend").alias("vendors"), F.max("spend").alias("top"))
    return agg.select(
        half_up(F.col("spend"), 2).alias("annual_spend"), half_up(F.col("bought"), 2).alias("purchased_commitment"), F.col("bought_n").alias("purchased_priced"),
        half_up(F.col("bought") - F.col("spend"), 2).alias("commitment_gap"), half_up(F.col("rec"), 2).alias("recommended_spend"), half_up(F.col("opp"), 2).alias("opportunity"),
        half_up(F.col("inc"), 2).alias("incremental"), half_up(F.col("rec") - F.col("spend"), 2).alias("net_change"), F.col("priced").alias("priced_features"),
        (F.col("n") - F.col("priced")).alias("unpriced_features"), F.col("vendors").alias("vendor_count"), half_up(or_zero(ratio(F.col("top"), F.col("spend"))), 4).alias("vendor_concentration"),
    )


def unused_capacity(rows: DataFrame) -> DataFrame:
    """Entitled concurrent capacity above P95, in money."""
    unused = F.greatest(F.col("entitled") - F.col("p95"), F.lit(0.0))
    counted = rows.where((F.col("license_model") == "concurrent") & F.col("unit_price").isNotNull() & (F.col("usage_evidence") == "observed") & (unused > 0))
    return counted.agg(half_up(or_zero(F.sum(unused * F.col("unit_price"))), 2).alias("amount"), F.count("*").alias("features"))


def data_quality(rows: DataFrame, unmatched: DataFrame) -> DataFrame:
    """Rules that hold: id, severity and how many are affected; one pass over the rows.

    ``unmatched``: one row with the number of users without a person. A feature that is used without any agreement is
    unmapped.
    """
    counts = rows.agg(
        F.count(F.when((F.col("usage_evidence") == "observed") & F.col("contract_id").isNull(), 1)).alias("unmapped"),
        F.count(F.when(F.col("unit_price").isNull(), 1)).alias("unpriced"),
        F.count(F.when((F.col("observed_days") > 0) & (F.col("observed_days") < 90), 1)).alias("short_history"),
        F.count(F.when((F.col("observed_days") > 0) & (F.lit(365) - F.col("observed_days") > 20), 1)).alias("missing_days"),
    )
    counts = counts.join(F.broadcast(unmatched.select("users")))
    users, features = F.col("users"), F.col("unmapped")
    rules = [
        ("unmatched_users", F.when(users > 25, "critical").otherwise("warning"), users),
        ("unmapped_features", F.when(features > 10, "critical").otherwise("warning"), features),
        ("unpriced", F.lit("warning"), F.col("unpriced")),
        ("short_history", F.lit("warning"), F.col("short_history")),
        ("missing_days", F.lit("info"), F.col("missing_days")),
    ]
    flat = counts.select(F.explode(F.array(*[F.struct(F.lit(i).alias("issue"), s.alias("severity"), n.alias("affected")) for i, s, n in rules])).alias("r"))
    return flat.select("r.*").where("affected > 0")


def filtered(rows: DataFrame, text: str = "", vendor: str | None = None, model: str | None = None, elevated: bool = False) -> DataFrame:
    """The portfolio table's filters: a text in any of four columns, a vendor, a model, elevated risk only."""
    out = rows
    if text:
        out = out.where(F.lower(F.concat_ws(" ", "feature_name", "feature_id", "product_id", "vendor_name")).contains(text.lower()))
    if vendor:
        out = out.where(F.col("vendor_id") == vendor)
    if model:
        out = out.where(F.col("license_model") == model)
    return out.where(F.col("risk").isin("High", "Critical")) if elevated else out


def sort_key(name: str, descending: bool) -> list[Column]:
    """Unknown numbers count as least; undated renewals as latest."""
    key = F.coalesce(F.col(name), F.lit(float("inf"))) if name == "days_to_renewal" else F.coalesce(F.col(name), F.lit(-1)) if name not in ("feature_name", "vendor_name") else F.col(name)
    return [key.desc() if descending else key.asc(), F.col("feature_id")]


def cost_bridge(rows: DataFrame) -> DataFrame:
    """Current spend, savings, additions and the result, with the running total of a waterfall: four rows; unknown where nothing carries a price."""
    t = priced_totals(totals(rows))
    steps = [(1, "current", F.col("annual_spend")), (2, "savings", -F.col("opportunity")), (3, "additions", F.col("incremental"))]
    flat = t.select(F.explode(F.array(*[F.struct(F.lit(k).alias("seq"), F.lit(n).alias("step"), x.alias("amount")) for k, n, x in steps])).alias("s")).select("s.*")
    return flat.withColumn("running_total", half_up(F.sum("amount").over(W.orderBy("seq").rowsBetween(W.unboundedPreceding, 0)), 2))


#: Assumptions to start from: how many observations count, and the options.
PRESETS = {
    "defaults": (365, Options()),
    "conservative": (730, Options(percentile=0.99, growth=1.1, safety=1.2)),
    "aggressive": (365, Options(percentile=0.9, safety=1.0)),
}


def scenario_detail(daily: DataFrame, features: DataFrame, options: Options = Options(), observations: int = 365) -> DataFrame:
    """Each feature with peaks under the assumptions of a scenario: its last ``observations`` days that were observed, whatever their dates, and a price raised by ``escalation_pct``."""
    last = daily.withColumn("place", F.row_number().over(W.partitionBy("feature_id").orderBy(F.col("date").desc()))).where(F.col("place") <= observations)
    price = F.col("unit_price") * (1 + options.escalation_pct / 100)
    peaks = last.select("feature_id", "peak").join(features.select("feature_id", "entitled", price.alias("unit_price")), "feature_id")
    rows = peaks.groupBy("feature_id", "entitled", "unit_price").agg(
        F.count("*").alias("observed_days"), F.round(F.percentile("peak", F.lit(options.percentile)), 6).alias("_basis"), F.round(F.percentile("peak", F.lit(0.95)), 6).alias("p95"), F.max("peak").alias("max_peak"), F.count(F.when(F.col("peak") >= F.col("entitled"), 1)).alias("saturation_days"),
    )
    used = or_zero(F.when(F.col("entitled") > 0, half_up(ratio(F.col("p95"), F.col("entitled")) * 100, 1)))
    rows = rows.withColumns({"utilization_pct": used, "saturation_pct": half_up(ratio(F.col("saturation_days"), F.col("observed_days")) * 100, 1)})
    rows = rows.withColumn("risk", capacity_risk(rows)).select("feature_id", "entitled", "unit_price", "observed_days", *sized(F.col("_basis"), F.col("entitled"), options)[:3], "max_peak", "utilization_pct", "saturation_days", "risk")
    return financials(rows)


def scenario(estate: Estate, options: Options) -> DataFrame:
    """All features with peaks under other assumptions, as one row of sums."""
    features = estate.features()
    sized_rows = right_sizing(estate.daily(estate.window(options.period)), features, estate.window(options.period), options).select("feature_id", "entitled", "recommended")
    rows = financials(sized_rows.join(features.select("feature_id", "unit_price"), "feature_id"))
    return rows.agg(F.count("*").alias("features"), F.sum("recommended").alias("recommended"), half_up(F.sum("opportunity"), 2).alias("opportunity"), half_up(F.sum("incremental"), 2).alias("incremental"))
