"""Every registered query over the star-schema tables: name -> function of (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seatmetrics.functions.dates import window
from seatmetrics.functions.numeric import half_up
from seatmetrics.operators import confidence, demand, denied, seats, sizing, tokens
from seatmetrics.plans import commercial, portfolio, signals
from seatmetrics.sources.estate import Estate
from seatmetrics.sources.shared import settle

Query = Callable[[SparkSession, str], DataFrame]
_registered: dict[str, Query] = {}


def query(make: Callable[[Estate], DataFrame]) -> Callable[[Estate], DataFrame]:
    """Register a function of an estate under its own name."""
    _registered[make.__name__] = lambda spark, sf_dir: make(Estate(spark, sf_dir))
    return make


def queries() -> dict[str, Query]:
    from seatmetrics import evidence_queries, ingest_queries, page_queries

    return _registered | ingest_queries.queries() | page_queries.queries() | evidence_queries.queries()


def _short_daily(e: Estate) -> DataFrame:
    return demand.hourly_to_daily(demand.hourly_concurrency(e.usage())).select("feature_id", "date", "peak")


def _short_window(e: Estate):
    return window(e.events_as_of, "3m")


def _long_metrics(e: Estate) -> DataFrame:
    return demand.concurrent_metrics(e.daily(e.window()), e.features(), e.window())


def _portfolio(e: Estate) -> DataFrame:
    return portfolio.portfolio(e)


def _kept_portfolio(e: Estate) -> DataFrame:
    """For plans that branch over the portfolio: a row for each feature, computed once and read from files."""
    return settle(_portfolio(e), "portfolio")


# ---- demand ----


@query
def hourly_concurrency(e: Estate) -> DataFrame:
    return demand.hourly_concurrency(e.usage())


@query
def daily_rollup(e: Estate) -> DataFrame:
    return demand.daily_rollup(e.usage())


@query
def hourly_to_daily(e: Estate) -> DataFrame:
    return demand.hourly_to_daily(demand.hourly_concurrency(e.usage()))


@query
def concurrent_metrics(e: Estate) -> DataFrame:
    return _long_metrics(e)


@query
def capacity_risk(e: Estate) -> DataFrame:
    metrics = _long_metrics(e)
    return metrics.select("feature_id", demand.capacity_risk(metrics).alias("risk"), demand.guarded_trend(F.col("observed_days"), F.col("trend_pct")).alias("trend_pct"))


@query
def daily_series(e: Estate) -> DataFrame:
    return demand.daily_series(e.daily(e.window()), "Brand#1", e.window()).select("date", "peak")


@query
def monthly_peaks(e: Estate) -> DataFrame:
    return demand.monthly_peaks(e.daily())


@query
def hourly_profile(e: Estate) -> DataFrame:
    return demand.hourly_profile(demand.hourly_concurrency(e.usage()))


@query
def weekday_hour_grid(e: Estate) -> DataFrame:
    return demand.weekday_hour_grid(demand.hourly_concurrency(e.usage()))


@query
def user_activity(e: Estate) -> DataFrame:
    return demand.user_activity(e.usage())


@query
def denial_events(e: Estate) -> DataFrame:
    return e.event_denials()


@query
def largest_entitlement(e: Estate) -> DataFrame:
    lines = e.table("part").select(F.col("p_brand").alias("feature_id"), F.col("p_size").alias("quantity"), F.col("p_partkey").alias("source_row"))
    return demand.largest_entitlement(lines)


@query
def coverage(e: Estate) -> DataFrame:
    return demand.coverage(e.usage())


# ---- sizing and money ----


@query
def right_sizing(e: Estate) -> DataFrame:
    return sizing.right_sizing(_short_daily(e), e.event_entitlements(), _short_window(e))


@query
def right_sizing_max(e: Estate) -> DataFrame:
    return sizing.right_sizing(_short_daily(e), e.event_entitlements(), _short_window(e), method="maximum")


@query
def sensitivity(e: Estate) -> DataFrame:
    return sizing.sensitivity(e.daily(e.window()), e.features(), e.window())


@query
def financials(e: Estate) -> DataFrame:
    sized = sizing.right_sizing(e.daily(e.window()), e.features(), e.window()).select("feature_id", "entitled", "recommended")
    return sizing.financials(sized.join(e.features().select("feature_id", "unit_price"), "feature_id"))


@query
def forecast(e: Estate) -> DataFrame:
    metrics = _long_metrics(e)
    rows = metrics.join(e.features().select("feature_id", "unit_price"), "feature_id")
    return sizing.forecast(rows).drop("_growth", "_baseline").join(metrics.select("feature_id", sizing.trend_note(metrics).alias("trend_note")), "feature_id")


@query
def forecast_curve(e: Estate) -> DataFrame:
    return sizing.forecast_curve(sizing.forecast(_long_metrics(e).withColumn("unit_price", F.lit(None).cast("double"))))


@query
def forecast_spend(e: Estate) -> DataFrame:
    return sizing.forecast_spend(sizing.forecast(_long_metrics(e).join(e.features().select("feature_id", "unit_price"), "feature_id")), 3.0)


@query
def scenario_rollup(e: Estate) -> DataFrame:
    """All features under other assumptions than the default ones."""
    return portfolio.scenario(e, sizing.Options(percentile=0.99, growth=1.05, safety=1.2))


# ---- seats, tokens, denials ----


@query
def named_user_metrics(e: Estate) -> DataFrame:
    return seats.named_user_metrics(e.activity(), e.features(), e.as_of)


@query
def named_user_sizing(e: Estate) -> DataFrame:
    return seats.named_user_sizing(seats.named_user_metrics(e.activity(), e.features(), e.as_of))


@query
def reclaim_queue(e: Estate) -> DataFrame:
    """Longest idle first, never used on top."""
    rows = seats.reclaim_queue(e.activity(), e.features(), e.people(), e.as_of)
    return rows.orderBy(F.col("idle_days").desc_nulls_first(), "feature_id", "employee_id")


@query
def reclaim_value(e: Estate) -> DataFrame:
    return seats.reclaim_value(seats.reclaim_queue(e.activity(), e.features(), e.people(), e.as_of))


@query
def inactivity_histogram(e: Estate) -> DataFrame:
    return seats.inactivity_histogram(e.activity(), e.as_of)


@query
def token_metrics(e: Estate) -> DataFrame:
    return tokens.token_metrics(e.token_daily(), e.event_entitlements(), _short_window(e))


@query
def token_monthly(e: Estate) -> DataFrame:
    return tokens.monthly_tokens(e.token_daily(), _short_window(e))


@query
def peak_token_draw(e: Estate) -> DataFrame:
    return tokens.peak_token_draw(e.token_daily())


@query
def denial_metrics(e: Estate) -> DataFrame:
    features = e.features().withColumn("observed_days", F.lit(365))
    return denied.denial_metrics(e.denials(e.window()), features, e.window())


@query
def denials_by_hour(e: Estate) -> DataFrame:
    return denied.denials_by_hour(e.event_denials())


@query
def denials_by_group(e: Estate) -> DataFrame:
    return denied.denials_by_group(e.event_denials(), e.people(), "department")


# ---- the portfolio and what follows from it ----


@query
def portfolio_rows(e: Estate) -> DataFrame:
    return _portfolio(e)


def _at_percentile(p: float) -> None:
    columns = ("feature_id", "p95", "sized", "recommended", "recommended_cost", "opportunity")
    _registered[f"portfolio_p{p * 100:g}"] = lambda spark, sf_dir: portfolio.portfolio(Estate(spark, sf_dir), sizing.Options(percentile=p)).select(*columns)


for _p in (0.85, 0.97):
    _at_percentile(_p)


@query
def portfolio_totals(e: Estate) -> DataFrame:
    return portfolio.totals(_portfolio(e))


@query
def unused_capacity(e: Estate) -> DataFrame:
    return portfolio.unused_capacity(_portfolio(e))


@query
def portfolio_filter_sort(e: Estate) -> DataFrame:
    rows = portfolio.filtered(_portfolio(e), text="vendor", elevated=True)
    return rows.orderBy(*portfolio.sort_key("current_cost", True)).select("feature_id", "vendor_name", "risk", "current_cost")


@query
def cost_bridge(e: Estate) -> DataFrame:
    return portfolio.cost_bridge(_portfolio(e))


@query
def data_quality(e: Estate) -> DataFrame:
    return portfolio.data_quality(_portfolio(e), e.users_without_person())


@query
def confidence_rows(e: Estate) -> DataFrame:
    rows = _long_metrics(e).join(e.features().select("feature_id", "unit_price"), "feature_id").select("feature_id", "observed_days", "unit_price")
    scored = confidence.confidence(rows, confidence.Context(365, employee_rate=0.9, feature_rate=0.99, has_denials=True))
    return scored.select("feature_id", "confidence_score", "confidence", F.array_join("strengths", ", ").alias("strengths"), F.array_join("weaknesses", ", ").alias("weaknesses"))


@query
def portfolio_confidence(e: Estate) -> DataFrame:
    return confidence.summary(_portfolio(e))


@query
def renewals(e: Estate) -> DataFrame:
    return commercial.renewals(_portfolio(e)).orderBy("days_to_renewal", "contract_id")


@query
def renewal_exposure(e: Estate) -> DataFrame:
    return commercial.renewal_exposure(_portfolio(e))


@query
def renewal_priority(e: Estate) -> DataFrame:
    return commercial.renewal_priority(commercial.renewals(_portfolio(e)))


@query
def reconciliation(e: Estate) -> DataFrame:
    return commercial.reconcile(e.features())


@query
def reconciliation_summary(e: Estate) -> DataFrame:
    return commercial.reconciliation_summary(commercial.reconcile(e.features()))


@query
def vendor_spend(e: Estate) -> DataFrame:
    return commercial.vendor_spend(_portfolio(e)).orderBy(F.col("spend").desc(), "vendor_id")


@query
def top_opportunities(e: Estate) -> DataFrame:
    """A report of five rows."""
    rows = _portfolio(e).where("opportunity > 0")
    return rows.orderBy(F.col("opportunity").desc(), "feature_id").limit(5).select("feature_id", "opportunity", "risk")


@query
def cost_per_head(e: Estate) -> DataFrame:
    return commercial.cost_per_head(_portfolio(e), e.people(), e.activity())


@query
def signal_rows(e: Estate) -> DataFrame:
    return signals.ordered(_signals(e)).drop("seq")


@query
def decisions(e: Estate) -> DataFrame:
    stored = e.spark.createDataFrame([("renewal:contract:1", "accepted"), ("cost:Brand#1", "dismissed")], "id string, status string")
    return signals.decisions(_signals(e), stored)


def _signals(e: Estate) -> DataFrame:
    rows = _kept_portfolio(e)
    summary = commercial.reconciliation_summary(commercial.reconcile(e.features()))
    return signals.generate(rows, commercial.renewals(rows), portfolio.data_quality(rows, e.users_without_person()), summary, cost_threshold=2_500)


@query
def executive_actions(e: Estate) -> DataFrame:
    rows = _kept_portfolio(e)
    return signals.executive_actions(rows, commercial.renewals(rows))


# ---- allocation, managers, drivers ----


def _costs(e: Estate) -> DataFrame:
    cost = half_up(F.col("entitled") * F.col("unit_price"), 2)
    return e.features().select("feature_id", cost.alias("current_cost"), half_up(cost / 4, 2).alias("waste"))


def _allocation(method: str, dimension: str) -> None:
    _registered[f"allocation_{method}_{dimension}"] = lambda spark, sf_dir: commercial.allocate((e := Estate(spark, sf_dir)).activity(), e.people(), _costs(e), dimension, method).orderBy(F.col("allocated_spend").desc(), "grp")


for _method in commercial.WEIGHTS:
    _allocation(_method, "department")
for _dimension in commercial.DIMENSIONS[1:]:
    _allocation("usage_duration", _dimension)


@query
def allocation_check(e: Estate) -> DataFrame:
    return commercial.allocation_check(e.activity(), e.people(), _costs(e), "department", "usage_duration")


@query
def allocation_auto(e: Estate) -> DataFrame:
    method = commercial.automatic_method(e.activity(), _costs(e))
    return commercial.allocate(e.activity(), e.people(), _costs(e), "department", method).withColumn("method", F.lit(method))


@query
def drill_path(e: Estate) -> DataFrame:
    return commercial.drill_path(e.activity(), e.people())


@query
def manager_rollup(e: Estate) -> DataFrame:
    rows = commercial.manager_rollup(e.people(), e.activity(), e.features(), e.as_of)
    return rows.orderBy(F.col("reclaim_candidates").desc(), F.col("assigned_seats").desc(), "manager")


@query
def demand_drivers(e: Estate) -> DataFrame:
    return commercial.demand_drivers(e.activity(), e.people(), "location")


@query
def users_filter(e: Estate) -> DataFrame:
    """The users page: idle holders of one feature by free text, its first 250 rows."""
    idle = seats.days_idle(F.col("last_used"), e.as_of)
    rows = e.activity().where("feature_id = 'Brand#3'").where(idle.isNull() | (idle >= 90)).join(e.people(), "employee_id", "left")
    return rows.where(F.lower(F.concat_ws(" ", "display_name", "department")).contains("build")).orderBy(F.col("total_hours").desc(), "employee_id").limit(250).select("employee_id", "display_name", "total_hours", idle.alias("idle_days"))
