"""Registered queries of stamped observations, lists and feet of pages, assembly parts, imports and kept analyses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seatmetrics import ingest_queries
from seatmetrics.functions import dates, text
from seatmetrics.operators import contracts, demand, identity, normalize, review, seats, sizing
from seatmetrics.plans import assembly, commercial, portfolio, signals, trust
from seatmetrics.plans.projection import Projection
from seatmetrics.sources import sinks
from seatmetrics.sources.estate import Estate
from seatmetrics.sources.shared import shared_dir

Query = Callable[[SparkSession, str], DataFrame]
_registered: dict[str, Query] = {}


def query(make: Callable[[Estate], DataFrame]) -> Callable[[Estate], DataFrame]:
    _registered[make.__name__] = lambda spark, sf_dir: make(Estate(spark, sf_dir))
    return make


def queries() -> dict[str, Query]:
    return dict(_registered)


# ---- observations that have a timestamp, or only a peak ----


def raw_stamped(e: Estate) -> DataFrame:
    """The events as an export without a date column would write them: a timestamp in several forms, a checkout time, a peak or a count."""
    i, ts = F.col("event_id"), F.col("ts")
    k = F.get_json_object("props", "$.k").cast("int")
    seen = F.when(i % 4 == 0, F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).when(i % 4 == 1, F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))).when(i % 4 == 2, F.date_format(ts, "MM/dd/yyyy HH:mm"))
    return e.table("events").select(
        i.alias("source_row"),
        F.when(i % 61 == 0, F.lit("later")).otherwise(seen).alias("observed_at"),
        F.when((i % 4 == 3) & (i % 59 != 0), F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).alias("checkout_at"),
        F.concat(F.lit("Feature "), (k % 10).cast("string")).alias("feature"),
        F.concat(F.lit(" User"), F.col("user_id").cast("string")).alias("user"),
        F.when(i % 3 == 0, k.cast("string")).alias("concurrent"),
        F.when(i % 3 != 2, (k + 1).cast("string")).alias("peak"),
        F.when(i % 7 == 0, (k % 4).cast("string")).alias("quantity"),
        F.when(i % 11 == 0, F.lit("DENIED")).otherwise(F.lit("ok")).alias("denied"),
        F.when(i % 13 == 0, F.lit("2")).alias("denial_count"),
    )


def _stamped(e: Estate) -> DataFrame:
    rows = normalize.accepted(normalize.checked(raw_stamped(e), "usage")).withColumn("feature_id", text.feature_key(F.col("feature")))
    return demand.observations(rows)


@query
def stamped_usage(e: Estate) -> DataFrame:
    return _stamped(e).select("source_row", "date", "hour", "observed_at", "checkout_at", "concurrent")


@query
def stamped_rejections(e: Estate) -> DataFrame:
    return normalize.rejection_summary(normalize.checked(raw_stamped(e), "usage"))


@query
def stamped_concurrency(e: Estate) -> DataFrame:
    return demand.hourly_concurrency(_stamped(e))


@query
def stamped_denials(e: Estate) -> DataFrame:
    return demand.observed_denials(_stamped(e))


@query
def stamped_activity(e: Estate) -> DataFrame:
    return demand.observed_activity(_stamped(e))


# ---- lists and feet of pages ----


@query
def cost_gate(e: Estate) -> DataFrame:
    """Totals of features without any price: unknown, not zero."""
    return portfolio.priced_totals(portfolio.totals(portfolio.portfolio(e).where("unit_price IS NULL").withColumn("purchased_commitment", F.lit(None).cast("double"))))


@query
def table_totals(e: Estate) -> DataFrame:
    return portfolio.table_totals(portfolio.filtered(portfolio.portfolio(e), vendor="vendor:1"))


@query
def reconciliation_order(e: Estate) -> DataFrame:
    return commercial.reconciliation_order(commercial.reconcile(e.features()))


@query
def identity_order(e: Estate) -> DataFrame:
    rows = identity.feature_identities(ingest_queries.commercial_lines(e).select("feature", "vendor"))
    return rows.select("feature_key", "observations").orderBy(F.col("observations").desc(), "feature_key")


@query
def review_totals(e: Estate) -> DataFrame:
    return contracts.review_totals(ingest_queries._links(e))


@query
def user_totals(e: Estate) -> DataFrame:
    """The foot of the user queue: usernames and observations by status."""
    return ingest_queries._users(e).groupBy("status").agg(F.count("*").alias("users"), F.sum("observations").alias("observations"))


@query
def unmapped_suggestions(e: Estate) -> DataFrame:
    names = e.table("part").select("p_name", "p_partkey")
    raw = names.select(F.concat("p_name", F.lit("-TOOL")).alias("raw")).distinct()
    known = names.where("p_partkey % 3 <> 0").groupBy("p_name").agg(F.min("p_partkey").alias("n")).select(F.concat(F.lit("feature:"), "n").alias("feature_id"), F.col("p_name").alias("label"))
    return review.suggestions(raw, known)


@query
def related_by_lead(e: Estate) -> DataFrame:
    return review.related_by_lead(e.table("part").select(text.feature_key(F.col("p_name")).alias("feature_key")))


@query
def top_users(e: Estate) -> DataFrame:
    """A report of eight rows."""
    return e.activity().groupBy("employee_id").agg(F.sum("total_hours").alias("hours")).orderBy(F.col("hours").desc(), "employee_id").limit(8)


@query
def top_locations(e: Estate) -> DataFrame:
    """A report of six rows."""
    return e.activity().join(e.people().select("employee_id", "location"), "employee_id").groupBy("location").agg(F.sum("total_hours").alias("hours")).orderBy(F.col("hours").desc(), "location").limit(6)


@query
def top_forecasts(e: Estate) -> DataFrame:
    """The five forecasts of the largest financial impact, up or down."""
    metrics = demand.concurrent_metrics(e.daily(e.window()), e.features(), e.window())
    rows = sizing.forecast(metrics.join(e.features().select("feature_id", "unit_price"), "feature_id")).where("financial_impact IS NOT NULL")
    return rows.orderBy(F.abs("financial_impact").desc(), "feature_id").limit(5).select("feature_id", "financial_impact")


@query
def date_range(e: Estate) -> DataFrame:
    """Every day of a month for each order status."""
    rows = e.table("orders").groupBy("o_orderstatus").agg(F.min("o_orderdate").cast("date").alias("first"))
    return rows.select("o_orderstatus", dates.every_day(F.col("first"), F.date_add("first", 29)).alias("day"))


# ---- scenarios, drivers, shares, filters ----


def _scenario(name: str, observations: int, options: sizing.Options) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = Estate(spark, sf_dir)
        return portfolio.scenario_detail(e.daily(), e.features(), options, observations).drop("savings_pct", "unit_price")

    _registered[f"scenario_{name}"] = run


for _name, (_days, _options) in portfolio.PRESETS.items():
    _scenario(_name, _days, _options)
_scenario("raised_prices", 30, sizing.Options(percentile=0.99, growth=1.05, safety=1.2, escalation_pct=4.0))


@query
def drivers_by_person(e: Estate) -> DataFrame:
    """A report of five rows."""
    return commercial.demand_drivers(e.activity(), e.people(), "username")


@query
def drivers_by_department(e: Estate) -> DataFrame:
    """A report of four rows."""
    return commercial.demand_drivers(e.activity(), e.people(), "department", 4)


@query
def spend_shares(e: Estate) -> DataFrame:
    return commercial.spend_shares(commercial.vendor_spend(portfolio.portfolio(e)))


@query
def positions_order(e: Estate) -> DataFrame:
    return commercial.positions_order(portfolio.portfolio(e))


@query
def open_decisions(e: Estate) -> DataFrame:
    from seatmetrics.queries import queries as every

    return signals.with_status(every()["decisions"](e.spark, e.root), "open").select("id", "action")


# ---- exports ----


@query
def portfolio_export(e: Estate) -> DataFrame:
    return sinks.export(portfolio.portfolio(e), "portfolio")


@query
def renewals_export(e: Estate) -> DataFrame:
    return sinks.export(commercial.renewals(portfolio.portfolio(e)), "renewals")


@query
def reclaim_export(e: Estate) -> DataFrame:
    return sinks.export(seats.reclaim_queue(e.activity(seats.NAMED), e.features(), e.people(), e.as_of), "reclaim")


# ---- assembly ----


def _lines(e: Estate) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Names in usage, entitlements and contracts, which overlap in part."""
    names = e.table("part").select(F.col("p_name").alias("feature"), F.lower("p_brand").alias("vendor"), "p_partkey")
    return tuple(names.where(f"p_partkey % 4 <> {k}").drop("p_partkey") for k in range(3))


@query
def identity_sources(e: Estate) -> DataFrame:
    """How often each source states a feature."""
    rows = assembly.identity_rows(*_lines(e)).withColumn("feature_key", text.feature_key(F.col("feature")))
    return rows.groupBy("feature_key").agg(*[F.count(F.when(F.col("source") == s, 1)).alias(s) for s in ("usage", "entitlements", "contracts")])


@query
def observed_keys(e: Estate) -> DataFrame:
    usage, entitlements, _ = _lines(e)
    return assembly.observed_keys(usage, entitlements)


@query
def licence_models(e: Estate) -> DataFrame:
    n = F.col("p_partkey")
    model = F.when(n % 5 == 0, "unknown").when((n % 7 == 0) & (F.length("p_name") % 2 == 0), "token").otherwise("named_user")
    return contracts.licence_model_by_key(e.table("part").select(text.feature_key(F.col("p_name")).alias("position_key"), model.alias("license_model")))


@query
def last_items(e: Estate) -> DataFrame:
    items = e.table("part").select(F.col("p_brand").alias("feature_id"), F.col("p_partkey").alias("source_row"), "p_size")
    return contracts.last_item(items)


@query
def evidence_state(e: Estate) -> DataFrame:
    """Whether the key of the evidence tells states apart: the same imports, one more, one more row, one more confirmation."""
    imports = e.table("orders").groupBy(F.concat(F.lit("import-"), F.col("o_orderpriority")).alias("import_id")).agg(F.count("*").alias("rows"))
    decided = e.table("customer").select(F.col("c_custkey").alias("decided_at"))
    more = imports.unionByName(e.spark.createDataFrame([("import-x", 1)], "import_id string, rows bigint"))
    shifted = imports.withColumn("rows", F.col("rows") + F.when(F.col("import_id").startswith("import-1"), 1).when(F.col("import_id").startswith("import-2"), -1).otherwise(0))
    states = {"same": (imports.repartition(3), decided), "more imports": (more, decided), "other rows": (shifted, decided), "more confirmations": (imports, decided.union(decided.limit(1)))}
    base = trust.evidence_key(imports, assembly.confirmation_state(decided)).select(F.col("evidence_key").alias("base"))
    keys = None
    for name, (rows, confirmed) in states.items():
        one = trust.evidence_key(rows, assembly.confirmation_state(confirmed)).select(F.lit(name).alias("state"), "evidence_key")
        keys = one if keys is None else keys.unionByName(one)
    return keys.join(F.broadcast(base)).select("state", (F.col("evidence_key") == F.col("base")).alias("equal"))


# ---- imports, kept analyses ----


@query
def import_commit(e: Estate) -> DataFrame:
    """Two imports, the first committed again with other rows, and a third that is deleted."""
    store = sinks.ImportStore(e.spark, shared_dir(e.spark, "imports"))
    rows = e.table("part").select(F.col("p_name").alias("feature"), F.col("p_size").alias("quantity"), F.col("p_partkey").alias("source_row"))
    halves = {name: rows.where(f"source_row % 2 = {k}") for k, name in enumerate(("even", "odd"))}
    for name, import_id in (("odd", "one"), ("even", "one"), ("odd", "two")):
        store.commit(halves[name], "entitlements", import_id, f"print-{import_id}", halves[name].count())
    store.commit(rows, "entitlements", "three", "print-three", rows.count())
    store.delete("entitlements", "three")
    return store.read("entitlements").groupBy("import_id").agg(F.count("*").alias("rows"), F.sum("quantity").alias("quantity"))


@query
def kept_projection(e: Estate) -> DataFrame:
    """The portfolio's totals as they were written, counted again and published."""
    kept = Projection(e.spark, shared_dir(e.spark, "projection"))
    recount = e.table("lineitem").agg(F.count("*").alias("rows"))
    kept.build(portfolio.totals(portfolio.portfolio(e)), "k1", recount, recount.collect()[0]["rows"])
    return kept.read().withColumn("usable", F.lit(kept.usable("k1") and not kept.usable("k2")))
