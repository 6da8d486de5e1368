"""Ten kinds of signals over the portfolio, scored alike, and the decisions that answer them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seatmetrics.functions.numeric import half_up, or_zero
from seatmetrics.operators.confidence import weight
from seatmetrics.operators.demand import guarded_trend

# Impact ceiling, horizon in days, and what each risk weighs.
CEILING, HORIZON = 500_000, 180
RISK_WEIGHT = (("Critical", 1.0), ("High", 0.75), ("Moderate", 0.4))
# The decision that a kind of signal asks for.
DECISIONS = {"renewal": "negotiate", "capacity": "increase", "cost": "reduce", "reclaim": "reclaim", "usage": "review", "forecast": "increase", "data": "resolve", "reconciliation": "reconcile"}
_COLUMNS = ["seq", "id", "kind", "impact", "urgency_days", "risk", "confidence"]


def score(impact: Column, urgency: Column, risk: Column, confidence: Column) -> Column:
    """0 to 100: money on a logarithmic scale, urgency and risk, times confidence."""
    money = F.least(F.lit(1.0), F.log10(F.abs(or_zero(impact)) + 1) / F.log10(F.lit(float(CEILING + 1))))
    urgent = F.when(urgency.isNull(), 0.25).otherwise(1 - F.least(F.greatest(urgency, F.lit(0)), F.lit(HORIZON)) / HORIZON)
    risky = F.lit(0.1)
    for name, value in reversed(RISK_WEIGHT):
        risky = F.when(risk == name, value).otherwise(risky)
    return half_up((money * 0.45 + urgent * 0.28 + risky * 0.22 + 0.05) * weight(confidence) * 100, 1)


def _signals(rows: DataFrame, seq: int, kind: str, key: Column, impact: Column, urgency: Column, risk: Column, confidence: Column) -> DataFrame:
    return rows.select(F.lit(seq).alias("seq"), key.alias("id"), F.lit(kind).alias("kind"), impact.cast("double").alias("impact"), urgency.cast("int").alias("urgency_days"), risk.alias("risk"), confidence.alias("confidence"))


def generate(portfolio: DataFrame, renewals: DataFrame, issues: DataFrame, reconciliation: DataFrame, cost_threshold: float = 25_000) -> DataFrame:
    """All signals with their score; ``ordered`` puts the best first."""
    days, conf, risk = F.col("days_to_renewal"), F.col("confidence"), F.col("risk")
    fid, trend = F.col("feature_id"), guarded_trend(F.col("observed_days"), F.col("trend_pct"))
    low, moderate = F.lit("Low"), F.lit("Moderate")

    net = or_zero(F.col("opportunity")) - or_zero(F.col("incremental"))
    measured = F.col("p95").isNotNull() & (F.col("observed_days") > 0) & (F.col("usage_evidence") == "observed")
    grown = F.col("p95") * (1 + F.greatest(or_zero(trend), F.lit(0.0)) / 100)

    def of_feature(when: Column, seq: int, kind: str, impact: Column, level: Column) -> Column:
        return F.when(when, F.struct(F.lit(seq).alias("seq"), F.lit(kind).alias("kind"), impact.cast("double").alias("impact"), level.alias("risk")))

    own = [
        of_feature(measured & risk.isin("High", "Critical"), 2, "capacity", F.col("incremental"), risk),
        of_feature(F.col("opportunity") >= cost_threshold, 3, "cost", F.col("opportunity"), low),
        of_feature(F.col("reclaim_candidates") >= 5, 4, "reclaim", F.col("reclaim_value"), low),
        of_feature(measured & (F.abs(trend) >= 25), 5, "usage", F.when(trend > 0, F.col("incremental")).otherwise(F.col("opportunity")), F.when((trend > 0) & (F.col("utilization_pct") > 70), "Moderate").otherwise("Low")),
        of_feature(measured & (F.col("entitled") > 0) & (grown > F.col("entitled")) & (F.col("utilization_pct") < 100), 6, "forecast", half_up((half_up(grown) - F.col("entitled")) * F.col("unit_price"), 2), moderate),
    ]
    features = portfolio.select("feature_id", days.cast("int").alias("urgency_days"), conf.alias("confidence"), F.explode(F.array_compact(F.array(*own))).alias("x"))
    features = features.select("x.seq", F.concat_ws(":", F.col("x.kind"), fid).alias("id"), "x.kind", "x.impact", "urgency_days", "x.risk", "confidence")
    # Both signals that look at features as a whole come from one pass.
    blind, unbound = (F.col("usage_evidence") == "not_supplied") & (F.col("current_cost") > 0), F.col("contract_id").isNull()
    whole = portfolio.agg(
        F.count(F.when(blind, 1)).alias("blind"), F.sum(F.when(blind, F.col("current_cost"))).alias("cost"), F.min(F.when(blind & (days >= 0), days)).alias("soonest"),
        F.count(F.when(unbound, 1)).alias("unbound"), or_zero(F.sum(F.when(unbound, F.col("current_cost")))).alias("value"),
    )

    def of_whole(when: Column, seq: int, kind: str, name: str, impact: Column, urgency: Column, level: Column) -> Column:
        return F.when(when, F.struct(F.lit(seq).alias("seq"), F.lit(name).alias("id"), F.lit(kind).alias("kind"), impact.cast("double").alias("impact"), urgency.cast("int").alias("urgency_days"), level.alias("risk"), F.lit("High").alias("confidence")))

    both = [
        of_whole(F.col("blind") > 0, 8, "data", "evidence:no-usage", half_up(F.col("cost"), 2), F.col("soonest"), F.when(F.col("soonest") <= 90, "High").otherwise("Moderate")),
        of_whole(F.col("unbound") > 0, 10, "reconciliation", "reconciliation:unmatched", F.when(F.col("value") > 0, half_up(F.col("value"), 2)), F.lit(None), moderate),
    ]
    parts = [
        features,
        whole.select(F.explode(F.array_compact(F.array(*both))).alias("x")).select("x.*"),
        _signals(renewals.where((days >= 0) & (days <= 240)), 1, "renewal", F.concat(F.lit("renewal:"), F.col("contract_id")), F.when(F.abs(net) > 0, F.abs(net)).otherwise(F.col("current_spend")), days, F.when(F.col("capacity_exposure") > 0, "High").when(days <= 60, "Moderate").otherwise("Low"), conf),
        _signals(issues.where("severity <> 'info'"), 7, "data", F.concat(F.lit("data:"), F.col("issue")), F.lit(None), F.lit(None), F.when(F.col("severity") == "critical", "High").otherwise("Moderate"), F.lit("High")),
        _signals(reconciliation.where("disagreeing > 0"), 9, "reconciliation", F.lit("reconciliation:sources"), F.when(F.col("value_at_stake") > 0, F.col("value_at_stake")), F.lit(None), F.when(F.col("over_deployed") > 0, "High").otherwise("Moderate"), F.lit("Medium")),
    ]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.withColumn("score", score(F.col("impact"), F.col("urgency_days"), F.col("risk"), F.col("confidence")))


def ordered(signals: DataFrame) -> DataFrame:
    """Best score first; equal scores keep the order of their generators."""
    return signals.orderBy(F.col("score").desc(), "seq", "id")


def decisions(signals: DataFrame, overrides: DataFrame) -> DataFrame:
    """One decision for each signal; a stored status of ``overrides`` (id, status) wins over open."""
    action = F.lit(None).cast("string")
    for kind, name in DECISIONS.items():
        action = F.when(F.col("kind") == kind, name).otherwise(action)
    return signals.join(overrides.select("id", F.col("status").alias("_status")), "id", "left").select("id", "kind", action.alias("action"), "impact", "score", F.coalesce("_status", F.lit("open")).alias("status"))


def with_status(decided: DataFrame, status: str | None) -> DataFrame:
    """The list of decisions under its filter; no status shows all."""
    return decided if status is None else decided.where(F.col("status") == status)


def executive_actions(portfolio: DataFrame, renewals: DataFrame) -> DataFrame:
    """What a brief asks for: reductions, additions, seats to take back and agreements within 90 days, as far as there are any."""
    money = portfolio.agg(or_zero(F.sum("opportunity")).alias("opp"), or_zero(F.sum("incremental")).alias("inc"), or_zero(F.sum("reclaim_value")).alias("rec"), F.sum("reclaim_candidates").alias("seats"))
    rows = [("reduce", F.col("opp")), ("increase", F.col("inc")), ("reclaim", F.col("rec"))]
    flat = money.select(F.explode(F.array(*[F.struct(F.lit(n).alias("action"), half_up(x, 2).alias("amount")) for n, x in rows])).alias("r")).select("r.*").where("amount > 0")
    soon = renewals.where("days_to_renewal BETWEEN 0 AND 90").agg(F.lit("renew").alias("action"), half_up(or_zero(F.sum("current_spend")), 2).alias("amount")).where("amount > 0")
    return flat.unionByName(soon)
