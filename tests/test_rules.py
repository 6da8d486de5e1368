"""Number, date and text rules, and worked examples of the decisions."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from seatmetrics.functions import dates, numeric, text
from seatmetrics.operators import contracts, demand, denied, identity, normalize, seats, sizing, tokens
from seatmetrics.plans import commercial, signals


def one(spark, column):
    return spark.range(1).select(column.alias("x")).collect()[0]["x"]


@pytest.mark.parametrize("value, places, want", [(1.005, 2, 1.0), (-2.5, 0, -2.0), (2.5, 0, 3.0), (float("nan"), 0, 0.0), (float("inf"), 1, 0.0)])
def test_half_up(spark, value, places, want):
    assert one(spark, numeric.half_up(F.lit(value), places)) == want


def test_whole_up_guards_products(spark):
    rows = spark.range(1, 501).select("id", numeric.whole_up(F.col("id") * 1.1).alias("up")).collect()
    assert all(r["up"] == -(-r["id"] * 11 // 10) for r in rows)


def test_worst_risk(spark):
    none = F.lit(None).cast("string")
    assert one(spark, numeric.worst(none, F.lit("High"), F.lit("Moderate"))) == "High"
    assert one(spark, numeric.worst(none, none)) == "Low"


def test_window():
    w = dates.window(date(2024, 12, 31), "3m")
    assert (w.start, w.days) == (date(2024, 10, 3), 90)


@pytest.mark.parametrize("raw, want", [("2024-02-29T10:00", date(2024, 2, 29)), ("2/3/2026", date(2026, 2, 3)), ("2023-02-30", None), ("1989-01-01", None), ("x", None), ("", None)])
def test_read_date(spark, raw, want):
    assert one(spark, text.read_date(F.lit(raw))) == want


def test_read_date_day_first(spark):
    assert one(spark, text.read_date(F.lit("02/03/2026"), True)) == date(2026, 3, 2)


@pytest.mark.parametrize("raw, want", [("$1,234.50", 1234.5), (" 7 ", 7.0), ("true", None), ("1e3", 1000.0), ("-3", -3.0), ("--", None)])
def test_read_number(spark, raw, want):
    assert one(spark, text.read_number(F.lit(raw))) == want


@pytest.mark.parametrize("raw, want", [("9:30", 9), ("23", 23), ("42", None), ("9.5", None), ("noon", None)])
def test_read_hour(spark, raw, want):
    assert one(spark, text.read_hour(F.lit(raw))) == want


@pytest.mark.parametrize("raw, want, unreadable", [("EUR 5", "EUR", False), ("€", "EUR", False), ("$", None, True), ("", None, False)])
def test_currency(spark, raw, want, unreadable):
    assert one(spark, text.read_currency(F.lit(raw))) == want
    assert one(spark, text.currency_unreadable(F.lit(raw))) is unreadable


def test_keys(spark):
    assert one(spark, text.feature_key(F.lit(" ANSYS-Mech  Pro.2 "))) == "ansys_mech_pro_2"
    assert one(spark, text.resemblance(F.lit("jsmith"), F.lit("jsmith"))) == 95
    assert one(spark, text.resemblance(F.lit("smit"), F.lit("jsmit"))) == 70
    assert one(spark, text.resemblance(F.lit("abc"), F.lit("abc"))) == 0


def flat(spark, peak, days=365):
    return spark.range(days).select(F.lit("a").alias("feature_id"), F.date_add(F.lit(date(2024, 1, 1)), F.col("id").cast("int")).alias("date"), F.lit(float(peak)).alias("peak"))


def test_right_sizing_worked_example(spark):
    ent = spark.createDataFrame([("a", 400, 5000.0)], "feature_id string, entitled bigint, unit_price double")
    w = dates.window(date(2024, 12, 30), "12m")
    row = sizing.right_sizing(flat(spark, 275), ent, w, sizing.Options(growth=1.05)).collect()[0]
    assert (row["recommended"], row["surplus"], row["shortfall"]) == (318, 82, 0)
    money = sizing.financials(spark.createDataFrame([(400, 318, 5000.0), (10, 12, None)], "entitled bigint, recommended bigint, unit_price double")).collect()
    assert (money[0]["opportunity"], money[0]["savings_pct"]) == (410_000.0, 20.5)
    assert money[1]["current_cost"] is None and money[1]["incremental"] is None
    assert sizing.right_sizing(flat(spark, 275), ent, w).collect()[0]["recommended"] == 303


def test_metrics_of_a_known_series(spark):
    daily = spark.range(1, 11).select(F.lit("a").alias("feature_id"), F.date_add(F.lit(date(2024, 1, 1)), F.col("id").cast("int")).alias("date"), (F.col("id") * 10.0).alias("peak"))
    ent = spark.createDataFrame([("a", 100), ("b", 0)], "feature_id string, entitled bigint")
    got = {r["feature_id"]: r for r in demand.concurrent_metrics(daily, ent, dates.window(date(2024, 1, 31), "3m")).collect()}
    assert (got["a"]["p95"], got["a"]["median"], got["a"]["observed_days"], got["a"]["missing_days"], got["a"]["saturation_days"]) == (95.5, 55.0, 10, 80, 1)
    assert (got["b"]["observed_days"], got["b"]["p95"], got["b"]["utilization_pct"]) == (0, 0.0, 0.0)


@pytest.mark.parametrize("util, top, saturated, entitled, want", [(55.0, 70.0, 0.0, 100, "Low"), (70.0, 100.0, 0.0, 100, "Moderate"), (94.0, 99.0, 0.0, 100, "High"), (99.0, 110.0, 12.0, 100, "Critical"), (0.0, 5.0, 0.0, 0, "Low")])
def test_capacity_risk(spark, util, top, saturated, entitled, want):
    m = spark.createDataFrame([(util, top, saturated, entitled)], "utilization_pct double, max_peak double, saturation_pct double, entitled bigint")
    assert m.select(demand.capacity_risk(m)).collect()[0][0] == want


def test_denial_risk_rules(spark):
    def risk(**x):
        base = {"mean": None, "entitled": 100, "concentration": 0.2, "users": 10, "days": 60, "rate": 0.16} | x
        return one(spark, denied.denial_risk({k: F.lit(v).cast("double") for k, v in base.items()}))

    assert risk() == "Critical"
    assert risk(mean=90.0) == "Low"
    assert risk(concentration=0.8, users=2) == "Low"
    assert risk(rate=0.08) == "High"
    assert risk(rate=0.0, users=1, days=2) == "Moderate"
    assert risk(rate=0.0, users=1, days=1) == "Low"


def test_named_users(spark):
    rows = [("a", k, True, date(2024, 1, 1) if k < 43 else date(2024, 6, 1)) for k in range(420)]
    activity = spark.createDataFrame(rows, "feature_id string, employee_id bigint, assigned boolean, last_used date")
    features = spark.createDataFrame([("a", 430, 2235.0)], "feature_id string, entitled bigint, unit_price double")
    m = seats.named_user_metrics(activity, features, date(2024, 6, 15))
    r = m.collect()[0]
    assert (r["reclaim_candidates"], r["reclaim_value"], r["active_users"], r["seats_without_user"]) == (43, 96_105.0, 377, 10)
    assert seats.named_user_sizing(m).collect()[0]["recommended"] == 425


@pytest.mark.parametrize("used, trend, want", [(None, 0.0, "Low"), (95.0, 0.0, "Critical"), (85.0, 0.0, "High"), (70.0, 0.0, "Moderate"), (60.0, 16.0, "Moderate"), (60.0, 15.0, "Low")])
def test_token_risk(spark, used, trend, want):
    assert one(spark, tokens.token_risk(F.lit(used).cast("double"), F.lit(trend))) == want


@pytest.mark.parametrize("days, stage, urgency", [(121, "analyze", "low"), (120, "validate", "low"), (90, "recommend", "medium"), (58, "negotiate", "high"), (30, "finalize", "critical"), (0, "renewed", "critical"), (-1, "renewed", "lapsed")])
def test_renewal_stages(spark, days, stage, urgency):
    assert one(spark, commercial.stage(F.lit(days))) == stage
    assert one(spark, commercial.urgency(F.lit(days))) == urgency


def test_allocation_reconciles(spark):
    activity = spark.createDataFrame([("a", 1, True, 2, 30.0, None), ("a", 2, True, 1, 10.0, None), ("a", 9, True, 1, 60.0, None), ("b", 1, False, 0, 0.0, None)], "feature_id string, employee_id bigint, assigned boolean, total_sessions bigint, total_hours double, last_used date")
    people = spark.createDataFrame([(1, "x", "active"), (2, "y", "active"), (3, "x", "inactive")], "employee_id bigint, department string, status string")
    costs = spark.createDataFrame([("a", 1000.0, 100.0), ("b", 50.0, 0.0)], "feature_id string, current_cost double, waste double")
    rows = {r["grp"]: r for r in commercial.allocate(activity, people, costs, "department", "usage_duration").collect()}
    assert (rows["x"]["allocated_spend"], rows["y"]["allocated_spend"]) == (300.0, 100.0)
    check = commercial.allocation_check(activity, people, costs, "department", "usage_duration").collect()[0]
    assert check["allocated"] + check["unallocated"] == check["allocatable"] == 1050.0
    assert (check["unresolved_identity_cost"], check["features_without_activity"]) == (600.0, 1)


def test_signal_score(spark):
    s = one(spark, signals.score(F.lit(500_000.0), F.lit(0), F.lit("Critical"), F.lit("High")))
    assert s == 100.0
    assert one(spark, signals.score(F.lit(None).cast("double"), F.lit(None).cast("int"), F.lit("Low"), F.lit("Low"))) == 7.1


def test_malformed_rows(spark):
    """Two of eight rows are good; each bad one names its own rule."""
    rows = [
        (2, "2024-01-02", "a", "u1", "5", "9"), (3, "not a date", "a", "u1", "5", "9"), (4, "2024-01-02", " ", "u1", "5", "9"), (5, "2024-01-02", "a", "u1", "-1", "9"),
        (6, "2024-01-02", "a", "u1", "many", "9"), (7, "2024-01-02", "a", "u1", "5", "42"), (8, "2024-01-02", "A", "U1", "5", "9"), (9, "2024-01-03", "a", "u1", "5", "9"),
    ]
    raw = spark.createDataFrame(rows, "source_row bigint, date string, feature string, user string, concurrent string, hour string")
    out = normalize.checked(raw, "usage")
    assert [r["source_row"] for r in normalize.accepted(out).orderBy("source_row").collect()] == [2, 9]
    assert sorted(r["rule"] for r in normalize.rejections(out).collect()) == ["duplicate_row", "invalid_date", "invalid_hour", "invalid_number", "missing_required_field", "negative_quantity"]
    empty = normalize.checked(raw.limit(0), "usage")
    assert empty.count() == 0 and normalize.rejection_summary(empty).count() == 0
    unmapped = normalize.checked(raw.drop("feature"), "usage")
    assert normalize.accepted(unmapped).count() == 0


def test_cost_bases(spark):
    rows = [(1, 10.0, 5.0, None, None, 0), (2, 10.0, None, None, 200.0, 0), (3, 10.0, None, 300.0, None, 365), (4, 10.0, None, 300.0, None, 800), (5, None, None, 300.0, None, None)]
    lines = spark.createDataFrame(rows, "id int, quantity double, unit_price double, total_cost double, annual_cost double, days int")
    lines = lines.withColumns({"start_date": F.when(F.col("days").isNotNull(), F.lit(date(2024, 1, 1))), "end_date": F.date_add(F.lit(date(2024, 1, 1)), F.col("days"))})
    got = {r["id"]: (r["unit_price"], r["unit_price_basis"], r["annual_cost"], r["annual_cost_basis"], r["multi_year"]) for r in contracts.derive_cost(lines).collect()}
    assert got[1] == (5.0, "supplied_unit_price", 50.0, "quantity_x_unit", False)
    assert got[2] == (20.0, "total_over_quantity", 200.0, "supplied_annual_cost", False)
    assert got[3] == (30.0, "total_over_quantity", 300.0, "supplied_total_cost", False)
    assert got[4] == (None, "none", None, "none", True)
    assert got[5] == (None, "none", 300.0, "supplied_total_cost", False)


def test_user_resolution(spark):
    usage = spark.createDataFrame([(" Ann ", None, 1), ("bob", "E2", 2), ("twin", None, 3), ("x@y.z", None, 4), ("ghost", None, 5), (None, None, 6), ("old", None, 7)], "user string, employee_code string, source_row bigint")
    people = spark.createDataFrame([(1, "ann", "E1", None), (2, "robert", "e2", None), (3, "twin", None, None), (4, "TWIN", None, None), (5, "w", None, "X@Y.Z")], "person_id bigint, username string, employee_code string, email string")
    confirmed = spark.createDataFrame([("old", "w")], "raw string, target string")
    got = {r["key"]: (r["status"], r["basis"], r["person_id"]) for r in identity.resolve_users(usage, people, confirmed).collect()}
    assert got == {"ann": ("matched", "username", 1), "bob": ("matched", "code", 2), "twin": ("ambiguous", None, None), "x@y.z": ("matched", "email", 5), "ghost": ("unmatched", None, None), "old": ("confirmed", "confirmed", 5)}
