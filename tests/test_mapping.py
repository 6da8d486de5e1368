"""Columns by names and cells, several sources in one plan."""

import pytest
from pyspark.sql import functions as F

from seatmetrics.functions.text import read_date, read_timestamp
from seatmetrics.operators import normalize
from seatmetrics.sources import adapters, ingest, mapping
from seatmetrics.sources.mapping import Profile


def fields(headers, dataset, **kw):
    return {m.column: m.field for m in mapping.resolve(headers, dataset, **kw)}


@pytest.mark.parametrize(
    "headers, dataset, want",
    [
        (["Item", "Qty", "Cost"], "contracts", {"Item": "feature", "Qty": "quantity", "Cost": "total_cost"}),
        (["Spend", "Contract Value", "Rate", "End"], "contracts", {"Spend": "annual_cost", "Contract Value": "total_cost", "Rate": "unit_price", "End": "end_date"}),
        (["Licenses"], "usage", {"Licenses": "quantity"}),
        (["Licenses Checked Out", "Free"], "usage", {"Licenses Checked Out": "concurrent", "Free": "available"}),
        (["Checked Out"], "usage", {"Checked Out": "concurrent"}),
        (["Active"], "usage", {"Active": "concurrent"}),
        (["Expires"], "contracts", {"Expires": "renewal_date"}),
        (["Reports To", "Active"], "people", {"Reports To": "manager_name", "Active": "status"}),
        (["license-feature", "LICENCES IN USE"], "usage", {"license-feature": "feature", "LICENCES IN USE": "concurrent"}),
        (["Suspended"], "contracts", {}),
        (["License Type"], "usage", {}),
        (["user", "username", "user_id"], "usage", {"user": "user"}),
        (["primary_network_user_id", "max_concurrent_licenses"], "usage", {"primary_network_user_id": "user", "max_concurrent_licenses": "peak"}),
    ],
)
def test_names(headers, dataset, want):
    assert fields(headers, dataset) == want


def test_no_guess_between_money_fields():
    assert fields(["Unit Cost Total", "Price Total"], "contracts") == {}
    assert mapping.money_claims("Unit Cost Total", "contracts") == ("unit_price", "total_cost")
    assert mapping.money_claims("Total Cost", "contracts") == () and mapping.money_claims("Unit Cost", "contracts") == ()
    assert fields(["Total", "Cost (USD)", "License Cost"], "contracts") == {"Total": "total_cost"}  # what is left is no other money, and no cost centre


def test_cells_decide_what_names_leave_open():
    words, days, numbers = (Profile(10, {"number": n, "date": d, "timestamp": d, "hour": 0.0, "boolean": 0.0}) for n, d in ((0.0, 0.0), (0.0, 1.0), (1.0, 0.0)))
    assert fields(["Renewal Note"], "contracts", cells={"Renewal Note": words}) == {"Renewal Note": "notes"}
    assert fields(["Renewal Note"], "contracts", cells={"Renewal Note": days}) == {"Renewal Note": "renewal_date"}
    assert fields(["Day", "Date"], "usage", cells={"Day": days, "Date": words}) == {"Day": "date"}
    assert fields(["Elapsed Remark"], "usage", cells={"Elapsed Remark": numbers}) == {"Elapsed Remark": "duration_hours"}
    assert fields(["Date"], "usage", cells={"Date": Profile(0, {})}) == {"Date": "date"}


def test_overrides_and_ignored_columns():
    assert fields(["a", "user"], "people", overrides={"user": "a"}) == {"a": "user"}
    assert fields(["USER", "FEATURE"], "usage", ignored=("USER",)) == {"FEATURE": "feature"}


def test_rows_prove_what_a_money_column_is(spark):
    def mapped(rows, names):
        found, cells = mapping.map_columns(spark.createDataFrame(rows, ", ".join(f"`{n.replace('`', '``')}` string" for n in names) + ", source_row int"), "contracts")
        return {m.column: m.field for m in found}, {h: (kind, sample) for h, _, kind, _, sample in mapping.reviewed(list(names), found, cells, "contracts")}

    rows = [("2", "$5.00", "10", 1), ("3", "4", "12.0", 2), (None, "9", "1", 3)]
    got, shown = mapped(rows, ("Qty", "Unit Price", "Price Total"))
    assert got["Price Total"] == "total_cost" and shown["Price Total"][0] == "strong"
    got, shown = mapped(rows, ("Qty", "Price Total", "Total"))
    assert got["Price Total"] == "unit_price"
    got, shown = mapped([("2", "5", "99", 1)], ("Qty", "Unit Price", "Price Total"))
    assert "Price Total" not in got and shown["Price Total"] == ("ambiguous", "99")
    assert mapped([(None, None, None, 1)], ("Qty", "Unit Price", "x`y"))[0] == {"Qty": "quantity", "Unit Price": "unit_price"}


def test_profile_of_odd_columns(spark):
    raw = spark.createDataFrame([(" 5 ", "2024-01-02", None, 1), ("n/a", "", None, 2)], "`a``b` string, `c.d` string, e string, source_row int")
    cells = mapping.profiles(raw)
    assert (cells["a`b"].cells, cells["a`b"].shares["number"], cells["a`b"].sample) == (2, 0.5, "5")
    assert (cells["c.d"].cells, cells["c.d"].shares["date"], cells["e"].cells) == (1, 1.0, 0)
    assert mapping.profiles(raw.select("source_row")) == {}


@pytest.mark.parametrize(
    "text, want",
    [("14-Mar-2026", "2026-03-14"), ("14 Mar 2026", "2026-03-14"), ("March 14, 2026", "2026-03-14"), ("Sat, 14 march 2026 10:00", "2026-03-14"), ("Sept 5 2026", "2026-09-05"), ("5.dec.1999", "1999-12-05"), ("soon 2026", None), ("30 Feb 2026", None), ("Mar 2026", None), ("14 Mar 1980", None), ("maybe 14 or 2026", None), ("14 Mar 20261", None)],
)
def test_dates_with_month_names(spark, text, want):
    row = spark.createDataFrame([(text,)], "x string").select(read_date(F.col("x")).alias("d"), read_timestamp(F.col("x")).alias("t")).first()
    assert (str(row["d"]) if row["d"] else None) == want
    assert (row["t"] is None) == (want is None) and (want is None or str(row["t"])[:10] == want)


def test_a_source_has_words_of_its_own(spark):
    rows = spark.createDataFrame([("flexnet", "Deny"), ("rlm", "issued"), ("rlm", "checkout"), ("sentinel", "deny"), ("sentinel", "allowed"), ("generic", "deny")], "source string, word string")
    got = rows.select(adapters.denied_reader(F.col("source"))(F.col("word")).alias("d")).collect()
    assert [r["d"] for r in got] == [True, None, False, None, False, None]
    assert adapters.ADAPTERS["sentinel"].unsupported == ("checkout_at", "checkin_at", "tokens")


def test_files_of_several_sources(spark):
    flex = spark.createDataFrame([("2024-01-01", "cad", "DENY", 1), ("2024-01-01", "cad", "DENY", 2)], "DATE string, FLEX_FEATURE string, STATUS string, source_row int")
    rlm = spark.createDataFrame([("2024-01-01", "cad", 1)], "date string, product string, source_row int")
    rows, named = adapters.together({"flexnet": flex, "rlm": rlm}, "usage")
    assert set(named["flexnet"]) == {"date", "feature", "denied"} and set(named["rlm"]) == {"date", "feature"}
    checked = normalize.checked(rows, "usage", denied=adapters.denied_reader(F.col("source")))
    assert sorted((r["source"], r["denied"]) for r in normalize.accepted(checked).collect()) == [("flexnet", True), ("rlm", None)]  # repeats are of one source
    report = {(r["source"], r["field"]): (r["coverage_pct"], r["reason"]) for r in adapters.quality_report(checked, "usage", named).collect()}
    assert report["rlm", "tokens"] == (0.0, "not carried") and report["rlm", "denied"] == (0.0, "not mapped") and report["flexnet", "denied"] == (100.0, "")
    with pytest.raises(ValueError, match="no files"):
        adapters.together({}, "usage")


def test_ingest_reviews_every_column(spark, tmp_path):
    path = tmp_path / "renewals.csv"
    path.write_text("Item,Qty,Cost,`odd`,Cost\ncad,100,\"$5,000\",x,7\n\ncam,2,10,y,8\n")
    done = ingest.ingest(spark, str(path), "contracts")
    assert [(r["feature"], r["total_cost"], r["unit_price"], r["source_row"]) for r in done.accepted.orderBy("source_row").collect()] == [("cad", 5000.0, 50.0, 2), ("cam", 10.0, 5.0, 4)]
    assert {h: (f, c) for _, h, f, c, _, _ in done.columns} == {"Item": ("feature", "exact"), "Qty": ("quantity", "exact"), "Cost": ("total_cost", "exact"), "`odd`": (None, "none"), "Cost (2)": (None, "none")}
