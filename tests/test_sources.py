"""Files, mapping, detection, stores, synthetic estates, streams and questions."""

import zipfile

import pytest
from pyspark.sql import functions as F

from seatmetrics import queries
from seatmetrics.operators import normalize, seats
from seatmetrics.plans import ask, commercial
from seatmetrics.sources import files, ingest, mapping, sinks, synthetic
from seatmetrics.streaming import hourly

FLEX = ["DATE", "TIME", "FEATURE", "VENDOR_DAEMON", "USER", "HOST", "DISPLAY", "SERVER_HOST", "LICENSES_ISSUED", "LICENSES_IN_USE", "CHECKOUT_TIME", "STATUS"]


def test_kind_and_delimiter():
    assert files.kind_of(files.ZIP + b"..") == "workbook"
    with pytest.raises(ValueError):
        files.kind_of(files.OLD_WORKBOOK)
    assert files.delimiter_of(b"a;b;c\n1,2,3") == ";"
    assert files.delimiter_of(b"abc") == ","
    assert files.delimiter_of(b"a,b", "x.tsv") == "\t"
    assert files.encoding_of(b"\xff\xfea\x00") == "UTF-16LE"
    assert files.accepted_name("A.CSV") and not files.accepted_name("a.pdf")


def test_delimited_file_to_rows(spark, tmp_path):
    path = tmp_path / "usage.csv"
    path.write_bytes("﻿Usage Date,Feature Name,In Use,\n2024-01-01,\"a, b\",3,x\n2024-01-02,c,bad,\n".encode())
    raw = files.read_delimited(spark, str(path))
    assert raw.columns == ["Usage Date", "Feature Name", "In Use", "Column 4", "source_row"]
    mapped = mapping.resolve(raw.columns[:4], "usage")
    assert {m.field: m.column for m in mapped} == {"date": "Usage Date", "feature": "Feature Name", "concurrent": "In Use"}
    out = normalize.checked(mapping.apply(raw, mapped), "usage")
    assert [(r["feature"], r["source_row"]) for r in normalize.accepted(out).collect()] == [("a, b", 2)]
    assert [(r["rule"], r["source_row"]) for r in normalize.rejections(out).collect()] == [("invalid_number", 3)]


def test_workbook(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="People" sheetId="1"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>user</t></si><si><r><t>an</t></r><r><t>n</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>seats</t></is></c></row><row r="2"/><row r="3"><c r="A3" t="s"><v>1</v></c><c r="C3"><f>1+1</f><v>2</v></c></row></sheetData></worksheet>')
    rows = files.read_workbooks(spark, str(tmp_path / "b.xlsx")).collect()
    assert [(r["sheet"], r["source_row"], r["cells"]) for r in rows] == [("People", 3, {"user": "ann", "seats": "2"})]


def write_book(path, sheets, relations, styles, settings=""):
    """A workbook of raw sheet rows: ``sheets`` name -> (part number, rows as XML)."""
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        listed = "".join(f'<sheet name="{n}" sheetId="{k}" r:id="{relations[n]}"/>' for k, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}">{settings}<sheets>{listed}</sheets></workbook>')
        targets = "".join(f'<Relationship Id="{relations[n]}" Target="worksheets/sheet{part}.xml"/>' for n, (part, _) in sheets.items())
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{targets}</Relationships>')
        formats = "".join(f'<numFmt numFmtId="{k}" formatCode="{c}"/>' for k, c in styles if c)
        cells = "".join(f'<xf numFmtId="{k}"/>' for k, _ in styles)
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{main}"><numFmts>{formats}</numFmts><cellXfs>{cells}</cellXfs></styleSheet>')
        for part, rows in sheets.values():
            z.writestr(f"xl/worksheets/sheet{part}.xml", f'<worksheet xmlns="{main}"><sheetData>{rows}</sheetData></worksheet>')


def _row(at, *cells):
    return f'<row r="{at}">' + "".join(f'<c r="{chr(65 + k)}{at}" t="inlineStr"><is><t>{c}</t></is></c>' if isinstance(c, str) else f'<c r="{chr(65 + k)}{at}" s="{c[0]}"><v>{c[1]}</v></c>' for k, c in enumerate(cells)) + "</row>"


STYLES = [(0, ""), (14, ""), (164, "yyyy\\-mm\\-dd hh:mm"), (165, "0.00 &quot;days&quot;")]


def test_workbook_dates_and_sheets(spark, tmp_path):
    """Date cells are dates, sheets are found by relationship, and each sheet has columns of its own."""
    first = _row(1, "Usage Date", "Feature", "In Use") + _row(2, (1, 45000), "cad", (0, 3)) + _row(3, (2, 45000.5), "cad", (3, 4.5))
    second = _row(1, "Day", "Module", "Used") + _row(2, (1, 45001), "cam", (0, 7))
    path = str(tmp_path / "use.xlsx")
    write_book(path, {"B": (2, first), "A": (1, second)}, {"B": "r7", "A": "r2"}, STYLES)
    rows = {(r["sheet"], r["source_row"]): r["cells"] for r in files.read_workbooks(spark, path).collect()}
    assert rows[("B", 2)] == {"Usage Date": "2023-03-15", "Feature": "cad", "In Use": "3"}
    assert rows[("B", 3)] == {"Usage Date": "2023-03-15 12:00:00", "Feature": "cad", "In Use": "4.5"}
    assert rows[("A", 2)]["Day"] == "2023-03-16"
    kept = ingest.ingest(spark, path, "usage").accepted.orderBy("date", "concurrent").collect()
    assert [(str(r["date"]), r["feature"], r["concurrent"]) for r in kept] == [("2023-03-15", "cad", 3.0), ("2023-03-15", "cad", 4.5), ("2023-03-16", "cam", 7.0)]


def test_date_cells_of_both_calendars(spark, tmp_path):
    assert [files.serial_text(x) for x in (1, 59, 61, 45000.25)] == ["1900-01-01", "1900-02-28", "1900-03-01", "2023-03-15 06:00:00"]
    path = str(tmp_path / "old.xlsx")
    write_book(path, {"S": (1, _row(1, "day") + _row(2, (1, 1)) + _row(3, (1, -5)))}, {"S": "r1"}, STYLES, '<workbookPr date1904="1"/>')
    assert [r["cells"]["day"] for r in files.read_workbooks(spark, path).orderBy("source_row").collect()] == ["1904-01-02", "-5"]


def test_no_evidence_allocates_nothing(spark):
    activity = spark.createDataFrame([("f", 1, False, 0, 0.0, None)], "feature_id string, employee_id int, assigned boolean, total_sessions long, total_hours double, last_used date")
    people = spark.createDataFrame([(1, "d", "active")], "employee_id int, department string, status string")
    costs = spark.createDataFrame([("f", 10.0, 1.0)], "feature_id string, current_cost double, waste double")
    assert commercial.automatic_method(activity, costs) == "none"
    assert commercial.automatic_method(activity.withColumn("assigned", F.lit(True)), costs) == "assigned_users"
    assert [r["allocated_spend"] for r in commercial.allocate(activity, people, costs, "department", "none").collect()] == [0.0]


def test_mapping_rules():
    by_field = {m.field: m.column for m in mapping.resolve(FLEX, "usage")}
    assert (by_field["date"], by_field["feature"], by_field["user"], by_field["concurrent"], by_field["license_server"]) == ("DATE", "FEATURE", "USER", "LICENSES_IN_USE", "SERVER_HOST")
    assert mapping.resolve(["zzz"], "usage") == []
    assert mapping.missing_required(mapping.resolve(["Application", "Day"], "usage"), "usage") == []
    assert mapping.missing_required([], "people") == ["user"]
    assert [m.column for m in mapping.resolve(["a", "user"], "people", {"user": "a"}) if m.field == "user"] == ["a"]


@pytest.mark.parametrize(
    "headers, want",
    [(FLEX, "flexnet"), ("date,isv,product,user,rlm_server,pool,count,count_in_use".split(","), "rlm"), (["Date", "License Name", "Product Line", "Server ID", "Max Count", "In Use", "Token"], "dsls"), (["Sample Time", "Feature Name", "Feature Version", "Client User", "Sublicense"], "sentinel"), (["day", "user name", "application"], "generic")],
)
def test_detection(headers, want):
    assert mapping.detect(headers)[0] == want


def test_import_store(spark, tmp_path):
    store = sinks.ImportStore(spark, str(tmp_path / "store"))
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "feature string, source_row bigint")
    assert store.commit(rows, "usage", "i1", "f1", 2) == 2
    assert store.commit(rows.limit(1), "usage", "i1", "f1", 1) == 1
    with pytest.raises(ValueError):
        store.commit(rows, "usage", "i2", "f1", 2)
    with pytest.raises(RuntimeError):
        store.commit(rows, "usage", "i3", "f3", 5)
    assert store.read("usage").count() == 1 and store.read("usage", "i3").count() == 0  # a failed commit is not seen
    store.commit(rows, "usage", "i2", "f2", 2)
    assert store.read("usage", "i1").count() == 1
    store.delete("usage", "i1")
    assert {r["import_id"] for r in store.imports().collect()} == {"i2"}


def test_csv_guard(spark, tmp_path):
    rows = spark.createDataFrame([("=1+1", 'a"b'), (None, "x\ny")], "a string, b string")
    assert [r[0] for r in rows.select(sinks.csv_line([F.col("a"), F.col("b")])).collect()] == ["'=1+1,\"a\"\"b\"", ',"x\ny"']
    sinks.write_csv(rows.where("a IS NOT NULL"), str(tmp_path / "out"))
    files_ = [f.read_bytes().decode() for f in (tmp_path / "out").glob("part*.csv")]
    assert all(f.startswith("\ufeffa,b\r\n") for f in files_) and "'=1+1,\"a\"\"b\"\r\n" in "".join(files_)


def test_synthetic_estate(spark):
    daily = synthetic.peaks(spark, 2, 730)
    got = daily.groupBy("feature_id").agg(F.percentile("peak", F.lit(0.95)).alias("p"), F.max("peak").alias("m"), F.count("*").alias("n")).collect()
    assert {(r["p"], r["m"], r["n"]) for r in got} == {(275.0, 314.0, 730)}
    assert daily.exceptAll(synthetic.peaks(spark, 2, 730)).count() == 0
    spread = synthetic.hourly(daily).groupBy("feature_id", "day").agg(F.max("concurrent").cast("double").alias("peak"))
    assert spread.join(daily, ["feature_id", "day", "peak"]).count() == 1460
    assert synthetic.people(spark, 50).distinct().count() == 50
    idle = synthetic.seats(spark, 420, 43, "2024-06-15")
    features = spark.createDataFrame([("feature:named", 420, 2235.0)], "feature_id string, entitled bigint, unit_price double")
    from datetime import date

    assert seats.named_user_metrics(idle, features, date(2024, 6, 15)).collect()[0]["reclaim_value"] == 96_105.0


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(f"f{k % 3}", f"2024-01-01 {k % 24:02d}:{k % 60:02d}:00", k % 17) for k in range(500)], "feature_id string, at string, concurrent int").select("feature_id", F.col("at").cast("timestamp").alias("observed_at"), "concurrent")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    hourly.into_files(hourly.hourly_stream(stream), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    batch = rows.groupBy("feature_id", F.to_date("observed_at").alias("date"), F.hour("observed_at").alias("hour")).agg(F.max("concurrent").cast("double").alias("concurrent"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, batch.collect()))
    once = hourly.first_only(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), ["feature_id", "concurrent"], "2 days")
    hourly.into_files(once, str(tmp_path / "once"), str(tmp_path / "state2"), "append").awaitTermination()
    assert spark.read.parquet(str(tmp_path / "once")).count() == 51


def test_questions(spark):
    assert ask.intent("What would we save if we cut 10%?")[0] == "scenario"
    assert ask.intent("Which renewals come first?")[1] == "renewal_priority"
    assert ask.intent("Tell me a joke") is None
    assert ask.percentage("grow by 7.5 %") == 7.5
    assert {q for _, _, q in ask.INTENTS} <= set(queries.queries())
    names = spark.createDataFrame([("Mech",), ("Mech Pro",), ("Other",)], "name string")
    assert [r["name"] for r in ask.subject("how is mech pro doing", names).collect()] == ["Mech Pro"]
    with pytest.raises(LookupError):
        ask.answer("hello", queries.queries(), spark, "/root/testdata/sf0.001")
    assert ask.answer("who uses it by location?", queries.queries(), spark, "/root/testdata/sf0.001").count() == 5


def test_ingest_usage_and_contracts(spark, tmp_path):
    from seatmetrics.sources.ingest import ingest

    usage = tmp_path / "flexlm_usage.csv"
    usage.write_text("DATE,TIME,FEATURE,VENDOR_DAEMON,USER,HOST,DISPLAY,LICENSES_IN_USE,STATUS\n2024-01-01,09:00,MECH,ansys,ann,h,d,4,DENIED\n2024-01-01,10:00,MECH,ansys,ann,h,d,5,OUT\nbad,10:00,MECH,ansys,ann,h,d,5,OUT\n")
    out = ingest(spark, str(usage), "usage", overrides={"hour": "TIME"})
    assert (out.source, out.accepted.count(), [r["rule"] for r in out.rejections.collect()]) == ("flexnet", 2, ["invalid_date"])
    assert {(r["hour"], r["denied"]) for r in out.accepted.collect()} == {(9, True), (10, None)}
    assert out.summary.count() == 1 and {r["field"] for r in out.quality.collect()} >= {"date", "feature", "user"}
    lines = tmp_path / "contracts.tsv"
    lines.write_text("Publisher\tSoftware Name\tQty\tUnit Price\tCurrency\tContract Start\tContract End\tRenewal Date\nA\tMech\t10\t$5.00\tUSD\t2024-01-01\t2024-12-31\t2025-01-01\nA\tMech\t10\t5\t$\t\t\t\nA\tOther\t1\t\tEUR\t\t\t\nA\tThird\t1\t2\t\t2024-05-01\t2024-01-01\t\n")
    out = ingest(spark, str(lines), "contracts")
    assert sorted(r["rule"] for r in out.rejections.collect()) == ["inconsistent_dates", "invalid_currency", "no_commercial_content"]
    assert [(r["feature"], r["unit_price"], r["annual_cost"], r["currency"]) for r in out.accepted.collect()] == [("Mech", 5.0, 50.0, "USD")]
