"""Records of delimited files, keyset reads, sliced inserts, confirmations and coverage."""

import csv
import io
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from seatmetrics.plans import confirmations, coverage
from seatmetrics.sources import files, keyset
from seatmetrics.sources.inserts import SlicedInsert


def test_blank_lines_count(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("a,A,a`b,source_row\n\n1,2,3,4\n , ,,\n\"x\n\ny\",5,,\nz\n")
    raw = files.read_delimited(spark, str(path))
    assert raw.columns == ["a", "A (2)", "a`b", "source_row (2)", "source_row"]
    assert sorted(map(tuple, raw.collect()), key=lambda r: r[-1]) == [("1", "2", "3", "4", 3), ("x\n\ny", "5", None, None, 5), ("z", None, None, None, 6)]


def test_empty_file(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("")
    with pytest.raises(ValueError, match="empty"):
        files.read_delimited(spark, str(path))
    path.write_text("a,b\n")
    assert files.read_delimited(spark, str(path)).count() == 0


@pytest.mark.parametrize("encoding", ["utf-8", "utf-16"])
def test_records_over_partitions(spark, tmp_path, encoding):
    """A file cut into many partitions, with quoted breaks across them, is read as the standard reader does."""
    rng = random.Random(5)
    cells = ["plain", "", 'a "word"', "two\nlines", "x,y", "\n\n", "é", 'q"', "end\n" * 40]
    rows = [[rng.choice(cells) for _ in range(4)] for _ in range(900)]
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows([["h1", "h2", "h3", "h4"], *rows])
    path = tmp_path / "many.csv"
    path.write_bytes(out.getvalue().encode(encoding))
    want = [(k, [c or None for c in r]) for k, r in enumerate(rows, 2) if any(c.strip() for c in r)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000b")
    try:
        lines = files.text_lines(spark, str(path), "UTF-8")
        assert encoding != "utf-8" or lines.rdd.getNumPartitions() > 8
        got = sorted((r["source_row"], [c or None for c in r[:4]]) for r in files.read_delimited(spark, str(path)).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == want


def test_state_of_a_reader():
    assert files.ends_inside('a,"b', False, ",") and not files.ends_inside('a"b,c', False, ",")
    assert not files.ends_inside('x",y', True, ",") and files.ends_inside('x"",y', True, ",") and files.ends_inside('x","y', True, ",")
    assert files.header_names([None, "a", "A", " ", "Column 1"]) == ["Column 1", "a", "A (2)", "Column 4", "Column 1 (2)"]


def test_ranges_of_keys():
    groups = [keyset.Group("f", 0, 100, 0, 99), keyset.Group("f", 1, 100, 100, 199), keyset.Group("g", 0, 100, 50, 149), keyset.Group("g", 1, 0, 5, 6)]
    for low, high in ((-1, 1 << 40), (60, 120), (199, 300), (10, 10)):
        found = keyset.ranges(groups, 40, low, high)
        keys = [k for r in found for k in range(max(r.after, -5) + 1, min(r.upto, 400) + 1)]
        assert [k for k in keys if k <= 199] == list(range(max(low + 1, keys[0] if keys else 0), min(high, 199) + 1))
        for r in found:
            assert r.groups == sorted({f: [g.number for g in groups if g.file == f and g.rows and g.greatest > r.after and g.least <= r.upto] for f, _ in r.groups}.items())
    assert len(keyset.ranges(groups, 40, -1, 1 << 40)) >= 6 and len(keyset.ranges(groups, 10_000, -1, 1 << 40)) == 1


def test_keyset_reads_its_ranges_only(spark, tmp_path):
    ids = list(range(0, 4000, 2))
    random.Random(3).shuffle(ids)
    for k in range(2):
        own = [*sorted(ids[k * 1000 : (k + 1) * 1000]), None]
        pq.write_table(pa.table({"id": pa.array(own, pa.int64()), "x": pa.array([str(i) for i in own]), "unread": pa.array([0] * len(own))}), tmp_path / f"{k}.parquet", row_group_size=100)
    rows = keyset.read_after(spark, str(tmp_path), "id", after=1000, rows=300, columns="id,x")
    assert rows.columns == ["id", "x"] and sorted(r["id"] for r in rows.collect()) == list(range(1002, 4000, 2))
    parts = [[r["id"] for r in part] for part in rows.rdd.glom().collect() if part]
    assert len(parts) > 3 and all(p == sorted(p) for p in parts)
    bounds = sorted((p[0], p[-1]) for p in parts)
    assert all(a[1] < b[0] for a, b in zip(bounds, bounds[1:]))
    assert keyset.read_after(spark, str(tmp_path), "id", after=5000).count() == 0
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        narrow = keyset.read_after(spark, str(tmp_path), "id", rows=300).where("id > 100 AND id <= 108 AND x <> '104'")
        assert sorted(r["id"] for r in narrow.collect()) == [102, 106, 108] and narrow.rdd.getNumPartitions() == 1
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_insert_that_breaks_off(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([(k, f"f{k % 30}", None if k % 3 else k) for k in range(100)], "source_row long, feature string, pool int")
    distinct = rows.dropDuplicates(["feature", "pool"]).count()
    store = SlicedInsert(spark, str(tmp_path / "s"), ("feature", "pool"), slice_rows=25)
    assert store.stored(rows).count() == 0
    assert store.send(rows, "one", most_slices=1) == 3
    with pytest.raises(RuntimeError, match="accepted"):
        store.complete("one", distinct)
    # An attempt whose rows were written, but of which the ledger never learns; and one that a second sender finished too.
    lost = rows.where("source_row >= 25").withColumns({"attempt": F.lit("lost"), "import_id": F.lit("one"), "slice": F.lit(1).cast("bigint")})
    lost.write.mode("append").partitionBy("attempt", "import_id", "slice").parquet(str(tmp_path / "s/rows"))
    assert store.stored(rows).where("source_row >= 25").count() == 0
    assert store.send(rows, "one") == 0 and store.send(rows, "one") == 0
    lost.selectExpr("import_id", "slice", "'zzz' AS attempt", "75L AS sent", "75L AS stored").limit(1).write.mode("append").parquet(str(tmp_path / "s/ledger"))
    assert store.complete("one", distinct) == distinct
    assert store.stored(rows).groupBy("feature", "pool").count().where("count > 1").count() == 0 and store.stored(rows).count() == distinct
    more = rows.unionByName(spark.createDataFrame([(100, "new", None)], rows.schema))
    store.send(more, "two")
    assert [(r["import_id"], r["feature"]) for r in store.stored(rows).where("import_id = 'two'").collect()] == [("two", "new")]
    assert store.complete("two", 1) == 1


EVENT = "kind string, raw_value string, target string, decision string, action string, decided_at timestamp_ntz, seq bigint"


def test_decisions_are_recorded_and_undone(spark, tmp_path):
    import datetime as dt

    at = lambda d: dt.datetime(2024, 1, d)
    log = confirmations.ConfirmationLog(spark, str(tmp_path))
    log.add(spark.createDataFrame([("feature", " Cad ", "Mech Ent", "confirmed", "record", at(1), 1), ("feature", "cad", None, None, "undo", at(2), 2), ("user", "ann", "Ann ", "confirmed", "record", at(1), 3), ("user", "bob", "b", "confirmed", "record", at(1), None), (None, "x", "y", "confirmed", "record", at(1), 1)], EVENT))
    assert {(r["kind"], r["raw"]) for r in log.state().collect()} == {("user", "ann"), ("user", "bob")}
    assert [(r["raw"], str(r["undone_at"])[:10]) for r in confirmations.undone(log.events()).collect()] == [("cad", "2024-01-02")]
    log.add(spark.createDataFrame([("feature", "CAD", "Other-One", "confirmed", "record", at(3), 4), ("user", "ann", "z", "rejected", "record", at(1), 9), ("user", "bob", "c", "confirmed", "record", at(1), None)], EVENT))
    assert {(r["raw"], r["target"]) for r in confirmations.aliases(log.events(), "feature").collect()} == {("cad", "other_one")}
    rows = {r["raw"]: (r["target"], r["decision"], r["changes"]) for r in log.state().collect()}
    assert rows == {"cad": ("other_one", "confirmed", 3), "ann": ("z", "rejected", 2), "bob": ("c", "confirmed", 2)}  # equal times: one outcome
    assert confirmations.undone(log.events()).count() == 0


def test_coverage_of_nothing(spark):
    usage = spark.createDataFrame([], "feature string, user string, date date, hour int, concurrent double, denied boolean, source string")
    lines, people = spark.createDataFrame([], "feature string, source string"), spark.createDataFrame([], "user string, source string")
    contracts = spark.createDataFrame([], "feature string, unit_price double, renewal_date date, currency string, source string")
    row = coverage.coverage(usage, lines, people, contracts).first().asDict()
    assert row["history_days"] == 0 and row["currencies"] == "" and row["has_denials"] is False and row["distinct_users"] == 0
    facts = spark.createDataFrame([(False, 0, False, 0)], "has_cost boolean, resolved_people int, named_user boolean, distinct_dates int")
    given = coverage.inputs(coverage.coverage(usage, lines, people, contracts), facts)
    assert coverage.quality_band(given).first()["band"] == "Low"
    assert coverage.suggestions(given).count() == 11
    first = coverage.unlocks(given).orderBy("rank").first()
    assert (first["input"], first["unlocks"]) == ("usage", 2)
    assert {r["label"]: r["state"] for r in coverage.lines(given).collect()}["Currency"] == "not_supplied"
    plan = coverage.coverage(usage, lines, people, contracts)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") <= 4


def test_denial_column_without_a_refusal_counts(spark):
    usage = spark.createDataFrame([("F", "Ann", False)], "feature string, user string, denied boolean").withColumn("date", F.lit("2024-01-01").cast("date"))
    people = spark.createDataFrame([("ANN",)], "user string")
    none = spark.createDataFrame([], "feature string")
    row = coverage.coverage(usage, none, people, none).first()
    assert row["has_denials"] and row["distinct_users"] == 1 and row["history_days"] == 1 and not row["has_timed"]
