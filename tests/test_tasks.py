"""What a task holds follows a fixed number of rows, not the size of the tables."""

import re
from datetime import date, datetime

from pyspark.sql import functions as F

from seatmetrics.functions import text
from seatmetrics.operators import review
from seatmetrics.plans import commercial
from seatmetrics.sources import estate, mapping
from seatmetrics.sources.inserts import SlicedInsert


def _tables(spark, tmp_path, orders: int):
    day = datetime(2024, 1, 5)
    spark.createDataFrame([(1, "Brand#1"), (2, "Brand#2")], "p_partkey bigint, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(n, n % 40, day) for n in range(orders)], "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    lines = [(n, 1 + (n + k) % 2, 2.0) for n in range(orders) for k in (0, 0, 1)]
    spark.createDataFrame(lines, "l_orderkey bigint, l_partkey bigint, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    return estate.Estate(spark, str(tmp_path))


def test_activity_is_dealt_by_the_number_of_lines(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(estate, "TASK_LINES", 100)
    rows = _tables(spark, tmp_path, 400).activity()
    assert rows.rdd.getNumPartitions() == 12  # 1,200 lines
    got = {(r["feature_id"], r["employee_id"]): (r["total_sessions"], r["total_hours"]) for r in rows.collect()}
    # An even employee has ten orders: two lines on the second brand and one on the first, each order counted once.
    assert len(got) == 80 and got["Brand#1", 2] == (10, 40.0) and got["Brand#2", 2] == (10, 20.0) and got["Brand#1", 0] == (0, 0.0)


def test_people_are_dealt_as_the_activity_that_they_join(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(estate, "TASK_LINES", 100)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        e = _tables(spark, tmp_path, 400)
        people = spark.range(40).select(F.col("id").alias("employee_id"), F.lit("d").alias("department"), F.lit("M1").alias("manager_key"), F.lit("Bo").alias("manager_name"), F.lit("active").alias("status"))
        features = spark.createDataFrame([("Brand#1", "named_user", 5.0, 80.0, 20.0), ("Brand#2", "token", 5.0, 40.0, 10.0)], "feature_id string, license_model string, unit_price double, current_cost double, waste double")
        for rows in (commercial.allocate(e.activity(), people, features, "department", "usage_duration"), commercial.manager_rollup(people, e.activity(), features, date(2024, 12, 1))):
            dealt = re.findall(r"hashpartitioning\((?:employee_id|l_orderkey)#\d+L?, (\d+)\)", rows._jdf.queryExecution().executedPlan().toString())
            assert set(dealt) == {"12"}  # 1,200 lines, while a join has 4 tasks by its settings
        assert [(r["grp"], r["allocated_spend"], r["sessions"], r["headcount"]) for r in commercial.allocate(e.activity(), people, features, "department", "usage_duration").collect()] == [("d", 120.0, 780, 40)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_people_of_a_manager_are_counted_without_sorting_them(spark):
    people = spark.createDataFrame([(1, "M1", "Bo"), (2, "m1 ", "Al"), (3, "M1", None), (3, "M1", None), (4, None, "Al"), (5, None, None)], "employee_id bigint, manager_key string, manager_name string")
    activity = spark.createDataFrame([("f", 1, True, 2, 3.0, date(2024, 1, 1))], "feature_id string, employee_id bigint, assigned boolean, total_sessions bigint, total_hours double, last_used date")
    features = spark.createDataFrame([("f", "named_user", 5.0)], "feature_id string, license_model string, unit_price double")
    rows = commercial.manager_rollup(people, activity, features, date(2024, 12, 1))
    assert not re.search(r"SortAggregate\(key=\[[^\]]*employee_id", rows._jdf.queryExecution().executedPlan().toString())
    # Rows are counted, as the statement does: a person told twice is two.
    assert sorted(tuple(r) for r in rows.collect()) == [("key:m1", "Al", True, 4, 1, 1, 1, 1, 5.0), ("name:Al", "Al", False, 1, 0, 0, 0, 0, None)]
    assert dict(rows.dtypes)["reports"] == "bigint"


def test_cells_are_counted_without_sorting_them(spark):
    raw = spark.createDataFrame([("1998-02-03 10:00", "7"), ("3-Mar-1999", "3000000000"), ("n/a", "$1,200.5")], "a string, b string")
    plan = mapping.profiled(raw)._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "HashAggregate" in plan
    assert {r["header"]: tuple(r)[1:] for r in mapping.profiled(raw).collect()} == {"a": (3, 2, 2, 0, 0, 0), "b": (3, 0, 0, 3, 1, 0)}
    assert mapping.profiles(raw)["b"].sample == "$1,200.5"


def test_whole_numbers_beyond_an_int_are_no_hours(spark):
    assert spark.range(1).select(text.read_hour(F.lit("3000000000"))).collect()[0][0] is None


def test_inserts_tell_keys_apart_by_their_values(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00.000001", None), (2, "2024-01-01 00:00:00.000002", None), (3, "2024-01-01 00:00:00.000002", None)], "source_row bigint, at string, pool bigint").withColumn("at", F.col("at").cast("timestamp"))
    store = SlicedInsert(spark, f"file://{tmp_path}/store", ("at", "pool"), slice_rows=2)
    assert store.send(rows, "one", most_slices=1) == 1 and store.send(rows, "one") == 0
    assert store.send(rows, "two") == 0
    assert sorted((r["import_id"], r["source_row"]) for r in store.stored(rows).collect()) == [("one", 1), ("one", 2)]


def test_people_to_review_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(review, "TASK_PEOPLE", 10)
    people = spark.range(90).select(F.col("id").alias("employee_id"), F.format_string("u%04d", "id").alias("username"), F.format_string("%04d@x", "id").alias("email"))
    best = review.user_review_queue(people.select(F.format_string("%04d", "employee_id").alias("key")), people)
    assert best.rdd.getNumPartitions() == 9
    assert {r["key"]: (r["employee_id"], r["score"]) for r in best.collect()} == {f"{k:04d}": (k, 85) for k in range(90)}
