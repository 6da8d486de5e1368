"""Questions about known and unknown subjects, and candidates by common words."""

import random

import pytest
from pyspark.sql import functions as F

from seatmetrics import queries
from seatmetrics.operators import review
from seatmetrics.plans import ask

SF = "/root/testdata/sf0.001"


def told(spark, names, *questions):
    rows = spark.createDataFrame([(k, q) for k, q in enumerate(questions)], "question_id int, question string")
    table = spark.createDataFrame([(n, "feature_id", n.lower()) for n in names], "name string, column string, value string")
    return {questions[r["question_id"]]: (r["status"], r["unknown"], r["name"], r["intent"]) for r in ask.understood(rows, table).collect()}


def test_subjects(spark):
    names = ["Simulink", "Simulink Coder", "MECH_ENT", "Mech Pro", "AB"]
    got = told(spark, names, "is catia at risk", "Is Simulink Coder at risk?", "What is the cost of mech-ent", "Explain NX_CAM renewals", "Which renewals need attention?", "Why is this recommendation low confidence?", "Tell me a joke", "What happens if Structures grows 12%?", "who uses it by location?", "is simulinkx idle", "")
    assert got["is catia at risk"][:2] == ("unknown subject", "catia")
    assert got["Is Simulink Coder at risk?"] == ("answer", None, "Simulink Coder", "capacity")
    assert got["What is the cost of mech-ent"] == ("answer", None, "MECH_ENT", "spend")
    assert got["Explain NX_CAM renewals"][:2] == ("unknown subject", "NX_CAM")
    assert got["Which renewals need attention?"] == ("answer", None, None, "renewal")
    assert got["Why is this recommendation low confidence?"][0] == "answer" and got["who uses it by location?"][0] == "answer"
    assert got["Tell me a joke"][0] == "no intent" and got[""][0] == "no intent"
    assert got["What happens if Structures grows 12%?"][:2] == ("unknown subject", "Structures") and got["is simulinkx idle"][1] == "simulinkx"


def test_an_empty_estate_answers_nothing(spark):
    assert told(spark, [], "Which renewals need attention?")["Which renewals need attention?"][0] == "no evidence"
    names = spark.createDataFrame([], "name string, column string, value string")
    with pytest.raises(LookupError, match="no evidence"):
        ask.answer("which renewals come first", queries.queries(), spark, SF, names)


def test_answers_are_refused_or_of_the_subject(spark):
    names = spark.createDataFrame([("Brand#3", "feature_id", "Brand#3")], "name string, column string, value string")
    with pytest.raises(LookupError, match="catia"):
        ask.answer("is catia at risk", queries.queries(), spark, SF, names)
    rows = ask.answer("is Brand#3 at risk", queries.queries(), spark, SF, names).collect()
    assert {r["feature_id"] for r in rows} == {"Brand#3"}


def test_common_words_change_nothing(spark):
    """With a word that every name holds, the rows are the same and the pairs are few."""
    rng = random.Random(8)
    words = ["tool"] + [f"w{k:03d}" for k in range(60)]
    names = ["tool " + " ".join(rng.sample(words[1:], rng.randint(0, 3))) for _ in range(400)]
    features = spark.createDataFrame([(f"f{k:03d}", n, f"vendor {k % 4}") for k, n in enumerate(names)], "feature_id string, feature_name string, vendor_name string")
    lines = spark.createDataFrame([(f"l{k}", " ".join(rng.sample(words, rng.randint(1, 4))), f"Vendor {k % 5}" if k % 3 else None) for k in range(120)], "line_id string, name string, vendor string")
    every = sorted(map(tuple, review.review_queue(lines, features, common=10**9).collect()))
    for common in (5, 100):
        assert sorted(map(tuple, review.review_queue(lines, features, common=common).collect())) == every
    raw, known = lines.select(F.col("name").alias("raw")), features.select("feature_id", F.col("feature_name").alias("label"))
    every = sorted(map(tuple, review.suggestions(raw, known, common=10**9).collect()))
    assert sorted(map(tuple, review.suggestions(raw, known, common=100).collect())) == every
    left, right = spark.createDataFrame([(["tool"],)] * 50, "a array<string>"), features.select("feature_id", F.split("feature_name", " ").alias("b")).withColumn("size", F.size("b"))
    assert review.word_pairs(left, right, "a", "b", "feature_id", [["size"]], 5, 10**9).count() == 50 * 400
    assert review.word_pairs(left, right, "a", "b", "feature_id", [["size"]], 5, 100).count() <= 50 * 5 * 5


def test_first_keys_of_a_word(spark):
    keys = spark.createDataFrame([(f"k{k:03d}_suite",) for k in range(50)] + [("lone_name",), ("suite",)], "feature_key string")
    got = {}
    for r in review.related_features(keys, keys).collect():
        got.setdefault(r["name"], []).append(r["feature_key"])
    assert sorted(got["k049_suite"]) == [f"k{k:03d}_suite" for k in range(5)] and sorted(got["k002_suite"]) == [f"k{k:03d}_suite" for k in (0, 1, 3, 4, 5)] and "lone_name" not in got
