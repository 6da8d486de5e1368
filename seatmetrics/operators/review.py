"""Candidates for a person to decide on: rows that share a telling word or a part of an identifier.

Both sides meet by equal words or pieces, so a line is compared with its plausible candidates only. Words that many names
hold do not pair them all: of names that can share only such common words with a line, the score depends on which of
them they hold and on how many words they have, so the first few of each such group stand for all, and the result is the
same. Users' pieces are nearly unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seatmetrics.functions.text import name_tokens, resemblance, token_similarity, user_key

LEAST_SCORE, SHOWN = 15, 5
#: A word that more names than this hold is common.
COMMON = 1_000
#: People whose identifiers a task cuts into pieces.
TASK_PEOPLE = 20_000


def _top(rows: DataFrame, by: str | list[str], order: list[Column], n: int = SHOWN) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(*order))).where(F.col("rank") <= n)


def common_words(right: DataFrame, words: str, common: int) -> DataFrame | None:
    """(word) of the words that more than ``common`` rows of ``right`` hold; nothing where there is none."""
    many = right.select(F.explode(F.array_distinct(words)).alias("word")).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") > common).select("word")
    return None if many.isEmpty() else many


def word_pairs(left: DataFrame, right: DataFrame, own: str, others: str, key: str, groups: list[list[str]], keep: int, common: int = COMMON) -> DataFrame:
    """Rows of ``left`` with rows of ``right`` that share a word of the arrays ``own`` and ``others``, as far as they can matter.

    Rows that share a word which is not common are all paired. For common words, the ``keep`` least ``key`` of each
    group of right rows stand for the group: those that hold the same common words and agree in the columns of one of
    ``groups``. The caller's score must depend on nothing else where no other word is shared, and rank equal ones by ``key``.
    A pair comes once for each word by which it is found.
    """
    spread = right.withColumn("word", F.explode(F.array_distinct(others)))
    asked = left.withColumn("word", F.explode(F.array_distinct(own)))
    many = common_words(right, others, common)
    if many is None:
        return asked.join(spread, "word").drop("word")
    rare = asked.join(many, "word", "left_anti").join(spread.join(many, "word", "left_anti"), "word")
    held = spread.join(many, "word").groupBy(key).agg(F.array_sort(F.collect_list("word")).alias("held"))
    marked = right.join(held, key)
    out = rare
    for columns in groups:
        first = F.row_number().over(W.partitionBy("held", *columns).orderBy(key))
        stand_in = marked.withColumn("place", first).where(F.col("place") <= keep).drop("place")
        out = out.unionByName(asked.join(stand_in.withColumn("word", F.explode("held")).drop("held"), "word"))
    return out.drop("word")


def review_queue(lines: DataFrame, features: DataFrame, common: int = COMMON) -> DataFrame:
    """``lines`` (line_id, name, vendor) against observed ``features`` (feature_id, feature_name, vendor_name): the five best by common words, the vendor adding 15.

    Lines of equal words and vendor are compared once.
    """
    named = lines.select("line_id", F.lower(F.trim("vendor")).alias("vendor"), name_tokens(F.col("name")).alias("a"))
    right = features.select("feature_id", F.lower(F.trim("vendor_name")).alias("vendor_name"), name_tokens(F.col("feature_name")).alias("b")).withColumn("size", F.size("b"))
    left = named.select("a", "vendor").distinct()
    # The score depends on the size and, where it is the line's own, on the vendor.
    pairs = word_pairs(left, right, "a", "b", "feature_id", [["size"], ["size", "vendor_name"]], SHOWN, common).dropDuplicates(["a", "vendor", "feature_id"])
    same = F.coalesce(F.col("vendor") == F.col("vendor_name"), F.lit(False))
    score = F.least(F.lit(100), token_similarity(F.col("a"), F.col("b")) + F.when(same, 15).otherwise(0)).cast("bigint")
    scored = pairs.select("a", "vendor", "feature_id", score.alias("score")).where(F.col("score") >= LEAST_SCORE)
    best = _top(scored, ["a", "vendor"], [F.col("score").desc(), F.col("feature_id")]).withColumnsRenamed({"a": "words", "vendor": "of"})
    return named.join(best, (F.col("a") == F.col("words")) & F.col("vendor").eqNullSafe(F.col("of"))).select("line_id", "feature_id", "score", "rank")


def user_review_queue(users: DataFrame, people: DataFrame) -> DataFrame:
    """``users`` (key) against ``people`` (employee_id, username, email): resemblance of identifiers, that of the mailbox less 10.

    Of two identifiers that resemble each other one begins or ends the other. So each meets the others by equal text,
    once with its own beginnings and ends and once as a beginning or end of theirs, and no two others are compared.
    """

    def ends(x: Column) -> Column:
        sizes = F.sequence(F.lit(4), F.length(x))
        return F.explode(F.array_distinct(F.concat(F.transform(sizes, lambda n: F.left(x, n)), F.transform(sizes, lambda n: F.right(x, n)))))

    name, mail = user_key(F.col("username")), F.split_part(user_key(F.col("email")), F.lit("@"), F.lit(1))
    # An identifier becomes some twenty rows of pieces, out of files that are small: both sides are dealt by their number first.
    tasks = max(users.sparkSession.sparkContext.defaultParallelism, -(-people.count() // TASK_PEOPLE))
    left = users.select("key").where(F.length("key") >= 4).repartition(tasks, "key")
    ids = people.repartition(tasks, "employee_id").select("employee_id", F.explode(F.array(F.struct(name.alias("id"), F.lit(0).alias("less")), F.struct(mail.alias("id"), F.lit(10).alias("less")))).alias("x")).select("employee_id", "x.*").where(F.length("id") >= 4)
    met = lambda a, b: a.repartition(tasks, "piece").join(b.repartition(tasks, "piece"), "piece")
    inside = met(left.withColumn("piece", ends(F.col("key"))), ids.withColumn("piece", F.col("id")))
    around = met(left.withColumn("piece", F.col("key")), ids.withColumn("piece", ends(F.col("id"))))
    raw = resemblance(F.col("key"), F.col("id"))
    scored = inside.unionByName(around).withColumn("score", F.when(raw > 0, F.greatest(raw - F.col("less"), F.lit(0)))).where("score > 0")
    best = scored.select("key", "employee_id", "score").repartition(tasks, "key").groupBy("key", "employee_id").agg(F.max("score").cast("bigint").alias("score"))
    return _top(best, "key", [F.col("score").desc(), F.col("employee_id")])


def related_features(names: DataFrame, features: DataFrame) -> DataFrame:
    """Features that share a word of four characters or more with a name: the first five by key.

    Of each word only the first six keys are sent to the names, as one of them may be the name itself.
    """
    words = F.explode(F.array_distinct(F.filter(F.split("feature_key", "_"), lambda w: F.length(w) >= 4))).alias("word")
    first = _top(features.select("feature_key", words).distinct(), "word", [F.col("feature_key")], SHOWN + 1).drop("rank")
    pairs = names.select(F.col("feature_key").alias("name"), words).join(first, "word").where("name <> feature_key").select("name", "feature_key").distinct()
    return _top(pairs, "name", [F.col("feature_key")])


def suggestions(unmapped: DataFrame, candidates: DataFrame, common: int = COMMON) -> DataFrame:
    """For each raw value of ``unmapped`` (raw) the feature of ``candidates`` (feature_id, label) that shares most words of three characters or more; the first of equal ones."""

    def words(x: Column) -> Column:
        return F.filter(F.split(F.lower(x), "[^a-z0-9]+"), lambda w: F.length(w) >= 3)

    left = unmapped.select("raw", words(F.col("raw")).alias("a")).distinct()
    right = candidates.select("feature_id", F.array_distinct(words(F.col("label"))).alias("b"))
    pairs = word_pairs(left, right, "a", "b", "feature_id", [[]], 1, common).dropDuplicates(["raw", "feature_id"])
    shared = F.size(F.filter("a", lambda w: F.array_contains("b", w))).cast("bigint")
    return _top(pairs.select("raw", "feature_id", shared.alias("overlap")), "raw", [F.col("overlap").desc(), F.col("feature_id")], 1).drop("rank")


def related_by_lead(keys: DataFrame) -> DataFrame:
    """Keys (feature_key) that begin with the same word of three characters or more: how many others there are, and the first few of them.

    The few smallest keys of each word are found first and joined to its members, so members are never paired with each other.
    """
    lead = F.filter(F.split("feature_key", "_"), lambda w: F.length(w) >= 3)[0]
    rows = keys.select("feature_key").distinct().withColumn("lead", lead).where("lead IS NOT NULL")
    sizes = rows.groupBy("lead").agg((F.count("*") - 1).alias("others")).where("others > 0")
    first = _top(rows, "lead", [F.col("feature_key")], SHOWN + 1).groupBy("lead").agg(F.array_sort(F.collect_list("feature_key")).alias("first"))
    shown = F.slice(F.array_remove("first", F.col("feature_key")), 1, SHOWN)
    return rows.join(sizes, "lead").join(first, "lead").select("feature_key", "lead", "others", F.array_join(shown, "|").alias("related"))
