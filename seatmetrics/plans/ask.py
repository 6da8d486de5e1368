"""Questions in words to registered queries: intents by pattern, the named feature or vendor by longest name, refusal else.

Questions are rows, as are the names that they may mean. Names are indexed by their rarest word, so that a question meets
only names of which it holds that word; what is left of a question's possible names after all known words and ordinary
ones are taken out is a subject that the estate does not know, and no answer about something else is given in its place.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seatmetrics.operators.sizing import Options
from seatmetrics.plans.portfolio import scenario
from seatmetrics.sources.estate import Estate

# Intents in the order they are tried, with what points to them and the query that answers.
INTENTS = (
    ("scenario", r"what if|scenario|\d+\s*%", "scenario_rollup"),
    ("renewal", r"renew|contract|agreement|expir", "renewal_priority"),
    ("reclaim", r"reclaim|idle|inactive|unused seat", "reclaim_queue"),
    ("denial", r"denial|denied|refus|turned away", "denial_metrics"),
    ("forecast", r"forecast|next year|predict|will we need", "forecast"),
    ("capacity", r"capacity|saturat|at risk|running out", "capacity_risk"),
    ("driver", r"who (uses|drives)|driver|by (team|department|location)", "demand_drivers"),
    ("vendor", r"vendor|supplier|concentration", "vendor_spend"),
    ("opportunity", r"sav(e|ing)|reduce|opportunit|over-?provision", "top_opportunities"),
    ("reconcile", r"reconcil|disagree|purchased|bought", "reconciliation_summary"),
    ("quality", r"confiden|quality|trust|missing data", "data_quality"),
    ("spend", r"spend|cost|total|price", "portfolio_totals"),
)


def intent(question: str) -> tuple[str, str] | None:
    """(intent, name of the query), or nothing if no pattern fits."""
    low = question.lower()
    return next(((name, query) for name, pattern, query in INTENTS if re.search(pattern, low)), None)


def percentage(question: str) -> float | None:
    found = re.search(r"(-?\d+(?:\.\d+)?)\s*%", question)
    return float(found[1]) if found else None


def subject(question: str, names: DataFrame, column: str = "name") -> DataFrame:
    """The longest name of ``names`` that the question contains; no row if it names none."""
    inside = F.contains(F.lit(question.lower()), F.lower(F.col(column)))
    return names.where(inside).orderBy(F.length(column).desc(), column).limit(1)


# Words that look like a product's name in a question and are none.
ORDINARY = (
    "what", "which", "who", "why", "when", "where", "how", "explain", "show", "tell",
    "the", "our", "my", "we", "us", "is", "are", "do", "does", "did", "can", "should",
    "this", "that", "these", "those", "and", "or", "for", "from", "with", "about",
    "renewal", "renewals", "contract", "contracts", "licence", "license", "licenses",
    "licences", "portfolio", "executive", "summary", "evidence", "missing", "data",
    "cost", "costs", "spend", "saving", "savings", "opportunity", "opportunities",
    "capacity", "risk", "demand", "usage", "forecast", "scenario", "confidence",
    "vendor", "vendors", "feature", "features", "product", "products",
    "user", "users", "seat", "seats", "team", "teams", "department", "departments",
    "program", "programs", "priorit", "prioritise", "prioritize", "biggest", "largest",
    "top", "next", "now", "year", "month", "quarter", "reclaim", "idle", "utilisation",
    "utilization", "growth", "grow", "increase", "decrease", "reduce", "change",
    "changes", "changed", "under", "assumption", "assumptions", "lab", "driving",
    "drives", "driver", "drivers", "recommendation", "recommendations", "made", "being",
)
#: Words written as names are (capitals, codes), and words in the place of a subject, whatever their case.
WRITTEN_AS_NAME = r"\b([A-Z][A-Za-z0-9]{2,}(?:[_-][A-Za-z0-9]+)*|[A-Z0-9]{2,}(?:_[A-Z0-9]+)+)\b"
AS_SUBJECT = r"(?i)\b(?:is|are|about|for|of|on|with|reducing|drives|uses|does)\s+([a-z][a-z0-9]{2,}(?:[_-][a-z0-9]+)*)\b"
#: Words that follow such a place without being a subject.
NO_SUBJECT = ("low", "high", "over", "left", "most", "more", "each", "every", "all", "any", "being", "there", "not", "our", "its", "their", "your", "running", "expiring", "unused", "inactive", "denied", "needed", "worth", "due", "too", "location", "locations", "supplier", "price", "total", "agreement", "agreements")


def _words(x: Column) -> Column:
    return F.filter(F.split(F.lower(x), "[^a-z0-9]+"), lambda w: w != "")


def _spaced(x: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(_words(x), " "), F.lit(" "))


def indexed_names(names: DataFrame) -> DataFrame:
    """``names`` (name, column, value) with ``key_word``, the word of each that fewest names hold; names of less than three characters are left out."""
    usable = names.where(F.length(F.trim("name")) > 2).withColumn("words", _words(F.col("name"))).where(F.size("words") > 0)
    spread = usable.select("name", F.explode(F.array_distinct("words")).alias("word")).distinct()
    counts = spread.groupBy("word").agg(F.count("*").alias("n"))
    rarest = spread.join(counts, "word").groupBy("name").agg(F.min(F.struct("n", "word")).alias("r")).select(F.col("name").alias("of"), F.col("r.word").alias("key_word"))
    return usable.drop("words").join(rarest, F.col("name") == F.col("of")).drop("of")


def understood(questions: DataFrame, names: DataFrame) -> DataFrame:
    """For each of ``questions`` (question_id, question): intent, query, percent, the name that it means (name, column, value), unknown, and status.

    ``names`` (name, column, value) is what the estate has. The longest name whose words stand in the question counts.
    ``unknown`` is the first word that must be a name and is neither known nor ordinary. ``status``: no evidence (the
    estate is empty), unknown subject, no intent, or answer.
    """
    intent_name, query_name = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, pattern, query in reversed(INTENTS):
        hit = F.lower("question").rlike(pattern)
        intent_name, query_name = F.when(hit, name).otherwise(intent_name), F.when(hit, query).otherwise(query_name)
    base = questions.select("question_id", "question", intent_name.alias("intent"), query_name.alias("query"), F.regexp_extract("question", r"(-?\d+(?:\.\d+)?)\s*%", 1).try_cast("double").alias("percent"))
    asked = base.select("question_id", "question", F.explode(F.array_distinct(_words(F.col("question")))).alias("key_word"))
    found = asked.join(indexed_names(names), "key_word").where(F.contains(_spaced(F.col("question")), _spaced(F.col("name"))))
    meant = found.groupBy("question_id").agg(F.max(F.struct(F.length("name").alias("size"), "name", "column", "value")).alias("m")).select(F.col("question_id").alias("of"), "m.name", "m.column", "m.value")
    # Possible names in the order of the question, each with its parts.
    place = F.struct(F.instr(F.col("question"), F.col("term")).alias("at"), "term")
    terms = base.select("question_id", "question", F.explode(F.array_distinct(F.concat(F.regexp_extract_all("question", F.lit(WRITTEN_AS_NAME), F.lit(1)), F.regexp_extract_all("question", F.lit(AS_SUBJECT), F.lit(1))))).alias("term"))
    parts = terms.select("question_id", place.alias("place"), F.explode(F.filter(_words(F.col("term")), lambda w: F.length(w) > 2)).alias("word"))
    known = names.select(F.explode(F.array_distinct(_words(F.col("name")))).alias("word")).where(F.length("word") > 2).distinct().withColumn("known", F.lit(True))
    judged = parts.join(known, "word", "left").groupBy("question_id", "place").agg(F.bool_or(F.coalesce("known", F.lit(False)) | F.col("word").isin(*ORDINARY, *NO_SUBJECT)).alias("fine"))
    strange = judged.where("NOT fine").groupBy("question_id").agg(F.min("place").alias("p")).select(F.col("question_id").alias("by"), F.col("p.term").alias("unknown"))
    empty = F.broadcast(names.agg((F.count("*") == 0).alias("empty")))
    out = base.join(meant, F.col("question_id") == F.col("of"), "left").join(strange, F.col("question_id") == F.col("by"), "left").join(empty).drop("of", "by")
    status = F.when(F.col("empty"), "no evidence").when(F.col("unknown").isNotNull(), "unknown subject").when(F.col("intent").isNull(), "no intent").otherwise("answer")
    return out.withColumn("status", status).drop("empty", "question")


def answer(question: str, queries: dict, spark, sf_dir: str, names: DataFrame | None = None) -> DataFrame:
    """The rows that answer; a question that no intent fits is refused, not guessed at.

    A percentage in a scenario is the growth that it asks about. ``names`` (name, column, value): what a question may
    name, and which rows it then means; an answer that has the column keeps only these rows, and one that has not is
    refused where a name was given, as it would say nothing about it.
    """
    if names is not None:
        (told,) = understood(spark.createDataFrame([(1, question)], "question_id int, question string"), names).collect()
        if told["status"] == "no evidence":
            raise LookupError("nothing was imported, so there is no evidence to answer from")
        if told["status"] == "unknown subject":
            raise LookupError(f"there is no evidence about {told['unknown']}")
    found = intent(question)
    if found is None:
        raise LookupError("no query answers this question")
    name, query = found
    share = percentage(question)
    if name == "scenario" and share is not None:
        return scenario(Estate(spark, sf_dir), Options(growth=1 + share / 100))
    rows = queries[query](spark, sf_dir)
    meant = subject(question, names).collect() if names is not None else []
    if not meant:
        return rows
    column, value = meant[0]["column"], meant[0]["value"]
    if column not in rows.columns:
        raise LookupError(f"the answer to this question has no {column}")
    return rows.where(F.col(column) == value)
