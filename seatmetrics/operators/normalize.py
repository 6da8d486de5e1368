"""Loosely written rows to typed ones: every failed rule of a row is named, the row itself counts once.

One projection reads and checks all cells; accepted rows and rejections are two filters on it. The first of equal rows
is kept by its place in the source.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seatmetrics.functions.numeric import half_up, ratio
from seatmetrics.functions.text import cell, day_part, read_boolean, read_currency, read_date, read_hour, read_number, read_timestamp


@dataclass(frozen=True)
class Field:
    """A canonical field of a dataset: its type, and whether a row needs it and may be below zero."""

    name: str
    kind: str = "string"
    required: bool = False
    signed: bool = False


USAGE = (
    Field("date", "date", required=True), Field("hour", "hour"), Field("feature", required=True), Field("user"), Field("employee_code"), Field("product"), Field("vendor"),
    Field("quantity", "number"), Field("concurrent", "number"), Field("peak", "number"), Field("available", "number"), Field("duration_hours", "number"), Field("denied", "boolean"),
    Field("denial_count", "number"), Field("license_server"), Field("pool"), Field("tokens", "number"), Field("hostname"), Field("version"), Field("borrowed", "boolean"),
    Field("observed_at", "timestamp"), Field("checkout_at", "timestamp"), Field("checkin_at", "timestamp"),
)
ENTITLEMENTS = (Field("feature", required=True), Field("product"), Field("vendor"), Field("quantity", "number", required=True), Field("license_model"), Field("license_server"), Field("pool"), Field("expires_on", "date"))
PEOPLE = (
    Field("user", required=True), Field("employee_code"), Field("display_name"), Field("email"), Field("status"), Field("employee_type"), Field("manager_name"), Field("manager_key"), Field("department"),
    Field("organization"), Field("business_unit"), Field("program"), Field("discipline"), Field("competency"), Field("location"), Field("region"), Field("cost_center"),
)
CONTRACTS = (
    Field("feature", required=True), Field("product"), Field("vendor"), Field("sku"), Field("contract_number"), Field("agreement_number"), Field("purchase_order"), Field("supplier"), Field("quantity", "number"),
    Field("unit_price", "number"), Field("total_cost", "number"), Field("annual_cost", "number"), Field("currency"), Field("license_model"), Field("pricing_unit"), Field("start_date", "date"), Field("end_date", "date"),
    Field("renewal_date", "date"), Field("business_unit"), Field("cost_center"), Field("owner"), Field("notes"),
)
DATASETS = {"usage": USAGE, "entitlements": ENTITLEMENTS, "people": PEOPLE, "contracts": CONTRACTS}
# What makes two rows of a dataset the same row. Usage folds the case of user and feature only.
KEYS = {
    "usage": ("date", "hour", "observed_at", "user", "feature", "license_server", "pool", "quantity", "concurrent", "peak", "checkout_at"),
    "entitlements": ("feature", "license_server", "pool", "expires_on"),
    "people": ("user",),
    "contracts": ("feature", "sku", "contract_number", "purchase_order", "quantity", "unit_price", "total_cost", "start_date", "end_date"),
}
#: Columns whose timestamp stands in for the date of an observation, the first that has one.
STAMPS = ("observed_at", "checkout_at")
#: A reader of cells as a column expression.
Reader = Callable[[Column], Column]
_RULES = {"date": "invalid_date", "timestamp": "invalid_date", "number": "invalid_number", "hour": "invalid_hour"}


def _read(field: Field, text: Column, day_first: bool, denied: Reader | None) -> Column:
    if field.kind == "date":
        return read_date(text, day_first)
    if field.kind == "timestamp":
        return read_timestamp(text, day_first, F.col(f"day_{field.name}"))
    if field.name == "denied":
        return F.coalesce((denied or denied_word)(text), read_boolean(text))
    return {"number": read_number, "hour": read_hour, "boolean": read_boolean}.get(field.kind, cell)(text)


def _error(rule: str, field: str, value: Column) -> Column:
    return F.struct(F.lit(rule).alias("rule"), F.lit(field).alias("field"), F.substring(value, 1, 60).alias("value"))


def typed(raw: DataFrame, dataset: str, day_first: bool = False, denied: Reader | None = None) -> DataFrame:
    """``raw`` (texts, source_row) as typed columns of the dataset's fields that it has, and ``errors``.

    ``denied`` reads a source's own words for a refused request; a column ``source``, if there is one, stays.
    Cells are trimmed, read and checked in three projections, so that each cell is trimmed and read once.
    """
    fields = [f for f in DATASETS[dataset] if f.name in raw.columns]
    have = {f.name for f in fields}
    said = {f.name: F.col(f"said_{f.name}") for f in fields}
    extra = ["source"] if "source" in raw.columns else []
    cells = raw.select("source_row", *extra, *[cell(F.col(f.name).cast("string")).alias(f"said_{f.name}") for f in fields])
    cells = cells.withColumns({f"day_{f.name}": day_part(said[f.name]) for f in fields if f.kind == "timestamp"})
    rows = cells.withColumns({f.name: read_currency(said[f.name]) if f.name == "currency" else _read(f, said[f.name], day_first, denied) for f in fields})
    stamps = [c for c in STAMPS if c in have] if dataset == "usage" else []
    dated = "date" not in have and bool(stamps)
    if dated:
        rows = rows.withColumn("date", F.coalesce(*stamps).cast("date"))
    none, errors = F.lit(None).cast("string"), []
    for f in fields:
        text, value = said[f.name], F.col(f.name)
        if f.required:
            errors.append(F.when(text.isNull(), _error("missing_required_field", f.name, none)))
        if f.kind in _RULES:
            errors.append(F.when(text.isNotNull() & value.isNull(), _error(_RULES[f.kind], f.name, text)))
        if f.kind == "number" and not f.signed:
            errors.append(F.when(value < 0, _error("negative_quantity", f.name, text)))
    if dataset == "contracts":
        errors += _commercial_errors(have, said)
    if dated:
        unread = F.lit(False)
        for c in stamps:
            unread = unread | (said[c].isNotNull() & F.col(c).isNull())
        errors.append(F.when(F.col("date").isNull() & ~unread, _error("missing_required_field", "date", none)))
    missing = [f.name for f in DATASETS[dataset] if f.required and f.name not in have and not (f.name == "date" and dated)]
    errors += [_error("unmapped_required_field", name, none) for name in missing]
    return rows.select("source_row", *extra, *[f.name for f in fields], *(["date"] if dated else []), F.array_compact(F.array(*errors)).alias("errors"))


def _commercial_errors(have: set[str], said: dict[str, Column]) -> list[Column]:
    """What only a contract line can get wrong: an unreadable currency, dates in the wrong order, neither a price nor a date."""

    def value(name: str, kind: str) -> Column:
        return F.col(name) if name in have else F.lit(None).cast(kind)

    start, end, renewal = (value(c, "date") for c in ("start_date", "end_date", "renewal_date"))
    costs = [value(c, "double") for c in ("unit_price", "total_cost", "annual_cost")]
    out = [F.when(end < start, _error("inconsistent_dates", "end_date", end.cast("string"))), F.when(renewal < start, _error("inconsistent_dates", "renewal_date", renewal.cast("string")))]
    out.append(F.when(F.coalesce(*costs).isNull() & F.coalesce(end, renewal).isNull(), _error("no_commercial_content", "", F.lit(None).cast("string"))))
    if "currency" in have:
        out.append(F.when(said["currency"].isNotNull() & F.col("currency").isNull(), _error("invalid_currency", "currency", said["currency"])))
    return out


def _key(dataset: str, columns: list[str]) -> list[Column]:
    fold = ("user", "feature") if dataset == "usage" else KEYS[dataset]
    own = [F.col("source")] if "source" in columns else []
    return own + [F.lower(F.col(c).cast("string")) if c in fold else F.col(c) for c in KEYS[dataset] if c in columns]


def denied_word(x: Column) -> Column:
    """A licence manager's status word as denied or not; words that say neither are null."""
    word = F.lower(F.trim(x))
    return F.when(word.isin("denied", "deny", "denial", "fail", "failed", "reject", "rejected"), True).when(word.isin("granted", "ok", "success", "issued", "checkout", "checked_out"), False)


def checked(raw: DataFrame, dataset: str, day_first: bool = False, denied: Reader | None = None) -> DataFrame:
    """Typed rows with ``errors``, of which repeats of an accepted row are one.

    Rejected rows are no repeats of each other; they are told apart by their place, so that they do not meet in one task.
    """
    rows = typed(raw, dataset, day_first, denied)
    clean = F.size("errors") == 0
    place = F.row_number().over(W.partitionBy(F.when(~clean, F.col("source_row")), *_key(dataset, rows.columns)).orderBy("source_row"))
    repeat = F.array(_error("duplicate_row", "", F.lit(None).cast("string")))
    return rows.withColumn("errors", F.when(clean & (place > 1), repeat).otherwise(F.col("errors")))


def accepted(rows: DataFrame) -> DataFrame:
    return rows.where(F.size("errors") == 0).drop("errors")


def rejections(rows: DataFrame) -> DataFrame:
    """One row for each failed rule of each rejected row."""
    return rows.select("source_row", F.explode("errors").alias("e")).select("source_row", "e.rule", F.nullif(F.col("e.field"), F.lit("")).alias("field"), "e.value")


def rejection_summary(rows: DataFrame, examples: int = 3) -> DataFrame:
    """By rule and field: how many, and the first few distinct values.

    Only the first few values of each task take part in the ranking, so that no task holds all values of a rule.
    """
    values = rejections(rows).withColumn("field", F.coalesce("field", F.lit(""))).groupBy("rule", "field", "value").agg(F.count("*").alias("n"))
    counts = values.groupBy("rule", "field").agg(F.sum("n").alias("rejections"))
    ranked = values.where("value IS NOT NULL").select("rule", "field", "value").withColumn("place", F.row_number().over(W.partitionBy("rule", "field").orderBy("value"))).where(F.col("place") <= examples)
    shown = ranked.groupBy("rule", "field").agg(F.array_join(F.array_sort(F.collect_list("value")), "|").alias("examples"))
    return counts.join(shown, ["rule", "field"], "left").select("rule", F.nullif(F.col("field"), F.lit("")).alias("field"), "rejections", F.coalesce("examples", F.lit("")).alias("examples"))


def field_quality(rows: DataFrame, dataset: str, detection: float = 0.0) -> DataFrame:
    """Coverage of each field among accepted rows, and the confidence in the whole: one aggregate, then unpivoted."""
    fields = [f for f in DATASETS[dataset] if f.name in rows.columns]
    clean = F.size("errors") == 0
    agg = rows.agg(F.count("*").alias("total"), F.count(F.when(clean, 1)).alias("ok"), *[F.count(F.when(clean, F.col(f.name))).alias(f.name) for f in fields])
    needed = [f.name for f in fields if f.required]
    cover = sum((ratio(F.col(n), F.col("ok")) for n in needed), F.lit(0.0)) / max(1, len(needed))
    score = half_up(detection * 0.3 + ratio(F.col("ok"), F.col("total")) * 100 * 0.4 + F.coalesce(cover, F.lit(0.0)) * 100 * 0.3, 1)
    cells = F.array(*[F.struct(F.lit(f.name).alias("field"), F.col(f.name).alias("present")) for f in fields])
    flat = agg.select("ok", score.alias("confidence"), F.explode(cells).alias("c"))
    return flat.select("c.field", "c.present", half_up(F.coalesce(ratio(F.col("c.present") * 100, F.col("ok")), F.lit(0.0)), 1).alias("coverage_pct"), "confidence")
