"""Why a row says what it says: derivation, assumptions, observations, reasons, what would help, and what was not assumed.

Each clause holds under a condition and is a typed fact: a label, a number with its unit or a text, and a note. Clauses
stay facts, in order, until ``rendered`` words them in one place, so that nothing that is missing reads as zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seatmetrics.functions.dates import Window, day_text
from seatmetrics.functions.numeric import half_up
from seatmetrics.functions.text import percent_text
from seatmetrics.operators.confidence import Context, deductions
from seatmetrics.operators.demand import guarded_trend
from seatmetrics.operators.sizing import Options, methodology

SECTIONS = ("derivation", "assumptions", "observations", "why", "improve", "not_assumed")
#: Units of a fact's number and how they are written.
COUNT, FACTOR, MONEY, SHARE, TEXT = "count", "factor", "money", "share", "text"
_FACT = "struct<label: string, unit: string, number: double, text: string, note: string>"


def fact(when: Column, label: str, unit: str, value: Column, note: Column | str | None = None) -> Column:
    """A clause that is there if ``when`` holds and its value is known."""
    number = value.cast("double") if unit != TEXT else F.lit(None).cast("double")
    text = value.cast("string") if unit == TEXT else F.lit(None).cast("string")
    said = note if isinstance(note, Column) else F.lit(note).cast("string")
    return F.when(F.coalesce(when, F.lit(False)) & value.isNotNull(), F.struct(F.lit(label).alias("label"), F.lit(unit).alias("unit"), number.alias("number"), text.alias("text"), said.alias("note")))


def _signed(x: float) -> str:
    return f"{x:+.1f}%"


def clauses(rows: DataFrame, window: Window, options: Options, context: Context) -> DataFrame:
    """``rows`` of the portfolio as feature_id and one array of facts for each section."""
    c, always = F.col, F.lit(True)
    sized = c("sized") & (c("license_model") == "concurrent") & c("p95").isNotNull()
    priced, delta = c("unit_price").isNotNull(), c("recommended") - c("entitled")
    seats, denied = c("assigned").isNotNull(), c("total_denials") > 0
    missing = F.lit(window.days) - c("observed_days")
    gap = missing > 0
    trend = guarded_trend(c("observed_days"), c("trend_pct"))
    difference = F.when(delta == 0, "as many as are needed").when(delta < 0, F.concat(F.format_number(-delta, 0), F.lit(" more than are needed"))).otherwise(F.concat(F.format_number(delta, 0), F.lit(" fewer than are needed")))
    by_label = {name: points for name, points in deductions(c("observed_days"), c("unit_price"), context)}
    sections = {
        "derivation": [
            fact(sized, f"P{options.percentile * 100:g} daily peak", COUNT, c("p95")),
            fact(sized, "Growth factor", FACTOR, F.lit(options.growth), "no growth" if options.growth == 1 else f"{_signed((options.growth - 1) * 100)} of demand"),
            fact(sized, "Safety factor", FACTOR, F.lit(options.safety), f"{_signed((options.safety - 1) * 100)} on top"),
            fact(c("sized"), "Recommended quantity", COUNT, c("recommended")),
            fact(c("sized"), "Current entitlement", COUNT, c("entitled"), difference),
            fact(priced, "Unit price", MONEY, c("unit_price")),
            fact(priced, "Current annual cost", MONEY, c("current_cost")),
            fact(priced & c("sized"), "Recommended annual cost", MONEY, c("recommended_cost")),
            fact(c("opportunity") > 0, "Annual opportunity", MONEY, c("opportunity"), F.concat(percent_text(c("savings_pct")), F.lit(" of what it costs"))),
            fact(c("incremental") > 0, "Incremental annual spend", MONEY, c("incremental")),
            fact(~priced, "Financial impact", TEXT, F.lit("Not available"), "there is no unit price"),
        ],
        "assumptions": [
            fact(sized, "Percentile", TEXT, F.lit(f"P{options.percentile * 100:g}")),
            fact(c("sized"), "Observation period", TEXT, F.lit(options.period)),
            fact(c("sized"), "Growth", TEXT, F.lit(_signed((options.growth - 1) * 100))),
            fact(c("sized"), "Safety buffer", TEXT, F.lit(_signed((options.safety - 1) * 100))),
            fact(sized, "Method", TEXT, F.lit(methodology(options))),
        ],
        "observations": [
            fact(c("usage_evidence") == "observed", "Observed days", COUNT, c("observed_days"), F.concat_ws(" - ", day_text(F.lit(window.start)), day_text(F.lit(window.end)))),
            fact(sized, "Maximum daily peak", COUNT, c("max_peak")),
            fact(sized, "Utilization at P95", SHARE, c("utilization_pct")),
            fact(sized, "Saturation days", COUNT, c("saturation_days")),
            fact(sized & trend.isNotNull(), "Demand trend", SHARE, trend, "a year"),
            fact(sized & trend.isNull(), "Demand trend", TEXT, F.lit("Insufficient history")),
            fact(sized & gap, "Missing days", COUNT, missing),
            fact(seats, "Assigned seats", COUNT, c("assigned")),
            fact(seats, "Active users", COUNT, c("active_users")),
            fact(denied, "Denials", COUNT, c("total_denials"), c("denial_risk")),
        ],
        "why": [fact(points > 0, name, COUNT, points, "points less") for name, points in by_label.items()],
        "improve": [
            fact(gap, "Usage", COUNT, missing, "days without usage to import"),
            fact(~priced, "Prices", TEXT, F.lit("A contract or price list")),
            fact(F.lit(not context.has_denials), "Denials", TEXT, F.lit("Records of refused requests")),
            fact(F.lit(context.employee_rate is not None and context.employee_rate < 0.95), "People", SHARE, F.lit(half_percent(1 - (context.employee_rate or 1))), "of usage belongs to nobody known"),
        ],
        "not_assumed": [
            fact(gap, "Days without usage", COUNT, missing, "are not taken as days without demand"),
            fact(missing <= 0, "Window", TEXT, F.lit("complete"), "nothing was inferred for other days"),
            fact(~priced, "Price", TEXT, F.lit("none"), "no list price stands in for it"),
            fact(F.lit(not context.has_denials), "Refused requests", TEXT, F.lit("unknown"), "observed peaks are a floor of demand"),
            fact(always, "Figures", TEXT, F.lit("as supplied"), "none is a benchmark or an estimate"),
        ],
    }
    return rows.select("feature_id", *[F.array_compact(F.array(*facts)).cast(f"array<{_FACT}>").alias(name) for name, facts in sections.items()])


def half_percent(share: float) -> float:
    return int(share * 100 + 0.5)


def rendered(facts: DataFrame) -> DataFrame:
    """(feature_id, section, place, label, value, note): every clause in words, in order."""
    unit, number = F.col("f.unit"), F.col("f.number")
    value = F.when(unit == TEXT, F.col("f.text")).when(unit == FACTOR, F.concat(F.lit("x "), F.format_number(number, 2))).when(unit == MONEY, F.concat(F.lit("$"), F.format_number(number, 2))).when(unit == SHARE, percent_text(number)).otherwise(F.format_number(half_up(number), 0))
    named = F.array(*[F.struct(F.lit(s).alias("section"), F.col(s).alias("facts")) for s in SECTIONS])
    flat = facts.select("feature_id", F.explode(named).alias("s")).select("feature_id", "s.section", F.posexplode("s.facts").alias("place", "f"))
    return flat.select("feature_id", "section", "place", "f.label", value.alias("value"), "f.note")
