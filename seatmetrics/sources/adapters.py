"""What each licence manager's exports can say, and its own words for it; rows of several of them go through one plan.

The source is a column, so that files of different licence managers, each mapped by its own names, are checked together.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seatmetrics.functions.numeric import half_up, ratio
from seatmetrics.functions.text import licence_model
from seatmetrics.operators.normalize import DATASETS
from seatmetrics.sources import mapping


@dataclass(frozen=True)
class Adapter:
    """What a source records: its resolution, and which kinds of facts its exports hold."""

    name: str
    resolution: str
    checkouts: bool = True
    denials: bool = True
    tokens: bool = True
    concurrency: bool = True

    @property
    def unsupported(self) -> tuple[str, ...]:
        """Fields that no export of this source can fill."""
        groups = ((self.checkouts, ("checkout_at", "checkin_at")), (self.denials, ("denied", "denial_count")), (self.tokens, ("tokens",)), (self.concurrency, ("concurrent", "peak")))
        return tuple(f for has, fields in groups if not has for f in fields)


# What the known sources record.
ADAPTERS = {
    "flexnet": Adapter("FlexNet / FLEXlm", "event"),
    "rlm": Adapter("Reprise License Manager (RLM)", "event", tokens=False),
    "dsls": Adapter("Dassault Systèmes DSLS", "event"),
    "sentinel": Adapter("Sentinel RMS", "interval", checkouts=False, tokens=False),
    "generic": Adapter("Generic tabular export", "unknown"),
}
# Words of a status column that mean refused and granted, by source.
REFUSED = {
    "flexnet": ("denied", "deny", "denial", "fail", "failed", "reject", "rejected"),
    "rlm": ("denied", "deny", "fail", "failed", "rejected"),
    "sentinel": ("denied", "denial", "rejected", "refused", "fail", "failed"),
}
GRANTED = {
    "flexnet": ("granted", "ok", "success", "issued", "checkout", "checked_out"),
    "rlm": ("granted", "ok", "success", "checkout"),
    "sentinel": ("granted", "ok", "success", "issued", "allowed"),
}
# Parts of a licence model's name in exports of one source, the first that fits.
MODELS = {"dsls": (("token", "token"), ("nodelock", "node_locked"), ("node_lock", "node_locked"), ("node locked", "node_locked"), ("named", "named_user"), ("concurrent", "concurrent"), ("floating", "concurrent"), ("network", "concurrent"))}


def denied_reader(source: Column) -> Callable[[Column], Column]:
    """A reader of status cells by their row's source: words of other sources say nothing."""
    rules = {(s, w): value for value, words in ((True, REFUSED), (False, GRANTED)) for s, own in words.items() for w in own}
    table = F.create_map(*[x for (s, w), value in rules.items() for x in (F.lit(f"{s}|{w}"), F.lit(value))])
    return lambda text: F.try_element_at(table, F.concat_ws("|", source, F.lower(F.trim(text))))


def read_licence_model(source: Column, text: Column) -> Column:
    """The licence model by the source's own wording, else by the common one."""
    low, own = F.lower(F.trim(text)), F.lit(None).cast("string")
    for name, parts in MODELS.items():
        found = F.coalesce(*[F.when(low.contains(part), model) for part, model in parts])
        own = F.when(source == name, found).otherwise(own)
    return F.coalesce(own, licence_model(text))


def together(files: dict[str, DataFrame], dataset: str, day_first: bool = False) -> tuple[DataFrame, dict[str, tuple[str, ...]]]:
    """Files by source, each under its own names, as one table of canonical texts with ``source``, and the fields of each; columns that one lacks are null."""
    out: DataFrame | None = None
    fields = {}
    for source, raw in files.items():
        mapped, _ = mapping.map_columns(raw, dataset, source=source, day_first=day_first)
        fields[source] = tuple(m.field for m in mapped)
        named = mapping.apply(raw, mapped).withColumn("source", F.lit(source))
        out = named if out is None else out.unionByName(named, allowMissingColumns=True)
    if out is None:
        raise ValueError("no files")
    return out, fields


def quality_report(rows: DataFrame, dataset: str, mapped: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """By source and field of the dataset: accepted rows that have it, their share, and why there is none.

    ``rows`` as ``checked`` gives them, with ``source``. One aggregate counts all fields of all sources. The reason is
    ``not carried`` for fields that the source cannot fill, ``not mapped`` without a column, ``empty`` for one without values.
    ``mapped`` has the fields of each source; without it those that ``rows`` has count for all.
    """
    fields = [f.name for f in DATASETS[dataset]]
    have = [f for f in fields if f in rows.columns]
    counted = rows.where(F.size("errors") == 0).groupBy("source").agg(F.count("*").alias("rows"), *[F.count(f).alias(f"n_{f}") for f in have])
    lacking = F.create_map(*[x for s, a in ADAPTERS.items() for x in (F.lit(s), F.array(*map(F.lit, a.unsupported)).cast("array<string>"))])
    from_source = {f: F.col("source").isin(*[s for s, own in mapped.items() if f in own]) if mapped else F.lit(f in have) for f in fields}
    cells = F.array(*[F.struct(F.lit(f).alias("field"), (F.col(f"n_{f}") if f in have else F.lit(0)).cast("bigint").alias("present"), from_source[f].alias("mapped")) for f in fields])
    flat = counted.select("source", "rows", lacking[F.col("source")].alias("lacking"), F.explode(cells).alias("c")).select("source", "rows", "lacking", "c.*")
    carried = ~F.coalesce(F.array_contains("lacking", F.col("field")), F.lit(False))
    reason = F.when(~carried, "not carried").when(~F.col("mapped"), "not mapped").when((F.col("rows") > 0) & (F.col("present") == 0), "empty").otherwise("")
    return flat.select("source", "field", "present", half_up(F.coalesce(ratio(F.col("present") * 100, F.col("rows")), F.lit(0.0))).alias("coverage_pct"), carried.alias("carried"), reason.alias("reason"))
