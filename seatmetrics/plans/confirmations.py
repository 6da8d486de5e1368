"""Decisions about names as a log of events: recorded, changed and undone; what holds is the latest event of each name.

The log is only ever added to. Its state is one aggregate with partial maxima, so a name with very many events is no
burden to one task, and equal times have one outcome on every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seatmetrics.functions.text import feature_key, user_key

#: Columns of an event. ``action`` is record or undo; ``seq`` orders events of one time.
EVENTS = "kind string, raw_value string, target string, decision string, action string, decided_at timestamp_ntz, seq bigint, decided_by string"


def raw_key(x: Column) -> Column:
    return F.lower(F.trim(x))


def target_key(kind: Column, target: Column) -> Column:
    """A target as the keys are that it has to meet; a display name of a feature would meet none."""
    return F.when(kind == "feature", feature_key(target)).otherwise(user_key(target))


def state(events: DataFrame) -> DataFrame:
    """(kind, raw, target, decision, decided_at, decided_by, changes) of every name whose latest event is no undo.

    The latest has the greatest time, then the greatest ``seq``; of events that agree in both, the undo and then the
    greatest target counts. ``changes`` counts the events of a name. Events without kind, name or time take no part.
    """
    usable = events.where("kind IS NOT NULL AND raw_value IS NOT NULL AND decided_at IS NOT NULL")
    order = F.struct(F.col("decided_at").alias("at"), F.coalesce("seq", F.lit(-1)).alias("seq"), (F.col("action") == "undo").alias("undone"), F.coalesce(target_key(F.col("kind"), F.col("target")), F.lit("")).alias("target"), F.coalesce("decision", F.lit("")).alias("decision"), F.coalesce("decided_by", F.lit("")).alias("by"))
    latest = usable.groupBy("kind", raw_key(F.col("raw_value")).alias("raw")).agg(F.max(order).alias("x"), F.count("*").alias("changes"))
    return latest.where("NOT x.undone").select("kind", "raw", "x.target", "x.decision", F.col("x.at").alias("decided_at"), F.nullif(F.col("x.by"), F.lit("")).alias("decided_by"), "changes")


def aliases(events: DataFrame, kind: str) -> DataFrame:
    """(raw, target) that are confirmed now."""
    return state(events).where((F.col("kind") == kind) & (F.col("decision") == "confirmed")).select("raw", "target")


def undone(events: DataFrame) -> DataFrame:
    """(kind, raw, undone_at): names that had a decision and have none now."""
    had = events.where("raw_value IS NOT NULL AND kind IS NOT NULL").groupBy("kind", raw_key(F.col("raw_value")).alias("raw")).agg(F.max(F.when(F.col("action") == "undo", F.col("decided_at"))).alias("undone_at"), F.count(F.when(F.col("action") == "record", 1)).alias("records"))
    return had.where("records > 0 AND undone_at IS NOT NULL").join(state(events).select("kind", "raw"), ["kind", "raw"], "left_anti").select("kind", "raw", "undone_at")


class ConfirmationLog:
    """Events in files under ``root``; each call adds some and changes none."""

    def __init__(self, spark, root: str):
        self.spark, self.root = spark, f"{root.rstrip('/')}/confirmations"

    def add(self, events: DataFrame) -> None:
        """Add events: columns of ``EVENTS``, of which missing ones are null."""
        names = [f.split()[0] for f in EVENTS.split(", ")]
        kinds = dict(f.split() for f in EVENTS.split(", "))
        events.select(*[(F.col(n) if n in events.columns else F.lit(None)).cast(kinds[n]).alias(n) for n in names]).write.mode("append").parquet(self.root)

    def events(self) -> DataFrame:
        return self.spark.read.schema(EVENTS).parquet(self.root)

    def state(self) -> DataFrame:
        return state(self.events())
