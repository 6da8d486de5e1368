"""What an estate can answer, and whether what is analysed is what is stored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Inputs that each capability needs, and the days of history that two of them need besides.
NEEDS = {
    "usageTrends": ("usage",),
    "dailyDemand": ("usage",),
    "percentileDemand": ("usage", "concurrency"),
    "capacityHeadroom": ("usage", "concurrency", "entitlements"),
    "utilization": ("usage", "concurrency", "entitlements"),
    "denialAnalysis": ("usage", "denials"),
    "financialOpportunity": ("usage", "entitlements", "cost"),
    "recommendedRenewalSpend": ("usage", "concurrency", "entitlements", "cost"),
    "renewalExposure": ("contractDates",),
    "reclaimOpportunity": ("usage", "people", "namedUser", "cost"),
    "organizationAllocation": ("usage", "people"),
}
HISTORY_DAYS, WITH_HISTORY = 14, ("percentileDemand", "recommendedRenewalSpend")


def capabilities(inputs: DataFrame) -> DataFrame:
    """``inputs``: one row with an array ``present`` and ``distinct_dates``; one row for each capability with what it lacks."""
    rows = F.array(*[F.struct(F.lit(k).alias("capability"), F.array(*map(F.lit, needs)).alias("needs"), F.lit(k in WITH_HISTORY).alias("history")) for k, needs in NEEDS.items()])
    flat = inputs.select("present", "distinct_dates", F.explode(rows).alias("r")).select("present", "distinct_dates", "r.*")
    missing = F.array_except("needs", "present")
    short = F.col("history") & (F.size(missing) == 0) & (F.col("distinct_dates") < HISTORY_DAYS)
    return flat.select("capability", ((F.size(missing) == 0) & ~short).alias("available"), F.when(short, F.lit(f"{HISTORY_DAYS} days of history")).otherwise(F.array_join(missing, " and ")).alias("requires"))


def integrity(accepted: DataFrame, stored: DataFrame, analysed: DataFrame) -> DataFrame:
    """``(dataset, rows)`` each: a dataset is intact if all three counts agree."""
    out = accepted.withColumnRenamed("rows", "accepted").join(stored.withColumnRenamed("rows", "stored"), "dataset", "full_outer").join(analysed.withColumnRenamed("rows", "analysed"), "dataset", "full_outer")
    zero = F.lit(0).cast("bigint")
    counts = {c: F.coalesce(c, zero) for c in ("accepted", "stored", "analysed")}
    out = out.withColumns(counts)
    return out.withColumn("intact", (F.col("accepted") == F.col("stored")) & (F.col("stored") == F.col("analysed")))


def evidence_key(imports: DataFrame, confirmations: DataFrame | None = None, version: int = 1) -> DataFrame:
    """One key for a state of the evidence: version, counts, the imports and the confirmations; equal keys mean equal results.

    The imports enter as a digest of sums of hashes, which no order changes; no task holds all their ids.
    ``confirmations``: one row (confirmations, latest).
    """
    ids = F.sum(F.xxhash64("import_id", "rows").cast("decimal(38,0)"))
    agg = imports.agg(F.sum("rows").alias("rows"), F.count("*").alias("imports"), F.coalesce(ids, F.lit(0)).cast("string").alias("ids"))
    parts = [F.lit(f"v{version}"), F.col("rows").cast("string"), F.col("imports").cast("string"), F.substring(F.sha2("ids", 256), 1, 16)]
    if confirmations is not None:
        agg = agg.join(F.broadcast(confirmations.limit(1)))
        parts += [F.col("confirmations").cast("string"), F.coalesce(F.col("latest").cast("string"), F.lit("none"))]
    key = F.concat_ws("|", *parts)
    return agg.select(key.alias("evidence_key"), F.substring(F.sha2(key, 256), 1, 12).alias("short_key"))


def fingerprint(imports: DataFrame) -> DataFrame:
    """``imports`` (import_id, content_hash, dataset, mapping: a map): the same file read in the same way has the same fingerprint."""
    pairs = F.array_sort(F.transform(F.map_entries("mapping"), lambda x: F.concat_ws("=", x["key"], x["value"])))
    return imports.select("import_id", F.sha2(F.concat_ws("|", "content_hash", "dataset", F.array_join(pairs, ",")), 256).alias("fingerprint"))
