"""What an estate's four datasets hold together, what that makes possible, and what the next import would unlock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seatmetrics.plans.trust import HISTORY_DAYS, NEEDS, WITH_HISTORY

# What each capability and each kind of input is called.
CAPABILITY_NAMES = {
    "usageTrends": "Usage trends",
    "dailyDemand": "Daily demand",
    "percentileDemand": "P90 / P95 / P99 demand",
    "capacityHeadroom": "Capacity headroom",
    "utilization": "Utilization",
    "denialAnalysis": "Unmet demand",
    "financialOpportunity": "Financial opportunity",
    "recommendedRenewalSpend": "Recommended renewal spend",
    "renewalExposure": "Renewal exposure",
    "reclaimOpportunity": "Reclaim opportunity",
    "organizationAllocation": "Organization allocation",
}
INPUT_NAMES = {
    "usage": "usage data",
    "concurrency": "concurrent demand",
    "entitlements": "entitlements",
    "denials": "denial data",
    "cost": "contract or cost data",
    "people": "employee context",
    "contractDates": "contract renewal or end dates",
    "namedUser": "named-user licensing",
}
CORE = ("usageTrends", "dailyDemand", "percentileDemand")
_DATASETS = ("usage", "entitlements", "people", "contracts")


def _tagged(df: DataFrame, dataset: str) -> DataFrame:
    """Rows of one dataset as keys that are counted and facts that are summed; what it does not have is null."""
    def has(name: str) -> Column:
        return F.col(name) if name in df.columns else F.lit(None)

    def some(*names: str) -> Column:
        out = F.lit(False)
        for n in names:
            out = out | has(n).isNotNull()
        return out

    usage, contracts = dataset == "usage", dataset == "contracts"
    keys = [
        ("dataset", F.lit(dataset)),
        ("feature", F.lower(has("feature")) if usage or contracts else F.lit(None)),
        ("user", F.lower(has("user")) if dataset in ("usage", "people") else F.lit(None)),
        ("source", has("source")),
        ("currency", has("currency") if contracts else F.lit(None)),
    ]
    no = F.lit(False)
    return df.select(
        F.filter(F.array(*[F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value")) for kind, value in keys]), lambda x: x["value"].isNotNull()).alias("keys"),
        (has("date").cast("date") if usage else F.lit(None).cast("date")).alias("date"),
        (some("hour", "observed_at") if usage else no).alias("timed"),
        (some("concurrent", "peak") if usage else no).alias("concurrency"),
        (some("denied", "denial_count") if usage else no).alias("denials"),
        (some("unit_price", "annual_cost") if contracts else no).alias("priced"),
        (some("renewal_date", "end_date") if contracts else no).alias("dated"),
    )


def coverage(usage: DataFrame, entitlements: DataFrame, people: DataFrame, contracts: DataFrame) -> DataFrame:
    """One row: records of each dataset, exact distinct features, users, currencies and sources across them, first and last date.

    Each table is read once. Rows go out under each of their keys and are aggregated by (kind of key, key) with partial
    aggregates; the second step counts the keys of a kind. Features and users fold their case, as in their own tables.
    """
    every: DataFrame | None = None
    for name, df in zip(_DATASETS, (usage, entitlements, people, contracts)):
        one = _tagged(df, name)
        every = one if every is None else every.unionByName(one)
    by_key = every.select(F.explode("keys").alias("k"), "date", "timed", "concurrency", "denials", "priced", "dated").groupBy("k.kind", "k.value").agg(
        F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"), F.bool_or("timed").alias("timed"), F.bool_or("concurrency").alias("concurrency"),
        F.bool_or("denials").alias("denials"), F.count(F.when(F.col("priced"), 1)).alias("priced"), F.count(F.when(F.col("dated"), 1)).alias("dated"),
    )
    of_table = F.col("kind") == "dataset"
    zero = F.lit(0).cast("bigint")

    def names(kind: str) -> Column:  # currencies and sources come from short fixed lists
        return F.array_join(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("value")))), "|")

    def any_of(name: str) -> Column:
        return F.coalesce(F.bool_or(F.when(of_table, F.col(name))), F.lit(False)).alias(f"has_{name}")

    row = by_key.agg(
        *[F.coalesce(F.sum(F.when(of_table & (F.col("value") == d), F.col("n"))), zero).alias(f"{d}_records") for d in _DATASETS],
        *[F.coalesce(F.sum(F.when(of_table, F.col(c))), zero).alias(f"{c}_contracts") for c in ("priced", "dated")],
        *[F.count(F.when(F.col("kind") == k, 1)).alias(f"distinct_{k}s") for k in ("feature", "user")],
        names("currency").alias("currencies"), names("source").alias("sources"), F.min(F.when(of_table, F.col("first"))).alias("first_date"), F.max(F.when(of_table, F.col("last"))).alias("last_date"),
        any_of("timed"), any_of("concurrency"), any_of("denials"),
    )
    return row.withColumn("history_days", F.coalesce((F.datediff("last_date", "first_date") + 1).cast("bigint"), zero))


def inputs(covered: DataFrame, facts: DataFrame) -> DataFrame:
    """One row with the array ``present`` and ``distinct_dates``, as ``trust.capabilities`` takes it, beside the coverage.

    ``facts``: one row (has_cost, resolved_people, named_user, distinct_dates).
    """
    rules = (
        ("usage", F.col("usage_records") > 0),
        ("concurrency", F.col("has_concurrency")),
        ("entitlements", F.col("entitlements_records") > 0),
        ("denials", F.col("has_denials")),
        ("cost", F.col("has_cost") | (F.col("priced_contracts") > 0)),
        ("people", F.col("resolved_people") > 0),
        ("contractDates", F.col("dated_contracts") > 0),
        ("namedUser", F.col("named_user")),
    )
    return covered.join(F.broadcast(facts.limit(1))).withColumn("present", F.array_compact(F.array(*[F.when(holds, name) for name, holds in rules])))


def _matrix(given: DataFrame) -> DataFrame:
    """A row for each capability with its place in the list, its needs, and which of them are missing."""
    rows = F.array(*[F.struct(F.lit(k).alias("place"), F.lit(name).alias("capability"), F.array(*map(F.lit, needs)).alias("needs"), F.lit(name in WITH_HISTORY).alias("history")) for k, (name, needs) in enumerate(NEEDS.items())])
    return given.select("present", "distinct_dates", F.explode(rows).alias("r")).select("present", "distinct_dates", "r.*").withColumn("missing", F.array_except("needs", "present"))


def _named(names: dict[str, str]) -> Column:
    return F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.lit(v))])


def suggestions(given: DataFrame) -> DataFrame:
    """(place, capability, needs): what to add for each capability that lacks an input."""
    labels = _named(INPUT_NAMES)
    text = F.concat(F.lit("Add "), F.array_join(F.transform("missing", lambda x: labels[x]), " and "))
    return _matrix(given).where(F.size("missing") > 0).select("place", _named(CAPABILITY_NAMES)[F.col("capability")].alias("capability"), text.alias("needs"))


def unlocks(given: DataFrame) -> DataFrame:
    """(input, unlocks, helps, capabilities, rank): for each missing input, how many capabilities it alone makes available, and how many lack it besides others.

    ``capabilities`` are those that it unlocks, in their order; what unlocks most comes first, then what helps most, then by name.
    """
    rows = _matrix(given)
    enough = ~F.col("history") | (F.col("distinct_dates") >= HISTORY_DAYS)
    lacking = rows.select("place", "capability", (F.size("missing") == 1).alias("alone"), enough.alias("enough"), F.explode("missing").alias("input"))
    opened = F.col("alone") & F.col("enough")
    by_input = lacking.groupBy("input").agg(
        F.count(F.when(opened, 1)).alias("unlocks"), F.count(F.when(~opened, 1)).alias("helps"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(opened, F.struct("place", "capability")))), lambda x: x["capability"]), "|").alias("capabilities"),
    )
    # A row for each kind of input, eight at most: their ranks come from arrays, no window over one partition.
    order = F.array_sort(F.collect_list(F.struct((-F.col("unlocks")).alias("a"), (-F.col("helps")).alias("b"), F.col("input").alias("c"), "unlocks", "helps", "capabilities")))
    return by_input.agg(order.alias("o")).select(F.posexplode("o").alias("k", "x")).select(F.col("x.c").alias("input"), "x.unlocks", "x.helps", "x.capabilities", (F.col("k") + 1).alias("rank"))


def quality_band(given: DataFrame) -> DataFrame:
    """One row (band, met): High if all core capabilities are available, Low if none is."""
    enough = ~F.col("history") | (F.col("distinct_dates") >= HISTORY_DAYS)
    met = F.count(F.when(F.col("capability").isin(*CORE) & (F.size("missing") == 0) & enough, 1))
    return _matrix(given).agg(met.alias("met")).select(F.when(F.col("met") == len(CORE), "High").when(F.col("met") > 0, "Medium").otherwise("Low").alias("band"), "met")


def lines(given: DataFrame) -> DataFrame:
    """(place, label, state, detail) for each kind of evidence; what a source did not supply is never shown as zero."""
    c = F.col
    many = lambda x: F.format_number(x, 0)
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    has, contracts = c("usage_records") > 0, c("contracts_records") > 0
    cost = c("has_cost") | (c("priced_contracts") > 0)
    currencies = F.filter(F.split("currencies", "\\|"), lambda x: x != "")

    def part(n: Column, of: Column) -> Column:
        return F.when(of > n, "partial").otherwise("complete")

    # The wording of the lines.
    rows = (
        ("Usage", F.when(has, "complete").otherwise("missing"), F.when(has, text(many(c("usage_records")), " records")).otherwise("No usage imported")),
        ("Concurrent demand", F.when(c("has_concurrency"), "complete").otherwise("not_supplied"), F.when(c("has_concurrency"), "Available").otherwise("Not supplied by the source")),
        ("Entitlements", F.when(c("entitlements_records") > 0, "complete").otherwise("missing"), F.when(c("entitlements_records") > 0, text(many(c("entitlements_records")), " records")).otherwise("Missing")),
        (
            "People",
            F.when(c("people_records") == 0, "missing").when((c("resolved_people") == 0) | (c("resolved_people") < c("distinct_users")), "partial").otherwise("complete"),
            F.when(c("people_records") == 0, "Missing").otherwise(text(many(c("resolved_people")), " of ", many(c("distinct_users")), " usernames resolved")),
        ),
        ("Denials", F.when(c("has_denials"), "complete").otherwise("not_supplied"), F.when(c("has_denials"), "Available").otherwise("Denial data not supplied")),
        (
            "Contracts",
            F.when(contracts, "complete").when(c("entitlements_records") > 0, "partial").otherwise("missing"),
            F.when(contracts, text(many(c("contracts_records")), " commercial lines")).when(c("entitlements_records") > 0, "Quantities only, no commercial terms").otherwise("Missing"),
        ),
        (
            "Renewal dates",
            F.when(c("dated_contracts") > 0, part(c("dated_contracts"), c("contracts_records"))).otherwise("missing"),
            F.when(c("dated_contracts") > 0, text(many(c("dated_contracts")), " of ", many(c("contracts_records")), " lines dated")).otherwise("Renewal date not supplied"),
        ),
        (
            "Cost",
            F.when(cost, part(c("priced_contracts"), c("contracts_records"))).otherwise("missing"),
            F.when(cost & contracts, text(many(c("priced_contracts")), " of ", many(c("contracts_records")), " lines priced")).when(cost, "Available").otherwise("Cost data not supplied"),
        ),
        (
            "Currency",
            F.when(F.size(currencies) == 1, "complete").when(F.size(currencies) > 1, "partial").otherwise("not_supplied"),
            F.when(F.size(currencies) == 1, currencies[0]).when(F.size(currencies) > 1, text("Mixed: ", F.array_join(currencies, ", "), " — amounts are not summed across currencies")).otherwise("Not stated, amounts reported as supplied"),
        ),
    )
    cells = F.array(*[F.struct(F.lit(label).alias("label"), state.alias("state"), detail.alias("detail")) for label, state, detail in rows])
    return given.select(F.posexplode(cells).alias("place", "x")).select("place", "x.*")
