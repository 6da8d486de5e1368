"""Registered queries of ingestion, identity and review: rows are written loosely out of the tables and read back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seatmetrics.functions import dates, numeric, text
from seatmetrics.operators import contracts, demand, identity, normalize, review
from seatmetrics.plans import assembly, commercial, portfolio, trust
from seatmetrics.sources import sinks, synthetic
from seatmetrics.sources.estate import Estate
from seatmetrics.sources.shared import settle, shared_dir
from seatmetrics.streaming import hourly

Query = Callable[[SparkSession, str], DataFrame]
_registered: dict[str, Query] = {}


def query(make: Callable[[Estate], DataFrame]) -> Callable[[Estate], DataFrame]:
    _registered[make.__name__] = lambda spark, sf_dir: make(Estate(spark, sf_dir))
    return make


def queries() -> dict[str, Query]:
    return dict(_registered)


def raw_usage(e: Estate) -> DataFrame:
    """The events as an export would write them, with some bad cells and some repeated rows."""
    i, ts = F.col("event_id"), F.col("ts")
    k = F.get_json_object("props", "$.k").cast("int")

    def every(n: int, bad: str, good: Column) -> Column:
        return F.when(i % n == 0, F.lit(bad)).otherwise(good)

    day = F.when(i % 3 == 0, F.date_format(ts, "yyyy-MM-dd")).when(i % 3 == 1, F.date_format(ts, "MM/dd/yyyy")).otherwise(F.date_format(ts, "yyyy-MM-dd HH:mm"))
    rows = e.table("events").select(
        i.alias("source_row"),
        every(97, "soon", day).alias("date"),
        every(73, "42", F.when(i % 2 == 0, F.date_format(ts, "HH:mm")).otherwise(F.hour(ts).cast("string"))).alias("hour"),
        every(89, " ", F.concat(F.when(i % 2 == 0, "Feature ").otherwise("feature-"), (k % 10).cast("string"))).alias("feature"),
        F.concat(F.lit(" User"), F.col("user_id").cast("string")).alias("user"),
        every(83, "-4", every(79, "many", F.concat(F.lit("1,"), F.lpad(k.cast("string"), 3, "0")))).alias("concurrent"),
        F.when(i % 5 == 0, "Yes").when(i % 5 == 1, "no").otherwise("perhaps").alias("denied"),
    )
    again = rows.where(F.col("source_row") % 50 == 0).withColumn("source_row", F.col("source_row") + 1_000_000_000_000)
    return rows.unionByName(again)


@query
def normalize_usage(e: Estate) -> DataFrame:
    return normalize.accepted(normalize.checked(raw_usage(e), "usage"))


@query
def rejections(e: Estate) -> DataFrame:
    return normalize.rejections(normalize.checked(raw_usage(e), "usage"))


@query
def rejection_summary(e: Estate) -> DataFrame:
    return normalize.rejection_summary(normalize.checked(raw_usage(e), "usage"))


@query
def field_quality(e: Estate) -> DataFrame:
    return normalize.field_quality(normalize.checked(raw_usage(e), "usage"), "usage", detection=80.0)


def commercial_lines(e: Estate) -> DataFrame:
    """Order lines as contract lines, with cells left out in turn."""
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    part = e.table("part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand")
    start = F.col("l_shipdate").cast("date")

    def unless(n: int, r: int, x: Column) -> Column:
        return F.when(key % n != r, x)

    return (
        e.table("lineitem")
        .join(part, "l_partkey")
        .select(
            key.alias("line_id"),
            F.when(key % 4 == 0, F.concat(F.lit("Suite "), "p_name")).when(key % 4 == 1, F.upper("p_name")).otherwise(F.col("p_name")).alias("feature"),
            unless(7, 0, F.concat(F.lit("SKU-"), F.substring("p_brand", 7, 9), F.lit("."), F.length("p_name").cast("string"))).alias("sku"),
            unless(5, 0, F.col("l_quantity")).alias("quantity"),
            unless(3, 0, F.col("l_quantity") * 3 + 1.25).alias("unit_price"),
            unless(2, 0, F.floor("l_extendedprice") * 1.0).alias("total_cost"),
            unless(4, 3, F.floor("l_extendedprice") * 0.5).alias("annual_cost"),
            F.when(key % 6 == 0, "EUR").when(key % 6 != 5, "USD").alias("currency"),
            start.alias("start_date"),
            F.date_add(start, (key % 9 * 100).cast("int")).alias("end_date"),
            F.date_add(start, (key % 9 * 100 + 30).cast("int")).alias("renewal_date"),
            F.concat(F.lit("C"), (key % 7).cast("string")).alias("contract_number"),
            F.lower("p_brand").alias("vendor"),
        )
    )


def _links(e: Estate) -> DataFrame:
    names = e.table("part").where("p_partkey % 3 <> 0").select(text.feature_key(F.col("p_name")).alias("feature_key")).where("feature_key NOT LIKE '%gear'")
    aliases = e.spark.createDataFrame([("suite red widget", "red_widget"), ("suite small ring", "no_such_feature")], "raw string, target string")
    return contracts.link_contracts(contracts.derive_cost(commercial_lines(e)), names, aliases)


@query
def derive_cost(e: Estate) -> DataFrame:
    return contracts.derive_cost(commercial_lines(e)).select("line_id", "unit_price", "unit_price_basis", "annual_cost", "annual_cost_basis", "multi_year")


@query
def link_contracts(e: Estate) -> DataFrame:
    return _links(e).select("line_id", "basis", "feature_key", "position_key")


@query
def merge_positions(e: Estate) -> DataFrame:
    return contracts.merge_positions(_links(e))


@query
def contract_review(e: Estate) -> DataFrame:
    return contracts.contract_review(_links(e))


@query
def feature_identity(e: Estate) -> DataFrame:
    return identity.feature_identities(commercial_lines(e).select("feature", "vendor"))


def _users(e: Estate) -> DataFrame:
    """Usernames out of the events; some carry a code, some differ from the directory."""
    u, i = F.col("user_id"), F.col("event_id")
    name = F.when(u % 7 == 3, F.concat(F.lit("USER"), u.cast("string"))).when(u % 7 == 5, F.concat(F.lit("svc_"), u.cast("string"))).when(u % 7 == 6, F.concat(F.lit("user"), (u + 3).cast("string"), F.lit("@example.com"))).otherwise(F.concat(F.lit(" user"), u.cast("string")))
    usage = e.table("events").select(name.alias("user"), F.when((u % 7 == 5) & (i % 4 == 0) & (u % 2 == 0), F.concat(F.lit("e"), F.lpad(u.cast("string"), 6, "0"))).alias("employee_code"), i.alias("source_row"))
    people = e.people().select(F.col("employee_id").alias("person_id"), F.when(F.col("employee_id") % 40 == 1, F.lit("user2")).otherwise(F.col("username")).alias("username"), "employee_code", "email")
    confirmed = e.spark.createDataFrame([("svc_5", "user9"), ("svc_19", "nobody")], "raw string, target string")
    return identity.resolve_users(usage, people, confirmed)


@query
def resolve_users(e: Estate) -> DataFrame:
    return _users(e)


@query
def unmatched_users(e: Estate) -> DataFrame:
    return identity.unmatched(_users(e)).select("key", "observations", "status")


@query
def people_without_usage(e: Estate) -> DataFrame:
    return identity.people_without_usage(e.people().select(F.col("employee_id").alias("person_id"), "username"), _users(e))


@query
def review_queue(e: Estate) -> DataFrame:
    """Distinct part names against the others: each name's five best by common words."""
    names = e.table("part").select(F.col("p_name").alias("name")).distinct()
    lines = names.select(F.concat(F.lit("l:"), "name").alias("line_id"), F.concat("name", F.lit(" license")).alias("name"), F.lit("Vendor 1").alias("vendor"))
    features = names.select(F.concat(F.lit("f:"), "name").alias("feature_id"), F.col("name").alias("feature_name"), F.concat(F.lit("vendor "), (F.length("name") % 3).cast("string")).alias("vendor_name"))
    return review.review_queue(lines, features)


@query
def user_review_queue(e: Estate) -> DataFrame:
    """Names that resemble usernames by their ends, against the whole directory."""
    users = e.table("customer").select(F.concat(F.lpad(F.col("c_custkey").cast("string"), 6, "0"), F.when(F.col("c_custkey") % 3 == 0, F.lit("@a")).otherwise(F.lit("@b"))).alias("key")).distinct()
    people = e.people().select("employee_id", F.concat(F.lit("u"), F.lpad(F.col("employee_id").cast("string"), 6, "0"), F.lit("@a")).alias("username"), F.concat(F.lpad((F.col("employee_id") + 3).cast("string"), 6, "0"), F.lit("@b"), F.lit("@example.com")).alias("email"))
    return review.user_review_queue(users, people)


@query
def related_features(e: Estate) -> DataFrame:
    keys = e.table("part").select(text.feature_key(F.col("p_name")).alias("feature_key")).distinct()
    return review.related_features(keys, keys)


@query
def capabilities(e: Estate) -> DataFrame:
    usage = e.usage().agg(F.countDistinct("date").alias("distinct_dates"), F.bool_or(F.col("concurrent").isNotNull()).alias("c"), F.bool_or("denied").alias("d"))
    have = F.array_compact(F.array(F.lit("usage"), F.when(F.col("c"), "concurrency"), F.when(F.col("d"), "denials"), F.lit("entitlements"), F.lit("people")))
    return trust.capabilities(usage.select(have.alias("present"), "distinct_dates"))


@query
def integrity(e: Estate) -> DataFrame:
    rows = normalize.checked(raw_usage(e), "usage")
    named = F.lit("usage").alias("dataset")
    ok = normalize.accepted(rows)
    accepted, stored = ok.agg(named, F.count("*").alias("rows")), rows.agg(named, F.count(F.when(F.size("errors") == 0, 1)).alias("rows"))
    analysed = ok.where("feature IS NOT NULL").agg(named, F.count("*").alias("rows"))
    return trust.integrity(accepted, stored, analysed)


@query
def evidence_key(e: Estate) -> DataFrame:
    imports = e.table("orders").groupBy(F.concat(F.lit("import-"), F.col("o_orderpriority")).alias("import_id")).agg(F.count("*").alias("rows"))
    return trust.evidence_key(imports).select(F.substring_index("evidence_key", "|", 3).alias("evidence_key"), (F.length("short_key") == 12).alias("short"))


@query
def fingerprint(e: Estate) -> DataFrame:
    rows = e.table("part").select(F.col("p_partkey").alias("import_id"), F.sha2("p_name", 256).alias("content_hash"), F.lit("usage").alias("dataset"), F.create_map(F.lit("user"), F.col("p_brand"), F.lit("date"), F.col("p_type")).alias("mapping"))
    return trust.fingerprint(rows)


@query
def export_csv(e: Estate) -> DataFrame:
    rows = e.table("part").select("p_partkey", F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("=SUM("), "p_name", F.lit(")"))).when(F.col("p_partkey") % 5 == 1, F.concat("p_name", F.lit(', "quoted"'))).otherwise(F.col("p_name")).alias("name"), F.col("p_size"))
    return rows.select("p_partkey", sinks.csv_line([F.col("name"), F.col("p_size")]).alias("line"))


@query
def coverage_lines(e: Estate) -> DataFrame:
    """Coverage of what ingestion accepted, by feature."""
    rows = normalize.accepted(normalize.checked(raw_usage(e), "usage")).withColumn("feature_id", text.feature_key(F.col("feature"))).withColumn("duration_hours", F.lit(None).cast("double"))
    return demand.coverage(rows)


@query
def date_helpers(e: Estate) -> DataFrame:
    day = F.col("d")
    rows = e.table("orders").select(F.col("o_orderdate").cast("date").alias("d")).distinct()
    return rows.select(
        day.alias("day"), dates.epoch_day(day).cast("bigint").alias("epoch_day"), dates.weekday(day).cast("bigint").alias("weekday"), dates.is_weekend(day).alias("weekend"), dates.day_text(day).alias("day_text"),
        dates.month_text(day).alias("month"), dates.days_idle(day, e.as_of).cast("bigint").alias("idle"), e.window("6m").holds(day).alias("in_window"),
    )


@query
def text_parsers(e: Estate) -> DataFrame:
    rows = e.table("part").select(
        F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("$1,"), F.lpad("p_size", 3, "0"), F.lit(".50"))).when(F.col("p_partkey") % 4 == 1, F.lit("n/a")).otherwise(F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(" "))).alias("num"),
        F.when(F.col("p_partkey") % 3 == 0, F.concat(F.col("p_size").cast("string"), F.lit("/"), (F.col("p_partkey") % 14).cast("string"), F.lit("/2024"))).otherwise(F.lit("2023-02-30")).alias("day"),
        F.element_at(F.array(*map(F.lit, ("USD 5", "€9", "$12", "", "gbp"))), (F.col("p_partkey") % 5 + 1).cast("int")).alias("cur"),
        F.element_at(F.array(*map(F.lit, ("Floating", "Named User", "node-locked", "Token pool", "site"))), (F.col("p_partkey") % 5 + 1).cast("int")).alias("model"),
        F.concat(F.initcap("p_name"), F.lit(" - "), "p_brand").alias("name"),
    )
    c = F.col
    return rows.select(
        "id", text.read_number(c("num")).alias("number"), text.read_date(c("day")).alias("month_first"), text.read_date(c("day"), True).alias("day_first"), text.read_currency(c("cur")).alias("currency"),
        text.currency_unreadable(c("cur")).alias("unreadable"), text.licence_model(c("model")).alias("licence_model"), text.feature_key(c("name")).alias("feature_key"), text.sku_key(c("name")).alias("sku_key"), text.slug(c("name")).alias("slug"),
        F.array_join(text.name_tokens(c("name")), " ").alias("tokens"),
    )


@query
def stats_scalars(e: Estate) -> DataFrame:
    x = F.col("l_quantity") * 1.1
    rows = e.table("lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"), F.count("*").alias("n"), F.max("l_linenumber").alias("m"), F.first(F.lit(0)).alias("zero"))
    x = F.col("q") * 1.1
    return rows.select(
        "l_orderkey", numeric.half_up(x, 1).alias("rounded"), numeric.half_up(-F.col("q") / 2).alias("half"), numeric.whole_up(x).alias("up"), numeric.ratio(F.col("q"), F.col("n") - 3).alias("ratio"), numeric.clamp(x, 20, 200).alias("clamped"),
        numeric.share(F.col("n"), F.col("q")).alias("share"), numeric.worst(F.when(F.col("n") > 4, "High"), F.when(F.col("m") > 5, "Critical"), F.lit("Moderate")).alias("worst"), text.money_text(F.when(F.col("n") > 2, F.col("q"))).alias("money"),
    )


@query
def licence_hours(e: Estate) -> DataFrame:
    """Each day's peak of the long history spread over the hours of a day."""
    return synthetic.licence_hours(e.daily(e.window("3m")).withColumnRenamed("date", "day"))


@query
def stream_hourly_concurrency(e: Estate) -> DataFrame:
    """The hourly maximum by a stream over the same files, run to their end."""
    schema = e.table("events").schema
    events = e.spark.readStream.schema(schema).parquet(f"{e.root}/events.parquet*")
    k = F.get_json_object("props", "$.k").cast("int")
    seen = events.select(F.concat(F.lit("f"), (k % 10).cast("string")).alias("feature_id"), F.col("ts").cast("timestamp").alias("observed_at"), F.when(F.col("event_type") != "view", F.floor("value").cast("int")).alias("concurrent"))
    at = shared_dir(e.spark, "hourly-stream")
    hourly.into_files(hourly.hourly_stream(seen, "60 days"), f"{at}/rows", f"{at}/state").awaitTermination()
    return e.spark.read.parquet(f"{at}/rows")


@query
def normalize_contracts(e: Estate) -> DataFrame:
    """Contract lines as an export would write them, and what is wrong with each."""
    return normalize.rejection_summary(normalize.checked(_raw_contracts(e), "contracts"))


@query
def accepted_contracts(e: Estate) -> DataFrame:
    rows = normalize.accepted(normalize.checked(_raw_contracts(e), "contracts"))
    return rows.select("source_row", "feature", "quantity", "unit_price", "total_cost", "currency", "start_date", "end_date")


def _raw_contracts(e: Estate) -> DataFrame:
    i = F.col("o_orderkey")
    start = F.col("o_orderdate").cast("date")
    return e.table("orders").select(
        i.alias("source_row"), F.concat(F.lit("Line "), i.cast("string")).alias("feature"), F.when(i % 3 != 0, F.lit("5")).alias("quantity"), F.when(i % 4 == 1, F.lit("$1,000.50")).alias("unit_price"), F.when(i % 4 == 2, F.lit("900")).alias("total_cost"),
        F.element_at(F.array(*map(F.lit, ("USD", "$", "€", "zz", " ", "GBP 5"))), (i % 6 + 1).cast("int")).alias("currency"), start.cast("string").alias("start_date"), F.when(i % 5 < 3, F.date_add(start, ((i % 7 - 1) * 100).cast("int")).cast("string")).alias("end_date"),
    )


@query
def assembled_features(e: Estate) -> DataFrame:
    """Features from entitlements and contract positions by the order of precedence."""
    n = F.col("p_partkey")
    entitlements = e.table("part").where("p_partkey % 3 <> 0").select(text.feature_key(F.col("p_name")).alias("feature_id"), F.col("p_size").alias("quantity"), F.when(n % 4 == 0, "node_locked").when(n % 4 == 1, "unknown").otherwise("named_user").alias("license_model"), F.date_add(F.lit(e.as_of), (n % 50).cast("int")).alias("expires_on"), n.alias("source_row"))
    positions = e.table("part").where("p_name LIKE '%ring' OR p_name LIKE 'blue%'").groupBy(text.feature_key(F.col("p_name")).alias("position_key")).agg(F.sum("p_size").alias("quantity"), F.max("p_retailprice").alias("unit_price"), F.when(F.min("p_partkey") % 2 == 0, "token").alias("license_model"), F.date_add(F.lit(e.as_of), (F.min("p_partkey") % 90).cast("int")).alias("renewal_date"))
    keys = e.table("part").select(text.feature_key(F.col("p_name")).alias("feature_key")).distinct()
    return assembly.assemble(keys, entitlements, positions)


@query
def alias_map(e: Estate) -> DataFrame:
    i = F.col("c_custkey")
    entries = e.table("customer").select(F.when(i % 2 == 0, "feature").otherwise("user").alias("kind"), F.concat(F.lit(" Raw "), (i % 20).cast("string")).alias("raw_value"), F.concat(F.lit("Mech-Ent "), i.cast("string")).alias("target"), F.when(i % 7 == 0, "rejected").otherwise("confirmed").alias("decision"), i.alias("decided_at"))
    return assembly.alias_map(entries, "feature")


@query
def evidence_record(e: Estate) -> DataFrame:
    return assembly.evidence_record(portfolio.portfolio(e))


@query
def page_figures(e: Estate) -> DataFrame:
    rows = settle(portfolio.portfolio(e), "portfolio")
    return assembly.page_figures(rows, commercial.renewals(rows), e.as_of)


@query
def agreement_drivers(e: Estate) -> DataFrame:
    return assembly.agreement_drivers(e.features(), e.activity(), e.people(), "contract:2", "region")


@query
def user_export(e: Estate) -> DataFrame:
    return assembly.user_export(e.activity(), e.people(), e.features())


@query
def people_wording(e: Estate) -> DataFrame:
    i = F.col("c_custkey")
    kinds, states = ("Contractor", "FTE", "Vendor staff", "contingent worker", "Employee"), ("Active", "Terminated", "No", "on leave", "former staff", "0")
    rows = e.table("customer").select(i.alias("id"), F.element_at(F.array(*map(F.lit, kinds)), (i % 5 + 1).cast("int")).alias("kind"), F.element_at(F.array(*map(F.lit, states)), (i % 6 + 1).cast("int")).alias("state"), F.when(i % 3 == 0, F.concat(F.lit("SVC_"), i.cast("string"))).when(i % 3 == 1, F.concat(F.lit("ann_"), i.cast("string"))).otherwise(F.lit("bob_old")).alias("user"))
    return rows.select("id", text.employee_type(F.col("kind")).alias("employee_type"), text.employment_status(F.col("state")).alias("status"), text.is_service_account(F.col("user")).alias("service"), text.without_suffix(F.col("user")).alias("bare"))


@query
def last_observations(e: Estate) -> DataFrame:
    """The last 30 observations of each feature, whatever their dates: the basis of a scenario."""
    place = F.row_number().over(W.partitionBy("feature_id").orderBy(F.col("date").desc()))
    rows = e.daily().withColumn("place", place).where("place <= 30")
    return rows.groupBy("feature_id").agg(F.count("*").alias("observations"), F.round(F.percentile("peak", F.lit(0.95)), 6).alias("p95"), F.min("date").alias("first_date"))
