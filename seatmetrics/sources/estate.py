"""A licence estate bound to the star-schema tables: the one place that says which column plays which part.

Short history (``events``): features f0..f9, hourly. Long history (``lineitem``): one feature for each brand, daily.
All measures are whole numbers or quarters, so that sums do not depend on their order.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seatmetrics.functions.dates import Window, window
from seatmetrics.sources.shared import settle

# Fixed values of this binding: brands without a price, an entitlement, a contract quantity, a contract and any usage.
UNPRICED, UNSERVED, UNBOUGHT, UNDATED, UNSEEN = (6, 13), (11,), (12,), (14,), (7,)
MODELS = ("token", "concurrent", "concurrent", "named_user", "subscription")
#: Order lines that a task holds where lines meet orders or are added up by employee.
TASK_LINES = 250_000


@dataclass(frozen=True)
class Estate:
    """DataFrames of one estate; nothing is read before a query needs it."""

    spark: SparkSession
    root: str

    @cached_property
    def _tables(self) -> dict[str, DataFrame]:
        return {}

    def table(self, name: str) -> DataFrame:
        """A table of the estate; its files are listed once."""
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.root}/{name}.parquet")
        return self._tables[name]

    @cached_property
    def as_of(self) -> date:
        """The latest usage date of the long history: one row out of one column."""
        return self.table("lineitem").agg(F.max("l_shipdate").cast("date").alias("d")).collect()[0]["d"]

    @cached_property
    def events_as_of(self) -> date:
        return self.table("events").agg(F.max("ts").cast("date").alias("d")).collect()[0]["d"]

    def window(self, period: str = "12m") -> Window:
        return window(self.as_of, period)

    # ---- short history -------------------------------------------------------------------------------------------

    def usage(self) -> DataFrame:
        """One row for each observation."""
        k = F.get_json_object("props", "$.k").cast("int")
        failed = F.col("event_type") == "error"
        return self.table("events").select(
            F.concat(F.lit("f"), (k % 10).cast("string")).alias("feature_id"),
            F.concat(F.lit("User"), F.col("user_id").cast("string")).alias("user"),
            F.col("user_id").alias("employee_id"),
            F.to_date("ts").alias("date"),
            F.hour("ts").alias("hour"),
            F.when(F.col("event_type") != "view", F.floor("value").cast("int")).alias("concurrent"),
            F.when(~failed, F.floor("value") / 4.0).alias("duration_hours"),
            failed.alias("denied"),
            k.alias("tokens"),
            F.col("event_id").alias("source_row"),
        )

    def event_entitlements(self) -> DataFrame:
        """(feature_id, entitled, unit_price): the largest size and price of the parts dealt to f0..f9."""
        return self.table("part").groupBy(F.concat(F.lit("f"), (F.col("p_partkey") % 10).cast("string")).alias("feature_id")).agg(F.max("p_size").cast("bigint").alias("entitled"), F.max("p_retailprice").alias("unit_price"))

    def token_daily(self) -> DataFrame:
        """(feature_id, date, token_hours, peak_tokens) of the short history."""
        return self.usage().groupBy("feature_id", "date").agg(F.sum(F.col("tokens").cast("double")).alias("token_hours"), F.max("tokens").alias("peak_tokens"))

    # ---- long history --------------------------------------------------------------------------------------------

    def features(self) -> DataFrame:
        """One row for each feature, with its product, vendor, contract, quantities and price; kept, as most plans use it several times."""
        return self._features

    @cached_property
    def _features(self) -> DataFrame:
        n = F.substring("p_brand", 7, 9).cast("int")
        sizes = self.table("part").groupBy(F.col("p_brand").alias("feature_id"), n.alias("n")).agg(F.sum("p_size").alias("size"), F.max("p_retailprice").alias("price"))
        vendor, col = (F.col("n") % 4).cast("string"), F.col("n")
        served = F.when(~col.isin(*UNSERVED), F.floor(F.col("size") / 20))
        bought = F.when(~col.isin(*UNBOUGHT), F.when(col % 3 == 0, F.floor(F.col("size") / 20)).otherwise(F.floor(F.col("size") / 18)))
        model = F.element_at(F.array(*map(F.lit, MODELS)), col % 5 + 1)
        return sizes.select(
            "feature_id",
            F.concat(F.lit("Feature "), col.cast("string")).alias("feature_name"),
            F.concat(F.lit("product:"), col.cast("string")).alias("product_id"),
            F.concat(F.lit("vendor:"), vendor).alias("vendor_id"),
            F.concat(F.lit("Vendor "), vendor).alias("vendor_name"),
            model.alias("license_model"),
            served.cast("bigint").alias("served_quantity"),
            bought.cast("bigint").alias("purchased_quantity"),
            F.coalesce(served, bought, F.lit(0)).cast("bigint").alias("entitled"),
            F.when(~col.isin(*UNPRICED), F.col("price")).alias("unit_price"),
            F.when(~col.isin(*UNDATED), F.concat(F.lit("contract:"), vendor)).alias("contract_id"),
            F.when(~col.isin(*UNDATED), F.date_add(F.lit(self.as_of), F.col("n") % 4 * 45 - 20)).alias("renewal_date"),
        ).cache()

    def lines(self, models: tuple[str, ...] | None = None) -> DataFrame:
        """Order lines with their brand; brands without usage left out, and those of other licence models if ``models`` says so."""
        n = F.substring("p_brand", 7, 9).cast("int")
        part = self.table("part").where(~n.isin(*UNSEEN))
        if models is not None:
            part = part.where((n % 5).isin(*[k for k, m in enumerate(MODELS) if m in models]))
        return self.table("lineitem").join(part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("feature_id")), "l_partkey")

    def daily(self, within: Window | None = None, models: tuple[str, ...] | None = None) -> DataFrame:
        """(feature_id, date, peak); the window is a filter on the scan."""
        lines = self.lines(models)
        if within is not None:
            lines = lines.where(within.holds(F.col("l_shipdate").cast("date")))
        return lines.groupBy("feature_id", F.col("l_shipdate").cast("date").alias("date")).agg(F.sum("l_quantity").alias("peak"))

    def by_day(self, within: Window, models: tuple[str, ...] | None = None) -> DataFrame:
        """(feature_id, date, peak, token_hours, peak_tokens): what ``daily`` and ``brand_tokens`` say, from one scan, and kept, as both are read from it."""
        lines = self.lines(models).where(within.holds(F.col("l_shipdate").cast("date")))
        rows = lines.groupBy("feature_id", F.col("l_shipdate").cast("date").alias("date")).agg(F.sum("l_quantity").alias("peak"), F.max("l_quantity").alias("peak_tokens"))
        return settle(rows.withColumn("token_hours", F.col("peak")), "by-day")

    def brand_tokens(self, within: Window, models: tuple[str, ...] | None = None) -> DataFrame:
        lines = self.lines(models).where(within.holds(F.col("l_shipdate").cast("date")))
        return lines.groupBy("feature_id", F.col("l_shipdate").cast("date").alias("date")).agg(F.sum("l_quantity").alias("token_hours"), F.max("l_quantity").alias("peak_tokens"))

    @cached_property
    def line_tasks(self) -> int:
        """Tasks among which the order lines are dealt, so that what one of them holds does not grow with the table."""
        context, needed = self.spark.sparkContext, -(-self.table("lineitem").count() // TASK_LINES)
        # Fewer than a join's usual number would be dealt once more by the join with the people.
        return context.defaultParallelism if needed <= context.defaultParallelism else max(needed, int(self.spark.conf.get("spark.sql.shuffle.partitions")))

    def activity(self, models: tuple[str, ...] | None = None) -> DataFrame:
        """One row for each feature and employee.

        Orders are counted once by sums for each order, feature and employee, which meet where the order's lines are. The
        rows are dealt by employee, as the people are who are joined to them.
        """
        orders = self.table("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("employee_id"), F.col("o_orderdate").cast("date").alias("day"))
        dealt = lambda rows, by: rows.repartition(self.line_tasks, by)
        used = dealt(self.lines(models).select("feature_id", "l_orderkey", "l_quantity"), "l_orderkey").join(dealt(orders, "l_orderkey"), "l_orderkey")
        by_order = used.groupBy("l_orderkey", "feature_id", "employee_id").agg(F.sum("l_quantity").alias("hours"), F.max("day").alias("day"))
        rows = dealt(by_order, "employee_id").groupBy("feature_id", "employee_id").agg(F.count("l_orderkey").alias("total_sessions"), F.sum("hours").alias("total_hours"), F.max("day").alias("day"))
        never = F.col("employee_id") % 50 == 0
        return rows.select("feature_id", "employee_id", (F.col("employee_id") % 17 != 0).alias("assigned"), F.when(never, 0).otherwise(F.col("total_sessions")).cast("bigint").alias("total_sessions"), F.when(never, 0.0).otherwise(F.col("total_hours")).alias("total_hours"), F.when(~never, F.col("day")).alias("last_used"))

    def users_without_person(self) -> DataFrame:
        """One row: how many users of the long history are not in the directory."""
        users = self.table("orders").select(F.col("o_custkey").alias("employee_id")).distinct()
        return users.join(self.table("customer").select(F.col("c_custkey").alias("employee_id")), "employee_id", "left_anti").agg(F.count("*").alias("users"))

    def people(self) -> DataFrame:
        """Employees with their dimensions; some have no department or manager."""
        nation = self.table("nation").join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        key = F.col("c_custkey")
        return (
            self.table("customer")
            .join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
            .select(
                key.alias("employee_id"),
                F.concat(F.lit("user"), key.cast("string")).alias("username"),
                F.concat(F.lit("E"), F.lpad(key.cast("string"), 6, "0")).alias("employee_code"),
                F.concat(F.lit("user"), (key + 3).cast("string"), F.lit("@example.com")).alias("email"),
                F.col("c_name").alias("display_name"),
                F.when(F.col("c_acctbal") < 0, "inactive").otherwise("active").alias("status"),
                F.when(key % 29 != 0, F.col("c_mktsegment")).alias("department"),
                F.col("n_name").alias("location"),
                F.col("r_name").alias("region"),
                F.when(key % 11 != 0, F.concat(F.lit("M"), F.col("c_nationkey").cast("string"))).alias("manager_key"),
                F.when(key % 13 != 0, F.concat(F.lit("Manager "), F.col("c_nationkey").cast("string"))).alias("manager_name"),
            )
        )

    def denials(self, within: Window) -> DataFrame:
        """(feature_id, date, hour, employee_id, count, concurrent_at_denial): returned lines of large quantity."""
        orders = self.table("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("employee_id"))
        refused = self.lines().where(within.holds(F.col("l_shipdate").cast("date")) & (F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 30))
        return refused.join(orders, "l_orderkey").select("feature_id", F.col("l_shipdate").cast("date").alias("date"), (F.col("l_linenumber") + 8).alias("hour"), "employee_id", F.lit(1).cast("bigint").alias("count"), F.col("l_quantity").alias("concurrent_at_denial"))

    def event_denials(self) -> DataFrame:
        denied = self.usage().where("denied")
        return denied.select("feature_id", "date", F.coalesce("hour", F.lit(0)).alias("hour"), "employee_id", F.lit(1).cast("bigint").alias("count"), F.col("concurrent").cast("double").alias("concurrent_at_denial"))
