"""Commercial lines: what they cost a year, which feature they are for, and one position for each feature."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seatmetrics.functions.numeric import half_up, or_zero, ratio
from seatmetrics.functions.text import feature_key, sku_key

#: A total over a longer term than this is not a yearly figure.
MULTI_YEAR_DAYS = 400


def derive_cost(lines: DataFrame) -> DataFrame:
    """``lines`` (quantity, unit_price, total_cost, annual_cost, start_date, end_date) with prices filled by the best evidence and its name."""
    quantity, unit, total, annual = (F.col(c) for c in ("quantity", "unit_price", "total_cost", "annual_cost"))
    days = F.datediff("end_date", "start_date")
    many_years = F.coalesce((days > MULTI_YEAR_DAYS) & total.isNotNull(), F.lit(False))
    counted = quantity > 0
    price = F.when(unit.isNotNull(), half_up(unit, 2)).when(annual.isNotNull() & counted, half_up(ratio(annual, quantity), 2)).when(total.isNotNull() & counted & ~many_years, half_up(ratio(total, quantity), 2))
    price_basis = F.when(unit.isNotNull(), "supplied_unit_price").when((annual.isNotNull() & counted) | (total.isNotNull() & counted & ~many_years), "total_over_quantity").otherwise("none")
    yearly = F.when(annual.isNotNull(), half_up(annual, 2)).when(unit.isNotNull() & counted, half_up(unit * quantity, 2)).when(total.isNotNull() & ~many_years, half_up(total, 2))
    yearly_basis = F.when(annual.isNotNull(), "supplied_annual_cost").when(unit.isNotNull() & counted, "quantity_x_unit").when(total.isNotNull() & ~many_years, "supplied_total_cost").otherwise("none")
    return lines.withColumns({"multi_year": many_years, "unit_price_basis": price_basis, "annual_cost_basis": yearly_basis, "_price": price, "_yearly": yearly}).withColumns({"unit_price": F.col("_price"), "annual_cost": F.col("_yearly")}).drop("_price", "_yearly")


def link_contracts(lines: DataFrame, features: DataFrame, aliases: DataFrame) -> DataFrame:
    """``lines`` (line_id, feature, sku) with the observed feature they are for, by confirmed alias, then name, then a part number that a line of a matching name vouches for.

    ``features``: feature_key; ``aliases``: raw (lower case), target. Names that merely look alike are never merged.
    """
    keyed = lines.withColumns({"name_key": feature_key(F.col("feature")), "raw": F.lower(F.trim("feature")), "sku_key": sku_key(F.col("sku"))})
    known = features.select(F.col("feature_key").alias("known")).distinct()
    named = keyed.join(known, keyed["name_key"] == known["known"], "left")
    spellings = lines.where("sku IS NOT NULL").groupBy("feature", "sku").agg(F.max("line_id").alias("line_id")).select(feature_key(F.col("feature")).alias("known"), sku_key(F.col("sku")).alias("sku_key"), "line_id")
    voucher = spellings.join(known, "known").where("sku_key IS NOT NULL").groupBy("sku_key").agg(F.max_by("known", "line_id").alias("vouched"))
    confirmed = aliases.join(known, aliases["target"] == known["known"]).groupBy("raw").agg(F.min("target").alias("aliased"))
    out = named.join(confirmed, "raw", "left").join(voucher, "sku_key", "left")
    basis = F.when(F.col("aliased").isNotNull(), "confirmed_alias").when(F.col("known").isNotNull(), "normalized_name").when(F.col("vouched").isNotNull(), "sku").otherwise("unmatched")
    found = F.coalesce("aliased", "known", "vouched")
    return out.withColumns({"basis": basis, "feature_key": found, "position_key": F.coalesce(found, "name_key")}).drop("known", "aliased", "vouched", "raw", "sku_key", "name_key")


def merge_positions(links: DataFrame) -> DataFrame:
    """One row for each position: quantities and yearly costs added up, one price by the best evidence, the earliest renewal."""
    priced = F.col("unit_price").isNotNull()
    counted = priced & (F.col("quantity") > 0)
    agg = links.groupBy("position_key").agg(
        F.count("*").alias("lines"), F.sum(F.coalesce("quantity", F.lit(0.0))).alias("quantity"), F.sum("annual_cost").alias("annual_cost"),
        F.sum(F.when(counted, F.col("unit_price") * F.col("quantity"))).alias("value"), F.sum(F.when(counted, F.col("quantity"))).alias("weight"),
        F.max("unit_price").alias("dearest"), F.min("unit_price").alias("price"), F.min("renewal_date").alias("renewal_date"),
        F.max("currency").alias("last_currency"), F.min("currency").alias("currency"), F.array_join(F.array_sort(F.collect_set("contract_number")), ",").alias("contract_numbers"),
    )
    price = F.when(F.col("annual_cost").isNotNull() & (F.col("quantity") > 0), half_up(ratio(F.col("annual_cost"), F.col("quantity")), 2)).when(F.col("weight") > 0, half_up(ratio(F.col("value"), F.col("weight")), 2)).when(F.col("dearest") == F.col("price"), F.col("price"))
    return agg.select("position_key", "lines", "quantity", half_up(F.col("annual_cost"), 2).alias("annual_cost"), price.alias("unit_price"), F.when(F.col("last_currency") == F.col("currency"), F.col("currency")).alias("currency"), "renewal_date", "contract_numbers")


def contract_review(links: DataFrame) -> DataFrame:
    """Unmatched positions with how often they occur and what they cost."""
    return links.where("basis = 'unmatched'").groupBy("position_key").agg(F.count("*").alias("occurrences"), half_up(or_zero(F.sum("annual_cost")), 2).alias("annual_cost"))


def licence_model_by_key(links: DataFrame) -> DataFrame:
    """The model of a position if its lines state exactly one."""
    stated = links.where("license_model IS NOT NULL AND license_model <> 'unknown'")
    return stated.groupBy("position_key").agg(F.max("license_model").alias("last"), F.min("license_model").alias("license_model")).where("last = license_model").drop("last")


def last_item(items: DataFrame) -> DataFrame:
    """The last item of each feature in source order."""
    place = F.row_number().over(W.partitionBy("feature_id").orderBy(F.col("source_row").desc()))
    return items.withColumn("place", place).where("place = 1").drop("place")


def review_totals(links: DataFrame) -> DataFrame:
    """The foot of the review queue: positions, what the priced ones cost, and how many have no price."""
    cost = links.where("basis = 'unmatched'").groupBy("position_key").agg(half_up(F.sum("annual_cost"), 2).alias("cost"))
    return cost.agg(F.count("*").alias("positions"), half_up(or_zero(F.sum("cost")), 2).alias("excluded_value"), F.count(F.when(F.col("cost").isNull(), 1)).alias("unpriced_positions"))
