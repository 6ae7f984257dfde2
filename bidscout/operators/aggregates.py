"""Aggregations over lines, options and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions import rules as R

money = lambda c: F.col(c).cast("decimal(12,2)")


def has_primary(cands: DataFrame, key: str = "sku") -> DataFrame:
    """Whether any candidate of a line is eligible for the price-match report."""
    return cands.groupBy(key).agg(F.bool_or(R.price_match_eligible()).alias("has_primary"))


def run_stats(lines: DataFrame, options: DataFrame, findings: DataFrame, key: str = "sku") -> DataFrame:
    """One row: lines by their first option (exact, near, none), the savings of first options, and the findings that are alternates."""
    first = options.filter("option_no = 1").select(key, "price", R.exact_candidate().alias("is_exact"))
    df = lines.join(first, key, "left")
    saved = F.when(F.col("price") < F.col("unit_price"), (money("unit_price") - money("price")) * F.col("qty"))
    alternates = findings.filter(F.col("level").isin("exact", "close")).agg(F.count("*").alias("alternate_items"))
    stats = df.agg(
        F.count("*").alias("items"),
        F.count_if("is_exact").alias("exact_items"),
        F.count_if(~F.col("is_exact")).alias("near_items"),
        F.count_if(F.col("price").isNull()).alias("unpriced_items"),
        F.coalesce(F.sum(saved), F.lit(0)).cast("decimal(18,2)").alias("savings"),
    )
    return stats.join(alternates)  # a row and a row


def group_best_savings(lines: DataFrame, options: DataFrame, key: str = "sku") -> DataFrame:
    """The best total saving of each line; null without options."""
    best = options.groupBy(key).agg(F.max("saved_total").alias("best_total"))
    return lines.select(key).join(best, key, "left")


def order_totals(lines: DataFrame, key: str = "order_id") -> DataFrame:
    return lines.groupBy(key).agg(F.count("*").alias("items"), F.sum(money("extended_price")).cast("decimal(18,2)").alias("computed_total"))


def reconcile(orders: DataFrame, totals: DataFrame, key: str = "order_id") -> DataFrame:
    """off: printed and computed totals differ by more than a cent."""
    df = orders.join(totals, key, "left").withColumn("computed_total", F.coalesce("computed_total", F.lit(0).cast("decimal(18,2)")))
    return df.withColumn("off", F.abs(F.col("computed_total") - F.col("printed_total")) > C.ORDER_TOLERANCE)


def mpn_conflicts(lines: DataFrame) -> DataFrame:
    """Numbers on several lines with different descriptions."""
    found = lines.groupBy("number").agg(F.count("*").alias("lines"), F.count_distinct("description").alias("texts"))
    return found.filter("lines > 1 AND texts > 1")


def mpn_consensus(cands: DataFrame, key: str = "sku", least: int = 2) -> DataFrame:
    """The number that a line's name-matched pages declare most often, with two mentions at least; the first wins ties."""
    seen = cands.filter(R.true("name_match") & F.col("page_name").isNotNull() & F.col("declared").isNotNull())
    counts = seen.groupBy(key, F.col("declared").alias("number")).agg(F.count("*").alias("n"), F.min("disc_seq").alias("first")).filter(F.col("n") >= least)
    w = Window.partitionBy(key).orderBy(F.desc("n"), "first", "number")
    return counts.withColumn("k", F.row_number().over(w)).filter("k = 1").select(key, "number", "n")


def usage_summary(calls: DataFrame, key: str = "run_id") -> DataFrame:
    """Calls, skipped ones, credits and whether they ran out, for each run."""
    return calls.groupBy(key).agg(F.count("*").alias("calls"), F.count_if("skipped").alias("skipped"), F.sum("credits").alias("credits"), F.bool_or("exhausted").alias("exhausted"))
