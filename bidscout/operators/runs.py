"""The registry of runs: change rows, the latest state, history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def current_runs(changes: DataFrame, columns: list[str]) -> DataFrame:
    """changes (id, seq, at, columns: null where unchanged) -> for each id the last value of each column."""
    last = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in columns]
    return changes.groupBy("id").agg(*last, F.min("at").alias("created_at"), F.max("at").alias("updated_at"))


def newest(runs: DataFrame, most: int = 200) -> DataFrame:
    """The runs changed last (a top-k: each task keeps its own)."""
    return runs.orderBy(F.desc("updated_at"), "id").limit(most)


def history_view(runs: DataFrame) -> DataFrame:
    """reference stands in for the file's name if blank; reports only of completed runs."""
    name = F.regexp_replace("filename", r"(?i)\.pdf$", "")
    reports = F.struct(*(F.concat(F.col("folder"), F.lit(f"/{r}")).alias(r) for r in ("price_match", "alternates", "evidence")))
    return runs.withColumn("reference", F.coalesce(F.nullif(F.trim("reference"), F.lit("")), name)).withColumn("reports", F.when(F.col("status") == "complete", reports))


def backfill(files: DataFrame, runs: DataFrame, orders: DataFrame, items: DataFrame) -> DataFrame:
    """Completed runs for orders whose reports (files: reference, written_at) no run has.

    orders (id, reference, filename, total_price, created_at) and items (order_id): of the latest order of that
    reference come file name, total, time and the number of items; without an order the reference names the file,
    and the time is when the report was written.
    """
    known = files.withColumn("id", F.concat(F.lit("legacy-"), "reference")).join(runs.select("id"), "id", "left_anti")
    latest = orders.groupBy("reference").agg(F.max_by(F.struct("id", "filename", "total_price", "created_at"), F.col("id")).alias("o"))
    counts = items.groupBy(F.col("order_id")).agg(F.count("*").alias("items"))
    df = known.join(latest, "reference", "left").join(counts, F.col("o.id") == F.col("order_id"), "left")
    return df.select(
        "id", "reference", F.coalesce("o.filename", F.concat("reference", F.lit(".pdf"))).alias("filename"), F.lit("complete").alias("status"), F.coalesce("items", F.lit(0)).alias("items"),
        F.col("o.total_price").alias("total_price"), F.coalesce("o.created_at", "written_at").alias("created_at"),
    )
