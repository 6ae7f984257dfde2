"""Order lines and offers as views of the order and supplier tables.

A part is an ordered product with its list price; a line item is an offer for
it, a supplier the site of the offer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(x: Column) -> Column:
    """x rounded to two decimals, half up."""
    return F.floor(x * 100 + 0.5).cast("double") / 100


def spread_out(df: DataFrame, spread: bool) -> DataFrame:
    """df, not to be broadcast if spread: files of few bytes may hold many rows, and the driver builds what is broadcast."""
    return df.hint("merge") if spread else df


def order_lines(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """sku, description, brand, variant, ordered_pack, unit_price, qty."""
    lines = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("sku"),
        F.concat_ws(" ", "p_name", "p_type", F.concat(F.col("p_size").cast("string"), F.lit("/Bx"))).alias("description"),
        F.col("p_brand").alias("brand"),
        F.substring_index("p_name", " ", 1).alias("variant"),
        F.col("p_size").alias("ordered_pack"),
        cents(F.col("p_retailprice")).alias("unit_price"),
        (1 + F.pmod("p_partkey", F.lit(10))).cast("int").alias("qty"),
    )
    return spread_out(lines, spread)


def offers(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """Candidate listings, one for each line item, with the verdict columns of a checked listing."""
    li = table(spark, sf_dir, "lineitem").join(spread_out(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"), spread), F.col("l_partkey") == F.col("p_partkey"))
    li = li.join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"))
    o, n, s = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_suppkey")
    site = F.lower(F.replace(F.col("s_name"), F.lit("#"), F.lit("-")))
    domain = F.concat(site, F.lit(".example"))
    pack = F.when(n % 3 == 1, F.col("p_size")).when(n % 3 == 2, F.col("p_size") * n)
    key = F.concat_ws("|", o, n, "l_partkey", s, F.floor(F.col("l_extendedprice") * 100 + 0.5), F.floor("l_quantity"), F.to_date("l_shipdate"))
    return li.select(
        F.col("l_partkey").alias("sku"),
        F.md5(key).alias("offer_id"),
        (o * 8 + n).alias("disc_seq"),
        F.col("s_name").alias("site"),
        domain.alias("domain"),
        F.concat(F.lit("https://www."), domain, F.lit("/products/"), F.col("l_partkey"), F.lit("?v="), n).alias("url"),
        cents(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        pack.cast("int").alias("pack_qty"),
        F.when(F.col("l_returnflag") == "A", "exact").when(F.col("l_returnflag") == "N", "approximate").when(o % 3 == 0, "unverified").otherwise("rejected").alias("match_type"),
        F.floor(100 - F.abs(F.col("l_discount")) * 500 + 0.5).cast("int").alias("confidence"),
        (F.col("l_linestatus") == "O").alias("out_of_stock"),
        (F.abs(F.col("l_discount")) > 0.085).alias("price_unreliable"),
        (s % 2 == 0).alias("brand_match"),
        F.when((o + s) % 9 == 0, None).otherwise((F.col("l_partkey") + s) % 4 != 0).alias("name_match"),
        (o % 3 != 0).alias("size_form_match"),
        (pack == F.col("p_size")).alias("pack_match"),
        (o % 11 == 0).alias("variant_conflict"),
        (o % 7 == 0).alias("variant_unverified"),
        (o % 13 == 0).alias("mpn_confirmed"),
        (o % 5 == 0).alias("price_locked"),
        (o % 29 == 0).alias("is_seed"),
        F.when(o % 17 == 0, "login required").when(o % 19 == 0, "page not found").alias("rejected_reason"),
        F.when(o % 23 != 0, F.col("p_name")).alias("page_name"),
        F.when(s % 10 == 0, "amazon").when(s % 10 == 5, "walmart").alias("marketplace"),
        F.col("l_shipdate").alias("ts"),
    )


def candidates(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """Offers with the columns of their order line; the join is on the sku, and never by broadcast if spread."""
    return offers(spark, sf_dir, spread).join(order_lines(spark, sf_dir, spread), "sku")


# The same views as SQL.
LINES_SQL = """lines AS (
  SELECT p_partkey AS sku, concat_ws(' ', p_name, p_type, p_size || '/Bx') AS description, p_brand AS brand,
    split_part(p_name, ' ', 1) AS variant, p_size AS ordered_pack, floor(p_retailprice * 100 + 0.5) / 100 AS unit_price,
    CAST(1 + p_partkey % 10 AS INTEGER) AS qty FROM part)"""

OFFERS_SQL = """offers AS (
  SELECT l_partkey AS sku,
    md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT), CAST(floor(l_quantity) AS BIGINT), CAST(l_shipdate AS DATE))) AS offer_id,
    l_orderkey * 8 + l_linenumber AS disc_seq, s_name AS site, lower(replace(s_name, '#', '-')) || '.example' AS domain,
    'https://www.' || lower(replace(s_name, '#', '-')) || '.example/products/' || l_partkey || '?v=' || l_linenumber AS url,
    floor(l_extendedprice / l_quantity * 100 + 0.5) / 100 AS price,
    CASE l_linenumber % 3 WHEN 1 THEN p_size WHEN 2 THEN p_size * l_linenumber END AS pack_qty,
    CASE WHEN l_returnflag = 'A' THEN 'exact' WHEN l_returnflag = 'N' THEN 'approximate' WHEN l_orderkey % 3 = 0 THEN 'unverified' ELSE 'rejected' END AS match_type,
    CAST(floor(100 - abs(l_discount) * 500 + 0.5) AS INTEGER) AS confidence,
    l_linestatus = 'O' AS out_of_stock, abs(l_discount) > 0.085 AS price_unreliable, l_suppkey % 2 = 0 AS brand_match,
    CASE WHEN (l_orderkey + l_suppkey) % 9 = 0 THEN NULL ELSE (l_partkey + l_suppkey) % 4 <> 0 END AS name_match,
    l_orderkey % 3 <> 0 AS size_form_match,
    CASE l_linenumber % 3 WHEN 1 THEN p_size WHEN 2 THEN p_size * l_linenumber END = p_size AS pack_match,
    l_orderkey % 11 = 0 AS variant_conflict, l_orderkey % 7 = 0 AS variant_unverified, l_orderkey % 13 = 0 AS mpn_confirmed,
    l_orderkey % 5 = 0 AS price_locked, l_orderkey % 29 = 0 AS is_seed,
    CASE WHEN l_orderkey % 17 = 0 THEN 'login required' WHEN l_orderkey % 19 = 0 THEN 'page not found' END AS rejected_reason,
    CASE WHEN l_orderkey % 23 <> 0 THEN p_name END AS page_name,
    CASE l_suppkey % 10 WHEN 0 THEN 'amazon' WHEN 5 THEN 'walmart' END AS marketplace, l_shipdate AS ts
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)"""

CANDIDATES_SQL = f"{LINES_SQL}, {OFFERS_SQL}, cands AS (SELECT * FROM offers JOIN lines USING (sku))"
