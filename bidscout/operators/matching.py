"""Row-local passes over checked candidates: demotion, backstops, confirmation.

Each takes and returns candidates; they are projections, without a shuffle, and
Catalyst joins a chain of them into one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import rules as R
from ..functions import text as T


def demote_mismatches(df: DataFrame) -> DataFrame:
    """Insane prices and wrong volumes are rejected; of another pack, exact becomes approximate with a condition text."""
    live = F.coalesce(F.col("match_type") != "rejected", F.lit(True))
    insane = live & ~R.sane_price()
    pack = live & ~insane & F.coalesce(~R.pack_compat(), F.lit(False))
    volume = live & ~insane & ~pack & F.coalesce(~T.volume_compat(F.col("description"), F.col("page_name")), F.lit(False))
    text = F.format_string("%d-pack price (ordered pack %d)", F.col("pack_qty"), F.col("ordered_pack"))
    return (
        df.withColumn("pack_condition", F.when(pack, text))
        .withColumn("rejected_reason", F.when(insane, "price failed sanity check").when(volume, "volume mismatch").otherwise(F.col("rejected_reason")))
        .withColumn("match_type", F.when(insane | volume, "rejected").when(pack & (F.col("match_type") == "exact"), "approximate").otherwise(F.col("match_type")))
    )


def variant_pack_backstop(df: DataFrame) -> DataFrame:
    """A variant conflict makes exact approximate; packs that differ by three times or more are a conflict."""
    return df.withColumn("pack_conflict", R.pack_conflict()).withColumn(
        "match_type", F.when(R.true("variant_conflict") & (F.col("match_type") == "exact"), "approximate").otherwise(F.col("match_type"))
    )


def consistency_guard(df: DataFrame) -> DataFrame:
    """Exact needs a page name and, if criteria were judged, to pass them; generic equivalents are tagged."""
    judged = F.coalesce("name_match", "brand_match", "size_form_match", "pack_match").isNotNull()
    unfounded = F.col("page_name").isNull() | (judged & ~R.effective_exact())
    return df.withColumn("generic_equivalent", R.generic_tag()).withColumn("match_type", F.when((F.col("match_type") == "exact") & unfounded, "approximate").otherwise(F.col("match_type")))


def confirm_by_mpn(df: DataFrame) -> DataFrame:
    """The normalized part number (five characters at least) in url, name or title confirms the product."""
    number = T.normal_id(F.col("mpn"))
    seen = F.contains(T.normal_id(F.concat_ws(" ", "url", "page_name", "title")), number)
    ok = F.coalesce((F.length(number) >= 5) & seen, F.lit(False)) & ~R.true("variant_conflict")
    return df.withColumn("mpn_confirmed", ok | R.true("mpn_confirmed")).withColumn("name_match", F.when(ok, F.lit(True)).otherwise(F.col("name_match")))


def confirm_locked(df: DataFrame) -> DataFrame:
    """A locked price whose page names the product is a name match."""
    ok = R.true("price_locked") & ~R.true("variant_conflict") & ~R.true("name_match") & T.likely_exact()
    return df.withColumn("name_match", F.when(ok, F.lit(True)).otherwise(F.col("name_match")))


def flag_unseen_price(df: DataFrame) -> DataFrame:
    """A price from a page of some length that shows none is unreliable, unless structured or locked."""
    unseen = (F.length("page_text") > 200) & ~F.rlike("page_text", F.lit(r"\$\s?\d")) & F.col("price").isNotNull() & ~R.true("price_structured") & ~R.true("price_locked")
    return df.withColumn("price_unreliable", R.true("price_unreliable") | F.coalesce(unseen, F.lit(False)))


def flag_out_of_stock(df: DataFrame) -> DataFrame:
    """Denied stock, or a phrase for it near the top of a page without a cart button; exact becomes approximate."""
    top = F.lower(F.substring("page_text", 1, 6000))
    phrase = F.rlike(top, F.lit(T.OUT_OF_STOCK)) & ~F.contains(top, F.lit("add to cart"))
    gone = (~R.not_false("in_stock")) | F.coalesce(phrase, F.lit(False))
    gone = gone & ~(R.true("price_locked") & R.true("aggregator"))
    return df.withColumn("out_of_stock", R.true("out_of_stock") | gone).withColumn("match_type", F.when(gone & (F.col("match_type") == "exact"), "approximate").otherwise(F.col("match_type")))


def option_savings(df: DataFrame) -> DataFrame:
    """saved_each, saved_total (rounded to cents), saved_pct and its band."""
    money = lambda c: F.col(c).cast("decimal(12,2)")
    each = (money("unit_price") - money("price")).cast("decimal(12,2)")
    pct = F.when(F.col("unit_price") > 0, each.cast("double") / F.col("unit_price") * 100)
    return df.withColumn("saved_each", each).withColumn("saved_total", (each * F.col("qty")).cast("decimal(14,2)")).withColumn("saved_pct", pct).withColumn("band", R.savings_band(pct))


def classify_source(df: DataFrame, trusted: list[str] | None = None, aggregators: list[str] | None = None) -> DataFrame:
    """source_type of a candidate by what it is and whose domain it is on."""
    on = lambda names: F.col("domain").isin(*names) if names else F.lit(False)
    kind = (
        F.when(R.true("generic_equivalent"), "Generic Alternative")
        .when(F.col("marketplace").isNotNull(), "Marketplace")
        .when(on(aggregators), "Aggregator")
        .when(on(trusted) | F.contains("domain", F.lit("dent")), "Dental Supplier")
        .otherwise("Other")
    )
    return df.withColumn("source_type", kind)


def apply_enrichment(lines: DataFrame, parsed: DataFrame) -> DataFrame:
    """Fields that were read from descriptions, joined by sku; the description stands in for what is missing."""
    p = parsed.select(F.col("sku").alias("p_sku"), F.col("product_name").alias("p_name"), F.col("search_query").alias("p_query"), F.col("pack_qty").cast("string").alias("p_pack"))
    out = lines.join(p, F.col("sku") == F.col("p_sku"), "left")
    return (
        out.withColumn("product_name", F.coalesce(F.nullif(F.trim("p_name"), F.lit("")), "description"))
        .withColumn("search_query", F.coalesce(F.nullif(F.trim("p_query"), F.lit("")), "description"))
        .withColumn("ordered_pack", F.coalesce(T.number(F.col("p_pack"), "int"), "ordered_pack"))
        .drop("p_sku", "p_name", "p_query", "p_pack")
    )


def build_queries(lines: DataFrame) -> DataFrame:
    """queries array<string>: the search text, the generic one, the one by number; distinct without regard to case."""
    asked = F.filter(F.array(F.coalesce(F.nullif(F.trim("search_query"), F.lit("")), F.col("description")), F.col("generic_query"), F.col("mpn_query")), lambda q: F.coalesce(F.trim(q), F.lit("")) != "")
    low = F.transform(asked, lambda q: F.lower(F.trim(q)))
    return lines.withColumn("queries", F.filter(F.transform(asked, lambda q: F.trim(q)), lambda q, i: F.array_position(low, F.lower(q)) == (i + 1).cast("long")))


def price_outcome(df: DataFrame) -> DataFrame:
    """How prices of a range, a login page or a page without names are rescued (low: the range's low price)."""
    named = R.true("name_match") & (R.true("brand_match") | (F.coalesce("brand", F.lit("")) == ""))
    rescue = F.col("price").isNull() & ~R.gated() & named & F.col("range_low").between(F.col("unit_price") * C.SANE_LOW, F.col("unit_price") * C.SANE_HIGH)
    rescue = F.coalesce(rescue, F.lit(False))
    return (
        df.withColumn("price_unreliable", R.true("price_unreliable") | rescue)
        .withColumn("match_type", F.when(rescue & (F.col("match_type") == "rejected"), "approximate").otherwise(F.col("match_type")))
        .withColumn("price", F.when(rescue, F.col("range_low")).otherwise(F.col("price")))
    )


def rescue_gated(df: DataFrame) -> DataFrame:
    """A structured or locked price outlives a login rejection, as an unverified one; the name is filled."""
    hit = R.gated() & (R.true("price_structured") | R.true("price_locked")) & F.col("price").isNotNull()
    return (
        df.withColumn("page_name", F.when(hit, F.coalesce("page_name", "structured_name", "title")).otherwise(F.col("page_name")))
        .withColumn("match_type", F.when(hit, "unverified").otherwise(F.col("match_type")))
        .withColumn("rejected_reason", F.when(hit, F.lit(None).cast("string")).otherwise(F.col("rejected_reason")))
    )
