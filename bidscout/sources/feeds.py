"""Storefront feeds, search results and model replies: JSON text flattened to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U


def _variant(json: str, path: str, kind: str) -> Column:
    return F.expr(f"try_variant_get({json}, '{path}', '{kind}')")


def _money(c: Column) -> Column:
    """A number, or the first number in a text."""
    return T.number(F.replace(F.regexp_extract(c, r"(\d[\d,]*(?:\.\d+)?)", 1), F.lit(",")), "decimal(12,2)")


def items(df: DataFrame, json: str, path: str) -> DataFrame:
    """df with pos and item (variant) for each element of the array at a path; rows without one go."""
    parsed = df.withColumn("_doc", F.try_parse_json(F.col(json)))
    parsed = parsed.withColumn("_items", F.expr(f"try_variant_get(_doc, '{path}', 'array<variant>')"))
    return parsed.select(*df.columns, F.posexplode("_items").alias("pos", "item"))


def flatten_storefront(feeds: DataFrame) -> DataFrame:
    """feeds (domain, body) -> domain, pos, title, handle, price (of the first variant that has one), url."""
    rows = items(feeds, "body", "$.products").select("domain", "pos", _variant("item", "$.title", "string").alias("title"), _variant("item", "$.handle", "string").alias("handle"), F.expr("try_variant_get(item, '$.variants', 'array<variant>')").alias("v"))
    prices = F.filter(F.transform("v", lambda x: _money(F.try_variant_get(x, "$.price", "string"))), lambda p: p > 0)
    rows = rows.filter("title != '' AND handle != ''")
    return rows.select("domain", "pos", "title", "handle", F.get(prices, 0).alias("price"), F.concat(F.lit("https://"), "domain", F.lit("/products/"), "handle").alias("url"))


#: The arrays of a search result in order of their rows, and where a hit's link may be.
HIT_ARRAYS = ("organic_results", "shopping_results", "ads", "inline_shopping_results")
LINKS = ("link", "product_link", "url", "source_link", "tracking_link", "redirect_link")


def flatten_hits(results: DataFrame, engine: str = r"google\.") -> DataFrame:
    """results (query_id, body) -> query_id, disc_seq, section, title, url (the first link outside the engine), price, domain.

    A link may also be that of the first offer or seller in a hit that has one. Bodies are parsed once.
    """
    text = lambda v, p: F.try_variant_get(v, p, "string")
    outside = lambda u: (F.coalesce(u, F.lit("")) != "") & ~F.rlike(U.domain(u), F.lit(rf"(?:^|\.){engine}"))
    first = lambda links: F.get(F.filter(links, outside), 0)

    def nested(v: Column) -> Column:
        link = lambda s: F.coalesce(F.nullif(text(s, "$.link"), F.lit("")), text(s, "$.direct_link"))
        return F.flatten(F.array(*(F.coalesce(F.transform(F.try_variant_get(v, f"$.{box}", "array<variant>"), link), F.array().cast("array<string>")) for box in ("offers", "sellers"))))

    def hit(section_no: int):
        def one(v: Column, pos: Column) -> Column:
            url = F.coalesce(first(F.array(*(text(v, f"$.{k}") for k in LINKS))), first(nested(v)))
            price = F.coalesce(_money(text(v, "$.extracted_price")), _money(text(v, "$.price")), F.get(T.dollars(text(v, "$.snippet")), 0))
            return F.struct(F.lit(section_no).alias("section_no"), pos.alias("pos"), text(v, "$.title").alias("title"), url.alias("url"), price.alias("price"))

        return one

    empty = F.array().cast("array<struct<section_no:int,pos:int,title:string,url:string,price:decimal(12,2)>>")
    docs = results.select("query_id", F.explode(F.array(F.try_parse_json("body"))).alias("_doc"))
    # a hit is read once, in its array: a filter of rows would read its links again
    hits = F.concat(*(F.coalesce(F.transform(F.try_variant_get("_doc", f"$.{n}", "array<variant>"), hit(k)), empty) for k, n in enumerate(HIT_ARRAYS)))
    rows = docs.select("query_id", F.inline(F.filter(hits, lambda h: h["url"].isNotNull())))
    out = rows.withColumn("disc_seq", F.row_number().over(Window.partitionBy("query_id").orderBy("section_no", "pos")))
    return out.select("query_id", "disc_seq", F.get(F.array(*map(F.lit, HIT_ARRAYS)), F.col("section_no")).alias("section"), "title", "url", "price", U.domain(F.col("url")).alias("domain"))


def flatten_sellers(results: DataFrame, most: int = 5) -> DataFrame:
    """results (product_id, body) -> up to `most` sellers with a link and a price, in order."""
    rows = items(results, "body", "$.sellers")
    price = F.coalesce(*(_money(_variant("item", f"$.{k}", "string")) for k in ("base_price", "total_price", "price")))
    rows = rows.select("product_id", "pos", _variant("item", "$.name", "string").alias("seller"), _variant("item", "$.link", "string").alias("url"), price.alias("price")).filter("url != '' AND price > 0")
    w = Window.partitionBy("product_id").orderBy("pos")
    return rows.withColumn("seller_no", F.row_number().over(w)).filter(F.col("seller_no") <= most).drop("pos")


def flatten_marketplace(results: DataFrame, limit: int = 6) -> DataFrame:
    """results (query_id, marketplace, body) -> up to limit hits on the marketplace's own domain, of the first 2 * limit.

    A price may be a number, a text, or an object with a value; a missing link is made of an asin.
    """
    rows = items(results, "body", "$.results").filter(F.col("pos") < 2 * limit)
    asin = _variant("item", "$.asin", "string")
    link = F.coalesce(F.nullif(_variant("item", "$.link", "string"), F.lit("")), F.when(F.col("marketplace") == "amazon", F.concat(F.lit("https://www.amazon.com/dp/"), asin)))
    price = F.coalesce(*(_money(_variant("item", p, "string")) for p in ("$.price.value", "$.price.raw", "$.price", "$.offer.price")))
    rows = rows.select("query_id", "marketplace", "pos", _variant("item", "$.title", "string").alias("title"), link.alias("url"), price.alias("price"))
    rows = rows.filter(F.contains(U.domain(F.col("url")), F.concat("marketplace", F.lit("."))))
    w = Window.partitionBy("query_id", "marketplace").orderBy("pos")
    return rows.withColumn("hit_no", F.row_number().over(w)).filter(F.col("hit_no") <= limit).drop("pos")


def parse_verdicts(replies: DataFrame) -> DataFrame:
    """replies (key, urls array<string>, reply) -> key, url, product_name, price, pack_quantity, match_type, confidence.

    A reply may be fenced, have prose around its JSON, be a list, an object with a
    list (results, items, candidates, data) or one object; page numbers count from 1.
    """
    plain = F.regexp_replace("reply", r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", "")
    # only what begins as JSON does is tried, as a failure costs an exception
    begins = r"^\s*\x{FEFF}?\s*[\[{\"\-0-9tfnNI]"
    doc = F.coalesce(F.when(F.rlike(plain, F.lit(begins)), F.try_parse_json(plain)), F.try_parse_json(F.regexp_extract(plain, r"(?s)\{.*\}", 0)))
    # exploded, so that the document is parsed once and not again in each place that reads it
    df = replies.select("key", "urls", F.explode(F.array(doc)).alias("doc"))
    lists = [F.try_variant_get("doc", p, "array<variant>") for p in ("$", "$.results", "$.items", "$.candidates", "$.data")]
    df = df.withColumn("list", F.coalesce(*lists, F.when(F.col("doc").isNotNull(), F.array("doc"))))
    df = df.select("key", "urls", F.posexplode("list").alias("pos", "item"))
    page = F.coalesce(_variant("item", "$.page", "int"), F.col("pos") + 1)
    return df.select(
        "key",
        F.coalesce(_variant("item", "$.url", "string"), F.get("urls", page - 1)).alias("url"),
        _variant("item", "$.product_name", "string").alias("product_name"),
        _money(_variant("item", "$.price", "string")).alias("price"),
        T.number(_variant("item", "$.pack_quantity", "string"), "int").alias("pack_quantity"),
        _variant("item", "$.match_type", "string").alias("match_type"),
        T.number(_variant("item", "$.confidence", "string"), "int").alias("confidence"),
    )


def pipe_table(lines: DataFrame, columns: list[str], least: int = 2) -> DataFrame:
    """lines (line_no, value) of a client table: cells between |, # starts a comment, blank cells are null."""
    body = F.trim(F.regexp_replace("value", r"#.*$", ""))
    cells = F.transform(F.split(body, r"\|"), lambda c: F.nullif(F.trim(c), F.lit("")))
    df = lines.withColumn("cells", cells).filter(F.size(F.filter("cells", lambda c: c.isNotNull())) >= least)
    return df.select("line_no", *(F.get("cells", i).alias(c) for i, c in enumerate(columns)))


def domain_list(lines: DataFrame) -> DataFrame:
    """lines (value) -> domain: lower case, without comments and www."""
    d = F.regexp_replace(F.lower(F.trim(F.regexp_replace("value", r"#.*$", ""))), r"^www\.", "")
    return lines.select(d.alias("domain")).filter("domain != ''").distinct()


#: Marketplaces that a source list has at least, with their priority.
DEFAULT_MARKETPLACES = (("amazon", "amazon.com", 900), ("walmart", "walmart.com", 910))
SOURCE_TYPES = ("dental_supplier", "aggregator", "marketplace", "other")


def load_sources(stored: DataFrame, sites: DataFrame, aggregators: tuple[str, ...] = ()) -> DataFrame:
    """stored (body: a JSON array of sources) -> position, id, domain, label, enabled, type, priority, with default
    marketplaces that it lacks; from the list of sites (position, domain) if nothing is stored."""
    text = lambda k: F.try_variant_get("s", f"$.{k}", "string")
    rows = stored.select(F.posexplode(F.try_variant_get(F.try_parse_json("body"), "$", "array<variant>")).alias("position", "s"))
    rows = rows.select((F.col("position") + 1).alias("position"), text("id").alias("id"), text("domain").alias("domain"), text("label").alias("label"), F.try_variant_get("s", "$.enabled", "boolean").alias("enabled"), text("type").alias("type"), F.try_variant_get("s", "$.priority", "int").alias("priority"))
    kind = F.when(F.col("domain").isin(*aggregators), "aggregator").otherwise("dental_supplier") if aggregators else F.lit("dental_supplier")
    made = sites.select(F.col("position").cast("int").alias("position"), F.col("domain").alias("id"), "domain", F.col("domain").alias("label"), F.lit(True).alias("enabled"), kind.alias("type"), F.col("position").cast("int").alias("priority"))
    some = rows.agg((F.count("*") > 0).alias("some"))  # one row
    rows = rows.unionByName(made.join(some).filter("NOT some").drop("some"))
    spark = stored.sparkSession
    known = spark.createDataFrame([(p, i, d, d, True, "marketplace", p) for i, d, p in DEFAULT_MARKETPLACES], "position int, id string, domain string, label string, enabled boolean, type string, priority int")
    return rows.unionByName(known.join(rows.select("domain"), "domain", "left_anti").select(*rows.columns))


def normalize_sources(sources: DataFrame) -> DataFrame:
    """sources (position, id, domain, label, enabled, type, priority) cleaned, with the default marketplaces added, in order."""
    d = F.regexp_replace(F.lower(F.trim("domain")), r"^www\.", "")
    clean = sources.select(
        "id",
        d.alias("domain"),
        F.coalesce(F.nullif(F.trim("label"), F.lit("")), d).alias("label"),
        F.coalesce("enabled", F.lit(True)).alias("enabled"),
        F.when(F.col("type").isin(*SOURCE_TYPES), F.col("type")).otherwise("other").alias("type"),
        F.coalesce(F.nullif(F.col("priority"), F.lit(0)), F.col("position")).cast("int").alias("priority"),
    ).filter(F.rlike("domain", F.lit(r"^[^/\s]+$")))
    spark = sources.sparkSession
    known = spark.createDataFrame([(i, d, d, True, "marketplace", p) for i, d, p in DEFAULT_MARKETPLACES], "id string, domain string, label string, enabled boolean, type string, priority int")
    return clean.unionByName(known.join(clean.select("domain"), "domain", "left_anti").select(*clean.columns)).orderBy("priority", "domain")


def site_lists(sources: DataFrame, excluded: DataFrame, incumbent: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Supplier sites, excluded domains and enabled marketplaces that follow from the sources."""
    sites = sources.filter(F.col("enabled") & F.col("type").isin("dental_supplier", "aggregator")).select("domain")
    markets = sources.filter(F.col("type") == "marketplace")
    on, off = markets.filter("enabled").select("domain"), markets.filter("NOT enabled").select("domain")
    spark = sources.sparkSession
    barred = excluded.select("domain").join(on, "domain", "left_anti").unionByName(off).unionByName(spark.createDataFrame([(incumbent,)], "domain string")).distinct()
    return sites, barred, on
