"""Queries over client tables, report sinks and the rest of the selections."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators import reports as P
from ..operators import selection as S
from ..operators import urls as U
from ..sources import feeds as D
from ..sources import files as L
from ..sources import pages as G
from ..sources.views import CANDIDATES_SQL, candidates, order_lines, table
from .offer_jobs import OPTIONS, SQL
from .registry import query


@query("s6_read_pipe_table", "SELECT CAST(p_partkey AS VARCHAR) AS sku, 'M-' || p_partkey AS mpn, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS maker FROM part WHERE p_partkey % 5 <> 0")
def s6(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    k = F.col("p_partkey").cast("string")
    maker = F.when(F.col("p_partkey") % 2 == 0, F.replace("p_brand", F.lit("#"), F.lit("no"))).otherwise("  ")
    line = F.when(F.col("p_partkey") % 5 == 0, F.concat(k, F.lit(" | # nothing"))).otherwise(F.concat(k, F.lit(" | M-"), k, F.lit(" | "), maker, F.lit(" # a note | x")))
    at = L.shared_folder(spark, "pipe-table")
    part.select(line.alias("value")).write.text(at)
    rows = L.pipe_table(spark, at, ["sku", "mpn", "maker"])
    return rows.select("sku", "mpn", F.replace("maker", F.lit("no"), F.lit("#")).alias("maker"))


@query("s7_read_domain_list", "SELECT DISTINCT lower(replace(s_name, '#', '-')) || '.example' AS domain FROM supplier WHERE s_suppkey % 4 <> 3")
def s7(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    name = F.concat(F.replace("s_name", F.lit("#"), F.lit("-")), F.lit(".example"))
    line = F.when(F.col("s_suppkey") % 4 == 0, F.concat(F.lit("WWW."), name)).when(F.col("s_suppkey") % 4 == 3, F.concat(F.lit("# "), name)).otherwise(F.concat(F.lit(" "), name, F.lit(" # good")))
    at = L.shared_folder(spark, "domain-list")
    s.select(line.alias("value")).write.text(at)
    return L.domain_list(spark, at)


def _sources(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    domain = F.when(k % 9 == 8, "bad/path").otherwise(F.concat(F.lower(F.replace("s_name", F.lit("#"), F.lit("-"))), F.lit(".example")))
    kind = F.get(F.array(*map(F.lit, ("dental_supplier", "aggregator", "marketplace", "odd"))), (k % 4).cast("int"))
    return s.select(k.cast("int").alias("position"), k.cast("string").alias("id"), domain.alias("domain"), F.lit(" ").alias("label"), (k % 3 != 0).alias("enabled"), kind.alias("type"), F.when(k % 2 == 0, 0).otherwise(7).alias("priority"))


SOURCES = """WITH n AS (SELECT CAST(s_suppkey AS VARCHAR) AS id, lower(replace(s_name, '#', '-')) || '.example' AS domain, s_suppkey % 3 <> 0 AS enabled,
  CASE s_suppkey % 4 WHEN 0 THEN 'dental_supplier' WHEN 1 THEN 'aggregator' WHEN 2 THEN 'marketplace' ELSE 'other' END AS type,
  CAST(CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey ELSE 7 END AS INTEGER) AS priority FROM supplier WHERE s_suppkey % 9 <> 8),
a AS (SELECT * FROM n UNION ALL SELECT 'amazon', 'amazon.com', true, 'marketplace', 900 UNION ALL SELECT 'walmart', 'walmart.com', true, 'marketplace', 910)
"""


@query(
    "s8_load_supplier_sources",
    """WITH s AS (SELECT row_number() OVER (ORDER BY s_suppkey) AS position, lower(replace(s_name, '#', '-')) || '.example' AS domain, s_suppkey AS k FROM supplier)
SELECT 'stored' AS origin, domain, domain AS label, CASE WHEN k % 3 = 0 THEN 'aggregator' ELSE 'dental_supplier' END AS type, k % 2 = 0 AS enabled, CAST(position AS INTEGER) AS priority FROM s
UNION ALL SELECT 'stored', 'amazon.com', 'The shop', 'marketplace', false, 1 UNION ALL SELECT 'stored', 'walmart.com', 'walmart.com', 'marketplace', true, 910
UNION ALL SELECT 'sites', domain, domain, CASE WHEN domain = 'supplier-000000003.example' THEN 'aggregator' ELSE 'dental_supplier' END, true, CAST(position AS INTEGER) FROM s
UNION ALL SELECT 'sites', 'amazon.com', 'amazon.com', 'marketplace', true, 900 UNION ALL SELECT 'sites', 'walmart.com', 'walmart.com', 'marketplace', true, 910""",
)
def s8(spark, sf_dir):
    domain = F.concat(F.lower(F.replace("s_name", F.lit("#"), F.lit("-"))), F.lit(".example"))
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), domain.alias("domain"))
    one = lambda d, label, kind, on, p: F.struct(d.alias("id"), d.alias("domain"), label.alias("label"), kind.alias("type"), on.alias("enabled"), p.cast("int").alias("priority"))
    ordered = F.array_sort(F.collect_list(F.struct("k", "domain")))
    rows = F.transform(ordered, lambda x, i: one(x["domain"], x["domain"], F.when(x["k"] % 3 == 0, "aggregator").otherwise("dental_supplier"), x["k"] % 2 == 0, i + 1))
    shop = F.array(one(F.lit("amazon.com"), F.lit("The shop"), F.lit("marketplace"), F.lit(False), F.lit(1)))
    stored = supplier.agg(F.to_json(F.concat(rows, shop)).alias("body"))  # a client's list: as short as its file
    sites = supplier.agg(ordered.alias("l")).select(F.posexplode("l").alias("i", "x")).select((F.col("i") + 1).alias("position"), "x.domain")
    at = L.shared_folder(spark, "sources")
    stored.write.text(at)
    load = lambda path, name: L.supplier_sources(spark, path, sites, ("supplier-000000003.example",)).select(F.lit(name).alias("origin"), "domain", "label", "type", "enabled", "priority")
    return load(at, "stored").unionByName(load(f"{at}-none", "sites"))


@query("s9_normalize_supplier_sources", SOURCES + "SELECT id, domain, domain AS label, enabled, type, priority FROM a")
def s9(spark, sf_dir):
    return D.normalize_sources(_sources(spark, sf_dir))


@query("s10_derive_site_lists", SOURCES + "SELECT 'site' AS list, domain FROM a WHERE enabled AND type IN ('dental_supplier', 'aggregator') UNION ALL SELECT 'barred', domain FROM a WHERE NOT enabled AND type = 'marketplace' UNION ALL SELECT 'barred', 'own.example' UNION ALL SELECT 'barred', 'x.example' UNION ALL SELECT 'market', domain FROM a WHERE enabled AND type = 'marketplace'")
def s10(spark, sf_dir):
    excluded = spark.createDataFrame([("x.example",), ("amazon.com",)], "domain string")
    lists = D.site_lists(D.normalize_sources(_sources(spark, sf_dir)), excluded, "own.example")
    out = None
    for name, df in zip(("site", "barred", "market"), lists, strict=True):
        part = df.select(F.lit(name).alias("list"), "domain")
        out = part if out is None else out.unionByName(part)
    return out


@query("a8_single_offer", "WITH " + CANDIDATES_SQL + " SELECT sku, count(DISTINCT CAST(price AS DECIMAL(12,2))) = 1 AS single_offer, CAST(min(price) AS DECIMAL(12,2)) AS price FROM cands WHERE price > 0 GROUP BY sku")
def a8(spark, sf_dir):
    p = F.col("price").cast("decimal(12,2)")
    return candidates(spark, sf_dir).filter("price > 0").groupBy("sku").agg((F.count_distinct(p) == 1).alias("single_offer"), F.min(p).alias("price"))


@query("a12_closest_miss", SQL + "SELECT sku, marketplace, max(score) AS score FROM r WHERE marketplace IS NOT NULL GROUP BY sku, marketplace HAVING NOT bool_or(eligible AND (brand_ok OR mpn_confirmed))")
def a12(spark, sf_dir):
    return S.marketplace_pick(candidates(spark, sf_dir)).filter("NOT found").select("sku", "marketplace", "score")


@query("u6_split_marketplace", "WITH " + CANDIDATES_SQL + " SELECT marketplace IS NOT NULL AS is_market, count(*) AS n FROM cands GROUP BY 1")
def u6(spark, sf_dir):
    c = candidates(spark, sf_dir)
    own, market = c.filter("marketplace IS NULL"), c.filter("marketplace IS NOT NULL")
    return own.select(F.lit(False).alias("is_market")).unionByName(market.select(F.lit(True).alias("is_market"))).groupBy("is_market").agg(F.count("*").alias("n"))


@query("t7_cheapest_unpriced", "WITH " + CANDIDATES_SQL + " SELECT sku, offer_id FROM cands QUALIFY price_locked OR row_number() OVER (PARTITION BY sku, price_locked ORDER BY price, disc_seq, offer_id) <= 4")
def t7(spark, sf_dir):
    w = Window.partitionBy("sku", "price_locked").orderBy("price", *S.LAST)
    return candidates(spark, sf_dir).withColumn("k", F.row_number().over(w)).filter("price_locked OR k <= 4").select("sku", "offer_id")


@query("t10_discovery_cap", "WITH " + CANDIDATES_SQL + " SELECT sku, least(count(DISTINCT url), 40) AS urls FROM cands GROUP BY sku")
def t10(spark, sf_dir):
    from ..operators.verdicts import cached_discovery

    now = F.lit("2026-01-01").cast("timestamp")
    cache = candidates(spark, sf_dir).groupBy("sku").agg(F.array_sort(F.collect_set("url")).alias("urls")).withColumn("ts", now)
    hits, _ = cached_discovery(order_lines(spark, sf_dir), cache, now)
    return hits.groupBy("sku").agg(F.count("*").alias("urls"))


@query("j17_skip_equivalency_skus", "WITH " + CANDIDATES_SQL + " SELECT sku, count(*) AS n FROM cands WHERE sku % 5 <> 0 GROUP BY sku")
def j17(spark, sf_dir):
    found = order_lines(spark, sf_dir).filter("sku % 5 = 0").select("sku")
    return candidates(spark, sf_dir).join(found, "sku", "left_anti").groupBy("sku").agg(F.count("*").alias("n"))


@query("r6_parsed_order_audit", "SELECT l_orderkey AS order_id, count(*) AS lines, CAST(sum(CAST(floor(l_extendedprice * 100 + 0.5) / 100 AS DECIMAL(12,2))) AS DECIMAL(18,2)) AS computed_total, CAST(any_value(floor(o_totalprice * 100 + 0.5) / 100) AS DECIMAL(12,2)) AS printed_total FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1")
def r6(spark, sf_dir):
    from ..sources.views import cents

    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("order_id")).agg(F.count("*").alias("lines"), F.sum(cents(F.col("l_extendedprice")).cast("decimal(12,2)")).cast("decimal(18,2)").alias("computed_total"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), cents(F.col("o_totalprice")).cast("decimal(12,2)").alias("printed_total"))
    return li.join(orders, "order_id")


@query("w8_report_positions", OPTIONS + ", g AS (SELECT DISTINCT sku FROM options) SELECT sku, option_no, option_no % 2 = 0 AS band FROM options JOIN g USING (sku)")
def w8(spark, sf_dir):
    return S.select_options(candidates(spark, sf_dir)).select("sku", "option_no", (F.col("option_no") % 2 == 0).alias("band"))


@query(
    "p25_likely_exact",
    SQL
    + """, w AS (SELECT *, list_distinct(list_filter(regexp_extract_all(lower(description), '[a-z0-9]+'), lambda t: length(t) > 2)) AS words, lower(coalesce(page_name || ' ', '') || array_to_string(string_split(description, ' ')[2:CAST(disc_seq % 8 AS INTEGER) + 1], ' ')) AS page FROM p)
SELECT offer_id, page_name IS NOT NULL AND coalesce(pack_qty = ordered_pack, true) AND len(words) > 0 AND len(list_filter(words, lambda t: contains(page, t))) >= 0.6 * len(words) AS likely FROM w""",
)
def p25(spark, sf_dir):
    from ..functions.text import likely_exact

    some = F.array_join(F.slice(F.split("description", " "), F.lit(2), (F.col("disc_seq") % 8).cast("int")), " ")
    return candidates(spark, sf_dir).withColumn("title", some).select("offer_id", likely_exact().alias("likely"))


MARKET_URLS = ("https://www.amazon.com/dp/B000000{n}", "https://amazon.co.uk/thing/gp/product/b00{n}00?x=1", "https://www.amazon.com/s?k={n}", "https://www.amazon.com/dp/B{n}", "https://amazon.example/dp/B000000{n}.pdf", "https://www.walmart.com/ip/thing/{n}", "https://walmart.com/browse/ip-{n}", "https://other.example/?u=https://www.amazon.com/dp/B000000{n}", "https://notamazon.com/dp/B000000{n}")


@query(
    "p48_filter_marketplace_pages",
    "WITH "
    + CANDIDATES_SQL
    + f""", u AS (SELECT *, replace((['{"', '".join(MARKET_URLS)}'])[CAST((disc_seq + sku) % {len(MARKET_URLS)} + 1 AS INTEGER)], '{{n}}', CAST(sku AS VARCHAR)) AS link FROM cands WHERE marketplace IS NOT NULL),
h AS (SELECT *, regexp_extract(link, '^https://([^/?]*)', 1) AS host FROM u)
SELECT offer_id, link AS url FROM h WHERE NOT regexp_matches(link, '(?i)[.]pdf($|[?#])') AND CASE marketplace WHEN 'amazon' THEN regexp_matches(host, '(^|[.])amazon[.]') AND regexp_matches(link, '(?i)/(dp|gp/product)/[A-Z0-9]{{8,}}') ELSE regexp_matches(host, '(^|[.])walmart[.]') AND contains(link, '/ip/') END""",
)
def p48(spark, sf_dir):
    link = F.get(F.array(*map(F.lit, MARKET_URLS)), ((F.col("disc_seq") + F.col("sku")) % len(MARKET_URLS)).cast("int"))
    return U.marketplace_pages(candidates(spark, sf_dir).filter("marketplace IS NOT NULL").withColumn("url", F.replace(link, F.lit("{n}"), F.col("sku").cast("string")))).select("offer_id", "url")


@query("p12_skip_oversized", "WITH " + CANDIDATES_SQL + " SELECT offer_id FROM cands WHERE CASE WHEN marketplace IS NULL THEN disc_seq % 1000 * 300 <= 150000 ELSE disc_seq % 1000 * 300 <= 600000 END")
def p12(spark, sf_dir):
    c = candidates(spark, sf_dir).withColumn("html_length", F.col("disc_seq") % 1000 * 300)
    return G.readable(c, F.col("html_length"), F.col("marketplace").isNotNull()).select("offer_id")


@query("s25_persist_run", SQL + "SELECT sku % 7 AS reference, sku % 7 < 4 AS replaced, count(*) AS findings FROM p WHERE sku % 7 >= 4 OR is_seed OR mpn_confirmed GROUP BY 1, 2")
def s25(spark, sf_dir):
    c = candidates(spark, sf_dir).withColumn("reference", F.col("sku") % 7)
    stored = c.select("reference", F.lit(False).alias("replaced"), "offer_id", "price")
    new = c.filter("reference < 4 AND (is_seed OR mpn_confirmed)").select("reference", F.lit(True).alias("replaced"), "offer_id", "price")
    return P.latest_run(stored, new).groupBy("reference", "replaced").agg(F.count("*").alias("findings"))
