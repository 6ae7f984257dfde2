"""Queries over candidate listings (views of the line item, part and supplier tables)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators import aggregates as A
from ..operators import caches as K
from ..operators import matching as M
from ..operators import reports as P
from ..operators import selection as S
from ..operators import urls as J
from ..operators import verdicts as E
from ..sources import files as L
from ..sources.views import CANDIDATES_SQL, LINES_SQL, candidates, order_lines, table
from .registry import query

# The rules of functions/rules.py as SQL over cands.
SQL = (
    "WITH "
    + CANDIDATES_SQL
    + """, p AS (SELECT *,
  coalesce(contains(lower(rejected_reason), 'login'), false) AS gated,
  coalesce(contains(lower(rejected_reason), 'page not found'), false) AS dead,
  coalesce(price > 0 AND price >= unit_price * 0.05 AND price <= unit_price * 3.0, false) AS sane,
  pack_match IS NOT DISTINCT FROM false OR coalesce(pack_qty <> 0 AND ordered_pack <> 0 AND pack_qty <> ordered_pack, false) AS pack_mismatch,
  coalesce(least(pack_qty, ordered_pack) > 0 AND greatest(pack_qty, ordered_pack) >= 3 * least(pack_qty, ordered_pack) AND pack_qty IS NOT NULL AND ordered_pack IS NOT NULL, false) AS pack_conflict,
  coalesce(brand_match, false) OR coalesce(brand, '') = '' AS brand_ok,
  coalesce(name_match, false) AS nm, coalesce(size_form_match, false) AS sm, coalesce(pack_match, false) AS pm, coalesce(brand_match, false) AS bm FROM cands),
q AS (SELECT *,
  coalesce(pack_qty > 0 AND ordered_pack > 0 AND price > 0 AND unit_price > 0 AND pack_qty > ordered_pack AND price < unit_price, false)
    AND NOT (gated OR out_of_stock OR price_unreliable OR variant_conflict OR match_type = 'unverified')
    AND (mpn_confirmed OR (nm AND sm)) AND (brand_ok OR mpn_confirmed) AS bulk FROM p),
r AS (SELECT *,
  price IS NOT NULL AND page_name IS NOT NULL AND NOT price_unreliable AND NOT out_of_stock AND sane AND NOT gated
    AND (bulk OR (NOT pack_mismatch AND NOT dead AND NOT variant_conflict AND (mpn_confirmed OR (NOT variant_unverified AND nm AND sm AND pm)))) AS eligible,
  (mpn_confirmed AND NOT variant_conflict AND coalesce(pack_qty = ordered_pack, true))
    OR (nm AND (sm OR (price_locked AND nm AND pm)) AND pm AND (brand_ok OR (nm AND sm AND pm))) AS eff_exact,
  coalesce(price IS NOT NULL AND price >= CASE WHEN match_type IN ('exact', 'approximate') OR mpn_confirmed THEN unit_price * 0.05 ELSE unit_price * 0.3 END
    AND price <= unit_price * 3.0 AND price < unit_price, false) AND page_name IS NOT NULL
    AND NOT (gated OR out_of_stock OR variant_conflict OR pack_conflict OR match_type IN ('rejected', 'unverified') OR dead) AS poolable,
  CAST(floor((nm::INT + sm::INT + pm::INT + bm::INT) * 15 + coalesce(confidence, 0) * 0.4 + 0.5) AS INTEGER) AS score FROM q),
s AS (SELECT *, CASE WHEN price_unreliable OR out_of_stock THEN greatest(t, 2) ELSE t END AS tier FROM (
  SELECT *, CASE WHEN eligible THEN 0 WHEN NOT pack_mismatch AND NOT variant_unverified AND coalesce(name_match, true) THEN 1 WHEN NOT pack_mismatch THEN 2 ELSE 3 END AS t FROM r))
"""
)

OPTIONS = (
    SQL
    + """, pool AS (SELECT * FROM s WHERE poolable QUALIFY row_number() OVER (PARTITION BY sku, domain ORDER BY tier, out_of_stock, price_unreliable, price, disc_seq, offer_id) = 1),
lead AS (SELECT *, eligible AND row_number() OVER (PARTITION BY sku ORDER BY NOT eligible, price, tier, out_of_stock, price_unreliable, price, disc_seq, offer_id) = 1 AS leads FROM pool),
options AS (SELECT *, row_number() OVER (PARTITION BY sku ORDER BY NOT leads, tier, out_of_stock, price_unreliable, price, disc_seq, offer_id) AS option_no FROM lead QUALIFY option_no <= 3),
saved AS (SELECT *, CAST(unit_price AS DECIMAL(12,2)) - CAST(price AS DECIMAL(12,2)) AS saved_each,
  (CAST(unit_price AS DECIMAL(12,2)) - CAST(price AS DECIMAL(12,2))) * qty AS saved_total,
  CAST(CAST(unit_price AS DECIMAL(12,2)) - CAST(price AS DECIMAL(12,2)) AS DOUBLE) / unit_price * 100 AS saved_pct FROM options)
"""
)


@query(
    "savings_report",
    OPTIONS
    + """, best AS (SELECT sku, max(saved_total) AS best_total FROM saved GROUP BY sku)
SELECT sku, option_no, site, url, price, unit_price, qty, score, CAST(saved_each AS DECIMAL(12,2)) AS saved_each, CAST(saved_total AS DECIMAL(14,2)) AS saved_total,
  CASE WHEN saved_pct > 10 THEN 'green' WHEN saved_pct >= 5 THEN 'yellow' END AS band, CAST(best_total AS DECIMAL(14,2)) AS best_total FROM saved JOIN best USING (sku)""",
)
def savings_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.savings_report(candidates(spark, sf_dir))


@query("p5_price_sanity", SQL + "SELECT offer_id, price, sane FROM p")
def p5(spark, sf_dir):
    return candidates(spark, sf_dir).select("offer_id", "price", R.sane_price().alias("sane"))


@query("p6_pack_compat", SQL + "SELECT offer_id, pack_qty = ordered_pack AS pack_ok, pack_mismatch, pack_conflict FROM p")
def p6(spark, sf_dir):
    return candidates(spark, sf_dir).select("offer_id", R.pack_compat().alias("pack_ok"), R.pack_mismatch().alias("pack_mismatch"), R.pack_conflict().alias("pack_conflict"))


@query(
    "p19_demote_mismatches",
    SQL
    + """, d AS (SELECT *, coalesce(match_type <> 'rejected', true) AS live, sane AS ok, pack_qty <> ordered_pack AS other FROM p)
SELECT offer_id, CASE WHEN live AND NOT ok THEN 'rejected' WHEN live AND other AND match_type = 'exact' THEN 'approximate' ELSE match_type END AS match_type,
  CASE WHEN live AND ok AND other THEN pack_qty || '-pack price (ordered pack ' || ordered_pack || ')' END AS pack_condition,
  CASE WHEN live AND NOT ok THEN 'price failed sanity check' ELSE rejected_reason END AS rejected_reason FROM d""",
)
def p19(spark, sf_dir):
    return M.demote_mismatches(candidates(spark, sf_dir)).select("offer_id", "match_type", "pack_condition", "rejected_reason")


@query(
    "p20_variant_pack_backstop",
    SQL + "SELECT offer_id, pack_conflict, CASE WHEN variant_conflict AND match_type = 'exact' THEN 'approximate' ELSE match_type END AS match_type FROM p",
)
def p20(spark, sf_dir):
    return M.variant_pack_backstop(candidates(spark, sf_dir)).select("offer_id", "pack_conflict", "match_type")


@query(
    "p21_consistency_guard",
    SQL
    + """SELECT offer_id, nm AND sm AND pm AND NOT bm AND coalesce(brand, '') <> '' AS generic_equivalent,
  CASE WHEN match_type = 'exact' AND (page_name IS NULL OR (coalesce(name_match, brand_match, size_form_match, pack_match) IS NOT NULL AND NOT eff_exact)) THEN 'approximate' ELSE match_type END AS match_type FROM r""",
)
def p21(spark, sf_dir):
    return M.consistency_guard(candidates(spark, sf_dir)).select("offer_id", "generic_equivalent", "match_type")


@query("p24_effective_exact", SQL + "SELECT offer_id, eff_exact FROM r")
def p24(spark, sf_dir):
    return candidates(spark, sf_dir).select("offer_id", R.effective_exact().alias("eff_exact"))


@query("p37_price_match_eligible", SQL + "SELECT offer_id, eligible, tier FROM s")
def p37(spark, sf_dir):
    return candidates(spark, sf_dir).select("offer_id", R.price_match_eligible().alias("eligible"), R.option_tier().alias("tier"))


@query("p38_bulk_value", SQL + "SELECT offer_id, bulk FROM q")
def p38(spark, sf_dir):
    return candidates(spark, sf_dir).select("offer_id", R.bulk_value().alias("bulk"))


@query("p39_poolable", SQL + "SELECT offer_id, poolable FROM r")
def p39(spark, sf_dir):
    return candidates(spark, sf_dir).select("offer_id", R.poolable().alias("poolable"))


@query("p40_report_predicates", SQL + "SELECT offer_id, gated, dead, brand_ok, price IS NOT NULL AND NOT gated AND NOT coalesce(contains(lower(rejected_reason), 'sanity'), false) AS reviewable, nm AND sm AND pm AND brand_ok AS exact_cand FROM p")
def p40(spark, sf_dir):
    return candidates(spark, sf_dir).select("offer_id", R.gated().alias("gated"), R.dead().alias("dead"), R.brand_confirmed().alias("brand_ok"), R.reviewable().alias("reviewable"), R.exact_candidate().alias("exact_cand"))


# Generic listings of house brands: gx has generic_ok and house for each row of s.
GENERIC = r""", g1 AS (SELECT *, lower(coalesce(nullif(page_name, ''), '')) AS page, lower(coalesce(description, '')) AS low,
  contains(lower(coalesce(brand, '')), 'brand#11') OR contains(lower(coalesce(brand, '')), 'brand#22') AS house,
  coalesce(pack_qty, try_cast(nullif(regexp_extract(concat_ws(' ', nullif(page_name, ''), url), '(?i)\b(\d{2,5})\s*[-/]?\s*(?:bx|box|pk|pack|ct|count|ca|case)\b', 1), '') AS INTEGER)) AS gpack FROM s),
g2 AS (SELECT *, list_filter(regexp_extract_all(low, '[a-z0-9#]+'), lambda t: len(t) > 1 AND t NOT IN ('the', 'and', 'for', 'with', 'non', 'sterile', 'premium', 'brand', 'dental', 'dentistry', 'absorbable', 'disposable', 'brand#11', 'brand#22')) AS toks,
  len(list_filter(regexp_extract_all(low, '#\s*\d+'), lambda g: NOT contains(regexp_replace(page, '\s', '', 'g'), regexp_replace(g, '\s', '', 'g')))) = 0 AS graded FROM g1),
g3 AS (SELECT *, list_filter(toks, lambda t: regexp_matches(t, '^[a-z]+$')) AS words FROM g2),
gx AS (SELECT *, nullif(page_name, '') IS NOT NULL AND sane AND NOT (gated OR out_of_stock OR price_unreliable) AND coalesce(gpack = nullif(ordered_pack, 0), false) AND graded
  AND (len(words) = 0 OR len(list_filter(words, lambda t: contains(page, t))) / len(words) >= 0.6) AND len(toks) > 0 AND len(list_filter(toks, lambda t: contains(page, t))) / greatest(len(toks), 1) >= 0.55 AS generic_ok,
  concat_ws(' · ', CASE WHEN pack_mismatch THEN 'PACK MISMATCH (page ' || coalesce(nullif(pack_qty, 0)::VARCHAR, '?') || ' vs ordered ' || coalesce(nullif(ordered_pack, 0)::VARCHAR, '?') || ')' END,
  CASE WHEN size_form_match = false THEN 'SIZE/VOLUME MISMATCH' END, CASE WHEN variant_unverified OR name_match IS NOT DISTINCT FROM false THEN 'VARIANT MISMATCH (ordered: ' || coalesce(variant, 'specified') || ')' END,
  CASE WHEN gated THEN 'LOGIN-GATED price' END, CASE WHEN dead THEN 'DEAD/EXPIRED listing' END) AS mismatch,
  nm AND sm AND pm AND NOT bm AND coalesce(brand, '') <> '' AS is_generic FROM g3)
"""

# The rows of report 1 by kind: options, ref, eq, bo, mk over the regular listings and those of marketplaces.
REPORT = (
    SQL
    + GENERIC
    + """, reg AS (SELECT * FROM gx WHERE marketplace IS NULL),
pool AS (SELECT * FROM reg WHERE poolable QUALIFY row_number() OVER (PARTITION BY sku, domain ORDER BY tier, out_of_stock, price_unreliable, price, disc_seq, offer_id) = 1),
lead AS (SELECT *, eligible AND row_number() OVER (PARTITION BY sku ORDER BY NOT eligible, price, tier, out_of_stock, price_unreliable, disc_seq, offer_id) = 1 AS leads FROM pool),
options AS (SELECT *, row_number() OVER (PARTITION BY sku ORDER BY NOT leads, tier, out_of_stock, price_unreliable, price, disc_seq, offer_id) AS no FROM lead QUALIFY no <= 3),
best AS (SELECT sku, min(price) AS least FROM options GROUP BY sku),
ref AS (SELECT *, 1 AS no FROM reg WHERE eligible AND price >= unit_price AND sku NOT IN (SELECT sku FROM options) QUALIFY row_number() OVER (PARTITION BY sku ORDER BY price, disc_seq, offer_id) = 1),
eqd AS (SELECT * FROM reg WHERE price < unit_price AND price >= unit_price * 0.05 AND page_name IS NOT NULL AND NOT (out_of_stock OR variant_conflict OR pack_conflict OR price_unreliable OR gated)
  AND (pack_qty = ordered_pack OR coalesce(pack_qty, 0) = 0 OR coalesce(ordered_pack, 0) = 0) AND sku NOT IN (SELECT sku FROM options) QUALIFY row_number() OVER (PARTITION BY sku, domain ORDER BY disc_seq, offer_id) = 1),
eq AS (SELECT *, row_number() OVER (PARTITION BY sku ORDER BY price, disc_seq, offer_id) AS no FROM eqd QUALIFY no <= 2),
late AS (SELECT *, 1 AS no FROM reg WHERE out_of_stock AND price > 0 QUALIFY row_number() OVER (PARTITION BY sku ORDER BY price, disc_seq, offer_id) = 1),
bo AS (SELECT late.* FROM late JOIN best USING (sku) WHERE price < least),
mc AS (SELECT *, CASE WHEN eligible AND (brand_ok OR mpn_confirmed) THEN 0 WHEN house AND (eligible OR generic_ok) THEN 1 ELSE 2 END AS mclass, CASE marketplace WHEN 'amazon' THEN 1 ELSE 2 END AS no FROM gx WHERE marketplace IN ('amazon', 'walmart')),
mk AS (SELECT * FROM mc WHERE mclass < 2 QUALIFY row_number() OVER (PARTITION BY sku, marketplace ORDER BY mclass, CASE WHEN mclass = 0 THEN NOT is_seed END, price, disc_seq, offer_id) = 1),
ms AS (SELECT sku, marketplace, coalesce(nullif(mismatch, ''), rejected_reason, 'not the same product and pack') AS why FROM mc WHERE page_name IS NOT NULL OR rejected_reason IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY sku, marketplace ORDER BY -score, disc_seq, offer_id) = 1),
kinds AS (SELECT *, 'OPTION' AS row_kind FROM (SELECT * EXCLUDE (leads) FROM options) UNION ALL BY NAME SELECT *, 'REFERENCE' AS row_kind FROM ref UNION ALL BY NAME SELECT *, 'EQUIVALENT' AS row_kind FROM eq
  UNION ALL BY NAME SELECT *, 'BACKORDER' AS row_kind FROM bo UNION ALL BY NAME SELECT *, 'MARKET' AS row_kind FROM mk),
labels AS (SELECT *, CAST(unit_price AS DECIMAL(12,2)) - CAST(price AS DECIMAL(12,2)) AS each, CASE WHEN out_of_stock THEN 'OUT OF STOCK (' || score || '%)' WHEN gated THEN 'GATED (' || score || '%)' WHEN price_unreliable THEN 'UNVERIFIED PRICE (' || score || '%)'
  WHEN is_generic THEN 'GENERIC EQUIVALENT (' || score || '%)' WHEN bulk THEN 'BULK VALUE (' || score || '%)'
  WHEN match_type = 'unverified' AND coalesce(name_match, brand_match, size_form_match, pack_match) IS NULL AND price IS NOT NULL THEN 'UNVERIFIED'
  WHEN nm AND sm AND pm AND brand_ok AND variant_unverified THEN 'EXACT · VARIANT UNVERIFIED (' || score || '%)' WHEN nm AND sm AND pm AND brand_ok THEN 'EXACT (' || score || '%)'
  WHEN match_type IN ('exact', 'approximate') THEN 'APPROXIMATE (' || score || '%)' ELSE 'POSSIBLE (' || score || '%)' END AS lab,
  CASE WHEN is_generic THEN 'Generic Alternative' WHEN marketplace IS NOT NULL THEN 'Marketplace' WHEN contains(domain, 'dent') THEN 'Dental Supplier' ELSE 'Other' END AS source FROM kinds)
"""
)


@query("p41_marketplace_eligible", SQL + GENERIC + "SELECT offer_id, eligible AND (brand_ok OR mpn_confirmed) AS market_ok, house, generic_ok FROM gx WHERE marketplace IS NOT NULL")
def p41(spark, sf_dir):
    c = P.complete(candidates(spark, sf_dir)).filter("marketplace IS NOT NULL")
    return c.select("offer_id", R.marketplace_eligible().alias("market_ok"), R.house_brand().alias("house"), R.generic_eligible().alias("generic_ok"))


@query("p42_match_score", SQL + "SELECT offer_id, score FROM r")
def p42(spark, sf_dir):
    return candidates(spark, sf_dir).select("offer_id", R.match_score().alias("score"))


@query(
    "p43_score_label",
    SQL
    + """SELECT offer_id, CASE WHEN out_of_stock THEN 'OUT OF STOCK (' || score || '%)' WHEN gated THEN 'GATED (' || score || '%)' WHEN price_unreliable THEN 'UNVERIFIED PRICE (' || score || '%)'
  WHEN nm AND sm AND pm AND NOT bm AND coalesce(brand, '') <> '' THEN 'GENERIC EQUIVALENT (' || score || '%)' WHEN bulk THEN 'BULK VALUE (' || score || '%)'
  WHEN match_type = 'unverified' AND coalesce(name_match, brand_match, size_form_match, pack_match) IS NULL AND price IS NOT NULL THEN 'UNVERIFIED'
  WHEN nm AND sm AND pm AND brand_ok AND variant_unverified THEN 'EXACT · VARIANT UNVERIFIED (' || score || '%)' WHEN nm AND sm AND pm AND brand_ok THEN 'EXACT (' || score || '%)'
  WHEN match_type IN ('exact', 'approximate') THEN 'APPROXIMATE (' || score || '%)' ELSE 'POSSIBLE (' || score || '%)' END AS label FROM r""",
)
def p43(spark, sf_dir):
    return candidates(spark, sf_dir).select("offer_id", R.score_label().alias("label"))


@query(
    "p44_mismatch_reason",
    SQL
    + """SELECT offer_id, concat_ws(' · ', CASE WHEN pack_mismatch THEN 'PACK MISMATCH (page ' || coalesce(nullif(pack_qty, 0)::VARCHAR, '?') || ' vs ordered ' || coalesce(nullif(ordered_pack, 0)::VARCHAR, '?') || ')' END,
  CASE WHEN size_form_match = false THEN 'SIZE/VOLUME MISMATCH' END, CASE WHEN variant_unverified OR name_match IS NOT DISTINCT FROM false THEN 'VARIANT MISMATCH (ordered: ' || coalesce(variant, 'specified') || ')' END,
  CASE WHEN gated THEN 'LOGIN-GATED price' END, CASE WHEN dead THEN 'DEAD/EXPIRED listing' END) AS reason FROM p""",
)
def p44(spark, sf_dir):
    return candidates(spark, sf_dir).select("offer_id", R.mismatch_reason().alias("reason"))


@query(
    "p45_classify_source",
    SQL
    + """SELECT site, source_type, count(*) AS offers FROM (SELECT site, CASE WHEN nm AND sm AND pm AND NOT bm AND coalesce(brand, '') <> '' THEN 'Generic Alternative' WHEN marketplace IS NOT NULL THEN 'Marketplace'
  WHEN domain = 'supplier-000000003.example' THEN 'Aggregator' WHEN domain = 'supplier-000000007.example' OR contains(domain, 'dent') THEN 'Dental Supplier' ELSE 'Other' END AS source_type FROM p) GROUP BY ALL""",
)
def p45(spark, sf_dir):
    df = candidates(spark, sf_dir).withColumn("generic_equivalent", R.generic_tag())
    df = M.classify_source(df, trusted=["supplier-000000007.example"], aggregators=["supplier-000000003.example"])
    return df.groupBy("site", "source_type").agg(F.count("*").alias("offers"))


@query("p46_savings", OPTIONS + "SELECT offer_id, CAST(saved_each AS DECIMAL(12,2)) AS saved_each, CAST(saved_total AS DECIMAL(14,2)) AS saved_total, CASE WHEN saved_pct > 10 THEN 'green' WHEN saved_pct >= 5 THEN 'yellow' END AS band FROM saved")
def p46(spark, sf_dir):
    return M.option_savings(S.select_options(candidates(spark, sf_dir))).select("offer_id", "saved_each", "saved_total", "band")


@query(
    "p50_option_reasons",
    OPTIONS
    + """SELECT offer_id, concat_ws(' · ', CASE WHEN price >= unit_price THEN 'no saving' END, CASE WHEN price_unreliable THEN 'price needs confirmation' END, CASE WHEN out_of_stock THEN 'out of stock' END,
  CASE WHEN bulk THEN 'larger pack for less: ' || pack_qty || ' instead of ' || ordered_pack WHEN nm AND sm AND pm AND NOT bm AND coalesce(brand, '') <> '' THEN 'generic equivalent of the same pack'
  WHEN nm AND sm AND pm AND brand_ok THEN 'all criteria match'
  ELSE concat_ws('; ', 'matches: ' || nullif(concat_ws(', ', CASE WHEN bm THEN 'brand' END, CASE WHEN nm THEN 'product name' END, CASE WHEN sm THEN 'form/spec' END, CASE WHEN pm THEN 'pack size' END), ''),
    'differs: ' || nullif(concat_ws(', ', CASE WHEN NOT brand_match THEN 'brand' END, CASE WHEN NOT name_match THEN 'product name' END, CASE WHEN NOT size_form_match THEN 'form/spec' END, CASE WHEN NOT pack_match THEN 'pack size' END), '')) END) AS reason FROM saved""",
)
def p50(spark, sf_dir):
    return S.select_options(candidates(spark, sf_dir)).select("offer_id", P.option_reason().alias("reason"))


@query(
    "w1_domain_cap",
    SQL + "SELECT offer_id, is_seed FROM p QUALIFY is_seed OR row_number() OVER (PARTITION BY sku, domain, is_seed ORDER BY price IS NULL, price, disc_seq, offer_id) <= 2",
)
def w1(spark, sf_dir):
    return S.domain_cap(candidates(spark, sf_dir)).select("offer_id", "is_seed")


@query("w1_cached_domain_cap", SQL + "SELECT offer_id FROM p QUALIFY row_number() OVER (PARTITION BY sku, domain ORDER BY disc_seq, offer_id) <= 2")
def w1_cached(spark, sf_dir):
    return S.cached_domain_cap(candidates(spark, sf_dir)).select("offer_id")


W2 = """, k AS (SELECT *, CASE WHEN is_seed THEN 0 WHEN known THEN 1 ELSE 2 END AS kind FROM (SELECT *, NOT price_unreliable AS known, brand_match AS trusted FROM p)),
k2 AS (SELECT *, count(*) FILTER (kind = 0) OVER (PARTITION BY sku) AS seeds,
  row_number() OVER (PARTITION BY sku, kind ORDER BY CASE WHEN kind = 1 THEN price END, CASE WHEN kind = 2 THEN NOT trusted END, disc_seq, offer_id) AS place FROM k)
SELECT offer_id, kind FROM k2 WHERE kind = 0 OR (kind = 1 AND place <= greatest(8 - seeds, 0)) OR (kind = 2 AND place <= 6)"""


@query("w2_shortlist", SQL + W2)
def w2(spark, sf_dir):
    df = candidates(spark, sf_dir).withColumn("price", F.when(~F.col("price_unreliable"), F.col("price"))).withColumn("trusted", F.col("brand_match"))
    return S.shortlist(df).select("offer_id", "kind")


@query(
    "w3_scrape_queue",
    SQL
    + """, t AS (SELECT *, CASE WHEN price_locked THEN 0 WHEN price IS NOT NULL AND NOT price_unreliable THEN 1 WHEN brand_match THEN 2 ELSE 3 END AS qt, CASE WHEN NOT price_unreliable THEN price END AS pr FROM p),
u AS (SELECT *, row_number() OVER (PARTITION BY sku ORDER BY qt, pr IS NULL, pr, disc_seq, offer_id) AS queue_place FROM t QUALIFY queue_place <= 24),
v AS (SELECT *, count(*) FILTER (NOT mpn_confirmed) OVER (PARTITION BY sku ORDER BY queue_place) AS paid_so_far FROM u)
SELECT offer_id, queue_place FROM v WHERE mpn_confirmed OR paid_so_far <= 12""",
)
def w3(spark, sf_dir):
    df = candidates(spark, sf_dir).withColumn("price", F.when(~F.col("price_unreliable"), F.col("price")))
    df = df.withColumns({"aggregator": F.col("price_locked"), "trusted": F.col("brand_match"), "paid_read": ~F.col("mpn_confirmed")})
    return S.scrape_queue(df).select("offer_id", "queue_place")


@query("w4_select_options", OPTIONS + "SELECT sku, option_no, offer_id, price, tier FROM options")
def w4(spark, sf_dir):
    return S.select_options(candidates(spark, sf_dir)).select("sku", "option_no", "offer_id", "price", "tier")


@query(
    "w5_best_exact",
    SQL
    + """, e AS (SELECT *, list(price) OVER w AS rest FROM r WHERE match_type = 'exact' AND eff_exact AND NOT (price_unreliable OR out_of_stock OR pack_match IS NOT DISTINCT FROM false OR marketplace IS NOT NULL)
  WINDOW w AS (PARTITION BY sku ORDER BY price, disc_seq, offer_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT sku, offer_id, price FROM e WHERE price >= list_sort(rest)[len(rest) // 2 + 1] * 0.25 QUALIFY row_number() OVER (PARTITION BY sku ORDER BY price, disc_seq, offer_id) = 1""",
)
def w5(spark, sf_dir):
    return S.best_exact(candidates(spark, sf_dir)).select("sku", "offer_id", "price")


@query(
    "a4_flag_low_outliers",
    SQL
    + """, n AS (SELECT *, CASE WHEN page_name IS NOT NULL AND match_type <> 'rejected' THEN price END AS counted FROM p),
m AS (SELECT sku, CASE WHEN count(counted) >= 3 THEN list_sort(list(counted) FILTER (counted IS NOT NULL))[count(counted) // 2 + 1] END AS med FROM n GROUP BY sku)
SELECT offer_id, coalesce(counted < med * 0.45, false) AND NOT price_locked AS low_outlier FROM n JOIN m USING (sku)""",
)
def a4(spark, sf_dir):
    return S.flag_low_outliers(candidates(spark, sf_dir)).select("offer_id", "low_outlier")


@query(
    "a5_flag_lock_outliers",
    SQL.replace("WITH ", "WITH RECURSIVE ", 1)
    + """, n AS (SELECT sku, list({'o': offer_id, 'p': price, 'named': page_name IS NOT NULL, 'bad': price_unreliable, 'suspect': price_locked AND NOT eff_exact} ORDER BY disc_seq, offer_id, price) AS l FROM r WHERE price IS NOT NULL GROUP BY sku),
g AS (SELECT sku, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS flags FROM n
UNION ALL SELECT sku, i + 1, CASE WHEN l[i + 1].suspect AND l[i + 1].named AND NOT l[i + 1].bad AND len(peers) >= 2 AND l[i + 1].p < list_sort(peers)[len(peers) // 2 + 1] * 0.5 THEN list_append(flags, i + 1) ELSE flags END
  FROM (SELECT g.sku, i, flags, l, list_transform(list_filter(range(1, len(l) + 1), lambda k: k <> i + 1 AND l[k].named AND NOT l[k].bad AND NOT list_contains(flags, k)), lambda k: l[k].p) AS peers FROM g JOIN n USING (sku) WHERE i < len(l)))
SELECT sku, l[k].o AS offer_id, l[k].p AS price FROM (SELECT g.sku, l, unnest(flags) AS k FROM g JOIN n USING (sku) WHERE i = len(l))""",
)
def a5(spark, sf_dir):
    return S.flag_lock_outliers(candidates(spark, sf_dir))


@query("t5_equivalents", SQL + """, e AS (SELECT * FROM p WHERE price < unit_price AND price >= unit_price * 0.05 AND page_name IS NOT NULL AND NOT (out_of_stock OR variant_conflict OR pack_conflict OR price_unreliable OR gated)
    AND (pack_qty = ordered_pack OR coalesce(pack_qty, 0) = 0 OR coalesce(ordered_pack, 0) = 0) QUALIFY row_number() OVER (PARTITION BY sku, domain ORDER BY disc_seq, offer_id) = 1)
SELECT sku, offer_id, row_number() OVER (PARTITION BY sku ORDER BY price, disc_seq, offer_id) AS equivalent_no FROM e QUALIFY equivalent_no <= 2""")
def t5(spark, sf_dir):
    return S.equivalents(candidates(spark, sf_dir)).select("sku", "offer_id", "equivalent_no")


@query(
    "t8_recheck_picks",
    SQL
    + """SELECT sku, offer_id, row_number() OVER (PARTITION BY sku ORDER BY disc_seq, offer_id) AS pick_no FROM p WHERE NOT price_locked AND (coalesce(confidence, 0) < 70 OR price_unreliable
  OR (match_type = 'exact' AND (name_match IS NOT DISTINCT FROM false OR brand_match = false OR size_form_match = false OR pack_match IS NOT DISTINCT FROM false))) QUALIFY pick_no <= 3""",
)
def t8(spark, sf_dir):
    return S.recheck_picks(candidates(spark, sf_dir)).select("sku", "offer_id", "pick_no")


@query(
    "a11_marketplace_pick",
    SQL
    + """, m AS (SELECT *, eligible AND (brand_ok OR mpn_confirmed) AS found FROM r WHERE marketplace IN ('amazon', 'walmart'))
SELECT sku, marketplace, offer_id, found, score FROM m QUALIFY row_number() OVER (PARTITION BY sku, marketplace ORDER BY NOT found, CASE WHEN found THEN NOT is_seed END, CASE WHEN found THEN price END, -score, disc_seq, offer_id) = 1""",
)
def a11(spark, sf_dir):
    return S.marketplace_pick(candidates(spark, sf_dir)).select("sku", "marketplace", "offer_id", "found", "score")


@query("u5_first_by_url", SQL + "SELECT sku, url, offer_id FROM p QUALIFY row_number() OVER (PARTITION BY sku, url ORDER BY disc_seq, offer_id) = 1")
def u5(spark, sf_dir):
    return S.first_by_url(candidates(spark, sf_dir)).select("sku", "url", "offer_id")


@query("a14_has_primary", SQL + "SELECT sku, bool_or(eligible) AS has_primary FROM r GROUP BY sku")
def a14(spark, sf_dir):
    return A.has_primary(candidates(spark, sf_dir))


@query(
    "a3_run_stats",
    OPTIONS
    + """, one AS (SELECT l.sku, o.price, o.unit_price, o.qty, o.nm AND o.sm AND o.pm AND o.brand_ok AS is_exact FROM lines l LEFT JOIN (SELECT * FROM saved WHERE option_no = 1) o USING (sku))
SELECT count(*) AS items, count(*) FILTER (is_exact) AS exact_items, count(*) FILTER (NOT is_exact) AS near_items, count(*) FILTER (price IS NULL) AS unpriced_items,
  CAST(coalesce(sum(CASE WHEN price < unit_price THEN (CAST(unit_price AS DECIMAL(12,2)) - CAST(price AS DECIMAL(12,2))) * qty END), 0) AS DECIMAL(18,2)) AS savings,
  (SELECT count(*) FROM lines WHERE sku % 6 = 3) AS alternate_items FROM one""",
)
def a3(spark, sf_dir):
    return A.run_stats(order_lines(spark, sf_dir), S.select_options(candidates(spark, sf_dir)), _findings(spark, sf_dir))


@query("a10_group_best_savings", OPTIONS + "SELECT l.sku, CAST(max(saved_total) AS DECIMAL(14,2)) AS best_total FROM lines l LEFT JOIN saved USING (sku) GROUP BY l.sku")
def a10(spark, sf_dir):
    return A.group_best_savings(order_lines(spark, sf_dir), M.option_savings(S.select_options(candidates(spark, sf_dir))))


@query("j14_exclude_shown", OPTIONS + "SELECT offer_id FROM p WHERE NOT EXISTS (SELECT 1 FROM options o WHERE o.sku = p.sku AND o.url = p.url)")
def j14(spark, sf_dir):
    c = candidates(spark, sf_dir)
    return P.exclude_shown(c, S.select_options(c)).select("offer_id")


OPTION_REASON = """concat_ws(' · ', CASE WHEN price >= unit_price THEN 'no saving' END, CASE WHEN price_unreliable THEN 'price needs confirmation' END, CASE WHEN out_of_stock THEN 'out of stock' END,
  CASE WHEN bulk THEN 'larger pack for less: ' || pack_qty || ' instead of ' || ordered_pack WHEN is_generic THEN 'generic equivalent of the same pack' WHEN nm AND sm AND pm AND brand_ok THEN 'all criteria match'
  ELSE concat_ws('; ', 'matches: ' || nullif(concat_ws(', ', CASE WHEN bm THEN 'brand' END, CASE WHEN nm THEN 'product name' END, CASE WHEN sm THEN 'form/spec' END, CASE WHEN pm THEN 'pack size' END), ''),
    'differs: ' || nullif(concat_ws(', ', CASE WHEN NOT brand_match THEN 'brand' END, CASE WHEN NOT name_match THEN 'product name' END, CASE WHEN NOT size_form_match THEN 'form/spec' END, CASE WHEN NOT pack_match THEN 'pack size' END), '')) END)"""


def _reported(spark, sf_dir):
    """Listings with a backorder of those that are out of stock."""
    late = F.array(F.struct("price", F.lit("Backordered").alias("status"), F.col("site").alias("vendor")))
    return candidates(spark, sf_dir).withColumn("backorder", F.when(F.col("out_of_stock"), late))


@query(
    "r1_price_match",
    REPORT
    + f""", t AS (SELECT sku, row_kind, CAST(no AS INTEGER) AS row_no, offer_id, description, qty, unit_price, price AS found_price,
  CASE row_kind WHEN 'OPTION' THEN lab WHEN 'REFERENCE' THEN 'REFERENCE — ' || lab WHEN 'EQUIVALENT' THEN CASE WHEN confidence > 0 THEN 'EQUIVALENT (' || confidence || '%)' ELSE 'EQUIVALENT' END WHEN 'MARKET' THEN upper(marketplace) ELSE row_kind END AS score_label,
  site, CASE WHEN row_kind = 'MARKET' THEN CASE WHEN NOT (eligible AND (brand_ok OR mpn_confirmed)) THEN 'Generic/Equivalent' ELSE 'Marketplace' END ELSE source END AS source_type, url,
  CASE row_kind WHEN 'OPTION' THEN {OPTION_REASON} WHEN 'REFERENCE' THEN 'no cheaper supplier: $' || CAST(-each AS DECIMAL(12,2)) || ' above the unit price' WHEN 'BACKORDER' THEN 'BACKORDERED via ' || site
    WHEN 'EQUIVALENT' THEN 'another brand of the same kind, verify' || CASE WHEN pack_qty IS NULL THEN ' · pack not confirmed' ELSE '' END
    ELSE CASE WHEN NOT (eligible AND (brand_ok OR mpn_confirmed)) THEN 'generic equivalent, verify before substituting · ' ELSE '' END || '$' || CAST(abs(each) AS DECIMAL(12,2)) || CASE WHEN each > 0 THEN ' below the unit price' ELSE ' above the unit price, for reference' END END AS note,
  CASE WHEN row_kind IN ('OPTION', 'BACKORDER', 'EQUIVALENT') OR (row_kind = 'MARKET' AND each > 0) THEN each END AS saved FROM labels
UNION ALL SELECT sku, 'NO SUPPLIER MATCH', 1, NULL, description, qty, unit_price, NULL, 'NO SUPPLIER MATCH', NULL, 'Other', NULL, 'no public listing passed', NULL FROM lines WHERE sku NOT IN (SELECT sku FROM options) AND sku NOT IN (SELECT sku FROM ref)
UNION ALL SELECT l.sku, 'MARKET', m.no, NULL, l.description, l.qty, l.unit_price, NULL, upper(m.name), m.name, 'Marketplace', NULL,
  'not found: ' || CASE WHEN (l.sku, m.name) NOT IN (SELECT (sku, marketplace) FROM mc) THEN 'no listing found' WHEN ms.why IS NULL THEN 'listings found, none could be read' ELSE 'closest listing: ' || ms.why END, NULL
  FROM lines l CROSS JOIN (VALUES (1, 'amazon'), (2, 'walmart')) m(no, name) LEFT JOIN ms ON ms.sku = l.sku AND ms.marketplace = m.name WHERE (l.sku, m.name) NOT IN (SELECT (sku, marketplace) FROM mk))
SELECT sku, row_kind, row_no, offer_id, description, qty, unit_price, found_price, score_label, site, source_type, url, note, unit_price AS list_price, found_price AS best_price,
  CAST(saved AS DECIMAL(12,2)) AS saved_each, CAST(saved * qty AS DECIMAL(14,2)) AS saved_total, CAST(NULL AS VARCHAR) AS mpn, CAST(NULL AS VARCHAR) AS pack_condition FROM t""",
)
def r1(spark, sf_dir):
    return P.price_match(order_lines(spark, sf_dir), _reported(spark, sf_dir))


def _findings(spark, sf_dir, spread=False):
    """Of every second line an equivalent, its neighbour; close for every third line."""
    lines = order_lines(spark, sf_dir, spread)
    entries = lines.filter("sku % 2 = 1").select("sku", (F.col("sku") - 1).alias("equivalent"))
    levels = lines.filter("sku % 3 = 0").select("sku", F.lit("close").alias("level"))
    return E.equivalency_findings(lines, entries, candidates(spark, sf_dir, spread), levels)


FINDINGS = """, few AS (SELECT *, row_number() OVER (PARTITION BY sku ORDER BY disc_seq, offer_id) AS k FROM s WHERE price IS NOT NULL QUALIFY k <= 3), cheap AS (SELECT * FROM few QUALIFY row_number() OVER (PARTITION BY sku ORDER BY price, k) = 1),
found AS (SELECT l.sku, l.description, l.unit_price, l.sku - 1 AS equivalent, CASE WHEN l.sku % 3 = 0 THEN 'close' ELSE 'possible_alternative' END AS level, c.offer_id, c.price, c.site, c.url FROM lines l LEFT JOIN cheap c ON c.sku = l.sku - 1 WHERE l.sku % 2 = 1)
"""


@query(
    "r2_alternates",
    REPORT
    + FINDINGS
    + """, shown AS (SELECT sku, url FROM options UNION SELECT sku, url FROM ref),
u AS (SELECT * FROM reg WHERE sku NOT IN (SELECT sku FROM found WHERE level = 'close') QUALIFY row_number() OVER (PARTITION BY sku, url ORDER BY disc_seq, offer_id) = 1),
v AS (SELECT *, CASE WHEN price IS NOT NULL AND NOT gated AND NOT coalesce(contains(lower(rejected_reason), 'sanity'), false) THEN CASE match_type WHEN 'exact' THEN 0 WHEN 'approximate' THEN 1 WHEN 'rejected' THEN 2 ELSE 3 END
  WHEN price IS NULL AND NOT gated THEN 8 END AS alt_tier FROM u WHERE NOT EXISTS (SELECT 1 FROM shown o WHERE o.sku = u.sku AND o.url = u.url)),
w AS (SELECT * FROM v WHERE alt_tier IS NOT NULL)
SELECT sku, description, unit_price, CAST(equivalent AS VARCHAR) AS equivalent, site, 'Generic/Equivalent' AS source_type, price, url, 'CLOSE (table)' AS score_label, 'equivalency table' AS basis,
  CAST(CAST(unit_price AS DECIMAL(12,2)) - CAST(price AS DECIMAL(12,2)) AS DECIMAL(12,2)) AS saved_each, -1 AS alt_tier, offer_id FROM found WHERE level = 'close'
UNION ALL SELECT sku, description, unit_price, page_name, site, CASE WHEN is_generic THEN 'Generic Alternative' WHEN contains(domain, 'dent') THEN 'Dental Supplier' ELSE 'Other' END, price, url,
  CASE alt_tier WHEN 8 THEN 'NOT PRICED' ELSE ['EXACT', 'APPROXIMATE', 'POSSIBLE', 'UNVERIFIED'][alt_tier + 1] || ' (' || score || '%)' END,
  CASE alt_tier WHEN 8 THEN 'found but not priced' ELSE concat_ws(' · ', nullif(mismatch, ''), rejected_reason) END, CAST(CAST(unit_price AS DECIMAL(12,2)) - CAST(price AS DECIMAL(12,2)) AS DECIMAL(12,2)), alt_tier, offer_id FROM w
UNION ALL SELECT sku, description, unit_price, NULL, NULL, 'Other', NULL, NULL, 'POSSIBLE (0%)', 'no usable public listing found', NULL, 9, NULL FROM lines
  WHERE sku NOT IN (SELECT sku FROM w) AND sku NOT IN (SELECT sku FROM reg WHERE eligible) AND sku NOT IN (SELECT sku FROM found WHERE level = 'close')""",
)
def r2(spark, sf_dir):
    # the candidates are read four times: broadcast lines would fill the driver
    return P.alternates(order_lines(spark, sf_dir, True), candidates(spark, sf_dir, True), _findings(spark, sf_dir, True))


def _written(spark, sf_dir, name: str):
    """A report table of orders (sku % 7) as read back after a first run of all and a second one of two orders, of which half the lines are left."""
    # alternates read the candidates five times a run: broadcast lines would fill the driver
    spread = name == "alternates"
    lines = order_lines(spark, sf_dir, spread)
    orders = lines.select(F.concat(F.lit("PO "), (F.col("sku") % 7).cast("string")).alias("reference"), "sku")
    again = orders.filter("sku % 7 < 2 AND sku div 7 % 2 = 0")
    at = L.shared_folder(spark, "reports")
    for of in (orders, again):
        P.write_reports(P.run_reports(of, lines, candidates(spark, sf_dir, spread), _findings(spark, sf_dir, spread), names=(name,)), at)
    return spark.read.parquet(f"{at}/{name}")


WRITTEN = " CROSS JOIN LATERAL (SELECT 'PO ' || (sku % 7) AS reference) WHERE sku % 7 > 1 OR sku // 7 % 2 = 0"


@query(
    "s22_write_price_match",
    REPORT
    + """, t AS (SELECT sku, row_kind, CAST(no AS INTEGER) AS row_no, offer_id, price AS found_price FROM kinds WHERE row_kind <> 'BACKORDER'
UNION ALL SELECT sku, 'NO SUPPLIER MATCH', 1, NULL, NULL FROM lines WHERE sku NOT IN (SELECT sku FROM options) AND sku NOT IN (SELECT sku FROM ref)
UNION ALL SELECT l.sku, 'MARKET', m.no, NULL, NULL FROM lines l CROSS JOIN (VALUES (1, 'amazon'), (2, 'walmart')) m(no, name) WHERE (l.sku, m.name) NOT IN (SELECT (sku, marketplace) FROM mk))
SELECT reference, sku, row_kind, row_no, offer_id, found_price FROM t"""
    + WRITTEN,
)
def s22(spark, sf_dir):
    return _written(spark, sf_dir, "price_match").select("reference", "sku", "row_kind", "row_no", "offer_id", "found_price")


@query(
    "s23_write_alternates",
    REPORT
    + FINDINGS
    + """, shown AS (SELECT sku, url FROM options UNION SELECT sku, url FROM ref),
u AS (SELECT * FROM reg WHERE sku NOT IN (SELECT sku FROM found WHERE level = 'close') QUALIFY row_number() OVER (PARTITION BY sku, url ORDER BY disc_seq, offer_id) = 1),
w AS (SELECT sku, offer_id, price, CASE match_type WHEN 'exact' THEN 0 WHEN 'approximate' THEN 1 WHEN 'rejected' THEN 2 ELSE 3 END AS alt_tier FROM u WHERE NOT gated AND NOT coalesce(contains(lower(rejected_reason), 'sanity'), false) AND NOT EXISTS (SELECT 1 FROM shown o WHERE o.sku = u.sku AND o.url = u.url)),
t AS (SELECT sku, offer_id, price, -1 AS alt_tier FROM found WHERE level = 'close' UNION ALL SELECT sku, offer_id, price, alt_tier FROM w
UNION ALL SELECT sku, NULL, NULL, 9 FROM lines WHERE sku NOT IN (SELECT sku FROM w) AND sku NOT IN (SELECT sku FROM reg WHERE eligible) AND sku NOT IN (SELECT sku FROM found WHERE level = 'close'))
SELECT reference, sku, offer_id, price, alt_tier FROM t"""
    + WRITTEN,
)
def s23(spark, sf_dir):
    return _written(spark, sf_dir, "alternates").select("reference", "sku", "offer_id", "price", "alt_tier")


@query("s24_write_evidence", SQL + "SELECT reference, sku, offer_id, price, match_type, score FROM (SELECT sku, offer_id, price, match_type, score FROM r UNION ALL SELECT sku, NULL, NULL, 'none', 0 FROM lines WHERE sku NOT IN (SELECT sku FROM r))" + WRITTEN)
def s24(spark, sf_dir):
    return _written(spark, sf_dir, "evidence").select("reference", "sku", "offer_id", "price", "match_type", "score")


@query(
    "r3_evidence",
    SQL + """SELECT sku, description, unit_price, CAST(NULL AS VARCHAR) AS title, site, CASE WHEN nm AND sm AND pm AND NOT bm AND coalesce(brand, '') <> '' THEN 'Generic Alternative' WHEN marketplace IS NOT NULL THEN 'Marketplace' WHEN contains(domain, 'dent') THEN 'Dental Supplier' ELSE 'Other' END AS source_type,
  url, price, pack_qty, CAST(NULL AS VARCHAR) AS pack_condition, match_type, score, confidence, CASE name_match WHEN true THEN 'Y' WHEN false THEN 'N' ELSE '' END AS name_yn, CASE brand_match WHEN true THEN 'Y' WHEN false THEN 'N' ELSE '' END AS brand_yn,
  CASE size_form_match WHEN true THEN 'Y' WHEN false THEN 'N' ELSE '' END AS size_yn, CASE pack_match WHEN true THEN 'Y' WHEN false THEN 'N' ELSE '' END AS pack_yn, rejected_reason AS notes, offer_id FROM r
UNION ALL SELECT sku, description, unit_price, 'no public candidate found', NULL, 'Other', NULL, NULL, NULL, NULL, 'none', 0, 0, '', '', '', '', NULL, NULL FROM lines WHERE sku NOT IN (SELECT sku FROM r)""",
)
def r3(spark, sf_dir):
    return P.evidence(order_lines(spark, sf_dir), candidates(spark, sf_dir))


@query("r4_equivalency_table", SQL + FINDINGS + "SELECT sku, description, equivalent, replace(level, '_', ' ') AS level, site, url, price, CASE WHEN level IN ('exact', 'close') THEN 'alternates' ELSE 'evidence only, manual review' END AS routed_to FROM found")
def r4(spark, sf_dir):
    return P.equivalency_table(order_lines(spark, sf_dir), _findings(spark, sf_dir))


@query("r5_flagged_sites", SQL + "SELECT sku, site, count(*) AS listings FROM p WHERE gated GROUP BY ALL")
def r5(spark, sf_dir):
    return candidates(spark, sf_dir).filter(R.gated()).groupBy("sku", "site").agg(F.count("*").alias("listings"))


@query("s26_upsert_latest", SQL + "SELECT url, offer_id, price FROM p QUALIFY row_number() OVER (PARTITION BY url ORDER BY ts DESC, disc_seq DESC, offer_id DESC) = 1")
def s26(spark, sf_dir):
    c = candidates(spark, sf_dir).select("url", "offer_id", "price", "ts", "disc_seq")
    old, new = c.filter("disc_seq % 2 = 0"), c.filter("disc_seq % 2 = 1")
    return K.upsert_latest(old, new, ["url"], ["ts", "disc_seq", "offer_id"]).select("url", "offer_id", "price")


@query(
    "j9_serve_cached_pages",
    SQL
    + """, c AS (SELECT url, max(ts) AS cached_at FROM p WHERE disc_seq % 2 = 0 GROUP BY url)
SELECT offer_id, cached_at IS NOT NULL AND NOT price_locked AND cached_at >= ts - INTERVAL 90 DAY AND cached_at <= ts AS hit FROM p LEFT JOIN c USING (url)""",
)
def j9(spark, sf_dir):
    c = candidates(spark, sf_dir)
    pages = c.filter("disc_seq % 2 = 0").groupBy("url").agg(F.max("ts").alias("cached_at"))
    asked = c.withColumn("ttl_hours", F.when(F.col("price_locked"), 0).otherwise(90 * 24)).select("offer_id", "url", "ttl_hours", F.col("ts").alias("asked_at"))
    return K.serve_cached(asked, pages).select("offer_id", "hit")


@query("j1_apply_mpn", SQL + ", m AS (SELECT sku, max(disc_seq) AS d FROM p WHERE mpn_confirmed GROUP BY sku) SELECT l.sku, 'M' || m.d AS mpn, m.d % 2 = 0 AS mpn_verified FROM lines l LEFT JOIN m USING (sku)")
def j1(spark, sf_dir):
    store = candidates(spark, sf_dir).filter("mpn_confirmed").groupBy("sku").agg(F.max("disc_seq").alias("d"))
    store = store.select("sku", F.concat(F.lit("M"), F.col("d").cast("string")).alias("mpn"), F.when(F.col("d") % 2 == 0, "verified").otherwise("seed").alias("status"))
    return K.apply_mpn(order_lines(spark, sf_dir), store).select("sku", "mpn", F.when(F.col("mpn").isNotNull(), F.col("mpn_verified")).alias("mpn_verified"))


@query(
    "j11_fuzzy_storefront_match",
    """WITH x AS (SELECT p_partkey AS sku, lower(concat_ws(' ', p_name, p_type, replace(p_brand, '#', ''), 's' || p_size)) AS s FROM part),
t AS (SELECT DISTINCT sku, unnest(regexp_extract_all(s, '[a-z0-9]{2,}')) AS tok FROM x), n AS (SELECT sku, count(*) AS n FROM t GROUP BY sku),
a AS (SELECT sku, tok FROM t WHERE len(tok) >= 4 AND NOT regexp_matches(tok, '^\\d+$') AND tok NOT IN (PLAIN)),
g AS (SELECT p_partkey AS sku, s_suppkey AS shop FROM part, supplier EXCEPT SELECT l_partkey, l_suppkey FROM lineitem),
f AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY sku ORDER BY shop) <= 12),
c AS (SELECT DISTINCT l_suppkey AS shop, l_partkey AS item FROM lineitem),
m AS (SELECT a.sku, b.sku AS item, count(*) AS hits FROM t a JOIN t b USING (tok) GROUP BY ALL HAVING count(*) >= 3),
k AS (SELECT m.* FROM m JOIN n USING (sku) WHERE hits >= greatest(3, n // 3) AND (sku NOT IN (SELECT sku FROM a) OR EXISTS (SELECT 1 FROM a JOIN t USING (tok) WHERE a.sku = m.sku AND t.sku = m.item)))
SELECT k.sku, shop, item, hits FROM k JOIN c USING (item) JOIN f USING (sku, shop) QUALIFY row_number() OVER (PARTITION BY k.sku, shop ORDER BY hits DESC, item) <= 2""".replace("PLAIN", ", ".join(f"'{x}'" for x in J.PLAIN_WORDS)),
)
def j11(spark, sf_dir):
    part, li = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    text = F.concat_ws(" ", "p_name", "p_type", F.replace("p_brand", F.lit("#"), F.lit("")), F.concat(F.lit("s"), F.col("p_size").cast("string")))
    lines = part.select(F.col("p_partkey").alias("sku"), text.alias("text"), J.anchors(text).alias("anchors"))
    sold = li.select(F.col("l_suppkey").alias("shop"), F.col("l_partkey").alias("item")).distinct()
    catalog = sold.join(part.select(F.col("p_partkey").alias("item"), text.alias("title")), "item")
    site = lambda c: F.concat(F.lit("s"), F.col(c).cast("string"), F.lit(".example"))
    sites = table(spark, sf_dir, "supplier").select(site("s_suppkey").alias("domain"), F.col("s_suppkey").alias("place"))
    seen = sold.select(F.col("item").alias("sku"), F.concat(F.lit("https://"), site("shop"), F.lit("/")).alias("url"))
    # only the first dozen shops of each line are expanded
    shops = J.supplier_gap(seen, sites, lines, first=12, order="place").select("sku", F.col("place").alias("shop"), "place")
    return K.fuzzy_match(lines, catalog, shops).select("sku", "shop", "item", "hits")


@query(
    "a7_mpn_conflicts",
    "WITH " + LINES_SQL + " SELECT brand || variant AS number, count(*) AS lines, count(DISTINCT description) AS texts FROM lines GROUP BY 1 HAVING count(*) > 1 AND count(DISTINCT description) > 1",
)
def a7(spark, sf_dir):
    return A.mpn_conflicts(order_lines(spark, sf_dir).withColumn("number", F.concat("brand", "variant"))).select("number", "lines", "texts")


@query(
    "a6_mpn_consensus",
    SQL
    + """, c AS (SELECT sku, brand_match::VARCHAR || (disc_seq % 5) AS number, count(*) AS n, min(disc_seq) AS first FROM p WHERE nm AND page_name IS NOT NULL GROUP BY ALL)
SELECT sku, number, n FROM c WHERE n >= 2 QUALIFY row_number() OVER (PARTITION BY sku ORDER BY n DESC, first, number) = 1""",
)
def a6(spark, sf_dir):
    c = candidates(spark, sf_dir).withColumn("declared", F.concat(F.col("brand_match").cast("string"), (F.col("disc_seq") % 5).cast("string")))
    return A.mpn_consensus(c)
