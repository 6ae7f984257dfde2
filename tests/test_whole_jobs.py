"""Queries and operators do the whole job, not a part of it."""

from oracle import SF, assert_same, connect

from bidscout.operators import caches as K
from bidscout.operators import urls as J
from bidscout.plans.registry import ORACLES, QUERIES

SF2 = SF.replace("sf0.001", "sf0.01")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_gaps_of_every_supplier(spark):
    got = QUERIES["j7_supplier_gap"](spark, SF2)
    assert got.select("domain").distinct().count() == spark.read.parquet(f"{SF2}/supplier.parquet").count()
    assert_same(spark, connect(SF2), SF2, "j7_supplier_gap", QUERIES["j7_supplier_gap"], ORACLES["j7_supplier_gap"])


def test_gaps_are_words_of_bits(spark):
    """Lines and sites aren't paired: 130 sites are three words a line, whose bits are the missing ones."""
    n, sites = 130, [(f"s{i:03}.example",) for i in range(130)]
    lines = spark.range(10).withColumnRenamed("id", "sku")
    found = {k: {k, 63, 64, 127, 128, 129} if k % 2 else ({k} if k else set()) for k in range(10)}
    cands = spark.createDataFrame([(k, f"https://www.s{i:03}.example/p") for k, own in found.items() for i in own for _ in range(2)], "sku long, url string")
    sites = spark.createDataFrame(sites, "domain string")
    rows = J.site_gaps(cands, J.numbered_sites(sites), lines)
    assert {r.sku: (len(r.missing), r.n_missing) for r in rows.collect()} == {k: (3, n - len(own)) for k, own in found.items()}
    got = J.supplier_gap(cands, sites, lines)
    assert "Cross" not in plan(rows) and "Generate explode(sequence" not in plan(rows)
    want = sorted((k, f"s{i:03}.example") for k, own in found.items() for i in range(n) if i not in own)
    assert sorted((r.sku, r.domain) for r in got.collect()) == want
    few = J.supplier_gap(cands, sites, lines, first=3)
    assert sorted((r.sku, r.domain) for r in few.collect()) == sorted(x for k in range(10) for x in [w for w in want if w[0] == k][:3])
    assert J.supplier_gap(cands, sites.filter("false"), lines).isEmpty()


def brute_lock(prices, suspect):
    flags = []
    for i, p in enumerate(prices):
        peers = sorted(q for k, q in enumerate(prices) if k != i and k not in flags)
        if suspect[i] and len(peers) >= 2 and p < peers[len(peers) // 2] * 0.5:
            flags.append(i)
    return flags


def test_lock_outliers_of_a_large_line(spark):
    """Removed rows shrink the peers of later ones; a line of 10,000 rows takes log n a row."""
    import numpy as np
    from pyspark.sql import functions as F

    from bidscout.operators import selection as S

    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 4, 7, 60, 300):
        for _ in range(20):
            prices, suspect = rng.integers(1, 40, n).astype(float), rng.random(n) < 0.6
            assert S.lock_outliers_of(prices, suspect) == brute_lock(prices.tolist(), suspect.tolist())
    n = 10_000
    prices, suspect = np.round(rng.exponential(20, n), 2) + 1, rng.random(n) < 0.5
    rows = [("hot", i, f"o{i:05}", float(prices[i]), bool(suspect[i])) for i in range(n)] + [(f"k{i}", 0, "a", 5.0, True) for i in range(30)]
    df = spark.createDataFrame(rows, "sku string, disc_seq long, offer_id string, price double, price_locked boolean").repartition(7)
    no = {c: F.lit(False) for c in ("name_match", "brand_match", "size_form_match", "pack_match", "price_unreliable", "variant_conflict", "mpn_confirmed")}
    df = df.withColumns(no | {"page_name": F.lit("p"), "description": F.lit("d"), "brand": F.lit("b"), "pack_qty": F.lit(1), "ordered_pack": F.lit(2)})
    got = sorted(int(r.offer_id[1:]) for r in S.flag_lock_outliers(df).collect())
    assert got == S.lock_outliers_of(prices, suspect) and len(got) > 500


def test_storefront_by_shop(spark):
    words = [f"w{i}" for i in range(11)]
    lines = spark.createDataFrame([(1, " ".join(words), ["w0"])], "sku long, text string, anchors array<string>")
    catalog = [(s, 10 * s + i, "w0 w1 w2") for s in range(1, 15) for i in range(3)] + [(1, 99, "w3 w4 w5 w6"), (2, 98, "w0 w1")]
    shops = spark.createDataFrame([(1, s, s) for s in range(1, 15)], "sku long, shop long, place long")
    got = K.fuzzy_match(lines, spark.createDataFrame(catalog, "shop long, item long, title string"), shops)
    assert sorted(map(tuple, got.collect())) == [(1, s, 10 * s + i, 3) for s in range(1, 13) for i in range(2)]
