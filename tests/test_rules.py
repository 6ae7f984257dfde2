"""Cases with known answers, in small tables."""

from pyspark.sql import functions as F

from bidscout.functions import rules as R
from bidscout.functions import text as T
from bidscout.functions import urls as U
from bidscout.operators import caches as K
from bidscout.operators import selection as S
from bidscout.operators import urls as J
from bidscout.sources import feeds as D
from bidscout.sources import orders as O
from bidscout.sources import pages as P


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first()["x"]


def test_canonical_url(spark):
    assert one(spark, U.canonical(F.col("u")), u="https://s.example/p?variant=1&utm_source=g&srsltid=z&ref=x#top") == "https://s.example/p?variant=1"
    assert one(spark, U.canonical(F.col("u")), u="https://s.example/p?utm_source=g") == "https://s.example/p"


def test_categories(spark):
    known = {"https://x.example/fluoride-products/c/215": True, "https://x.example/collections/a/products/b": False, "https://x.example/": True, "https://blog.x.example/y": True, "https://x.example/a-t-12": True, "https://x.example/shop?pid=3": False}
    for url, want in known.items():
        assert one(spark, U.is_category(F.col("u")), u=url) is want, url


def test_packs_and_volumes(spark):
    packs = {"100/Bx": (100, "Bx"), "12 PK": (12, "Pk"), "2x445 Gr": (2, None), "59ml/Bt": (None, None)}
    for text, want in packs.items():
        assert tuple(one(spark, T.pack_of(F.col("t")), t=text)) == want, text
    assert one(spark, T.volume_compat(F.col("a"), F.col("b")), a="2 L", b="2010 ml") is True
    assert one(spark, T.volume_compat(F.col("a"), F.col("b")), a="2 L", b="5 l") is False
    assert one(spark, T.volume_compat(F.col("a"), F.col("b")), a="2 L", b="bottle") is None


def test_prices_in_text(spark):
    assert float(one(spark, T.sale_price(F.lit(22.99), F.col("t")), t="Was: $22.99 Now: $13.99")) == 13.99
    assert one(spark, T.sale_price(F.lit(13.99), F.col("t")), t="Was: $22.99 Now: $13.99") is None
    assert float(one(spark, T.public_price(F.col("t")), t="YOUR PRICE $65.64 VIP PRICE $63.42")) == 65.64
    assert one(spark, T.grounded(F.lit(18.15), F.col("t")), t="now $18 each") is True
    assert one(spark, T.grounded(F.lit(25.00), F.col("t")), t="now $18 each") is False
    assert one(spark, T.grounded(F.lit(25.00), F.col("t")), t="no price") is True
    masked = one(spark, T.without_wrong_packs(F.col("t"), F.lit(100)), t="100-pack $272.99 and more, 50-pack $137.49")
    assert masked == "100-pack $272.99 and more, 50-pack $—"


def test_login(spark):
    gate = lambda t: one(spark, T.login_gated(F.col("t"), F.lit(False)), t=t)
    assert gate("Login to see price, others from $24.95") is True
    assert gate("sign in for contract pricing, list $133.95") is False


def cands(spark, rows):
    kinds = "sku int, offer_id string, disc_seq long, price double, unit_price double, match_type string, page_name string, domain string, price_locked boolean"
    df = spark.createDataFrame([(1, str(i), i, p, 100.0, m, "n", f"d{i}", lock) for i, (p, m, lock) in enumerate(rows)], kinds)
    no = F.lit(None).cast("boolean")
    more = {c: no for c in ("name_match", "brand_match", "size_form_match", "pack_match", "price_unreliable", "out_of_stock", "variant_conflict", "mpn_confirmed")}
    return df.withColumns(more | {"pack_qty": F.lit(None).cast("int"), "ordered_pack": F.lit(None).cast("int"), "brand": F.lit(None).cast("string"), "marketplace": F.lit(None).cast("string"), "rejected_reason": F.lit(None).cast("string")})


def test_low_outliers(spark):
    out = S.flag_low_outliers(cands(spark, [(24.99, "exact", False), (250.0, "exact", False), (275.0, "exact", False), (300.0, "exact", False)]))
    assert {r.price for r in out.filter("low_outlier").collect()} == {24.99}
    assert out.select("line_median").first()[0] == 275.0


def test_lock_outliers(spark):
    hit = S.flag_lock_outliers(cands(spark, [(174.0, "exact", True), (581.0, "exact", False), (590.0, "exact", False)]))
    assert [r.price for r in hit.collect()] == [174.0]
    kept = S.flag_lock_outliers(cands(spark, [(10.0, "exact", True), (16.0, "exact", False), (18.0, "exact", False)]))
    assert kept.count() == 0


def test_best_exact(spark):
    for prices, want in (((24.95, 241.0), 241.0), ((34.95, 76.0), 34.95)):
        df = cands(spark, [(p, "exact", False) for p in prices]).withColumn("mpn_confirmed", F.lit(True))
        assert S.best_exact(df).first()["price"] == want


SELLERS = """**$41.94**/ea
Vendor options
[Alpha Supply](https://m.example/vendor/alpha-supply/1 "x")
Stocked. **$41.94**/ea + FREE Standard Shipping
$41.94
Add to Cart
[Beta Goods](https://m.example/vendor/beta-goods/2)
**$36.00**/ea + $9.95 Shipping
1 @ $36.00, 2 @ $20.00
Add to Cart
[Gamma](https://m.example/vendor/gamma/3)
Backordered **$26.73**/ea
$26.73LOWEST PRICE
"""


def test_seller_tables(spark):
    pages = spark.createDataFrame([("u", SELLERS)], "url string, text string")
    rows = P.seller_rows(pages)
    assert [(float(r.total), r.vendor, r.status is None) for r in rows.orderBy("seller_no").collect()] == [(41.94, "Alpha Supply", True), (36.0, "Beta Goods", True), (26.73, "Gamma", False)]
    got = P.aggregator_price(rows, pages).first()
    assert (float(got.price), got.badge, got.n_rows, len(got.backorder)) == (36.0, False, 2, 1)
    badge = spark.createDataFrame([("u", SELLERS.replace("Backordered", "Stocked"))], "url string, text string")
    got = P.aggregator_price(P.seller_rows(badge), badge).first()
    assert (float(got.price), got.badge, got.n_rows) == (26.73, True, 3)
    assert float(P.seller_rows(pages, include_shipping=True).filter("vendor = 'Beta Goods'").first().total) == 45.95


def test_a_page_of_many_sellers(spark):
    """Each piece is cut once: a table of 3,000 sellers is no more work for a seller than one of 30."""
    rows = "".join(f"[S{i}](https://m.example/vendor/s-{i}/1) Stocked **${i + 1}.00**/ea\nAdd to Cart\n" for i in range(3_000))
    pages = spark.createDataFrame([("u", "Vendor options\n" + rows)], "url string, text string")
    got = P.seller_rows(pages).agg(F.count("*").alias("n"), F.sum("total").alias("sum"), F.count_distinct("vendor").alias("vendors")).first()
    assert (got.n, float(got["sum"]), got.vendors) == (3_000, 3_000 * 3_001 / 2, 3_000)


def test_badge_beside_another_total(spark):
    """A badge's own amount counts, unless its seller has no stock; a lock keeps what other candidates have."""
    text = "[A](/vendor/a-one/1) Stocked $30.00/ea shipping surcharge $2.00\n$31.00LOWEST PRICE\n[B](/vendor/b-two/2) Backordered $29.00/ea\n$20.00 lowest price"
    pages = spark.createDataFrame([("u", text)], "url string, text string")
    got = P.aggregator_price(P.seller_rows(pages), pages)
    row = got.first()
    assert (float(row.price), row.badge, float(row.badge_price), row.n_rows, [float(o.total) for o in row.backorder]) == (31.0, True, 31.0, 1, [29.0])
    rows = [("u", 99.0, None, None, [], "old"), ("v", 5.0, True, None, [(7.0, "Backordered", "C")], "kept"), ("w", None, False, True, None, None)]
    df = spark.createDataFrame(rows, "url string, price double, in_stock boolean, price_locked boolean, backorder array<struct<price:double,status:string,vendor:string>>, notes string")
    u, v, w = P.apply_seller_lock(df, got).orderBy("url").collect()
    assert (u.price, u.in_stock, u.price_locked, u.backorder[0].vendor, u.notes) == (31.0, True, True, "B Two", "old · price of the seller table: lowest of 1 available seller, by its badge")
    assert (v.price, v.in_stock, v.price_locked, v.backorder[0].price, v.notes) == (5.0, True, False, 7.0, "kept")
    assert (w.price, w.in_stock, w.price_locked, w.backorder, w.notes) == (None, False, True, None, None)


def test_seller_table_without_links(spark):
    text = "Acme In stock ~~$15.00~~ $12.00 + $5.00 Flat Rate\nBolt Out of stock $9.50\nCog Special order $11.00"
    pages = spark.createDataFrame([("u", text)], "url string, text string")
    got = P.aggregator_price(P.seller_rows(pages), pages).first()
    assert (float(got.price), got.n_rows) == (11.0, 2)
    assert {float(r.total) for r in P.seller_rows(pages, include_shipping=True).collect()} == {17.0, 11.0}


def test_seller_table_of_cart_rows(spark):
    text = "Acme ~~$15.00~~ $12.00 1 @ $3.00\nAdd to Cart\nBolt backordered $9.50\nadd  to cart Cog $11.00 lowest price ADD TO CART footer $1.00"
    rows = P.seller_rows(spark.createDataFrame([("u", text.replace("backordered", "notify me"))], "url string, text string")).collect()
    assert [(float(r.total), r.badge) for r in rows] == [(12.0, False), (11.0, True)]


def test_seller_price_without_a_link_looks_back(spark):
    text = "Backordered" + " " * 380 + "$5.00/ea" + " " * 250 + "shipping surcharge $4.00 Backordered" + " " * 401 + "$6.00/ea"
    rows = P.seller_rows(spark.createDataFrame([("u", text)], "url string, text string")).collect()
    assert [(float(r.total), r.status) for r in rows] == [(5.0, "Backordered"), (6.0, None)]


def test_structured_offers(spark):
    rows = [
        ("graph", '<script type="application/ld+json">{"@graph": [{"@type": ["Product"], "name": "N", "offers": {"lowPrice": "5.00", "highPrice": "9.00"}}]}</script>', 5.0, 1, False),
        ("list", '<script type="application/ld+json">[{"@type": "Product", "offers": [{"price": 7}, {"price": "7.00"}]}]</script>', 7.0, 1, True),
        ("broken", '<script type="application/ld+json">{oops</script><meta property="og:price:amount" content="1,200.50">', 1200.5, 2, True),
        ("two", '<script>{"price": 5, "price": 6}</script>', None, None, None),
        ("null", None, None, None, None),
    ]
    got = {r.url: (float(r.price), r.tier, r.single_offer) for r in P.structured_offers(spark.createDataFrame([r[:2] for r in rows], "url string, html string")).collect()}
    assert got == {u: (p, t, s) for u, _, p, t, s in rows if p}


def test_variants(spark):
    wanted = spark.createDataFrame([("a", "7210FF"), ("b", "7210FF"), ("c", "8969286"), ("d", "8969286"), ("e", "21521")], "page string, number string")
    variants = spark.createDataFrame([("a", 0, "3M-7210FF", 1.0), ("b", 0, "516-7210FF", 2.0), ("c", 0, "8969286 1Box", 3.0), ("d", 0, "89692861", 4.0), ("e", 0, "SUL-21521", 5.0)], "page string, pos int, sku string, price double")
    assert {r.page for r in K.match_variant_by_id(wanted, variants).collect()} == {"a", "b", "c", "e"}
    sizes = K.match_variant_by_size(spark.createDataFrame([("a", "33oz")], "page string, size string"), spark.createDataFrame([("a", "Bottle 33oz", 1.0), ("a", "Packets 24Pkg", 2.0)], "page string, title string, price double"))
    assert [r.title for r in sizes.collect()] == ["Bottle 33oz"]


def test_relevance_and_gap(spark):
    lines = spark.createDataFrame([(1, "https://x.example/ion-polycarbonate-crowns-p22", "clinical fluoride varnish"), (2, "https://x.example/p22", "clinical fluoride varnish"), (3, "https://x.example/fluorides-sale-here", "clinical fluoride varnish")], "id int, url string, description string")
    assert {r.id for r in J.relevant(lines).collect()} == {2, 3}
    sites = spark.createDataFrame([("shop.a.com",), ("b.com",), ("c.com",)], "domain string")
    cands_ = spark.createDataFrame([(1, "https://a.com/x"), (1, "https://www.b.com/y")], "sku int, url string")
    gap = J.supplier_gap(cands_, sites, spark.createDataFrame([(1,), (2,)], "sku int"))
    assert {tuple(r) for r in gap.select("sku", "domain").collect()} == {(1, "c.com"), (2, "c.com"), (2, "b.com"), (2, "shop.a.com")}
    assert {r.trusted for r in J.trusted(cands_, sites).collect()} == {True}


def test_validation(spark):
    kinds = "doc_id int, pos int, pass int, qty int, sku string, unit_price decimal(12,2), extended_price decimal(12,2)"
    from decimal import Decimal as d

    rows = spark.createDataFrame([(1, 0, 0, 3, "a", d("10.00"), d("30.04")), (1, 1, 0, 3, "b", d("10.00"), d("30.06")), (1, 2, 1, 3, "a", d("10.00"), d("30.04"))], kinds)
    assert [(r.sku, r["pass"]) for r in O.validate(rows).collect()] == [("a", 0)]


def test_client_tables(spark):
    lines = spark.createDataFrame([(0, "# head"), (1, "123 | A-1 | Maker # note"), (2, "123|A-2|"), (3, "lone"), (4, None)], "line_no int, value string")
    rows = D.pipe_table(lines, ["sku", "mpn", "maker"])
    assert [tuple(r) for r in K.last_wins(rows, "sku", "line_no").select("sku", "mpn", "maker").collect()] == [("123", "A-2", None)]
    sources = spark.createDataFrame([(1, "a", "WWW.A.com", "", True, "odd", 0), (2, "b", "bad/x", "l", True, "other", 5), (3, "c", "walmart.com", "W", False, "marketplace", 3)], "position int, id string, domain string, label string, enabled boolean, type string, priority int")
    clean = D.normalize_sources(sources)
    assert [(r.domain, r.label, r.type, r.priority) for r in clean.collect()] == [("a.com", "a.com", "other", 1), ("walmart.com", "W", "marketplace", 3), ("amazon.com", "amazon.com", "marketplace", 900)]
    sites, barred, on = D.site_lists(clean, spark.createDataFrame([("amazon.com",), ("x.com",)], "domain string"), "own.com")
    assert {r.domain for r in barred.collect()} == {"x.com", "walmart.com", "own.com"} and {r.domain for r in on.collect()} == {"amazon.com"} and sites.count() == 0


def test_verdict_replies(spark):
    replies = [("fence", '```json\n{"items": [{"page": 2, "price": "$1,234.50", "confidence": "91"}]}\n```'), ("prose", 'So: {"price": 5, "pack_quantity": "many"} done'), ("bad", "none at all"), ("null", None)]
    df = spark.createDataFrame([(k, ["u1", "u2"], r) for k, r in replies], "key string, urls array<string>, reply string")
    got = {r.key: (r.url, float(r.price), r.pack_quantity, r.confidence) for r in D.parse_verdicts(df).collect()}
    assert got == {"fence": ("u2", 1234.5, None, 91), "prose": ("u1", 5.0, None, None)}


def test_order_of_rows_does_not_matter(spark, sf):
    from bidscout.sources.views import candidates

    c = candidates(spark, sf)
    a = S.select_options(c).select("sku", "option_no", "offer_id")
    b = S.select_options(c.orderBy(F.rand(3)).repartition(7)).select("sku", "option_no", "offer_id")
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_reports_are_overwritten_by_order(spark, tmp_path):
    from bidscout.operators.reports import latest_run, write_reports

    rows = lambda *r: spark.createDataFrame(list(r), "reference string, sku int")
    write_reports({"a": rows(("x", 1), ("y", 2))}, str(tmp_path))
    write_reports({"a": rows(("x", 3))}, str(tmp_path))
    assert {(r.sku, r.reference) for r in spark.read.parquet(f"{tmp_path}/a").collect()} == {(3, "x"), (2, "y")}
    assert {tuple(r) for r in latest_run(rows(("x", 1), ("x", 2), ("y", 2)), rows(("x", 3))).collect()} == {("x", 3), ("y", 2)}


def test_generic_listings_of_house_brands(spark):
    line = dict(description="Cotton Rolls #2 Non Sterile 2000/Bx", ordered_pack=2000, unit_price=20.0, rejected_reason=None, out_of_stock=False, price_unreliable=False, structured_name=None, pack_qty=None, title=None, price=9.0, url="https://m.example/x")
    kind = "description string, ordered_pack int, unit_price double, rejected_reason string, out_of_stock boolean, price_unreliable boolean, structured_name string, pack_qty int, title string, price double, url string, page_name string"
    cases = [
        (dict(page_name="Plain cotton rolls # 2, 2000/bx"), True),
        (dict(page_name="Plain cotton rolls #4, 2000/bx"), False),  # another grade
        (dict(page_name="Gauze sponge #2 2000 2000/bx"), False),  # another product
        (dict(page_name="Cotton rolls #2", url="https://m.example/cotton-2000-bx"), True),  # the pack is in the url
        (dict(page_name="Cotton rolls #2", pack_qty=200), False),
        (dict(page_name=None, title="Cotton rolls #2 2000 count"), True),
        (dict(page_name=None), False),
        (dict(page_name="Cotton rolls #2 2000/bx", price=0.5), False),
        (dict(page_name="Cotton rolls #2 2000/bx", rejected_reason="login required"), False),
    ]
    df = spark.createDataFrame([{**line, **c} for c, _ in cases], kind)
    assert [r.ok for r in df.select(R.generic_eligible().alias("ok")).collect()] == [ok for _, ok in cases]


def test_reports_are_written_by_order(spark, tmp_path):
    from bidscout.operators.reports import write_reports

    df = spark.createDataFrame([("A", 1), ("A", 2), ("B", 3)], "reference string, price int")
    write_reports({"price_match": df, "alternates": df}, str(tmp_path))
    write_reports({"price_match": df.filter("reference = 'A' AND price = 2")}, str(tmp_path))
    got = lambda name: sorted((r.reference, r.price) for r in spark.read.parquet(f"{tmp_path}/{name}").collect())
    assert got("price_match") == [("A", 2), ("B", 3)] and got("alternates") == [("A", 1), ("A", 2), ("B", 3)]


def test_pack_phrases(spark):
    pack = lambda t: one(spark, T.pack_from_text(F.col("t")), t=t)
    assert [pack(t) for t in ("Pack of 12, $3.10 each", "Contains: 5 per Package", "sold individually", "50mL PF171-5 Size 5", "100/Bx")] == [12, 5, 1, None, 100]


def test_cross_sell_is_cut_at_a_line_after_the_start(spark):
    cut = lambda t: len(one(spark, T.without_cross_sell(F.col("t")), t=t))
    assert cut("Related products\n" + "x" * 500) == 517
    assert cut("x" * 399 + "\nRelated products") == 400  # the line begins at 400
    assert cut("x" * 398 + "\nRelated products") == 415  # at 399
    assert cut("x" * 500 + " related products") == 517


def test_entities(spark):
    """As html.unescape: named with and without a semicolon, numeric, hexadecimal, unknown and broken ones."""
    import html as H

    odd = ["&eacute;", "&eacute", "&#233;", "&#xE9;", "&#x1F600;", "&notit;", "&unknown;", "&;", "&#0;", "&#128;", "&#x110000;", "&amp;lt;", "&NotEqualTilde;", "a & b", "&ThickSpace;x", "&nbsp;&nbsp;x", "&copy2", "&#38;amp;"]
    pages = spark.createDataFrame([(i, f"<p>{x}</p><script>{x}</script>y") for i, x in enumerate(odd)] + [(99, None), (98, "")], "page_id int, html string")
    got = {r.page_id: r.page_text for r in P.html_to_text(pages).collect()}
    assert [got[i] for i in range(len(odd))] == [" ".join(H.unescape(f" {x} y").split()) for x in odd]
    assert got[99] is None and got[98] == ""


def test_sources_are_files(spark, tmp_path):
    from bidscout.sources import files as L
    from bidscout.sources import orders as O

    (tmp_path / "orders").mkdir()
    body = "OR1234567890123456\nShip To\nClinic\n01/02/2026\n3\n1234567\nGauze\n200/Bx\nBX\n$10.00\n$30.00\nTotal Price $30.00\n"
    for name in ("a 1.txt", "b.txt"):
        (tmp_path / "orders" / name).write_text(body)
    docs = L.order_documents(spark, f"{tmp_path}/orders")
    assert sorted((r.doc_id, r.sku, r.qty) for r in O.order_lines(docs).collect()) == [("a 1", "1234567", 3), ("b", "1234567", 3)]
    assert {(r.doc_id, r.reference, str(r.printed_total)) for r in O.headers(docs).collect()} == {("a 1", "OR1234567890123456", "30.00"), ("b", "OR1234567890123456", "30.00")}
    (tmp_path / "mpn.txt").write_text("# sku | mpn\r\n1 | A | x # note\r\n\r\n2 | | \n1 | B\n")
    rows = K.last_wins(L.pipe_table(spark, f"{tmp_path}/mpn.txt", ["sku", "mpn", "maker"]), "sku", "line_no")
    assert [tuple(r) for r in rows.select("sku", "mpn", "maker").collect()] == [("1", "B", None)]
    (tmp_path / "sites.txt").write_text("WWW.A.com # x\n#b.com\n c.com\n")
    assert {r.domain for r in L.domain_list(spark, f"{tmp_path}/sites.txt").collect()} == {"a.com", "c.com"}
    sites = spark.createDataFrame([(1, "a.com")], "position int, domain string")
    assert [r.domain for r in L.supplier_sources(spark, f"{tmp_path}/none.json", sites).orderBy("priority").collect()] == ["a.com", "amazon.com", "walmart.com"]
    (tmp_path / "s.json").write_text('[\n {"id": "z", "domain": "z.com", "enabled": false}\n]')
    assert [(r.domain, r.enabled) for r in L.supplier_sources(spark, f"{tmp_path}/s.json", sites).orderBy("priority").collect()][0] == ("z.com", False)
    for empty in (L.order_documents(spark, f"{tmp_path}/no"), L.pipe_table(spark, f"{tmp_path}/no", ["sku", "mpn"]), L.domain_list(spark, f"{tmp_path}/no"), L.written_reports(spark, f"{tmp_path}/no")):
        assert empty.isEmpty()


def test_backfilled_runs(spark, tmp_path):
    from bidscout.operators.reports import write_reports
    from bidscout.operators.runs import backfill
    from bidscout.sources import files as L

    write_reports({"price_match": spark.createDataFrame([("PO 1/a", 1), ("PO 2", 2), ("PO 3", 3)], "reference string, sku int")}, str(tmp_path))
    files = L.written_reports(spark, str(tmp_path))
    assert {r.reference for r in files.collect()} == {"PO 1/a", "PO 2", "PO 3"}
    runs = spark.createDataFrame([("legacy-PO 3",)], "id string")
    orders = spark.createDataFrame([(1, "PO 2", "old.pdf", 1.0, None), (5, "PO 2", "new.pdf", 2.0, None)], "id long, reference string, filename string, total_price double, created_at timestamp")
    got = {r.reference: (r.id, r.filename, r["items"], r.total_price, r.created_at is not None) for r in backfill(files, runs, orders, spark.createDataFrame([(5,), (5,), (1,)], "order_id long")).collect()}
    assert got == {"PO 1/a": ("legacy-PO 1/a", "PO 1/a.pdf", 0, None, True), "PO 2": ("legacy-PO 2", "new.pdf", 2, 2.0, True)}


def test_listing_urls_of_one_site(spark):
    urls = [("https://www.net32.com/ec/gloves-d-123", False), ("https://www.net32.com/ec/gloves-t-12", True), ("https://www.net32.com/gloves", True), ("https://shop.net32.com/x-d-9", False), ("https://www.other.example/gloves", False)]
    df = spark.createDataFrame([(u,) for u, _ in urls], "url string")
    assert [r.c for r in df.select(U.is_category(F.col("url")).alias("c")).collect()] == [c for _, c in urls]


def test_cross_sell_from_its_line_on(spark):
    """A heading counts only at the start of a line, and only behind what is kept; a line break right before that is seen."""
    head = "h" * 399
    cases = [(f"{head}\n## Similar items $1", f"{head}\n"), (f"{head}x Similar items $1", None), (f"{head}Similar items", None), (f"Related products\n{head}", None), (f"{head}\ntext\nRelated:\n$2", f"{head}\ntext\n"), (f"{head}\nrelated sizes", None), ("short", None)]
    df = spark.createDataFrame([(t,) for t, _ in cases], "t string")
    assert [r.c for r in df.select(T.without_cross_sell(F.col("t")).alias("c")).collect()] == [t if c is None else c for t, c in cases]
