"""What plans must not do: repeat what is dear, or broadcast what grows."""

import itertools
import re

from oracle import SF
from pyspark.sql import functions as F

from bidscout import config as C
from bidscout.functions import text as T
from bidscout.sources.views import candidates


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_numbers_of_texts(spark):
    rows = ["", None, "several", "12", " 7 ", "1.5", "9999999999", "NaN", "Infinity", "x1", "٣"]
    df = spark.createDataFrame([(r,) for r in rows], "x string")
    for kind in ("int", "double", "decimal(12,2)"):
        got = df.select(T.number(F.col("x"), kind).alias("a"), F.col("x").try_cast(kind).alias("b")).collect()
        assert [str(r.a) for r in got] == [str(r.b) for r in got]


def test_a_pack_phrase_is_sought_once(spark):
    """Each phrase was sought thrice, and each text without it cost a failed cast."""
    df = spark.createDataFrame([("Pack of 12",), ("9999 pcs or 6-pk, contains 4",), ("nothing",), ("",), (None,), ("1 per box",)], "x string")
    found = df.select(T.pack_from_text(F.col("x")).alias("n"))
    assert [r.n for r in found.collect()] == [12, 4, None, None, None, 1]
    assert all(plan(found).count(f", {p}, 1)") == 1 for p in T.PACK_COUNTS)


def test_spread_candidates(spark):
    """Only suppliers may be broadcast."""
    assert plan(candidates(spark, SF, spread=True)).count("BroadcastExchange") <= 1
    assert plan(candidates(spark, SF, spread=True)).count("SortMergeJoin") == 2


def test_first_gaps_do_not_grow_with_sites(spark):
    """Only the first places are looked at (before: every bit of all sites of a line)."""
    from bidscout.operators import urls as J

    sites = spark.range(100_000).select(F.format_string("s%06d.example", "id").alias("domain"))
    cands = spark.createDataFrame([(1, "https://s000000.example/a"), (1, "https://s000002.example/"), (2, "https://s099999.example/")], "sku int, url string")
    lines = spark.createDataFrame([(1,), (2,), (3,)], "sku int")
    gaps = J.first_gaps(cands, J.numbered_sites(sites), lines, 3)
    assert {r.sku: r.gaps for r in gaps.collect()} == {1: [1, 3, 4], 2: [0, 1, 2], 3: [0, 1, 2]}
    assert J.first_gaps(cands, J.numbered_sites(sites.filter("false")), lines, 3).filter("size(gaps) > 0").isEmpty()
    assert J.first_gaps(cands, J.numbered_sites(sites.limit(2)), lines, 3).filter("size(gaps) > 2").isEmpty()


def test_rules_are_a_value(spark):
    """The plan of a score doesn't grow by an expression for each rule."""
    from bidscout.llm import quality as Q

    model = Q.RuleModel(0.5, [(0.1, (("words", True, float(i)), ("chars", False, 100.0 + i))) for i in range(200)])
    stats = spark.createDataFrame([(50.0,) * len(Q.STATISTICS)], ", ".join(f"{k} double" for k in Q.STATISTICS)).select(F.struct("*").alias("stats"))
    df = stats.select(model.score().alias("s"))
    assert df._jdf.queryExecution().analyzed().toString().count("CASE WHEN") == 1
    assert abs(df.first().s - 1 / (1 + 2.718281828459045 ** -5.5)) < 1e-9


def test_listings_and_logins_by_their_words(spark):
    """Patterns are tried only on texts that have their words; what they find stays."""
    rows = ["Filter Products. SORT BY price", "Items 1 - 16 of 40", "SHOP by Price", "16 products per page", "sort by price", "items of", None, ""]
    df = spark.createDataFrame([(r,) for r in rows], "x string")
    assert [r.y for r in df.select(T.is_listing(F.col("x")).alias("y")).collect()] == [True, True, True, True, False, False, None, False]
    rows = [("LOG IN to see price $5", "price gated behind login"), ("Register to view our Cost", "price gated behind login"), ("create an account to see the price", "login required for pricing"), ("sign in", "login required for pricing"), ("sign in $ 4", None), ("price $", None), (None, None)]
    df = spark.createDataFrame(rows, "x string, y string")
    found = df.select("y", T.login_reason(F.col("x"), F.lit(False)).alias("z"))
    assert all(r.y == r.z for r in found.collect())
    assert plan(found).count("lower(") == 1 and plan(df.select(T.is_listing(F.col("x")).alias("y"))).count("lower(") == 1


def test_best_amount_takes_one_row(spark):
    """A page's best amount is found in its row (before: amounts were rows, in a window of their page)."""
    from bidscout.sources import pages as P

    rows = [("a", "was $9.00 now $7.50"), ("b", "~~$5.00~~ $6.00"), ("c", "none"), ("d", None), ("e", "list $3.00, $2.00 our price"), ("e", "our price $4,000"), ("f", "$0.00 or $123,456,789,012.00")]
    found = P.fallback_price(spark.createDataFrame(rows, "url string, text string"))
    assert {r.url: (str(r.price), r.pages) for r in found.collect()} == {"a": ("7.50", 1), "b": ("6.00", 1), "e": ("4000.00", 2)}
    assert "Window" not in plan(found) and "Generate" not in plan(found)


def test_variant_pages_are_read_once(spark):
    from bidscout.sources import pages as P

    html = '<script>{"variants": [{"sku": "a]", "price": 2}, {"sku": "b", "price": {"amount": "3.5"}}]}</script><form data-product_variations="[{&quot;sku&quot;:&quot;c&amp;&quot;,&quot;display_price&quot;:4}]">'
    pages = spark.createDataFrame([("u", html), ("u", html), ("v", None), ("w", '"variants": [1, ["x]"'), ("x", '"variants": [{"sku": "d", "price": 5,}]')], "url string, html string").repartition(2)
    found = P.variant_records(pages)
    assert [tuple(map(str, r)) for r in found.orderBy("url", "pos").collect()] == [("u", "1", "c&", "4.00", ""), ("u", "2", "a]", "2.00", ""), ("u", "3", "b", "3.50", "")]
    assert plan(found).count("RoundRobinPartitioning") == 1
    assert [P.balanced(x, 0) for x in ('[1, "]", [2]] x', '["\\"]"]', "[[1]", '["a', "[1,]]", '["\n]"]]')] == ['[1, "]", [2]]', '["\\"]"]', None, None, "[1,]", '["\n]"]']


def test_structured_offers_take_one_row(spark):
    """Pages aren't joined with their own blocks (before: they were read twice and joined)."""
    from bidscout.sources import pages as P

    ld = '<script type="application/ld+json">%s</script>'
    rows = [
        ("a", ld % '{"@graph": [{"@type": "Product", "name": "x", "offers": [{"price": "3"}, {"price": "2", "priceCurrency": "USD"}, {"price": 1, "priceCurrency": "EUR"}]}]}'),
        ("b", ld % "no" + '<META property="product:price:amount" content="4.5">'), ("c", '<b itemprop="price" content="5.00"></b>'), ("d", "{'price': '6'}"), ("e", "{'price': '6', \"price\": 7}"), ("f", None),
        ("g", ld % '[{"@type": "Product", "offers": {"lowPrice": 8, "highPrice": 9}}]'),
    ]
    found = P.structured_offers(spark.createDataFrame(rows, "url string, html string"))
    got = {r.url: (float(r.price), r.name, r.single_offer, r.tier) for r in found.collect()}
    assert got == {"a": (2.0, "x", False, 1), "b": (4.5, None, True, 2), "c": (5.0, None, True, 3), "d": (6.0, None, True, 4), "g": (8.0, None, False, 1)}
    assert "Join" not in plan(found) and "Exchange" not in plan(found)


def test_a_hit_is_read_once(spark):
    """The links of a hit were read for the filter and again for the row."""
    import json

    from bidscout.sources import feeds as D

    body = {"organic_results": [{"link": "https://www.google.com/x", "product_link": "https://a.com/1", "price": "$2"}, {"title": "t"}], "ads": [{"offers": [{"link": ""}, {"direct_link": "https://b.com/2"}], "snippet": "for $3.50"}]}
    found = D.flatten_hits(spark.createDataFrame([("q", json.dumps(body)), ("r", "no")], "query_id string, body string"))
    assert [(r.disc_seq, r.section, r.url, float(r.price), r.domain) for r in found.orderBy("disc_seq").collect()] == [(1, "organic_results", "https://a.com/1", 2.0, "a.com"), (2, "ads", "https://b.com/2", 3.5, "b.com")]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("product_link") <= 4


def test_a_sorted_report_is_made_once(spark):
    """The sample that a sort takes reads a shuffle (before: it made the report, which was then made again)."""
    from bidscout.plans.registry import QUERIES

    for name in ("r1_price_match",):
        first = [x for x in plan(QUERIES[name](spark, SF)).split("\n") if "Exchange" in x]
        assert "rangepartitioning" in first[0] and "REPARTITION_BY_COL" in first[1], name


def test_single_rows_match_twice(spark):
    """A line was matched anew for each of its six groups."""
    from bidscout.sources import orders as O

    docs = spark.createDataFrame([(1, "\t 2 1000001  Part \x01 7  10/Bx BX $1,000.50 $2,001.00\r\n3 100002 x BX $1 $2.00\n\x0b\n4 1000003 y CA $1.00 $4.00")], "doc_id int, text string")
    found = O.parse_single(docs)
    rows = [(r.pos, r.qty, r.sku, r.description, r.uom, str(r.unit_price), str(r.extended_price)) for r in found.collect()]
    assert rows == [(0, 2, "1000001", "Part \x01 7  10/Bx", "BX", "1000.50", "2001.00"), (3, 4, "1000003", "y", "CA", "1.00", "4.00")]
    logical = found._jdf.queryExecution().optimizedPlan().toString()
    assert logical.count("d{6,8}") <= 2


def test_a_verdicts_numbers_are_read_once(spark):
    """The price of a verdict was read anew by each column that it bears on."""
    from bidscout.operators import verdicts as E

    c = spark.createDataFrame([("k", 5.0, "page says $6.00", False, False, False, "exact", 1, "", 2)], "key string, price double, page_text string, price_locked boolean, price_structured boolean, aggregator boolean, match_type string, confidence int, rejected_reason string, pack_qty int")
    c = c.selectExpr("*", *(f"false AS {x}_match" for x in ("brand", "name", "size_form", "pack")), "false AS price_unreliable")
    v = spark.createDataFrame([("k", "$6.00", "$8.00", "3.0", "80")], "key string, price string, original_price string, pack_quantity string, confidence string")
    out = E.apply_verdicts(c, v)
    r = out.first()
    assert (r.price, r.original_price, r.pack_qty, r.confidence, r.pack_condition, r.price_unreliable) == (6.0, 8.0, 3, 80, "on sale: was $8.00, now $6.00 (25% off)", False)
    assert not [x for x in out.columns if x.startswith("v_")]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("translate(v_price") <= 1


def test_gaps_are_named_where_they_are(spark):
    """Gaps were joined with the names of their sites row by row: a shuffle of lines x sites rows, if sites weren't broadcast."""
    from bidscout.plans.registry import QUERIES

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        above, below = plan(QUERIES["j7_supplier_gap"](spark, SF)).split("Generate explode(own", 1)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in above and "Join" not in above and "Exchange" in below


def test_a_seller_table_is_cut_once(spark):
    """What a page was cut into was cut anew for each array that reads it, and its price was a join with the page's own rows."""
    from bidscout.plans.registry import QUERIES
    from bidscout.sources import pages as P

    text = "Featured $9.00\nVendor options\n"
    pages = [
        ("a", text + "[x](https://s/vendor/ann-b/1)\nStocked\n$9.00/ea\n[y](https://s/vendor/ted/1)\nback-ordered\n$8.00 /ea shipping surcharge $1.50"), ("b", text + "x In stock $3.00 + $1.00\ny Out of stock $1.00\nz special order $2,000.00 lowest price"),
        ("c", text + "x $4.00 1 @ $0.01 add to cart y notify me $1.00 add to cart"), ("d", text + "no longer available $5.00/ea"), ("e", ""), ("f", None), ("g", text + "$2.00/ea\n$8.00LOWEST PRICE\n$9.00/ea"),
    ]
    pages = spark.createDataFrame(pages, "url string, text string")
    rows = P.seller_rows(pages)
    got = [(r.url, r.seller_no, r.vendor, float(r.total), r.badge, r.status) for r in rows.orderBy("url", "seller_no").collect()]
    want = [("a", 0, "Ann B", 9.0, False, None), ("a", 1, "Ted", 9.5, False, "Back-ordered"), ("b", 0, None, 3.0, False, None), ("b", 1, None, 2000.0, True, None), ("c", 0, None, 4.0, False, None)]
    assert got[:5] == want and [r[:2] for r in got[5:]] == [("d", 0), ("g", 0), ("g", 1)] and got[5][5] == "No Longer Available"
    logical = rows._jdf.queryExecution().optimizedPlan().toString()
    assert logical.count("split(") == 3 and logical.count(f"{P.T.CROSS_SELL}, 0)") == 1
    kept = P.page_prices(pages)
    assert "Exchange" not in plan(kept) and "Join" not in plan(kept)
    assert sorted(map(str, kept.collect())) == sorted(map(str, P.aggregator_price(rows, pages).collect()))
    assert plan(QUERIES["s21_aggregator_price"](spark, SF)).count("Exchange hash") == 1


def test_only_what_can_be_chosen_is_shuffled(spark):
    """Every candidate was shuffled and sorted for the price match, which can choose one in four; the table is the same."""
    from bidscout.operators import reports as E
    from bidscout.sources.views import order_lines

    late = F.array(F.struct("price", F.lit("Backordered").alias("status"), F.col("site").alias("vendor")))
    cands = candidates(spark, SF).withColumn("backorder", F.when(F.col("out_of_stock"), late))
    lines = order_lines(spark, SF).filter("sku % 5 > 0")  # candidates of other lines stay
    few, every = (E.choices(lines, cands, every=e) for e in (False, True))
    below = lambda df: df._jdf.queryExecution().optimizedPlan().toString().rsplit("RepartitionByExpression", 1)[1]
    assert ["rejected,unverified" in below(x).replace(", ", ",") for x in (few, every)] == [True, False]
    assert every.count() == cands.select("sku").union(lines.select("sku")).distinct().count()
    tables = [E.price_match(lines, cands, chosen=x, ordered=False) for x in (None, every)]
    assert sorted(map(str, tables[0].collect())) == sorted(map(str, tables[1].collect()))


def test_narrow_rows_of_evidence_are_dealt(spark):
    """What the evidence table says by words was made before its rows were dealt to their orders, and shuffled with them."""
    from bidscout.operators import reports as E
    from bidscout.sources.views import order_lines

    lines = order_lines(spark, SF)
    cands = candidates(spark, SF).filter("sku % 9 > 0").withColumn("offer_id", F.when(F.col("disc_seq") % 2 == 0, F.col("offer_id")).when(F.col("disc_seq") % 3 == 0, F.concat(F.lit("A"), "offer_id")).when(F.col("disc_seq") % 3 == 1, F.concat("offer_id", F.lit("\n"))))
    orders = lines.select(F.concat(F.lit("PO "), (F.col("sku") % 2).cast("string")).alias("reference"), "sku")
    rows, make = E.run_reports(orders, lines, cands, lines, names=("evidence",))["evidence"]
    above, below = make(rows.hint("rebalance", "reference"))._jdf.queryExecution().optimizedPlan().toString().split("RebalancePartitions")
    assert "THEN Y" in above and "THEN Y" not in below and "Dental Supplier" in above
    got, want = make(rows), E.evidence(lines, cands)
    assert [c for c in got.columns if c != "reference"] == want.columns
    assert sorted(map(str, got.drop("reference").collect())) == sorted(map(str, want.collect()))
    assert want.filter("offer_id IS NOT NULL").select("offer_id").exceptAll(cands.select("offer_id")).isEmpty()


def test_a_window_of_a_text_is_cut_at_once(spark):
    """Places and parts of a text were found by Spark character by character, 200 microseconds a page; what is shown stays."""
    from bidscout.sources import pages as P

    far, gap = "é" * 4500, "\n…\n"
    rows = [
        ("$1.25 " + far, "x", True), ("$1.25 a" + far + "ÀNCHOR" + far, "àncHor", False), ("a " + far + "$ 3" + far, "x", False), ("a $" + far + "$3" + far, "x", False), ("a " + far + "$3", "x", None), ("$2" + far + "$3", None, False),
        (far[:3994] + "anchor" + far, "ANCHOR", None), (far[:4000] + "$7" + far, "", False), (far[:3999] + "$7" + far, "", False), (None, "x", False), ("", "x", True),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, text string, anchor string, locked boolean")
    found = P.window_text(df, F.col("anchor"), F.col("locked"))
    got = [r.window for r in found.orderBy("i").collect()]
    start = lambda i: rows[i][0][:4000]
    deep = " a" + far[:593] + gap  # the head loses its price
    assert got[0] == ("$1.25 " + far)[:1500] and got[1] == deep + far[-800:] + "ÀNCHOR" + far[: 3400 - 806]
    assert [got[i] for i in (2, 3)] == [rows[i][0][:1333] + gap + far[-800:] + rows[i][0][4500 + i :][:1800] for i in (2, 3)]
    assert [got[i] for i in (4, 5, 6, 8)] == [start(i) for i in (4, 5, 6, 8)] and got[7] == far[:1333] + gap + far[:800] + "$7" + far[:1798] and got[9:] == [None, ""]
    assert "instr" not in plan(found).lower() and "substring" not in plan(found).lower()


def broadcast_lines(text: str) -> int:
    """How many broadcasts of a plan read the lines (parts) and join nothing."""
    rows, n = text.split("\n"), 0
    for i, row in enumerate(rows):
        if "BroadcastExchange" in row:
            at = row.index("BroadcastExchange")
            below = list(itertools.takewhile(lambda x: re.search("[A-Za-z*]", x) and re.search("[A-Za-z*]", x).start() > at, rows[i + 1 :]))
            n += any("part.parquet" in x for x in below) and not any("Join" in x for x in below)
    return n


def test_alternates_broadcast_no_lines(spark):
    """Lines were broadcast for each of four reads of the candidates: files of few bytes hold many lines."""
    from bidscout.plans.registry import QUERIES

    assert broadcast_lines(plan(candidates(spark, SF))) == 2
    assert broadcast_lines(plan(QUERIES["r2_alternates"](spark, SF))) == 0


def test_seller_tables_broadcast_no_lines(spark):
    """Lines were broadcast twice, and rows of text were shuffled to their pages; offers are, before texts are made of them."""
    from bidscout.plans.registry import QUERIES

    found = plan(QUERIES["s20_parse_seller_tables"](spark, SF))
    assert broadcast_lines(found) == 0
    assert "Exchange hash" not in found.split("SortMergeJoin", 1)[0]


def test_verdicts_are_shuffled_narrow(spark):
    """Candidates were shuffled with an id of letters beside a key of letters that has it again."""
    from bidscout.plans.registry import QUERIES

    found = QUERIES["p31_apply_verdicts"](spark, SF)
    join = found._jdf.queryExecution().optimizedPlan().toString().split("Join LeftOuter", 1)[1]
    dealt = join.split("Project", 2)[1]
    assert "unhex(" in dealt and not re.search(r"[\[ ]offer_id#\d+[,\]]", dealt)
