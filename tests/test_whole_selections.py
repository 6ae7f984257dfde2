"""Queries take every row of their selection, and the caps of the survey."""

from oracle import SF

from bidscout.operators import caches as K
from bidscout.plans.registry import QUERIES
from bidscout.sources.views import candidates


def test_every_candidate(spark):
    n = candidates(spark, SF).count()
    assert QUERIES["u3_evidence_rows"](spark, SF).filter("offer_id IS NOT NULL").count() == n
    assert QUERIES["p32_price_grounded"](spark, SF).count() == n
    skus = candidates(spark, SF).select("sku").distinct().count()
    assert QUERIES["j12_match_variant_by_id"](spark, SF).count() == skus
    assert QUERIES["t10_discovery_cap"](spark, SF).agg({"urls": "max"}).first()[0] > 10


def test_ties_of_variants(spark):
    wanted = spark.createDataFrame([("a", "p1")], "page string, number string")
    rows = [("a", 1, "P-1", 3.0), ("a", 1, "P-1", 2.0), ("a", 1, "P-1", 2.0), ("a", 2, "P-1", 1.0)]
    for r in (rows, rows[::-1]):
        got = K.match_variant_by_id(wanted, spark.createDataFrame(r, "page string, pos long, sku string, price double").coalesce(1))
        assert [x.price for x in got.collect()] == [2.0]


def test_references_without_semicolon(spark):
    """s19_pages_text is its SQL: what no semicolon ends stays; by default it is decoded, as browsers do."""
    from bidscout.sources import pages as P

    pages = spark.createDataFrame([(1, "<b>a&amp</b> &amp;lt; &copy;&nbsp;&#39;x&#x41; &lt &nosuch; &amp")], "page_id int, html string")
    texts = [P.html_to_text(pages, lenient=lenient).first().page_text for lenient in (False, True)]
    assert texts == ["a&amp &lt; © 'xA &lt &nosuch; &amp", "a& &lt; © 'xA < &nosuch; &"]
