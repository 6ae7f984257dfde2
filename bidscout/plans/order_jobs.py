"""Queries over orders: documents are made from the order and line item tables, then parsed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import caches as K
from ..sources import orders as O
from ..sources.views import cents, table
from .registry import query

# An order document: a header, the lines in one of the two grammars (by the line's number), the total. Unit price: total / quantity in cents.
LINES = """WITH l AS (SELECT l_orderkey AS doc_id, l_linenumber AS n, l_suppkey, CAST(l_quantity AS INTEGER) AS qty, CAST(1000000 + l_partkey AS VARCHAR) AS sku,
  CAST(floor(l_extendedprice / l_quantity * 100 + 0.5) / 100 AS DECIMAL(12,2)) AS unit, 'Part ' || l_suppkey || ' 10/Bx' AS description
  FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice, l_shipdate) = 1),
x AS (SELECT *, CAST(unit * qty AS DECIMAL(12,2)) AS ext FROM l)"""


def order_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text for each order."""
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    li = table(spark, sf_dir, "lineitem").withColumn("k", F.row_number().over(w)).filter("k = 1")
    unit = cents(F.col("l_extendedprice") / F.col("l_quantity")).cast("decimal(12,2)")
    qty = F.col("l_quantity").cast("int")
    sku = (F.lit(1000000) + F.col("l_partkey")).cast("string")
    name = F.concat(F.lit("Part "), F.col("l_suppkey").cast("string"))
    ext = (unit * qty).cast("decimal(12,2)")
    one = F.concat_ws(" ", qty.cast("string"), sku, name, F.lit("10/Bx BX"), F.concat(F.lit("$"), unit.cast("string")), F.concat(F.lit("$"), ext.cast("string")))
    cells = F.concat_ws("\n", qty.cast("string"), sku, name, F.lit("10/Bx"), F.lit("BX"), F.concat(F.lit(" $"), unit.cast("string")), F.concat(F.lit("$"), ext.cast("string")))
    rows = li.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("n"), F.when(F.col("l_linenumber") % 2 == 0, one).otherwise(cells).alias("row"), ext.alias("ext"))
    body = rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "row"))), lambda x: x["row"]), "\n\n").alias("body"), F.sum("ext").alias("total"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.date_format("o_orderdate", "MM/dd/yyyy").alias("day"), "o_custkey").join(body, "doc_id")
    head = F.concat(F.lit("Order OR"), F.lpad(F.col("doc_id").cast("string"), 16, "0"), F.lit("\nDate "), F.col("day"), F.lit("\nSHIP TO\nClinic "), F.col("o_custkey").cast("string"), F.lit("\n\n"))
    return orders.select("doc_id", F.concat(head, F.col("body"), F.lit("\nTotal Price $"), F.col("total").cast("decimal(14,2)").cast("string")).alias("text"))


@query("s1_scan_order_text", LINES + " SELECT doc_id, 5 + sum(CASE WHEN n % 2 = 0 THEN 1 ELSE 7 END) AS tokens FROM x WHERE doc_id IN (SELECT o_orderkey FROM orders) GROUP BY doc_id")
def s1(spark, sf_dir):
    return O.scan_text(order_documents(spark, sf_dir)).groupBy("doc_id").agg(F.count("*").alias("tokens"))


PARSED = LINES + " SELECT doc_id, qty, sku, description, unit AS unit_price, ext AS extended_price FROM x WHERE doc_id IN (SELECT o_orderkey FROM orders)"
COLUMNS = ("doc_id", "qty", "sku", "description", "unit_price", "extended_price")


@query("s2_parse_cells", PARSED + " AND n % 2 = 1")
def s2(spark, sf_dir):
    return O.parse_cells(order_documents(spark, sf_dir)).select(*COLUMNS)


@query("s3_parse_single", PARSED + " AND n % 2 = 0")
def s3(spark, sf_dir):
    return O.parse_single(order_documents(spark, sf_dir)).select(*COLUMNS)


@query("s4_validate_lines", PARSED + " QUALIFY row_number() OVER (PARTITION BY doc_id, sku, qty, unit, ext ORDER BY n % 2 = 0, n) = 1")
def s4(spark, sf_dir):
    return O.order_lines(order_documents(spark, sf_dir)).select(*COLUMNS)


@query(
    "s5_order_headers",
    LINES
    + """ SELECT doc_id, 'OR' || lpad(doc_id::VARCHAR, 16, '0') AS reference, CAST(sum(ext) AS DECIMAL(14,2)) AS printed_total, any_value(CAST(o_orderdate AS DATE)) AS order_date, 'Clinic ' || any_value(o_custkey) AS ship_to
FROM x JOIN orders ON o_orderkey = doc_id GROUP BY doc_id""",
)
def s5(spark, sf_dir):
    return O.headers(order_documents(spark, sf_dir))


DEDUPED = LINES + ", y AS (SELECT * FROM x WHERE doc_id IN (SELECT o_orderkey FROM orders) QUALIFY row_number() OVER (PARTITION BY doc_id, sku, qty, unit, ext ORDER BY n) = 1), t AS (SELECT doc_id, count(*) AS items, CAST(sum(ext) AS DECIMAL(14,2)) AS computed_total FROM y GROUP BY doc_id), f AS (SELECT doc_id, CAST(sum(ext) AS DECIMAL(14,2)) AS printed_total FROM x GROUP BY doc_id)"


@query("s29_order_preview", DEDUPED + " SELECT doc_id, items, computed_total, printed_total, abs(computed_total - printed_total) > 0.01 AS off FROM t JOIN f USING (doc_id)")
def s29(spark, sf_dir):
    docs = order_documents(spark, sf_dir)
    return O.preview(O.headers(docs), O.order_lines(docs)).select("doc_id", "items", "computed_total", "printed_total", "off")


@query("j19_cross_check", DEDUPED + " SELECT doc_id, items, coalesce(items = (SELECT count(*) FROM x WHERE x.doc_id = t.doc_id) AND abs(computed_total - printed_total) <= 0.01, false) AS ok FROM t JOIN f USING (doc_id)")
def j19(spark, sf_dir):
    docs = order_documents(spark, sf_dir)
    lines, heads = O.order_lines(docs), O.headers(docs)
    known = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct().groupBy("l_orderkey").agg(F.count("*").alias("item_count"))
    expected = heads.join(known, F.col("doc_id") == F.col("l_orderkey")).select("reference", "item_count", "printed_total")
    return O.cross_check(heads, lines, expected, ["street", "suite"]).select("doc_id", "items", "ok")


@query("a1_order_totals", "SELECT l_orderkey AS order_id, count(*) AS items, CAST(sum(CAST(floor(l_extendedprice * 100 + 0.5) / 100 AS DECIMAL(12,2))) AS DECIMAL(18,2)) AS computed_total FROM lineitem GROUP BY 1")
def a1(spark, sf_dir):
    return A.order_totals(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_id"), cents(F.col("l_extendedprice")).alias("extended_price")))


@query(
    "a2_reconcile_totals",
    """WITH t AS (SELECT l_orderkey AS order_id, count(*) AS items, CAST(sum(CAST(floor(l_extendedprice * 100 + 0.5) / 100 AS DECIMAL(12,2))) AS DECIMAL(18,2)) AS total FROM lineitem GROUP BY 1)
SELECT o_orderkey AS order_id, coalesce(total, 0)::DECIMAL(18,2) AS computed_total, abs(coalesce(total, 0) - CAST(floor(o_totalprice * 100 + 0.5) / 100 AS DECIMAL(12,2))) > 0.01 AS off FROM orders LEFT JOIN t ON o_orderkey = order_id""",
)
def a2(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), cents(F.col("o_totalprice")).cast("decimal(12,2)").alias("printed_total"))
    totals = a1(spark, sf_dir)
    return A.reconcile(orders, totals).select("order_id", "computed_total", "off")


@query("a9_items_per_order", "SELECT l_orderkey AS order_id, count(*) AS items FROM lineitem GROUP BY 1")
def a9(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("order_id")).agg(F.count("*").alias("items"))


@query("j15_findings_to_items", "SELECT l_partkey AS sku, max(l_orderkey * 8 + l_linenumber) AS item_id FROM lineitem GROUP BY 1")
def j15(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("sku"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("item_id"))
    return K.last_wins(items, "sku", "item_id")


@query("j2_equivalency_first", "SELECT l_partkey AS sku, arg_min(s, k) AS equivalent FROM (SELECT l_partkey, l_suppkey AS s, (l_orderkey * 8 + l_linenumber) * 100000 + l_suppkey AS k FROM lineitem) GROUP BY 1")
def j2(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("sku"), F.col("l_suppkey").alias("equivalent"), ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 100000 + F.col("l_suppkey")).alias("line_no"))
    return K.first_wins(li, "sku", "line_no").select("sku", "equivalent")


@query(
    "s27_order_runs",
    "SELECT o_custkey AS id, arg_max(o_orderstatus, o_orderkey) AS status, arg_max(o_orderpriority, o_orderkey) FILTER (o_orderkey % 2 = 0) AS reference, max(o_orderdate) AS updated_at FROM orders GROUP BY 1",
)
def s27(spark, sf_dir):
    from ..operators.runs import current_runs

    o = table(spark, sf_dir, "orders")
    changes = o.select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("seq"), F.col("o_orderdate").alias("at"), F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).alias("reference"))
    return current_runs(changes, ["status", "reference"]).select("id", "status", "reference", "updated_at")


@query("t6_newest_runs", "SELECT id, updated_at FROM (SELECT o_custkey AS id, max(o_orderdate) AS updated_at FROM orders GROUP BY 1) ORDER BY updated_at DESC, id LIMIT 200")
def t6(spark, sf_dir):
    from ..operators.runs import current_runs, newest

    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("seq"), F.col("o_orderdate").alias("at"), F.col("o_orderstatus").alias("status"))
    return newest(current_runs(o, ["status"])).select("id", "updated_at")


@query(
    "s30_history_view",
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'PO-' || o_orderkey ELSE 'order_' || o_orderkey END AS reference, CASE WHEN o_orderstatus = 'F' THEN 'order_' || o_orderkey || '/price_match' END AS price_match FROM orders""",
)
def s30(spark, sf_dir):
    from ..operators.runs import history_view

    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey").cast("string")
    runs = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("PO-"), k)).otherwise("").alias("reference"), F.concat(F.lit("order_"), k, F.lit(".pdf")).alias("filename"), F.when(F.col("o_orderstatus") == "F", "complete").otherwise("running").alias("status"), F.concat(F.lit("order_"), k).alias("folder"))
    return history_view(runs).select("id", "reference", F.col("reports.price_match").alias("price_match"))


# Reports of ninety references, of which every third has a run; orders of two references of three.
@query(
    "s28_backfill_runs",
    """WITH f AS (SELECT DISTINCT c_custkey % 90 AS r FROM customer), o AS (SELECT o_custkey % 90 AS r, max(o_orderkey) AS id FROM orders WHERE o_custkey % 90 % 3 > 0 AND o_custkey % 90 % 4 > 0 GROUP BY 1),
n AS (SELECT l_orderkey AS id, count(*) AS items FROM lineitem GROUP BY 1)
SELECT 'legacy-R ' || r AS id, 'R ' || r AS reference, CASE WHEN o.id IS NULL THEN 'R ' || r || '.pdf' ELSE 'order ' || o.id || '.pdf' END AS filename, 'complete' AS status, coalesce(items, 0) AS items, CAST(o_totalprice AS DECIMAL(14,2)) AS total_price, o_orderdate AS created_at
FROM f LEFT JOIN o USING (r) LEFT JOIN n ON n.id = o.id LEFT JOIN orders ON o_orderkey = o.id WHERE r % 3 > 0""",
)
def s28(spark, sf_dir):
    from ..operators.reports import write_reports
    from ..operators.runs import backfill
    from ..sources import files as L

    name = lambda c: F.concat(F.lit("R "), (F.col(c) % 90).cast("string"))
    at = L.shared_folder(spark, "reports")
    write_reports({"price_match": table(spark, sf_dir, "customer").select(name("c_custkey").alias("reference"), "c_custkey").repartition("reference")}, at)
    o = table(spark, sf_dir, "orders")
    runs = o.filter("o_custkey % 90 % 3 = 0").select(F.concat(F.lit("legacy-"), name("o_custkey")).alias("id")).distinct()
    orders = o.filter("o_custkey % 90 % 3 > 0 AND o_custkey % 90 % 4 > 0").select(F.col("o_orderkey").alias("id"), name("o_custkey").alias("reference"), F.concat(F.lit("order "), F.col("o_orderkey"), F.lit(".pdf")).alias("filename"), F.col("o_totalprice").cast("decimal(14,2)").alias("total_price"), F.col("o_orderdate").alias("created_at"))
    out = backfill(L.written_reports(spark, at), runs, orders, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_id")))
    # where no order tells the time, it is that of the file, which SQL can't know
    return out.withColumn("created_at", F.when(F.col("total_price").isNotNull(), F.col("created_at").cast("timestamp_ntz")))
