"""Order documents: text lines, cells, order lines, headers, checks.

A document is text; its lines are rows (doc_id, pos, token). Order lines come in
two grammars: one cell to a line (quantity, sku, up to five lines of description,
unit, $ price, $ total), or all in one line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions import text as T

MONEY = r"\$([\d,]+\.\d{2})"
MOST_CELLS = 5


def with_tokens(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with tokens array<struct<pos, token>>: trimmed lines that aren't empty. A document is a row, so nothing is shuffled."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("pos"), F.btrim(x, F.lit(" \t\n\x0b\f\r")).alias("token")))
    return docs.withColumn("tokens", F.filter(lines, lambda t: t["token"] != ""))


def scan_text(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, pos, token."""
    return with_tokens(docs).select("doc_id", F.inline("tokens"))


def _money(c):
    return T.number(F.replace(F.regexp_extract(c, MONEY, 1), F.lit(",")), "decimal(12,2)")


def cell_rows(tokens: Column) -> Column:
    """The cell grammar: rows in place, of cells that no earlier row has taken.

    A row starts at a quantity whose next cell is a sku; the description may take
    one to five cells up to a unit cell that two money cells follow. A fold over the
    few rows that fit somewhere drops those that begin inside a row before them.
    """
    at = lambda i, k=0: F.get(tokens, i + k)["token"]

    def row(i: Column) -> Column:
        out = F.lit(None).cast(f"struct<n:int,cells:int,line:{LINE}>")
        for d in range(MOST_CELLS, 0, -1):
            fits = F.rlike(at(i, d + 2), F.lit("^[A-Z]{2,3}$")) & F.rlike(at(i, d + 3), F.lit(f"^{MONEY}$")) & F.rlike(at(i, d + 4), F.lit(f"^{MONEY}$"))
            line = _line(F.get(tokens, i)["pos"], 0, at(i), at(i, 1), F.concat_ws(" ", *(at(i, k) for k in range(2, d + 2))), at(i, d + 2), _money(at(i, d + 3)), _money(at(i, d + 4)))
            out = F.when(F.coalesce(fits, F.lit(False)), F.struct(i.alias("n"), F.lit(d + 5).alias("cells"), line.alias("line"))).otherwise(out)
        return out

    starts = F.filter(F.transform(tokens, lambda t, i: i), lambda i: F.rlike(at(i), F.lit(r"^\d{1,5}$")) & F.coalesce(F.rlike(at(i, 1), F.lit(r"^\d{6,8}$")), F.lit(False)))
    none = F.struct(F.lit(-1).alias("end"), F.array().cast(f"array<{LINE}>").alias("kept"))
    take = lambda a, x: F.struct((x["n"] + x["cells"] - 1).alias("end"), F.concat(a["kept"], F.array(x["line"])).alias("kept"))
    return F.aggregate(F.array_compact(F.transform(starts, row)), none, lambda a, x: F.when(x["n"] > a["end"], take(a, x)).otherwise(a), lambda a: a["kept"])


def single_rows(tokens: Column) -> Column:
    """The grammar of one line to a row."""
    pattern = rf"^(\d{{1,5}})\s+(\d{{6,8}})\s+(.+?)\s+([A-Z]{{2,3}})\s+{MONEY}\s+{MONEY}$"

    # one match puts a separator between its groups; a description may hold it, the others can't
    cut, last = "\x01", lambda g, k: F.get(g, F.size(g) - k)

    def line(t: Column, g: Column) -> Column:
        number = lambda x: T.number(F.replace(x, F.lit(",")), "decimal(12,2)")
        description = F.array_join(F.slice(g, F.lit(3), F.size(g) - 5), cut)
        return _line(t["pos"], 1, F.get(g, 0), F.get(g, 1), description, last(g, 3), number(last(g, 2)), number(last(g, 1)))

    groups = lambda t: F.split(F.regexp_replace(t["token"], pattern + r"\R?", cut.join(f"${k}" for k in range(1, 7))), cut)
    return F.transform(F.filter(tokens, lambda t: F.rlike(t["token"], F.lit(pattern))), lambda t: T.let(groups(t), lambda g: line(t, g)))


LINE = "struct<pos:int,pass:int,qty:int,sku:string,description:string,uom:string,unit_price:decimal(12,2),extended_price:decimal(12,2)>"


def _line(pos, number: int, qty, sku, description, uom, unit, total) -> Column:
    return F.struct(pos.alias("pos"), F.lit(number).alias("pass"), qty.cast("int").alias("qty"), sku.alias("sku"), description.alias("description"), uom.alias("uom"), unit.alias("unit_price"), total.alias("extended_price"))


def parse_cells(docs: DataFrame) -> DataFrame:
    return with_tokens(docs).select("doc_id", F.inline(cell_rows(F.col("tokens"))))


def parse_single(docs: DataFrame) -> DataFrame:
    return with_tokens(docs).select("doc_id", F.inline(single_rows(F.col("tokens"))))


def validate(lines: DataFrame) -> DataFrame:
    """Rows whose quantity times price is the total within five cents; the first of equal ones, cells before single lines."""
    ok = lines.filter(F.abs(F.col("qty") * F.col("unit_price") - F.col("extended_price")) <= C.LINE_TOLERANCE)
    w = Window.partitionBy("doc_id", "sku", "qty", "unit_price", "extended_price").orderBy("pass", "pos")
    return ok.withColumn("k", F.row_number().over(w)).filter("k = 1").drop("k")


def order_lines(docs: DataFrame) -> DataFrame:
    """docs -> validated lines of both grammars, with the pack that the description states."""
    tokens = F.col("tokens")
    lines = validate(with_tokens(docs).select("doc_id", F.inline(F.concat(cell_rows(tokens), single_rows(tokens)))))
    return lines.withColumn("pack_qty", T.pack_of(F.col("description"))["count"])


def headers(docs: DataFrame) -> DataFrame:
    """reference, printed_total, order_date, ship_to: the first of each in a document."""
    ship = F.array_position(F.transform("tokens", lambda t: F.lower(t["token"])), "ship to").cast("int")
    text = F.col("text")
    return with_tokens(docs).select(
        "doc_id",
        F.nullif(F.regexp_extract(text, r"OR\d{16,22}", 0), F.lit("")).alias("reference"),
        T.number(F.replace(F.regexp_extract(text, rf"Total(?: Price)?:?\s*{MONEY}", 1), F.lit(",")), "decimal(14,2)").alias("printed_total"),
        F.try_to_date(F.regexp_extract(text, r"\b\d{2}/\d{2}/\d{4}\b", 0), "MM/dd/yyyy").alias("order_date"),
        F.when(ship > 0, F.get("tokens", ship)["token"]).alias("ship_to"),
    )


def cross_check(orders: DataFrame, lines: DataFrame, expected: DataFrame, words: list[str]) -> DataFrame:
    """expected (reference, item_count, printed_total) beside what was parsed; phantom lines have an address word in the description."""
    totals = lines.groupBy("doc_id").agg(F.count("*").alias("items"), F.sum("extended_price").cast("decimal(14,2)").alias("computed_total"), F.count_if(F.rlike(F.lower("description"), F.lit("|".join(rf"\b{w}\b" for w in words)))).alias("phantoms"))
    df = expected.join(orders.select("doc_id", "reference", F.col("printed_total").alias("parsed_total")), "reference", "left").join(totals, "doc_id", "left")
    ok = (F.col("items") == F.col("item_count")) & (F.abs(F.col("computed_total") - F.col("printed_total")) <= C.ORDER_TOLERANCE) & (F.col("phantoms") == 0)
    return df.withColumn("ok", F.coalesce(ok, F.lit(False)))


def preview(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """Headers beside their lines' count and total, without anything looked up."""
    totals = lines.groupBy("doc_id").agg(F.count("*").alias("items"), F.sum("extended_price").cast("decimal(14,2)").alias("computed_total"))
    df = orders.join(totals, "doc_id", "left")
    return df.withColumn("off", F.abs(F.coalesce("computed_total", F.lit(0)) - F.col("printed_total")) > C.ORDER_TOLERANCE)
