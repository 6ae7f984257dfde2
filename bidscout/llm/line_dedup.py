r"""Line dedup by distinct-site spread.

For each line that is on enough rows a HyperLogLog sketch of the sites (sources)
that have it merges by aggregation. Only lines whose estimate lies within a margin
of the threshold are paired with their sites, for an exact distinct count; the
others are decided by the estimate. A line on at
least min_sites sites is boilerplate: it is removed everywhere but at its first
occurrence, in the smallest doc_id that has it, so that no text is lost.

Lines are cut at \n and compared without the characters [\x20\x09-\x0D] at their
ends, by a 128-bit hash; blank lines are never boilerplate.

Pre-aggregation in each map task makes a hot line one row for each task; the
rows of documents meet the boilerplate lines in a join that AQE can broadcast
(few lines) or split (hot lines). Texts that lose no line stay where they are.

Defined cases: a null source is a site of its own; null text has no lines and
stays null; null doc_ids come last; repeated rows (doc_id, text) keep or lose
the same lines; an empty table gives no rows; further columns are kept. Of a
table with fewer than min_sites sources no line is removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import SPACES, cut, sha256_hex, sieve, sifted, table

#: Lines of documents that are merely copied are on a few sites (3 at most for lines of over 50
#: words in sf0.1's documents), boilerplate is on 8 or more of its 20 (from 11 for those lines).
MIN_SITES = 8
LG_K = 10
#: Five standard errors of a sketch with 2**LG_K registers.
MARGIN = 5 * 1.04 / 2 ** (LG_K / 2)


def exploded(docs: DataFrame) -> DataFrame:
    """doc_id, raw (hash of the text), site, at (place of the line, from 0), line (16 bytes; blank lines are left out)."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("raw"), F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("site"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    lines = lines.withColumn("line", F.btrim("line", F.lit(SPACES)))
    return lines.filter("line != ''").withColumn("line", F.unhex(F.md5("line")))


def frequent(docs: DataFrame, min_sites: int) -> DataFrame:
    """exploded(), of lines that are on so many rows at least: others can't be on so many sites."""
    lines = exploded(docs)
    often = cut(lines.groupBy("line").agg(F.count("*").alias("n")).filter(F.col("n") >= min_sites).select("line"), "often")
    bits = cut(sieve(often, F.xxhash64("line")), "sieve")
    maybe = sifted(lines, F.xxhash64("line"), bits, "maybe").filter("maybe").drop("maybe")
    return cut(maybe.join(often, "line", "left_semi"), "frequent")


def boilerplate(rows: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """rows: of frequent(). line, first_id, first_raw, first_at: the lines on at least min_sites sites and where each stays."""
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("doc_id"), F.col("raw").alias("raw"), F.col("at").alias("at"))
    sketches = rows.groupBy("line").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"), F.min(place).alias("first"))
    spread = cut(sketches.select("line", "first", F.hll_sketch_estimate("sketch").alias("sites")).filter(F.col("sites") >= min_sites * (1 - MARGIN)), "spread")
    # lines and sites are paired only for lines whose estimate doesn't decide
    near = F.col("sites") <= min_sites * (1 + MARGIN)
    pairs = rows.join(spread.filter(near).select("line"), "line", "left_semi").select("line", "site").distinct()
    exact = pairs.groupBy("line").agg(F.count("*").alias("exact")).filter(F.col("exact") >= min_sites)
    wide = spread.filter(~near).unionByName(spread.filter(near).join(exact, "line", "left_semi"))
    return wide.select("line", F.col("first.doc_id").alias("first_id"), F.col("first.raw").alias("first_raw"), F.col("first.at").alias("first_at"))


def removals(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """r_id, r_raw, places array<int>: for each document that loses lines, which."""
    rows = frequent(docs, min_sites)
    lines = rows.join(cut(boilerplate(rows, min_sites), "boilerplate"), "line")
    stays = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("raw") == F.col("first_raw")) & (F.col("at") == F.col("first_at"))
    gone = lines.filter(~stays).groupBy("doc_id", "raw").agg(F.collect_set("at").alias("places"))
    return cut(gone.select(F.col("doc_id").alias("r_id"), F.col("raw").alias("r_raw"), "places"), "removals")


@F.pandas_udf(StringType())
def without(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """The text without the lines at the places given."""
    for text, places in parts:
        out = []
        for t, p in zip(text, places, strict=True):
            if t is not None and p is not None and len(p):
                gone = set(p)
                t = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone)
            out.append(t)
        yield pd.Series(out, dtype=object)


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """docs, all rows and columns, with boilerplate lines removed from text; n_chars, if there, follows; adds removed_lines."""
    columns = docs.columns
    gone = removals(docs.select("doc_id", "text", "source"), min_sites)
    bits = cut(sieve(gone, F.xxhash64("r_id", "r_raw")), "sieve")
    # only texts that lose lines are shuffled, and go through Python
    inner = docs.select("doc_id", "text", F.xxhash64("text").alias("raw"), F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"))
    inner = sifted(inner, F.xxhash64("doc_id", "raw"), bits, "maybe")
    met = inner.filter("maybe").join(gone, F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("raw") == F.col("r_raw")), "left").select("text", "row", "places")
    changed = met.filter("places IS NOT NULL").withColumn("text", without("text", "places"))
    same = met.filter("places IS NULL").unionByName(inner.filter("NOT maybe").select("text", "row", F.lit(None).cast("array<int>").alias("places")))
    both = changed.unionByName(same)
    names = []
    for c in columns:
        if c == "text":
            names.append(F.col("text"))
        elif c == "n_chars":
            names.append(F.when(F.col("places").isNull(), F.col("row.n_chars")).otherwise(F.char_length("text").cast("long")).alias("n_chars"))
        else:
            names.append(F.col(f"row.`{c}`").alias(c))
    return both.select(*names, F.coalesce(F.size("places"), F.lit(0)).alias("removed_lines"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, n_chars (left), kept_sha256 (of the text that is left)."""
    docs = table(spark, sf_dir, "documents")
    cleaned = dedup_lines(docs.select("doc_id", "text", "source"))
    text = F.coalesce("text", F.lit(""))
    lines = F.when(F.col("text").isNull(), 0).otherwise(F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"))) + 1)
    left = F.when((text == "") & (F.col("removed_lines") > 0), 0).otherwise(lines)
    return cleaned.select(
        "doc_id",
        (left + F.col("removed_lines")).cast("long").alias("n_lines"),
        F.col("removed_lines").cast("long").alias("n_removed"),
        F.char_length(text).cast("long").alias("n_chars"),
        sha256_hex(text).alias("kept_sha256"),
    )


OP9_SQL = r"""
WITH l AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS raw_line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents WHERE text IS NOT NULL),
t AS (SELECT *, regexp_replace(raw_line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS line FROM l),
b AS (SELECT line, min((doc_id, pos)) AS first FROM t WHERE line <> '' GROUP BY line HAVING count(DISTINCT coalesce('=' || source, '')) >= 8),
k AS (SELECT doc_id, pos, raw_line, b.line IS NOT NULL AND (doc_id, pos) <> b.first AS gone FROM t LEFT JOIN b USING (line)),
g AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(raw_line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS kept FROM k GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
  CAST(length(coalesce(kept, '')) AS BIGINT) AS n_chars, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN g USING (doc_id)
"""
