r"""Benchmark decontamination by a broadcast hash set of normalised n-grams.

Words are runs of [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing A-Z. A
window is `window` consecutive words of a benchmark item; an item with fewer
words, but not none, is one window. Everything is DataFrame functions, in one
pass over the texts:

1. Benchmark windows are keyed by a hash of their first words and broadcast if
   their bytes, which are counted first, are below a limit; else they are joined
   by a shuffle, behind a sieve of their keys.
2. A document's words are cut once and hashed once each; hashes of neighbours are
   combined, by doubling, to the hash of the words from each place on.
3. What is found is verified on the words themselves, in the same task.
4. Documents that are hit, or their spans, are removed behind a sieve: the others
   aren't shuffled.

Defined cases: null and empty texts have no words and aren't contaminated; a
null item text has no windows; a null item_id is the empty string; repeated
rows give repeated results; with an empty benchmark nothing is hit; further
columns of docs are kept by decontaminate(); null doc_ids are told apart by
their texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, sha256_hex, sieve, sifted, table

OTHERS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_CASE, NEITHER = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words that make a key; shorter windows are keyed by all of theirs.
PREFIX = 8
#: Bytes of windows, with the names of their items, that are broadcast at most.
BROADCAST_BYTES = 200_000_000


def lowered(text: Column) -> Column:
    """text with A-Z lower-cased and nothing else; the quicker function is right where all characters are ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def word_array(text: Column) -> Column:
    return F.array_remove(F.split(lowered(F.coalesce(text, F.lit(""))), OTHERS), "")


def _key(words: str, at: Column, length: int) -> Column:
    """Of length words from place at, which counts from 0."""
    return F.xxhash64(F.lit(length), *(F.get(F.col(words), at + i) for i in range(length)))


def benchmark_windows(bench: DataFrame, window: int = 13) -> DataFrame:
    """key, prefix (words in the key), words (of the window, joined by spaces), length, items array<string>."""
    most = min(PREFIX, window)
    items = bench.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.explode(F.array(word_array(F.col("text")))).alias("w")).filter(F.size("w") > 0)
    items = items.withColumn("length", F.least(F.size("w"), F.lit(window))).withColumn("prefix", F.least("length", F.lit(most)))
    at = items.select("item", "w", "length", "prefix", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("length"))).alias("at"))
    key = F.lit(None).cast("long")
    for n in range(1, most + 1):
        key = F.when(F.col("prefix") == n, _key("w", F.col("at"), n)).otherwise(key)
    at = at.select("item", "length", "prefix", key.alias("key"), F.array_join(F.slice("w", F.col("at") + 1, F.col("length")), " ").alias("words"))
    return at.groupBy("key", "prefix", "words", "length").agg(F.collect_set("item").alias("items"))


def found_windows(docs: DataFrame, bench: DataFrame, window: int = 13) -> DataFrame:
    """docs (doc_id, text) -> a row for each of them (at = -1) and for each verified window: doc_id, raw (hash of the text), n_words, at, length, items."""
    windows = cut(benchmark_windows(bench, window), "windows")
    size = F.octet_length("words") + F.aggregate("items", F.lit(0), lambda a, x: a + F.octet_length(x) + 16) + 100
    # at most PREFIX rows
    seen = {r["prefix"]: r["bytes"] for r in windows.groupBy("prefix").agg(F.sum(size).alias("bytes")).collect()}
    lengths = sorted(seen) or [1]
    w = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("raw"), word_array(F.col("text")).alias("w"))
    # a row for the text (at = -1) and one for each word. The outer form, as no filter on the number
    # of words is then pushed to the scan, which would cut the words a second time
    places = w.select("doc_id", "raw", "w", F.size("w").alias("n_words"), F.posexplode_outer(F.concat(F.array(F.lit("")), "w")).alias("pos", "word"))
    places = places.withColumn("at", F.col("pos") - 1).drop("pos", "word")
    keys = [F.when((F.col("at") >= 0) & (F.col("at") + n <= F.col("n_words")), _key("w", F.col("at"), n)) for n in lengths]
    if len(keys) == 1:
        places = places.withColumn("of", F.lit(0)).withColumn("key", keys[0])
    else:
        places = places.select("*", F.posexplode(F.array(*keys)).alias("of", "key"))
    every = (F.col("at") < 0) & (F.col("of") == 0)
    verified = lambda said: F.coalesce(F.array_join(F.slice(said, 1, F.col("length")), " ") == F.col("words"), F.lit(False))
    columns = ("doc_id", "raw", "n_words", "at", "length", "items")
    if sum(seen.values()) <= BROADCAST_BYTES:
        met = places.join(F.broadcast(windows), "key", "left")
        met = met.filter(every | F.col("prefix").isNotNull() & verified(F.slice("w", F.col("at") + 1, F.col("length")))).select(*columns)
    else:
        bits = cut(sieve(windows, F.col("key")), "sieve")
        maybe = sifted(places.filter("key IS NOT NULL"), F.col("key"), bits, "maybe").filter("maybe")
        maybe = maybe.select("doc_id", "raw", "n_words", "at", "key", F.slice("w", F.col("at") + 1, F.lit(window)).alias("said"))
        met = maybe.join(windows, "key").filter(verified(F.col("said"))).select(*columns)
        met = met.unionByName(w.select("doc_id", "raw", F.size("w").alias("n_words"), F.lit(-1).alias("at")), allowMissingColumns=True)
    return cut(met, "found")


def hit_documents(found: DataFrame) -> DataFrame:
    """h_id, h_raw, n_words, covered array<int> (the words that are hit), items array<string> (sorted) of each document with windows."""
    inside = found.filter("at >= 0").groupBy("doc_id", "raw").agg(F.max("n_words").alias("n_words"), F.collect_set(F.struct("at", "length")).alias("runs"), F.collect_set("items").alias("items"))
    covered = F.array_distinct(F.flatten(F.transform("runs", lambda x: F.sequence(x["at"], x["at"] + x["length"] - 1))))
    return inside.select(F.col("doc_id").alias("h_id"), F.col("raw").alias("h_raw"), "n_words", covered.alias("covered"), F.array_sort(F.array_distinct(F.flatten("items"))).alias("items"))


def contamination(docs: DataFrame, bench: DataFrame, window: int = 13) -> DataFrame:
    """For every row of docs: doc_id, n_words, n_hit, n_items, items array<string> (sorted), contaminated."""
    found = found_windows(docs.select("doc_id", "text"), bench, window)
    hit = hit_documents(found).select("h_id", "h_raw", F.size("covered").cast("long").alias("hit"), "items")
    every = found.filter("at < 0").select("doc_id", "raw", F.col("n_words").cast("long").alias("n_words"))
    met = every.join(hit, F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("raw") == F.col("h_raw")), "left")
    met = met.select("doc_id", "n_words", F.coalesce("hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return met.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))


def contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (20 * n_hit >= n_words)


def without_words(text: Column, n_words: Column, covered: Column) -> Column:
    """text without the words at the places covered and what stands between two neighbours of them; linear in its length.

    A text is gap, word, gap, ..., word, gap. What stays are stretches between runs of covered words.
    """
    gaps, words = F.split(text, ANY_CASE), F.array_remove(F.split(text, NEITHER), "")
    first = F.sort_array(F.array_except(covered, F.transform(covered, lambda x: x + 1)))
    last = F.sort_array(F.array_except(covered, F.transform(covered, lambda x: x - 1)))
    # a stretch is from the word after a run (or 0) up to the word before the next run (or the last)
    stretch = F.zip_with(F.concat(F.array(F.lit(0)), F.transform(last, lambda x: x + 1)), F.concat(first, F.array(n_words)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    made = F.struct(gaps.alias("gaps"), words.alias("words"), stretch.alias("stretch"))

    def joined(x: Column) -> Column:
        parts = F.transform(
            x["stretch"],
            lambda s: F.array_join(F.flatten(F.zip_with(F.slice(x["gaps"], s["a"] + 1, s["b"] - s["a"] + 1), F.slice(x["words"], s["a"] + 1, s["b"] - s["a"]), lambda g, w: F.array(g, F.coalesce(w, F.lit(""))))), ""),
        )
        return F.array_join(parts, "")

    # made is bound to a lambda's variable, so that it is computed once for a text
    return F.get(F.transform(F.array(made), joined), 0)


def decontaminate(docs: DataFrame, bench: DataFrame, window: int = 13, spans: bool = False) -> DataFrame:
    """docs without contaminated documents, with its columns.

    spans: keep these documents and remove the hit words, with what stands
    between them, from the text instead (n_chars, if there, follows).
    """
    columns = docs.columns
    bad = hit_documents(found_windows(docs.select("doc_id", "text"), bench, window))
    bad = cut(bad.filter(contaminated(F.size("covered"), F.col("n_words"))).select("h_id", "h_raw", "n_words", *(["covered"] if spans else [])), "contaminated")
    bits = cut(sieve(bad, F.xxhash64("h_id", "h_raw")), "sieve")
    # names of our own can't clash with further columns
    inner = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("raw"), F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"))
    inner = sifted(inner, F.xxhash64("doc_id", "raw"), bits, "maybe")
    rest = inner.filter("NOT maybe").select("row.*")
    met = inner.filter("maybe").join(bad, F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("raw") == F.col("h_raw")), "left")
    if not spans:
        return rest.unionByName(met.filter("n_words IS NULL").select("row.*"))
    is_bad = F.col("n_words").isNotNull()
    met = met.withColumn("cleaned", F.when(is_bad, without_words(F.col("row.text"), F.col("n_words"), F.col("covered"))).otherwise(F.col("row.text")))
    names = []
    for c in columns:
        if c == "text":
            names.append(F.col("cleaned").alias("text"))
        elif c == "n_chars":
            names.append(F.when(is_bad, F.char_length("cleaned").cast("long")).otherwise(F.col("row.n_chars")).alias("n_chars"))
        else:
            names.append(F.col(f"row.`{c}`").alias(c))
    return rest.unionByName(met.select(*names))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return c.select("doc_id", "n_words", "n_hit", "n_items", sha256_hex(F.array_join("items", ",")).alias("items_sha256"), "contaminated")


OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 11, 2))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
h AS (SELECT doc_id, i, dw.n, item FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""
