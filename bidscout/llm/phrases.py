r"""Phrase mining by top-order marginalisation.

Only the longest windows are counted: at each word the columns c1..cN are the word
and the words that lead it by 1..N-1 places, padded where the piece ends. Spark's
ROLLUP over these counts then sums ever shorter prefixes, which are the counts of
all shorter phrases; no n-grams of other lengths are made.

Words are coded before they are counted. A first pass counts the words of each
lang; those that occur often enough to be in any phrase, the most frequent first
and VOCABULARY at most, get numbers, so that windows are rows of small integers.
A window ends before a word without a number, as its prefixes do. If frequent words
are left without one, windows that hold such a word are counted as texts in the
same way, and give the phrases that contain it; so no phrase is lost.

Counts are aggregated in each map task before they are shuffled, so a hot pair of
words is one row for each task and third word. Products are decimals of 38 digits.

Defined cases: null text is empty, null lang is `und`; repeated rows count each;
words of any length count; an empty table gives no rows; further columns are
ignored. Ties of score and count are ordered by phrase, in byte order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

#: Numbered words at most, and the bytes of the longest: the bound of what is sent to every task.
VOCABULARY, LONGEST_WORD = 1 << 20, 64
#: Bytes of text that are cut into words at once.
CHUNK = 1 << 22
#: Characters that end a piece, and that part words.
ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
END = re.compile(rb"[.,;:!?\x0A-\x0D]")
PAD = 0

KIND = np.zeros(256, np.uint8)
KIND[list(BLANKS)], KIND[list(ENDS)] = 1, 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def chunks(part: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    """lang, text: the texts of each lang, a line each, in chunks that end with pieces."""
    langs = pc.fill_null(part.column(0), "und").dictionary_encode()
    texts = pc.fill_null(part.column(1), "")
    for number, lang in enumerate(langs.dictionary.to_pylist()):
        own = texts.filter(pc.equal(langs.indices, number)).cast(pa.large_binary())
        held, size = [], 0
        for text in own:
            held.append(text.as_buffer())
            size += len(held[-1])
            if size >= CHUNK:
                yield from pieces(lang, b"\n".join(held))
                held, size = [], 0
        yield from pieces(lang, b"\n".join(held))


def pieces(lang: str, text: bytes) -> Iterator[tuple[str, bytes]]:
    at = 0
    while at < len(text):
        end = END.search(text, at + CHUNK)
        till = end.end() if end else len(text)
        yield lang, text[at:till]
        at = till


def words_of(text: bytes) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased words, and the number of the piece that each is in."""
    raw = np.frombuffer(text, np.uint8)
    kind = KIND[raw]
    inside = kind == 0
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    stops = np.flatnonzero(kind == 2)
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    letters = LOWER[raw[inside]]
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
    return words, np.searchsorted(stops, starts)


def led(codes: np.ndarray, piece: np.ndarray, k: int) -> np.ndarray:
    """The code that leads by k places; PAD beyond the piece."""
    out = np.full(len(codes), PAD, codes.dtype)
    if len(codes) > k:
        out[:-k] = np.where(piece[:-k] == piece[k:], codes[k:], PAD)
    return out


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, n: the occurrences of each word."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for lang, text in chunks(part):
                counts = words_of(text)[0].value_counts()
                n = len(counts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), counts.field("values").cast(pa.string()), counts.field("counts").cast(pa.int64())], names=["lang", "word", "n"])

    each = docs.select("lang", "text").mapInArrow(run, "lang string, word string, n long")
    return each.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame, least: int) -> tuple[pa.Table, bool]:
    """lang, word of the numbered words (number: its row, from 1), and whether frequent words are left out.

    The least count that a numbered word has is chosen by a histogram, so that
    they are VOCABULARY at most.
    """
    often = counts.filter(F.col("n") >= least)
    short = F.octet_length("word") <= LONGEST_WORD
    step = F.when(F.col("n") < 1 << 12, F.col("n")).otherwise((F.log2(F.col("n").cast("double")) * 256).cast("long") + (1 << 12) - 12 * 256)
    sizes = often.groupBy(step.alias("step")).agg(F.count("*").alias("all"), F.count_if(short).alias("short")).orderBy(F.desc("step")).collect()
    from_step, held = None, 0
    for row in sizes:
        if held + row["short"] > VOCABULARY:
            break
        from_step, held = row["step"], held + row["short"]
    if from_step is None:
        return pa.table({"lang": pa.array([], pa.string()), "word": pa.array([], pa.string())}), bool(sizes)
    chosen = often.filter(short & (step >= from_step)).select("lang", "word")
    return chosen.toArrow(), held < sum(row["all"] for row in sizes)


class Coder:
    """Numbers words: from 1 on by their rows in the vocabulary, 0 for others."""

    def __init__(self, words: pa.Table):
        langs = words.column("lang").combine_chunks().dictionary_encode()
        every = words.column("word").combine_chunks().cast(pa.large_string())
        self.of = {}
        for number, lang in enumerate(langs.dictionary.to_pylist()):
            rows = np.flatnonzero(langs.indices.to_numpy() == number)
            self.of[lang] = (every.take(pa.array(rows)), rows.astype(np.int32) + 1)

    def codes(self, lang: str, words: pa.Array) -> np.ndarray:
        if lang not in self.of:
            return np.zeros(len(words), np.int32)
        own, number = self.of[lang]
        at = pc.fill_null(pc.index_in(words, value_set=own), -1).to_numpy()
        return np.where(at >= 0, number[at], 0).astype(np.int32)


def _sent(spark: SparkSession, words: pa.Table):
    """The vocabulary as a broadcast value; its coder is made once in each Python worker."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, words.schema) as out:
        out.write_table(words)
    return spark.sparkContext.broadcast(sink.getvalue().to_pybytes())


def _received(sent) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(sent.value)).read_all()


def coded_windows(docs: DataFrame, sent, longest: int) -> DataFrame:
    """c1..cN: the windows that begin with a numbered word."""
    names = [f"c{k + 1}" for k in range(longest)]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(_received(sent))
        for part in parts:
            for lang, text in chunks(part):
                words, piece = words_of(text)
                codes = coder.codes(lang, words)
                columns, known = [codes], codes > 0
                for k in range(1, longest):
                    known &= (code := led(codes, piece, k)) > 0
                    columns.append(np.where(known, code, PAD))
                begins = codes > 0
                for at in range(0, len(codes), 1 << 18):
                    some = slice(at, at + (1 << 18))
                    yield pa.RecordBatch.from_arrays([pa.array(c[some][begins[some]]) for c in columns], names=names)

    return docs.select("lang", "text").mapInArrow(run, ", ".join(f"{c} int" for c in names))


def text_windows(docs: DataFrame, sent, longest: int) -> DataFrame:
    """lang, c1..cN (padded by empty strings), strange: the windows that hold a word without a number, and the place of the first."""
    names = [f"c{k + 1}" for k in range(longest)]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(_received(sent))
        for part in parts:
            for lang, text in chunks(part):
                words, piece = words_of(text)
                unknown = coder.codes(lang, words) == 0
                order = np.arange(len(words))
                places, strange = [order], np.where(unknown, 1, 0)
                for k in range(1, longest):
                    place = led(order, piece, k)  # no window leads to word 0, so PAD can't be mistaken for it
                    places.append(place)
                    strange = np.where((strange == 0) & (place > 0) & unknown[place], k + 1, strange)
                held = np.flatnonzero(strange > 0)
                columns = [pc.fill_null(words.take(pa.array(p[held], mask=(p[held] == 0) & (k > 0))), "").cast(pa.string()) for k, p in enumerate(places)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(held), pa.string()), *columns, pa.array(strange[held], pa.int32())], names=["lang", *names, "strange"])

    return docs.select("lang", "text").mapInArrow(run, f"lang string, {', '.join(f'{c} string' for c in names)}, strange int")


def marginals(windows: DataFrame, keys: list[str], longest: int, pad: object, least: int, strange: Column | None = None) -> DataFrame:
    """keys, c1..cN, words, n: the phrases (of 1 word on) that occur least times; columns beyond the phrase are null.

    The counts of the longest windows are made once; ROLLUP sums their prefixes.
    """
    names = [f"c{k + 1}" for k in range(longest)]
    first = [strange.alias("strange")] if strange is not None else []
    counts = windows.groupBy(*keys, *names).agg(F.count("*").alias("n"), *(F.min(s).alias("strange") for s in first))
    # one condition, which needs the counts: a filter of the last word alone would move below the shuffle, which both uses share
    whole = counts.filter(F.when(F.col("n") >= least, F.col(names[-1]) != pad)).select(*keys, *names, F.lit(longest).alias("words"), "n")
    if longest == 1:
        return whole
    rolled = counts.rollup(*keys, *names[:-1]).agg(F.sum("n").alias("n"), F.grouping_id().alias("gone"), *(F.min("strange").alias("strange") for _ in first))
    # grouping_id has a bit for each column that is summed away
    words = F.lit(longest - 1) - F.bit_count("gone")
    last = F.coalesce(*(F.col(c) for c in reversed(names[:-1])))
    rolled = rolled.withColumn("words", words.cast("int")).filter((F.col("words") > 0) & (F.col("n") >= least) & (last != pad))
    if first:
        rolled = rolled.filter(F.col("strange") <= F.col("words"))
    return rolled.select(*keys, *names[:-1], F.lit(None).cast(windows.schema[names[-1]].dataType).alias(names[-1]), "words", "n").unionByName(whole)


def decoded(coded: DataFrame, sent, longest: int) -> DataFrame:
    """lang, phrase (words, by a space), words, n of coded marginals."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _received(sent)
        langs, every = known.column("lang").combine_chunks(), known.column("word").combine_chunks()
        for part in parts:
            at = [pc.subtract(part.column(k), 1) for k in range(longest)]
            phrase = pc.binary_join_element_wise(*(every.take(a) for a in at), " ", null_handling="skip")
            yield pa.RecordBatch.from_arrays([langs.take(at[0]), phrase, part.column(longest), part.column(longest + 1)], names=["lang", "phrase", "words", "n"])

    return coded.select(*(f"c{k + 1}" for k in range(longest)), "words", "n").mapInArrow(run, "lang string, phrase string, words int, n long")


def frequent_phrases(docs: DataFrame, longest: int, least: int) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, n) of the phrases of 1 to longest words that occur least times; (lang, n) of all words."""
    counts = cut(word_counts(docs), "words")
    words, more = vocabulary(counts, least)
    sent = _sent(docs.sparkSession, words)
    found = decoded(marginals(coded_windows(docs, sent, longest), [], longest, PAD, least), sent, longest)
    if more:
        texts = marginals(text_windows(docs, sent, longest), ["lang"], longest, "", least, F.col("strange"))
        found = found.unionByName(texts.select("lang", F.concat_ws(" ", *(f"c{k + 1}" for k in range(longest))).alias("phrase"), "words", "n"))
    return cut(found, "phrases"), counts.groupBy("lang").agg(F.sum("n").alias("total"))


def scored(phrases: DataFrame) -> DataFrame:
    """lang, phrase, words, a, l, r, score of phrases (of two words on): by the cut that scores lowest, ties to the first."""
    parts = phrases.filter("words > 1").withColumn("w", F.split("phrase", " "))
    parts = parts.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    parts = parts.select("lang", "phrase", "words", F.col("n").alias("a"), "k", F.array_join(F.slice("w", 1, F.col("k")), " ").alias("head"), F.array_join(F.slice("w", F.col("k") + 1, F.col("words")), " ").alias("rest"))
    for side, name in (("head", "l"), ("rest", "r")):
        parts = parts.join(phrases.select("lang", F.col("phrase").alias(side), F.col("n").alias(name)), ["lang", side])
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    parts = parts.withColumn("over", whole("a") * whole("a") * F.lit(1_000_000).cast("decimal(7,0)")).withColumn("under", whole("l") * whole("r"))
    parts = parts.withColumn("score", F.expr("over div under"))
    best = F.min(F.struct("score", "k", "l", "r")).alias("best")
    return parts.groupBy("lang", "phrase").agg(F.first("words").alias("words"), F.first("a").alias("a"), best).select("lang", "phrase", "words", "a", "best.l", "best.r", "best.score")


def contained(phrases: DataFrame) -> DataFrame:
    """lang, phrase, longer: for phrases within longer frequent ones, the count of the most frequent of these."""
    longer = phrases.filter("words > 2").withColumn("w", F.split("phrase", " "))
    sized = longer.withColumn("size", F.explode(F.sequence(F.lit(2), F.col("words") - 1)))
    inner = sized.select("lang", "n", F.explode(F.transform(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1), lambda i: F.array_join(F.slice("w", i, F.col("size")), " "))).alias("phrase"))
    return inner.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))


def phrases(docs: DataFrame, longest: int = 3, least: int = 10, top: int = 2000, share: int = 50) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the top phrases of each lang that no longer phrase accounts for.

    a phrase goes if a longer candidate that holds it has share percent of its
    count. top is what the report shows of each lang; None gives all.
    """
    found, totals = frequent_phrases(docs, longest, least)
    kept = scored(found).join(contained(found), ["lang", "phrase"], "left").filter("longer IS NULL OR 100 * longer < " + f"{share} * a")
    if top is not None:
        from pyspark.sql import Window

        order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
        kept = kept.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    else:
        kept = kept.withColumn("rank", F.lit(None).cast("long"))
    return kept.join(F.broadcast(totals) if top is not None else totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases(table(spark, sf_dir, "documents").select("lang", "text"))


OP11_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
q AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
e AS MATERIALIZED (SELECT lang, unnest(w) AS w1, unnest(w[2:]) AS w2, unnest(w[3:]) AS w3 FROM q WHERE len(w) > 0),
f AS MATERIALIZED (
  SELECT lang, w1 AS phrase, 1 AS m, count(*) AS n FROM e GROUP BY ALL
  UNION ALL SELECT lang, w1 || ' ' || w2, 2, count(*) FROM e WHERE w2 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, w1 || ' ' || w2 || ' ' || w3, 3, count(*) FROM e WHERE w3 IS NOT NULL GROUP BY ALL),
c AS MATERIALIZED (SELECT lang, phrase, m, n AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND n >= 10),
k AS (SELECT lang, phrase, a, m, 1 AS k, w[1] AS h, array_to_string(w[2:], ' ') AS t FROM c
  UNION ALL SELECT lang, phrase, a, m, 2, array_to_string(w[1:2], ' '), w[3] FROM c WHERE m = 3),
s AS (SELECT k.lang, k.phrase, k.a, l.n AS l, r.n AS r, k.k, CAST(1000000::HUGEINT * k.a * k.a // (l.n::HUGEINT * r.n) AS BIGINT) AS score
  FROM k JOIN f l ON l.lang = k.lang AND l.phrase = k.h JOIN f r ON r.lang = k.lang AND r.phrase = k.t),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
g AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM c WHERE m = 3 UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM c WHERE m = 3) GROUP BY ALL),
z AS (SELECT b.* FROM b LEFT JOIN g ON g.lang = b.lang AND g.phrase = b.phrase WHERE longer IS NULL OR 100 * longer < 50 * a),
t AS (SELECT lang, count(*) AS n FROM e GROUP BY lang),
o AS (SELECT z.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM z)
SELECT o.lang, o.rank, o.phrase, o.a, o.l, o.r, t.n, o.score FROM o JOIN t ON t.lang = o.lang WHERE o.rank <= 2000
"""
