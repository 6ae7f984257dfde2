"""Exact deduplication by content-defined chunk recipes.

1. Each text, without white space, is cut into chunks where a rolling hash of
   its bytes says so. The digests of its chunks are its recipe. One narrow row
   for each document leaves this step; documents whose recipe no other has are
   settled by it.
2. The texts of the others are read once more, through a sieve of bounded size
   that is broadcast, so that long documents without copies aren't moved. Their chunks are deduplicated on
   (digest, bytes); a digest that stands for one byte string is a verified
   identifier, and one that stands for several (a collision) is extended by the bytes.
3. The ordered identifier lists are compared: equal lists, equal texts.

Groups are counted by partial aggregation, so a group of any size is one row
for each map task; rows find their group by a join which AQE can split.

Defined cases: null text is empty, and empty texts are equal; with a tie in
length the smallest doc_id stays (null last); of repeated rows one stays;
an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, cut, sieve, sifted, table

WINDOW = 16
LEAST, MEAN_BITS, MOST = 256, 10, 16_384
#: Bytes that a task hashes at once.
SLICE = 4_000_000
#: One random number for each byte, the same in every run.
GEAR = np.random.default_rng(20).integers(0, 2**32, 256, dtype=np.uint32)


def rolling(data: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """At each byte a hash of the last window bytes, by doubling; window is a power of two."""
    h = GEAR[data]
    k = 1
    while k < window:
        longer = h.copy()
        longer[k:] += h[:-k] << np.uint32(k)
        h, k = longer, 2 * k
    return h


def cuts(data: np.ndarray, sizes: list[int]) -> Iterator[list[int]]:
    """For each text in data (one after the other) the ends of its chunks, from its start."""
    ends = np.flatnonzero(rolling(data) >> np.uint32(32 - MEAN_BITS) == 0) + 1 if len(data) else np.empty(0, int)
    start = 0
    for size in sizes:
        own = (ends[np.searchsorted(ends, start + LEAST) : np.searchsorted(ends, start + size)] - start).tolist()
        out, last = [], 0
        for end in [*own, size]:
            while end - last > MOST:
                out.append(last := last + MOST)
            if end - last >= LEAST or end == size and end > last:
                out.append(last := end)
        yield out
        start += size


def squeezed(text: str | None) -> bytes:
    return (text or "").encode("utf-8").translate(None, SPACES.encode())


def chunked(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """(place in texts, chunks) of each text, in order."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= SLICE):
            size += len(texts[j])
            j += 1
        part = texts[i:j]
        for k, ends in enumerate(cuts(np.frombuffer(b"".join(part), dtype=np.uint8), [len(t) for t in part])):
            yield i + k, [part[k][a:b] for a, b in zip([0, *ends], ends, strict=False)]
        i = j


def strong(chunk: bytes) -> bytes:
    return xxhash.xxh3_128_digest(chunk)


def exact_groups(docs: DataFrame, digest: Callable[[bytes], bytes] = strong) -> DataFrame:
    """docs (doc_id, text) -> for every row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are identical without white space. The row with the
    most code points stays, then the one with the smallest doc_id. digest names
    chunks; any function will do, since identifiers are verified.
    """
    id_type = docs.schema["doc_id"].dataType
    keyed = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("raw"))

    def recipes(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = part.column(1).to_pylist()
            plain = [squeezed(t) for t in texts]
            marks = [xxhash.xxh3_128_digest(b"".join(map(digest, chunks)) + len(plain[i]).to_bytes(8, "big")) for i, chunks in chunked(plain)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), pa.array([len(t or "") for t in texts], pa.int64()), pa.array(marks, pa.binary()), pa.array([hashlib.sha256(t).hexdigest() for t in plain], pa.string())],
                names=["doc_id", "raw", "points", "mark", "text_sha256"],
            )

    rows = keyed.mapInArrow(recipes, f"doc_id {id_type.simpleString()}, raw long, points long, mark binary, text_sha256 string")
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()), "recipes")
    shared = rows.groupBy("mark").agg(F.count("*").alias("n")).filter("n > 1").select("mark")
    shared = rows.join(cut(shared, "marks"), "mark", "left_semi").select("row", "doc_id", "raw", "points")
    shared = cut(shared, "shared")

    wanted = shared.select(F.col("doc_id").alias("w_id"), F.col("raw").alias("w_raw")).distinct()
    # texts that no other can equal are left where they are; only the rest is shuffled
    bits = cut(sieve(wanted, F.xxhash64("w_id", "w_raw")), "sieve")
    maybe = sifted(keyed, F.xxhash64("doc_id", "raw"), bits, "maybe").filter("maybe").drop("maybe")
    texts = maybe.join(wanted, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("raw") == F.col("w_raw")), "left_semi")
    texts = cut(texts.dropDuplicates(["doc_id", "raw"]), "texts")

    def explode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            plain = [squeezed(t) for t in part.column(1).to_pylist()]
            row, place, name, chunk = [], [], [], []
            for i, chunks in chunked(plain):
                row += [i] * len(chunks)
                place += range(len(chunks))
                name += map(digest, chunks)
                chunk += chunks
            of = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0).take(of), part.column(2).take(of), pa.array(place, pa.int32()), pa.array(name, pa.binary()), pa.array(chunk, pa.binary())], names=["doc_id", "raw", "place", "name", "chunk"])

    chunks = texts.mapInArrow(explode, f"doc_id {id_type.simpleString()}, raw long, place int, name binary, chunk binary")
    # the names that stand for several chunks; with a good digest there are none
    unsure = chunks.select("name", "chunk").distinct().groupBy("name").agg(F.count("*").alias("n")).filter("n > 1")
    unsure = cut(unsure.select("name", F.lit(True).alias("unsure")), "unsure")
    named = chunks.join(unsure, "name", "left").withColumn("name", F.when(F.col("unsure"), F.concat("name", "chunk")).otherwise(F.col("name")))
    lists = named.groupBy("doc_id", "raw").agg(F.array_sort(F.collect_list(F.struct("place", "name"))).alias("names"))
    lists = lists.select(F.col("doc_id").alias("l_id"), F.col("raw").alias("l_raw"), F.transform("names", lambda x: x["name"]).alias("names"))

    members = shared.join(lists, F.col("doc_id").eqNullSafe(F.col("l_id")) & (F.col("raw") == F.col("l_raw")), "left")
    members = members.select("row", "doc_id", "points", F.coalesce("names", F.array().cast("array<binary>")).alias("names"))
    members = cut(members, "members")
    first = F.struct((-F.col("points")).alias("shorter"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"))
    groups = members.groupBy("names").agg(F.count("*").alias("group_size"), F.min(first).alias("first"))
    # written, so that the join below has no aggregate above its shuffle and AQE can split a hot list
    groups = cut(groups.select("names", "group_size", "first.keep_id", "first.keep_row"), "groups")
    grouped = members.select("row", "names").join(groups, "names").select("row", "group_size", "keep_id", "keep_row")

    out = rows.select("row", "doc_id", "text_sha256").join(grouped, "row", "left")
    alone = F.col("group_size").isNull()
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
        "text_sha256",
    )


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points,
  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
g AS (SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size,
  first(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
