"""Removal of repeated byte strings, by suffix arrays over what hashing leaves open.

A byte goes if a 200-byte string (window) covers it that starts anywhere else too.

1. A window's anchor is the gram (50 bytes) in it with the smallest hash. Equal
   windows have equal anchors at equal places. Consecutive windows with one anchor
   are a region. Grams that are the anchor of one region only settle its windows:
   they are unique. A bounded sieve and a join leave the other regions.
2. A region that others equal as a whole, on 128 bits, is one symbol of a text. So
   are its copies.
3. Where an anchor has unequal regions, a repeat begins or ends in them. They are
   cut into blocks of windows, which all contain a common core. Blocks with equal
   cores form a group; a block is the bytes before the core, the core as one
   symbol, and the bytes after it. Neighbouring columns in which all of a group
   agree become one symbol.
4. A suffix array over these texts (Lyndon grouping, suffix_array.py) brings equal
   windows together: a window is repeated if the one before or behind it in the
   order is equal to it. What occurs several times stands in a text twice.
5. Of a core with more than GROUP different blocks (a passage in very many
   surroundings) the windows are counted by aggregation instead, which is exact too
   and has no large group.
6. The repeated windows of a document are joined to its text, and their bytes go.

A task holds slices of SLICE bytes, of longer texts too (slices overlap by a
window), and groups of at most GROUP short blocks. Hashes of grams only choose what
is looked at; equality is decided on 128-bit hashes of bytes (regions, cores) and on
the bytes around cores.

Defined cases: null text is empty; texts under 200 bytes have no windows; of two
equal texts of 200 bytes or more nothing is left, and repeated rows are equal
texts; overlapping repeats within a document count; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bytes_of, cut, sieve, sifted, table
from .near_join import groups_of, run_starts
from .suffix_array import suffix_array

WINDOW, GRAM, BLOCK = 200, 50, 25
#: Bytes that a task hashes at once; below 2**PLACE.
SLICE, PLACE = 400_000, 20
#: Blocks of a core that one task sorts; of a core with more, windows are counted.
GROUP = 2_000
#: Symbols of a suffix array, about.
TEXT = 100_000

_table = np.random.default_rng(7).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_factors = np.random.default_rng(8).integers(0, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

def gram_hashes(data: np.ndarray, length: int = GRAM) -> np.ndarray:
    """A 64-bit hash of the length bytes from each place on, by doubling."""
    h, size, out, done = _table[data], 1, None, 0
    level, rest = 0, length
    while rest:
        if rest & 1:
            part = h[done : done + max(0, len(data) - length + 1)]
            out = part.copy() if out is None else (out ^ (out >> np.uint64(31))) * _factors[level] + part
            done += size
        rest >>= 1
        if rest:
            h = h[: len(h) - size] * _factors[level + 8] + h[size:]
            h ^= h >> np.uint64(29)
            size *= 2
            level += 1
    return out * np.uint64(0x9E3779B97F4A7C15) if out is not None else h


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of width values."""
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[: len(x) - size], x[size:])
        size *= 2
    more = width - size
    return np.minimum(x[: len(x) - more], x[more:]) if more else x


def slices(ends: np.ndarray, window: int = WINDOW, most: int = SLICE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(the first text, where its part and those of the next texts begin, their lengths): of at most `most` bytes in all.

    A longer text is several parts that overlap by window - 1 bytes.
    """
    size = np.diff(ends)
    i = 0
    while i < len(size):
        if size[i] > most:
            step = most - window + 1
            for a in range(0, int(size[i]) - window + 1, step):
                yield i, ends[i : i + 1] + a, np.minimum(size[i : i + 1] - a, most)
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + most, side="right")) - 1)
        yield i, ends[i:j], size[i:j]
        i = j


def regions(column: pa.Array, window: int = WINDOW, gram: int = GRAM, most: int = SLICE) -> Iterator[tuple[np.ndarray, ...]]:
    """For slices of texts: (text, first window, last window, anchor, hash of the anchor's gram, 128-bit name of its bytes) of each region."""
    data, ends = bytes_of(column)
    whole = memoryview(data)
    place = np.uint64(PLACE)
    for first, starts, lengths in slices(ends, window, most):
        count = np.maximum(lengths - window + 1, 0)
        if not count.any():
            continue
        begin = int(starts[0])
        h = gram_hashes(data[begin : int(starts[-1] + lengths[-1])], gram)
        low = (h >> place << place) | np.arange(len(h), dtype=np.uint64)
        best = (sliding_min(low, window - gram + 1) & ((np.uint64(1) << place) - np.uint64(1))).astype(np.int32)
        doc = np.repeat(np.arange(len(count), dtype=np.int32), count)
        at = (np.arange(len(doc), dtype=np.int64) + np.repeat(starts - begin - (np.cumsum(count) - count), count)).astype(np.int32)
        anchor = best[at]
        new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])])
        last = np.r_[new[1:], len(doc)] - 1
        lo, hi, anchor, doc = at[new].astype(np.int64), at[last].astype(np.int64), anchor[new].astype(np.int64), doc[new]
        names = [xxhash.xxh3_128_digest(whole[a:b]) for a, b in zip((lo + begin).tolist(), (hi + begin + window).tolist(), strict=True)]
        shift = begin - ends[first + doc]
        yield first + doc, lo + shift, hi + shift, anchor + shift, h[anchor].view(np.int64), names


def _bytes(column) -> list[bytes]:
    return [(t or "").encode("utf-8") for t in column.to_pylist()]


def blocks_of(text: bytes, first: int, last: int, anchor: int, window: int = WINDOW, block: int = BLOCK) -> Iterator[tuple[bytes, int, bytes, bytes]]:
    """(name of the core, first window, bytes before the core, bytes after it) of each block of a region."""
    for b in range((anchor - last) // block, (anchor - first) // block + 1):
        high = anchor - block * b
        low = high - block + 1
        core = text[high : low + window]
        lo, hi = max(low, first), min(high, last)
        if lo <= hi:
            yield xxhash.xxh3_128_digest(core + bytes([b])), lo, text[lo:high], text[low + window : hi + window]


def merged_columns(before: list[bytes], after: list[bytes], group: np.ndarray, shown: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Strings (bytes before and after a common symbol) of groups, in few symbols; shown: the strings in the order of the text.

    Two neighbouring columns of a group are one symbol if all strings that have them
    agree in both, unless a string begins or ends between them, or a window that
    begins or ends between them would be told apart by it. So windows that begin in
    one symbol are alike: either all or none of them are repeated.

    -> for each symbol of the text: its row in shown, the symbol (from 0), the first and
    the last window that begin in it, and the symbols of a window (0: none begins).
    """
    left, right = (np.fromiter(map(len, x), np.int64, len(x)) for x in (before, after))
    most, width = int(left.max()), int(left.max() + 1 + right.max())
    chars = np.frombuffer(b"".join(bytes(most - len(b)) + b + b"\0" + a + bytes(width - most - 1 - len(a)) for b, a in zip(before, after, strict=True)), np.uint8).reshape(-1, width)
    begin, end, at = most - left, most + 1 + right, np.arange(width)
    has = (at >= begin[:, None]) & (at < end[:, None])
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    differ = np.minimum.reduceat(np.where(has, chars, 255), first) < np.maximum.reduceat(np.where(has, chars, 0), first)
    edge = np.zeros((len(first), width + window + 2), dtype=bool)
    edge[:, :width] |= differ
    edge[:, 1 : width + 1] |= differ
    for x in (begin, end, end + 1):
        edge[group, x] = True
    cuts = edge[:, : width + 1] | edge[:, window : window + width + 1]
    if width >= window:
        cuts[:, window:] |= edge[:, : width + 1 - window]
    number = np.cumsum(cuts, axis=1) - 1
    base = 257 * np.r_[0, np.cumsum(number[:-1, -1] + 1)]
    row, c = np.nonzero(cuts[group[shown], :width] & has[shown])
    string = shown[row]
    g, b, e = group[string], begin[string], end[string]
    symbol = base[g] + 257 * number[g, c] + np.where(differ[g, c], chars[string, c], 256)
    span = np.where(c <= e - window, number[g, np.minimum(c + window, width)] - number[g, c], 0)
    following = np.where(np.r_[row[1:] == row[:-1], False], np.r_[c[1:], 0], e)
    return row, symbol, c - b, np.minimum(following - 1, e - window) - b, span


def repeated_in(before: list[bytes], after: list[bytes], times: np.ndarray, windows: np.ndarray, starts: np.ndarray, order: Callable[[list[int]], list[int]] = suffix_array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Groups (that begin at starts) of distinct strings: before and after a symbol that the group has in common, with the
    number of their occurrences and the length of a window, which is one for all groups of several strings.

    -> (string, first window, last window) of each run of repeated windows, decided by a suffix array. What occurs
    several times stands in the text twice; a string that is its group's only one is one symbol.
    """
    n = len(before)
    size = np.diff(np.r_[starts, n])
    alone = np.repeat(size == 1, size)
    shown = np.repeat(np.arange(n), np.minimum(times, 2))
    some, lone = shown[~alone[shown]], shown[alone[shown]]
    strings, symbols, xs, ys, spans = [], [], [], [], []

    def add(string, at, symbol, x, y, span, rows) -> None:
        """Rows of symbols, with a separator (1) behind each."""
        place = np.arange(len(at)) + at
        for out, value, rest in ((strings, string, 0), (symbols, symbol, 1), (xs, x, 0), (ys, y, 0), (spans, span, 0)):
            filled = np.full(len(at) + rows, rest, dtype=np.int64)
            filled[place] = value
            out.append(filled)

    highest = 2
    if len(some):
        own = np.flatnonzero(~alone)
        index = np.cumsum(~alone) - 1
        group = np.repeat(np.arange((size > 1).sum()), size[size > 1])
        row, symbol, x, y, span = merged_columns([before[k] for k in own], [after[k] for k in own], group, index[some], int(windows[own[0]]))
        add(some[row], row, symbol + highest, x, y, span, len(some))
        highest += int(symbol.max()) + 1
    if len(lone):
        last = np.array([len(before[k]) + len(after[k]) + 1 - windows[k] for k in lone])
        add(lone, np.arange(len(lone)), lone + highest, 0, last, 1, len(lone))
    if not strings:
        return (np.empty(0, np.int64),) * 3
    string, text, x, y, span = (np.r_[np.concatenate(v), 0] for v in (strings, symbols, xs, ys, spans))
    plain = text.tolist()
    sorted_ = np.array(order(plain), dtype=np.int64)
    sorted_ = sorted_[span[sorted_] > 0]
    a, b = sorted_[:-1], sorted_[1:]
    near = np.flatnonzero((span[a] == span[b]) & (text[a] == text[b]))
    equal = [i for i, p, q, k in zip(near.tolist(), a[near].tolist(), b[near].tolist(), span[a[near]].tolist(), strict=True) if plain[p : p + k] == plain[q : q + k]]
    hit = np.unique(np.r_[a[equal], b[equal]])
    found = np.unique(np.c_[string[hit], x[hit], y[hit]], axis=0)
    if not len(found):
        return (np.empty(0, np.int64),) * 3
    new = np.r_[True, (found[1:, 0] != found[:-1, 0]) | (found[1:, 1] > found[:-1, 2] + 1)]
    return found[new, 0], found[new, 1], found[np.r_[new[1:], True], 2]


def repeated_windows(docs: DataFrame, order: Callable[[list[int]], list[int]] = suffix_array) -> DataFrame:
    """docs (doc_id, text) -> doc_id, raw, lo, hi: runs of repeated windows, by their first bytes."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("raw"), "text")
    most = SLICE

    def cut_up(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for row, lo, hi, anchor, h, names in regions(part.column(2), most=most):
                of = pa.array(row)
                yield pa.RecordBatch.from_arrays([part.column(0).take(of), part.column(1).take(of), pa.array(lo, pa.int32()), pa.array(hi - lo, pa.int16()), pa.array(anchor - lo, pa.int16()), pa.array(h), pa.array(names, pa.binary())], names=["doc_id", "raw", "lo", "more", "off", "h", "name"])

    every = cut(keyed.mapInArrow(cut_up, f"doc_id {kind}, raw long, lo int, more short, off short, h long, name binary"), "every")
    often = cut(every.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"), "often")
    bits = cut(sieve(often, F.col("h")), "sieve")
    found = sifted(every, F.col("h"), bits, "maybe").filter("maybe").drop("maybe").join(often, "h", "left_semi")
    found = cut(found, "regions")
    # equal regions are one kind; one of them takes part for all
    place = ("doc_id", "raw", "lo", "more", "off")
    names = cut(found.groupBy("h", "name").agg(F.count("*").alias("copies"), *(F.first(c).alias(c) for c in place)), "names")
    several = names.groupBy("h").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("h")
    asked = names.join(several, "h", "left_semi").groupBy("doc_id", "raw").agg(F.collect_set(F.struct("lo", "more", "off", "copies")).alias("open"))
    asked = cut(asked.select(F.col("doc_id").alias("a_id"), F.col("raw").alias("a_raw"), "open"), "asked")
    bits = cut(sieve(asked, F.xxhash64("a_id", "a_raw")), "sieve")
    texts = sifted(keyed, F.xxhash64("doc_id", "raw"), bits, "maybe").filter("maybe").drop("maybe")
    texts = texts.join(asked, F.col("doc_id").eqNullSafe(F.col("a_id")) & (F.col("raw") == F.col("a_raw"))).select("doc_id", "raw", "text", "open").dropDuplicates(["doc_id", "raw"])

    def cores(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary())
        for part in (p.slice(i, 64) for p in parts for i in range(0, p.num_rows, 64)):
            cols: list[list] = [[] for _ in range(7)]
            for i, (text, open_) in enumerate(zip(_bytes(part.column(2)), part.column(3).to_pylist(), strict=True)):
                for r in open_:
                    for core, lo, before, after in blocks_of(text, r["lo"], r["lo"] + r["more"], r["lo"] + r["off"]):
                        for c, v in zip(cols, (i, core, lo, before, after, r["copies"], xxhash.xxh3_128_digest(core + bytes([len(before)]) + before + after)), strict=True):
                            c.append(v)
            of = pa.array(cols[0], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0).take(of), part.column(1).take(of), *(pa.array(c, k) for c, k in zip(cols[1:], kinds, strict=True))], names=["doc_id", "raw", "core", "lo", "before", "after", "copies", "same"])

    made = cut(texts.mapInArrow(cores, f"doc_id {kind}, raw long, core binary, lo long, before binary, after binary, copies long, same binary"), "blocks")
    # equal blocks are one kind
    kinds = cut(made.groupBy("core", "same").agg(F.sum("copies").alias("times"), F.first("before").alias("before"), F.first("after").alias("after")), "kinds")
    hot = cut(kinds.groupBy("core").agg(F.count("*").alias("kinds")).filter(F.col("kinds") > GROUP).select("core"), "hot")
    none = F.lit(b"")
    alike = names.filter("copies > 1").select(F.col("name").alias("core"), F.col("name").alias("same"), F.col("copies").alias("times"), none.alias("before"), none.alias("after"), F.lit(1).alias("wide"))
    small = kinds.join(hot, "core", "left_anti").withColumn("wide", F.lit(BLOCK)).unionByName(alike).repartition("core").sortWithinPartitions("core")

    def sort(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups_of(parts, ["core"], GROUP):
            starts = run_starts(t, ["core"])
            size = np.diff(np.r_[starts, t.num_rows])
            # a lone block of a core that no other has isn't repeated
            open_ = np.repeat((size > 1) | (t["times"].to_numpy()[starts] > 1), size)
            t = t.filter(pa.array(open_))
            starts = run_starts(t, ["core"])
            before, after, times, windows = t["before"].to_pylist(), t["after"].to_pylist(), t["times"].to_numpy(), t["wide"].to_numpy()
            length = np.cumsum([len(b) + len(a) + 2 for b, a in zip(before, after, strict=True)])
            a = 0
            while a < len(starts):  # whole groups, of about TEXT symbols
                low = int(starts[a])
                b = a + 1
                while b < len(starts) and length[starts[b] - 1] - (length[low - 1] if low else 0) < TEXT:
                    b += 1
                high = int(starts[b]) if b < len(starts) else t.num_rows
                k, x, y = repeated_in(before[low:high], after[low:high], times[low:high], windows[low:high], starts[a:b] - low, order)
                yield from pa.table([t["same"].take(pa.array(k + low)), pa.array(x), pa.array(y)], names=["same", "x", "y"]).to_batches()
                a = b

    answers = cut(small.select("core", "same", "before", "after", "times", "wide").mapInArrow(sort, "same binary, x long, y long"), "answers")
    # cores with very many blocks: a window is its core and what is around it
    large = kinds.join(hot, "core", "left_semi").withColumn("k", F.explode(F.sequence(F.lit(0), F.length("before") + F.length("after") + 1 - BLOCK)))
    large = large.withColumn("pre", F.expr("substring(before, k + 1)")).withColumn("post", F.expr(f"substring(after, 1, {BLOCK - 1} - (length(before) - k))"))
    counted = large.groupBy("core", "pre", "post").agg(F.sum("times").alias("n")).filter("n > 1").select("core", "pre", "post")
    counted = large.join(counted, ["core", "pre", "post"], "left_semi").select("same", F.col("k").cast("long").alias("x"), F.col("k").cast("long").alias("y"))
    full = found.join(answers.select(F.col("same").alias("name")), "name", "left_semi").select("doc_id", "raw", F.col("lo").cast("long").alias("lo"), (F.col("lo") + F.col("more")).cast("long").alias("hi"))
    part = made.filter("copies = 1").join(answers.unionByName(counted), "same").select("doc_id", "raw", (F.col("lo") + F.col("x")).alias("lo"), (F.col("lo") + F.col("y")).alias("hi"))
    return full.unionByName(part)


def covered(runs: list[dict], window: int = WINDOW) -> list[tuple[int, int]]:
    """The bytes that runs of windows cover, as spans."""
    out: list[list[int]] = []
    for lo, hi in sorted((r["lo"], r["hi"]) for r in runs):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi + window)
        else:
            out.append([lo, hi + window])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, order: Callable[[list[int]], list[int]] = suffix_array) -> DataFrame:
    """docs (doc_id, text) -> for every row: doc_id, n_bytes, n_removed, n_spans, kept binary (the bytes left)."""
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    runs = cut(repeated_windows(docs, order), "windows")
    runs = runs.groupBy("doc_id", "raw").agg(F.collect_set(F.struct("lo", "hi")).alias("runs"))
    runs = cut(runs.select(F.col("doc_id").alias("r_id"), F.col("raw").alias("r_raw"), "runs"), "runs")
    bits = cut(sieve(runs, F.xxhash64("r_id", "r_raw")), "sieve")
    keyed = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("raw"), "text")
    keyed = sifted(keyed, F.xxhash64("doc_id", "raw"), bits, "maybe")
    met = keyed.filter("maybe").join(runs, F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("raw") == F.col("r_raw")), "left").select("doc_id", "text", "runs")
    rest = keyed.filter("NOT maybe").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("kept"))
    rest = rest.select("doc_id", F.length("kept").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), "kept")

    def strip(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            cols: tuple[list, list, list, list] = ([], [], [], [])
            for text, own in zip(_bytes(part.column(1)), part.column(2).to_pylist(), strict=True):
                spans = covered(own or [])
                ends = [0, *(x for s in spans for x in s), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True))
                for c, v in zip(cols, (len(text), len(text) - len(kept), len(spans), kept), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return met.mapInArrow(strip, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary").unionByName(rest)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
