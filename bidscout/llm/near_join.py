r"""N-gram Jaccard join by MinHash banding, verified on full n-gram sets.

Words are runs of [^\x20\x09-\x0D], A-Z lower-cased; n-grams are five words (all
words of a shorter text). Two documents are linked if the Jaccard similarity of
their n-gram sets is at least 0.8.

1. Documents with equal n-gram sets are one set; its MinHash bands are a row.
   The number of bands follows from the rows in a band and the target recall.
2. Sets that share a band hash meet in a bucket. A pair of sets belongs to the
   first band it shares, so that it is verified once; only members that have such
   a pair, of sizes that allow the similarity, are sent their n-grams. Buckets of more
   members than BLOCK, or n-grams than BLOCK_GRAMS, are dealt out as pairs of blocks,
   so that no task holds more than two blocks.
3. A task verifies the pairs of its bucket and emits, for each set, the number of
   documents linked to it and one edge of a spanning forest: rows grow with the
   members, not with the pairs.
4. Classes are the connected components of the links, by label propagation with
   shortcuts over the spanning edges.

Defined cases: null text and text without words have no links and are classes of
their own; repeated rows are linked; a class is named by its smallest doc_id
(null doc_ids last); an empty table gives no rows; further columns are ignored by
classes() and kept by keep_one().
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, sieve, sifted, table

WORDS, SIMILARITY = 5, 0.8
ROWS, RECALL = 5, 0.9999
#: Members of a bucket that a task compares with as many others, and their n-grams.
BLOCK, BLOCK_GRAMS = 1024, 1 << 20
#: Bytes of whole groups that a task takes at once.
AT_ONCE = 32_000_000
#: n-grams that a task hashes at once.
SLICE = 1 << 16

_word = re.compile(r"[^\x20\x09-\x0D]+")


def bands_for(similarity: float = SIMILARITY, recall: float = RECALL, rows: int = ROWS) -> int:
    """Bands with which a pair of that similarity meets with that probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


def _lower(text: str) -> str:
    return text.translate(_LOWER)


_LOWER = {c: c + 32 for c in range(65, 91)}


def grams(text: str | None, n: int = WORDS) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the text's n-grams."""
    words = _word.findall(text or "")
    if not words:
        return np.empty(0, np.uint64)
    one = np.array([xxhash.xxh3_64_intdigest(_lower(w) if not w.islower() else w) for w in words], dtype=np.uint64)
    return np.unique(rolled(one, n))


def rolled(one: np.ndarray, n: int) -> np.ndarray:
    """The hash of each run of n word hashes (of all of them, if fewer)."""
    n = min(n, len(one))
    h = np.zeros(len(one) - n + 1, dtype=np.uint64)
    for i in range(n):
        h = (h ^ one[i : i + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def factors(count: int) -> np.ndarray:
    return np.random.default_rng(6).integers(0, 2**63, (count, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(sets: list[np.ndarray], bands: int, rows: int = ROWS) -> np.ndarray:
    """For each set (none empty) a 64-bit hash for each band."""
    out = np.empty((len(sets), bands), dtype=np.uint64)
    by = factors(bands * rows)
    i = 0
    while i < len(sets):
        j, size = i, 0
        while j < len(sets) and (j == i or size + len(sets[j]) <= SLICE):
            size += len(sets[j])
            j += 1
        part = np.concatenate(sets[i:j])
        part ^= part >> np.uint64(32)
        starts = np.cumsum([0, *map(len, sets[i : j - 1])])
        for b in range(bands):
            key = np.full(j - i, b + 1, dtype=np.uint64)
            for r in range(rows):
                mul, add = by[b * rows + r]
                low = np.minimum.reduceat(part * mul + add, starts)
                key = (key ^ (low >> np.uint64(16))) * np.uint64(0xD6E8FEB86659FD93)
                key ^= key >> np.uint64(32)
            out[i:j, b] = key
        i = j
    return out


def groups_of(parts: Iterator[pa.RecordBatch], keys: list[str], most: int = 4096) -> Iterator[pa.Table]:
    """Runs of rows with equal keys, of sorted batches; several whole runs at once, of about most rows."""
    held: list[pa.RecordBatch] = []
    rows = size = 0
    for part in parts:
        if not part.num_rows:
            continue
        held.append(part)
        rows += part.num_rows
        size += part.nbytes
        if rows < most and size < AT_ONCE:
            continue
        whole = pa.Table.from_batches(held)
        starts = run_starts(whole, keys)
        if len(starts) > 1:
            yield whole.slice(0, starts[-1])
            rest = whole.slice(starts[-1])
            held, rows, size = rest.to_batches(), rest.num_rows, rest.nbytes
    if held:
        yield pa.Table.from_batches(held)


def run_starts(t: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(t.num_rows, dtype=bool)
    new[:1] = True
    for k in keys:
        v = t[k].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks] or [np.empty(0, np.int64)]).reshape(-1, width)


def first_shared(bands: np.ndarray, at: int, side: np.ndarray | None, size: np.ndarray, similarity: float) -> np.ndarray:
    """Which pairs of rows share band `at` and none before, of sizes that can be as similar; side: only pairs of different sides."""
    n = len(bands)
    ok = np.triu(np.ones((n, n), dtype=bool), 1) if side is None else np.triu(side[:, None] != side[None, :], 1)
    # a set much smaller than the other can't be as similar
    ok &= np.minimum(size[:, None], size[None, :]) >= similarity * np.maximum(size[:, None], size[None, :])
    for b in range(at):
        ok &= bands[:, None, b] != bands[None, :, b]
    return ok


def jaccard(sets: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
    """The similarity of each pair, on the full sets."""
    out = np.empty(len(pairs))
    if len(pairs) > 4 * len(sets):
        # one table of who has what; a pair's common n-grams are the product of its rows
        _, code = np.unique(np.concatenate(sets), return_inverse=True)
        size = np.array([len(s) for s in sets])
        row = np.repeat(np.arange(len(sets)), size)
        common = np.zeros((len(sets), len(sets)), dtype=np.float32)
        step = max(1, 16_000_000 // len(sets))
        for low in range(0, int(code.max()) + 1, step):
            own = (code >= low) & (code < low + step)
            x = np.zeros((len(sets), step if low + step <= code.max() else int(code.max()) + 1 - low), dtype=np.float32)
            x[row[own], code[own] - low] = 1
            common += x @ x.T
        c = common[pairs[:, 0], pairs[:, 1]].astype(float)
        return c / (size[pairs[:, 0]] + size[pairs[:, 1]] - c)
    for k, (i, j) in enumerate(pairs):
        both = np.sort(np.concatenate([sets[i], sets[j]]), kind="stable")
        c = int((both[1:] == both[:-1]).sum())
        out[k] = c / (len(both) - c)
    return out


def document_sets(docs: DataFrame, bands: int) -> DataFrame:
    """docs (doc_id, text) -> doc_id, raw, set (16 bytes; null without words), n, bands array<long>, for every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("raw"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            sets = [grams(t) for t in part.column(1).to_pylist()]
            full = [s for s in sets if len(s)]
            keys = iter(band_keys(full, bands).view(np.int64)) if full else iter(())
            names = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), pa.array(names, pa.binary()), pa.array([len(s) for s in sets], pa.int32()), pa.array([next(keys) if len(s) else None for s in sets], pa.list_(pa.int64()))],
                names=["doc_id", "raw", "set", "n", "bands"],
            )

    return keyed.mapInArrow(run, f"doc_id {kind}, raw long, set binary, n int, bands array<bigint>")


def set_links(docs: DataFrame, rows: DataFrame, bands: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """rows: of document_sets. (set, links): documents of other sets linked to a set; (a, b): spanning edges of the links."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    place = F.struct(F.col("doc_id").alias("doc_id"), F.col("raw").alias("raw"))
    sets = rows.filter("set IS NOT NULL").groupBy("set").agg(F.count("*").alias("docs"), F.first("bands").alias("bands"), F.first("n").alias("n"), F.min(place).alias("place"))
    sets = cut(sets, "sets")
    keys = sets.select("set", "docs", "n", "bands", F.posexplode("bands").alias("band", "key"))
    shared = cut(keys.groupBy("key", "band").agg(F.count("*").alias("members"), F.sum("n").alias("all")).filter("members > 1"), "buckets")
    bits = cut(sieve(shared, F.col("key")), "sieve")
    met = sifted(keys, F.col("key"), bits, "maybe").filter("maybe").drop("maybe").join(shared, ["key", "band"])
    # a bucket is one group; a large one a group for each pair of its blocks
    blocks = F.when((F.col("members") > BLOCK) | (F.col("all") > BLOCK_GRAMS), F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("all") / BLOCK_GRAMS))).otherwise(F.lit(1))
    met = met.withColumn("own", F.pmod(F.xxhash64("set"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    met = met.select("key", "band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "set", "docs", "n", "bands")
    group = ["key", "band", "i", "j"]

    def needed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups_of(parts, group):
            starts = [*run_starts(t, group), t.num_rows]
            table_, own, i, j, band = _matrix(t["bands"], bands), t["own"].to_numpy(), t["i"].to_numpy(), t["j"].to_numpy(), t["band"].to_numpy()
            size = t["n"].to_numpy()
            keep = np.zeros(t.num_rows, dtype=bool)
            for a, b in zip(starts, starts[1:], strict=False):
                if b - a == 2 and i[a] == j[a]:
                    keep[a:b] = not (table_[a, : band[a]] == table_[a + 1, : band[a]]).any()
                elif b - a > 1:
                    ok = first_shared(table_[a:b], band[a], None if i[a] == j[a] else own[a:b], size[a:b], similarity)
                    keep[a:b] = ok.any(axis=0) | ok.any(axis=1)
            yield from t.filter(pa.array(keep)).to_batches()

    def spread(df: DataFrame) -> DataFrame:
        return df.repartition(*group).sortWithinPartitions(*group)

    need = cut(spread(met).mapInArrow(needed, met.schema), "needed")

    # n-grams of one document of each set that is needed
    wanted = sets.join(need.select("set").distinct(), "set", "left_semi").select("set", F.col("place.doc_id").alias("w_id"), F.col("place.raw").alias("w_raw"))
    wanted = cut(wanted, "wanted")
    bits = cut(sieve(wanted, F.xxhash64("w_id", "w_raw")), "sieve")
    keyed = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("raw"))
    maybe = sifted(keyed, F.xxhash64("doc_id", "raw"), bits, "maybe").filter("maybe").select("doc_id", "raw", "text")

    def texts(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = [grams(t).view(np.int64) for t in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "raw", "grams"])

    full = maybe.mapInArrow(texts, f"doc_id {kind}, raw long, grams array<bigint>")
    full = full.join(wanted, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("raw") == F.col("w_raw"))).select("set", "grams").dropDuplicates(["set"])
    full = cut(full, "grams")

    def verify(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups_of(parts, group, 1024):
            starts = [*run_starts(t, group), t.num_rows]
            table_, own, i, j, band, docs_ = _matrix(t["bands"], bands), t["own"].to_numpy(), t["i"].to_numpy(), t["j"].to_numpy(), t["band"].to_numpy(), t["docs"].to_numpy()
            name, all_grams = t["set"].to_pylist(), t["grams"].combine_chunks()
            out: tuple[list, list, list] = ([], [], [])
            for a, b in zip(starts, starts[1:], strict=False):
                if b - a < 2:
                    continue
                pairs = np.argwhere(first_shared(table_[a:b], band[a], None if i[a] == j[a] else own[a:b], t["n"].to_numpy()[a:b], similarity))
                if not len(pairs):
                    continue
                sets_ = [all_grams[k].values.to_numpy().view(np.uint64) for k in range(a, b)]
                pairs = pairs[jaccard(sets_, pairs) >= similarity]
                links = np.zeros(b - a, dtype=np.int64)
                np.add.at(links, pairs[:, 0], docs_[a + pairs[:, 1]])
                np.add.at(links, pairs[:, 1], docs_[a + pairs[:, 0]])
                root = list(range(b - a))
                for x, y in pairs.tolist():
                    while root[x] != x:
                        root[x] = x = root[root[x]]
                    while root[y] != y:
                        root[y] = y = root[root[y]]
                    root[max(x, y)] = min(x, y)
                for k in np.flatnonzero(links).tolist():
                    x = k
                    while root[x] != x:
                        x = root[x]
                    out[0].append(name[a + k])
                    out[1].append(name[a + x])
                    out[2].append(int(links[k]))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.int64())], names=["set", "root", "links"])

    ready = need.join(full, "set").select(*group, "own", "set", "docs", "n", "bands", "grams")
    linked = cut(spread(ready).mapInArrow(verify, "set binary, root binary, links long"), "linked")
    return linked.groupBy("set").agg(F.sum("links").alias("links")), linked.filter("set != root").select(F.col("set").alias("a"), F.col("root").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> node, root: the smallest node of its component.

    Each round a node takes the smallest label among its own, its neighbours' and
    its label's label; rounds go on until none changes (a few: the edges are stars).
    """
    both = cut(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("m")).select(F.col("a").alias("n_node"), "m")
        step = labels.join(near, F.col("node") == F.col("n_node")).select("node", F.col("root").alias("old"), F.least("root", "m").alias("root"))
        # the root's own new label, and what others tell a root through this node
        hook = step.filter("root != old").groupBy(F.col("old").alias("h_node")).agg(F.min("root").alias("h"))
        step = step.join(hook, F.col("node") == F.col("h_node"), "left").select("node", "old", F.least("root", F.coalesce("h", "root")).alias("root"))
        step = cut(step, "step")
        up = step.select(F.col("node").alias("u_node"), F.col("root").alias("u"))
        fresh = step.join(up, F.col("root") == F.col("u_node"), "left").select("node", "old", F.least("root", F.coalesce("u", "root")).alias("root"))
        fresh = cut(fresh, "labels")
        labels = fresh.select("node", "root")
        if fresh.filter("root != old").isEmpty():
            return labels


def classes(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """docs (doc_id, text) -> for every row: doc_id, raw (hash of the text), class_id, n_links, first (whether it stays)."""
    bands = bands_for(similarity, recall)
    docs = docs.select("doc_id", "text")
    rows = cut(document_sets(docs, bands).withColumn("row", F.monotonically_increasing_id()), "documents")
    links, edges = set_links(docs, rows, bands, similarity)
    roots = cut(components(edges), "components")
    of_set = rows.filter("set IS NOT NULL").groupBy("set").agg(F.count("*").alias("docs"), F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("doc_id"), F.col("row").alias("row"))).alias("first"))
    of_set = of_set.join(links, "set", "left").join(roots.withColumnRenamed("node", "set"), "set", "left")
    of_set = of_set.filter("docs > 1 OR links > 0").withColumn("root", F.coalesce("root", "set"))
    of_set = cut(of_set, "sets")
    named = of_set.groupBy("root").agg(F.min("first").alias("class"))
    of_set = of_set.join(named, "root").select("set", F.col("class.doc_id").alias("c_id"), F.col("class.row").alias("c_row"), (F.coalesce("links", F.lit(0)) + F.col("docs") - 1).alias("links"))
    of_set = cut(of_set, "classes")
    out = rows.select("doc_id", "raw", "row", "set").join(of_set, "set", "left")
    alone = F.col("c_row").isNull()
    return out.select(
        "doc_id",
        "raw",
        F.when(alone, F.col("doc_id")).otherwise(F.col("c_id")).alias("class_id"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        (alone | (F.col("row") == F.col("c_row"))).alias("first"),
    )


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs, with its columns, with one document of each class."""
    columns = docs.columns
    marks = classes(docs, similarity).groupBy("doc_id", "raw").agg(F.bool_or("first").alias("stays"), F.count("*").alias("rows"))
    marks = cut(marks.filter("NOT stays OR rows > 1").select(F.col("doc_id").alias("g_id"), F.col("raw").alias("g_raw"), "stays"), "gone")
    inner = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("raw"), F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"))
    bits = cut(sieve(marks, F.xxhash64("g_id", "g_raw")), "sieve")
    inner = sifted(inner, F.xxhash64("doc_id", "raw"), bits, "maybe")
    sure = inner.filter("NOT maybe").select("row.*")
    met = inner.filter("maybe").join(marks, F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("raw") == F.col("g_raw")), "left")
    # of repeated rows one stays, if any; which, if further columns differ, is decided by all columns
    one = met.filter("stays").groupBy("doc_id", "raw").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    return sure.unionByName(met.filter("stays IS NULL").select("row.*")).unionByName(one.select("row.*"))


def op6_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id, n_links for every document."""
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")
