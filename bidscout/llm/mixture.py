r"""Mixing sources to target weights by the cube method of balanced sampling.

Every source has a target in words. A document is taken floor(r) times, with r =
target / words of its source, and once more if it is sampled; its inclusion
probability is the fraction of r. The sample is balanced: while probabilities
move, at random, to 0 or 1, the sums of words and of documents expected from the
source stay as they are.

Flight: three undecided documents have a direction u in which both totals stay
(the null space of two balancing equations); one moves along u until a
probability reaches 0 or 1. A block of a source runs through its documents with
three of them in hand and leaves two or three undecided. Rounds merge blocks:
the undecided of many blocks form the next round's blocks, until a source is one
block. Landing: the last two or three, with ten that sat out the last block's
flight, are decided so that the words come nearest to the expected total.

Repeated rows are counted first and are one row of a block. So a block has a
bounded number of rows (BLOCK, about), whatever a source's size, and a hot source
is many tasks. Rows are narrow (no text). The order of blocks and rows
comes from hashes of the ids, so that reruns agree. A source of one block waits,
unflown, for the last round and its landing, whatever other sources do.

Sources are a table: ranked by ranges, and their targets found in rounds in which
only two sums come to the driver. The table meets the documents in a join that
Spark broadcasts if it is small.

Defined cases: null text has size 0; a null source comes last in the order;
documents of size 0 are sampled like others; repeated rows are rows of their
own, and as many of them are taken as their probabilities sum up to, give or take
one (of those with different further columns, which ones depends on how the table
is partitioned); a source without words, or an empty table, takes nothing; no document is
taken more than `cap` times. Further columns are ignored by mix() and kept by
mixed().
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table, words_of

#: Rows of a block, about.
BLOCK = 2_000
#: Repeated rows that one task writes out.
SLICE = 1 << 16
#: Documents of a source that are kept for its landing.
LANDING = 10
EPS = 1e-9


def targets(sums: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """sums (source, source_size) -> with rank (code point order, null last) and target.

    Shares of the whole size by weight; at most cap times a size, the excess shared by weight among the others.
    """
    # each range is ranked in its own task; what comes before it is a sum of as many rows as there are ranges
    ranged = sums.withColumn("none", F.col("source").isNull()).repartitionByRange(F.col("none"), F.col("source")).withColumn("part", F.spark_partition_id())
    ranged = cut(ranged, "ranges")
    before = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = before.select(F.col("part").alias("b_part"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("part").orderBy("none", "source"))
    ranked = ranged.withColumn("within", within).join(F.broadcast(before), F.col("part") == F.col("b_part"))
    ranked = ranked.withColumn("rank", (F.col("before") + F.col("within") - 1).cast("long")).drop("none", "part", "b_part", "before", "within")
    weight = F.get(F.array(*(F.lit(float(w)) for w in weights)), F.pmod("rank", F.lit(len(weights))).cast("int"))
    ranked = cut(ranked.withColumn("weight", weight), "ranked")
    level = 0.0  # words for a weight of 1
    while True:
        full = F.lit(level) * F.col("weight") > F.lit(cap) * F.col("source_size")
        size = F.col("source_size").cast("double")
        r = ranked.agg(F.sum(size).alias("total"), F.sum(F.when(full, size * cap)).alias("held"), F.sum(F.when(~full, F.col("weight"))).alias("free")).first()
        more = max(level, (r["total"] - (r["held"] or 0.0)) / r["free"]) if r["free"] else level
        if more <= level * (1 + 1e-12):
            break
        level = more
    return ranked.withColumn("target", F.least(F.lit(level) * F.col("weight"), F.lit(cap) * F.col("source_size")))


def flight(size: np.ndarray, prob: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """prob after the flight phase: all but two or three are 0 or 1; sums of prob and of size * prob are kept."""
    p = prob.astype(float).tolist()
    s = size.astype(float).tolist()
    draws = rng.random(len(p) + 1).tolist()
    hand: list[int] = []
    for i in range(len(p)):
        if p[i] < EPS or p[i] > 1 - EPS:
            p[i] = float(round(p[i]))
            continue
        hand.append(i)
        while len(hand) >= 3 or len(hand) == 2 and s[hand[0]] == s[hand[1]]:
            if len(hand) == 3:
                a, b, c = (s[k] for k in hand)
                u = (b - c, c - a, a - b)
                if not any(u):
                    u = (1.0, -1.0, 0.0)
            else:
                u = (1.0, -1.0)
            up = min((1 - p[k]) / x if x > 0 else p[k] / -x for k, x in zip(hand, u, strict=True) if x)
            down = min(p[k] / x if x > 0 else (1 - p[k]) / -x for k, x in zip(hand, u, strict=True) if x)
            step = up if draws[i] * (up + down) < down else -down
            left = []
            for k, x in zip(hand, u, strict=True):
                p[k] += step * x
                if p[k] < EPS or p[k] > 1 - EPS:
                    p[k] = float(round(p[k]))
                else:
                    left.append(k)
            if len(left) == len(hand):  # only by rounding: the nearest to an end gets there
                k = min(left, key=lambda j: min(p[j], 1 - p[j]))
                p[k] = float(round(p[k]))
                left.remove(k)
            hand = left
    return np.array(p)


def landing(size: np.ndarray, prob: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Decides all of a source's last block.

    A few documents of evenly spread sizes sit out its flight. They and the two
    or three that the flight leaves are decided together, by trying all subsets:
    their words come nearest to the expected ones, then their number.
    """
    open_ = np.flatnonzero((prob >= EPS) & (prob <= 1 - EPS))
    by_size = open_[np.argsort(size[open_], kind="stable")]
    out = np.unique(by_size[np.linspace(0, len(by_size) - 1, min(LANDING, len(by_size))).round().astype(int)]) if len(by_size) else by_size
    p = prob.copy()
    p[out] = 0.0
    p = flight(size, p, rng)
    left = np.r_[np.flatnonzero((p >= EPS) & (p <= 1 - EPS)), out].astype(int)
    p[out] = prob[out]
    if len(left):
        subsets = (np.arange(2 ** len(left))[:, None] >> np.arange(len(left))) & 1
        off = np.abs(subsets @ size[left] - (size[left] * p[left]).sum())
        number = np.abs(subsets.sum(axis=1) - p[left].sum())
        p[left] = subsets[np.lexsort((number, off))[0]]
    return np.round(p)


def _block(seed: int, final: bool):
    def fly(part: pa.Table) -> pa.Table:
        marks = part["mark"].to_numpy()
        order = np.argsort(marks, kind="stable")  # equal marks are equal rows
        size = part["size"].to_numpy()[order].astype(float)
        rng = np.random.default_rng([seed, int(marks[order[0]]) & 0xFFFFFFFF, len(order)])
        out = np.empty(len(order))
        out[order] = (landing if final else flight)(size, part["prob"].to_numpy()[order], rng)
        return part.set_column(part.schema.get_field_index("prob"), "prob", pa.array(out))

    return fly


def mix_units(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3.0, seed: int = 7) -> DataFrame:
    """docs (doc_id, source, size) -> for each set of repeated rows: doc_id, source, key, size, rows, source_size, target, times, more.

    Each of the rows is taken `times` times, and `more` of them once more. They
    are one unit of the sample: of rows * probability the whole part is sure and
    the fraction is the unit's own probability.
    """
    if "key" not in docs.columns:
        docs = docs.withColumn("key", F.lit(0).cast("long"))
    docs = docs.select("doc_id", "source", F.col("key"), F.col("size").cast("long").alias("size"))
    docs = cut(docs.groupBy("doc_id", "source", "key", "size").agg(F.count("*").alias("rows")), "sizes")
    sums = docs.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count("*").alias("units"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = targets(sums, weights, cap).select(F.col("source").alias("p_source"), "source_size", "target", rate.alias("rate"), F.ceil(F.col("units") / BLOCK).alias("blocks"))
    plan = cut(plan, "plan")
    rows = docs.join(plan, F.col("source").eqNullSafe(F.col("p_source"))).drop("p_source")
    rows = rows.withColumn("times", F.floor(F.least(F.col("rate"), F.lit(cap)) + EPS).cast("long"))
    expected = F.greatest(F.least(F.col("rate"), F.lit(cap)) - F.col("times"), F.lit(0.0)) * F.col("rows")
    rows = rows.withColumn("prob", expected).withColumn("more", F.floor(F.col("prob") + EPS).cast("long"))
    rows = rows.withColumn("prob", F.greatest(F.col("prob") - F.col("more"), F.lit(0.0)))
    rows = rows.withColumn("mark", F.xxhash64("doc_id", "key", "size", F.lit(seed))).withColumn("block", F.pmod("mark", "blocks"))

    schema = rows.schema
    last = plan.agg(F.max("blocks").alias("n")).first()["n"] or 1
    done, alone, number = [], [], 0
    while last > 1:
        # a source that is one block waits for its landing
        alone.append(rows.filter("blocks = 1"))
        # a block is bounded, so it can be one group; source and block spread hot sources
        moved = cut(rows.filter("blocks > 1").groupBy("source", "block").applyInArrow(_block(seed, False), schema), "flight")
        decided = (F.col("prob") == 0) | (F.col("prob") == 1)
        done.append(moved.filter(decided))
        # at most three of each block are left
        last, number = -(-3 * last // BLOCK), number + 1
        rows = moved.filter(~decided).withColumn("blocks", F.ceil(3 * F.col("blocks") / BLOCK))
        rows = rows.withColumn("block", F.pmod(F.xxhash64("block", F.lit(number)), F.col("blocks")))
    for more in alone:
        rows = rows.unionByName(more)
    out = cut(rows.groupBy("source").applyInArrow(_block(seed, True), schema), "landing")
    for more in done:
        out = out.unionByName(more)
    return out.select("doc_id", "source", "key", "size", "rows", "source_size", "target", "times", (F.col("more") + F.col("prob").cast("long")).alias("more"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3.0, seed: int = 7) -> DataFrame:
    """docs (doc_id, source, size) -> for every row: doc_id, source, key, size, source_size, target, times.

    Sources in code point order (null last) get the weights, repeated; the mix
    is as large as all of docs. key is docs.key, if there.
    """
    units = mix_units(docs, weights, cap, seed)
    # a unit of very many rows is written out by many tasks
    few = units.filter(F.col("rows") <= SLICE).withColumn("n", F.explode(F.sequence(F.lit(1).cast("long"), "rows")))
    slices = units.filter(F.col("rows") > SLICE).withColumn("from", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"), F.lit(SLICE).cast("long"))))
    slices = slices.repartition(F.xxhash64("doc_id", "source", "key", "from"))
    many = slices.withColumn("n", F.explode(F.sequence("from", F.least(F.col("from") + SLICE - 1, F.col("rows"))))).drop("from")
    again = (F.col("n") <= F.col("more")).cast("long")
    return few.unionByName(many).select("doc_id", "source", "key", "size", "source_size", "target", (F.col("times") + again).alias("times"))


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", words_of(F.col("text")).alias("size"))
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """The rows of docs that the mix takes, with their columns and times, size, source_size and target."""
    columns = docs.columns
    inner = docs.select(F.col("doc_id").alias("d_id"), F.xxhash64("text").alias("d_key"), F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), "source", words_of(F.col("text")).alias("d_size"))
    narrow = inner.select(F.col("d_id").alias("doc_id"), F.col("source"), F.col("d_key").alias("key"), F.col("d_size").alias("size"))
    # repeated rows share a key: their numbers of times (two at most) are dealt out among them
    own = mix_units(narrow, weights, cap).withColumn("low", F.col("times") + (F.col("more") == F.col("rows")).cast("long")).withColumn("high", F.col("times") + (F.col("more") > 0).cast("long"))
    own = cut(own.select(F.col("doc_id").alias("p_id"), F.col("source").alias("p_source"), F.col("key").alias("p_key"), "size", "source_size", "target", "low", "high", F.col("more").alias("highs")), "times")
    met = inner.join(own, F.col("d_id").eqNullSafe(F.col("p_id")) & F.col("d_key").eqNullSafe(F.col("p_key")) & F.col("source").eqNullSafe(F.col("p_source")))
    alike = F.col("high") == F.col("low")
    # a row's number among those repeated: within its own part of the table, after those in parts before
    several = cut(met.filter(~alike).withColumn("part", F.spark_partition_id()), "several")
    keys = ("p_id", "p_source", "p_key")
    before = several.groupBy(*keys, "part").agg(F.count("*").alias("n"))
    before = before.withColumn("before", F.sum("n").over(Window.partitionBy(*keys).orderBy("part")) - F.col("n")).select(*(F.col(k).alias(f"b_{k}") for k in keys), F.col("part").alias("b_part"), "before")
    several = several.withColumn("n", F.row_number().over(Window.partitionBy(*keys, "part").orderBy(F.xxhash64(F.to_json("row")))))
    several = several.join(before, (F.col("part") == F.col("b_part")) & F.col("p_id").eqNullSafe(F.col("b_p_id")) & F.col("p_key").eqNullSafe(F.col("b_p_key")) & F.col("p_source").eqNullSafe(F.col("b_p_source")))
    several = several.withColumn("times", F.when(F.col("n") + F.col("before") <= F.col("highs"), F.col("high")).otherwise(F.col("low")))
    new = ["times", "size", "source_size", "target"]
    met = met.filter(alike).withColumn("times", F.col("high")).select("row", *new).unionByName(several.select("row", *new)).filter("times > 0")
    taken = {c.lower() for c in columns}
    return met.select(*(F.col(f"row.`{c}`").alias(c) for c in columns), *(F.col(c).alias(c if c not in taken else f"mix_{c}") for c in new))
