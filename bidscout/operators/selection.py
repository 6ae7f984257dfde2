"""Choosing among the candidates of a line: options, best exact, caps, outliers.

All of these work within a line (key, default sku), whose candidates are few by
the caps on discovery; orders are made total by disc_seq and offer_id, so that
results don't depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions import rules as R

LAST = ("disc_seq", "offer_id")


def _first(df: DataFrame, by: list[str], order: list[Column], k: int = 1, name: str = "rank") -> DataFrame:
    """The first k rows of each group, numbered."""
    w = Window.partitionBy(*by).orderBy(*order, *LAST)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)


def domain_cap(cands: DataFrame, cap: int = C.DOMAIN_CAP, key: str = "sku") -> DataFrame:
    """At most cap candidates of a line from one domain, cheapest first, unpriced last; seeds don't count."""
    seed = R.true("is_seed")
    w = Window.partitionBy(key, "domain", seed).orderBy(F.col("price").isNull(), "price", *LAST)
    return cands.withColumn("domain_rank", F.row_number().over(w)).filter(seed | (F.col("domain_rank") <= cap))


def cached_domain_cap(cands: DataFrame, cap: int = C.DOMAIN_CAP, key: str = "sku") -> DataFrame:
    """At most cap candidates of a line from one domain, as they were found; of cached discoveries, where seeds count."""
    return _first(cands, [key, "domain"], [], cap, "domain_rank")


def shortlist(cands: DataFrame, size: int = C.SHORTLIST, reserve: int = C.RESERVE, key: str = "sku") -> DataFrame:
    """Seeds, then priced candidates in the places that reserve and seeds leave, then up to reserve unpriced ones, trusted first."""
    kind = F.when(R.true("is_seed"), 0).when(F.col("price").isNotNull(), 1).otherwise(2)
    df = cands.withColumn("kind", kind)
    df = df.withColumn("seeds", F.sum(F.when(F.col("kind") == 0, 1).otherwise(0)).over(Window.partitionBy(key)))
    order = [F.when(F.col("kind") == 1, F.col("price")), F.when(F.col("kind") == 2, ~R.true("trusted"))]
    df = df.withColumn("place", F.row_number().over(Window.partitionBy(key, "kind").orderBy(*order, *LAST)))
    places = F.greatest(F.lit(size - reserve) - F.col("seeds"), F.lit(0))
    return df.filter((F.col("kind") == 0) | (F.col("kind") == 1) & (F.col("place") <= places) | (F.col("kind") == 2) & (F.col("place") <= reserve))


def scrape_queue(cands: DataFrame, attempted: int = C.ATTEMPTED, paid: int = C.PAID, key: str = "sku") -> DataFrame:
    """The first candidates to read, aggregators, priced, trusted, others; paid reads are capped by a running sum."""
    tier = F.when(R.true("aggregator"), 0).when(F.col("price").isNotNull(), 1).when(R.true("trusted"), 2).otherwise(3)
    df = cands.withColumn("queue_tier", tier)
    w = Window.partitionBy(key).orderBy("queue_tier", F.col("price").isNull(), "price", *LAST)
    df = df.withColumn("queue_place", F.row_number().over(w)).filter(F.col("queue_place") <= attempted)
    spent = F.sum(F.when(R.true("paid_read"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("paid_so_far", spent).filter(~R.true("paid_read") | (F.col("paid_so_far") <= paid))


def select_options(cands: DataFrame, options: int = C.OPTIONS, key: str = "sku") -> DataFrame:
    """Up to `options` candidates of a line: the cheapest eligible one, then by tier and price, one of each domain."""
    pool = cands.filter(R.poolable()).withColumn("tier", R.option_tier()).withColumn("eligible", R.price_match_eligible())
    order = [F.col("tier"), R.true("out_of_stock"), R.true("price_unreliable"), F.col("price")]
    pool = _first(pool, [key, "domain"], order, name="domain_rank").drop("domain_rank")
    cheapest = F.row_number().over(Window.partitionBy(key).orderBy(~F.col("eligible"), "price", *order, *LAST))
    pool = pool.withColumn("leads", F.col("eligible") & (cheapest == 1))
    return _first(pool, [key], [~F.col("leads"), *order], options, "option_no").drop("leads")


def is_equivalent() -> Column:
    """A cross-brand alternative below the unit price, of the same pack as far as is known."""
    same_pack = (F.col("pack_qty") == F.col("ordered_pack")) | F.coalesce(F.col("pack_qty"), F.lit(0)).isin(0) | F.coalesce(F.col("ordered_pack"), F.lit(0)).isin(0)
    barred = R.true("out_of_stock") | R.true("variant_conflict") | R.pack_conflict() | R.true("price_unreliable") | R.gated()
    priced = F.coalesce((F.col("price") < F.col("unit_price")) & (F.col("price") >= F.col("unit_price") * C.SANE_LOW), F.lit(False))
    return priced & F.col("page_name").isNotNull() & ~barred & same_pack


def equivalents(cands: DataFrame, most: int = 2, key: str = "sku") -> DataFrame:
    """Alternatives: the first of each domain as found, then the cheapest."""
    found = _first(cands.filter(is_equivalent()), [key, "domain"], [], name="domain_rank").drop("domain_rank")
    return _first(found, [key], [F.col("price")], most, "equivalent_no")


def flag_low_outliers(cands: DataFrame, key: str = "sku") -> DataFrame:
    """low_outlier: price under 0.45 of the upper median of the line's named, priced rows (three at least).

    The median is the row at its place in a window, which spills, not in an array.
    """
    counted = F.when(F.col("page_name").isNotNull() & F.col("price").isNotNull() & (F.col("match_type") != "rejected"), F.col("price"))
    line = Window.partitionBy(key)
    df = cands.withColumn("counted", counted).withColumn("n", F.count("counted").over(line))
    df = df.withColumn("k", F.row_number().over(line.orderBy(F.col("counted").asc_nulls_last())) - 1)
    middle = F.when((F.col("k") == F.floor(F.col("n") / 2)) & (F.col("n") >= C.LOW_OUTLIER_ROWS), F.col("counted"))
    df = df.withColumn("line_median", F.max(middle).over(line))
    low = F.coalesce(F.col("counted") < F.col("line_median") * C.LOW_OUTLIER, F.lit(False)) & ~R.true("price_locked")
    return df.withColumn("low_outlier", low).drop("counted", "n", "k")


class OrderStatistics:
    """Prices of a line in order, of which some go: the k-th that is left, in log n (counts of what is left, by powers of two)."""

    def __init__(self, prices: np.ndarray):
        self.order = np.argsort(prices, kind="stable")
        self.place = np.empty(len(prices), np.int64)
        self.place[self.order] = np.arange(len(prices))
        self.left = len(prices)
        i = np.arange(1, len(prices) + 1)
        self.counts = [0, *(i & -i).tolist()]

    def before(self, place: int) -> int:
        n = 0
        while place > 0:
            n, place = n + self.counts[place], place & (place - 1)
        return n

    def kth(self, k: int) -> int:
        """The row with k of those that are left before it."""
        at, step = 0, 1 << (len(self.order).bit_length())
        while step:
            if at + step < len(self.counts) and self.counts[at + step] <= k:
                at += step
                k -= self.counts[at]
            step >>= 1
        return int(self.order[at])

    def remove(self, row: int) -> None:
        place, self.left = int(self.place[row]) + 1, self.left - 1
        while place < len(self.counts):
            self.counts[place] -= 1
            place += place & -place

    def upper_median_without(self, row: int) -> int:
        k = (self.left - 1) // 2
        return self.kth(k + (k >= self.before(int(self.place[row]))))


def lock_outliers_of(prices: np.ndarray, suspect: np.ndarray, low: float = C.LOCK_OUTLIER, peers: int = C.LOCK_PEERS) -> list[int]:
    """The rows (in discovery order) that are flagged: suspects under low of the upper median of the others that aren't flagged."""
    rows = np.flatnonzero(suspect)
    out: list[int] = []
    if len(rows) and len(prices) > peers:
        left = OrderStatistics(prices)
        for i in rows.tolist():
            if left.left > peers and prices[i] < prices[left.upper_median_without(i)] * low:
                out.append(i)
                left.remove(i)
    return out


def flag_lock_outliers(cands: DataFrame, key: str = "sku") -> DataFrame:
    """The locked rows (key, offer_id, price), not effectively exact, under half the upper median of the line's other reliable prices.

    Rows are judged in discovery order, and one that is flagged no longer counts as reliable for the next.
    Lines lie together and in order within partitions; a task holds the prices of one line, of which the
    median is found in log n when a row goes. Rows without price or page name and unreliable ones have no part.
    """
    suspect = F.coalesce(R.true("price_locked") & ~R.effective_exact(), F.lit(False))
    rows = cands.filter(F.col("price").isNotNull() & F.col("page_name").isNotNull() & ~R.true("price_unreliable"))
    rows = rows.select(key, "disc_seq", "offer_id", F.col("price").cast("double").alias("price"), suspect.alias("suspect"))
    rows = rows.repartition(key).sortWithinPartitions(key, "disc_seq", "offer_id", "price").select(key, "offer_id", "price", "suspect")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:3])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for part in parts:
            table = pa.Table.from_batches([part])
            held = table if held is None else pa.concat_tables([held, table])
            # all lines but the last are whole
            ends = pc.run_end_encode(held.column(0).combine_chunks()).run_ends
            if len(ends) > 1:
                whole = ends[-2].as_py()
                yield from flagged(held.slice(0, whole))
                held = held.slice(whole)
        if held is not None:
            yield from flagged(held)

    def flagged(lines: pa.Table) -> Iterator[pa.RecordBatch]:
        ends = pc.run_end_encode(lines.column(0).combine_chunks()).run_ends.to_numpy()
        prices, suspect = lines.column(2).to_numpy(), lines.column(3).to_numpy()
        hit: list[int] = []
        start = 0
        for end in ends.tolist():
            hit += [start + i for i in lock_outliers_of(prices[start:end], suspect[start:end])]
            start = end
        if hit:
            yield from lines.select([0, 1, 2]).take(pa.array(hit)).combine_chunks().to_batches()

    return rows.mapInArrow(run, kinds)


def best_exact(cands: DataFrame, key: str = "sku") -> DataFrame:
    """The cheapest sane exact candidate that isn't under a quarter of the upper median of those dearer than it (it included)."""
    bad = R.true("price_unreliable") | R.true("out_of_stock") | ~R.not_false("pack_match") | F.col("marketplace").isNotNull()
    pool = cands.filter((F.col("match_type") == "exact") & R.effective_exact() & F.col("price").isNotNull() & ~bad)
    # row k of n, from 0: the upper median of those from k on is row k + (n - k) // 2
    line = Window.partitionBy(key)
    pool = pool.withColumn("k", F.row_number().over(line.orderBy("price", *LAST)) - 1).withColumn("n", F.count("*").over(line))
    pool = pool.withColumn("m", F.col("k") + F.floor((F.col("n") - F.col("k")) / 2).cast("int"))
    middle = pool.select(key, F.col("k").alias("m"), (F.col("price") * C.BEST_FLOOR).alias("floor"))
    pool = pool.join(middle, [key, "m"])
    return _first(pool.filter(F.col("price") >= F.col("floor")), [key], [F.col("price")], name="best_rank").drop("floor", "best_rank", "k", "n", "m")


def marketplace_pick(cands: DataFrame, key: str = "sku") -> DataFrame:
    """For each line and marketplace the cheapest eligible listing, seeds first; if none is eligible, the one with the best score, not found."""
    own = cands.filter(F.col("marketplace").isin(*C.MARKETPLACES)).withColumn("found", R.marketplace_eligible()).withColumn("score", R.match_score())
    order = [~F.col("found"), F.when(F.col("found"), ~R.true("is_seed")), F.when(F.col("found"), F.col("price")), -F.col("score")]
    return _first(own, [key, "marketplace"], order, name="market_rank").drop("market_rank")


def first_by_url(cands: DataFrame, key: str = "sku") -> DataFrame:
    """The first candidate of each url of a line."""
    return _first(cands, [key, "url"], [], name="url_rank").drop("url_rank")


def recheck_picks(cands: DataFrame, most: int = 3, key: str = "sku") -> DataFrame:
    """Unlocked candidates worth a second look: unsure, unreliable, or exact with a criterion that failed."""
    failed = ~R.not_false("name_match") | ~R.not_false("brand_match") | ~R.not_false("size_form_match") | ~R.not_false("pack_match")
    pick = (F.coalesce("confidence", F.lit(0)) < 70) | R.true("price_unreliable") | ((F.col("match_type") == "exact") & failed)
    return _first(cands.filter(pick & ~R.true("price_locked")), [key], [], most, "pick_no")
