"""Quality classifier: a sparse ensemble of rules over text statistics.

1. Statistics of whole texts (STATISTICS) are counted in numpy arrays of their
   bytes, in parts of a bounded size; Arrow hands over batches of texts.
2. A random forest is grown on the labelled rows; each path from a root to a
   node is a rule, a conjunction of bounds on statistics.
3. A logistic regression with a lasso penalty weighs the rules; most weights are 0.
4. The rules left are compiled into one Spark column, the score.

Training reads every labelled row (narrow: numbers only) and is distributed; the
driver holds the forest's nodes and the weights, whose number is set by TREES
and DEPTH, not by the data. Scoring is a projection.

Defined cases: statistics don't depend on the parts that a long text is counted
in, as words and neighbours that a cut goes through are put together again; null
text is the empty text, and it gets a score; labels other than 0 and 1, or null,
aren't learnt from; a document labelled twice counts twice; with labels of one
class only (or none) the score is that class's share (0.5 for none); an empty
table gives no rows; further columns are kept by keep_good().
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import bytes_of, cut, sieve, sifted, table

TREES, DEPTH, LASSO, SEED = 24, 4, 0.001, 11
GOOD = 0.7


STATISTICS = ("chars", "words", "word_length", "longest", "symbols", "bars", "shouts", "capitals", "digits", "stops", "marks", "foreign", "lines", "distinct", "pairs", "repeated")
#: Bytes that are counted at once.
PART = 1 << 18

_rng = np.random.default_rng(3)
_mixed = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_base = 0x9E3779B97F4A7C15
_power = np.cumprod(np.r_[np.uint64(1), np.full(PART, _base, np.uint64)], dtype=np.uint64)
_inverse = np.cumprod(np.r_[np.uint64(1), np.full(PART, pow(_base, -1, 2**64), np.uint64)], dtype=np.uint64)
# classes of bytes
LETTER, SPACE, NEWLINE, DIGIT, CAPITAL, SYMBOL, BAR, SHOUT, STOP, MARK, LEAD, REST = range(12)
_class = np.full(256, MARK, np.uint8)
for _kind, _chars in ((LETTER, b"abcdefghijklmnopqrstuvwxyz"), (SPACE, b" \t\x0b\x0c\r"), (NEWLINE, b"\n"), (DIGIT, b"0123456789"), (CAPITAL, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (SYMBOL, b"#$%&*@^~=+<>{}[]\\_"), (BAR, b"|"), (SHOUT, b"!"), (STOP, b".,;:?"), (REST, bytes(range(0x80, 0xC0))), (LEAD, bytes(range(0xC0, 0x100)))):
    _class[list(_chars)] = _kind


def parts_of(data: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, the text that each is of) of at most PART bytes, and of one text only if it is longer. No character is cut."""
    i, n = 0, len(ends) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + PART, side="right")) - 1)
        a, b = int(ends[i]), int(ends[j])
        if b - a <= PART:
            yield data[a:b], np.repeat(np.arange(i, j), np.diff(ends[i : j + 1]))
        else:
            while a < b:
                to = min(a + PART, b)
                while to < b and _class[data[to]] == REST:
                    to -= 1
                yield data[a:to], np.full(to - a, i)
                a = to
        i = j


class LongText:
    """The words of a text that comes in parts, counted as if it came at once."""

    def __init__(self) -> None:
        self.open: tuple[int, int] | None = None  # hash and length of a word that the next part may go on with
        self.last = np.empty(0, np.uint64)  # the last whole word
        self.words = self.longest = self.repeated = 0
        self.distinct: list[np.ndarray] = []
        self.pairs: list[np.ndarray] = []

    def add(self, word: np.ndarray, length: np.ndarray, begun: bool, unfinished: bool) -> None:
        """word: hashes without their lengths. begun: the part starts within a word, or at one; unfinished: it ends so."""
        if self.open:
            before, n = self.open
            if begun:
                word[0] = (before + int(word[0]) * pow(_base, n, 2**64)) % 2**64
                length[0] += n
            else:
                word, length = np.r_[np.uint64(before), word], np.r_[n, length]
        self.open = (int(word[-1]), int(length[-1])) if unfinished else None
        if unfinished:
            word, length = word[:-1], length[:-1]
        self.words += len(word)
        self.longest = max(self.longest, int(length.max(initial=0)))
        all_ = np.r_[self.last, word + length.astype(np.uint64)]
        self.repeated += int((all_[1:] == all_[:-1]).sum())
        self.distinct.append(np.unique(all_))
        self.pairs.append(np.unique(two_of(all_)))
        self.last = all_[-1:]

    def end(self) -> None:
        self.add(np.empty(0, np.uint64), np.empty(0, np.int64), False, False)


def two_of(word: np.ndarray) -> np.ndarray:
    """Hashes of words beside each other."""
    return word[:-1] * np.uint64(31) ^ word[1:]


def counted(column: pa.Array) -> dict[str, np.ndarray]:
    """The statistics of each text."""
    data, ends = bytes_of(column)
    n = len(ends) - 1
    classes, accents = np.zeros((n, 12)), np.zeros(n)
    words, repeated, longest, distinct, pairs = (np.zeros(n) for _ in range(5))
    of_long: dict[int, LongText] = {}
    for part, text in parts_of(data, ends):
        if not len(part):
            continue
        kind = _class[part]
        low, high = int(text[0]), int(text[-1]) + 1
        classes[low:high] += np.bincount((text - low) * 12 + kind, minlength=12 * (high - low)).reshape(-1, 12)
        accent = np.flatnonzero((part[:-1] == 0xC3) & (part[1:] >= 0x80) & (part[1:] <= 0x9E) & (part[1:] != 0x97))
        accents[low:high] += np.bincount(text[accent] - low, minlength=high - low)
        blank = (kind == SPACE) | (kind == NEWLINE)
        begins = np.r_[True, blank[:-1] | (text[1:] != text[:-1])] & ~blank
        stops = np.r_[blank[1:] | (text[1:] != text[:-1]), True] & ~blank
        first, last = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        sums = np.r_[np.uint64(0), np.cumsum(_mixed[part] * _power[: len(part)], dtype=np.uint64)]
        word, length = (sums[last] - sums[first]) * _inverse[first], last - first
        if ends[low + 1] - ends[low] > PART:
            of_long.setdefault(low, LongText()).add(word, length, not blank[0], not blank[-1])
            continue
        word = word + length.astype(np.uint64)
        of = text[first] - low
        words[low:high] += np.bincount(of, minlength=high - low)
        np.maximum.at(longest, text[first], length)
        near = of[1:] == of[:-1]
        repeated[low:high] += np.bincount(of[1:][near & (word[1:] == word[:-1])], minlength=high - low)
        two, of_two = two_of(word)[near], of[1:][near]
        for out, hashes, at in ((distinct, word, of), (pairs, two, of_two)):
            _, unique = np.unique(hashes + at.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93), return_index=True)
            out[low:high] += np.bincount(at[unique], minlength=high - low)
    for i, own in of_long.items():
        own.end()
        words[i], longest[i], repeated[i], distinct[i], pairs[i] = own.words, own.longest, own.repeated, len(np.unique(np.concatenate(own.distinct))), len(np.unique(np.concatenate(own.pairs)))
    chars = classes.sum(axis=1) - classes[:, REST]

    def share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
        return np.divide(part, whole, out=np.zeros(n), where=whole > 0)

    return {
        "chars": chars,
        "words": words,
        "word_length": share(chars, words),
        "longest": longest,
        "symbols": share(classes[:, SYMBOL], chars),
        "bars": share(classes[:, BAR], words),
        "shouts": share(classes[:, SHOUT], words),
        "capitals": share(classes[:, CAPITAL] + accents, chars),
        "digits": share(classes[:, DIGIT], chars),
        "stops": share(classes[:, STOP], words),
        "marks": share(classes[:, MARK], chars),
        "foreign": share(classes[:, LEAD], chars),
        "lines": share(classes[:, NEWLINE], words),
        "distinct": share(distinct, words),
        "pairs": share(pairs, words),
        "repeated": share(repeated, words),
    }


@F.arrow_udf(StructType([StructField(k, DoubleType()) for k in STATISTICS]))
def statistics(text: pa.Array) -> pa.Array:
    found = counted(text)
    return pa.StructArray.from_arrays([pa.array(found[k]) for k in STATISTICS], names=list(STATISTICS))


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the struct column stats."""
    # not deterministic to the optimizer, so that it doesn't repeat it where it is read
    return docs.withColumn("stats", statistics.asNondeterministic()(F.col(text)))


#: (statistic, whether above the bound, the bound)
Bound = tuple[str, bool, float]


@dataclass
class RuleModel:
    """score = 1 / (1 + exp(-(intercept + sum of the weights of the rules that hold)))"""

    intercept: float
    rules: list[tuple[float, tuple[Bound, ...]]] = field(default_factory=list)

    def score(self, stats: str = "stats") -> Column:
        weighed = [{"weight": w, "bounds": numbered(r)} for w, r in self.rules]
        x = F.array(*(F.col(f"{stats}.{name}") for name in STATISTICS))
        rules = F.from_json(F.lit(json.dumps(weighed)), f"array<struct<weight:double,bounds:{BOUNDS}>>")
        total = F.aggregate(rules, F.lit(self.intercept), lambda sum_, r: sum_ + F.when(all_hold(r["bounds"], x), r["weight"]).otherwise(F.lit(0.0)))
        return 1 / (1 + F.exp(-total))


#: A rule as a value: numbers of statistics (from 0), sides and bounds. Expressions of all rules filled the driver.
BOUNDS = "array<struct<stat:int,above:boolean,bound:double>>"


def numbered(rule: tuple[Bound, ...]) -> list[dict]:
    return [{"stat": STATISTICS.index(name), "above": bool(above), "bound": float(bound)} for name, above, bound in rule]


def all_hold(bounds: Column, x: Column) -> Column:
    """Whether the statistics x (array<double>, in their order) are within all bounds of a rule."""
    return F.forall(bounds, lambda b: (F.get(x, b["stat"]) > b["bound"]) == b["above"])


def all_held(rules: list[tuple[Bound, ...]], x: Column) -> Column:
    """array<double>: 1 for each rule that holds, else 0."""
    values = F.from_json(F.lit(json.dumps([numbered(r) for r in rules])), f"array<{BOUNDS}>")
    return F.transform(values, lambda bounds: all_hold(bounds, x).cast("double"))


def paths(node, names: tuple[str, ...], so_far: tuple[Bound, ...] = ()) -> list[tuple[Bound, ...]]:
    """The rules of a tree: the bounds on the way to each node below the root."""
    out = [so_far] if so_far else []
    if node.subtreeDepth() > 0:
        name, bound = names[node.split().featureIndex()], node.split().threshold()
        for child, above in ((node.leftChild(), False), (node.rightChild(), True)):
            out += paths(child, names, tighter(so_far, (name, above, bound)))
    return out


def tighter(rule: tuple[Bound, ...], new: Bound) -> tuple[Bound, ...]:
    """rule and new, with one bound for each statistic and side, in a fixed order."""
    kept = {(n, a): b for n, a, b in rule}
    n, a, b = new
    if (n, a) in kept:
        b = max(b, kept[n, a]) if a else min(b, kept[n, a])
    kept[n, a] = b
    return tuple(sorted((n, a, b) for (n, a), b in kept.items()))


def fit(labelled: DataFrame) -> RuleModel:
    """labelled (stats, label 0 or 1) -> the model."""
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    data = cut(labelled.filter("label IN (0, 1)").select("stats.*", F.col("label").cast("double").alias("label")), "labelled")
    seen = {r["label"]: r["count"] for r in data.groupBy("label").count().collect()}
    if len(seen) < 2:
        share = next(iter(seen), 0.5)
        return RuleModel(40.0 if share == 1 else -40.0 if share == 0 else 0.0)
    x = VectorAssembler(inputCols=list(STATISTICS), outputCol="x").transform(data)
    forest = RandomForestClassifier(labelCol="label", featuresCol="x", numTrees=TREES, maxDepth=DEPTH, maxBins=64, minInstancesPerNode=5, subsamplingRate=0.7, featureSubsetStrategy="onethird", seed=SEED).fit(x)
    rules = sorted({r for tree in forest.trees for r in paths(tree._java_obj.rootNode(), STATISTICS)})
    held = data.select("label", F.array(*STATISTICS).alias("x")).select("label", all_held(rules, F.col("x")).alias("held"))
    from pyspark.ml.functions import array_to_vector

    held = held.select("label", array_to_vector("held").alias("x"))
    lasso = LogisticRegression(labelCol="label", featuresCol="x", elasticNetParam=1.0, regParam=LASSO, maxIter=60, standardization=True).fit(held)
    weights = lasso.coefficients.toArray().tolist()
    return RuleModel(float(lasso.intercept), [(w, r) for w, r in zip(weights, rules, strict=True) if w and math.isfinite(w)])


def held_out(doc_id: str = "doc_id") -> Column:
    """The rows that no model learns from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def learnable(labels: DataFrame) -> DataFrame:
    """doc_id, label of the rows that aren't held out."""
    return labels.select("doc_id", F.col("quality").alias("label")).filter(~held_out()).filter("label IN (0, 1)")


def train(docs: DataFrame, labels: DataFrame) -> RuleModel:
    """From the rows that aren't held out. Texts aren't shuffled: a sieve finds those with a label, their numbers meet it."""
    known = learnable(labels)
    bits = cut(sieve(known, F.xxhash64("doc_id")), "sieve")
    maybe = sifted(docs.select("doc_id", "text"), F.xxhash64("doc_id"), bits, "maybe").filter("maybe").drop("maybe")
    return fit(with_statistics(maybe).select("doc_id", "stats").join(known, "doc_id").select("stats", "label"))


def scored(docs: DataFrame, model: RuleModel) -> DataFrame:
    """docs with score and predicted (1 if score >= GOOD)."""
    made = with_statistics(docs).withColumn("score", model.score()).drop("stats")
    return made.withColumn("predicted", (F.col("score") >= GOOD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs, with its columns, without those that the classifier rejects."""
    columns = docs.columns
    inner = docs.select("text", F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"))
    return scored(inner, train(docs, labels)).filter("predicted = 1").select("row.*")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted. Texts are read once; their statistics are written and serve training and scoring."""
    stats = cut(with_statistics(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "stats"), "statistics")
    model = fit(stats.join(learnable(table(spark, sf_dir, "labels")), "doc_id").select("stats", "label"))
    return stats.select("doc_id", held_out().alias("held_out"), model.score().alias("score")).withColumn("predicted", (F.col("score") >= GOOD).cast("int"))
