"""Token counts: rank-synchronous merging of batches of pre-tokens as ragged arrays.

The text is cut into pre-tokens; each distinct pre-token of a batch that isn't
yet known becomes a row of a ragged numpy array of symbols. In each round every
sequence finds its lowest-rank pair, and all sequences merge theirs at once;
when no sequence has a known pair, the surviving symbols are counted.

Spark deals the documents out; a task holds one Arrow batch and a bounded table
of known pre-tokens. No shuffle.

Defined cases: null and empty texts have 0 tokens and 0 bytes; repeated rows
are counted each; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

#: The pattern of byte-level BPE pre-tokens (a fixed value).
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Known pre-tokens that a task keeps; beyond it the table starts anew.
KNOWN = 1_000_000
#: Documents that a task holds at once; long ones are cut no further than by pre-tokens.
BATCH_CHARS = 4_000_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies -> the byte."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merger:
    """Counts the symbols that pre-tokens have after merging.

    symbols are numbered: 0-255 the bytes, then one for each merged string.
    A pair's key is left * 2**32 + right; keys are sorted for binary search.
    """

    def __init__(self, merges: list[tuple[bytes, bytes]]):
        number = {bytes([b]): b for b in range(256)}
        keys, made = [], []
        for left, right in merges:
            whole = left + right
            keys.append(number[left] << 32 | number[right])
            made.append(number.setdefault(whole, len(number)))
        order = np.argsort(np.array(keys, dtype=np.uint64), kind="stable")
        self.keys = np.array(keys, dtype=np.uint64)[order]
        self.rank = order.astype(np.int64)
        self.made = np.array(made, dtype=np.int64)  # by rank
        self.none = np.int64(len(keys))

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], self.none)

    def count(self, words: list[bytes]) -> np.ndarray:
        """The number of symbols of each word."""
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        out = sizes.copy()
        if not len(words) or not len(self.keys):
            return out
        symbols = np.frombuffer(b"".join(words), dtype=np.uint8).astype(np.int64)
        owner = np.repeat(np.arange(len(words)), sizes)
        # rank of the pair that starts at each symbol; a sequence's last symbol has none
        rank = np.full(len(symbols), self.none)
        inside = np.flatnonzero(owner[:-1] == owner[1:])
        rank[inside] = self.ranks(symbols[inside], symbols[inside + 1])
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lengths = np.diff(np.r_[starts, len(owner)])
            lowest = np.minimum.reduceat(rank, starts)
            going = lowest < self.none
            done = ~going
            out[owner[starts[done]]] = lengths[done]
            if not going.any():
                break
            stay = np.repeat(going, lengths)
            symbols, owner, rank, low = symbols[stay], owner[stay], rank[stay], np.repeat(lowest, lengths)[stay]
            hit = rank == low
            # of overlapping pairs of one rank (aaa), from the left every second one merges
            at = np.flatnonzero(hit)
            run = np.r_[True, np.diff(at) != 1]
            offset = at - np.repeat(at[run], np.diff(np.r_[np.flatnonzero(run), len(at)]))
            at = at[offset % 2 == 0]
            symbols[at] = self.made[low[at]]
            keep = np.ones(len(symbols), dtype=bool)
            keep[at + 1] = False
            at = at - np.searchsorted(at + 1, at, side="right")  # new positions: one gone for each merge before
            symbols, owner = symbols[keep], owner[keep]
            rank = rank[keep]
            again = np.unique(np.r_[at, at[at > 0] - 1])
            rank[again] = self.none
            again = again[again + 1 < len(symbols)]
            again = again[owner[again] == owner[again + 1]]
            rank[again] = self.ranks(symbols[again], symbols[again + 1])
        return out


@lru_cache(maxsize=2)
def load(path: str) -> tuple[Merger, tuple[str, ...]]:
    """The merger of a byte-level BPE file, and the special strings that stand for one token each."""
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    if said["model"]["type"] != "BPE" or said["pre_tokenizer"]["type"] != "ByteLevel" or said.get("normalizer"):
        raise ValueError(f"{path} isn't a byte-level BPE tokenizer")
    letters = byte_letters()
    raw = lambda s: bytes(letters[c] for c in s)
    pairs = (m if isinstance(m, list) else m.split(" ") for m in said["model"]["merges"])
    return Merger([(raw(a), raw(b)) for a, b in pairs]), tuple(x["content"] for x in said["added_tokens"])


class Counter:
    """Counts tokens of whole texts, with a bounded table of known pre-tokens."""

    def __init__(self, path: str):
        import regex

        self.merger, special = load(path)
        self.find = regex.compile(PRE_TOKEN).findall
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.known: dict[str, int] = {}

    def count(self, texts: list[str]) -> list[int]:
        known, find = self.known, self.find
        out, cut = [], []
        for text in texts:
            pieces, extra = [text], 0
            if self.special is not None and (parts := self.special.split(text))[1:]:
                pieces, extra = parts, len(parts) - 1
            cut.append(([find(p) for p in pieces], extra))
        new = set()
        for lists, _ in cut:
            for words in lists:
                new.update(words)
        if len(known) + len(new) > KNOWN:
            known.clear()
        new = [w for w in new if w not in known]
        for i in range(0, len(new), 50_000):
            part = new[i : i + 50_000]
            known.update(zip(part, self.merger.count([w.encode() for w in part]).tolist(), strict=True))
        get = known.__getitem__
        for lists, extra in cut:
            out.append(extra + sum(sum(map(get, words)) for words in lists))
        return out


def batches(texts: list[str], chars: int) -> Iterator[list[str]]:
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= chars:
            yield held
            held, size = [], 0
    if held:
        yield held


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """id_col, n_bytes, n_tokens, over_limit (n_tokens > limit) for every row of docs.

    path is a tokenizer file that every executor can read (installed with the
    workers' Python packages).
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path)
        for part in parts:
            texts = [t or "" for t in part.column(1).to_pylist()]
            counts = [n for b in batches(texts, BATCH_CHARS) for n in counter.count(b)]
            sizes = [len(t.encode("utf-8")) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op3_token_count(spark: SparkSession, sf_dir: str, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(vocabulary))
