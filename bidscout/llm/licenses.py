r"""License scans: short notices with a bounded number of edits.

A notice that may have k edits is split into k+1 seeds: k edits can't touch all of
them, so where the notice stands at least one seed stands unchanged. One automaton
of all notices' seeds runs over a text; around each seed that it meets the notice
can only lie in a window of the notice's length and k characters more on both sides.
Windows that meet are joined, and the regex library's fuzzy matching, bounded by k
edits, looks only there; it gives the edits and the span of each place.

Texts are compared as words (A-Z lower-cased, everything that is neither a digit, a
letter a-z nor beyond ASCII parts them) with one space between, so that punctuation
and line ends aren't edits. A place counts only if the notice's telling words (a
version, a name) stand in it unchanged. Where places of several notices meet, those
with more edits go; a place of a base notice without edits always stays.

Documents are scanned where they are: no shuffle; a task holds one text and its
places.

Defined cases: null and empty texts have no words and no places; repeated rows are
scanned each; an empty table gives no rows; further columns are ignored; texts of any
length are scanned whole.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


class Notice(NamedTuple):
    label: str
    words: str
    telling: str = ""  # words that must stand unchanged
    base: bool = False


#: Wordings of public licenses. Base notices are reported apart, where they stand without edits.
NOTICES = (
    Notice("mit", "under the mit license", "mit", True),
    Notice("apache-2", "apache license version 2", "apache 2", True),
    Notice("cc-by-nc", "cc by nc", "cc by nc", True),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    Notice("apache-2", "apache license 2 0", "apache 2 0"),
    Notice("agpl-3", "gnu affero general public license version 3", "affero 3"),
    Notice("bsd", "redistribution and use in source and binary forms with or without modification"),
    Notice("bsd", "under the bsd license", "bsd"),
    Notice("cc-by", "creative commons attribution 4 0 international", "4 0"),
    Notice("cc-by-nc", "creative commons attribution noncommercial", "creative"),
    Notice("cc-by-sa", "creative commons attribution sharealike", "creative"),
    Notice("cc0", "cc0 1 0 universal", "cc0 1 0"),
    Notice("epl-2", "eclipse public license version 2", "eclipse 2"),
    Notice("gpl-2", "gnu general public license version 2", "gnu 2"),
    Notice("gpl-3", "gnu general public license version 3", "gnu 3"),
    Notice("isc", "permission to use copy modify and or distribute this software for any purpose"),
    Notice("lgpl-2-1", "gnu lesser general public license version 2 1", "lesser 2 1"),
    Notice("lgpl-3", "gnu lesser general public license version 3", "lesser 3"),
    Notice("mpl-2", "mozilla public license version 2", "mozilla 2"),
    Notice("reserved", "all rights reserved", "all"),
    Notice("unlicense", "free and unencumbered software released into the public domain"),
)
#: One edit is allowed for so many characters of a notice.
CHARS_PER_EDIT = 10

#: Bytes of words as they are, A-Z as a-z, all others as a space.
PLAIN = bytes(b if b > 127 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))
PLACE = "label string, base boolean, edits int, similarity double, first_word long, last_word long"


def plain(text: bytes) -> str:
    """The words with one space around each; a character for each byte."""
    text = b" " + text.translate(PLAIN) + b" "
    while b"  " in text:
        text = text.replace(b"  ", b" ")
    return text.decode("latin-1")


class Apart:
    """Spans of a text that don't meet."""

    def __init__(self, spans: Iterable[tuple[int, int]]):
        self.starts, self.ends = [], []
        for a, b in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(b, self.ends[-1])
            else:
                self.starts.append(a)
                self.ends.append(b)

    def add(self, a: int, b: int) -> bool:
        """Whether [a, b) meets none of the spans; it is then one of them."""
        i = bisect_left(self.starts, b)
        if i and self.ends[i - 1] > a:
            return False
        self.starts.insert(i, a)
        self.ends.insert(i, b)
        return True


class Scanner:
    def __init__(self, notices: tuple[Notice, ...], chars_per_edit: int):
        import ahocorasick
        import regex

        self.notices = [(n, len(n.words) // chars_per_edit, set(n.telling.split())) for n in notices]
        self.patterns = [regex.compile(f"(?e)(?:{re.escape(n.words)}){{e<={k}}}") for n, k, _ in self.notices]
        self.seeds = ahocorasick.Automaton()
        held: dict[str, list[tuple[int, int]]] = {}
        for number, (notice, k, _) in enumerate(self.notices):
            cuts = [len(notice.words) * i // (k + 1) for i in range(k + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                held.setdefault(notice.words[a:b], []).append((number, a))
        for seed, owners in held.items():
            self.seeds.add_word(seed, (len(seed), owners))
        self.seeds.make_automaton()

    def windows(self, text: str) -> dict[int, list[list[int]]]:
        """By notice: where it can lie, [start, end), in order and apart."""
        found: dict[int, list[list[int]]] = {}
        for end, (size, owners) in self.seeds.iter(text):
            for number, offset in owners:
                notice, k, _ = self.notices[number]
                start = end + 1 - size - offset
                a, b = max(0, start - k - 1), min(len(text), start + len(notice.words) + k + 1)
                own = found.setdefault(number, [])
                own.append([a, b])
        for number, own in found.items():
            own.sort()
            joined = [own[0]]
            for a, b in own[1:]:
                if a <= joined[-1][1]:
                    joined[-1][1] = max(joined[-1][1], b)
                else:
                    joined.append([a, b])
            found[number] = joined
        return found

    def places(self, text: str) -> list[tuple[str, bool, int, float, int, int]]:
        """The places (as PLACE says) in a plain text, in order; starts and ends are those of text."""
        kept, fuzzy = [], []
        for number, windows in self.windows(text).items():
            notice, k, telling = self.notices[number]
            for a, b in windows:
                if notice.base:
                    at = text.find(f" {notice.words} ", a, b)
                    while at >= 0:
                        kept.append((notice.label, True, 0, 1.0, at + 1, at + 1 + len(notice.words)))
                        at = text.find(f" {notice.words} ", at + 1, b)
                for m in self.patterns[number].finditer(text, a, b):
                    edits = sum(m.fuzzy_counts)
                    start, end = self.words_of(text, m.start(), m.end())
                    if start < end and telling <= set(text[start:end].split()):
                        fuzzy.append((1 - edits / len(notice.words), start, end, notice.label, edits))
        taken = Apart((a, b) for *_, a, b in kept)
        for similarity, a, b, label, edits in sorted(fuzzy, key=lambda p: (-p[0], p[1], p[3])):
            if taken.add(a, b):
                kept.append((label, False, edits, similarity, a, b))
        return sorted(kept, key=lambda p: (p[4], p[5], p[0]))

    @staticmethod
    def words_of(text: str, start: int, end: int) -> tuple[int, int]:
        """The span of the words that text[start:end] touches."""
        span = text[start:end]
        start, end = end - len(span.lstrip(" ")), start + len(span.rstrip(" "))
        return (text.rfind(" ", 0, start + 1) + 1, text.find(" ", end)) if start < end else (start, start)

    def scan(self, text: bytes) -> tuple[int, list[tuple]]:
        """The number of words, and the places by words."""
        words = plain(text)
        out, at, seen = [], 0, -1
        for label, base, edits, similarity, a, b in self.places(words):
            seen, at = seen + words.count(" ", at, a), a
            out.append((label, base, edits, similarity, seen, seen + words.count(" ", a, b)))
        return max(0, words.count(" ") - 1), out


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: tuple[Notice, ...] = NOTICES, chars_per_edit: int = CHARS_PER_EDIT) -> DataFrame:
    """id_col, n_words, places array of (label, base, edits, similarity, first_word, last_word), in order, for each row."""
    kind = docs.schema[id_col].dataType.simpleString()
    place = pa.struct([("label", pa.string()), ("base", pa.bool_()), ("edits", pa.int32()), ("similarity", pa.float64()), ("first_word", pa.int64()), ("last_word", pa.int64())])
    fields = place.names

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(notices, chars_per_edit)
        for part in parts:
            counts, found = [], []
            for text in pc.fill_null(part.column(1), "").cast(pa.large_binary()):
                n, places = scanner.scan(text.as_buffer().to_pybytes())
                counts.append(n)
                found.append([dict(zip(fields, p, strict=True)) for p in places])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(found, pa.list_(place))], names=[id_col, "n_words", "places"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_words long, places array<struct<{PLACE.replace(' ', ': ').replace(',:', ',')}>>")


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"))
    base = F.filter("places", lambda p: p["base"])
    starts = F.transform(base, lambda p: p["first_word"])
    named = lambda places: F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        named(base).alias("base_labels"),
        named(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["similarity"])), F.lit(0.0)).alias("score"),
    )
