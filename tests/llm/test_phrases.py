"""Phrase mining against brute force."""

import re
from collections import Counter

import pytest

from bidscout.llm import phrases as P

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, longest, least, top, share):
    counts, totals = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for i in range(len(words)):
                for m in range(1, longest + 1):
                    if i + m <= len(words):
                        counts[lang, tuple(words[i : i + m])] += 1
    candidates = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    out = []
    for (lang, words), a in candidates.items():
        best = None
        for k in range(1, len(words)):
            l, r = counts[lang, words[:k]], counts[lang, words[k:]]
            if best is None or 1_000_000 * a * a // (l * r) < best[0]:
                best = (1_000_000 * a * a // (l * r), l, r)
        held = False
        for (other, longer), b in candidates.items():
            if other == lang and len(longer) > len(words) and 100 * b >= share * a:
                held |= any(longer[i : i + len(words)] == words for i in range(len(longer) - len(words) + 1))
        if not held:
            out.append((lang, " ".join(words), a, best[1], best[2], totals[lang], best[0]))
    ranked = []
    for lang in totals:
        own = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        ranked += [(lang, i + 1, *r[1:]) for i, r in enumerate(own[:top])]
    return sorted(ranked)


def mined(df, **kinds):
    return sorted(tuple(r) for r in P.phrases(df, **kinds).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


ROWS = [
    (1, "New York is big. new york, New York\tIS BIG; york new", "en"),
    (2, "in new york is  it\x0bnew york is", "en"),
    (3, None, "en"),
    (4, "", None),
    (5, "a a a a a a", None),
    (6, "a a\x00a é b é b é b", "und"),
    (7, "new york is", "de"),
    (8, "new york is", "de"),
    (8, "new york is", "de"),
]


@pytest.mark.parametrize("vocabulary", [1 << 20, 3, 0])
@pytest.mark.parametrize("longest", [2, 3, 4])
def test_phrases(spark, monkeypatch, vocabulary, longest):
    """The same whatever share of the words is numbered."""
    monkeypatch.setattr(P, "VOCABULARY", vocabulary)
    df = spark.createDataFrame([(*r, 1, "c") for r in ROWS], "doc_id long, text string, lang string, n int, c1 string").repartition(3)
    assert mined(df, longest=longest, least=2) == brute(ROWS, longest, 2, 2000, 50)


def test_corpus(spark, docs, corpus):
    assert mined(docs, least=3, top=40) == brute(corpus, 3, 3, 40, 50)


def test_long_words_and_chunks(spark, monkeypatch):
    """Words longer than numbered ones may be, and texts cut into many chunks."""
    monkeypatch.setattr(P, "CHUNK", 64)
    rows = [(1, "x" * 200 + " ab cd. " + "y" * 90 + " ab cd ef " + "x" * 200 + " ab", "en"), (2, " ".join(["ab cd", "ef gh.", "cd ab"] * 40), "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert mined(df, least=2) == brute(rows, 3, 2, 2000, 50)


def test_empty(spark, none):
    assert mined(none) == []


def test_large_products(spark):
    """Counts whose product passes 64 bits are scored exactly."""
    a = 3_000_000_007
    rows = [("en", "p q", 2, a), ("en", "p", 1, a + 1), ("en", "q", 1, a + 5)]
    (row,) = P.scored(spark.createDataFrame(rows, "lang string, phrase string, words int, n long")).collect()
    assert row["score"] == 1_000_000 * a * a // ((a + 1) * (a + 5))
