"""License scans against brute force."""

import random
import re

import pytest

from bidscout.llm import licenses as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def base(text):
    """(first word, label) of each place where a base phrase's words stand."""
    words = WORD.findall((text or "").translate(LOWER))
    out = []
    for n in L.NOTICES:
        if n.base:
            own = n.words.split()
            out += [(i, n.label) for i in range(len(words) - len(own) + 1) if words[i : i + len(own)] == own]
    return len(words), sorted(out)


def within(pattern, text, k):
    """Whether some substring of text is within k edits of pattern (dynamic programme by columns)."""
    row = list(range(len(pattern) + 1))
    for c in text:
        before, row[0] = row[0], 0
        for i in range(1, len(row)):
            before, row[i] = row[i], min(row[i] + 1, row[i - 1] + 1, before + (pattern[i - 1] != c))
        if row[-1] <= k:
            return True
    return False


def edited(rng, text, k):
    for _ in range(k):
        at = rng.randrange(len(text))
        text = rng.choice((text[:at] + text[at + 1 :], text[:at] + rng.choice("abcxyz") + text[at + 1 :], text[:at] + rng.choice("abcxyz") + text[at:]))
    return text


TEXTS = [
    None, "", "   ", "Licensed under the Apache License, Version 2.0.", "Released under the MIT\nLicense. under THE mit-license", "cc by nc cc by nc CC BY-NC 4.0", "apache license version 21", "xunder the mit licensex",
    "under the mit licence", "under the bit license", "apache license version 3", "GNU General Public Licence, version 3", "GNU Lesser General Public License version 2.1", "under the mit license " * 300, "é under the mit license é", "word " * 20_000 + "cc-by-nc",
]


def test_base_places(spark):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, n_words int, places string").repartition(3)
    found = {r["doc_id"]: r for r in L.scan_licenses(df).collect()}
    assert len(found) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        n, places = base(text)
        assert found[i]["n_words"] == n
        assert sorted((p["first_word"], p["label"]) for p in found[i]["places"] if p["base"]) == places


def test_labels():
    s = L.Scanner(L.NOTICES, L.CHARS_PER_EDIT)
    said = lambda t: [(p[0], p[1], p[2]) for p in s.scan(t.encode())[1]]
    assert said("under the mit licence") == [("mit", False, 1)]
    assert said("GNU General Public Licence, version 3") == [("gpl-3", False, 1)]
    assert said("GNU Lesser General Public License version 2.1") == [("lgpl-2-1", False, 0)]
    for clean in ("under the bit license", "apache license version 3", "apache license version 21", "a license to use", "version 2"):
        assert said(clean) == []


@pytest.mark.parametrize("seed", range(4))
def test_no_notice_is_missed(seed):
    """Seeds and windows find a notice exactly where a dynamic programme over the whole text does."""
    rng = random.Random(seed)
    for notice in L.NOTICES:
        plain = notice._replace(telling="", base=False)
        s, k = L.Scanner((plain,), L.CHARS_PER_EDIT), len(notice.words) // L.CHARS_PER_EDIT
        for extra in (0, k, k + 1, k + 3):
            text = f"some words {edited(rng, notice.words, extra)} and license version others"
            whole = L.plain(text.encode())
            assert bool(s.scan(text.encode())[1]) == within(notice.words, whole, k), (notice, text)


def test_spans():
    s = L.Scanner(L.NOTICES, L.CHARS_PER_EDIT)
    n, places = s.scan(b"one two under the mit lisense three apache license version 2 four")
    assert n == 12 and [(p[0], p[4], p[5]) for p in places] == [("mit", 2, 5), ("apache-2", 7, 10)]


def test_query(spark, sf):
    import duckdb

    rows = dict(duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall())
    found = L.op13_licenses(spark, sf).collect()
    assert sorted(r["doc_id"] for r in found) == sorted(rows)
    for r in found:
        n, places = base(rows[r["doc_id"]])
        labels = sorted({label for _, label in places})
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (n, len(places), ",".join(labels))
        assert (r["first_word"], r["last_word"]) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert set(labels) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_empty(spark, none):
    assert L.scan_licenses(none).collect() == []
