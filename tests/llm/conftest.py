import random

import pytest

KINDS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


_r = random.Random(4)
WORDS = ["".join(_r.choice("abcdefghijklmnopqrstuvwxyzäé") for _ in range(_r.randint(2, 9))) for _ in range(400)]
#: Names that clash with columns that operators add.
EXTRA = {"raw": 1, "row": "r", "n": 2, "size": 3, "key": "k", "stats": 4.0, "maybe": True, "times": 5, "score": 0.5, "w": "w", "places": "p"}


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text, lang, source, n_chars) with nulls, empty and long texts, ties, copies, near copies, shared passages and lines."""
    r = random.Random(1)
    base, passage, line = words(r, 300), words(r, 70), "shared boilerplate line of every site"
    texts = [None, "", "   \n\t", "one", "one", "two words", "Two  words", base, base, base.replace(" ", "  ", 3), base + " end", base.replace(WORDS[1], "zzz", 1), "ä" * 400, "a" * 1000, words(r, 30_000), "x\n" * 50]
    texts += [words(r, 150) + " " + passage + " " + words(r, 40) for _ in range(4)]
    texts += [f"{line}\n{words(r, 60)}\n{line}" for _ in range(24)]
    changed = base.split()
    for k in range(12):
        own = list(changed)
        for _ in range(r.randint(1, 12)):
            own[r.randrange(len(own))] = f"q{r.randrange(10**6)}"
        texts.append(" ".join(own))
    texts += [words(r, r.randint(5, 200)) for _ in range(40)]
    rows = [(i, t, "en", f"s{i % 20}", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[7], rows[20]]  # repeated rows
    rows += [(500, words(r, 50), None, None, None), (None, words(r, 20), "de", "s1", 5)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    from pyspark.sql import functions as F

    return spark.createDataFrame(corpus, KINDS).withColumns({k: F.lit(v) for k, v in EXTRA.items()}).repartition(5)


@pytest.fixture(scope="session")
def none(docs):
    return docs.filter("false")
