"""Each operator against a brute-force version on a small corpus, with its defined cases."""

import collections
import hashlib
import random
import re
import zlib

import pytest
from oracle import SF
from pyspark.sql import functions as F

from bidscout.llm import chat_format, decontaminate, exact_dedup, html_extract, line_dedup, mixture, near_join, quality, repeats, token_count
from bidscout.llm.suffix_array import suffix_array

SPACE = re.compile(r"[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def counted(rows):
    return collections.Counter(tuple(r) for r in rows)


# 1 mixture -----------------------------------------------------------------


def brute_targets(sizes, weights, cap=3.0):
    total, free, out = sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while free:
        rest, w = total - sum(out[i] for i in range(len(sizes)) if i not in free), sum(weights[i] for i in free)
        over = {i for i in free if rest * weights[i] / w > cap * sizes[i]}
        for i in over or free:
            out[i] = cap * sizes[i] if over else rest * weights[i] / w
        free -= over or free
    return out


def test_targets_reshare_what_caps_leave(spark):
    r = random.Random(3)
    for names, sizes in (
        (["a", "b", "c"], [100, 100, 100]),
        (["a", "b", "é"], [10, 500, 490]),
        (["Z", "a", None], [0, 0, 0]),
        (["Z", "a", None], [5, 0, 7]),
        ([*(f"{i:04d}" for i in range(300)), None], [r.choice([0, 1, 10, 1000, 10**6]) for _ in range(301)]),
    ):
        df = spark.createDataFrame(list(zip(names, sizes)), "source string, source_size long").repartition(3)
        got = mixture.targets(df).orderBy("rank").collect()
        assert [x.source for x in got] == names and [x["rank"] for x in got] == list(range(len(names)))
        assert [x.target for x in got] == pytest.approx(brute_targets(sizes, [1 + i % 3 for i in range(len(sizes))]))
    assert mixture.targets(df.filter("false")).count() == 0


def test_a_small_source_lands_beside_a_hot_one(spark, monkeypatch):
    monkeypatch.setattr(mixture, "BLOCK", 20)
    r = random.Random(2)
    rows = [(i, "hot", r.randint(1, 50)) for i in range(900)] + [(1000 + i, "small", 300 if i == 3 else r.randint(1, 40)) for i in range(14)]
    got = mixture.mix(spark.createDataFrame(rows, "doc_id long, source string, size long"), (3, 2)).collect()
    assert len(got) == len(rows)
    for source in ("hot", "small"):
        own = [x for x in got if x.source == source]
        assert abs(sum(x.times * x.size for x in own) - own[0].target) <= 5


def test_repeated_rows_take_what_they_are_dealt(spark):
    rows = [(1, "the same four words", "a", i % 7) for i in range(500)] + [(2 + i, "w " * (i % 9 + 1), "b", 0) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, more long").repartition(6)
    got = mixture.mixed(docs).collect()
    own = [x for x in got if x.doc_id == 1]
    assert abs(sum(x.times * x.size for x in own) - own[0].target) <= 4 and len(own) <= 500
    assert counted(got) == counted(mixture.mixed(docs).collect())


def test_very_many_repeated_rows_are_one_row_of_a_block(spark, monkeypatch):
    monkeypatch.setattr(mixture, "SLICE", 1000)
    flown = []
    grouped = mixture.cut
    monkeypatch.setattr(mixture, "cut", lambda df, name="stage": flown.append((name, grouped(df, name))) or flown[-1][1])
    copies, others = 200_001, [(10 + i, "hot", i % 30 + 1) for i in range(5_000)] + [(9_000 + i, "b", 40) for i in range(300)]
    same = spark.range(copies).select(F.lit(None).cast("long").alias("doc_id"), F.lit("hot").alias("source"), F.lit(7).cast("long").alias("size"))
    docs = same.unionByName(spark.createDataFrame(others, "doc_id long, source string, size long"))
    got = mixture.mix(docs, (1, 2)).groupBy("source", "doc_id", "size", "target", "times").count().collect()
    for name, df in flown:
        if name in ("flight", "landing") and df.count():
            assert df.groupBy("source", "block").count().agg(F.max("count")).first()[0] < 2 * mixture.BLOCK
    for source in ("hot", "b"):
        own = [x for x in got if x.source == source]
        assert abs(sum(x.times * x.size * x["count"] for x in own) - own[0].target) <= 40
    hot = [x for x in got if x.doc_id is None]
    size = sum(s for _, f, s in others if f == "hot") + 7 * copies
    assert sum(x["count"] for x in hot) == copies and {x.times for x in hot} <= {0, 1}
    assert abs(sum(x.times * x["count"] for x in hot) - copies * hot[0].target / size) <= 1


def test_flight_keeps_both_totals():
    import numpy as np

    r = np.random.default_rng(0)
    size, prob = r.integers(0, 1000, 500).astype(float), r.random(500)
    out = mixture.flight(size, prob, np.random.default_rng(1))
    assert ((out > 0) & (out < 1)).sum() <= 3
    assert out.sum() == pytest.approx(prob.sum()) and (out * size).sum() == pytest.approx((prob * size).sum())


@pytest.mark.parametrize("block", [7, 2_000])
def test_mix(spark, corpus, docs, none, block, monkeypatch):
    monkeypatch.setattr(mixture, "BLOCK", block)
    sized = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).alias("size"))
    rows = mixture.mix(sized).collect()
    assert counted(r[:1] for r in rows) == counted((c[0],) for c in corpus)
    by = collections.defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    for own in by.values():
        taken = sum(r.times * r.size for r in own)
        assert all(0 <= r.times <= 3 for r in own)
        assert abs(taken - own[0].target) <= 0.5 * max(r.size for r in own)
    assert counted(rows) == counted(mixture.mix(sized.repartition(2)).collect())
    assert mixture.mix(none.select("doc_id", "source", F.lit(1).alias("size"))).count() == 0


def test_mixed_keeps_columns(docs):
    got = mixture.mixed(docs)
    assert got.columns[: len(docs.columns)] == docs.columns and "mix_times" in got.columns
    assert got.filter("mix_times < 1").count() == 0 and got.count() > 0


# 2 exact dedup --------------------------------------------------------------


def brute_groups(corpus):
    groups = collections.defaultdict(list)
    for i, t, *_ in corpus:
        groups[SPACE.sub("", t or "")].append((-len(t or ""), i is None, i))
    out = []
    for plain, members in groups.items():
        keep = min(members, key=lambda m: (m[0], m[1], m[2] or 0))[2]
        digest = hashlib.sha256(plain.encode()).hexdigest()
        out += [(m[2], keep, len(members), digest) for m in members]
    return counted(out), len(groups)


@pytest.mark.parametrize("digest", [exact_dedup.strong, lambda chunk: chunk[:1]])
def test_exact_groups(corpus, docs, none, digest):
    rows = exact_dedup.exact_groups(docs, digest).collect()
    want, groups = brute_groups(corpus)
    assert counted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows) == want
    assert sum(r.kept for r in rows) == groups
    assert exact_dedup.exact_groups(none).count() == 0


def test_chunks_are_whole_and_bounded():
    r = random.Random(2)
    texts = [bytes(r.randrange(256) for _ in range(n)) for n in (0, 1, 300, 50_000)] + [b"a" * 100_000]
    for i, chunks in exact_dedup.chunked(texts):
        assert b"".join(chunks) == texts[i] and all(len(c) <= exact_dedup.MOST for c in chunks)


# 3 tokens -------------------------------------------------------------------


def test_tokens_as_the_library_counts_them(spark, corpus, docs, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    r = random.Random(5)
    odd = ["<|endoftext|>", "a<|endoftext|>b", "'s 's'S", "　 \n\n x", "aaaaaaaaa", "\x00\x01", "".join(chr(r.randrange(32, 0x2FFF)) for _ in range(500)), "🙂" * 20]
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    lib = Tokenizer.from_file(path)
    texts = [c[1] or "" for c in corpus] + odd
    want = counted(zip([c[0] for c in corpus] + [1000 + i for i in range(len(odd))], [len(t.encode()) for t in texts], [len(e.ids) for e in lib.encode_batch(texts, add_special_tokens=False)]))
    got = token_count.count_tokens(more, path).collect()
    assert counted((x.doc_id, x.n_bytes, x.n_tokens) for x in got) == want
    assert all(x.over_limit == (x.n_tokens > 512) for x in got)
    assert token_count.count_tokens(none, path).count() == 0


# 4 pages --------------------------------------------------------------------

PAGE = """<!doctype html><html><head><title>T</title><style>p {{}}</style></head><body><header>Top</header><nav><ul><li>Home</ul></nav>
<div class="promo-box">Buy</div>{wrap}<h1>Title {i}</h1><p>First &amp; <b>bo</b>ld{i}<br>line<p>Second&nbsp;one<div class="comments"><p>Nice</p></div><form>Send</form><script>x("</p>")</script>{end}
<aside>Side</aside><footer>&copy; me</footer></body></html>"""


def pages_of(spark):
    rows = [(i, f"https://h{i % 2}.example/{i}", PAGE.format(wrap="<article>" if i % 2 else "<div id=main>", end="</article>" if i % 2 else "<div>All rights are kept</div></div>", i=f"{i} {random.Random(i).random()}")) for i in range(20)]
    rows += [(50, None, None), (51, "", ""), (52, "x", "<p>open <i>markup"), (53, "x", "just text &lt;3"), rows[0]]
    return spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, host int")


def test_pages(spark):
    got = collections.defaultdict(set)
    for r in html_extract.extract(pages_of(spark)).collect():
        got[r.page_id].add(r.text)
    for i in range(20):
        n = f"{i} {random.Random(i).random()}"
        assert got[i] == {f"Title {n} First & bold{n} line Second one"}, i
    assert (got[50], got[51], got[52], got[53]) == ({""}, {""}, {"open markup"}, {"just text <3"})
    assert html_extract.extract(pages_of(spark).filter("false")).count() == 0


@pytest.mark.parametrize(
    "html,text",
    [
        ('<div class="post hentry tag-spark"><p>Main text.</p></div>', "Main text."),
        ('<div class="more-info"><p>The story.</p></div><p>End</p>', "The story. End"),
        ('<div class="form-group legal"><p>A law.</p></div>', "A law."),
        ('<p title="a>Hello</p><p>x</p>', "Hello x"),
        ("<p title='a>Hello</p><p>x</p>", "Hello x"),
        ('<div class="a>b"><p>in</p></div>out', "in out"),
        ('<div class="site-footer">no</div><div id="comments-list">no</div><div class="share-price">yes</div>', "yes"),
        ('<section class="user-comments"><p>reader</p></section><p>t</p>', "t"),
        ('<p>t</p><div id="disqus_thread">no</div><ul class="reader_comments">no</ul><div class="related-posts">no</div>', "t"),
        ('<div class="public-posts"><p>yes</p></div><div class="comments-open"><p>yes</p></div>', "yes yes"),
        ("<div>" * 20_000 + "deep" + "</div>" * 20_000, "deep"),
        ("<p>" + "word " * 300_000, "word " * 299_999 + "word"),
        ('<a "' * 2_000 + ">t", "t"),
        ("<b>" * 5 + "x</i></b></div>y", "xy"),
    ],
)
def test_main_text_of(html, text):
    assert html_extract.main_text(html) == text


def test_importance_by_brute_force(spark):
    import math

    r = random.Random(6)
    rows = []
    for i in range(60):
        menu = "<div class=x><ul>" + "".join(f"<li>Menu {k}</li>" for k in range(r.choice([3, 3, 4]))) + "</ul></div>"
        box = f"<div class=y>{r.choice(['Buy now', 'Buy now', 'Try it'])}</div>" if r.random() < 0.8 else ""
        rows.append((i, f"http://h{i % 3}.example/", f"{menu}<div id=m><h1>T{i}</h1><p>{r.random()}</p></div>{box}<div class=z>Always the same</div>"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    seen = collections.defaultdict(lambda: ([], []))
    for i, _, page in rows:
        for place, (above, shown, own) in html_extract.places(page).items():
            seen[f"h{i % 3}.example", place][0].append(shown)
            if own:
                seen[f"h{i % 3}.example", place][1].append(own)

    def entropy(found):
        n = len(found)
        return 1.0 if n == 1 else sum(-c / n * math.log(c / n) for c in collections.Counter(found).values()) / math.log(n) if n else 0.0

    want = {k: (len(shown), max(entropy(shown), entropy(own))) for k, (shown, own) in seen.items()}
    placed = html_extract.page_places(df)
    got = {(x.host, x.place): (x.pages, x.importance) for x in html_extract.style_trees(placed).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    above = {(f"h{i % 3}.example", p): a for i, _, page in rows for p, (a, *_) in html_extract.places(page).items()}
    good = {k for k, (n, x) in want.items() if x >= html_extract.LEAST_IMPORTANCE or n < html_extract.LEAST_PAGES}
    for k in list(good):
        while above.get(k):
            k = (k[0], above[k])
            good.add(k)
    low = {(x.host, x.place) for x in html_extract.noise(placed).collect()}
    assert low == set(want) - good and low
    texts = {x.text for x in html_extract.extract(df).collect()}
    # what all pages have goes by the tree alone: no name says that it is noise
    assert not any("Always the same" in t for t in texts) and all("T" in t for t in texts)


def test_a_site_of_equal_articles_keeps_them(spark):
    page = "<nav>menu</nav><article><p>The same.</p></article>"
    df = spark.createDataFrame([(i, "http://a.example/", f"<i>{i}</i>" + page) for i in range(9)], "page_id long, url string, html string")
    assert {r.text for r in html_extract.extract(df).collect()} == {"The same."}


# 5 chats --------------------------------------------------------------------


def test_chats_round_trip(spark):
    r = random.Random(3)
    parts = ["<|im_end|>", "<|im_start|>", "<|", "\\", "\\|", "\n", "|>", "assistant", " ", "ä", "🙂", ""]
    chats = {c: [(t, r.choice(["system", "user", "assistant", "tool\n", None]), r.choice([None, "".join(r.choice(parts) for _ in range(r.randint(0, 12)))])) for t in range(r.randint(1, 6))] for c in range(60)}
    chats[60] = [(0, "user", "a"), (1, "assistant", "b")]
    chats[61] = [(0, "system", "a"), (1, "user", "b"), (2, "assistant", "c"), (3, "user", "d")]
    chats[62] = [(0, "assistant", "a")]
    df = spark.createDataFrame([(c, *t, "x") for c, ts in chats.items() for t in ts], "conv_id long, turn long, role string, text string, formatted string")
    out = chat_format.format_chats(df)
    got = out.select("conv_id", "valid", "formatted", chat_format.read_turns(F.col("formatted")).alias("ts"), chat_format.read_learnt(F.col("formatted"), F.col("loss_spans")).alias("learnt"), "segments").collect()
    for x in got:
        want = [(role or "", text or "") for _, role, text in chats[x.conv_id]]
        assert [tuple(t) for t in x.ts] == want
        assert list(x.learnt) == [t for role, t in want if role == "assistant"]
        assert "".join(s.text for s in x.segments) == x.formatted
    valid = {x.conv_id: x.valid for x in got}
    assert valid[60] and valid[61] and not valid[62]
    assert chat_format.format_chats(df.filter("false")).count() == 0


def test_chats_with_nulls_ties_and_clashing_names(spark):
    rows = [(None, 1, "assistant", "b"), (None, 0, "user", "a"), (1, None, "user", "first"), (1, 0, "assistant", "second"), (2, 5, "user", "b"), (2, 5, "user", "a"), (2, 5, "assistant", "z"), (3, 0, "user", "x"), (3, 0, "user", "x"), (4, 0, None, None)]
    kind = "conv_id long, turn long, role string, text string, segments int, valid string, ts int, formatted int, loss_spans string"
    df = spark.createDataFrame([(*r, 1, "v", 2, 3, "s") for r in rows], kind)
    got = {x.conv_id: [tuple(t) for t in x.t] for x in chat_format.format_chats(df).select("conv_id", chat_format.read_turns(F.col("formatted")).alias("t")).collect()}
    assert got == {
        None: [("user", "a"), ("assistant", "b")],
        1: [("user", "first"), ("assistant", "second")],  # a null turn is first
        2: [("assistant", "z"), ("user", "a"), ("user", "b")],  # equal turns by role, then text
        3: [("user", "x"), ("user", "x")],
        4: [("", "")],
    }


# 6 near copies --------------------------------------------------------------


def brute_links(corpus):
    sets = [set(near_join.grams(c[1]).tolist()) for c in corpus]
    links, root = [0] * len(corpus), list(range(len(corpus)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(corpus)):
        for j in range(i):
            if sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, c in enumerate(corpus):
        least[find(i)] = min(least.get(find(i), (True, 0)), (c[0] is None, c[0] or 0))
    return counted((c[0], None if least[find(i)][0] else least[find(i)][1], links[i]) for i, c in enumerate(corpus)), len(least)


@pytest.mark.parametrize("block", [3, 512])
def test_near_copies(corpus, docs, none, block, monkeypatch):
    monkeypatch.setattr(near_join, "BLOCK", block)
    want, groups = brute_links(corpus)
    got = near_join.classes(docs).collect()
    assert counted((r.doc_id, r.class_id, r.n_links) for r in got) == want
    assert sum(r.first for r in got) == groups
    kept = near_join.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == groups
    assert near_join.classes(none).count() == 0 and near_join.keep_one(none).count() == 0


def test_components_of_a_long_chain(spark):
    ids = list(range(40))
    random.Random(1).shuffle(ids)
    edges = spark.createDataFrame([(a, b) for a, b in zip(ids, ids[1:])] + [(100, 101)], "a long, b long")
    assert counted(near_join.components(edges).collect()) == counted([(i, 0) for i in ids] + [(100, 100), (101, 100)])


# 7 repeats ------------------------------------------------------------------


def test_suffix_arrays():
    r = random.Random(7)
    for _ in range(400):
        text = [r.randint(1, r.choice([1, 2, 4])) for _ in range(r.randint(0, 60))] + [0]
        assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def test_repeated_strings():
    import numpy as np

    r = random.Random(9)
    for _ in range(300):
        wide, groups = r.choice([1, 2, 5, 25]), []
        for _ in range(r.randint(1, 4)):
            group = {}
            for _ in range(r.randint(1, 7)):
                b, a = (bytes(r.choice(b"ab") for _ in range(r.randint(0, wide - 1))) for _ in range(2))
                if len(b) + len(a) + 1 >= wide:
                    group[b, a] = r.randint(1, 3)
            if group:
                groups.append(group)
        if not groups:
            continue
        rows = [(g, b, a, n) for g, group in enumerate(groups) for (b, a), n in group.items()]
        whole = lambda b, a, k: (b + b"c" + a)[k : k + wide]
        places = lambda b, a: range(len(b) + len(a) + 2 - wide)
        seen = collections.Counter((g, k - len(b), whole(b, a, k)) for g, b, a, n in rows for k in places(b, a) for _ in range(n))
        want = {(i, k) for i, (g, b, a, n) in enumerate(rows) for k in places(b, a) if seen[g, k - len(b), whole(b, a, k)] > 1}
        starts = np.cumsum([0, *map(len, groups)])[:-1]
        found = repeats.repeated_in([x[1] for x in rows], [x[2] for x in rows], np.array([x[3] for x in rows]), np.full(len(rows), wide), starts)
        assert {(int(i), k) for i, x, y in zip(*found) for k in range(x, y + 1)} == want


def test_nothing_is_repeated_without_the_array(docs):
    assert repeats.remove_repeats(docs, order=lambda text: []).filter("n_removed > 0").isEmpty()


@pytest.mark.parametrize("group,slice_", [(1, 1_000), (2_000, 400_000)])
def test_repeats(corpus, docs, none, group, slice_, monkeypatch):
    monkeypatch.setattr(repeats, "GROUP", group)
    monkeypatch.setattr(repeats, "SLICE", slice_)
    texts = [(c[0], (c[1] or "").encode()) for c in corpus]
    seen = collections.Counter(t[k : k + 200] for _, t in texts for k in range(len(t) - 199))
    want = []
    for i, t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - 199):
            if seen[t[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        kept = bytes(b for b, g in zip(t, gone) if not g)
        want.append((i, len(t), sum(gone), len([1 for m in re.finditer(rb"\x01+", bytes(gone))]), kept))
    got = repeats.remove_repeats(docs).collect()
    assert counted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == counted(want)
    assert repeats.remove_repeats(none).count() == 0


# 8 benchmark ----------------------------------------------------------------


def bench_words(text):
    return BENCH_WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def benchmark_of(spark, corpus):
    w = (corpus[20][1] or "").split()
    items = [(1, " ".join(w[10:40]).upper().replace("Ä", "ä").replace("É", "é")), (2, "two, WORDS!"), (3, None), (4, ""), (None, "never anywhere at all"), (2, "two words"), (5, " ".join(w[60:73]))]
    return spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, key int"), items


def brute_hits(corpus, items):
    out = []
    for i, t, *_ in corpus:
        words, hit, found = bench_words(t), set(), set()
        for item, text in items:
            own = bench_words(text)
            n = min(13, len(own))
            for k in range(len(own) - n + 1) if n else ():
                for at in range(len(words) - n + 1):
                    if words[at : at + n] == own[k : k + n]:
                        hit.update(range(at, at + n))
                        found.add("" if item is None else str(item))
        out.append((i, len(words), len(hit), len(found), ",".join(sorted(found)), bool(hit) and 20 * len(hit) >= len(words)))
    return counted(out)


def test_contamination(spark, corpus, docs, none, monkeypatch):
    bench, items = benchmark_of(spark, corpus)
    got = decontaminate.contamination(docs, bench).collect()
    want = brute_hits(corpus, items)
    assert counted((r.doc_id, r.n_words, r.n_hit, r.n_items, ",".join(r["items"]), r.contaminated) for r in got) == want
    bad = sum(n for k, n in want.items() if k[-1])
    clean = decontaminate.decontaminate(docs, bench)
    assert clean.columns == docs.columns and clean.count() == len(corpus) - bad and bad >= 3
    spans = decontaminate.decontaminate(docs, bench, spans=True)
    assert spans.count() == len(corpus)
    assert decontaminate.contamination(spans, bench).filter("contaminated").count() == 0
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    assert counted((r.doc_id, r.n_words, r.n_hit, r.n_items, ",".join(r["items"]), r.contaminated) for r in decontaminate.contamination(docs, bench).collect()) == want
    assert decontaminate.contamination(none, bench).count() == 0
    assert decontaminate.contamination(docs, bench.filter("false")).filter("n_hit > 0").count() == 0


def without_spans(text, item, n=13):
    """text without the words that item's windows hit, and without what stands between two of these."""
    words = [(m[0], *m.span()) for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
    low, own = [bench_words(w)[0] for w, *_ in words], bench_words(item)
    windows = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)}
    hit = {k + i for k in range(len(low) - n + 1) if tuple(low[k : k + n]) in windows for i in range(n)}
    out, at = "", 0
    for k, (_, a, b) in enumerate(words):
        if k in hit:
            out += "" if k - 1 in hit else text[at:a]
            at = b
        else:
            out, at = out + text[at:b], b
    return out + text[at:]


def test_spans_of_long_texts(spark, corpus):
    r = random.Random(8)
    item = " ".join(f"W{i}" for i in range(40))
    long = " ".join(r.choice([item, "\"Quote, (of) it!", " ".join(item.split()[7:30]), "É end. "]) for _ in range(20_000))
    texts = [long, f"({item})", f"a {item} b {item} c", "nothing of it", None, item.lower() + "!"]
    df = spark.createDataFrame([(i, t, len(t or ""), 1) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long, covered int")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: (r.text, r.n_chars) for r in decontaminate.decontaminate(df, bench, spans=True).collect()}
    want = {i: t and without_spans(t, item) for i, t in enumerate(texts)}
    assert got == {i: (t, len(t or "")) for i, t in want.items()}


# 9 lines --------------------------------------------------------------------


def brute_lines(corpus, least):
    sites, first = collections.defaultdict(set), {}
    for i, t, _, source, _ in corpus:
        for k, line in enumerate(t.split("\n") if t is not None else ()):
            if line := line.strip(" \t\n\x0b\x0c\r"):
                sites[line].add(source)
                first[line] = min(first.get(line, (True, 0, 0)), (i is None, i or 0, k))
    out = []
    for i, t, *_ in corpus:
        if t is None:
            out.append((i, None, 0))
            continue
        lines = t.split("\n")
        kept = [x for k, x in enumerate(lines) if len(sites[(s := x.strip(" \t\n\x0b\x0c\r"))]) < least or not s or first[s] == (i is None, i or 0, k)]
        out.append((i, "\n".join(kept), len(lines) - len(kept)))
    return counted(out)


@pytest.mark.parametrize("least", [2, 16])
def test_lines(corpus, docs, none, least):
    got = line_dedup.dedup_lines(docs, least)
    assert counted((r.doc_id, r.text, r.removed_lines) for r in got.collect()) == brute_lines(corpus, least)
    assert got.columns == [*docs.columns, "removed_lines"] and line_dedup.dedup_lines(none).count() == 0
    assert got.filter("removed_lines > 0 AND n_chars != char_length(text)").count() == 0


def test_boilerplate_of_some_sites(spark):
    passage, few, *own = (" ".join(f"{k}x{i}" for i in range(60)) for k in range(26))
    rows = [(i, f"{own[i]}\n{passage}" if i < 11 else f"{few}\n{own[i]}" if i < 15 else own[i], f"s{i % 20}") for i in range(24)]
    got = {r.doc_id: (r.text, r.removed_lines) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got == {i: (own[i], 1) if 0 < i < 11 else (t, 0) for i, t, _ in rows}


# 10 quality -----------------------------------------------------------------


def test_quality(spark):
    rows = quality.op10_quality(spark, SF.replace("sf0.001", "sf0.01")).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(SF.replace("sf0.001", "sf0.01") + "/labels.parquet").collect()}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    out = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    good, bad = [s for s, q in out if q == 1], [s for s, q in out if q == 0]
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.9 and sum((s >= 0.7) == (q == 1) for s, q in out) / len(out) > 0.9


def test_statistics_of_texts(corpus, monkeypatch):
    import pyarrow as pa

    texts = [c[1] for c in corpus] + ["É|é!! #1, ok. a a b a a b\n\tÀ" * 3, "x" * 5000, " " * 3000, "same " * 5000, "äÀ€ " * 400 + "ä" * 301]
    whole = None
    for part in (1 << 18, 64, 101):
        monkeypatch.setattr(quality, "PART", part)
        got = quality.counted(pa.array(texts))
        whole = whole or got
        assert all((got[k] == whole[k]).all() for k in quality.STATISTICS), part
        for i, t in enumerate(t or "" for t in texts):
            words = WORD.findall(t)
            n, w = max(len(t), 1), max(len(words), 1)
            want = {"chars": len(t), "words": len(words), "word_length": len(t) / w if words else 0, "longest": max((len(x.encode()) for x in words), default=0), "bars": t.count("|") / w, "shouts": t.count("!") / w}
            want |= {"digits": sum(c in "0123456789" for c in t) / n, "capitals": sum("A" <= c <= "Z" or "À" <= c <= "Þ" and c != "×" for c in t) / n, "lines": t.count("\n") / w if words else 0}
            want |= {"distinct": len(set(words)) / w, "foreign": sum(ord(c) > 127 for c in t) / n}
            want |= {"repeated": sum(a == b for a, b in zip(words, words[1:])) / w, "pairs": len(set(zip(words, words[1:]))) / w}
            assert {k: float(got[k][i]) for k in want} == pytest.approx(want), (i, part)


def test_quality_cases(spark, docs, none):
    label = lambda q: docs.filter("doc_id IS NOT NULL").select("doc_id", F.lit(q).alias("quality")).distinct()
    for q, want in ((1, 1), (0, 0), (None, 0)):
        got = quality.scored(docs.drop("score"), quality.train(docs, label(q)))
        assert {r.predicted for r in got.collect()} == {want} and got.count() == docs.count()
    twice = label(1).unionByName(label(1)).unionByName(label(0).filter("doc_id < 20"))  # repeated labels
    assert quality.scored(docs.drop("score"), quality.train(docs, twice)).count() == docs.count()
    kept = quality.keep_good(docs, label(1))
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert quality.scored(none.drop("score"), quality.RuleModel(0.0)).count() == 0


def test_compiled_rules_are_the_model(spark, docs):
    model = quality.RuleModel(0.5, [(2.0, (("words", True, 3.0),)), (-1.0, (("chars", False, 100.0), ("words", True, 1.0)))])
    import math

    for r in quality.with_statistics(docs.select("doc_id", "text")).select("stats", model.score().alias("s")).collect():
        z = 0.5 + (2.0 if r.stats.words > 3 else 0) - (1.0 if r.stats.chars <= 100 and r.stats.words > 1 else 0)
        assert r.s == pytest.approx(1 / (1 + math.exp(-z)))
