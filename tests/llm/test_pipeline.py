"""The pipeline's stages, each on what the one before it kept, and the queries' SQL."""

import pytest
from oracle import SF, assert_same, connect
from test_operators import WORD, benchmark_of, brute_hits, brute_lines, brute_links, counted

import corpus_pipeline
from bidscout.llm import line_dedup, near_join, quality
from bidscout.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    assert_same(spark, connect(SF), SF, name, QUERIES[name], ORACLES[name])


def test_names():
    assert [int(n[2:].split("_")[0]) for n in sorted(QUERIES, key=lambda n: int(n[2:].split("_")[0]))] == list(range(1, 14))
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SF)
        docs = docs.cache()
        counts.append(docs.count())
        if name != "mixture":
            assert docs.columns == columns, name
        if name == "line dedup":
            assert counts[-1] == counts[-2]
        if name == "near copies":
            classes = near_join.classes(before)
            assert counts[-1] == classes.select("class_id").distinct().count()
            assert near_join.classes(docs).filter("n_links > 0").isEmpty()
    assert {r.source: round(r.target) for r in docs.select("source", "target").distinct().collect()}
    assert counts[1] < counts[0] and counts[3] < counts[2]
    assert corpus_pipeline.run(spark, SF).count() == counts[-1]


def test_rejected_documents_go(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    kept = {r.doc_id for r in quality.keep_good(docs, labels).collect()}
    scored = {r.doc_id: r.predicted for r in quality.op10_quality(spark, SF).collect()}
    assert kept == {d for d, p in scored.items() if p == 1}


def test_stages_by_brute_force(spark, corpus, docs, tmp_path):
    """Nulls, empty and very long texts, repeated rows, ties and clashing names through the chain."""
    sf = str(tmp_path)
    bench, items = benchmark_of(spark, corpus)
    bench.write.parquet(f"{sf}/benchmark.parquet")
    good = [(c[0], 0 if c[0] in (1, 2) else 1) for c in corpus if c[0] is not None]
    spark.createDataFrame(good, "doc_id long, quality int").write.parquet(f"{sf}/labels.parquet")
    five = lambda df: [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]

    stage = dict(corpus_pipeline.STAGES)
    kept = stage["quality classifier"](spark, docs, sf).cache()
    predicted = quality.scored(docs.drop("score"), quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))).filter("predicted = 1")
    assert counted(five(kept)) == counted(five(predicted)) and kept.columns == docs.columns

    docs = docs.cache()  # the other stages, over all rows
    rows = five(docs)
    lined = stage["line dedup"](spark, docs, sf).cache()
    want = counted(r[:2] for r in brute_lines(rows, line_dedup.MIN_SITES).elements())
    assert counted(r[:2] for r in five(lined)) == want and lined.columns == docs.columns
    assert all(r[4] == len(r[1]) for r in five(lined) if r[1] is not None and r[0] is not None and r[3] is not None)

    rows = five(lined)
    classes, groups = brute_links(rows)
    near = stage["near copies"](spark, lined, sf).cache()
    of = {}
    for doc_id, class_id, _ in classes:
        of[doc_id] = class_id
    assert near.count() == groups and len({of[r[0]] for r in five(near)}) == len(set(of.values())) and near.columns == docs.columns

    rows = five(near)
    bad = {r[0] for r in brute_hits(rows, items) if r[-1]}
    clean = stage["benchmark decontamination"](spark, near, sf).cache()
    assert counted(five(clean)) == counted(r for r in rows if r[0] not in bad) and bad and clean.columns == docs.columns

    mix = stage["mixture"](spark, clean, sf).cache()
    assert set(five(mix)) <= set(five(clean))
    took = mix.collect()
    most = {}  # words of the longest document of each source
    for r in five(clean):
        most[r[3]] = max(most.get(r[3], 0), len(WORD.findall(r[1] or "")))
    for source, longest in most.items():
        own = [x for x in took if x.source == source]
        assert not own or abs(sum(x.mix_times * x.mix_size for x in own) - own[0].target) <= longest
    empty = docs.filter("false")
    for name, f in corpus_pipeline.STAGES:
        empty = f(spark, empty, sf)
        assert empty.count() == 0, name
