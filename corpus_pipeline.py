"""A corpus pipeline: quality, line dedup, near copies, benchmark, mixture.

Each stage is one operator of bidscout.llm on all its predecessor kept. A stage
takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each as
Parquet to the shared folder and reads it again as the next one's docs. All but
the last return the columns of documents; the last adds times (how often the mix
takes a row), size, source_size and target; names that clash are prefixed mix_.

Defined cases: null and empty texts are documents without words, which the
classifier judges, which are nobody's copies and aren't contaminated; null doc_ids
and sources are kept; repeated rows are copies of each other, of which one stays;
labels and benchmark items of no document change nothing; an empty table gives an
empty table; further columns are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bidscout.llm.common import cut, table
from bidscout.llm.decontaminate import decontaminate
from bidscout.llm.line_dedup import dedup_lines
from bidscout.llm.mixture import mixed
from bidscout.llm.near_join import keep_one
from bidscout.llm.quality import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup_lines(docs).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed(docs)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("near copies", near_copies),
    ("benchmark decontamination", benchmark),
    ("mixture", mixture),
]

#: SQL can't express the classifier, the banding and the balanced sample.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
