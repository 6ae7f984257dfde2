"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters of [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"
#: A run of other characters is a word.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one in the warehouse where that isn't set (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    return at or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_stages"


def cut(df: DataFrame, name: str = "stage") -> DataFrame:
    """df, written to the shared folder as Parquet and read back.

    What follows survives lost executors without recomputing what came before,
    and takes less disk than RDD checkpoints, which aren't columnar.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores added until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def words_of(text: Column) -> Column:
    """The number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sha256_hex(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


#: Words of 64 bits in a sieve: its broadcast has that many rows of two numbers at most.
SIEVE_WORDS = 1 << 20


def sieve(keys: DataFrame, h: Column) -> DataFrame:
    """word, bits: a bit set of bounded size for the hashes h (long) of keys.

    It lets through whatever is in keys, and little else while keys are fewer
    than its bits; beyond that it lets through more, and what follows it has
    more to do, but nothing is lost. Spark's own runtime filter drops rows below a
    join; here rows that don't pass must be kept, and not be shuffled.
    """
    word, bit = _place(h)
    bits = keys.select(word.alias("word"), bit.alias("bit"))
    return bits.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))


def _place(h: Column) -> tuple[Column, Column]:
    mixed = F.xxhash64(h)
    return F.pmod(mixed, F.lit(SIEVE_WORDS)), F.shiftrightunsigned(mixed, 58).cast("int")


def sifted(df: DataFrame, h: Column, bits: DataFrame, name: str) -> DataFrame:
    """df with the boolean column name: whether the sieve lets the row through. No shuffle of df."""
    word, bit = _place(h)
    own = bits.select(F.col("word").alias(f"{name}_word"), F.col("bits").alias(f"{name}_bits"))
    met = df.join(F.broadcast(own), word == F.col(f"{name}_word"), "left")
    passes = F.coalesce(F.getbit(F.col(f"{name}_bits"), bit) == 1, F.lit(False))
    return met.withColumn(name, passes).drop(f"{name}_word", f"{name}_bits")


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, not copied, and where each text begins (one more: the end). Null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8), ends
