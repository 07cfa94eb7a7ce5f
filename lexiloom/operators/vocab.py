"""Vocabularies as tables of token, id and count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.arrays import FIRST_WORD
from .ranking import global_rank
from .terms import KEYS

# Special tokens and their ids.
SPECIALS = [("<PAD>", 0), ("<UNK>", 1), ("<SOS>", 2), ("<EOS>", 3)]


def _place(df: DataFrame, keys: list[str], pos: str) -> Column:
    """A sortable value for the place of a token.

    One or two whole-number keys and the position fit the digits of one decimal, whose
    minimum is found by hashing; the minimum of a struct would sort every row instead.
    A second key or a position of 10**9 or more doesn't fit and is an error.
    """
    types = dict(df.dtypes)
    if len(keys) > 2 or any(types[k] not in ("int", "bigint") for k in keys):
        return F.struct(*keys, pos)
    place = F.col(keys[0]).cast("decimal(19,0)") * F.lit(10**18).cast("decimal(19,0)")
    if len(keys) == 2:  # at most 10**9 rows per first key, 10**9 tokens per row
        place = place + F.col(keys[1]).cast("decimal(9,0)") * F.lit(10**9).cast("decimal(10,0)")
    return (place + F.col(pos).cast("decimal(9,0)")).cast("decimal(38,0)")


def token_counts(line_tokens: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Token, count and first place of appearance."""
    rows = line_tokens.select(*keys, F.posexplode_outer("tokens").alias("pos", "token")).filter("pos is not null")
    return rows.groupBy("token").agg(F.count("*").alias("cnt"), F.min(_place(line_tokens, keys, "pos")).alias("first"))


def top_words(counts: DataFrame, size: int) -> DataFrame:
    """The ``size`` most frequent tokens, ties by first appearance."""
    return counts.orderBy(F.desc("cnt"), "first").limit(size)


def most_common_vocab(counts: DataFrame, size: int, first_id: int = FIRST_WORD) -> DataFrame:
    """Ids for the ``size`` most frequent tokens."""
    order = Window.orderBy(F.desc("cnt"), "first")  # at most ``size`` rows
    return top_words(counts, size).select(
        "token", (F.row_number().over(order) + (first_id - 1)).cast("int").alias("id"), "cnt"
    )


def first_seen_vocab(counts: DataFrame, first_id: int = FIRST_WORD) -> DataFrame:
    """Ids for every token in order of first appearance."""
    ranked = global_rank(counts, ["first"], "_rank")
    return ranked.select("token", (F.col("_rank") + first_id).cast("int").alias("id"), "cnt")


def min_freq_vocab(counts: DataFrame, min_freq: int, first_id: int = FIRST_WORD) -> DataFrame:
    """Ids for the tokens seen at least ``min_freq`` times, most frequent first."""
    kept = counts.filter(F.col("cnt") >= min_freq).withColumn("_neg", -F.col("cnt"))
    ranked = global_rank(kept, ["_neg", "token"], "_rank")
    return ranked.select("token", (F.col("_rank") + first_id).cast("int").alias("id"), "cnt")


def with_specials(vocab: DataFrame) -> DataFrame:
    """The vocabulary preceded by its special tokens."""
    rows = vocab.sparkSession.createDataFrame(
        [(t, i, 0) for t, i in SPECIALS], "token string, id int, cnt bigint"
    )
    return rows.unionByName(vocab.select("token", "id", F.col("cnt").cast("bigint").alias("cnt")))


def char_counts(vocab: DataFrame) -> DataFrame:
    """Character counts over the distinct words of a vocabulary."""
    chars = vocab.select("id", F.posexplode(F.split("token", "")).alias("pos", "ch")).filter(F.length("ch") > 0)
    return chars.groupBy("ch").agg(F.count("*").alias("cnt"), F.min(F.struct("id", "pos")).alias("first"))


def char_vocab(counts: DataFrame, size: int = 2000, first_id: int = FIRST_WORD) -> DataFrame:
    """Ids for the ``size`` most frequent characters."""
    return most_common_vocab(counts.withColumnRenamed("ch", "token"), size, first_id).withColumnRenamed(
        "token", "ch"
    )


def save_vocab(vocab: DataFrame, path: str) -> None:
    vocab.write.mode("overwrite").parquet(path)


def load_vocab(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def label_index(df: DataFrame, label: str, keys: list[str], index: str = "label_id") -> DataFrame:
    """Label table with indices from 0 in order of first appearance."""
    seen = df.groupBy(label).agg(F.min(F.struct(*keys)).alias("first"))
    return global_rank(seen, ["first"], "_rank").select(label, F.col("_rank").cast("int").alias(index))
