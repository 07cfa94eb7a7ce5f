"""Token counts as an exact length histogram.

Every whole text is encoded once. Documents are then counted by encoded length, which
map-side aggregation reduces to one row per length and task, and sums from the long end
answer totals, quantiles and truncated totals for every context limit.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import materialize

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
BLOCK = 1024
# Fixed value: the split pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_ENCODINGS: dict[bytes, tiktoken.Encoding] = {}  # by digest of the ranks file


def encoding(content: bytes) -> tiktoken.Encoding:
    """The encoding of a ranks file; kept for the next task of the same worker."""
    key = hashlib.blake2b(content).digest()
    if key not in _ENCODINGS:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines())}
        _ENCODINGS[key] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[key]


def _length_batches(content):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoding(content.value)
        for batch in batches:
            # One text at a time: a list of encodings of a batch of long texts is not bounded.
            n = [len(coder.encode_ordinary(x.as_py() or "")) for x in batch.column("text")]
            lengths, docs = np.unique(np.array(n, np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(lengths), pa.array(docs)], names=["tokens", "docs"])

    return run


def length_histogram(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(tokens, docs): how many rows of ``docs`` (text) encode to each length.

    The vocabulary file is read by Spark and has a fixed size. Null counts as empty.
    """
    spark = docs.sparkSession
    content = spark.read.format("binaryFile").load(vocabulary).select("content").first()[0]
    shared = spark.sparkContext.broadcast(bytes(content))
    counted = docs.select("text").mapInArrow(_length_batches(shared), "tokens long, docs long")
    return counted.groupBy("tokens").agg(F.sum("docs").alias("docs"))


def context_totals(histogram: DataFrame, block: int = BLOCK) -> DataFrame:
    """The histogram with its sums from the long end, one row per length.

    For a context limit equal to the row's ``tokens``: ``docs_from`` and ``tokens_from``
    are the documents of at least this length and their tokens, ``docs_upto`` those of
    at most this length, ``truncated_total`` the tokens left when every document is cut
    to the limit, ``share_upto`` the quantile that the length is. An empty histogram
    gives no rows. Sums run inside blocks of lengths and over the block totals, so no
    task sees more than a block or the list of blocks.
    """
    histogram = materialize(histogram.withColumn("block", F.floor(F.col("tokens") / block)), "histogram")
    weight = F.sum(F.col("tokens") * F.col("docs"))
    blocks = histogram.groupBy("block").agg(F.sum("docs").alias("d"), weight.alias("t"))
    longer = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("d").over(longer), F.lit(0)).alias("docs_beyond"),
        F.coalesce(F.sum("t").over(longer), F.lit(0)).alias("tokens_beyond"),
        F.sum("d").over(Window.partitionBy()).alias("docs_all"),
    )
    inside = Window.partitionBy("block").orderBy(F.desc("tokens"))
    docs_from = F.sum("docs").over(inside) + F.col("docs_beyond")
    tokens_from = F.sum(F.col("tokens") * F.col("docs")).over(inside) + F.col("tokens_beyond")
    rows = histogram.join(blocks, "block").select(
        "tokens", "docs", docs_from.alias("docs_from"), tokens_from.alias("tokens_from"), "docs_all"
    )
    tokens_all = rows.crossJoin(F.broadcast(histogram.agg(weight.alias("tokens_all"))))  # one row
    upto = F.col("docs_all") - F.col("docs_from") + F.col("docs")
    return tokens_all.select(
        "tokens",
        "docs",
        "docs_from",
        "tokens_from",
        upto.alias("docs_upto"),
        (F.col("tokens_all") - F.col("tokens_from") + F.col("tokens") * F.col("docs_from")).alias("truncated_total"),
        (upto / F.col("docs_all")).alias("share_upto"),
    )


def at_limits(totals: DataFrame, limits: list[int]) -> DataFrame:
    """(limit, docs_cut, truncated_total) for any list of limits, from ``context_totals``."""
    spark: SparkSession = totals.sparkSession
    asked = spark.createDataFrame([(int(x),) for x in limits], "limit long")
    rows = totals.select("tokens", "docs").crossJoin(F.broadcast(asked))  # a stated list of limits
    return rows.groupBy("limit").agg(
        F.sum(F.when(F.col("tokens") > F.col("limit"), F.col("docs")).otherwise(0)).alias("docs_cut"),
        F.sum(F.least("tokens", "limit") * F.col("docs")).alias("truncated_total"),
    )


def quantiles(totals: DataFrame, shares: list[float]) -> DataFrame:
    """(share, tokens): the smallest length that covers each share of the documents."""
    found = totals.select(
        *[F.min(F.when(F.col("share_upto") >= p, F.col("tokens"))).alias(str(i)) for i, p in enumerate(shares)]
    )
    pairs = F.array(*[F.struct(F.lit(p).alias("share"), F.col(str(i)).alias("tokens")) for i, p in enumerate(shares)])
    return found.select(F.inline(pairs))
