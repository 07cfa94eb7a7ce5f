"""Global positions, chunks and batches without a single-partition window."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import keyed_hash
from ..runtime import fits_broadcast, materialize

ChunkRule = Callable[[Column, Column], Column]


def global_rank(df: DataFrame, keys: list[str], rank: str = "rank", total: str | None = None) -> DataFrame:
    """Add the 0-based position of each row in the order of ``keys`` (a unique key).

    Rows are range-partitioned and sorted, numbered inside their range, and written
    once; the start of a range is the sum of the sizes of the ranges before it. Ranges
    are cut by sampled keys, so an uneven leading key does not pile up in one task.
    """
    placed = (
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_mono", F.monotonically_increasing_id())
    )
    table = materialize(placed, "rank")
    table = table.withColumn("_slot", F.shiftright("_mono", 33))
    # One row per range partition, so this window is bounded by the partition count.
    starts = table.groupBy("_slot").agg(F.count("*").alias("_size")).select(
        "_slot",
        F.coalesce(
            F.sum("_size").over(Window.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_start"),
        F.sum("_size").over(Window.partitionBy()).alias("_total"),
    )
    ranked = table.join(F.broadcast(starts), "_slot").withColumn(
        rank, F.col("_start") + F.col("_mono").bitwiseAND(F.lit((1 << 33) - 1))
    )
    if total:
        ranked = ranked.withColumnRenamed("_total", total)
    return ranked.drop("_mono", "_slot", "_start", "_total")


BUCKET_ROWS = 1_000_000
LEAST_DIGITS = 3


def bucket_digits(rows: int) -> int:
    """Hexadecimal digits of a prefix that leaves about BUCKET_ROWS rows per bucket, LEAST_DIGITS at least."""
    return max(LEAST_DIGITS, math.ceil(math.log(max(1, rows / BUCKET_ROWS), 16)))


def _hash_buckets(df: DataFrame, keys: list[str], seed: int, digits: int | None) -> tuple[DataFrame, DataFrame]:
    """Rows with their hash and prefix bucket, and the start of each bucket, to be joined.

    One pass counts the rows per bucket of the shortest prefix, which also gives the number
    of rows. Only where that asks for a longer prefix are the rows counted again.
    """
    hashed = df.withColumn("_hash", keyed_hash(seed, *keys))
    used = LEAST_DIGITS if digits is None else digits

    def counted(n: int) -> DataFrame:
        sizes = hashed.groupBy(F.substring("_hash", 1, n).alias("_bucket")).agg(F.count("*").alias("_size"))
        return materialize(sizes, "buckets")

    sizes = counted(used)
    if digits is None:
        wanted = bucket_digits(sizes.agg(F.sum("_size")).first()[0] or 0)
        if wanted > used:
            used, sizes = wanted, counted(wanted)
    # At most 16**LEAST_DIGITS rows, or a millionth of the table.
    starts = sizes.select(
        "_bucket",
        "_size",
        F.coalesce(
            F.sum("_size").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_start"),
        F.sum("_size").over(Window.partitionBy()).alias("_total"),
    )
    few = used <= LEAST_DIGITS or fits_broadcast(sizes)
    return hashed.withColumn("_bucket", F.substring("_hash", 1, used)), F.broadcast(starts) if few else starts


def hash_rank(
    df: DataFrame, keys: list[str], seed: int, rank: str = "rank", digits: int | None = None, total: str | None = None
) -> DataFrame:
    """0-based position in a pseudo-random permutation of the rows.

    The bucket is a prefix of the hash of a unique key, so buckets are even whatever
    the data look like and the window never sees more than one bucket at a time.
    """
    hashed, starts = _hash_buckets(df, keys, seed, digits)
    inside = Window.partitionBy("_bucket").orderBy("_hash", *keys)
    ranked = hashed.join(starts, "_bucket").withColumn(
        rank, F.col("_start") + F.row_number().over(inside) - 1
    )
    if total:
        ranked = ranked.withColumnRenamed("_total", total)
    return ranked.drop("_hash", "_bucket", "_size", "_start", "_total")


def hash_chunks(
    df: DataFrame, keys: list[str], seed: int, rule: ChunkRule, chunk: str = "chunk", digits: int | None = None
) -> DataFrame:
    """Chunk number of each row's position in hash order.

    ``rule(rank, total)`` must not decrease with rank. A bucket whose first and last
    rank fall in one chunk needs no order at all; only the few buckets cut by a chunk
    border are ranked, so nearly all rows are labelled without a shuffle.
    """
    hashed, starts = _hash_buckets(df, keys, seed, digits)
    borders = starts.select(
        "_bucket",
        "_start",
        "_total",
        rule(F.col("_start"), F.col("_total")).alias("_low"),
        rule(F.col("_start") + F.col("_size") - 1, F.col("_total")).alias("_high"),
    )
    placed = hashed.join(borders, "_bucket")
    inside = Window.partitionBy("_bucket").orderBy("_hash", *keys)
    whole = placed.filter("_low = _high").withColumn(chunk, F.col("_low"))
    cut = placed.filter("_low <> _high").withColumn(
        chunk, rule(F.col("_start") + F.row_number().over(inside) - 1, F.col("_total"))
    )
    helpers = ["_hash", "_bucket", "_start", "_total", "_low", "_high"]
    return whole.drop(*helpers).unionByName(cut.drop(*helpers))


def near_equal(chunks: int) -> ChunkRule:
    """``chunks`` contiguous parts, the first ``n mod chunks`` one row larger."""

    def rule(rank: Column, total: Column) -> Column:
        small = F.floor(total / chunks).cast("bigint")
        larger = total % chunks
        border = larger * (small + 1)
        return (
            F.when(rank < border, F.floor(rank / (small + 1)))
            .otherwise(F.floor((rank - larger) / F.greatest(small, F.lit(1))))
            .cast("int")
        )

    return rule


def near_equal_chunks(df: DataFrame, keys: list[str], chunks: int, chunk: str = "chunk") -> DataFrame:
    """Contiguous near-equal chunks in key order."""
    ranked = global_rank(df, keys, "_rank", "_n")
    return ranked.withColumn(chunk, near_equal(chunks)(F.col("_rank"), F.col("_n"))).drop("_rank", "_n")


def batch_rows(
    df: DataFrame, keys: list[str], size: int, batch: str = "batch", keys_from: DataFrame | None = None
) -> DataFrame:
    """Fixed-size batches in key order; the last one may be smaller.

    Only the keys are ranked and written; the rows join their batch number. When ``df``
    is costly, ``keys_from`` names a cheaper table with the same keys.
    """
    source = df if keys_from is None else keys_from
    ranked = global_rank(source.select(*keys), keys, "_rank")
    numbered = ranked.withColumn(batch, F.floor(F.col("_rank") / size).cast("bigint")).drop("_rank")
    return numbered if set(df.columns) == set(keys) else df.join(numbered, keys)


def shuffled_batches(df: DataFrame, keys: list[str], size: int, seed: int, batch: str = "batch") -> DataFrame:
    """Fixed-size batches of a pseudo-random permutation."""
    ranked = hash_rank(df, keys, seed, "_rank")
    return ranked.withColumn(batch, F.floor(F.col("_rank") / size).cast("bigint")).drop("_rank")


def batch_length_sort(df: DataFrame, length: str, keys: list[str], batch: str = "batch") -> DataFrame:
    """Position inside each batch by descending length. A batch has a fixed size."""
    inside = Window.partitionBy(batch).orderBy(F.desc(length), *keys)
    return df.withColumn("slot", F.row_number().over(inside) - 1)


def length_buckets(df: DataFrame, length: str, keys: list[str], size: int, batch: str = "batch") -> DataFrame:
    """Batches of examples of similar length."""
    return batch_rows(df, [length, *keys], size, batch)
