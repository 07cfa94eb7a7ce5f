"""Lookups of tokens in word tables that stay even when a few words dominate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import BROADCAST_ROWS, fits_broadcast, materialize, table_size

# The most frequent keys of a table that is too large to be sent, within both bounds.
HOT_ROWS = 100_000
HOT_BYTES = 32 << 20
# The most frequent keys where they have to be counted first.
COUNTED_ROWS = 10_000


def hot_rows(table: DataFrame, key: str, values: list[str], hot_by: str, most: int = HOT_ROWS) -> DataFrame:
    """The most frequent keys of a written table and their values, written; small enough to be sent."""
    rows, size = table_size(table.select(key, *values))
    most = min(most, max(1, HOT_BYTES * rows // max(1, size)))
    return materialize(table.orderBy(F.desc(hot_by), key).limit(most).select(key, *values), "hot")


def lookup_join(
    left: DataFrame,
    table: DataFrame,
    key: str,
    values: list[str],
    hot_by: str | None = None,
    limit: int = BROADCAST_ROWS,
) -> DataFrame:
    """Left join of ``values`` from ``table`` on ``key``; misses give null.

    ``table`` holds one row per key and should be a written table, as it is measured
    first. Up to ``limit`` rows (and a byte bound) it is broadcast. Beyond, the most
    frequent keys are broadcast and all others go through a shuffled join. With
    ``hot_by``, the column of ``table`` that counts a key, rows answered by the broadcast
    are not shuffled at all; ``left`` is then evaluated once for either kind of rows and
    must give the same rows again. Without, the frequent keys are counted in ``left``,
    and answered rows carry a spread-out key that matches nothing.
    """
    table = table.select(key, *values, *([hot_by] if hot_by and hot_by not in values else []))
    if fits_broadcast(table.select(key, *values), limit):
        return left.join(F.broadcast(table.select(key, *values)), key, "left")
    renamed = [F.col(v).alias(f"_hot_{v}") for v in values]
    if hot_by:
        hot = hot_rows(table, key, values, hot_by).select(key, F.lit(True).alias("_hit"), *renamed)
        # One expression, so that no part of it moves below: both sides share what ``left`` exchanges.
        first = left.join(F.broadcast(hot), key, "left").withColumn("_known", F.coalesce("_hit", F.col(key).isNull()))
        answered = first.filter("_known").select(*left.columns, *[F.col(f"_hot_{v}").alias(v) for v in values])
        rest = first.filter(~F.col("_known")).select(*left.columns)
        return answered.unionByName(rest.join(table.select(key, *values), key, "left").select(*answered.columns))
    counted = left.groupBy(key).agg(F.count("*").alias("_n")).orderBy(F.desc("_n")).limit(COUNTED_ROWS)
    hot = table.join(F.broadcast(counted.select(key)), key, "left_semi")
    hot = hot.select(key, F.lit(True).alias("_hit"), *renamed)
    first = left.join(F.broadcast(hot), key, "left")
    answered = F.concat(F.lit("\u0000"), F.xxhash64(*[F.col(c) for c in left.columns]).cast("string"))
    routed = first.withColumn(
        "_route", F.when(F.col("_hit") | F.col(key).isNull(), answered).otherwise(F.col(key).cast("string"))
    )
    cold = table.select(F.col(key).cast("string").alias("_route"), *[F.col(v).alias(f"_cold_{v}") for v in values])
    joined = routed.join(cold, "_route", "left")
    return joined.select(*left.columns, *[_either(v) for v in values])


def _either(value: str) -> Column:
    return F.coalesce(f"_hot_{value}", f"_cold_{value}").alias(value)


def require_all(ids: DataFrame, table: DataFrame, key: str) -> None:
    """Raise when some id has no row in ``table``."""
    missing = ids.select(key).join(table.select(key), key, "left_anti").limit(5).collect()
    if missing:
        raise KeyError(f"unknown {key}: {[row[0] for row in missing]}")


def split_two_sets(table: DataFrame, a_ids: DataFrame, key: str, b_ids: DataFrame | None = None):
    """A = the given ids, B = the other given ids or all the rest."""
    a = table.join(a_ids.select(key).distinct(), key, "left_semi")
    if b_ids is None:
        return a, table.join(a_ids.select(key).distinct(), key, "left_anti")
    return a, table.join(b_ids.select(key).distinct(), key, "left_semi")


def map_labels(df: DataFrame, labels: DataFrame, label: str, index: str = "label_id") -> DataFrame:
    """Label string to index through a label table; unknown labels give -1."""
    return lookup_join(df, labels, label, [index]).withColumn(index, F.coalesce(index, F.lit(-1)))
