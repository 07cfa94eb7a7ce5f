"""What the operators of this package share: table access, row numbers, measured lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import materialize

# Ids are broadcast up to this many (8 bytes each); beyond, the join shuffles.
BROADCAST_IDS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(df: DataFrame, label: str, rid: str = "rid") -> DataFrame:
    """Write the rows with a number each, so that repeated ids stay rows of their own.

    Later steps read the written rows, hence a lost executor cannot change a number.
    """
    return materialize(df.withColumn(rid, F.monotonically_increasing_id()), label)


def only_ids(df: DataFrame, ids: DataFrame, key: str, bound: int | None = None) -> DataFrame:
    """The rows of ``df`` whose key is in ``ids`` (one column, distinct).

    A counted small list is broadcast, so wide rows stay where they are; a longer one
    is joined by a shuffle. Both give the same rows.
    """
    few = ids.count() <= (BROADCAST_IDS if bound is None else bound)
    return df.join(F.broadcast(ids) if few else ids, key, "left_semi")


def text_or_empty(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def without_ids(df: DataFrame, ids: DataFrame, key: str, bound: int | None = None) -> DataFrame:
    """The rows of ``df`` whose key is not in ``ids``; null keys stay. Joined as in ``only_ids``."""
    ids = materialize(ids.filter(F.col(key).isNotNull()).distinct(), "ids")
    few = ids.count() <= (BROADCAST_IDS if bound is None else bound)
    return df.join(F.broadcast(ids) if few else ids, key, "left_anti")
