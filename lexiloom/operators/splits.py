"""Sampling, train/test splits and folds in hash order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import keyed_hash, unit_float
from .ranking import hash_chunks, near_equal


def _first_part(ratio: float):
    return lambda rank, total: F.when(rank < F.ceil(total * F.lit(float(ratio))), F.lit(0)).otherwise(F.lit(1))


def sample_exact(df: DataFrame, keys: list[str], ratio: float, seed: int) -> DataFrame:
    """Exactly ``ceil(n * ratio)`` rows without replacement."""
    return hash_chunks(df, keys, seed, _first_part(ratio), "_part").filter("_part = 0").drop("_part")


def sample_fraction(df: DataFrame, keys: list[str], ratio: float, seed: int) -> DataFrame:
    """Each row independently with probability ``ratio``."""
    return df.filter(unit_float(keyed_hash(seed, *keys)) < ratio)


def train_test_split(df: DataFrame, keys: list[str], ratio: float = 0.9, seed: int = 0) -> DataFrame:
    """Add ``is_train``: true for the first ``ceil(n * ratio)`` rows in hash order."""
    parts = hash_chunks(df, keys, seed, _first_part(ratio), "_part")
    return parts.withColumn("is_train", F.col("_part") == 0).drop("_part")


def kfold_assign(df: DataFrame, keys: list[str], folds: int = 10, seed: int = 12) -> DataFrame:
    """Add ``fold``: near-equal parts of a pseudo-random permutation."""
    return hash_chunks(df, keys, seed, near_equal(folds), "fold")
