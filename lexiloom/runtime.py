"""Session helpers: shared folder, materialised tables, input spreading."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A lookup table is broadcast only when it was measured to be within both bounds.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 128 << 20


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    With that setting absent, a folder below the session's warehouse is used, which
    Spark itself resolves and which all executors share.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_intermediate"


_written: list[str] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path in the shared folder."""
    _written.append(f"{shared_dir(spark).rstrip('/')}/lexiloom/{label}-{uuid.uuid4().hex}")
    return _written[-1]


def discard(spark: SparkSession, path: str) -> bool:
    """Delete one intermediate table that nothing reads any more."""
    if path in _written:
        _written.remove(path)
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> int:
    """Delete the intermediate tables this session wrote; results read from them end here."""
    removed = 0
    while _written:
        removed += discard(spark, _written[-1])
    return removed


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used where two passes must see the very same rows, or where a derived table is
    read more than once. The result survives the loss of any executor.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_at = path
    return table


def discard_table(table: DataFrame) -> None:
    """Delete a table made by :func:`materialize` that nothing reads any more."""
    discard(table.sparkSession, table._written_at)


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that are no longer held; without, they wait for the driver's next collection."""
    gc.collect()
    spark._jvm.System.gc()


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Redistribute by a unique key when the scan yields fewer splits than cores.

    A table of many files is returned untouched, so no shuffle is added at scale. Rows
    are dealt by a hash that no later grouping matches: a small table gets the very
    exchanges that a large one gets.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, F.xxhash64(*keys))


def table_size(table: DataFrame) -> tuple[int, int]:
    """Rows of a written table, and bytes of its numbers, strings and arrays."""
    width = F.lit(8 * len(table.columns))
    for field in table.schema:
        if field.dataType.typeName() == "string":
            width = width + F.coalesce(F.octet_length(field.name), F.lit(0))
        elif field.dataType.typeName() == "array":
            width = width + 8 * F.coalesce(F.greatest(F.size(field.name), F.lit(0)), F.lit(0))
    found = table.agg(F.count("*").alias("n"), F.sum(width).alias("bytes")).first()
    return found["n"], found["bytes"] or 0


def fits_broadcast(table: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether a written table was measured to be small enough for a broadcast."""
    n, found = table_size(table)
    return n <= rows and found <= size


def with_keys(df: DataFrame, keys: list[str], more: str) -> str:
    """The schema of the keys of ``df`` and further columns."""
    return ", ".join([*[f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys], more])
