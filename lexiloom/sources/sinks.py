"""Writers of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.keywords import keyword_lines, summary_lines


def write_keywords(extracted: DataFrame, key: str, path: str) -> None:
    """``key|k1,k2`` text, one row per line, empty ones included."""
    keyword_lines(extracted, key).write.mode("overwrite").text(path)


def write_keywords_table(extracted: DataFrame, path: str) -> None:
    """Parquet partitioned by corpus, so reading one corpus skips the other."""
    extracted.write.mode("overwrite").partitionBy("corpus").parquet(path)


def write_summary(summary: DataFrame, path: str) -> None:
    """``name : value`` text and the full record as JSON."""
    stamped = summary.withColumn("process_date", F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm"))
    summary_lines(stamped).coalesce(1).write.mode("overwrite").text(f"{path}/text")  # one row per field
    stamped.write.mode("overwrite").json(f"{path}/record")


def write_vectors(vectors: DataFrame, path: str) -> None:
    vectors.write.mode("overwrite").parquet(path)


def write_text(rows: DataFrame, line: Column, path: str) -> None:
    rows.select(line.alias("value")).write.mode("overwrite").text(path)


def write_parallel(pairs: DataFrame, keys: list[str], source: str, target: str) -> None:
    """Columns ``src`` and ``dst`` as two line-aligned folders of text, in the order of ``keys`` (unique).

    Line ends inside a text become spaces, a null text is an empty line.
    """
    for column, path in (("src", source), ("dst", target)):
        line = F.coalesce(F.translate(column, "\r\n", "  "), F.lit(""))
        pairs.select(*keys, line.alias("value")).orderBy(*keys).select("value").write.text(path)
