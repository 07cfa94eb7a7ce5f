"""Views over the provided parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import spread

# The sources taken as the small code-book side of the corpus.
CODE_SOURCES = ["src0", "src1", "src2", "src3"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def tag_corpus(df: DataFrame) -> DataFrame:
    """Origin 0 for the code-book side, 1 for the item side."""
    return df.withColumn("corpus", F.when(F.col("source").isin(CODE_SOURCES), F.lit(0)).otherwise(F.lit(1)))


def explode_lines(docs: DataFrame, carry: list[str] = ("lang", "source"), following: bool = False) -> DataFrame:
    """One row per text line: 1-based ``line_no`` and the document's ``n_lines``.

    ``following`` adds ``next_line``, null after the last line, out of the same row.
    """
    parts = docs.select("doc_id", *carry, F.split("text", "\n", -1).alias("_parts"))
    after = [F.get("_parts", F.col("_i") + 1).alias("next_line")] if following else []
    return parts.select(
        "doc_id", *carry, F.size("_parts").alias("n_lines"), "_parts", F.posexplode("_parts").alias("_i", "line")
    ).select("doc_id", (F.col("_i") + 1).alias("line_no"), *carry, "n_lines", "line", *after)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, line_no, lang, source, n_lines, line, corpus``."""
    return tag_corpus(explode_lines(documents(spark, sf_dir)))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"), "label")


def vector_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Vectors with label 0 and all others."""
    both = vectors(spark, sf_dir)
    return both.filter("label = 0"), both.filter("label <> 0")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns with the assistant turn that follows."""
    turns = table(spark, sf_dir, "conversations")
    user = turns.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("src"))
    reply = turns.filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("dst")
    )
    return user.join(reply, ["conv_id", "turn"])


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a quality label."""
    marks = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("label"))
    return documents(spark, sf_dir).select("doc_id", "lang", "text").join(marks, "doc_id")
