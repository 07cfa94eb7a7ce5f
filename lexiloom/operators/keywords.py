"""Keyword extraction and its summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import lookup_join
from .terms import KEYS


def drop_stopwords(tokens: DataFrame, stops: DataFrame, hot_by: str | None = None) -> DataFrame:
    """Tokens outside a written stop table.

    The table may hold all words of the corpus, with a column ``stop``: then the frequent
    words that stay are known as well, and are not shuffled.
    """
    flagged = stops.withColumnRenamed("stop", "_stop") if "stop" in stops.columns else stops.withColumn("_stop", F.lit(True))
    found = lookup_join(tokens, flagged, "word", ["_stop"], hot_by)
    return found.filter(~F.coalesce("_stop", F.lit(False))).drop("_stop")


def extract_keywords(
    line_tokens: DataFrame,
    keep: DataFrame | None = None,
    stops: DataFrame | None = None,
    keys: list[str] = KEYS,
    hot_by: str | None = None,
) -> DataFrame:
    """Per line the surviving words in token order, joined by commas, and their count.

    Give ``keep`` (words that survive) when the stop words were derived from this very
    corpus, or ``stops`` otherwise; both are written tables. Lines without keywords stay
    in the result: each line's first token, or a null for an empty line, is carried as
    a marker, so only survivors and one marker per line reach the final grouping.
    """
    words = line_tokens.select(*keys, F.posexplode_outer("tokens").alias("pos", "word"))
    table = (keep if keep is not None else stops).withColumn("_hit", F.lit(True))
    found = lookup_join(words, table, "word", ["_hit"], hot_by)
    kept = F.col("_hit") if keep is not None else F.col("_hit").isNull()
    kept = F.coalesce(kept & F.col("word").isNotNull(), F.lit(False))
    marked = found.select(*keys, "pos", "word", kept.alias("kept")).filter(
        F.col("kept") | F.col("pos").isNull() | (F.col("pos") == 0)
    )
    grouped = marked.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.when(F.col("kept"), F.struct("pos", "word")))).alias("k")
    )
    return grouped.select(
        *keys,
        F.concat_ws(",", F.transform("k", lambda x: x["word"])).alias("keywords"),
        F.size("k").cast("bigint").alias("cnt"),
    )


def keyword_lines(extracted: DataFrame, key: str) -> DataFrame:
    """``key|k1,k2`` rows, empty ones included."""
    return extracted.select(F.concat_ws("|", F.col(key).cast("string"), "keywords").alias("value"))


def extraction_summary(extracted: DataFrame, stop_count: DataFrame, sampling_ratio: float) -> DataFrame:
    """One row of totals. ``stop_count`` is a one-row table with ``stopwords``."""
    totals = extracted.agg(
        F.count("*").alias("total_lines"),
        F.sum((F.col("cnt") > 0).cast("bigint")).alias("extraction"),
        F.sum((F.col("cnt") == 0).cast("bigint")).alias("empty"),
        F.sum("cnt").alias("total_keywords_cnt"),
    )
    return totals.crossJoin(F.broadcast(stop_count)).select(  # one row each
        "total_lines",
        "extraction",
        F.format_string(
            "%.2f%% (%d/%d)", F.col("empty") / F.col("total_lines") * 100, F.col("empty"), F.col("total_lines")
        ).alias("empty_keywords_ratio"),
        F.lit(f"{sampling_ratio * 100}%").alias("tfidf_sampling_ratio"),
        F.col("stopwords").alias("stopwords"),
        "total_keywords_cnt",
        F.format_string("%.2f", F.col("total_keywords_cnt") / F.col("total_lines")).alias("average_keywords_cnt"),
    )


def empty_keys(extracted: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Keys of the lines without keywords."""
    return extracted.filter(F.col("cnt") == 0).select(*keys)


def keyword_counts(extracted: DataFrame) -> DataFrame:
    """How often each keyword was extracted."""
    words = extracted.filter(F.col("cnt") > 0).select(F.explode_outer(F.split("keywords", ",", -1)).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("cnt"))


def summary_lines(summary: DataFrame) -> DataFrame:
    """``name : value`` rows of the summary."""
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value"))
            for c in summary.columns
        ]
    )
    return summary.select(F.explode(pairs).alias("p")).select(
        F.concat_ws(" : ", "p.name", "p.value").alias("value")
    )

