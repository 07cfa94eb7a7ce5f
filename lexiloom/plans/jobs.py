"""The end-to-end jobs: each stage is one DataFrame function, joined by written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import KeywordSettings
from ..functions.text import keyword_tokens
from ..operators.keywords import extract_keywords, extraction_summary
from ..operators.splits import sample_fraction
from ..operators.terms import KEYS, derive_stopwords, surviving_words, term_stats, union_stopwords, with_tokens
from ..operators.vectors import keyed_centroids, recommend_topn
from ..runtime import materialize
from ..sources.readers import scan_key_value, scan_lines, scan_stopwords
from ..sources.sinks import write_keywords, write_summary, write_vectors


def keyword_stats(lines: DataFrame, settings: KeywordSettings, keys: list[str] = KEYS) -> DataFrame:
    """Word statistics of the (sampled) corpus, written once."""
    sample = lines
    if settings.sampling_ratio < 1:
        sample = sample_fraction(lines, keys, settings.sampling_ratio, settings.seed)
    return materialize(term_stats(with_tokens(sample, keyword_tokens(F.col("line")), keys), keys), "terms")


def keyword_job(lines: DataFrame, settings: KeywordSettings, keys: list[str] = KEYS) -> DataFrame:
    """Lines to their keywords; stop words are derived from the corpus itself.

    With ``use_default_stopwords`` a list (of ``stopword_path``, or the default one) is
    added to them. Over the whole corpus the words to keep are the short list, so those
    are looked up; with a sample, words outside it are kept and the stop list is looked up.
    """
    stats = keyword_stats(lines, settings, keys)
    tokens = with_tokens(lines, keyword_tokens(F.col("line")), keys)
    if settings.sampling_ratio >= 1:
        keep = surviving_words(stats, settings.tfidf_threshold, settings.min_count)
        if settings.use_default_stopwords:
            given = scan_stopwords(lines.sparkSession, settings.stopword_path or None)
            keep = keep.join(given, "word", "left_anti")
        return extract_keywords(tokens, keep=materialize(keep, "keep"), keys=keys, hot_by="total")
    return extract_keywords(tokens, stops=stop_table(lines.sparkSession, stats, settings), keys=keys, hot_by="total")


def stop_table(spark: SparkSession, stats: DataFrame, settings: KeywordSettings) -> DataFrame:
    """Derived and given stop words with the count of each in the (sampled) corpus, written once."""
    stops = derive_stopwords(stats, settings.tfidf_threshold, settings.min_count)
    if settings.use_default_stopwords:
        stops = union_stopwords(stops, scan_stopwords(spark, settings.stopword_path or None))
    counted = stops.join(stats.select("word", "total"), "word", "left")
    return materialize(counted.select("word", F.coalesce("total", F.lit(0)).alias("total")), "stops")


def keyword_file_job(spark: SparkSession, settings: KeywordSettings) -> DataFrame:
    """Read both corpus files, write ``key|words`` per corpus and the summary, return the keywords.

    ``corpus`` is 0 for the code book and 1 for the items; a path left empty is no corpus.
    """
    corpus = None
    for origin, path in enumerate((settings.code_corpus_path, settings.item_corpus_path)):
        if path:
            part = scan_lines(spark, path).select(F.lit(origin).alias("corpus"), "line_no", "line")
            corpus = part if corpus is None else corpus.unionByName(part)
    keys = ["corpus", "line_no"]
    stats = keyword_stats(corpus, settings, keys)
    stops = stop_table(spark, stats, settings)
    tokens = with_tokens(corpus, keyword_tokens(F.col("line")), keys)
    extracted = materialize(extract_keywords(tokens, stops=stops, keys=keys, hot_by="total"), "keywords")
    count = stops.agg(F.count("*").alias("stopwords"))
    for origin, name in enumerate(("code", "item")):
        write_keywords(extracted.filter(F.col("corpus") == origin), "line_no", f"{settings.save_path}/keywords/{name}")
    write_summary(extraction_summary(extracted, count, settings.sampling_ratio), f"{settings.save_path}/keywords/meta")
    return extracted


def recommendation_job(
    spark: SparkSession, code_path: str, item_path: str, word_vectors: DataFrame, dim: int, save_path: str, top_n: int = 20
) -> DataFrame:
    """Keyed word lists to centroids, saved, and the best items of each code."""
    sides = []
    for name, path in (("code", code_path), ("item", item_path)):
        words = scan_key_value(spark, path)
        vectors = keyed_centroids(words, word_vectors, "key", dim)
        write_vectors(vectors, f"{save_path}/{name}")
        sides.append(spark.read.parquet(f"{save_path}/{name}"))
    code, item = sides
    best = recommend_topn(code, item, "key", "centroid", top_n)
    return best.select(F.col("q_id").alias("code_key"), F.col("t_id").alias("item_key"), "cos", "rank")
