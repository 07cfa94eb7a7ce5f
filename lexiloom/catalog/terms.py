"""Term statistics and keyword extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import KeywordSettings
from ..functions import text
from ..functions.stopwords import ENGLISH
from ..operators import keywords, splits, terms
from ..operators.terms import KEYS, with_tokens
from ..plans.jobs import keyword_job
from ..runtime import materialize
from ..sources import tables
from . import sql
from .registry import query
from .text import IN_STOPS, line_tokens

SETTINGS = KeywordSettings(use_default_stopwords=False)
WITH_DEFAULT = KeywordSettings()
SAMPLED = KeywordSettings(sampling_ratio=0.5)


def written_stats(spark, sf):
    return materialize(terms.term_stats(line_tokens(spark, sf)), "terms")


@query(
    "term_frequency",
    f"""WITH {sql.STATS} SELECT doc_id, line_no, word, n_w, CAST(n_d AS BIGINT) AS n_d,
      round(n_w / CAST(n_d AS DOUBLE), 6) AS tf FROM tf""",
)
def term_frequency(spark, sf):
    return terms.term_frequency(line_tokens(spark, sf)).select(
        *KEYS, "word", "n_w", "n_d", F.round("tf", 6).alias("tf")
    )


@query("inverse_doc_frequency", f"WITH {sql.STATS} SELECT word, c_d, i_d, round(idf, 6) AS idf FROM idf")
def inverse_doc_frequency(spark, sf):
    return terms.inverse_doc_frequency(line_tokens(spark, sf)).withColumn("idf", F.round("idf", 6))


TFIDF = f"""WITH {sql.STATS} SELECT doc_id, line_no, word,
      round(n_w / CAST(n_d AS DOUBLE) * idf, 6) AS tf_idf FROM tf JOIN idf USING (word)"""


@query("tfidf", TFIDF)
def tfidf(spark, sf):
    found = terms.tfidf(line_tokens(spark, sf), written_stats(spark, sf))
    return found.select(*KEYS, "word", F.round("tf_idf", 6).alias("tf_idf"))


@query(
    "join_tf_idf",
    f"""WITH {sql.STATS} SELECT doc_id, line_no, word, n_w, i_d, round(n_w / CAST(n_d AS DOUBLE), 6) AS tf, round(idf, 6) AS idf
    FROM tf JOIN idf USING (word)""",
)
def join_tf_idf(spark, sf):
    found = terms.attach_idf(line_tokens(spark, sf), written_stats(spark, sf))
    return found.select(*KEYS, "word", "n_w", "i_d", F.round("tf", 6).alias("tf"), F.round("idf", 6).alias("idf"))


def smooth_sql(rounded: bool) -> str:
    value = "round(raw / norm, 6)" if rounded else "raw / norm"
    return f"""{sql.LINES},
wtok AS (
  SELECT doc_id, line_no, unnest(list_filter(regexp_extract_all(lower({sql.clean_keyword('line')}), '[a-z][a-z]+'),
         lambda t: t NOT IN ({IN_STOPS}))) AS word FROM lines
),
wtf AS (SELECT doc_id, line_no, word, count(*) AS n_w FROM wtok GROUP BY doc_id, line_no, word),
wdf AS (SELECT word, count(*) AS df FROM wtf GROUP BY word),
weights AS (
  SELECT doc_id, line_no, word, {value} AS weight FROM (
    SELECT doc_id, line_no, word, n_w * idf AS raw, sqrt(sum(n_w * idf * n_w * idf) OVER (PARTITION BY doc_id, line_no)) AS norm
    FROM wtf JOIN (SELECT word, ln((1 + (SELECT count(*) FROM lines)) / CAST(1 + df AS DOUBLE)) + 1 AS idf FROM wdf) USING (word))
)"""


@query("tfidf_smooth_l2", f"WITH {smooth_sql(True)} SELECT doc_id, line_no, word, weight FROM weights")
def tfidf_smooth_l2(spark, sf):
    words = text.without(text.cleaned_words(text.clean_keyword_text(F.col("line"))), ENGLISH)
    tokens = with_tokens(tables.lines(spark, sf), words)
    found = terms.tfidf_smooth_l2(tokens, materialize(terms.smooth_stats(tokens), "smooth"))
    return found.withColumn("weight", F.round("weight", 6))


@query(
    "low_tfidf_terms",
    f"WITH {sql.STATS} SELECT word FROM idf WHERE min_tf * idf < CAST(0.1 AS DOUBLE)",
)
def low_tfidf_terms(spark, sf):
    return terms.low_tfidf_terms(terms.term_stats(line_tokens(spark, sf)), SETTINGS.tfidf_threshold)


@query("rare_terms", f"WITH {sql.TOK} SELECT word FROM tok GROUP BY word HAVING count(*) < 10")
def rare_terms(spark, sf):
    return terms.rare_terms(terms.term_stats(line_tokens(spark, sf)), SETTINGS.min_count)


@query("derive_stopwords", f"WITH {sql.STOPS} SELECT word FROM stops")
def derive_stopwords(spark, sf):
    return terms.derive_stopwords(
        terms.term_stats(line_tokens(spark, sf)), SETTINGS.tfidf_threshold, SETTINGS.min_count
    )


@query(
    "derive_stopwords_plain",
    f"""WITH {smooth_sql(False)},
    atok AS (SELECT unnest(regexp_split_to_array({sql.clean_keyword('line')}, '{text.DELIMITERS}')) AS word FROM lines),
    judged AS (SELECT word, count(*) AS cnt, min(low) AS low FROM atok
               LEFT JOIN (SELECT word, min(weight) AS low FROM weights GROUP BY word) USING (word) GROUP BY word)
    SELECT word FROM judged WHERE low IS NULL OR low < CAST(0.1 AS DOUBLE) OR cnt < 10
    UNION SELECT unnest([{IN_STOPS}])""",
)
def derive_stopwords_plain(spark, sf):
    return terms.derive_stopwords_plain(
        tables.lines(spark, sf), text.clean_keyword_text(F.col("line")), ENGLISH, 0.1, 10
    )


@query("extract_keywords", f"WITH {sql.EXTRACT} SELECT doc_id, line_no, keywords, cnt FROM extracted")
def extract_keywords(spark, sf):
    return keyword_job(tables.lines(spark, sf), SETTINGS)


def extracted_without(stops: str) -> str:
    return f"""SELECT l.doc_id, l.line_no, coalesce(k.keywords, '') AS keywords, coalesce(k.cnt, 0) AS cnt
    FROM lines l LEFT JOIN (
      SELECT doc_id, line_no, string_agg(word, ',' ORDER BY pos) AS keywords, count(*) AS cnt
      FROM tok WHERE word NOT IN ({stops}) AND word NOT IN ({IN_STOPS}) GROUP BY doc_id, line_no
    ) k USING (doc_id, line_no)"""


@query("extract_keywords_default_stops", f"WITH {sql.STOPS} {extracted_without('SELECT word FROM stops')}")
def extract_keywords_default_stops(spark, sf):
    """With the default stop words besides the derived ones."""
    return keyword_job(tables.lines(spark, sf), WITH_DEFAULT)


@query(
    "extract_keywords_sampled",
    f"""WITH {sql.TOK}, half AS (SELECT * FROM tok WHERE {sql.unit(sql.digest(SAMPLED.seed, 'doc_id', 'line_no'))} < CAST(0.5 AS DOUBLE)),
    tf AS (SELECT doc_id, line_no, word, count(*) AS n_w, sum(count(*)) OVER (PARTITION BY doc_id, line_no) AS n_d
           FROM half GROUP BY doc_id, line_no, word),
    idf AS (SELECT word, CAST(sum(n_w) AS BIGINT) AS total, min(n_w / CAST(n_d AS DOUBLE)) AS min_tf,
                   ln((SELECT count(DISTINCT (doc_id, line_no)) FROM half) / CAST(count(*) AS DOUBLE)) AS idf FROM tf GROUP BY word),
    stops AS (SELECT word FROM idf WHERE min_tf * idf < CAST(0.1 AS DOUBLE) OR total < 10)
    {extracted_without('SELECT word FROM stops')}""",
)
def extract_keywords_sampled(spark, sf):
    """Stop words derived from half of the lines, applied to all of them."""
    return keyword_job(tables.lines(spark, sf), SAMPLED)


@query(
    "extraction_summary",
    f"""WITH {sql.EXTRACT} SELECT total_lines, extraction,
      printf('%.2f%% (%d/%d)', empty / CAST(total_lines AS DOUBLE) * 100, empty, total_lines) AS empty_keywords_ratio,
      '100.0%' AS tfidf_sampling_ratio, (SELECT count(*) FROM stops) AS stopwords, total_keywords_cnt,
      printf('%.2f', total_keywords_cnt / CAST(total_lines AS DOUBLE)) AS average_keywords_cnt
    FROM (SELECT count(*) AS total_lines, count(*) FILTER (cnt > 0) AS extraction, count(*) FILTER (cnt = 0) AS empty,
                 CAST(sum(cnt) AS BIGINT) AS total_keywords_cnt FROM extracted)""",
)
def extraction_summary(spark, sf):
    tokens = line_tokens(spark, sf)
    stats = written_stats(spark, sf)
    keep = materialize(terms.surviving_words(stats, SETTINGS.tfidf_threshold, SETTINGS.min_count), "keep")
    stops = terms.derive_stopwords(stats, SETTINGS.tfidf_threshold, SETTINGS.min_count)
    extracted = keywords.extract_keywords(tokens, keep=keep, hot_by="total")
    return keywords.extraction_summary(extracted, stops.agg(F.count("*").alias("stopwords")), 1.0)


@query(
    "sink_keywords",
    f"WITH {sql.EXTRACT} SELECT corpus, doc_id || ':' || line_no || '|' || keywords AS value FROM extracted",
)
def sink_keywords(spark, sf):
    """Keywords written partitioned by corpus, read back as ``key|words`` rows."""
    from ..runtime import scratch_path
    from ..sources.sinks import write_keywords_table

    extracted = keyword_job(tables.lines(spark, sf), SETTINGS, ["corpus", *KEYS])
    path = scratch_path(spark, "keywords")
    write_keywords_table(extracted, path)
    saved = spark.read.parquet(path).withColumn("key", F.concat_ws(":", "doc_id", "line_no"))
    return saved.select(
        F.col("corpus").cast("int").alias("corpus"), F.concat_ws("|", "key", "keywords").alias("value")
    )


@query(
    "sink_meta",
    f"""WITH {sql.EXTRACT}, s AS (SELECT count(*) AS total_lines, count(*) FILTER (cnt > 0) AS extraction,
      count(*) FILTER (cnt = 0) AS empty, CAST(sum(cnt) AS BIGINT) AS words FROM extracted)
    SELECT 'total_lines : ' || total_lines AS value FROM s
    UNION ALL SELECT 'extraction : ' || extraction FROM s
    UNION ALL SELECT 'empty_keywords_ratio : ' || printf('%.2f%% (%d/%d)', empty / CAST(total_lines AS DOUBLE) * 100, empty, total_lines) FROM s
    UNION ALL SELECT 'tfidf_sampling_ratio : 100.0%'
    UNION ALL SELECT 'stopwords : ' || (SELECT count(*) FROM stops)
    UNION ALL SELECT 'total_keywords_cnt : ' || words FROM s
    UNION ALL SELECT 'average_keywords_cnt : ' || printf('%.2f', words / CAST(total_lines AS DOUBLE)) FROM s""",
)
def sink_meta(spark, sf):
    return keywords.summary_lines(extraction_summary(spark, sf))


@query("word_counts", f"WITH {sql.TOK} SELECT word, count(*) AS cnt FROM tok GROUP BY word")
def word_counts(spark, sf):
    return terms.word_counts(line_tokens(spark, sf))


@query(
    "doc_length",
    f"WITH {sql.LTOK} SELECT doc_id, line_no, len(w) AS n_d FROM ltok WHERE len(w) > 0",
)
def doc_length(spark, sf):
    """The length of a line is the size of its own token array."""
    return line_tokens(spark, sf).select(*KEYS, F.size("tokens").cast("bigint").alias("n_d")).filter("n_d > 0")


@query(
    "doc_frequency",
    f"WITH {sql.STATS} SELECT doc_id, line_no, word, i_d FROM tf JOIN stats USING (word)",
)
def doc_frequency(spark, sf):
    """Document frequency on every (line, word) row, through the lookup that splits hot words."""
    from ..operators.joins import lookup_join

    rows = terms.term_frequency(line_tokens(spark, sf)).select(*KEYS, "word")
    return lookup_join(rows, written_stats(spark, sf), "word", ["i_d"], hot_by="i_d")


@query(
    "sample_exact",
    f"WITH {sql.LINES} SELECT doc_id, line_no, line FROM {sql.hash_order('lines', 3, 'doc_id', 'line_no')} "
    "WHERE r < ceil(n * CAST(0.3 AS DOUBLE))",
)
def sample_exact(spark, sf):
    return splits.sample_exact(tables.lines(spark, sf).select(*KEYS, "line"), KEYS, 0.3, 3)


@query(
    "sample_fraction",
    f"WITH {sql.LINES} SELECT doc_id, line_no, line FROM lines "
    f"WHERE {sql.unit(sql.digest(4, 'doc_id', 'line_no'))} < CAST(0.2 AS DOUBLE)",
)
def sample_fraction(spark, sf):
    return splits.sample_fraction(tables.lines(spark, sf).select(*KEYS, "line"), KEYS, 0.2, 4)


@query(
    "train_test_split",
    f"WITH {sql.LABELLED} SELECT doc_id, label, r < ceil(n * CAST(0.9 AS DOUBLE)) AS is_train "
    f"FROM {sql.hash_order('labelled', 0, 'doc_id')}",
)
def train_test_split(spark, sf):
    return splits.train_test_split(tables.labelled(spark, sf).select("doc_id", "label"), ["doc_id"], 0.9, 0)


@query(
    "kfold_assign",
    f"WITH {sql.LABELLED} SELECT doc_id, label, CAST(ntile(10) OVER (ORDER BY {sql.digest(12, 'doc_id')}, doc_id) - 1 AS INTEGER) AS fold FROM labelled",
)
def kfold_assign(spark, sf):
    return splits.kfold_assign(tables.labelled(spark, sf).select("doc_id", "label"), ["doc_id"], 10, 12)
