"""Term statistics over lines.

A line's own token counts come from its token array, so the only shuffle is the one
that groups by word, and that one is combined on the map side.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import term_runs
from ..functions.text import cleaned_words, tokenize_delims, without
from ..runtime import fits_broadcast, materialize, with_keys
from .joins import HOT_BYTES, HOT_ROWS, hot_rows, lookup_join

KEYS = ["doc_id", "line_no"]


def with_tokens(lines: DataFrame, tokens: Column, keys: list[str] = KEYS) -> DataFrame:
    """One row per line with its token array."""
    return lines.select(*keys, tokens.alias("tokens"))


def explode_tokens(line_tokens: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """One row per token with its 0-based position."""
    # The outer form, because the inner one evaluates the token array twice to skip empty ones.
    return line_tokens.select(*keys, F.posexplode_outer("tokens").alias("pos", "word")).filter(F.col("pos").isNotNull())


def term_frequency(line_tokens: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """(line, word): count, line length and their ratio. No shuffle."""
    runs = line_tokens.select(*keys, F.size("tokens").cast("bigint").alias("n_d"), F.explode(term_runs(F.col("tokens"))).alias("r"))
    return runs.select(
        *keys,
        F.col("r.word").alias("word"),
        F.col("r.n_w").alias("n_w"),
        "n_d",
        (F.col("r.n_w") / F.col("n_d")).alias("tf"),
        F.col("r.first_pos").alias("first_pos"),
    )


def word_counts(line_tokens: DataFrame) -> DataFrame:
    """Occurrences per word over the corpus."""
    words = line_tokens.select(F.explode_outer("tokens").alias("word"))
    return words.groupBy("word").agg(F.count("word").alias("cnt")).filter(F.col("cnt") > 0)


def term_stats(line_tokens: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Per word: lines holding it, total count, smallest tf, and the corpus line count.

    Each non-empty line also emits one empty word with count 0, so the number of lines
    with a token is that group's count and needs no second scan. The smallest tf-idf of a
    word is its smallest tf times its idf, because idf is constant per word and never
    negative.
    """
    entry = "struct<word:string,n_w:bigint>"
    runs = F.transform(
        term_runs(F.col("tokens")), lambda r: F.struct(r["word"].alias("word"), r["n_w"].alias("n_w"))
    )
    marker = F.array(F.struct(F.lit("").alias("word"), F.lit(0).cast("bigint").alias("n_w")))
    marked = F.when(F.size("tokens") > 0, F.concat(runs, marker)).otherwise(F.array().cast(f"array<{entry}>"))
    rows = line_tokens.select(F.size("tokens").alias("n_d"), F.explode_outer(marked).alias("r")).filter("r is not null")
    stats = rows.groupBy(F.col("r.word").alias("word")).agg(
        F.count("*").alias("i_d"),
        F.sum("r.n_w").alias("total"),
        F.min(F.col("r.n_w") / F.col("n_d")).alias("min_tf"),
    )
    # Reads every aggregate column and filters on none of the keys, so that both uses of
    # the aggregate share one exchange.
    lines = stats.agg(
        F.max(F.when(F.col("word") == "", F.struct("i_d", "total", "min_tf"))).alias("m")
    ).select(F.col("m.i_d").alias("c_d"))
    return (
        stats.crossJoin(F.broadcast(lines))  # one row
        .filter("total > 0")
        .withColumn("idf", F.log(F.col("c_d") / F.col("i_d")))
    )


def inverse_doc_frequency(line_tokens: DataFrame) -> DataFrame:
    """ln(lines / lines with the word), unsmoothed.

    Only the lines of a word are counted, so its places in a line needn't be sorted.
    """
    marked = F.when(F.size("tokens") > 0, F.concat(F.array_distinct("tokens"), F.array(F.lit(""))))
    words = line_tokens.select(F.explode_outer(marked).alias("word"))
    found = words.groupBy("word").agg(F.count("*").alias("i_d"), F.max(F.length("word")).alias("size"))
    # Reads both aggregates and no filter is on the key, so that both uses share one exchange.
    lines = found.agg(F.max(F.when(F.col("word") == "", F.struct("i_d", "size"))).alias("m")).select(F.col("m.i_d").alias("c_d"))
    counted = found.crossJoin(F.broadcast(lines)).filter("size > 0")  # one row
    return counted.select("word", "c_d", "i_d", F.log(F.col("c_d") / F.col("i_d")).alias("idf"))


def attach_idf(line_tokens: DataFrame, stats: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Term frequencies with the idf of their word. ``stats`` is a written :func:`term_stats` table."""
    return lookup_join(term_frequency(line_tokens, keys), stats, "word", ["idf", "i_d", "total"], hot_by="total")


def tfidf(line_tokens: DataFrame, stats: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """tf * idf per (line, word)."""
    joined = attach_idf(line_tokens, stats, keys)
    return joined.select(*keys, "word", "tf", "idf", (F.col("tf") * F.col("idf")).alias("tf_idf"))


def smooth_stats(line_tokens: DataFrame) -> DataFrame:
    """Smoothed idf, ln((1+n)/(1+df))+1, where n counts every line."""
    marked = F.concat(
        F.transform(F.array_distinct("tokens"), lambda t: F.struct(t.alias("word"), F.lit(1).alias("real"))),
        F.array(F.struct(F.lit("").alias("word"), F.lit(0).alias("real"))),
    )
    rows = line_tokens.select(F.explode(marked).alias("r"))
    df = rows.groupBy(F.col("r.word").alias("word")).agg(F.count("*").alias("df"), F.sum("r.real").alias("real"))
    lines = df.agg(F.max(F.when(F.col("word") == "", F.struct("df", "real"))).alias("m")).select(
        F.col("m.df").alias("n_lines")
    )
    return (
        df.crossJoin(F.broadcast(lines))  # one row
        .filter("real > 0")
        .drop("real")
        .withColumn("idf", F.log((1 + F.col("n_lines")) / (1 + F.col("df"))) + 1)
    )


def _weight_batches(sent, n_keys: int):
    """Arrow batches of keys, tokens and the line's unsent words to keys, word and weight."""

    def run(batches):
        known, idf = sent.value["word"].combine_chunks(), sent.value["idf"].to_numpy()
        for batch in batches:
            lists, others = batch.column(n_keys), batch.column(n_keys + 1).flatten()
            coded = lists.flatten().dictionary_encode()
            words, more = coded.dictionary, others.field("word").dictionary_encode()
            own = np.zeros(len(more.dictionary))
            own[more.indices.to_numpy()] = others.field("idf").to_numpy()
            place = pc.index_in(words, value_set=known)
            values = np.zeros(len(words))
            hit = pc.is_valid(place).to_numpy(zero_copy_only=False)
            values[hit] = idf[place.drop_null().to_numpy()]
            values[~hit] = own[pc.index_in(words.filter(pa.array(~hit)), value_set=more.dictionary).to_numpy()]
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(sizes)), sizes)
            cells, n = np.unique(row * len(words) + coded.indices.to_numpy(), return_counts=True)
            row, code = np.divmod(cells, max(1, len(words)))
            raw = n * values[code]
            norm = np.sqrt(np.bincount(row, raw * raw, minlength=len(sizes)))
            columns = [*[batch.column(i).take(pa.array(row)) for i in range(n_keys)], words.take(pa.array(code))]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(raw / norm[row])], names=[str(i) for i in range(n_keys + 2)]
            )

    return run


def tfidf_smooth_l2(line_tokens: DataFrame, stats: DataFrame, keys: list[str] = KEYS, sent: int = HOT_ROWS) -> DataFrame:
    """Raw count times smoothed idf, scaled to unit length per line.

    Lines stay whole. The idf of the most frequent words (all of them up to ``sent``, as
    measured) is sent to the tasks; only the other words of a line meet theirs in a join, and
    the lines cross one exchange to get them. ``line_tokens`` is then read twice and must be
    the same again.
    """
    lines = line_tokens.select(*keys, F.filter("tokens", lambda t: t.isNotNull()).alias("tokens"))
    kind = "array<struct<word:string,idf:double>>"
    hot = hot_rows(stats, "word", ["idf"], "df", sent)
    if fits_broadcast(stats.select("word", "idf"), sent, HOT_BYTES):
        lines = lines.withColumn("others", F.lit(None).cast(kind))
    else:
        words = lines.select(*keys, F.explode_outer(F.array_distinct("tokens")).alias("word"))
        rare = words.join(F.broadcast(hot.select("word")), "word", "left_anti").join(stats.select("word", "idf"), "word")
        others = F.collect_list(F.struct("word", "idf")).cast(kind)  # of one line
        lines = lines.join(rare.groupBy(*keys).agg(others.alias("others")), keys, "left")
    table = lines.sparkSession.sparkContext.broadcast(hot.toArrow())
    schema = with_keys(line_tokens, keys, "word string, weight double")
    return lines.select(*keys, "tokens", "others").mapInArrow(_weight_batches(table, len(keys)), schema)


def low_tfidf_terms(stats: DataFrame, threshold: float) -> DataFrame:
    """Words whose tf-idf is below the threshold in any line."""
    return stats.filter(F.col("min_tf") * F.col("idf") < threshold).select("word")


def rare_terms(stats: DataFrame, min_count: int) -> DataFrame:
    """Words seen fewer than ``min_count`` times."""
    return stats.filter(F.col("total") < min_count).select("word")


def derive_stopwords(
    stats: DataFrame, threshold: float, min_count: int, carry: list[str] = ()
) -> DataFrame:
    """Low tf-idf words and rare words, each once (``stats`` has one row per word)."""
    return stats.filter(
        (F.col("min_tf") * F.col("idf") < threshold) | (F.col("total") < min_count)
    ).select("word", *carry)


def judged_words(stats: DataFrame, threshold: float, min_count: int) -> DataFrame:
    """Every word with its count, and whether :func:`derive_stopwords` names it."""
    stop = (F.col("min_tf") * F.col("idf") < threshold) | (F.col("total") < min_count)
    return stats.select("word", stop.alias("stop"), "total")


def surviving_words(stats: DataFrame, threshold: float, min_count: int) -> DataFrame:
    """The complement of :func:`derive_stopwords` within the corpus vocabulary."""
    return stats.filter(
        ~((F.col("min_tf") * F.col("idf") < threshold) | (F.col("total") < min_count))
    ).select("word", "total")


def union_stopwords(*word_tables: DataFrame) -> DataFrame:
    """Set union of word lists."""
    out = word_tables[0].select("word")
    for table in word_tables[1:]:
        out = out.unionByName(table.select("word"))
    return out.distinct()


def derive_stopwords_plain(
    lines: DataFrame, clean: Column, default_stops: list[str], threshold: float, min_count: int, keys: list[str] = KEYS
) -> DataFrame:
    """Stop words of the smoothed variant: low weight in any line, rare, default, or
    outside the vectoriser's vocabulary."""
    # Cleaned and cut once; the statistics, the weights and the counts read the written arrays.
    both = materialize(
        lines.select(*keys, clean.alias("clean")).select(
            *keys,
            without(cleaned_words(F.col("clean")), default_stops).alias("tokens"),
            tokenize_delims(F.col("clean"), keep_empty=True).alias("parts"),
        ),
        "tokens",
    )
    kept = both.select(*keys, "tokens")
    weights = tfidf_smooth_l2(kept, materialize(smooth_stats(kept), "smooth"), keys)
    lowest = weights.groupBy("word").agg(F.min("weight").alias("lowest"))
    counts = word_counts(both.select(*keys, F.col("parts").alias("tokens")))
    judged = counts.join(lowest, "word", "left")
    stop = F.col("lowest").isNull() | (F.col("lowest") < threshold) | (F.col("cnt") < min_count)
    found = judged.filter(stop).select("word")
    given = lines.sparkSession.createDataFrame([(w,) for w in default_stops], "word string")
    return union_stopwords(found, given)
