"""Scans, cleaning, tokenising, filters and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays, text
from ..functions.stopwords import ENGLISH
from ..operators import ranking, terms
from ..operators.encode import render
from ..operators.keywords import drop_stopwords
from ..operators.terms import KEYS, with_tokens
from ..runtime import materialize, scratch_path
from ..sources import readers, sinks, tables
from . import sql
from .registry import query

IN_STOPS = ", ".join(sql.quoted(w) for w in ENGLISH)


def line_tokens(spark, sf):
    return with_tokens(tables.lines(spark, sf), text.keyword_tokens(F.col("line")))


# --- scans -----------------------------------------------------------------


@query(
    "scan_lines",
    f"WITH {sql.LINES} SELECT doc_id, line_no, lang, source, line, corpus FROM lines",
)
def scan_lines(spark, sf):
    return tables.lines(spark, sf).select(*KEYS, "lang", "source", "line", "corpus")


@query(
    "scan_multi_file",
    "SELECT source, count(*) AS n_lines FROM "
    "(SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY source",
)
def scan_multi_file(spark, sf):
    """One text file set per source, read back through one glob."""
    path = f"{materialize_text(spark, sf)}/*/*.txt"
    read = readers.scan_lines(spark, path)
    source = F.regexp_extract("path", "source=([^/]+)", 1)
    return read.groupBy(source.alias("source")).agg(F.count("*").alias("n_lines"))


def materialize_text(spark, sf) -> str:
    path = scratch_path(spark, "text")
    rows = tables.lines(spark, sf).select("source", F.col("line").alias("value"))
    rows.write.partitionBy("source").text(path)
    return path


KEY_VALUE = "lang || '|' || replace(line, ' ', ',')"


@query(
    "scan_key_value",
    f"""WITH {sql.LINES}, v AS (SELECT doc_id, line_no, string_split({KEY_VALUE}, '|') AS p FROM lines)
    SELECT doc_id, line_no, len(p) = 2 AS ok, CASE WHEN len(p) = 2 THEN p[1] END AS key,
           CASE WHEN len(p) = 2 THEN array_to_string(string_split(p[2], ','), ' ') END AS words FROM v""",
)
def scan_key_value(spark, sf):
    value = F.concat_ws("|", "lang", F.replace("line", F.lit(" "), F.lit(",")))
    rows = tables.lines(spark, sf).select(*KEYS, value.alias("value"))
    good, bad = readers.parse_key_value(rows)
    return good.select(*KEYS, F.lit(True).alias("ok"), "key", F.concat_ws(" ", "words").alias("words")).unionByName(
        bad.select(*KEYS, F.lit(False).alias("ok")), allowMissingColumns=True
    )


@query(
    "scan_labelled",
    f"WITH {sql.LINES} SELECT doc_id, line_no, source AS label, line AS text FROM lines",
)
def scan_labelled(spark, sf):
    label, body = readers.parse_labelled(F.col("value"), "|^|")
    rows = tables.lines(spark, sf).withColumn("value", F.concat_ws("|^|", "source", "line"))
    return rows.select(*KEYS, label.alias("label"), body.alias("text"))


@query(
    "scan_ratings",
    f"""WITH {sql.LABELLED} SELECT CAST(doc_id AS VARCHAR) AS id, t AS text, label FROM (
      SELECT doc_id, label, regexp_replace(text, '[^A-Za-z ]', '', 'g') AS t FROM labelled) WHERE length(t) > 0""",
)
def scan_ratings(spark, sf):
    """Labelled documents written as a rating file and read back."""
    path = scratch_path(spark, "ratings")
    flat = F.regexp_replace("text", r"[\n\r\t]", "")
    rows = tables.labelled(spark, sf).select(F.col("doc_id").alias("id"), flat.alias("document"), "label")
    rows.select(F.concat_ws("\t", "id", "document", "label").alias("id\tdocument\tlabel")).write.option(
        "header", True
    ).option("quote", "").option("sep", "\u0001").csv(path)
    return readers.scan_ratings(spark, path, text.LATIN)


@query(
    "scan_class_files",
    f"""WITH {sql.LABELLED}, l AS (SELECT label, unnest(string_split(text, chr(10))) AS line FROM labelled)
    SELECT {sql.clean_english('line')} AS text, label FROM l""",
)
def scan_class_files(spark, sf):
    """Labelled lines written as one file set per class and read back as ISO-8859-1."""
    root = scratch_path(spark, "classes")
    rows = tables.explode_lines(tables.labelled(spark, sf), ["label"])
    rows.select("label", F.col("line").alias("value")).write.partitionBy("label").text(root)
    files = {f"{root}/label=1": 1, f"{root}/label=0": 0}
    return readers.scan_class_files(spark, files).select("text", "label")


PAIRS = """SELECT u.conv_id, u.turn, u.text AS src, a.text AS dst
    FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
    WHERE u.role = 'user' AND a.role = 'assistant'"""


@query(
    "scan_parallel",
    f"""SELECT row_number() OVER (ORDER BY conv_id, turn) AS line_no,
      translate(src, chr(13) || chr(10), '  ') AS src, translate(dst, chr(13) || chr(10), '  ') AS dst FROM ({PAIRS})""",
)
def scan_parallel(spark, sf):
    """Two line-aligned folders of text, written from the conversation pairs and read back side by side."""
    root = scratch_path(spark, "sides")
    sinks.write_parallel(tables.pairs(spark, sf), ["conv_id", "turn"], f"{root}/src", f"{root}/dst")
    return readers.scan_parallel(spark, f"{root}/src", f"{root}/dst").select("line_no", "src", "dst")


@query("parallel_join", f"SELECT conv_id, turn, length(src) AS src_chars, length(dst) AS dst_chars FROM ({PAIRS})")
def parallel_join(spark, sf):
    return tables.pairs(spark, sf).select(
        "conv_id", "turn", F.length("src").cast("bigint").alias("src_chars"), F.length("dst").cast("bigint").alias("dst_chars")
    )


@query(
    "scan_stopwords",
    f"WITH {sql.TOK} SELECT word, count(*) AS cnt FROM tok WHERE word IN ({IN_STOPS}) GROUP BY word",
)
def scan_stopwords(spark, sf):
    """Default stop words found in the corpus, with their counts."""
    found = terms.word_counts(line_tokens(spark, sf))
    return found.join(F.broadcast(readers.scan_stopwords(spark)), "word", "left_semi")


# --- string and array functions ---------------------------------------------


@query("clean_keyword_text", f"WITH {sql.LINES} SELECT doc_id, line_no, {sql.clean_keyword('line')} AS clean FROM lines")
def clean_keyword_text(spark, sf):
    return tables.lines(spark, sf).select(*KEYS, text.clean_keyword_text(F.col("line")).alias("clean"))


@query("clean_english_text", f"WITH {sql.LINES} SELECT doc_id, line_no, {sql.clean_english('line')} AS clean FROM lines")
def clean_english_text(spark, sf):
    return tables.lines(spark, sf).select(*KEYS, text.clean_english_text(F.col("line")).alias("clean"))


@query(
    "clean_script_text",
    f"""WITH {sql.LINES} SELECT * FROM (
      SELECT doc_id, line_no, regexp_replace(line, '[^A-Za-z ]', '', 'g') AS clean FROM lines) WHERE length(clean) > 0""",
)
def clean_script_text(spark, sf):
    cleaned = text.clean_script_text(F.col("line"), text.LATIN).alias("clean")
    return tables.lines(spark, sf).select(*KEYS, cleaned).filter(F.length("clean") > 0)


@query("normalize_line", "SELECT doc_id, lower(replace(text, chr(10), '')) AS clean FROM documents")
def normalize_line(spark, sf):
    return tables.documents(spark, sf).select("doc_id", text.normalize_line(F.col("text")).alias("clean"))


@query(
    "tokenize_delims",
    f"""WITH {sql.LTOK}, a AS (
      SELECT doc_id, line_no, len(regexp_split_to_array({sql.clean_keyword('line')}, '{text.DELIMITERS}')) AS n_all FROM lines)
    SELECT doc_id, line_no, array_to_string(w, '|') AS tokens, len(w) AS n_tokens, n_all
    FROM ltok JOIN a USING (doc_id, line_no)""",
)
def tokenize_delims(spark, sf):
    clean = text.clean_keyword_text(F.col("line"))
    return tables.lines(spark, sf).select(*KEYS, clean.alias("c")).select(
        *KEYS,
        F.concat_ws("|", text.tokenize_delims(F.col("c"))).alias("tokens"),
        F.size(text.tokenize_delims(F.col("c"))).cast("bigint").alias("n_tokens"),
        F.size(text.tokenize_delims(F.col("c"), keep_empty=True)).cast("bigint").alias("n_all"),
    )


@query(
    "tokenize_space",
    f"WITH {sql.LINES} SELECT doc_id, line_no, array_to_string(string_split(line, ' '), '|') AS tokens, "
    "len(string_split(line, ' ')) AS n_tokens FROM lines",
)
def tokenize_space(spark, sf):
    parts = text.tokenize_space(F.col("line"))
    return tables.lines(spark, sf).select(
        *KEYS, F.concat_ws("|", parts).alias("tokens"), F.size(parts).cast("bigint").alias("n_tokens")
    )


@query("explode_tokens", f"WITH {sql.TOK} SELECT doc_id, line_no, pos, word FROM tok")
def explode_tokens(spark, sf):
    return terms.explode_tokens(line_tokens(spark, sf))


@query("distinct_words", f"WITH {sql.LTOK} SELECT doc_id, line_no, array_to_string(list_sort(list_distinct(w)), ',') AS words FROM ltok")
def distinct_words(spark, sf):
    csv = line_tokens(spark, sf).select(*KEYS, F.concat_ws(",", "tokens").alias("csv"))
    return csv.select(*KEYS, F.concat_ws(",", text.distinct_words(F.col("csv"))).alias("words"))


@query(
    "replicate_tagged",
    "SELECT doc_id, CAST(i AS VARCHAR) || CAST(doc_id AS VARCHAR) AS tag, n_chars FROM documents, range(0, 3) t(i)",
)
def replicate_tagged(spark, sf):
    copies = tables.table(spark, sf, "documents").select(
        "doc_id", "n_chars", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i")
    )
    return copies.select("doc_id", F.concat(F.col("i").cast("string"), F.col("doc_id").cast("string")).alias("tag"), "n_chars")


@query("join_words", f"WITH {sql.LTOK} SELECT doc_id, line_no, array_to_string(w, ',') AS words FROM ltok")
def join_words(spark, sf):
    return line_tokens(spark, sf).select(*KEYS, F.concat_ws(",", "tokens").alias("words"))


@query("tag_corpus", f"SELECT doc_id, source, {sql.CORPUS} AS corpus FROM documents")
def tag_corpus(spark, sf):
    return tables.tag_corpus(tables.table(spark, sf, "documents").select("doc_id", "source"))


@query(
    "prefix_pieces",
    f"""WITH {sql.LTOK} SELECT doc_id, line_no,
      array_to_string(list_transform(w, lambda t, i: CASE WHEN i = 1 THEN t ELSE '##' || t END), ' ') AS pieces FROM ltok""",
)
def prefix_pieces(spark, sf):
    return line_tokens(spark, sf).select(*KEYS, text.prefix_pieces(F.col("tokens")).alias("pieces"))


@query(
    "format_ratio",
    f"""WITH {sql.LINES} SELECT lang, printf('%.2f%% (%d/%d)', p / CAST(n AS DOUBLE) * 100, p, n) AS share,
      printf('%.2f', chars / CAST(n AS DOUBLE)) AS average
    FROM (SELECT lang, CAST(sum(1 - corpus) AS BIGINT) AS p, count(*) AS n, CAST(sum(length(line)) AS BIGINT) AS chars
          FROM lines GROUP BY lang)""",
)
def format_ratio(spark, sf):
    per_lang = tables.lines(spark, sf).groupBy("lang").agg(
        F.sum(1 - F.col("corpus")).alias("p"), F.count("*").alias("n"), F.sum(F.length("line")).alias("chars")
    )
    return per_lang.select(
        "lang",
        arrays.format_ratio(F.col("p"), F.col("n")).alias("share"),
        F.format_string("%.2f", F.col("chars") / F.col("n")).alias("average"),
    )


@query(
    "split_duration",
    """SELECT event_id, CAST(floor(s / 60) AS BIGINT) AS minutes, CAST(floor(s - 60 * floor(s / 60)) AS BIGINT) AS seconds
    FROM (SELECT event_id, (epoch_us(ts) - epoch_us(date_trunc('day', ts))) / CAST(1000000 AS DOUBLE) AS s FROM events)""",
)
def split_duration(spark, sf):
    """Time since the start of the event's day."""
    day = F.date_trunc("day", "ts").cast("timestamp_ntz")
    micros = F.expr("timestampdiff(MICROSECOND, day, CAST(ts AS TIMESTAMP_NTZ))")
    events = tables.table(spark, sf, "events").select("event_id", "ts", day.alias("day"))
    return events.select("event_id", (micros / 1000000.0).alias("s")).select(
        "event_id", arrays.split_minutes(F.col("s")).alias("minutes"), arrays.split_seconds(F.col("s")).alias("seconds")
    )


@query(
    "keyword_udf",
    f"""WITH {sql.LTOK} SELECT doc_id, line_no,
      array_to_string(list_filter(w, lambda t: t NOT IN ({IN_STOPS})), ',') AS keywords FROM ltok""",
)
def keyword_udf(spark, sf):
    return tables.lines(spark, sf).select(
        *KEYS, text.keep_words(F.col("line"), text.keyword_tokens, ENGLISH).alias("keywords")
    )


@query(
    "tokenizer_hook",
    f"""WITH {sql.LINES} SELECT doc_id, line_no,
      array_to_string(regexp_extract_all(line, '[A-Za-z]+|[0-9]+'), ' ') AS tokens FROM lines""",
)
def tokenizer_hook(spark, sf):
    """Any ``Column -> Column`` function serves as tokenizer."""
    tokenizer = text.resolve_tokenizer(lambda c: F.regexp_extract_all(c, F.lit("[A-Za-z]+|[0-9]+"), F.lit(0)))
    return tables.lines(spark, sf).select(*KEYS, F.concat_ws(" ", tokenizer(F.col("line"))).alias("tokens"))


# --- filters and set operations -------------------------------------------------


@query(
    "drop_empty_tokens",
    f"""WITH {sql.LINES}, t AS (
      SELECT doc_id, line_no, unnest(regexp_split_to_array({sql.clean_keyword('line')}, '{text.DELIMITERS}')) AS word FROM lines)
    SELECT doc_id, count(*) AS n_tokens FROM t WHERE length(word) > 0 GROUP BY doc_id""",
)
def drop_empty_tokens(spark, sf):
    parts = text.tokenize_delims(text.clean_keyword_text(F.col("line")), keep_empty=True)
    words = tables.lines(spark, sf).select("doc_id", F.explode_outer(parts).alias("word"))
    return words.filter(F.length("word") > 0).groupBy("doc_id").agg(F.count("*").alias("n_tokens"))


@query(
    "drop_stopwords",
    f"""WITH {sql.STOPS} SELECT doc_id, line_no, pos, word FROM tok WHERE word NOT IN (SELECT word FROM stops)""",
)
def drop_stopwords_query(spark, sf):
    tokens = line_tokens(spark, sf)
    stats = materialize(terms.term_stats(tokens), "terms")
    judged = terms.judged_words(stats, 0.1, 10)
    return drop_stopwords(terms.explode_tokens(tokens), judged, hot_by="total")


@query("select_corpus", f"WITH {sql.LINES} SELECT doc_id, line_no, line FROM lines WHERE corpus = 0")
def select_corpus(spark, sf):
    return tables.lines(spark, sf).filter("corpus = 0").select(*KEYS, "line")


@query(
    "union_corpora",
    f"WITH {sql.LINES} SELECT CAST(0 AS INTEGER) AS origin, doc_id AS id, line FROM lines "
    "UNION ALL SELECT 1, item_id, unnest(string_split(text, chr(10))) FROM benchmark",
)
def union_corpora(spark, sf):
    docs = tables.lines(spark, sf).select(F.lit(0).alias("origin"), F.col("doc_id").alias("id"), "line")
    items = tables.table(spark, sf, "benchmark").select(
        F.lit(1).alias("origin"), F.col("item_id").alias("id"), F.explode(F.split("text", "\n", -1)).alias("line")
    )
    return docs.unionByName(items)


@query(
    "union_stopwords",
    f"""WITH {sql.STATS} SELECT word FROM idf WHERE min_tf * idf < CAST(0.1 AS DOUBLE)
    UNION SELECT word FROM idf WHERE total < 10
    UNION SELECT unnest([{IN_STOPS}])""",
)
def union_stopwords(spark, sf):
    stats = materialize(terms.term_stats(line_tokens(spark, sf)), "terms")
    given = spark.createDataFrame([(w,) for w in ENGLISH], "word string")
    return terms.union_stopwords(terms.low_tfidf_terms(stats, 0.1), terms.rare_terms(stats, 10), given)


@query("distinct_tokens", f"WITH {sql.TOK} SELECT DISTINCT word FROM tok")
def distinct_tokens(spark, sf):
    return line_tokens(spark, sf).select(F.explode_outer(F.array_distinct("tokens")).alias("word")).distinct().filter(
        F.col("word").isNotNull()
    )


@query(
    "subtract_positions",
    f"""WITH {sql.LTOK}, p AS (SELECT doc_id, line_no, list_transform(w, lambda t, i: i - 1) AS everything,
        list_filter(list_transform(w, lambda t, i: CASE WHEN t IN ({IN_STOPS}) THEN i - 1 END), lambda x: x IS NOT NULL) AS chosen FROM ltok)
    SELECT doc_id, line_no, {sql.digits('list_filter(everything, lambda x: NOT list_contains(chosen, x))')} AS remaining FROM p""",
)
def subtract_positions(spark, sf):
    from ..operators.instances import subtract_positions as subtract

    tokens = line_tokens(spark, sf)
    stops = F.array(*[F.lit(w) for w in ENGLISH])
    everything = F.transform("tokens", lambda t, i: i)
    chosen = F.filter(
        F.transform("tokens", lambda t, i: F.when(F.array_contains(stops, t), i)), lambda x: x.isNotNull()
    )
    return tokens.select(*KEYS, render(subtract(everything, chosen)).alias("remaining"))


@query("count_lines", f"WITH {sql.LINES} SELECT corpus, count(*) AS n_lines FROM lines GROUP BY corpus")
def count_lines(spark, sf):
    return tables.lines(spark, sf).groupBy("corpus").agg(F.count("*").alias("n_lines"))


# --- positions and chunks ---------------------------------------------------------


@query(
    "row_ids",
    f"WITH {sql.LINES} SELECT doc_id, line_no, row_number() OVER (ORDER BY doc_id, line_no) - 1 AS row_id FROM lines",
)
def row_ids(spark, sf):
    return ranking.global_rank(tables.lines(spark, sf).select(*KEYS), KEYS, "row_id")


@query(
    "next_line",
    f"WITH {sql.LINES} SELECT doc_id, line_no, line, lead(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS next_line FROM lines",
)
def next_line(spark, sf):
    return tables.explode_lines(tables.documents(spark, sf), [], following=True).select(*KEYS, "line", "next_line")


@query(
    "near_equal_chunks",
    f"WITH {sql.LINES} SELECT doc_id, line_no, CAST(ntile(7) OVER (ORDER BY doc_id, line_no) - 1 AS INTEGER) AS chunk FROM lines",
)
def near_equal_chunks(spark, sf):
    return ranking.near_equal_chunks(tables.lines(spark, sf).select(*KEYS), KEYS, 7)


@query(
    "batch_rows",
    f"WITH {sql.LINES} SELECT doc_id, line_no, (row_number() OVER (ORDER BY doc_id, line_no) - 1) // 64 AS batch FROM lines",
)
def batch_rows(spark, sf):
    return ranking.batch_rows(tables.lines(spark, sf).select(*KEYS), KEYS, 64)


@query(
    "shuffle_rows",
    f"WITH {sql.LINES} SELECT doc_id, line_no, r AS position FROM {sql.hash_order('lines', 5, 'doc_id', 'line_no')}",
)
def shuffle_rows(spark, sf):
    return ranking.hash_rank(tables.lines(spark, sf).select(*KEYS), KEYS, 5, "position")


@query(
    "length_buckets",
    f"""WITH {sql.LTOK} SELECT doc_id, line_no, len(w) AS length,
      (row_number() OVER (ORDER BY len(w), doc_id, line_no) - 1) // 64 AS batch FROM ltok""",
)
def length_buckets(spark, sf):
    sized = line_tokens(spark, sf).select(*KEYS, F.size("tokens").cast("bigint").alias("length"))
    return ranking.length_buckets(sized, "length", KEYS, 64)


@query(
    "batch_length_sort",
    f"""WITH {sql.LTOK}, b AS (SELECT doc_id, line_no, len(w) AS length,
        (row_number() OVER (ORDER BY doc_id, line_no) - 1) // 64 AS batch FROM ltok)
    SELECT *, CAST(row_number() OVER (PARTITION BY batch ORDER BY length DESC, doc_id, line_no) - 1 AS INTEGER) AS slot FROM b""",
)
def batch_length_sort(spark, sf):
    sized = line_tokens(spark, sf).select(*KEYS, F.size("tokens").cast("bigint").alias("length"))
    return ranking.batch_length_sort(
        ranking.batch_rows(sized, KEYS, 64, keys_from=tables.lines(spark, sf)), "length", KEYS
    )
