"""The registered queries of this package, with SQL where it can express them.

Each query reads its whole tables and gives every row of its result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .align import alignment_report
from .chat import read_back, segments
from .common import table
from .exact import exact_duplicates
from .language import identify_languages
from .merkle import verified_manifest
from .mixing import SHARE, mix_report
from .near import near_duplicates
from .quality import quality_verdicts
from .shards import shard_rows
from .substrings import without_repeats
from .tokens import context_totals, length_histogram
from .urls import judge_urls
from .winnow import contamination

QUERIES = {}
ORACLES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histogram of encoded lengths with its sums from the long end."""
    return context_totals(length_histogram(table(spark, sf_dir, "documents")))


@query
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal texts but for white space; one row per document."""
    return exact_duplicates(table(spark, sf_dir, "documents"))


ORACLES["op2_exact_dedup"] = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents),
r AS (
  SELECT doc_id, norm, count(*) OVER (PARTITION BY norm) AS group_size,
         row_number() OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS place,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id
  FROM d)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(norm) AS text_sha256 FROM r
"""


@query
def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links at 85 of 100 on five-word shingles; one row per document."""
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


ORACLES["op3_near_duplicates"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
shingle AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM words WHERE len(w) > 0)),
sized AS (SELECT doc_id, count(g) AS n FROM words LEFT JOIN shingle USING (doc_id) GROUP BY doc_id),
pair AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
  FROM shingle a JOIN shingle b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS (
  SELECT a, b FROM pair JOIN sized x ON x.doc_id = a JOIN sized y ON y.doc_id = b
  WHERE 100 * common >= 85 * (x.n + y.n - common)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (
  SELECT doc_id AS node, doc_id AS other FROM words
  UNION SELECT node, b FROM reach JOIN edge ON edge.a = other)
SELECT doc_id, n AS n_shingles, min(other) AS component_id, doc_id = min(other) AS kept
FROM sized JOIN reach ON node = doc_id GROUP BY doc_id, n
"""


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language by compression, learned from three quarters of the documents."""
    return identify_languages(table(spark, sf_dir, "documents"))


@query
def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page by rule, or by its path template's purity."""
    return judge_urls(table(spark, sf_dir, "pages"))


def _with_control_conversation(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    text = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(text).alias("text"),
    )
    return conversations.select("conv_id", "turn", "role", "text").unionByName(extra)


@query
def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation, read back from its formatted form."""
    conversations = _with_control_conversation(spark, table(spark, sf_dir, "conversations"))
    return read_back(segments(conversations))


ORACLES["op6_chat_format"] = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
o AS (
  SELECT *, coalesce(lag(role) OVER w, '') AS before, row_number() OVER w AS place,
         count(*) OVER (PARTITION BY conv_id) AS n
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
f AS (
  SELECT *,
    4 + CASE WHEN role IN ('user', 'assistant', 'system', 'tool') THEN length(role)
             ELSE 1 + length(role) + len(regexp_extract_all(role, '[\\:\n#<]')) END
      + 2 + length(text) + len(regexp_extract_all(text, '\\|### |</turn>')) + 9 AS chars,
    (before, role) IN (('', 'system'), ('', 'user'), ('system', 'user'), ('user', 'assistant'),
                       ('assistant', 'user'), ('assistant', 'tool'), ('tool', 'assistant')) AS allowed
  FROM o)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars,
       bool_and(allowed) AND bool_or(place = n AND role = 'assistant') AS valid
FROM f GROUP BY conv_id
"""


@query
def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of every document against the quantiles of trusted text."""
    return quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards 0 to 39 of near equal bytes, equal texts together."""
    return shard_rows(table(spark, sf_dir, "documents"))


@query
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside 13-word windows of benchmark items."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op9_decontamination"] = r"""
WITH lower_ascii AS (
  SELECT 'd' AS side, doc_id AS id, coalesce(text, '') AS text FROM documents
  UNION ALL SELECT 'b', item_id, coalesce(text, '') FROM benchmark),
t AS (
  SELECT side, id, regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM lower_ascii),
spans AS (SELECT DISTINCT least(13, len(w)) AS m FROM t WHERE side = 'b' AND len(w) > 0),
item AS (
  SELECT DISTINCT id AS item_id, m, array_to_string(w[i : i + m - 1], ' ') AS g
  FROM (SELECT id, w, least(13, len(w)) AS m, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i
        FROM t WHERE side = 'b' AND len(w) > 0)),
place AS (
  SELECT id, m, i, array_to_string(w[i : i + m - 1], ' ') AS g
  FROM (SELECT id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM t, spans WHERE side = 'd' AND len(w) >= m)),
hit AS (SELECT id, item_id, p.m, i FROM place p JOIN item USING (m, g)),
word AS (SELECT id, count(DISTINCT spot) AS n_hit FROM (SELECT id, unnest(range(i, i + m)) AS spot FROM hit) GROUP BY id),
named AS (
  SELECT id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items
  FROM (SELECT DISTINCT id, item_id::VARCHAR AS x FROM hit) GROUP BY id)
SELECT t.id AS doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM t LEFT JOIN word ON word.id = t.id LEFT JOIN named ON named.id = t.id WHERE side = 'd'
"""


@query
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated sampling probability of every document, and whether it is kept."""
    return mix_report(table(spark, sf_dir, "documents"))


ORACLES["op10_mixing"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(source, 'unknown') AS source, coalesce(lang, 'unknown') AS lang,
         list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
longest AS (
  SELECT *, list_reduce(w, lambda a, b: CASE WHEN (length(a), a) >= (length(b), b) THEN a ELSE b END, '') AS top FROM words),
described AS (
  SELECT doc_id, source, lang, len(w) AS tokens,
         CASE WHEN len(w) = 0 THEN 'unknown'
              ELSE 't' || (CAST('0x' || substr(md5(top), 1, 8) AS UBIGINT) % 8) END AS topic
  FROM longest),
cell AS (
  SELECT source, lang, topic, sum(tokens)::DOUBLE AS tokens FROM described WHERE tokens > 0 GROUP BY source, lang, topic),
s AS (SELECT source, r / sum(r) OVER () AS ts FROM (SELECT source, pow(sum(tokens), 0.8::DOUBLE) AS r FROM cell GROUP BY source)),
l AS (SELECT lang, r / sum(r) OVER () AS tl FROM (SELECT lang, pow(sum(tokens), 0.9::DOUBLE) AS r FROM cell GROUP BY lang)),
t AS (SELECT topic, r / sum(r) OVER () AS tt FROM (SELECT topic, pow(sum(tokens), 0.9::DOUBLE) AS r FROM cell GROUP BY topic)),
ipf AS (
  SELECT 0 AS n, source, lang, topic, tokens, ts, tl, tt, tokens AS w FROM cell JOIN s USING (source) JOIN l USING (lang) JOIN t USING (topic)
  UNION ALL
  SELECT n + 1, source, lang, topic, tokens, ts, tl, tt, w * tt / sum(w) OVER (PARTITION BY topic) FROM (
    SELECT n, source, lang, topic, tokens, ts, tl, tt, w * tl / sum(w) OVER (PARTITION BY lang) AS w FROM (
      SELECT n, source, lang, topic, tokens, ts, tl, tt, w * ts / sum(w) OVER (PARTITION BY source) AS w FROM ipf WHERE n < 60))),
p AS (SELECT source, lang, topic, w / tokens / max(w / tokens) OVER () AS p FROM ipf WHERE n = 60),
chance AS (
  SELECT d.*, CASE WHEN d.tokens > 0 THEN p.p ELSE 0 END AS p FROM described d LEFT JOIN p USING (source, lang, topic))
SELECT doc_id, source, lang, topic, tokens, round(p, 4) AS probability,
       CAST('0x' || substr(md5('0:' || doc_id), 1, 13) AS UBIGINT) / pow(2, 52) < p AS kept
FROM chance
"""


@query
def op10_mixing_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As op10_mixing, for a sample whose expected tokens are a stated share of the corpus."""
    return mix_report(table(spark, sf_dir, "documents"), SHARE)


@query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, and whether it still verifies."""
    return verified_manifest(table(spark, sf_dir, "documents"))


ORACLES["op11_merkle_manifest"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, text, CASE WHEN xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
             lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))), 4294967295) % 3 = 0
           THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS other,
         concat_ws('', coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
                   coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head
  FROM documents),
l AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         sha256(head || coalesce(strlen(other) || ':' || other, '-')) AS changed FROM d),
p AS (
  SELECT *, coalesce('+' || lang, '') AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS spot,
         count(*) OVER (PARTITION BY lang) AS n FROM l),
low AS (
  SELECT tree, 0 AS level, spot, leaf AS h, n FROM p
  UNION ALL
  SELECT tree, level + 1, spot // 8, sha256(string_agg(h, '' ORDER BY spot)), (n + 7) // 8 FROM low WHERE n > 1 GROUP BY tree, level, spot // 8, n),
top AS (SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS spot, count(*) OVER () AS n FROM low WHERE n = 1),
high AS (
  SELECT 0 AS level, spot, subroot AS h, n FROM top
  UNION ALL
  SELECT level + 1, spot // 8, sha256(string_agg(h, '' ORDER BY spot)), (n + 7) // 8 FROM high WHERE n > 1 GROUP BY level, spot // 8, n),
node AS (
  SELECT tree, level, spot, h, n FROM low WHERE n > 1
  UNION ALL
  SELECT '#', level, spot, h, n FROM high WHERE n > 1),
run AS (SELECT tree, level, spot // 8 AS run, list(h ORDER BY spot) AS hs FROM node GROUP BY tree, level, spot // 8),
fold AS (
  SELECT p.doc_id, p.leaf, p.tree AS home, p.tree, p.spot, 0 AS level, changed AS h, '' AS sibs FROM p
  UNION ALL
  SELECT f.doc_id, f.leaf, f.home,
         CASE WHEN run.run IS NULL THEN '#' ELSE f.tree END, CASE WHEN run.run IS NULL THEN top.spot ELSE f.spot // 8 END,
         CASE WHEN run.run IS NULL THEN 0 ELSE f.level + 1 END,
         CASE WHEN run.run IS NULL THEN f.h
              ELSE sha256(array_to_string(list_transform(hs, lambda x, i: CASE WHEN i = f.spot % 8 + 1 THEN f.h ELSE x END), '')) END,
         CASE WHEN run.run IS NULL THEN f.sibs
              ELSE f.sibs || array_to_string(list_filter(hs, lambda x, i: i <> f.spot % 8 + 1), '') END
  FROM fold f LEFT JOIN run ON run.tree = f.tree AND run.level = f.level AND run.run = f.spot // 8
  LEFT JOIN top ON top.tree = f.home
  WHERE run.run IS NOT NULL OR f.tree <> '#'),
last AS (
  SELECT f.* FROM fold f LEFT JOIN run ON run.tree = '#' AND run.level = f.level AND run.run = f.spot // 8
  WHERE f.tree = '#' AND run.run IS NULL)
SELECT last.doc_id, last.leaf, subroot, high.h AS root, sha256(sibs) AS proof_sha256, last.h AS folded_root, last.h = high.h AS verified
FROM last JOIN top ON top.tree = last.home, high WHERE high.n = 1
"""


@query
def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document but for windows of 20 words that start earlier elsewhere."""
    return without_repeats(table(spark, sf_dir, "documents"))


ORACLES["op12_substring_dedup"] = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
place AS (
  SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS n FROM place) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS spot FROM again),
listed AS (SELECT doc_id, count(*) AS n, list(spot) AS spots FROM gone GROUP BY doc_id),
word AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS spot FROM d),
kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY spot) AS text FROM word ANTI JOIN gone USING (doc_id, spot) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN listed USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


@query
def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizers in every document, with corpus-wide counts of linked ids."""
    return alignment_report(table(spark, sf_dir, "documents"))
