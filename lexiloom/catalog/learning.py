"""Trained models and subword vocabularies."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import ml, splits, subwords, terms, vocab, wordvec
from ..operators.terms import KEYS
from ..runtime import materialize
from ..sources import tables
from . import sql
from .registry import query
from .text import line_tokens
from .vectors import keyed_words

VECTOR_SIZE = 32
FACTORS = 300
PIECES = 12_000


SIGN_SUMS = ", ".join(
    f"CAST(sum(n * (2 * CAST((bits >> {VECTOR_SIZE - 1 - d}) & 1 AS BIGINT) - 1)) AS BIGINT)" for d in range(VECTOR_SIZE)
)
CONTEXTS = sql.TOK + f""",
near AS (
  SELECT a.word, b.word AS other, count(*) AS n FROM tok a
  JOIN tok b ON a.doc_id = b.doc_id AND a.line_no = b.line_no AND b.pos BETWEEN a.pos - 5 AND a.pos + 5 AND b.pos <> a.pos
  GROUP BY a.word, b.word),
found AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS near, [{SIGN_SUMS}] AS sums
  FROM (SELECT *, CAST('0x' || substr(md5('1:0:' || other), 1, {VECTOR_SIZE // 4}) AS UBIGINT) AS bits FROM near) GROUP BY word),
vectors AS (
  SELECT word, coalesce(near, 0) AS near, coalesce(sums, list_resize(CAST([] AS BIGINT[]), {VECTOR_SIZE}, 0)) AS sums
  FROM (SELECT DISTINCT word FROM tok) LEFT JOIN found USING (word))"""


@query(
    "context_sign_sums",
    f"WITH {CONTEXTS} SELECT word, near, {sql.digits('sums')} AS sums FROM vectors",
)
def context_sign_sums(spark, sf):
    """Summed random signs of the context words: a projection of the raw counts, nothing is learned."""
    found = ml.context_sums(keyed_words(spark, sf), VECTOR_SIZE)
    return found.select("word", "near", F.concat_ws(" ", F.transform("sums", lambda x: x.cast("string"))).alias("sums"))


@query(
    "document_context_means",
    f"""WITH {CONTEXTS}, m AS (SELECT word, list_sum(list_transform(sums, lambda x: x / CAST(greatest(near, 1) AS DOUBLE))) AS total FROM vectors),
    d AS (SELECT doc_id, line_no, count(*) AS found, round(avg(total), 5) AS total FROM tok JOIN m USING (word) GROUP BY doc_id, line_no)
    SELECT l.doc_id || ':' || l.line_no AS key, coalesce(found, 0) AS found, coalesce(total, 0.0) AS total, CAST({VECTOR_SIZE} AS INTEGER) AS dim
    FROM lines l LEFT JOIN d USING (doc_id, line_no)""",
)
def document_context_means(spark, sf):
    """Mean of the projected contexts of a line's words."""
    words = keyed_words(spark, sf)
    found = ml.document_vectors(words, "key", ml.context_vectors(words, VECTOR_SIZE), VECTOR_SIZE)
    total = F.aggregate("centroid", F.lit(0.0), lambda s, x: s + x)
    return found.select("key", "found", F.round(total, 5).alias("total"), F.size("centroid").alias("dim"))


PAIRS = sql.TOK + """,
half AS (
  SELECT least(a.word, b.word) AS word, greatest(a.word, b.word) AS other FROM tok a
  JOIN tok b ON a.doc_id = b.doc_id AND a.line_no = b.line_no AND b.pos BETWEEN a.pos + 1 AND a.pos + 5),
pairs AS (SELECT word, other, count(*) AS n FROM half GROUP BY word, other)"""


@query("word_cooccurrences", f"WITH {PAIRS} SELECT word, other, n FROM pairs")
def word_cooccurrences(spark, sf):
    """How often two words stand within five places of a line."""
    return wordvec.cooccurrences(keyed_words(spark, sf))


@query(
    "word_information",
    f"""WITH {PAIRS},
    near AS (
      SELECT word, CAST(sum(n) AS DOUBLE) AS near FROM (
        SELECT word, n * CASE WHEN word = other THEN 2 ELSE 1 END AS n FROM pairs
        UNION ALL SELECT other, n FROM pairs WHERE word <> other) GROUP BY word),
    cell AS (
      SELECT p.word, other, n * CASE WHEN p.word = other THEN 2 ELSE 1 END AS n, a.near * b.near AS expected
      FROM pairs p JOIN near a ON a.word = p.word JOIN near b ON b.word = other)
    SELECT word, other, n, round(ln(n * (SELECT sum(near) FROM near) / expected), 6) AS value
    FROM cell WHERE ln(n * (SELECT sum(near) FROM near) / expected) > 1e-9""",
)
def word_information(spark, sf):
    """Positive mutual information of the pairs: the table that word vectors factorise."""
    cells, _ = wordvec.mutual_information(wordvec.cooccurrences(keyed_words(spark, sf)))
    return cells.filter("value > 1e-9").select("word", "other", "n", F.round("value", 6).alias("value"))


@query("train_word_vectors")
def train_word_vectors(spark, sf):
    """A learned vector of every word."""
    return wordvec.train_word_vectors(keyed_words(spark, sf), FACTORS)


@query("document_vectors")
def document_vectors(spark, sf):
    """Every line folded into the learned word vectors."""
    words = keyed_words(spark, sf)
    return wordvec.document_vectors(words, "key", wordvec.train_word_vectors(words, FACTORS), FACTORS)


def fold_tokens(spark, sf):
    """Labelled documents with their fold and tokens."""
    rows = splits.kfold_assign(tables.labelled(spark, sf), ["doc_id"], 5, 12)
    tokens = text.tokenize_space(text.clean_english_text(F.col("text"))).alias("tokens")
    return rows.select("doc_id", tokens, "label", "fold")


@query(
    "kfold_classifier",
    f"""WITH {sql.LABELLED}, d AS (
      SELECT doc_id, label, CAST(ntile(5) OVER (ORDER BY {sql.digest(12, 'doc_id')}, doc_id) - 1 AS INTEGER) AS fold,
             string_split({sql.clean_english('text')}, ' ') AS w FROM labelled),
    t AS (SELECT doc_id, label, fold, word, count(*) AS n FROM (SELECT doc_id, label, fold, unnest(w) AS word FROM d) GROUP BY ALL),
    own AS (SELECT word, fold, sum(n) FILTER (label = 1) AS p, sum(n) FILTER (label = 0) AS q FROM t GROUP BY word, fold),
    every AS (SELECT word, coalesce(sum(p), 0) AS p, coalesce(sum(q), 0) AS q FROM own GROUP BY word),
    whole AS (SELECT sum(p) AS p, sum(q) AS q, count(*) AS v FROM every),
    part AS (SELECT fold, coalesce(sum(p), 0) AS p, coalesce(sum(q), 0) AS q FROM own GROUP BY fold),
    score AS (
      SELECT t.doc_id, sum(n * (ln((every.p - coalesce(own.p, 0) + 1) / CAST(whole.p - part.p + v AS DOUBLE))
                              - ln((every.q - coalesce(own.q, 0) + 1) / CAST(whole.q - part.q + v AS DOUBLE)))) AS s
      FROM t JOIN every USING (word) JOIN own USING (word, fold) JOIN part USING (fold), whole GROUP BY t.doc_id),
    prior AS (
      SELECT fold, ln((1 + (SELECT count(*) FROM d WHERE label = 1) - count(*) FILTER (label = 1))
                    / CAST(1 + (SELECT count(*) FROM d WHERE label = 0) - count(*) FILTER (label = 0) AS DOUBLE)) AS s FROM d GROUP BY fold),
    logit AS (SELECT fold, label, score.s + prior.s AS x FROM d JOIN score USING (doc_id) JOIN prior USING (fold))
    SELECT fold, count(*) AS n, CAST(sum(label) AS BIGINT) AS positives,
           round(avg(greatest(x, 0) - x * label + ln(1 + exp(-abs(x)))), 4) AS loss,
           round(avg(CASE WHEN (x > 0) = (label = 1) THEN 1.0::DOUBLE ELSE 0 END), 6) AS acc FROM logit GROUP BY fold""",
)
def kfold_classifier(spark, sf):
    """Held-out rows, loss and accuracy of each fold of a naive Bayes classifier."""
    found = ml.kfold_bayes(fold_tokens(spark, sf), "doc_id", "tokens", "label", "fold", 5)
    return found.select("fold", "n", "positives", F.round("loss", 4).alias("loss"), F.round("acc", 6).alias("acc"))


@query("kfold_logistic")
def kfold_logistic(spark, sf):
    """Held-out loss and accuracy of each fold of a logistic classifier over hashed tf-idf."""
    return ml.kfold_classifier(fold_tokens(spark, sf), "tokens", "label", "fold", 5)


def words_of(spark, sf):
    return materialize(terms.word_counts(line_tokens(spark, sf)), "words")


@query(
    "subword_pair_counts",
    f"""WITH {sql.TOK}, w AS (SELECT word, count(*) AS cnt FROM tok GROUP BY word),
    s AS (SELECT cnt, list_transform(string_split(word, ''), lambda c, i: CASE WHEN i = 1 THEN c ELSE '##' || c END) AS p FROM w),
    q AS (SELECT cnt, p, unnest(range(1, len(p))) AS i FROM s WHERE len(p) > 1)
    SELECT p[i] AS a, p[i + 1] AS b, CAST(sum(cnt) AS BIGINT) AS cnt FROM q GROUP BY ALL""",
)
def subword_pair_counts(spark, sf):
    """One step of the merge loop."""
    return subwords.pair_counts(subwords.word_symbols(words_of(spark, sf)))


@query("train_subwords")
def train_subwords(spark, sf):
    return subwords.train_subwords(words_of(spark, sf), PIECES)


# A given vocabulary: specials, the letters of the corpus, then its 500 most common longer words, all
# but the specials with and without the continuation mark.
GIVEN = sql.COUNTS + """,
letters AS (SELECT DISTINCT unnest(string_split(token, '')) AS p FROM counts),
common AS (SELECT token AS p FROM counts WHERE length(token) > 1 ORDER BY cnt DESC, first LIMIT 500),
plain AS (SELECT p FROM letters WHERE p <> '' UNION SELECT p FROM common),
pieces AS (
  SELECT piece, CAST(row_number() OVER (ORDER BY encode(piece)) + 4 AS INTEGER) AS id
  FROM (SELECT p AS piece FROM plain UNION SELECT '##' || p FROM plain))"""


def given_pieces(spark, sf):
    """token, id of the given vocabulary; at most the letters and 500 words, twice."""
    counts = materialize(vocab.token_counts(line_tokens(spark, sf)), "counts")
    letters = counts.select(F.explode(F.split("token", "")).alias("p")).filter("p <> ''")
    common = counts.filter(F.length("token") > 1).orderBy(F.desc("cnt"), "first").limit(500).select(F.col("token").alias("p"))
    plain = letters.union(common).distinct()
    marked = plain.union(plain.select(F.concat(F.lit(subwords.MARK), "p"))).distinct()
    order = Window.orderBy("p")  # as long as the vocabulary
    first = len(subwords.PIECE_SPECIALS)
    return marked.select(F.col("p").alias("token"), (F.row_number().over(order) + first - 1).cast("int").alias("id"))


@query(
    "encode_subwords",
    f"""WITH RECURSIVE {GIVEN},
    cut AS (
      SELECT token, spot, unnest(range(1, length(token) - spot + 2)) AS n
      FROM (SELECT token, unnest(range(1, length(token) + 1)) AS spot FROM counts)),
    longest AS (
      SELECT token, spot, max(n) AS n, max_by(id, n) AS id
      FROM cut JOIN pieces ON piece = CASE WHEN spot > 1 THEN '##' ELSE '' END || substr(token, spot, n) GROUP BY token, spot),
    step AS (
      SELECT token, CAST(1 AS BIGINT) AS spot, CAST([] AS INTEGER[]) AS ids FROM counts
      UNION ALL
      SELECT s.token, s.spot + coalesce(m.n, 1000000), list_append(s.ids, coalesce(m.id, -1))
      FROM step s LEFT JOIN longest m ON m.token = s.token AND m.spot = s.spot WHERE s.spot <= length(s.token)),
    words AS (
      SELECT token, CASE WHEN list_contains(ids, -1) THEN [1] ELSE ids END AS ids
      FROM step WHERE spot > length(token)),
    body AS (
      SELECT doc_id, line_no, flatten(list(ids ORDER BY pos))[1:254] AS ids
      FROM tok JOIN words ON words.token = tok.word GROUP BY doc_id, line_no)
    SELECT l.doc_id, l.line_no, len(f) AS n_ids, md5({sql.digits('f')}) AS ids_md5
    FROM (SELECT doc_id, line_no, list_concat([2], list_concat(coalesce(ids, CAST([] AS INTEGER[])), [3])) AS f
          FROM lines LEFT JOIN body USING (doc_id, line_no)) l""",
)
def encode_subwords(spark, sf):
    """Greedy longest match over a given vocabulary."""
    coded = subwords.encode_subwords(line_tokens(spark, sf), given_pieces(spark, sf), KEYS)
    ids = F.transform("ids", lambda x: x.cast("string"))
    return coded.select(*KEYS, F.size("ids").cast("bigint").alias("n_ids"), F.md5(F.concat_ws(" ", ids)).alias("ids_md5"))


@query("train_and_encode_subwords")
def train_and_encode_subwords(spark, sf):
    """The lines in pieces of the vocabulary learned from them."""
    learned = subwords.train_subwords(words_of(spark, sf), PIECES)
    coded = subwords.encode_subwords(line_tokens(spark, sf), learned, KEYS)
    return coded.select(*KEYS, F.size("ids").alias("n_ids"), F.array_max("ids").alias("largest"))
