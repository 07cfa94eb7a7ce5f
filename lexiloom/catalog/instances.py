"""Training instances."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays, text
from ..operators import encode, instances, splits, vocab
from ..operators.encode import render
from ..operators.terms import KEYS
from ..runtime import materialize
from ..sources import tables
from . import sql
from .registry import query
from .text import line_tokens
from .vocabulary import pair_sides

WORDS = 3000
SEED = 11

NUMBERED = """
numbered AS (SELECT *, row_number() OVER (ORDER BY doc_id, line_no) - 1 AS r, count(*) OVER () AS n FROM {0})"""


def partners(table: str) -> str:
    follows = f"({sql.unit(sql.digest(SEED, 'doc_id', 'line_no'))} > CAST(0.5 AS DOUBLE) AND line_no < n_lines)"
    jump = f"{sql.hash_int(sql.digest(f'{SEED}x', 'doc_id', 'line_no'))} % (n - 2)"
    return NUMBERED.format(table) + f""",
chosen AS (
  SELECT *, CAST({follows} AS INTEGER) AS nsp, CASE WHEN {follows} THEN r + 1 ELSE (r + 2 + {jump}) % n END AS partner FROM numbered
)"""


@query(
    "next_sentence_pairs",
    f"""WITH {sql.LINES},{partners('lines')}
    SELECT c.doc_id, c.line_no, c.r, c.nsp, c.line, b.line AS line_b FROM chosen c JOIN numbered b ON b.r = c.partner""",
)
def next_sentence_pairs(spark, sf):
    return instances.next_sentence_pairs(tables.lines(spark, sf).select(*KEYS, "n_lines", "line"), SEED)


# Word ids start at 5 behind the five special tokens.
CODES = sql.COUNTS + "," + sql.vocab(WORDS, 5) + """,
coded AS (
  SELECT l.doc_id, l.line_no, l.n_lines, coalesce(c.ids, CAST([] AS INTEGER[])) AS ids
  FROM ltok l LEFT JOIN (
    SELECT doc_id, line_no, list(coalesce(v.id, 1) ORDER BY pos) AS ids
    FROM tok LEFT JOIN vocab v ON v.token = tok.word GROUP BY doc_id, line_no
  ) c USING (doc_id, line_no)
)"""

JOINED = CODES + "," + partners("coded") + """,
sized AS (
  SELECT c.doc_id, c.line_no, c.nsp, c.ids AS a, b.ids AS b, len(c.ids) AS na, len(b.ids) AS nb
  FROM chosen c JOIN numbered b ON b.r = c.partner
),
cuts AS (SELECT *, least(least(na, nb), 126) AS s FROM sized),
cuts2 AS (SELECT *, least(greatest(na, nb), 253 - s) AS l FROM cuts),
joined AS (
  SELECT doc_id, line_no, nsp, list_concat([2], list_concat(a[1:CASE WHEN na <= nb THEN s ELSE l END],
         list_concat([3], list_concat(b[1:CASE WHEN na <= nb THEN l ELSE s END], [3])))) AS ids FROM cuts2
)"""


def masking(source: str, vocab_size: int) -> str:
    d = sql.digest(SEED, "doc_id", "line_no", "i")
    rand = f"CAST(5 + {sql.hash_int(sql.digest(f'{SEED}r', 'doc_id', 'line_no', 'i'))} % {vocab_size - 5} AS INTEGER)"
    return f"""
cells AS (SELECT doc_id, line_no, unnest(ids) AS x, generate_subscripts(ids, 1) - 1 AS i FROM {source}),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, line_no, x IN (2, 3) ORDER BY {d}, i) AS k,
         count(*) OVER (PARTITION BY doc_id, line_no, x IN (2, 3)) AS m FROM cells
),
limits AS (SELECT *, CASE WHEN x IN (2, 3) THEN 0 ELSE ceil(m * CAST(0.3 AS DOUBLE)) END AS t FROM ranked),
limits2 AS (SELECT *, ceil(t * CAST(0.8 AS DOUBLE)) AS mm FROM limits),
limits3 AS (SELECT *, ceil((t - mm) * CAST(0.5 AS DOUBLE)) AS rr FROM limits2),
masked AS (
  SELECT doc_id, line_no,
    list(CASE WHEN k <= mm THEN 4 WHEN k <= mm + rr THEN {rand} ELSE x END ORDER BY i) AS inputs,
    list(CASE WHEN k <= t THEN 1 ELSE 0 END ORDER BY i) AS marks,
    list(x ORDER BY i) AS labels
  FROM limits3 GROUP BY doc_id, line_no
)"""


def coded_lines(spark, sf):
    lines = tables.lines(spark, sf).select(*KEYS, "n_lines", text.keyword_tokens(F.col("line")).alias("tokens"))
    words = materialize(vocab.most_common_vocab(vocab.token_counts(lines), WORDS, arrays.FIRST_PIECE), "vocab")
    return materialize(encode.encode_tokens(lines, words, [*KEYS, "n_lines"]), "coded")


@query(
    "segment_ids",
    f"""WITH {JOINED} SELECT doc_id, line_no,
      md5({sql.digits('list_transform(ids, lambda x, i: CASE WHEN i <= list_position(ids, 3) THEN 1 ELSE 2 END)')}) AS segments_md5,
      list_position(ids, 3) AS first_sep FROM joined""",
)
def segment_ids(spark, sf):
    pairs = instances.next_sentence_pairs(coded_lines(spark, sf), SEED, carry=["ids"])
    joined = pairs.select(*KEYS, instances.join_pair(F.col("ids"), F.col("ids_b")).alias("ids"))
    return joined.select(
        *KEYS,
        F.md5(render(arrays.segment_ids(F.col("ids")))).alias("segments_md5"),
        F.array_position("ids", F.lit(arrays.SEP)).cast("int").alias("first_sep"),
    )


@query(
    "mask_tokens",
    f"""WITH {CODES}, framed AS (SELECT doc_id, line_no, list_concat([2], list_concat(ids, [3])) AS ids FROM coded),{masking('framed', WORDS + 5)}
    SELECT doc_id, line_no, {sql.digits('inputs')} AS inputs, {sql.digits('marks')} AS marks, {sql.digits('labels')} AS labels FROM masked""",
)
def mask_tokens(spark, sf):
    framed = coded_lines(spark, sf).select(*KEYS, arrays.frame_sequence(F.col("ids")).alias("ids"))
    masked = instances.mask_tokens(framed, KEYS, WORDS + arrays.FIRST_PIECE, SEED)
    return masked.select(*KEYS, *[render(F.col(c)).alias(c) for c in ("inputs", "marks", "labels")])


def padded(x: str) -> str:
    return f"md5({sql.digits(f'list_resize({x}, 256, 0)')})"


@query(
    "nsp_mlm_instances",
    f"""WITH {JOINED},{masking('joined', WORDS + 5)}
    SELECT doc_id, line_no, nsp, {padded('inputs')} AS inputs_md5,
      {padded('list_transform(ids, lambda x, i: CASE WHEN i <= list_position(ids, 3) THEN 1 ELSE 2 END)')} AS segments_md5,
      {padded('list_transform(ids, lambda x: 1)')} AS attention_md5,
      {padded('labels')} AS labels_md5, {padded('marks')} AS marks_md5, CAST(list_sum(marks) AS BIGINT) AS n_marks
    FROM joined JOIN masked USING (doc_id, line_no)""",
)
def nsp_mlm_instances(spark, sf):
    made = instances.nsp_mlm_instances(coded_lines(spark, sf), WORDS + arrays.FIRST_PIECE, SEED, texts=True)
    return made.select(
        *KEYS,
        "nsp",
        *[F.md5(c).alias(f"{c}_md5") for c in instances.INSTANCE],
        F.length(F.translate("marks", " 0", "")).cast("bigint").alias("n_marks"),
    )


@query(
    "seq2seq_instances",
    f"""WITH {sql.pair_codes()},
    framed AS (
      SELECT conv_id, turn, list_concat([2], list_concat(list_reverse(src_ids), [3])) AS src, list_concat([2], list_concat(dst_ids, [3])) AS dst,
             (row_number() OVER (ORDER BY conv_id, turn) - 1) // 32 AS batch FROM src_codes JOIN dst_codes USING (conv_id, turn)
    ),
    sized AS (SELECT *, max(len(src)) OVER (PARTITION BY batch) AS ls, max(len(dst)) OVER (PARTITION BY batch) AS ld,
              row_number() OVER (PARTITION BY batch ORDER BY len(src) DESC, conv_id, turn) - 1 AS slot FROM framed)
    SELECT conv_id, turn, batch, CAST(slot AS INTEGER) AS slot, len(src) AS src_len,
      {sql.digits('list_resize(src, ls, 0)')} AS src, {sql.digits('list_resize(dst, ld, 0)')} AS dst FROM sized""",
)
def seq2seq_instances(spark, sf):
    pairs, src_words, dst_words = pair_sides(spark, sf)
    made = instances.seq2seq_instances(pairs, src_words, dst_words, ["conv_id", "turn"], 32)
    return made.select(
        "conv_id",
        "turn",
        "batch",
        "slot",
        F.col("src_len").cast("bigint").alias("src_len"),
        render(F.col("src")).alias("src"),
        render(F.col("dst")).alias("dst"),
    )


@query(
    "classifier_instances",
    f"""WITH {sql.LABELLED}, split AS (SELECT *, r < ceil(n * CAST(0.9 AS DOUBLE)) AS is_train FROM {sql.hash_order('labelled', 0, 'doc_id')}),
    words AS (SELECT doc_id, label, is_train, string_split({sql.clean_english('text')}, ' ') AS w FROM split),
    ctok AS (SELECT doc_id, is_train, unnest(w) AS token, generate_subscripts(w, 1) - 1 AS pos FROM words),
    cvocab AS (SELECT token, CAST(row_number() OVER (ORDER BY first) + 3 AS INTEGER) AS id FROM (
      SELECT token, min(doc_id * 1000000 + pos) AS first FROM ctok WHERE is_train GROUP BY token)),
    ids AS (SELECT doc_id, list(coalesce(id, 1) ORDER BY pos) AS ids FROM ctok LEFT JOIN cvocab USING (token) GROUP BY doc_id)
    SELECT doc_id, is_train, {sql.digits('list_resize(ids[1:128], 128, 0)')} AS x, label AS y FROM words JOIN ids USING (doc_id)""",
)
def classifier_instances(spark, sf):
    """The vocabulary comes from the training part only and is reused for the rest."""
    parts = splits.train_test_split(tables.labelled(spark, sf), ["doc_id"], 0.9, 0)
    rows = materialize(
        parts.select("doc_id", "label", "is_train", text.tokenize_space(text.clean_english_text(F.col("text"))).alias("tokens")),
        "classifier",
    )
    counts = vocab.token_counts(rows.filter("is_train").select("doc_id", "tokens"), ["doc_id"])
    words = materialize(vocab.first_seen_vocab(counts), "vocab")
    made = instances.classifier_instances(rows, words, "doc_id")
    return made.join(rows.select("doc_id", "is_train"), "doc_id").select(
        "doc_id", "is_train", render(F.col("x")).alias("x"), "y"
    )
