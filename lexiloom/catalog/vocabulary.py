"""Vocabularies, encoding, framing and padding."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays
from ..operators import encode, ranking, vocab
from ..operators.encode import render, render_padded
from ..operators.joins import map_labels as join_labels
from ..operators.terms import KEYS
from ..runtime import materialize, scratch_path
from ..sources import tables
from . import sql
from .registry import query
from .text import line_tokens

SIZE = 3000


def common_vocab(spark, sf, size: int = SIZE):
    return materialize(vocab.most_common_vocab(vocab.token_counts(line_tokens(spark, sf)), size), "vocab")


def coded_lines(spark, sf):
    return encode.encode_tokens(line_tokens(spark, sf), common_vocab(spark, sf))


def line_batches(spark, sf, size: int = 64):
    """Batch of each line and the most tokens of a line of the batch, from keys and sizes only."""
    sizes = line_tokens(spark, sf).select(*KEYS, F.size("tokens").alias("n"))
    return encode.batch_longest(sizes, "n", KEYS, size)


def padded_lines(spark, sf):
    """Coded lines padded with zeros to the longest of their batch of 64."""
    rows = coded_lines(spark, sf).join(line_batches(spark, sf), KEYS)
    return rows.withColumn("ids", arrays.pad_fixed(F.col("ids"), F.col("longest")))


def pair_sides(spark, sf, size: int = 6000):
    """Conversation pairs as token arrays, and the vocabulary of each side."""
    from ..functions.text import normalize_line, tokenize_space

    pairs = materialize(
        tables.pairs(spark, sf).select(
            "conv_id",
            "turn",
            tokenize_space(normalize_line(F.col("src"))).alias("src_tokens"),
            tokenize_space(normalize_line(F.col("dst"))).alias("dst_tokens"),
        ),
        "pairs",
    )
    words = []
    for side in ("src_tokens", "dst_tokens"):
        counts = vocab.token_counts(pairs.select("conv_id", "turn", F.col(side).alias("tokens")), ["conv_id", "turn"])
        words.append(materialize(vocab.most_common_vocab(counts, size), "vocab"))
    return pairs, words[0], words[1]


@query(
    "first_seen_ids",
    f"WITH {sql.COUNTS} SELECT token, cnt, CAST(row_number() OVER (ORDER BY first) + 3 AS INTEGER) AS id FROM counts",
)
def first_seen_ids(spark, sf):
    return vocab.first_seen_vocab(vocab.token_counts(line_tokens(spark, sf)))


@query("most_common_vocab", f"WITH {sql.VOCAB} SELECT token, cnt, id FROM vocab")
def most_common_vocab(spark, sf):
    return vocab.most_common_vocab(vocab.token_counts(line_tokens(spark, sf)), SIZE)


@query(
    "top_words",
    f"WITH {sql.COUNTS} SELECT token, cnt FROM counts ORDER BY cnt DESC, first LIMIT 100",
)
def top_words(spark, sf):
    return vocab.top_words(vocab.token_counts(line_tokens(spark, sf)), 100).select("token", "cnt")


@query(
    "min_freq_vocab",
    f"""WITH {sql.COUNTS} SELECT token, cnt, CAST(row_number() OVER (ORDER BY cnt DESC, token) + 3 AS INTEGER) AS id
    FROM counts WHERE cnt >= 2""",
)
def min_freq_vocab(spark, sf):
    return vocab.min_freq_vocab(vocab.token_counts(line_tokens(spark, sf)), 2)


@query(
    "sink_vocab",
    f"""WITH {sql.VOCAB} SELECT token, id, cnt FROM vocab
    UNION ALL SELECT * FROM (VALUES ('<PAD>', 0, 0), ('<UNK>', 1, 0), ('<SOS>', 2, 0), ('<EOS>', 3, 0)) s(token, id, cnt)""",
)
def sink_vocab(spark, sf):
    path = scratch_path(spark, "vocabulary")
    vocab.save_vocab(vocab.with_specials(common_vocab(spark, sf)), path)
    return vocab.load_vocab(spark, path)


CHARS = sql.VOCAB + """,
letters AS (
  SELECT id, ch, i - 1 AS pos FROM (
    SELECT id, unnest(string_split(token, '')) AS ch, generate_subscripts(string_split(token, ''), 1) AS i FROM vocab)
),
ch_counts AS (SELECT ch AS token, count(*) AS cnt, min(CAST(id AS BIGINT) * 1000000 + pos) AS first FROM letters GROUP BY ch),""" + sql.vocab(
    2000, 4, "ch_counts", "ch_vocab"
)


@query("char_counts", f"WITH {CHARS} SELECT token AS ch, cnt, id FROM ch_vocab")
def char_counts(spark, sf):
    return vocab.char_vocab(vocab.char_counts(common_vocab(spark, sf)))


@query("encode_tokens", f"WITH {sql.CODED} SELECT doc_id, line_no, {sql.digits('ids')} AS ids FROM coded")
def encode_tokens(spark, sf):
    return coded_lines(spark, sf).select(*KEYS, render(F.col("ids")).alias("ids"))


DECODED = sql.CODED + """,
decoded AS (
  SELECT c.doc_id, c.line_no, coalesce(t.text, '') AS text FROM coded c LEFT JOIN (
    SELECT doc_id, line_no, string_agg(token, ' ' ORDER BY pos) AS text
    FROM tok JOIN vocab ON vocab.token = tok.word GROUP BY doc_id, line_no) t USING (doc_id, line_no)
)"""


@query("decode_ids", f"WITH {DECODED} SELECT doc_id, line_no, text FROM decoded")
def decode_ids(spark, sf):
    words = common_vocab(spark, sf)
    return encode.decode_ids(encode.encode_tokens(line_tokens(spark, sf), words), words)


@query("sink_decoded", f"WITH {DECODED} SELECT text AS value FROM decoded")
def sink_decoded(spark, sf):
    from ..sources.sinks import write_text

    path = scratch_path(spark, "decoded")
    write_text(decode_ids(spark, sf), F.col("text"), path)
    return spark.read.text(path)


@query(
    "frame_sequence",
    f"""WITH {sql.CODED} SELECT doc_id, line_no, {sql.digits('list_concat([2], list_concat(list_reverse(ids), [3]))')} AS ids FROM coded""",
)
def frame_sequence(spark, sf):
    return encode.frame_all(coded_lines(spark, sf), "ids", reverse=True).select(*KEYS, render(F.col("ids")).alias("ids"))


@query(
    "pad_fixed",
    f"""WITH {sql.CODED} SELECT doc_id, line_no,
      {sql.digits('list_resize(ids[1:128], 128, 0)')} AS ids FROM coded""",
)
def pad_fixed(spark, sf):
    return coded_lines(spark, sf).select(*KEYS, render(arrays.pad_fixed(F.col("ids"), 128)).alias("ids"))


@query(
    "pad_batch",
    f"""WITH {sql.CODED}, b AS (SELECT *, (row_number() OVER (ORDER BY doc_id, line_no) - 1) // 64 AS batch FROM coded),
    p AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch) AS longest FROM b)
    SELECT doc_id, line_no, batch, longest AS padded, md5({sql.digits('list_resize(ids, longest, 1)')}) AS ids_md5 FROM p""",
)
def pad_batch(spark, sf):
    rows = coded_lines(spark, sf).join(line_batches(spark, sf), KEYS)
    padded = render_padded(F.col("ids"), F.col("longest") - F.size("ids"), arrays.UNK)
    return rows.select(*KEYS, "batch", F.col("longest").cast("bigint").alias("padded"), F.md5(padded).alias("ids_md5"))


@query(
    "max_length",
    f"""WITH {sql.CODED}, b AS (SELECT *, (row_number() OVER (ORDER BY doc_id, line_no) - 1) // 64 AS batch FROM coded)
    SELECT batch, least(max(len(ids)), 512) AS longest FROM b GROUP BY batch""",
)
def max_length(spark, sf):
    sized = line_tokens(spark, sf).select(*KEYS, F.size("tokens").alias("n"))
    return ranking.batch_rows(sized, KEYS, 64, keys_from=tables.lines(spark, sf)).groupBy("batch").agg(
        F.least(F.max("n"), F.lit(512)).cast("bigint").alias("longest")
    )


@query(
    "char_grid",
    f"""WITH {CHARS},{sql.CODED.split(sql.VOCAB + ',', 1)[1]},
    framed AS (SELECT doc_id, line_no, list_concat([2], list_concat(ids, [3])) AS ids,
                      (row_number() OVER (ORDER BY doc_id, line_no) - 1) // 64 AS batch FROM coded),
    rows_ AS (
      SELECT id, list_resize(list(coalesce(v.ch_id, 1) ORDER BY pos)[1:10], 10, 0) AS chars
      FROM letters LEFT JOIN (SELECT token AS ch, id AS ch_id FROM ch_vocab) v USING (ch) GROUP BY id
      UNION ALL SELECT i, list_resize([CAST(i AS INTEGER)], 10, 0) FROM (VALUES (1), (2), (3)) s(i)
    ),
    cells AS (SELECT doc_id, line_no, batch, unnest(ids) AS id, generate_subscripts(ids, 1) AS pos FROM framed),
    grids AS (SELECT doc_id, line_no, batch, count(*) AS n, string_agg({sql.digits('chars')}, ' ' ORDER BY pos) AS g
              FROM cells JOIN rows_ USING (id) GROUP BY doc_id, line_no, batch),
    padded AS (SELECT *, max(n) OVER (PARTITION BY batch) AS longest FROM grids)
    SELECT doc_id, line_no, batch, longest AS n_rows, md5(g || repeat(' 0', CAST((longest - n) * 10 AS BIGINT))) AS grid_md5 FROM padded""",
)
def char_grid(spark, sf):
    words = common_vocab(spark, sf)
    chars = materialize(vocab.char_vocab(vocab.char_counts(words)), "chars")
    framed = encode.frame_all(encode.encode_tokens(line_tokens(spark, sf), words), "ids")
    rows = framed.join(line_batches(spark, sf), KEYS).withColumn("longest", F.col("longest") + 2)
    table = materialize(encode.word_char_rows(words, chars), "wordchars")
    grids = encode.char_grid_texts(rows, table, [*KEYS, "batch", "longest"])
    grid = encode.padded_text(F.col("text"), (F.col("longest") - F.col("n_rows")) * 10, arrays.PAD)
    return grids.select(
        *KEYS,
        "batch",
        F.col("longest").cast("bigint").alias("n_rows"),
        F.md5(grid).alias("grid_md5"),
    )


@query(
    "attention_mask",
    f"""WITH {sql.PADDED}
    SELECT doc_id, line_no, {sql.digits('list_transform(ids, lambda x: CASE WHEN x <> 0 THEN 1 ELSE 0 END)')} AS mask FROM padded""",
)
def attention_mask(spark, sf):
    rows = coded_lines(spark, sf).join(line_batches(spark, sf), KEYS)
    mask = render_padded(arrays.attention_mask(F.col("ids")), F.col("longest") - F.size("ids"), 0)
    return rows.select(*KEYS, mask.alias("mask"))


@query(
    "shift_targets",
    f"""WITH {sql.CODED}, f AS (SELECT doc_id, line_no, list_concat([2], list_concat(ids, [3])) AS ids FROM coded)
    SELECT doc_id, line_no, {sql.digits('ids[1:len(ids) - 1]')} AS inputs, {sql.digits('ids[2:len(ids)]')} AS targets FROM f""",
)
def shift_targets(spark, sf):
    framed = encode.frame_all(coded_lines(spark, sf), "ids")
    return framed.select(
        *KEYS,
        render(arrays.shift_inputs(F.col("ids"))).alias("inputs"),
        render(arrays.shift_targets(F.col("ids"))).alias("targets"),
    )


@query(
    "map_labels",
    f"""WITH {sql.LINES}, first AS (SELECT source, min(doc_id) AS d FROM lines GROUP BY source),
    ids AS (SELECT source, CAST(row_number() OVER (ORDER BY d) - 1 AS INTEGER) AS label_id FROM first)
    SELECT doc_id, line_no, source, label_id FROM lines JOIN ids USING (source)""",
)
def map_labels(spark, sf):
    lines = tables.lines(spark, sf).select(*KEYS, "source")
    index = materialize(
        vocab.label_index(tables.table(spark, sf, "documents").select("doc_id", "source"), "source", ["doc_id"]), "labels"
    )
    return join_labels(lines, index, "source")
