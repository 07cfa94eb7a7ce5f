"""Evaluation aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays
from ..operators import encode, evaluate, ranking, splits, terms
from ..operators.joins import lookup_join
from ..operators.terms import KEYS
from ..runtime import materialize
from ..sources import tables
from . import sql
from .registry import query
from .text import line_tokens
from .vectors import F1, KNN, knn_table
from .vocabulary import DECODED, coded_lines, common_vocab, padded_lines

# A score per labelled document, from its length.
SCORED = """
scored AS (
  SELECT *, CAST(round_even(1 / (1 + exp(-logit)), 0) AS INTEGER) AS pred,
         greatest(logit, 0.0) - logit * label + ln(1 + exp(-abs(logit))) AS loss
  FROM (SELECT d.doc_id, CAST(l.quality AS INTEGER) AS label, (d.n_chars - 600) / CAST(300 AS DOUBLE) AS logit
        FROM documents d JOIN labels l ON l.doc_id = d.doc_id)
)"""


def scored(spark, sf):
    marks = tables.table(spark, sf, "labels").select("doc_id", F.col("quality").cast("int").alias("label"))
    docs = tables.table(spark, sf, "documents").select("doc_id", ((F.col("n_chars") - 600) / 300.0).alias("logit"))
    rows = docs.join(marks, "doc_id")
    return rows.select(
        "doc_id",
        "label",
        "logit",
        arrays.sigmoid_round(F.col("logit")).alias("pred"),
        evaluate.binary_loss(F.col("logit"), F.col("label")).alias("loss"),
    )


BATCHED = SCORED + ", batched AS (SELECT *, (row_number() OVER (ORDER BY doc_id) - 1) // 32 AS batch FROM scored)"


@query(
    "accuracy",
    f"""WITH {BATCHED}, b AS (SELECT batch, avg(CAST(label = pred AS INTEGER)) AS acc, count(*) FILTER (label = pred) AS hits, count(*) AS n FROM batched GROUP BY batch)
    SELECT round(sum(hits) / CAST(sum(n) AS DOUBLE), 6) AS accuracy, round(avg(acc), 6) AS batch_accuracy FROM b""",
)
def accuracy(spark, sf):
    rows = ranking.batch_rows(scored(spark, sf), ["doc_id"], 32)
    found = evaluate.accuracy(rows, "label", "pred", "batch")
    return found.select(*[F.round(c, 6).alias(c) for c in found.columns])


@query(
    "macro_f1",
    f"""WITH {KNN},{F1} SELECT round(avg(f), 6) AS macro_f1 FROM f1""",
)
def macro_f1(spark, sf):
    found = evaluate.macro_f1(knn_table(spark, sf), "label", "pred")
    return found.select(F.round("macro_f1", 6).alias("macro_f1"))


@query(
    "batch_macro_f1",
    f"""WITH {BATCHED}, c AS (
      SELECT DISTINCT batch, unnest([label, pred]) AS c FROM batched),
    f AS (SELECT c.batch, c.c, count(*) FILTER (b.label = c.c AND b.pred = c.c) AS tp, count(*) FILTER (b.label = c.c) AS l, count(*) FILTER (b.pred = c.c) AS p
          FROM c JOIN batched b ON b.batch = c.batch GROUP BY c.batch, c.c)
    SELECT round(avg(m), 6) AS batch_macro_f1 FROM (SELECT batch, avg(2 * CAST(tp AS DOUBLE) / (l + p)) AS m FROM f GROUP BY batch)""",
)
def batch_macro_f1(spark, sf):
    rows = ranking.batch_rows(scored(spark, sf), ["doc_id"], 32)
    return evaluate.batch_macro_f1(rows, "label", "pred", "batch").select(
        F.round("batch_macro_f1", 6).alias("batch_macro_f1")
    )


CELLS = sql.PADDED + """,
cells AS (SELECT doc_id, line_no, unnest(ids) AS label FROM padded)"""


def real_ids(spark, sf):
    """The ids of batch-padded lines that are no padding."""
    return padded_lines(spark, sf).select(*KEYS, arrays.real_ids(F.col("ids")).alias("ids"))


@query(
    "ignore_padding",
    f"""WITH {CELLS} SELECT doc_id, line_no, count(*) AS kept, CAST(sum(label) AS BIGINT) AS total FROM cells WHERE label <> 0 GROUP BY doc_id, line_no""",
)
def ignore_padding(spark, sf):
    total = F.aggregate("ids", F.lit(0).cast("bigint"), lambda s, x: s + x)
    kept = real_ids(spark, sf).select(*KEYS, F.size("ids").cast("bigint").alias("kept"), total.alias("total"))
    return kept.filter("kept > 0")


@query(
    "cross_entropy",
    f"""WITH {CELLS}, freq AS (SELECT label, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS p FROM cells WHERE label <> 0 GROUP BY label),{SCORED}
    SELECT (SELECT round(avg(-ln(p)), 6) FROM cells JOIN freq USING (label)) AS cross_entropy,
           (SELECT round(avg(loss), 6) FROM scored) AS binary_loss""",
)
def cross_entropy(spark, sf):
    """Unigram model over the coded lines, and the one-logit loss of the scored documents."""
    cells = real_ids(spark, sf).select(F.explode("ids").alias("label"))
    # The mean over all cells is the mean over the labels, weighted by their counts.
    freq = materialize(cells.groupBy("label").agg(F.count("*").alias("n")), "labels")
    total = freq.agg(F.sum("n").alias("t"))
    share = freq.crossJoin(F.broadcast(total)).withColumn("p", F.col("n") / F.col("t"))  # one row
    model = evaluate.cross_entropy(share, "p", "label", weight="n")
    binary = scored(spark, sf).agg(F.avg("loss").alias("binary_loss"))
    return model.crossJoin(binary).select(  # one row each
        F.round("cross_entropy", 6).alias("cross_entropy"), F.round("binary_loss", 6).alias("binary_loss")
    )


@query(
    "perplexity",
    f"""WITH {sql.TOK}, freq AS (SELECT word, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS p FROM tok GROUP BY word)
    SELECT doc_id, line_no, round(exp(-avg(ln(p))), 4) AS perplexity FROM tok JOIN freq USING (word) GROUP BY doc_id, line_no""",
)
def perplexity(spark, sf):
    tokens = line_tokens(spark, sf)
    counts = materialize(terms.word_counts(tokens), "counts")
    total = counts.agg(F.sum("cnt").alias("t"))
    rows = lookup_join(terms.explode_tokens(tokens), counts, "word", ["cnt"], hot_by="cnt")
    scored_rows = rows.crossJoin(F.broadcast(total)).withColumn("p", F.col("cnt") / F.col("t"))  # one row
    return evaluate.perplexity(scored_rows, "p", KEYS).withColumn("perplexity", F.round("perplexity", 4))


def grams(side: str) -> str:
    return f"""
{side}_grams AS (
  SELECT key, n, array_to_string({side}[i:i + n - 1], ' ') AS gram, count(*) AS cnt
  FROM both_sides, range(1, 5) o(n), LATERAL (SELECT unnest(range(1, len({side}) - n + 2)) AS i) s GROUP BY ALL
)"""


BLEU = DECODED + """,
both_sides AS (
  SELECT l.doc_id || ':' || l.line_no AS key, l.w AS ref, CASE WHEN d.text = '' THEN CAST([] AS VARCHAR[]) ELSE string_split(d.text, ' ') END AS cand
  FROM ltok l JOIN decoded d USING (doc_id, line_no)
),""" + grams("cand") + "," + grams("ref") + """,
orders AS (
  SELECT key, n, sum(least(c.cnt, coalesce(r.cnt, 0))) AS matched, sum(c.cnt) AS total
  FROM cand_grams c LEFT JOIN ref_grams r USING (key, n, gram) GROUP BY key, n
),
sent AS (
  SELECT b.key, len(b.cand) AS lc, len(b.ref) AS lr,
    count(*) FILTER (o.matched > 0) AS ok, avg(ln(CASE WHEN o.matched > 0 THEN o.matched / CAST(o.total AS DOUBLE) END)) AS m
  FROM both_sides b LEFT JOIN orders o USING (key) GROUP BY b.key, b.cand, b.ref
)"""


def decoded_sides(spark, sf):
    """Lines with their key and words (ref), and the candidate: the words after coding and decoding.

    A vocabulary that can be sent codes the words in the task that matches them.
    """
    words = common_vocab(spark, sf)
    recoder = encode.inline_recoder(words)
    if recoder is not None:
        return line_tokens(spark, sf).select(F.concat_ws(":", *KEYS).alias("key"), F.col("tokens").alias("ref")), recoder
    tokens = line_tokens(spark, sf).withColumn("ref", F.col("tokens"))
    carried = [*KEYS, "ref"]
    decoded = encode.decode_ids(encode.encode_tokens(tokens, words, carried), words, carried)
    cand = F.when(F.col("text") == "", F.array().cast("array<string>")).otherwise(F.split("text", " ", -1))
    return decoded.select(F.concat_ws(":", *KEYS).alias("key"), cand.alias("cand"), "ref"), "cand"


@query(
    "bleu_sentence",
    f"""WITH {BLEU} SELECT key, round(CASE WHEN ok = 4 THEN exp(m) * exp(least(1 - lr / CAST(lc AS DOUBLE), 0.0)) ELSE 0.0 END, 6) AS bleu
    FROM sent""",
)
def bleu_sentence(spark, sf):
    lines, candidate = decoded_sides(spark, sf)
    return evaluate.bleu_sentence(lines, "key", candidate, "ref").withColumn("bleu", F.round("bleu", 6))


@query(
    "bleu_corpus",
    f"""WITH {BLEU}, sums AS (SELECT n, sum(matched) AS matched, sum(total) AS total FROM orders GROUP BY n)
    SELECT round((SELECT exp(avg(ln(matched / CAST(total AS DOUBLE)))) FROM sums)
      * exp(least(1 - (SELECT sum(len(ref)) FROM both_sides) / CAST((SELECT sum(len(cand)) FROM both_sides) AS DOUBLE), 0.0)), 6) AS bleu""",
)
def bleu_corpus(spark, sf):
    lines, candidate = decoded_sides(spark, sf)
    return evaluate.bleu_corpus(lines, candidate, "ref").withColumn("bleu", F.round("bleu", 6))


FOLDS = SCORED + f""",
folded AS (SELECT *, CAST(ntile(10) OVER (ORDER BY {sql.digest(12, 'doc_id')}, doc_id) - 1 AS INTEGER) AS fold FROM scored),
runs AS (SELECT fold, avg(loss) AS loss, avg(CAST(label = pred AS INTEGER)) AS acc FROM folded GROUP BY fold)"""


def fold_runs(spark, sf):
    rows = splits.kfold_assign(scored(spark, sf), ["doc_id"], 10, 12)
    return rows.groupBy("fold").agg(
        F.avg("loss").alias("loss"), F.avg((F.col("label") == F.col("pred")).cast("double")).alias("acc")
    )


@query(
    "running_best_rows",
    """SELECT event_id, value, b AS best_before, (b IS NULL OR value < b) AS improved FROM (
      SELECT event_id, value, min(value) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM events)""",
)
def running_best_rows(spark, sf):
    """The least value so far over one sequence of all events."""
    events = tables.table(spark, sf, "events").select("event_id", "value", F.lit(0).alias("sequence"))
    return evaluate.running_best(events, "event_id", "value", "sequence").drop("sequence")


@query("fold_average", f"WITH {FOLDS} SELECT round(avg(loss), 6) AS mean_loss, round(avg(acc), 6) AS mean_acc FROM runs")
def fold_average(spark, sf):
    found = evaluate.fold_average(fold_runs(spark, sf), "loss", "acc")
    return found.select(*[F.round(c, 6).alias(c) for c in found.columns])


@query("best_run", f"WITH {FOLDS} SELECT fold, round(loss, 6) AS loss FROM runs ORDER BY runs.loss, fold LIMIT 1")
def best_run(spark, sf):
    return evaluate.best_run(fold_runs(spark, sf), "fold", "loss").withColumn("loss", F.round("loss", 6))


@query(
    "running_best",
    f"""WITH {FOLDS}, w AS (SELECT fold, loss, min(loss) OVER (ORDER BY fold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM runs)
    SELECT fold, round(loss, 6) AS loss, round(b, 6) AS best_before, (b IS NULL OR loss < b) AS improved FROM w""",
)
def running_best(spark, sf):
    runs = fold_runs(spark, sf).withColumn("experiment", F.lit(0))
    found = evaluate.running_best(runs, "fold", "loss", "experiment")
    return found.select(
        "fold", F.round("loss", 6).alias("loss"), F.round("best_before", 6).alias("best_before"), "improved"
    )
