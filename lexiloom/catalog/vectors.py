"""Vector tables, cosine ranking, recommendation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays
from ..operators import splits, terms, vectors
from ..operators.ml import knn_predict
from ..operators import evaluate
from ..operators.terms import KEYS
from ..runtime import materialize, scratch_path
from ..sources import tables
from . import sql
from .registry import query
from .text import line_tokens
from .vocabulary import common_vocab

DIM = 64

EMB = """
emb AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS vec, label FROM embeddings)"""
DOT = "list_inner_product({0}, {1})"


def cos(a: str, b: str) -> str:
    norm = f"(sqrt({DOT.format(a, a)}) * sqrt({DOT.format(b, b)}))"
    return f"(CASE WHEN {norm} = 0 THEN 0.0 ELSE {DOT.format(a, b)} / {norm} END)"


PAIRS = EMB + f""",
pairs AS (
  SELECT a.vec_id AS a_id, b.vec_id AS b_id, round({cos('a.vec', 'b.vec')}, 9) AS cos, {cos('a.vec', 'b.vec')} AS raw
  FROM emb a, emb b WHERE a.label = 0 AND b.label <> 0
)"""


@query(
    "scan_vectors",
    f"WITH {EMB} SELECT vec_id, label, len(vec) AS dim, round(list_sum(vec), 5) AS total FROM emb",
)
def scan_vectors(spark, sf):
    total = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return tables.vectors(spark, sf).select(
        "vec_id", "label", F.size("vec").cast("bigint").alias("dim"), F.round(total, 5).alias("total")
    )


@query(
    "sink_vectors",
    f"WITH {EMB} SELECT vec_id, round(list_sum(vec), 5) AS total FROM emb WHERE label <> 0",
)
def sink_vectors(spark, sf):
    from ..sources.sinks import write_vectors

    path = scratch_path(spark, "vectors")
    write_vectors(tables.vector_sides(spark, sf)[1].select("vec_id", "vec"), path)
    total = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return spark.read.parquet(path).select("vec_id", F.round(total, 5).alias("total"))


@query(
    "cast_vector",
    f"""WITH {EMB} SELECT vec_id, round(list_sum(list_transform(vec, lambda x: CAST(CAST(x / 3 AS FLOAT) AS DOUBLE))), 5) AS total FROM emb""",
)
def cast_vector(spark, sf):
    thirds = F.transform("vec", lambda x: x.cast("double") / 3)
    low = tables.vectors(spark, sf).select("vec_id", arrays.cast_vector(thirds).alias("v"))
    return low.select(
        "vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double")), 5).alias("total")
    )


@query(
    "argmax_class",
    f"WITH {EMB} SELECT vec_id, CAST(list_position(vec, list_max(vec)) - 1 AS INTEGER) AS best FROM emb",
)
def argmax_class(spark, sf):
    return tables.vectors(spark, sf).select("vec_id", arrays.argmax_class(F.col("vec")).alias("best"))


@query(
    "sigmoid_round",
    f"WITH {EMB} SELECT vec_id, CAST(round_even(1 / (1 + exp(-vec[1] * 10)), 0) AS INTEGER) AS hit FROM emb",
)
def sigmoid_round(spark, sf):
    logit = F.get("vec", F.lit(0)).cast("double") * 10
    return tables.vectors(spark, sf).select("vec_id", arrays.sigmoid_round(logit).alias("hit"))


@query(
    "vector_consistency",
    f"""WITH {EMB}, k AS (SELECT vec_id, count(*) AS n, count(*) FILTER (vec IS NULL) AS m, count(*) FILTER (len(vec) <> 64) AS w FROM emb GROUP BY vec_id)
    SELECT CAST(sum(n) AS BIGINT) AS total, CAST(sum(m) AS BIGINT) AS missing_vectors,
      count(*) FILTER (n > 1) AS duplicate_ids, CAST(sum(w) AS BIGINT) AS wrong_dim FROM k""",
)
def vector_consistency(spark, sf):
    return vectors.vector_consistency(tables.vectors(spark, sf), "vec_id", "vec", DIM)


@query(
    "lookup_vectors",
    f"WITH {EMB} SELECT vec_id, round(list_sum(vec), 5) AS total FROM emb WHERE label = 3",
)
def lookup_vectors(spark, sf):
    table = tables.vectors(spark, sf)
    found = vectors.lookup_vectors(table.filter("label = 3").select("vec_id"), table.select("vec_id", "vec"), "vec_id")
    return found.select(
        "vec_id", F.round(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double")), 5).alias("total")
    )


@query("restrict_targets", "SELECT vec_id, label FROM embeddings WHERE label IN (1, 2)")
def restrict_targets(spark, sf):
    table = tables.vectors(spark, sf).select("vec_id", "label")
    return vectors.restrict_targets(table, table.filter("label IN (1, 2)"), "vec_id")


@query("split_two_sets", "SELECT vec_id, CASE WHEN label = 0 THEN 'a' ELSE 'b' END AS side FROM embeddings")
def split_two_sets(spark, sf):
    from ..operators.joins import split_two_sets as split

    table = tables.vectors(spark, sf).select("vec_id", "label")
    a, b = split(table, table.filter("label = 0"), "vec_id")
    return a.select("vec_id", F.lit("a").alias("side")).unionByName(b.select("vec_id", F.lit("b").alias("side")))


# The whole matrix has as many cells as there are pairs; each row is given to this depth.
RANKED = 100


@query(
    "cosine_cross",
    f"""WITH {PAIRS} SELECT b_id, count(*) AS n, string_agg(printf('%.9f', cos), ' ' ORDER BY cos DESC, a_id) AS cosines
    FROM (SELECT *, row_number() OVER (PARTITION BY b_id ORDER BY cos DESC, a_id) AS place FROM pairs) WHERE place <= {RANKED} GROUP BY b_id""",
)
def cosine_cross(spark, sf):
    """The largest cosines of each row of the matrix."""
    a, b = tables.vector_sides(spark, sf)
    rows = vectors.ranked_lists(vectors.recommend_topn(b, a, "vec_id", "vec", top_n=RANKED))
    text = F.transform("cos", lambda c: F.format_string("%.9f", c))
    return rows.select(F.col("q_id").alias("b_id"), F.size("cos").cast("bigint").alias("n"), F.concat_ws(" ", text).alias("cosines"))


@query(
    "rank_similarity",
    f"""WITH {PAIRS}, placed AS (
      SELECT *, row_number() OVER (PARTITION BY b_id ORDER BY cos DESC, a_id) AS of_b,
             row_number() OVER (PARTITION BY a_id ORDER BY cos DESC, b_id) AS of_a FROM pairs)
    SELECT 'b' AS side, b_id AS id, string_agg(a_id, ' ' ORDER BY of_b) AS ranked FROM placed WHERE of_b <= {RANKED} GROUP BY b_id
    UNION ALL SELECT 'a', a_id, string_agg(b_id, ' ' ORDER BY of_a) FROM placed WHERE of_a <= {RANKED} GROUP BY a_id""",
)
def rank_similarity(spark, sf):
    """Each side ranked for the other, to a given depth."""
    a, b = tables.vector_sides(spark, sf)
    sides = []
    for side, queries, targets in (("b", b, a), ("a", a, b)):
        rows = vectors.ranked_lists(vectors.recommend_topn(queries, targets, "vec_id", "vec", top_n=RANKED))
        ranked = F.concat_ws(" ", F.transform("ranked", lambda x: x.cast("string")))
        sides.append(rows.select(F.lit(side).alias("side"), F.col("q_id").alias("id"), ranked.alias("ranked")))
    return sides[0].unionByName(sides[1])


@query(
    "exact_ranks",
    f"""WITH {PAIRS}, placed AS (
      SELECT a_id AS q_id, b_id AS t_id, cos, row_number() OVER (PARTITION BY a_id ORDER BY cos DESC, b_id) AS rank FROM pairs)
    SELECT * FROM placed WHERE t_id % 10 = q_id % 10""",
)
def exact_ranks(spark, sf):
    """The rank, at any depth, of every item vector whose id ends like that of the code vector."""
    a, b = tables.vector_sides(spark, sf)
    # There are ten ends only: slices of the first side keep the many pairs of an end out of one task.
    slices, tasks = 64, 4 * spark.sparkContext.defaultParallelism
    q = a.select(F.col("vec_id").alias("q_id"), F.pmod("vec_id", F.lit(10)).alias("end"), F.pmod(F.xxhash64("vec_id"), F.lit(slices)).cast("int").alias("slice"))
    each = F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice")
    t = b.select(F.col("vec_id").alias("t_id"), F.pmod("vec_id", F.lit(10)).alias("end"), each)
    asked = q.repartition(tasks, "end", "slice").join(t.repartition(tasks, "end", "slice"), ["end", "slice"])
    return vectors.exact_ranks(asked, a, b, "vec_id", "vec").select("q_id", "t_id", "cos", "rank")


@query(
    "recommend_topn",
    f"""WITH {PAIRS} SELECT a_id AS q_id, b_id AS t_id, cos, CAST(rn AS INTEGER) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY cos DESC, b_id) AS rn FROM pairs) WHERE rn <= 20""",
)
def recommend_topn(spark, sf):
    a, b = tables.vector_sides(spark, sf)
    best = vectors.recommend_topn(a, b, "vec_id", "vec", top_n=20)
    return best.select("q_id", "t_id", "cos", "rank")


@query(
    "recommend_topn_reverse",
    f"""WITH {PAIRS} SELECT b_id AS q_id, a_id AS t_id, cos, CAST(rn AS INTEGER) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY b_id ORDER BY cos DESC, a_id) AS rn FROM pairs) WHERE rn <= 5""",
)
def recommend_topn_reverse(spark, sf):
    """Item side to code side, on the path for many query vectors."""
    a, b = tables.vector_sides(spark, sf)
    best = vectors.recommend_topn(b, a, "vec_id", "vec", top_n=5, query_rows=0)
    return best.select("q_id", "t_id", "cos", "rank")


@query(
    "nearest_order",
    f"""WITH {EMB}, q AS (SELECT vec_id AS q_id, vec AS q_vec FROM emb ORDER BY vec_id LIMIT 1)
    SELECT q_id, vec_id, round({cos('q_vec', 'vec')}, 9) AS cos FROM emb, q WHERE vec_id <> q_id""",
)
def nearest_order(spark, sf):
    table = tables.vectors(spark, sf)
    first = table.orderBy("vec_id").limit(1)
    return vectors.nearest_order(first, table.select("vec_id", "vec"), "vec_id", "vec")


# The i-th vector stands for the i-th most common word.
WORDVEC = sql.VOCAB + "," + EMB + """,
wordvec AS (SELECT v.token AS word, e.vec FROM vocab v JOIN emb e ON e.vec_id = v.id - 4)"""


def word_vectors(spark, sf):
    words = common_vocab(spark, sf).select(F.col("token").alias("word"), (F.col("id") - 4).cast("bigint").alias("vec_id"))
    return materialize(words.join(tables.vectors(spark, sf).select("vec_id", "vec"), "vec_id").select("word", "vec"), "wordvec")


def keyed_words(spark, sf):
    """Each line's words under its key."""
    return line_tokens(spark, sf).select(F.concat_ws(":", *KEYS).alias("key"), F.col("tokens").alias("words"))


@query(
    "words_to_vectors",
    f"""WITH {WORDVEC} SELECT doc_id || ':' || line_no AS key, word, vec IS NOT NULL AS known, count(*) AS n,
      round(sum(list_sum(vec)), 4) AS total FROM tok LEFT JOIN wordvec USING (word) GROUP BY ALL""",
)
def words_to_vectors(spark, sf):
    rows = vectors.words_to_vectors(keyed_words(spark, sf), word_vectors(spark, sf), "key").filter(F.col("word").isNotNull())
    total = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return rows.select("key", "word", F.col("vec").isNotNull().alias("known"), total.alias("t")).groupBy(
        "key", "word", "known"
    ).agg(F.count("*").alias("n"), F.round(F.sum("t"), 4).alias("total"))


@query("skip_oov", f"WITH {WORDVEC} SELECT word, count(*) AS n FROM tok JOIN wordvec USING (word) GROUP BY word")
def skip_oov(spark, sf):
    known = word_vectors(spark, sf).select("word", F.lit(True).alias("known"))
    counts = terms.word_counts(line_tokens(spark, sf))
    return counts.join(known, "word", "left_semi").select("word", F.col("cnt").alias("n"))


@query(
    "centroid",
    f"""WITH {WORDVEC}, dims AS (SELECT doc_id, line_no, unnest(vec) AS x, generate_subscripts(vec, 1) AS d FROM tok JOIN wordvec USING (word)),
    means AS (SELECT doc_id, line_no, d, avg(x) AS m, count(*) AS n FROM dims GROUP BY doc_id, line_no, d),
    c AS (SELECT doc_id, line_no, max(n) AS found, round(sum(m), 5) AS total, round(max(m), 6) AS largest FROM means GROUP BY doc_id, line_no)
    SELECT l.doc_id || ':' || l.line_no AS key, coalesce(found, 0) AS found, coalesce(total, 0.0) AS total, coalesce(largest, 0.0) AS largest
    FROM lines l LEFT JOIN c USING (doc_id, line_no)""",
)
def centroid(spark, sf):
    found = vectors.keyed_centroids(keyed_words(spark, sf), word_vectors(spark, sf), "key", DIM)
    total = F.aggregate("centroid", F.lit(0.0), lambda s, x: s + x)
    return found.select(
        "key", "found", F.round(total, 5).alias("total"), F.round(F.array_max("centroid"), 6).alias("largest")
    )


@query(
    "vector_spread",
    f"""WITH {EMB} SELECT CAST(d - 1 AS INTEGER) AS dim, round(var_pop(x), 6) AS spread
    FROM (SELECT unnest(vec) AS x, generate_subscripts(vec, 1) AS d FROM emb) GROUP BY d""",
)
def vector_spread(spark, sf):
    spread = vectors.vector_spread(tables.vectors(spark, sf), "vec", DIM)
    return spread.select(F.posexplode("spread").alias("dim", "spread")).withColumn("spread", F.round("spread", 6))


@query(
    "init_vectors",
    f"""WITH {WORDVEC}, sp AS (SELECT d, var_pop(x) AS s FROM (SELECT unnest(vec) AS x, generate_subscripts(vec, 1) AS d FROM wordvec) GROUP BY d),
    cells AS (SELECT v.token, v.id, d, s, w.vec FROM vocab v CROSS JOIN sp LEFT JOIN wordvec w ON w.word = v.token)
    SELECT token, id, vec IS NOT NULL AS known,
      round(sum(CASE WHEN vec IS NOT NULL THEN vec[d] ELSE s * (2 * {sql.unit(sql.digest(9, 'token', '(d - 1)'))} - 1) END), 5) AS total
    FROM cells GROUP BY token, id, vec IS NOT NULL""",
)
def init_vectors(spark, sf):
    pretrained = word_vectors(spark, sf).withColumnRenamed("word", "token")
    filled = vectors.init_vectors(common_vocab(spark, sf), pretrained, DIM, 9)
    total = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x)
    return filled.select("token", "id", "known", F.round(total, 5).alias("total"))


KNN = EMB + f""",
parts AS (SELECT *, r < ceil(n * CAST(0.9 AS DOUBLE)) AS is_train FROM {sql.hash_order('emb', 21, 'vec_id')}),
near AS (
  SELECT q.vec_id AS q_id, t.vec_id AS t_id, q.label AS label, t.label AS pred,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY round({cos('q.vec', 't.vec')}, 9) DESC, t.vec_id) AS rn
  FROM parts q, parts t WHERE NOT q.is_train AND t.is_train
),
pred AS (SELECT q_id, t_id, label, pred FROM near WHERE rn = 1)"""


def knn_table(spark, sf):
    """Held-out vectors with the label of their nearest training vector."""
    table = tables.vectors(spark, sf)
    parts = materialize(splits.train_test_split(table, ["vec_id"], 0.9, 21), "parts")
    nearest = vectors.recommend_topn(parts.filter("NOT is_train"), parts.filter("is_train"), "vec_id", "vec", top_n=1)
    return knn_predict(nearest, table.select("vec_id", "label"), "vec_id", "label")


F1 = """
cls AS (SELECT label AS c FROM pred UNION SELECT pred FROM pred),
f1 AS (
  SELECT c, 2 * CAST((SELECT count(*) FROM pred WHERE label = c AND pred = c) AS DOUBLE)
         / ((SELECT count(*) FROM pred WHERE label = c) + (SELECT count(*) FROM pred WHERE pred = c)) AS f FROM cls
)"""


@query(
    "knn_label",
    f"""WITH {KNN},{F1} SELECT (SELECT count(*) FROM pred) AS n,
      (SELECT round(avg(CAST(label = pred AS INTEGER)), 6) FROM pred) AS accuracy, round(avg(f), 6) AS macro_f1 FROM f1""",
)
def knn_label(spark, sf):
    found = materialize(knn_table(spark, sf), "knn")
    count = found.agg(F.count("*").alias("n"))
    acc = evaluate.accuracy(found, "label", "pred")
    f1 = evaluate.macro_f1(found, "label", "pred")
    return count.crossJoin(acc).crossJoin(f1).select(  # one row each
        "n", F.round("accuracy", 6).alias("accuracy"), F.round("macro_f1", 6).alias("macro_f1")
    )
