"""Mixing sources to target weights by iterative proportional fitting, DataFrame only.

Documents are reduced to cells (source, language, topic) with their tokens. The cell
weights are raked to one marginal after the other until all three hold. With a token
budget a cell gives at most its own tokens, and the rest of the budget is raked over the
others; without one, probabilities are weights per token over the largest of all cells.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialize
from .common import text_or_empty

DIMENSIONS = ("source", "lang", "topic")
# Exponents that flatten the shares found in the corpus into the target shares.
FLATTEN = {"source": 0.8, "lang": 0.9, "topic": 0.9}
TOPICS = 8
TOLERANCE = 1e-9
ROUNDS = 60
# Cells that one task works through, and rounds that it makes before they are written.
FEW_CELLS, ROUNDS_AT_ONCE = 100_000, 4
# The sample's expected tokens as a share of the corpus, and how near shares come to targets.
SHARE = 0.8
BUDGET_TOLERANCE = 1e-6
WHITE = "[ \\t\\n\\x0B\\f\\r]+"


def described(docs: DataFrame) -> DataFrame:
    """``docs`` with _source, _lang, _topic and _tokens (words of the whole text).

    The topic is one of TOPICS hash classes of the text's longest word (of equally long
    ones the last in order), a stand-in for a topic model. Null parts are ``unknown``.
    """
    words = F.filter(F.split(F.lower(text_or_empty("text")), WHITE), lambda w: w != "")
    longest = F.array_max(F.transform(F.col("_words"), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    digest = F.conv(F.substring(F.md5(longest.cast("binary")), 1, 8), 16, 10).cast("long")
    topic = F.when(F.size("_words") > 0, F.concat(F.lit("t"), (digest % TOPICS).cast("string")))
    unknown = F.lit("unknown")
    return (
        docs.withColumn("_words", words)
        .withColumn("_topic", F.coalesce(topic, unknown))
        .withColumn("_tokens", F.size("_words").cast("long"))
        .drop("_words")
        .withColumn("_source", F.coalesce(F.col("source").cast("string"), unknown))
        .withColumn("_lang", F.coalesce(F.col("lang").cast("string"), unknown))
    )


def tempered(cells: DataFrame, dimension: str, exponent: float) -> DataFrame:
    """(dimension, target): the corpus shares to the given power, summing to one."""
    shares = cells.groupBy(dimension).agg(F.pow(F.sum("tokens"), F.lit(exponent)).alias("raised"))
    total = shares.agg(F.sum("raised").alias("total"))  # one row
    return shares.crossJoin(F.broadcast(total)).select(dimension, (F.col("raised") / F.col("total")).alias("target"))


def one_task(cells: DataFrame) -> tuple[DataFrame, bool]:
    """The (written) cells, in one partition where there are few enough, and whether there are.

    Sums over a dimension are then windows of that partition: a round is a task and not a
    dozen exchanges. More cells stay dealt, and sums are aggregated and joined.
    """
    few = cells.count() <= FEW_CELLS
    return (cells.coalesce(1) if few else cells), few


def with_sums(rows: DataFrame, dimension: str, sums: dict[str, Column], few: bool) -> DataFrame:
    """``rows`` with sums over all rows that share the value of a dimension."""
    if few:
        return rows.withColumns({n: F.sum(c).over(Window.partitionBy(dimension)) for n, c in sums.items()})
    return rows.join(rows.groupBy(dimension).agg(*[F.sum(c).alias(n) for n, c in sums.items()]), dimension)


def _unmet(off: dict[str, float | None], tolerance: float, rounds: int) -> None:
    if any(x is not None and x > tolerance for x in off.values()):
        warnings.warn(f"targets not met after {rounds} rounds: off by {off}", stacklevel=3)


def rake(cells: DataFrame, targets: dict[str, DataFrame], tolerance: float = TOLERANCE, rounds: int = ROUNDS) -> DataFrame:
    """``cells`` with a column weight whose sums meet the targets of every dimension.

    ``targets`` has one (dimension, target) table each, of positive shares. Weights are
    written after each round, or few rounds of few cells; the driver sees the largest
    deviation only. Targets that the cells can't meet together are met as nearly as
    ``rounds`` rounds come, with a warning that says how far off they are.
    """
    now = cells.withColumn("weight", F.col("tokens").cast("double"))
    for d in targets:
        now = now.join(targets[d].withColumnRenamed("target", f"target_{d}"), d)
    now, few = one_task(materialize(now, "weights"))
    step, off = ROUNDS_AT_ONCE if few else 1, {}
    for done in range(0, rounds, step):
        for _ in range(min(step, rounds - done)):
            for d in targets:
                now = with_sums(now, d, {"_sum": F.col("weight")}, few)
                factor = F.col(f"target_{d}") / F.col("_sum")
                now = now.withColumn(f"factor_{d}", factor).withColumn("weight", F.col("weight") * F.col(f"factor_{d}")).drop("_sum")
        now = materialize(now, "weights")
        now = now.coalesce(1) if few else now
        # The last dimension is met; the first two say how far the last round still moved.
        off = now.agg(*[F.max(F.abs(F.col(f"factor_{d}") - 1)).alias(d) for d in targets]).first().asDict()
        now = now.drop(*[f"factor_{d}" for d in targets])
        if all(x is None or x <= tolerance for x in off.values()):
            break
    _unmet(off, tolerance, rounds)
    return now.drop(*[f"target_{d}" for d in targets])


def filled(table: DataFrame, room: str, weight: str, budget: float) -> float:
    """The scale at which the sum of min(room, scale * weight) is ``budget``.

    Rows at their room leave the rest of the budget to the others, until none is added;
    the scale only grows, and the driver sees sums. ``budget`` is at most the sum of room.
    """
    scale, full = 0.0, -1
    while True:
        at_room = F.col(weight) * F.lit(scale) >= F.col(room) if scale else F.lit(False)
        found = table.agg(
            F.sum(F.when(at_room, F.col(room)).otherwise(0.0)).alias("taken"),
            F.sum(F.when(at_room, 0.0).otherwise(F.col(weight))).alias("free"),
            F.sum(at_room.cast("long")).alias("full"),
        ).first()
        if not found["free"] or found["full"] == full:
            return scale
        full, scale = found["full"], max(scale, (budget - found["taken"]) / found["free"])


def budgeted(
    cells: DataFrame,
    targets: dict[str, DataFrame],
    share: float,
    tolerance: float = BUDGET_TOLERANCE,
    rounds: int = ROUNDS,
) -> DataFrame:
    """``cells`` with a column p; the sum of p * tokens is ``share`` of all tokens.

    p is min(1, rate), rate being a product of one factor per dimension and one scale. A
    value whose target exceeds its tokens gives all of them, and the rest goes to the
    other values by their targets. Factors are found as in ``rake``, of the cells below 1
    where a value's sum must rise. Targets that the cells can't meet together are met as
    nearly as ``rounds`` rounds come; the budget is met by the scale.
    """
    total = cells.agg(F.sum("tokens").alias("n")).first()["n"]
    if not total:
        return cells.withColumn("p", F.lit(0.0))
    budget = float(share * total)
    goals = {}
    for d in targets:
        room = cells.groupBy(d).agg(F.sum("tokens").cast("double").alias("room")).join(targets[d], d)
        room = materialize(room, "room")
        scale = filled(room, "room", "target", budget)
        goals[d] = materialize(room.select(d, F.least("room", F.col("target") * scale).alias("goal")), "goals")
    now = cells.withColumn("rate", F.lit(1.0))
    for d in goals:
        now = now.join(goals[d].withColumnRenamed("goal", f"goal_{d}"), d)
    now, few = one_task(materialize(now, "rates"))
    step, off = ROUNDS_AT_ONCE if few else 1, {}
    for done in range(0, rounds, step):
        for _ in range(min(step, rounds - done)):
            for d in goals:
                below = F.col("rate") < 1
                free = F.when(below, F.col("tokens") * F.col("rate")).otherwise(0.0)
                taken = F.when(below, 0.0).otherwise(F.col("tokens").cast("double"))
                now = with_sums(now, d, {"_free": free, "_taken": taken}, few)
                goal, total = F.col(f"goal_{d}"), F.col("_free") + F.col("_taken")
                rise = (goal > total) & (F.col("_free") > 0)
                factor = F.when(rise, (goal - F.col("_taken")) / F.col("_free")).otherwise(F.least(F.lit(1.0), goal / total))
                now = now.withColumns({f"off_{d}": F.abs(total / goal - 1), "_factor": factor})
                now = now.withColumn("rate", F.col("rate") * F.col("_factor")).drop("_free", "_taken", "_factor")
        now = materialize(now, "rates")
        now = now.coalesce(1) if few else now
        off = now.agg(*[F.max(f"off_{d}").alias(d) for d in goals]).first().asDict()
        now = now.drop(*[f"off_{d}" for d in goals])
        if all(x is None or x <= tolerance for x in off.values()):
            break
    _unmet(off, tolerance, rounds)
    now = now.drop(*[f"goal_{d}" for d in goals])
    weighed = now.withColumn("weight", F.col("tokens") * F.col("rate"))
    scale = filled(weighed.withColumn("room", F.col("tokens").cast("double")), "room", "weight", budget)
    return now.withColumn("p", F.least(F.lit(1.0), F.col("rate") * scale)).drop("rate")


def mixed(
    docs: DataFrame,
    flatten: dict[str, float] | None = None,
    seed: int = 0,
    drop: tuple[str, ...] = (),
    share: float | None = SHARE,
) -> DataFrame:
    """``described`` rows with _probability and _kept; ``drop`` names columns to leave out.

    The sample's expected tokens are ``share`` of the corpus (see ``budgeted``). With share
    None the sample has no stated size: the probability is a cell's weight per token over
    the largest one of all cells, so one rare cell can lower all others. Documents without
    tokens have probability 0. A document is kept by a hash of seed and doc_id: the
    result does not depend on partitions or retries, and repeated rows share their fate.
    """
    rows = materialize(described(docs).drop(*drop), "described")
    cells = rows.filter("_tokens > 0").groupBy(*[F.col(f"_{d}").alias(d) for d in DIMENSIONS]).agg(F.sum("_tokens").alias("tokens"))
    cells = materialize(cells, "mixture")
    targets = {d: materialize(tempered(cells, d, (flatten or FLATTEN)[d]), "targets") for d in DIMENSIONS}
    if share is None:
        weights = rake(cells, targets).withColumn("per_token", F.col("weight") / F.col("tokens"))
        most = weights.agg(F.max("per_token").alias("most"))  # one row
        weights = weights.crossJoin(F.broadcast(most)).withColumn("p", F.col("per_token") / F.col("most"))
    else:
        weights = budgeted(cells, targets, share)
    weights = weights.select(*[F.col(d).alias(f"_{d}") for d in DIMENSIONS], F.col("p").alias("_p"))
    joined = rows.join(materialize(weights, "probabilities"), [f"_{d}" for d in DIMENSIONS], "left")
    p = F.when(F.col("_tokens") > 0, F.coalesce("_p", F.lit(0.0))).otherwise(0.0)
    return joined.withColumn("_probability", p).withColumn("_kept", uniform("doc_id", seed) < F.col("_probability")).drop("_p")


def uniform(key: str, seed: int) -> Column:
    """A number in [0, 1) from 52 bits of the md5 of seed and key."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def mix_report(docs: DataFrame, share: float | None = None) -> DataFrame:
    """doc_id, source, lang, topic, tokens, probability, kept for every row of ``docs``."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", "text")
    return mixed(slim, drop=("text",), share=share).select(
        "doc_id",
        F.col("_source").alias("source"),
        F.col("_lang").alias("lang"),
        F.col("_topic").alias("topic"),
        F.col("_tokens").alias("tokens"),
        F.round("_probability", 4).alias("probability"),
        F.col("_kept").alias("kept"),
    )
