"""Evaluation aggregates over prediction tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialize


def accuracy(df: DataFrame, label: str, pred: str, batch: str | None = None) -> DataFrame:
    """Share of equal labels; with ``batch``, also the mean of the batch shares."""
    hit = (F.col(label) == F.col(pred)).cast("double")
    if batch is None:
        return df.agg(F.avg(hit).alias("accuracy"))
    per_batch = df.groupBy(batch).agg(F.avg(hit).alias("acc"), F.sum(hit).alias("hits"), F.count("*").alias("n"))
    return per_batch.agg(
        (F.sum("hits") / F.sum("n")).alias("accuracy"), F.avg("acc").alias("batch_accuracy")
    )


def macro_f1(df: DataFrame, label: str, pred: str, groups: list[str] = ()) -> DataFrame:
    """Unweighted mean of per-class F1 over the classes seen as label or prediction."""
    cells = df.groupBy(*groups, F.col(label).alias("_l"), F.col(pred).alias("_p")).agg(F.count("*").alias("_n"))
    sides = cells.select(
        *groups,
        F.explode(
            F.array(
                F.struct(F.col("_l").alias("c"), F.lit(1).alias("is_l"), F.lit(0).alias("is_p")),
                F.struct(F.col("_p").alias("c"), F.lit(0).alias("is_l"), F.lit(1).alias("is_p")),
            )
        ).alias("s"),
        "_l",
        "_p",
        "_n",
    )
    per_class = sides.groupBy(*groups, F.col("s.c").alias("c")).agg(
        F.sum(F.col("_n") * F.col("s.is_l")).alias("labelled"),
        F.sum(F.col("_n") * F.col("s.is_p")).alias("predicted"),
        F.sum(F.when(F.col("_l") == F.col("_p"), F.col("_n") * F.col("s.is_l")).otherwise(0)).alias("hits"),
    )
    f1 = 2 * F.col("hits") / (F.col("labelled") + F.col("predicted"))
    return per_class.groupBy(*groups).agg(F.avg(f1).alias("macro_f1"))


def batch_macro_f1(df: DataFrame, label: str, pred: str, batch: str) -> DataFrame:
    """Mean over batches of the batch's macro F1."""
    return macro_f1(df, label, pred, [batch]).agg(F.avg("macro_f1").alias("batch_macro_f1"))


def binary_loss(logit: Column, label: Column) -> Column:
    """Cross entropy of one logit, in its overflow-safe form."""
    return F.greatest(logit, F.lit(0.0)) - logit * label + F.log1p(F.exp(-F.abs(logit)))


def cross_entropy(df: DataFrame, probability: str, label: str, ignore: int = 0, weight: str | None = None) -> DataFrame:
    """Mean negative log probability of the target, leaving out the padding label.

    ``weight`` says how often a row counts.
    """
    kept = ignore_padding(df, label, ignore)
    times = F.col(weight) if weight else F.lit(1)
    return kept.agg((F.sum(-F.log(F.col(probability)) * times) / F.sum(times)).alias("cross_entropy"))


def ignore_padding(df: DataFrame, label: str, ignore: int = 0) -> DataFrame:
    return df.filter(F.col(label) != ignore)


def perplexity(df: DataFrame, probability: str, groups: list[str] = ()) -> DataFrame:
    """Inverse geometric mean of probabilities, in log space."""
    return df.groupBy(*groups).agg(F.exp(-F.avg(F.log(F.col(probability)))).alias("perplexity"))


def fold_average(folds: DataFrame, loss: str, acc: str) -> DataFrame:
    return folds.agg(F.avg(loss).alias("mean_loss"), F.avg(acc).alias("mean_acc"))


def best_run(runs: DataFrame, run: str, loss: str) -> DataFrame:
    """The run with the lowest loss, the earliest on a tie."""
    return runs.agg(F.min(F.struct(F.col(loss), F.col(run))).alias("b")).select(
        F.col(f"b.{run}").alias(run), F.col(f"b.{loss}").alias(loss)
    )


def running_best(runs: DataFrame, run: str, loss: str, group: str) -> DataFrame:
    """Loss of the best run so far (``best_before``) and whether this run improves on it.

    ``group`` names one experiment, which may hold all rows: they are range-dealt by
    group and run, so a range only needs the least loss of the ranges before it.
    """
    dealt = runs.repartitionByRange(group, run).sortWithinPartitions(group, run)
    rows = materialize(dealt.withColumn("_range", F.spark_partition_id()), "runs")
    sizes = rows.groupBy(F.col("_range").alias("_r"), F.col(group).alias("_g")).agg(F.min(loss).alias("_least"))
    ranges = Window.partitionBy("_g").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    sizes = sizes.select("_r", "_g", F.min("_least").over(ranges).alias("_before"))
    inside = Window.partitionBy("_range", group).orderBy(run).rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.withColumn("_own", F.min(loss).over(inside)).join(
        sizes, (F.col("_range") == F.col("_r")) & F.col(group).eqNullSafe(F.col("_g"))
    )
    found = joined.withColumn("best_before", F.least("_own", "_before"))
    improved = F.col("best_before").isNull() | (F.col(loss) < F.col("best_before"))
    return found.withColumn("improved", improved).select(*runs.columns, "best_before", "improved")


# Words of both sides that are matched at once: few enough to be sorted in the processor's cache.
MATCH_WORDS = 1 << 16


def _sizes(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _numbered(values: np.ndarray, top: int) -> tuple[np.ndarray, int]:
    """The number of each value, from 0 to below ``top``, among the different ones; how many there are."""
    bits = len(values).bit_length()
    if not len(values) or top.bit_length() + bits > 63:  # place and value don't fit in one integer
        coded = pa.array(values).dictionary_encode()
        return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(coded.dictionary)
    order = np.sort(values << bits | np.arange(len(values)))  # quicker than by argsort
    place, order = order & ((1 << bits) - 1), order >> bits
    numbers = np.zeros(len(values), np.int64)
    numbers[place[1:]] = np.cumsum(order[1:] != order[:-1])
    return numbers, int(numbers[place[-1]]) + 1


def _clipped(words: np.ndarray, sizes: tuple[np.ndarray, np.ndarray], orders: int) -> tuple[list, list]:
    """Per row, of every order: clipped matches and candidate n-grams. ``words`` has all candidates first.

    An n-gram is named by the number of the shorter one before its last word, and a first
    word by its row as well, so n-grams of different rows never share a name. Those whose
    beginning isn't on both sides match nowhere and go no further.
    """
    n_rows, split = len(sizes[0]), int(sizes[0].sum())
    row = np.concatenate([np.repeat(np.arange(n_rows), x) for x in sizes])
    end = np.concatenate([np.repeat(np.cumsum(x), x) for x in sizes])
    end[split:] += split
    word, n_words = _numbered(words, int(words.max(initial=0)) + 1)
    name, n_names, place, matched = row, n_rows, np.arange(len(word)), []
    for n in range(1, orders + 1):
        name, n_names = _numbered(name * n_words + word[place + n - 1], n_names * n_words)
        first_ref = np.searchsorted(place, split)
        ours, theirs = (np.bincount(x, minlength=n_names) for x in (name[:first_ref], name[first_ref:]))
        both = np.minimum(ours, theirs)
        owner = np.empty(n_names, np.int64)
        owner[name] = row[place]
        matched.append(np.bincount(owner[both > 0], both[both > 0], n_rows).astype(np.int64))
        open_ = (both[name] > 0) & (place + n < end[place])
        place, name = place[open_], name[open_]
    return matched, [np.maximum(sizes[0] - n, 0) for n in range(orders)]


def _match_batches(orders: int, most: int = MATCH_WORDS):
    """Per row, of every order: clipped matches and candidate n-grams; both lengths last.

    Words are numbered per batch. Its rows are matched in parts of about ``most`` words.
    """

    def run(batches):
        for batch in batches:
            sides = [batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)]
            words = pa.concat_arrays([x.flatten() for x in sides]).dictionary_encode().indices
            word = words.to_numpy(zero_copy_only=False).astype(np.int64)
            sizes = [_sizes(x) for x in sides]
            (at_c, at_r), split = (np.concatenate([[0], np.cumsum(x)]) for x in sizes), int(sizes[0].sum())
            cuts = np.flatnonzero(np.diff((at_c + at_r)[1:] // most)) + 1
            parts = []
            for x, y in zip([0, *cuts], [*cuts, len(batch)]):
                own = np.concatenate([word[at_c[x] : at_c[y]], word[split + at_r[x] : split + at_r[y]]])
                matched, total = _clipped(own, (sizes[0][x:y], sizes[1][x:y]), orders)
                parts.append([*matched, *total])
            counts = [np.concatenate(x) for x in zip(*parts)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-2], *map(pa.array, [*counts, *sizes])],
                names=[str(i) for i in range(batch.num_columns + 2 * orders)],
            )

    return run


def _counts(
    pairs: DataFrame, candidate: str | Callable, reference: str, orders: int, keys: list[str] = ()
) -> DataFrame:
    """Clipped matches and candidate n-grams of every order, and both lengths, per row.

    ``candidate`` is a column, or an Arrow kernel that puts the candidate before the
    reference, the last column, in the task that matches both: words move to it once.
    """
    kinds = [f"`{k}` {pairs.schema[k].dataType.simpleString()}" for k in keys]
    kinds += [f"_{kind}{n} long" for kind in "mt" for n in range(1, orders + 1)]
    sides, match = [F.col(reference).alias("_ref")], _match_batches(orders)
    if callable(candidate):
        first = candidate
        kernel = lambda batches: match(first(batches))
    else:
        sides, kernel = [F.col(candidate).alias("_cand"), *sides], match
    return pairs.select(*keys, *sides).mapInArrow(kernel, ", ".join([*kinds, "_c long", "_r long"]))


def _score(orders: int) -> Column:
    logs = [F.log(F.col(f"_m{n}") / F.col(f"_t{n}")) for n in range(1, orders + 1)]
    mean = sum(logs[1:], logs[0]) / orders
    brevity = F.exp(F.least(1 - F.col("_r") / F.col("_c"), F.lit(0.0)))
    usable = F.least(*[F.col(f"_m{n}") for n in range(1, orders + 1)]) > 0
    return F.when(usable, F.exp(mean) * brevity).otherwise(F.lit(0.0))


def bleu_sentence(pairs: DataFrame, key: str, candidate: str | Callable, reference: str, orders: int = 4) -> DataFrame:
    """Sentence BLEU; 0 when some order has no match. No shuffle. ``candidate`` as in :func:`_counts`."""
    return _counts(pairs, candidate, reference, orders, [key]).select(key, _score(orders).alias("bleu"))


def bleu_corpus(pairs: DataFrame, candidate: str | Callable, reference: str, orders: int = 4) -> DataFrame:
    """Corpus BLEU from the sums of all rows."""
    names = [*(f"_m{n}" for n in range(1, orders + 1)), *(f"_t{n}" for n in range(1, orders + 1)), "_c", "_r"]
    counts = _counts(pairs, candidate, reference, orders)
    return counts.agg(*[F.sum(n).alias(n) for n in names]).select(_score(orders).alias("bleu"))
