"""Array expressions for id sequences and vectors. All are local to a row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Special ids.
PAD, UNK, SOS, EOS = 0, 1, 2, 3
CLS, SEP, MASK = 2, 3, 4
FIRST_WORD = 4
FIRST_PIECE = 5


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def term_runs(tokens: Column) -> Column:
    """``array<struct<word, n_w, first_pos>>``: the distinct tokens of one row.

    Sorting the row's own tokens gives the counts without any shuffle.
    """
    placed = F.sort_array(F.transform(tokens, lambda t, i: F.struct(t.alias("word"), i.alias("pos"))))

    def runs(s: Column) -> Column:
        starts = F.filter(
            F.transform(
                s,
                lambda x, i: F.struct(
                    x["word"].alias("word"),
                    x["pos"].alias("pos"),
                    i.alias("at"),
                    (F.when(i > 0, F.get(s, i - 1)["word"]) == x["word"]).alias("same"),
                ),
            ),
            lambda x: ~F.coalesce(x["same"], F.lit(False)),
        )
        return let(
            starts,
            lambda st: F.transform(
                st,
                lambda x, k: F.struct(
                    x["word"].alias("word"),
                    (F.coalesce(F.get(st, k + 1)["at"], F.size(s)) - x["at"]).cast("bigint").alias("n_w"),
                    x["pos"].alias("first_pos"),
                ),
            ),
        )

    return let(placed, runs)


def frame_sequence(ids: Column, reverse: bool = False) -> Column:
    """Put SOS and EOS around a sequence, optionally reversing it first."""
    body = F.reverse(ids) if reverse else ids
    return F.concat(F.array(F.lit(SOS)), body, F.array(F.lit(EOS)))


def pad_fixed(ids: Column, length: int | Column, value: int = PAD) -> Column:
    """Cut or pad to ``length``."""
    length = F.lit(length) if isinstance(length, int) else length
    return F.slice(F.concat(ids, F.array_repeat(F.lit(value), length)), F.lit(1), length)


def segment_ids(ids: Column) -> Column:
    """1 up to and including the first SEP, 2 after it."""
    return let(
        F.array_position(ids, F.lit(SEP)),
        lambda first: F.transform(ids, lambda _, i: F.when(i < first, F.lit(1)).otherwise(F.lit(2))),
    )


def real_ids(ids: Column) -> Column:
    """The ids without padding."""
    return F.filter(ids, lambda x: x != PAD)


def attention_mask(ids: Column) -> Column:
    """1 on real positions, 0 on padding."""
    return F.transform(ids, lambda x: (x != PAD).cast("int"))


def shift_inputs(ids: Column) -> Column:
    return F.slice(ids, F.lit(1), F.greatest(F.size(ids) - 1, F.lit(0)))


def shift_targets(ids: Column) -> Column:
    return F.slice(ids, F.lit(2), F.greatest(F.size(ids) - 1, F.lit(0)))


def argmax_class(scores: Column) -> Column:
    """0-based index of the first largest score."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def sigmoid_round(logit: Column) -> Column:
    """Round the sigmoid half to even, so a logit of 0 gives 0."""
    return F.rint(1 / (1 + F.exp(-logit))).cast("int")


def cast_vector(vec: Column) -> Column:
    """Lower the precision to float for storage."""
    return F.transform(vec, lambda x: x.cast("float"))


def split_minutes(seconds: Column) -> Column:
    return F.floor(seconds / 60).cast("bigint")


def split_seconds(seconds: Column) -> Column:
    return F.floor(seconds - 60 * F.floor(seconds / 60)).cast("bigint")


def format_ratio(part: Column, total: Column) -> Column:
    """``12.34% (a/b)``."""
    return F.format_string("%.2f%% (%d/%d)", part / total * 100, part, total)
