"""Training instances: sentence pairs, masked tokens, parallel sequences, classifier rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import CLS, FIRST_PIECE, MASK, PAD, SEP, let, pad_fixed
from ..functions.hashing import hash_int, hash_text, keyed_hash, numbered_md5, unit_float
from ..runtime import with_keys
from .encode import encode_tokens, frame_all, pad_batch
from .ranking import batch_length_sort, batch_rows, global_rank
from .terms import KEYS

MAX_LENGTH = 256
PAIR_SPECIALS = 3
INSTANCE = ("inputs", "segments", "attention", "labels", "marks")
INSTANCE_ROWS = 1_000


def next_sentence_pairs(
    lines: DataFrame, seed: int, probability: float = 0.5, carry: list[str] = ("line",)
) -> DataFrame:
    """Pair every line with its successor (``nsp`` 1) or with another random line (0).

    ``lines`` has ``doc_id, line_no, n_lines`` and the carried columns. Both kinds of
    partner are found by their global position, so one equi-join of keys serves them; the
    random position skips the line itself and the one after it. Needs at least three lines.
    Only keys are ranked, so ``lines`` is best a written table, of which that reads little.
    """
    ranked = global_rank(lines.select(*KEYS, "n_lines"), KEYS, "r", "n")
    key = keyed_hash(seed, *KEYS)
    follows = (unit_float(key) > probability) & (F.col("line_no") < F.col("n_lines"))
    jump = hash_int(keyed_hash(f"{seed}x", *KEYS)) % (F.col("n") - 2)
    left = ranked.withColumn("nsp", follows.cast("int")).withColumn(
        "partner", F.when(follows, F.col("r") + 1).otherwise((F.col("r") + 2 + jump) % F.col("n"))
    )
    places = ranked.select(F.col("r").alias("partner"), *[F.col(k).alias(f"_{k}") for k in KEYS])
    asked = left.join(places, "partner").drop("partner")
    body = lines.select(*KEYS, *carry).repartition(*KEYS)
    # Both joins take the bodies from one exchange by key; only the partner's copy moves on.
    # Merged at every size: a broadcast would leave the bodies to the few tasks of the keys.
    other = body.select(*[F.col(k).alias(f"_{k}") for k in KEYS], *[F.col(c).alias(f"{c}_b") for c in carry])
    copies = asked.hint("merge").join(other, [f"_{k}" for k in KEYS])
    return copies.hint("merge").join(body, KEYS).select(*KEYS, "r", "nsp", *carry, *[f"{c}_b" for c in carry])


def join_pair(a: Column, b: Column, max_length: int = MAX_LENGTH) -> Column:
    """``CLS a SEP b SEP``, cutting the longer side first."""
    room = max_length - PAIR_SPECIALS
    na, nb = F.size(a), F.size(b)
    short = F.least(F.least(na, nb), F.lit(room // 2))
    long = F.least(F.greatest(na, nb), F.lit(room) - short)
    keep_a = F.when(na <= nb, short).otherwise(long)
    keep_b = F.when(na <= nb, long).otherwise(short)
    return F.concat(
        F.array(F.lit(CLS)),
        F.slice(a, F.lit(1), keep_a),
        F.array(F.lit(SEP)),
        F.slice(b, F.lit(1), keep_b),
        F.array(F.lit(SEP)),
    )


def mask_ranks(ids: Column, seed: int, keys: list[str]) -> Column:
    """Place of each position in hash order, CLS and SEP positions last.

    Two sorts of the row's own positions; nothing is searched.
    """
    tagged = let(
        hash_text(seed, *keys),
        lambda row: F.transform(
            ids,
            lambda x, i: F.struct(
                x.isin(CLS, SEP).alias("closed"),
                F.md5(F.concat(row, F.lit(":"), i.cast("string"))).alias("h"),
                i.alias("i"),
            ),
        ),
    )
    placed = F.transform(F.sort_array(tagged), lambda t, k: F.struct(t["i"].alias("i"), k.alias("k")))
    return F.transform(F.sort_array(placed), lambda t: t["k"])


def mask_tokens(
    df: DataFrame,
    keys: list[str],
    vocab_size: int,
    seed: int,
    probability: float = 0.3,
    ids: str = "ids",
    mask_id: int = MASK,
) -> DataFrame:
    """Pick ``ceil(p*m)`` of the m open positions; of those ``ceil(0.8*t)`` become MASK,
    half of the rest (rounded up) a random id, the others keep their id.

    Everything is local to the row. Adds ``inputs``, ``marks`` and ``labels``.
    """
    opened = F.size(F.filter(ids, lambda x: ~x.isin(CLS, SEP)))
    sized = df.withColumn("_t", F.ceil(opened * F.lit(float(probability))).cast("int"))
    sized = sized.withColumn("_m", F.ceil(F.col("_t") * F.lit(0.8)).cast("int"))
    sized = sized.withColumn("_r", F.ceil((F.col("_t") - F.col("_m")) * F.lit(0.5)).cast("int"))
    pairs = F.zip_with(ids, mask_ranks(F.col(ids), seed, keys), lambda x, k: F.struct(x.alias("x"), k.alias("k")))

    def random_id(i: Column) -> Column:
        digest = keyed_hash(f"{seed}r", *[F.col(k) for k in keys], i)
        return (F.lit(FIRST_PIECE) + hash_int(digest) % (vocab_size - FIRST_PIECE)).cast("int")

    cells = F.transform(
        pairs,
        lambda p, i: F.struct(
            F.when(p["k"] < F.col("_m"), F.lit(mask_id))
            .when(p["k"] < F.col("_m") + F.col("_r"), random_id(i))
            .otherwise(p["x"])
            .alias("input"),
            (p["k"] < F.col("_t")).cast("int").alias("mark"),
        ),
    )
    made = sized.withColumn("_cells", cells)
    return (
        made.withColumn("inputs", F.col("_cells.input"))
        .withColumn("marks", F.col("_cells.mark"))
        .withColumn("labels", F.col(ids))
        .drop("_t", "_m", "_r", "_cells")
    )


def nsp_mlm_instances(
    line_ids: DataFrame, vocab_size: int, seed: int, max_length: int = MAX_LENGTH, probability: float = 0.3, texts: bool = False
) -> DataFrame:
    """Sentence pairs, masked, with segments and padding marks, padded to ``max_length``.

    Lines are encoded once and partners joined as ids, so each text is coded once. A pair is
    joined, masked and padded in one kernel, as :func:`join_pair`, :func:`mask_tokens` and the
    array rules would; ``texts`` gives the padded arrays as text, one space between ids,
    whose padding is written and not built.
    """
    pairs = next_sentence_pairs(line_ids, seed, carry=["ids"])
    kind = "string" if texts else "array<int>"
    schema = with_keys(pairs, KEYS, "nsp int, " + ", ".join(f"{c} {kind}" for c in INSTANCE))
    rows = pairs.select(*KEYS, "nsp", hash_text(seed, *KEYS).alias("row"), "ids", "ids_b")
    return rows.mapInArrow(_instance_batches(vocab_size, str(seed), max_length, float(probability), texts), schema)


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of runs that begin at ``starts``, one run behind the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def _joined(a: pa.Array, b: pa.Array, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows, one behind the other, and their sizes, as of :func:`join_pair`."""
    na, nb = (pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (a, b))
    short = np.minimum(np.minimum(na, nb), room // 2)
    long = np.minimum(np.maximum(na, nb), room - short)
    kept = np.where(na <= nb, short, long), np.where(na <= nb, long, short)
    sizes = kept[0] + kept[1] + PAIR_SPECIALS
    ends = np.cumsum(sizes)
    ids = np.full(sizes.sum(), SEP, np.int32)
    ids[ends - sizes] = CLS
    for side, n, own, start in ((a, na, kept[0], ends - sizes + 1), (b, nb, kept[1], ends - 1 - kept[1])):
        ids[_spans(start, own)] = side.flatten().to_numpy(zero_copy_only=False)[_spans(np.cumsum(n) - n, own)]
    return ids, sizes


def _masked(ids, row, at, texts: list[bytes], drawn_texts: list[bytes], vocab_size: int, probability: float):
    """Inputs and marks as of :func:`mask_tokens`; only open positions are hashed, as closed ones come last."""
    opened = np.flatnonzero((ids != CLS) & (ids != SEP))
    own = row[opened]
    count = np.bincount(own, minlength=len(texts))
    marked = np.ceil(count * probability).astype(np.int64)
    masked = np.ceil(marked * 0.8).astype(np.int64)
    drawn = np.ceil((marked - masked) * 0.5).astype(np.int64)
    head, tail = numbered_md5(texts, own, at[opened])
    order = np.lexsort((head, own))
    if ((head[order][1:] == head[order][:-1]) & (own[order][1:] == own[order][:-1])).any():
        order = np.lexsort((tail, head, own))
    place = np.arange(len(own)) - (np.cumsum(count) - count)[own]  # rows keep their order
    spot, inputs, marks = opened[order], ids.copy(), np.zeros(len(ids), np.int32)
    marks[spot[place < marked[own]]] = 1
    inputs[spot[place < masked[own]]] = MASK
    other = spot[(place >= masked[own]) & (place < (masked + drawn)[own])]
    head, _ = numbered_md5(drawn_texts, row[other], at[other])
    inputs[other] = FIRST_PIECE + ((head >> np.uint64(4)) % np.uint64(vocab_size - FIRST_PIECE)).astype(np.int32)
    return inputs, marks


def _instance_batches(vocab_size: int, seed: str, max_length: int, probability: float, texts: bool):
    """Arrow batches of keys, nsp, the row's hashed text and both sides' ids to instances."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        padding = pa.array([" 0" * n for n in range(max_length + 1)])

        def shown(values: np.ndarray, row: np.ndarray, at: np.ndarray, sizes: np.ndarray, digits: bool) -> pa.Array:
            if texts and not digits:
                ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
                own = pc.binary_join(pa.ListArray.from_arrays(ends, pa.array(values).cast(pa.string())), " ")
                return pc.binary_join_element_wise(own, padding.take(pa.array(max_length - sizes)), "")
            padded = np.full((len(sizes), max_length), PAD, np.int32)
            padded[row, at] = values
            if not texts:
                return pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1) * max_length, pa.int32()), pa.array(padded.ravel()))
            width = 2 * max_length - 1
            written = np.full((len(sizes), width), ord(" "), np.uint8)
            written[:, ::2] = padded + ord("0")
            ends = np.arange(len(sizes) + 1, dtype=np.int32) * width
            return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(ends), pa.py_buffer(written))

        for whole in batches:
            for low in range(0, len(whole), INSTANCE_ROWS):
                batch = whole.slice(low, INSTANCE_ROWS)
                ids, sizes = _joined(batch.column("ids"), batch.column("ids_b"), max_length - PAIR_SPECIALS)
                row = np.repeat(np.arange(len(batch)), sizes)
                at = np.arange(len(ids)) - (np.cumsum(sizes) - sizes)[row]
                keys = [x.encode() + b":" for x in batch.column("row").to_pylist()]
                drawn = [seed.encode() + b"r" + x[len(seed.encode()) :] for x in keys]
                inputs, marks = _masked(ids, row, at, keys, drawn, vocab_size, probability)
                ends = np.flatnonzero(ids == SEP)[::-1]
                first = np.zeros(len(batch), np.int64)
                first[row[ends]] = at[ends]  # of several, the first is written last
                segments, attention = 1 + (at > first[row]), ids != PAD
                columns = zip((inputs, segments, attention, ids, marks), (False, True, True, False, True))
                made = [shown(x, row, at, sizes, digits) for x, digits in columns]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*KEYS, "nsp")), *made], names=[*KEYS, "nsp", *INSTANCE])

    return run


def seq2seq_instances(
    pairs: DataFrame, src_vocab: DataFrame, dst_vocab: DataFrame, keys: list[str], batch_size: int
) -> DataFrame:
    """Encode both sides of ``src_tokens``/``dst_tokens``, reverse the source, frame, batch,
    pad to the batch and order each batch by source length."""
    src = encode_tokens(pairs.select(*keys, F.col("src_tokens").alias("tokens")), src_vocab, keys, "src")
    dst = encode_tokens(pairs.select(*keys, F.col("dst_tokens").alias("tokens")), dst_vocab, keys, "dst")
    framed = frame_all(frame_all(src, "src", reverse=True).join(dst, keys), "dst")
    batches = batch_rows(framed.withColumn("src_len", F.size("src")), keys, batch_size, keys_from=pairs)
    padded = pad_batch(pad_batch(batches, "src"), "dst")
    return batch_length_sort(padded, "src_len", keys)


def classifier_instances(rows: DataFrame, vocab: DataFrame, key: str, length: int = 128) -> DataFrame:
    """``tokens`` and ``label`` to a fixed-length id row and its label."""
    coded = encode_tokens(rows, vocab, [key, "label"], "ids")
    return coded.select(key, pad_fixed(F.col("ids"), length).alias("x"), F.col("label").alias("y"))


def subtract_positions(all_positions: Column, chosen: Column) -> Column:
    """Positions left after removing the chosen ones."""
    return F.array_except(all_positions, chosen)
