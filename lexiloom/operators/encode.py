"""Tokens to ids and back, padding by batch, character grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import PAD, UNK, frame_sequence, pad_fixed
from ..runtime import fits_broadcast, materialize, with_keys
from .joins import lookup_join
from .ranking import batch_rows
from .terms import KEYS

# A vocabulary of up to this many words is sent to the tasks.
INLINE_ROWS = 100_000


def collect_ordered(rows: DataFrame, keys: list[str], value: str, out: str, carry: list[str] = ()) -> DataFrame:
    """Gather ``value`` by ``pos`` into one array per key; a null ``pos`` adds nothing."""
    placed = F.when(F.col("pos").isNotNull(), F.struct("pos", F.col(value).alias("v")))
    grouped = rows.groupBy(*keys, *carry).agg(F.sort_array(F.collect_list(placed)).alias("_l"))
    return grouped.select(*keys, *carry, F.transform("_l", lambda x: x["v"]).alias(out))


def encode_tokens(
    line_tokens: DataFrame, vocab: DataFrame, keys: list[str] = KEYS, out: str = "ids", unknown: int = UNK,
    inline: int = INLINE_ROWS,
) -> DataFrame:
    """Token arrays to id arrays; tokens outside the written vocabulary give ``unknown``.

    A vocabulary measured to be small is sent to the tasks and arrays are coded inside
    their rows, without a shuffle. A larger one is joined token by token.
    """
    if fits_broadcast(vocab.select("token", "id"), inline):
        words = vocab.sparkSession.sparkContext.broadcast(vocab.select("token", "id").toArrow())
        return line_tokens.select(*keys, "tokens").mapInArrow(
            inline_encoder(words, unknown), with_keys(line_tokens, keys, f"{out} array<int>")
        )
    rows = line_tokens.select(*keys, F.posexplode_outer("tokens").alias("pos", "token"))
    coded = lookup_join(rows, vocab, "token", ["id", "cnt"], hot_by="cnt")
    # Position and id in one number: short to shuffle and quick to sort.
    packed = F.shiftleft(F.col("pos").cast("bigint"), 32) + F.coalesce("id", F.lit(unknown))
    grouped = coded.groupBy(*keys).agg(F.sort_array(F.collect_list(packed)).alias("_l"))
    low = F.lit((1 << 32) - 1)
    return grouped.select(*keys, F.transform("_l", lambda x: x.bitwiseAND(low).cast("int")).alias(out))


def inline_encoder(words, unknown: int):
    """Arrow batches of keys and a token array (last) to keys and ids."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        table = words.value
        known, ids = table["token"].combine_chunks(), table["id"].combine_chunks().cast(pa.int32())
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            found = ids.take(pc.index_in(lists.flatten(), value_set=known)).fill_null(unknown)
            sizes = pc.fill_null(pc.list_value_length(lists), 0)
            coded = pa.ListArray.from_arrays(_offsets(sizes), found)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], coded], names=[str(i) for i in range(batch.num_columns)])

    def _offsets(sizes):
        import numpy as np
        import pyarrow as pa

        return pa.array(np.concatenate([[0], np.cumsum(sizes.to_numpy(zero_copy_only=False))]), pa.int32())

    return run


def inline_decoder(words, drop_below: int):
    """Arrow batches of keys and an id array (last) to keys and space-joined words."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        table = words.value
        known, tokens = table["id"].combine_chunks().cast(pa.int32()), table["token"].combine_chunks()
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            flat = lists.flatten().cast(pa.int32())
            place = pc.index_in(flat, value_set=known)
            keep = pc.and_(pc.fill_null(pc.greater_equal(flat, drop_below), False), pc.is_valid(place))
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            upto = np.concatenate([[0], np.cumsum(keep.to_numpy(zero_copy_only=False))])
            offsets = upto[np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)]
            found = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), tokens.take(place.filter(keep)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pc.binary_join(found, " ")], names=[str(i) for i in range(batch.num_columns)]
            )

    return run


def decode_ids(
    seqs: DataFrame, vocab: DataFrame, keys: list[str] = KEYS, ids: str = "ids", drop_below: int = 4,
    inline: int = INLINE_ROWS,
) -> DataFrame:
    """Id arrays to space-joined words, leaving out the ids below ``drop_below``.

    Small and large vocabularies as in :func:`encode_tokens`.
    """
    if fits_broadcast(vocab.select("token", "id"), inline):
        words = vocab.sparkSession.sparkContext.broadcast(vocab.select("token", "id").toArrow())
        return seqs.select(*keys, ids).mapInArrow(inline_decoder(words, drop_below), with_keys(seqs, keys, "text string"))
    rows = seqs.select(*keys, F.posexplode_outer(ids).alias("pos", "id"))
    kept = rows.withColumn("pos", F.when(F.col("id") >= drop_below, F.col("pos")))
    words = lookup_join(kept, vocab, "id", ["token", "cnt"], hot_by="cnt")
    return collect_ordered(words, keys, "token", "_w").select(*keys, F.concat_ws(" ", "_w").alias("text"))


def inline_recoder(vocab: DataFrame, unknown: int = UNK, drop_below: int = 4, inline: int = INLINE_ROWS):
    """An Arrow kernel that puts the words left by coding and decoding before a token array (last).

    The same words as :func:`encode_tokens` and :func:`decode_ids` leave, without a way
    through the rows for each; None where the vocabulary is too large to be sent.
    """
    if not fits_broadcast(vocab.select("token", "id"), inline):
        return None
    words = vocab.sparkSession.sparkContext.broadcast(vocab.select("token", "id").toArrow())

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            (coded,) = inline_encoder(words, unknown)(iter([batch]))
            (decoded,) = inline_decoder(words, drop_below)(iter([coded]))
            text = decoded.column(decoded.num_columns - 1)
            lists, filled = pc.split_pattern(text, " "), pc.not_equal(text, "").to_numpy(zero_copy_only=False)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            kept = lists.flatten().filter(pa.array(np.repeat(filled, sizes)))
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes * filled)]), pa.int32())
            left = pa.ListArray.from_arrays(offsets, kept)
            columns = [*batch.columns[:-1], left, batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(columns, names=[str(i) for i in range(len(columns))])

    return run


def batch_longest(sizes: DataFrame, size: str, keys: list[str], rows: int, batch: str = "batch") -> DataFrame:
    """keys, batch and longest: batches of ``rows`` rows in key order, and their largest size."""
    numbered = materialize(batch_rows(sizes.select(*keys, size), keys, rows, batch, keys_from=sizes), "batches")
    longest = numbered.groupBy(batch).agg(F.max(size).alias("longest"))
    return numbered.join(longest, batch).select(*keys, batch, "longest")


def pad_batch(df: DataFrame, ids: str, batch: str = "batch", value: int = PAD, cap: int | None = None) -> DataFrame:
    """Pad to the longest row of the batch. A batch has a fixed number of rows."""
    longest = F.max(F.size(ids)).over(Window.partitionBy(batch))
    if cap is not None:
        longest = F.least(longest, F.lit(cap))
    return df.withColumn("_len", longest).withColumn(ids, pad_fixed(F.col(ids), F.col("_len"), value)).drop("_len")


def word_char_rows(vocab: DataFrame, chars: DataFrame, width: int = 10) -> DataFrame:
    """Character ids of every vocabulary word, cut or padded to ``width``: once per word."""
    letters = vocab.select("id", F.posexplode(F.split("token", "")).alias("pos", "ch")).filter(
        (F.length("ch") > 0) & (F.col("pos") < width)
    )
    # A character vocabulary is cut at a given size when it is built.
    coded = letters.join(F.broadcast(chars.select("ch", F.col("id").alias("ch_id"))), "ch", "left")
    rows = collect_ordered(
        coded.select("id", "pos", F.coalesce("ch_id", F.lit(UNK)).alias("ch_id")), ["id"], "ch_id", "chars"
    )
    return rows.select("id", pad_fixed(F.col("chars"), width).alias("chars"))


def char_grids(
    coded: DataFrame, char_rows: DataFrame, keys: list[str] = KEYS, width: int = 10, inline: int = INLINE_ROWS
) -> DataFrame:
    """The grid of character ids of each id array, built last and without a shuffle.

    ``char_rows`` (written) has one row per word; other ids are special and have
    themselves in the first place. A table too large to be sent is joined by id.
    """
    if fits_broadcast(char_rows, inline):
        sent = coded.sparkSession.sparkContext.broadcast(char_rows.select("id", "chars").toArrow())
        return coded.select(*keys, "ids").mapInArrow(inline_grid(sent, width), with_keys(coded, keys, "grid array<array<int>>"))
    special = F.concat(F.array("id"), F.array_repeat(F.lit(PAD), width - 1))
    rows = coded.select(*keys, F.posexplode_outer("ids").alias("pos", "id"))
    found = lookup_join(rows, char_rows, "id", ["chars"], hot_by="id")
    return collect_ordered(found.withColumn("chars", F.coalesce("chars", special)), keys, "chars", "grid")


def inline_grid(sent, width: int):
    """Arrow batches of keys and an id array (last) to keys and rows of character ids."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        table = sent.value
        ids = table["id"].to_numpy()
        known = np.stack(table["chars"].to_numpy()) if len(ids) else np.empty((0, width))
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            top = int(max(flat.max(initial=0), ids.max(initial=0))) + 1
            rows = np.zeros((top, width), np.int32)
            rows[:, 0] = np.arange(top)
            rows[ids] = known
            cells = pa.ListArray.from_arrays(
                pa.array(np.arange(len(flat) + 1) * width, pa.int32()), pa.array(rows[flat].ravel(), pa.int32())
            )
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.ListArray.from_arrays(offsets, cells)],
                names=[str(i) for i in range(batch.num_columns)],
            )

    return run


def char_grid_texts(
    coded: DataFrame, char_rows: DataFrame, keys: list[str] = KEYS, width: int = 10, inline: int = INLINE_ROWS
) -> DataFrame:
    """keys, n_rows and ``text``: the grid of each id array as text, one space between numbers.

    With a table that can be sent, each id's row is written out once and then taken as a
    whole; a larger table goes through :func:`char_grids`.
    """
    if not fits_broadcast(char_rows, inline):
        grids = char_grids(coded, char_rows, keys, width, inline)
        return grids.select(*keys, F.size("grid").alias("n_rows"), render(F.flatten("grid")).alias("text"))
    sent = coded.sparkSession.sparkContext.broadcast(char_rows.select("id", "chars").toArrow())
    return coded.select(*keys, "ids").mapInArrow(inline_grid_text(sent, width), with_keys(coded, keys, "n_rows int, text string"))


def inline_grid_text(sent, width: int):
    """Arrow batches of keys and an id array (last) to keys, rows and the grid's text."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        table = sent.value
        known = dict(zip(table["id"].to_pylist(), table["chars"].to_pylist()))
        texts: dict[int, str] = {}
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            flat = lists.flatten().dictionary_encode()
            for i in flat.dictionary.to_pylist():
                if i not in texts:
                    texts[i] = " ".join(map(str, known.get(i, [i, *[PAD] * (width - 1)])))
            rows = pa.array([texts[i] for i in flat.dictionary.to_pylist()], pa.string()).take(flat.indices)
            sizes = pc.fill_null(pc.list_value_length(lists), 0)
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes.to_numpy(zero_copy_only=False))]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], sizes, pc.binary_join(pa.ListArray.from_arrays(offsets, rows), " ")],
                names=[str(i) for i in range(batch.num_columns + 1)],
            )

    return run


def frame_all(df: DataFrame, ids: str, reverse: bool = False) -> DataFrame:
    return df.withColumn(ids, frame_sequence(F.col(ids), reverse))


def render(ids: Column) -> Column:
    """Ids as text, one space between them."""
    return F.concat_ws(" ", F.transform(ids, lambda x: x.cast("string")))


def render_padded(ids: Column, missing: Column, pad: int) -> Column:
    """Ids as text, followed by ``missing`` times the padding id, which is written and not built."""
    return padded_text(render(ids), missing, pad)


def padded_text(text: Column, missing: Column, pad: int) -> Column:
    return F.ltrim(F.concat(text, F.repeat(F.lit(f" {pad}"), missing.cast("int"))))
