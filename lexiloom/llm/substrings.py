"""Removal of word windows that start earlier elsewhere, by super-k-mers.

A window is WINDOW consecutive words. Its minimiser is the smallest hash of RUN words in
it, the last of equal ones. Consecutive windows with the same minimiser travel together, as
one packed string of their words, to the bucket of the minimiser. Equal windows have equal
minimisers, so they meet in a bucket, where the strings come in the order of their texts,
are cut in windows and sorted: of equal windows the first one stays.

Strings that repeat inside a slice of texts are settled there and travel once. The
minimisers are counted beforehand. Those with a single string can't repeat: a bit table of
fixed size of the others spares the shuffle most of them (with more entries than bits it
lets more pass; it never drops a window that repeats). Those with more than HOT strings
would make a large bucket: their windows travel one by one, to a bucket of their own
content, once per slice. A bucket then holds the different windows of at most HOT strings,
whatever a passage is repeated.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import global_rank
from ..runtime import fits_broadcast, materialize
from .winnow import _bit_table
from .words import SPACE_BYTES, U64, _powers, mix, row_slices, run_hashes, text_bytes, word_table

WINDOW = 20
RUN = 5
HOT = 4096
TABLE_BITS, HOT_BITS = 27, 24
SLICE = 4 << 20
WINDOWS_AT_ONCE = 1 << 17
RANGES_ROWS, RANGES_BYTES = 1_000_000, 32 << 20  # ranges are broadcast up to this size
SENT = "bucket long, rid long, start int, until int, packed string"


class Texts:
    """The words of some rows: places, hashes, and their bytes with one space between words."""

    def __init__(self, texts: pa.Array):
        data, offsets = text_bytes(texts)
        starts, ends, self.hashes, self.counts = word_table(data, offsets, SPACE_BYTES)
        keep = np.zeros(len(data) + 1, np.int8)
        keep[starts] = 1
        keep[ends] -= 1
        inside = np.cumsum(keep[:-1], dtype=np.int8).astype(bool)
        if len(inside):
            gap = ~inside
            gap[1:] &= inside[:-1]
            gap[0] = False
            kept = inside | gap
            place = np.cumsum(kept) - 1
            self.data = np.where(inside, data, np.uint8(0x20))[kept]
            self.starts, self.ends = place[starts], place[ends - 1] + 1
        else:
            self.data, self.starts, self.ends = data, starts, ends
        self.last = np.cumsum(self.counts)  # one past the last word of each row
        self.row = np.repeat(np.arange(len(self.counts)), self.counts)
        self.first = (self.last - self.counts)[self.row] if len(self.row) else self.row

    def spans(self, first: np.ndarray, n_words: np.ndarray) -> pa.Array:
        """Runs of words as packed strings."""
        low, high = self.starts[first], self.ends[first + n_words - 1]
        return gather(self.data, low, high - low)


def gather(data: np.ndarray, low: np.ndarray, size: np.ndarray) -> pa.Array:
    """Strings of the given places and sizes of a run of bytes."""
    ends = np.append(0, np.cumsum(size)).astype(np.int64)
    shift = np.repeat(low - ends[:-1], size)
    flat = data[shift + np.arange(len(shift))] if len(shift) else np.empty(0, np.uint8)
    return pa.LargeStringArray.from_buffers(len(low), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(flat)))


def run_digest(hashes: np.ndarray, first: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """Hash of each run of words, for any lengths."""
    base, inverse = _powers(len(hashes) + 1)
    sums = np.append(U64(0), np.cumsum(hashes * base[: len(hashes)]))
    return mix((sums[first + n_words] - sums[first]) * inverse[first] + n_words.astype(U64))


def super_kmers(texts: Texts, window: int, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of windows and minimiser of each run of windows that share it."""
    n = len(texts.hashes) - window + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, U64)
    hashes = run_hashes(texts.hashes, run)
    least, place = hashes[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, window - run + 1):
        other = hashes[j : j + n]
        take = other <= least
        np.copyto(least, other, where=take)
        place[take] = j
    place += np.arange(n)
    whole = np.arange(n) + window <= texts.last[texts.row[:n]]
    new = whole.copy()
    new[1:] &= (place[1:] != place[:-1]) | ~whole[:-1] | (texts.row[1:n] != texts.row[: n - 1])
    first = np.flatnonzero(new)
    sizes = np.bincount(np.cumsum(new)[whole] - 1, minlength=len(first))
    return first, sizes, least[first]


def _firsts(codes: np.ndarray, rid: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Whether each entry is the first of its code, in the order of rid and place."""
    order = np.lexsort((place, rid))
    _, index = np.unique(codes[order], return_index=True)
    out = np.zeros(len(codes), bool)
    out[order[index]] = True
    return out


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[Texts, pa.RecordBatch]]:
    text = batch.column("text")
    size = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    for low, high in row_slices(np.append(0, np.cumsum(size)), SLICE):
        yield Texts(text.slice(low, high - low)), batch.slice(low, high - low)


def _minimiser_batches(window: int, run: int):
    """(hash, n): the different strings of each minimiser in a slice of texts."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts, _ in _slices(batch):
                first, sizes, least = super_kmers(texts, window, run)
                _, different = np.unique(run_digest(texts.hashes, first, sizes + window - 1), return_index=True)
                hashes, n = np.unique(least[different], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(n)], names=["hash", "n"])

    return kernel


def _has(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = (hashes & U64(len(table) * 8 - 1)).astype(np.int64)
    return (table[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


def _sent_batches(window: int, run: int, repeated, hot):
    """What goes to the buckets, and the ranges of words already known to go (without string)."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many, large = (np.frombuffer(x.value, np.uint8) for x in (repeated, hot))
        for batch in batches:
            for texts, rows in _slices(batch):
                yield from one_slice(texts, rows.column("rid").to_numpy(), many, large)

    def one_slice(texts: Texts, rids: np.ndarray, many: np.ndarray, large: np.ndarray) -> Iterator[pa.RecordBatch]:
        first, sizes, least = super_kmers(texts, window, run)
        digest = run_digest(texts.hashes, first, sizes + window - 1)
        _, code, count = np.unique(digest, return_inverse=True, return_counts=True)
        live = _has(many, least)
        candidate = live | (count[code] > 1)
        first, sizes, least, live = first[candidate], sizes[candidate], least[candidate], live[candidate]
        gone = np.zeros(len(texts.hashes) + 1, bool)  # windows, by first word
        n_words = sizes + window - 1
        packed = texts.spans(first, n_words)
        code = packed.dictionary_encode().indices.to_numpy()
        rid = rids[texts.row[first]]
        kept = _firsts(code, rid, first)
        again = ~kept
        gone[_each(first[again], sizes[again])] = True

        broad = kept & live & _has(large, least)
        whole = kept & live & ~broad
        yield from sent(texts, rids, least[whole], first[whole], packed.filter(pa.array(whole)))
        single = _each(first[broad], sizes[broad])
        if len(single):
            span = np.full(len(single), window)
            strings = texts.spans(single, span)
            own = _firsts(strings.dictionary_encode().indices.to_numpy(), rids[texts.row[single]], single)
            gone[single[~own]] = True
            yield from sent(
                texts, rids, run_digest(texts.hashes, single[own], span[own]), single[own], strings.filter(pa.array(own))
            )
        low, high = _runs(np.flatnonzero(gone), texts.row)
        if len(low):
            rid, base = rids[texts.row[low]], texts.first[low]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(mix(rid.view(U64)).view(np.int64)),
                    pa.array(rid),
                    pa.array((low - base).astype(np.int32)),
                    pa.array((high + window - base).astype(np.int32)),
                    pa.nulls(len(low), pa.string()),
                ],
                names=["bucket", "rid", "start", "until", "packed"],
            )

    def sent(texts, rids, bucket, first, packed) -> Iterator[pa.RecordBatch]:
        for low in range(0, len(first), 1 << 14):
            part = slice(low, low + (1 << 14))
            at = first[part]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(bucket[part].view(np.int64)),
                    pa.array(rids[texts.row[at]]),
                    pa.array((at - texts.first[at]).astype(np.int32)),
                    pa.nulls(len(at), pa.int32()),
                    packed[low : low + (1 << 14)].cast(pa.string()),
                ],
                names=["bucket", "rid", "start", "until", "packed"],
            )

    return kernel


def _each(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The members of consecutive ranges."""
    ends = np.cumsum(sizes)
    return np.repeat(first - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def _runs(places: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of adjacent places of one row."""
    if not len(places):
        return places, places
    own = row[places]
    new = np.append(True, (np.diff(places) != 1) | (np.diff(own) != 0))
    at = np.flatnonzero(new)
    return places[at], places[np.append(at[1:], len(places)) - 1]


def _bucket_batches(window: int):
    """(rid, start, until): words covered by windows that are not the first of their kind.

    Rows come by bucket and in the order of their texts. Of the bucket that a batch ends
    in, its different windows are kept for the next batch.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_bucket, held = None, pa.array([], pa.large_string())
        for batch in batches:
            known = pc.is_null(batch.column("packed"))
            yield ranges(*(batch.column(c).filter(known).to_numpy() for c in ("rid", "start", "until")))
            rows = batch.filter(pc.invert(known))
            bucket = rows.column("bucket").to_numpy()
            if not len(bucket):
                continue
            starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            ends = np.append(starts[1:], len(bucket))
            at = 0
            while at < len(starts):  # some buckets at a time
                to = at + 1
                while to < len(starts) and ends[to] - starts[at] <= WINDOWS_AT_ONCE // window:
                    to += 1
                before = held if held_bucket == bucket[starts[at]] else held[:0]
                found, left = settle(rows.slice(starts[at], ends[to - 1] - starts[at]), before, to == len(starts))
                yield found
                if to == len(starts):
                    held_bucket, held = bucket[-1], left
                at = to

    def settle(rows: pa.RecordBatch, before: pa.Array, last: bool) -> tuple[pa.RecordBatch, pa.Array]:
        bucket = rows.column("bucket").to_numpy()
        _, inverse, count = np.unique(bucket, return_inverse=True, return_counts=True)
        open_rows = count[inverse] > 1
        if len(before):
            open_rows |= inverse == inverse[0]
        if last:
            open_rows |= inverse == inverse[-1]
        rows = rows.filter(pa.array(open_rows))
        bucket = rows.column("bucket").to_numpy()
        data, offsets = text_bytes(rows.column("packed"))
        # Ends of words: at each space, and at the end of each string.
        gaps = np.flatnonzero(data == 0x20)
        per_row = np.diff(np.searchsorted(gaps, offsets)) + 1
        row = np.repeat(np.arange(len(rows)), per_row)
        word_end = np.empty(len(row), np.int64)
        closing = np.cumsum(per_row) - 1
        inner = np.ones(len(row), bool)
        inner[closing] = False
        word_end[inner], word_end[closing] = gaps, offsets[1:]
        word_start = np.append(0, word_end[:-1] + inner[:-1])
        opening = _each(closing + 1 - per_row, per_row - window + 1)  # first words of windows
        low, high = word_start[opening], word_end[opening + window - 1]
        strings = gather(data, low, high - low)
        owner = row[opening]
        n_before = len(before)
        both = pa.concat_arrays([before, strings])
        order = pc.sort_indices(
            pa.table({"window": both, "at": pa.array(np.arange(len(both)))}),
            sort_keys=[("window", "ascending"), ("at", "ascending")],
        ).to_numpy()
        ranked = both.take(pa.array(order))
        same = pc.equal(ranked[1:], ranked[:-1]).to_numpy(zero_copy_only=False) if len(ranked) > 1 else np.empty(0, bool)
        # Equal windows are in one bucket, as their minimiser is the same; order is that of the texts.
        again = np.zeros(len(both), bool)
        again[order[1:][same]] = True
        again = again[n_before:]
        at, to = _runs(opening[again], row)
        start = rows.column("start").to_numpy().astype(np.int64)
        first = (closing + 1 - per_row)[row[at]] if len(at) else at
        base = start[row[at]] - first if len(at) else at
        found = ranges(rows.column("rid").to_numpy()[row[at]], at + base, to + base + window)
        left = both[:0]
        if last:
            keep = np.zeros(len(both), bool)
            keep[n_before:] = ~again & (bucket[owner] == bucket[-1])
            if n_before and len(rows) and bucket[0] == bucket[-1]:
                keep[:n_before] = True
            left = both.filter(pa.array(keep))
        return found, left

    def ranges(rid, start, until) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(rid, pa.int64()), pa.array(start).cast(pa.int32()), pa.array(until).cast(pa.int32())],
            names=["rid", "start", "until"],
        )

    return kernel


def _cut_batches(with_text: bool):
    """The words of each row without those in its ranges."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts, rows in _slices(batch):
                own = rows.column("cuts")
                flat = pc.list_flatten(own).to_numpy().reshape(-1, 2)
                row = pc.list_parent_indices(own).to_numpy()[::2]
                base = (texts.last - texts.counts)[row]
                marks = np.zeros(len(texts.hashes) + 1, np.int32)
                np.add.at(marks, base + flat[:, 0], 1)
                np.add.at(marks, base + flat[:, 1], -1)
                kept = np.cumsum(marks[:-1]) == 0
                size = np.where(kept, texts.ends - texts.starts + 1, 0)
                strings = gather(texts.data, texts.starts[kept], (texts.ends - texts.starts)[kept])
                flat_bytes, _ = text_bytes(strings)
                # One space behind each word; a row's last one is left out.
                spaced = np.full(int(size.sum()), 0x20, np.uint8)
                if len(flat_bytes):
                    ends = np.cumsum(size[kept])
                    is_word = np.ones(len(spaced), bool)
                    is_word[ends - 1] = False
                    spaced[is_word] = flat_bytes
                total = np.append(0, np.cumsum(size))
                low, high = total[texts.last - texts.counts], total[texts.last]
                content = [spaced[a : max(a, b - 1)].tobytes() for a, b in zip(low.tolist(), high.tolist())]
                gone = np.append(0, np.cumsum(~kept))
                columns = [
                    rows.column("doc_id"),
                    pa.array(texts.counts.astype(np.int64)),
                    pa.array((gone[texts.last] - gone[texts.last - texts.counts]).astype(np.int64)),
                    pa.array([x.decode() for x in content] if with_text else [hashlib.sha256(x).hexdigest() for x in content], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept"])

    return kernel


def ordered(docs: DataFrame) -> DataFrame:
    """doc_id, rid, text; ``rid`` is a number for each row in the order of doc_id.

    It is doc_id itself where that is given and unique. Else rows are sorted and written
    with their place: null ids first, rows of one id by text.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    odd = slim.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 OR doc_id IS NULL").limit(1).count()
    if not odd:
        return slim.select("doc_id", F.col("doc_id").alias("rid"), "text")
    return global_rank(slim, ["doc_id", "text"], "rid").select("doc_id", F.col("rid").cast("long").alias("rid"), "text")


def repeated_ranges(
    rows: DataFrame, window: int = WINDOW, run: int = RUN, hot: int = HOT, bits: int = TABLE_BITS
) -> DataFrame:
    """(rid, cuts): per row with any, the word ranges that its repeated windows cover.

    ``cuts`` is start, end, start, end, ... of ranges that neither touch nor overlap. ``rows``
    has rid and text and is read twice.
    """
    spark = rows.sparkSession
    slim = rows.select("rid", "text")
    counted = slim.mapInArrow(_minimiser_batches(window, run), "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    many = materialize(counted.filter("n > 1"), "minimisers")
    repeated = spark.sparkContext.broadcast(_bit_table(many, bits))
    large = spark.sparkContext.broadcast(_bit_table(many.filter(F.col("n") > hot), min(bits, HOT_BITS)))
    sent = slim.mapInArrow(_sent_batches(window, run, repeated, large), SENT)
    dealt = sent.repartition("bucket").sortWithinPartitions("bucket", "rid", "start")
    found = dealt.mapInArrow(_bucket_batches(window), "rid long, start int, until int")
    # The ranges of a row are bounded by its own words.
    spans = found.groupBy("rid").agg(F.collect_list(F.struct("start", "until")).alias("spans"))
    flat = spans.select("rid", F.col("spans.start").alias("start"), F.col("spans.until").alias("until"))
    return materialize(flat.mapInArrow(_merged_batches, "rid long, cuts array<int>"), "ranges")


def _merged_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges of each row that touch or overlap become one."""
    for batch in batches:
        row = pc.list_parent_indices(batch.column("start")).to_numpy().astype(np.int64)
        start, until = ((row << 32) + pc.list_flatten(batch.column(c)).to_numpy() for c in ("start", "until"))
        order = np.argsort(start, kind="stable")  # rows are in order already, as their number leads
        start, reach = start[order], np.maximum.accumulate(until[order])
        new = np.flatnonzero(np.append(True, start[1:] > reach[:-1])) if len(start) else np.empty(0, np.int64)
        last = np.append(new[1:], len(start)) - 1
        flat = np.stack([start[new], reach[last]], axis=1) & 0xFFFFFFFF
        sizes = 2 * np.bincount(start[new] >> 32, minlength=len(batch))
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(flat.ravel().astype(np.int32)))
        yield pa.RecordBatch.from_arrays([batch.column("rid"), lists], names=["rid", "cuts"])


def without_repeats(
    docs: DataFrame,
    window: int = WINDOW,
    run: int = RUN,
    hot: int = HOT,
    bits: int = TABLE_BITS,
    with_text: bool = False,
    broadcast: bool | None = None,
) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (or the text, as ``kept``) of every row of ``docs``.

    ``docs`` has doc_id and text; further columns are ignored. Words are runs without
    spaces, tabs and line ends. A word goes when a window over it starts earlier too, in
    a row with a smaller doc_id or in the same text; the kept words are joined by single
    spaces. Rows without doc_id come first, rows that share an id follow one another by
    text, so of equal rows one keeps its words. Texts of fewer words than a window lose
    none; null and empty texts have no words; an empty table gives no rows.

    The ranges of repeated words go to the texts where they were measured to be small;
    beyond, both are joined by a shuffle.
    """
    rows = ordered(docs)
    cuts = repeated_ranges(rows, window, run, hot, bits)
    small = fits_broadcast(cuts, RANGES_ROWS, RANGES_BYTES) if broadcast is None else broadcast
    joined = rows.join(F.broadcast(cuts) if small else cuts.hint("merge"), "rid", "left")
    kind = "doc_id long, n_words long, n_removed long, kept string"
    named = joined.select("doc_id", "text", F.coalesce("cuts", F.array().cast("array<int>")).alias("cuts"))
    made = named.mapInArrow(_cut_batches(with_text), kind)
    return made if with_text else made.withColumnRenamed("kept", "kept_sha256")
