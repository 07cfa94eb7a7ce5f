"""Benchmark decontamination by winnowing.

Of every SPAN consecutive words, whose runs of K words have SPAN - K + 1 hashes, the
smallest hash is kept (the rightmost of equal ones) with the words around it. Any span
shared by a document and an item therefore keeps the same fingerprint on both sides: the
join on fingerprints misses no shared span of SPAN words, and the words around a joined
fingerprint are compared outwards to confirm it and to find its extent.

An item of fewer words is one window: its length m is winnowed with runs of m words and
windows of one hash, which keeps every run of m words.

A fixed-size bit table of the items' fingerprints goes to all tasks and spares the join
the fingerprints that no item has; it is a filter only, the join decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize
from .common import text_or_empty
from .words import NOT_ALNUM_BYTES, U64, run_hashes, word_hashes

SPAN = 13
K = 5
TABLE_BITS = 24
HITS = "array<struct<span:int,at:int,hash:long,around:binary>>"


def fingerprints(words: np.ndarray, ends: np.ndarray, span: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the fingerprints of consecutive texts that end at ``ends``."""
    hashes = run_hashes(words, k)
    window = span - k + 1
    n = len(words) - span + 1
    if n <= 0:
        return np.empty(0, np.int64), hashes[:0]
    least, place = hashes[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, window):
        other = hashes[j : j + n]
        take = other <= least
        np.copyto(least, other, where=take)
        place[take] = j
    end_of = np.repeat(ends, np.diff(ends, prepend=0))[:n]
    starts = np.flatnonzero(np.arange(n) + span <= end_of)
    at = np.unique(starts + place[starts])
    return at, hashes[at]


def _around(words: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, reach: int, k: int, blank: int):
    """Words from ``reach`` before to ``reach`` after each run; ``blank`` beyond the text."""
    index = at[:, None] + np.arange(-reach, k + reach)
    outside = (index < low[:, None]) | (index >= high[:, None])
    found = words[np.clip(index, 0, max(0, len(words) - 1))]
    found[outside] = U64(blank)
    return found


def _scan(spans: list[int], k: int, span: int, table, blank: int):
    """Rows with their word count and the fingerprints that the bit table lets pass."""

    def one_slice(words: np.ndarray, counts: np.ndarray, bits: np.ndarray | None) -> list[list[dict]]:
        ends = np.cumsum(counts)
        rows: list[list[dict]] = [[] for _ in counts]
        for m in spans:
            own = k if m == span else m
            at, hashes = fingerprints(words, ends, m, own)
            if bits is not None:
                place = (hashes & U64(len(bits) * 8 - 1)).astype(np.int64)
                passed = (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
                at, hashes = at[passed], hashes[passed]
            if len(at) == 0:
                continue
            row = np.searchsorted(ends, at, side="right")
            low = ends[row] - counts[row]
            around = _around(words, at, low, ends[row], m - own, own, blank)
            for r, a, h, x in zip(row.tolist(), (at - low).tolist(), hashes.view(np.int64).tolist(), around):
                rows[r].append({"span": m, "at": a, "hash": h, "around": x.tobytes()})
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if table is None else np.frombuffer(table.value, np.uint8)
        kind = pa.list_(
            pa.struct([("span", pa.int32()), ("at", pa.int32()), ("hash", pa.int64()), ("around", pa.binary())])
        )
        for batch in batches:
            n_words, hits = [], []
            for _, words, counts in word_hashes(batch.column("text"), NOT_ALNUM_BYTES):
                n_words.extend(counts.tolist())
                hits.extend(one_slice(words, counts, bits))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n_words, pa.int64()), pa.array(hits, kind)],
                names=["id", "n_words", "hits"],
            )

    return run


def _short_lengths(items: DataFrame, span: int) -> list[int]:
    """Word counts below ``span`` that occur among the items; at most span - 1 numbers."""

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [counts for _, _, counts in word_hashes(batch.column("text"), NOT_ALNUM_BYTES)]
            n = np.concatenate([np.empty(0, np.int64), *found])
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(n[(n > 0) & (n < span)]))], names=["m"])

    rows = items.select("text").mapInArrow(lengths, "m long").distinct().collect()
    return sorted(r["m"] for r in rows)


def _item_batches(k: int, span: int):
    """One row per fingerprint of an item; a short item has one of its own length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_pylist()
            out: list[tuple] = []
            for first, words, counts in word_hashes(batch.column("text"), NOT_ALNUM_BYTES):
                ends = np.cumsum(counts)
                for i, (end, n) in enumerate(zip(ends, counts)):
                    own = words[end - n : end]
                    m = min(int(n), span)
                    run_length = k if m == span else m
                    if n == 0:
                        continue
                    at, hashes = fingerprints(own, np.array([n]), m, run_length)
                    around = _around(own, at, np.zeros(len(at)), np.full(len(at), n), m - run_length, run_length, 1)
                    out += [
                        (ids[first + i], m, int(h), x.tobytes()) for h, x in zip(hashes.view(np.int64), around)
                    ]
            columns = list(zip(*out)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(columns[0], pa.string()),
                    pa.array(columns[1], pa.int32()),
                    pa.array(columns[2], pa.int64()),
                    pa.array(columns[3], pa.binary()),
                ],
                names=["item", "span", "hash", "item_around"],
            )

    return run


def _bit_table(prints: DataFrame, bits: int) -> bytes:
    """2**bits bits, one set for each fingerprint; at most 2**bits / 8 bytes reach the driver."""
    place = F.col("hash").bitwiseAND(F.lit((1 << bits) - 1)) + 1
    rows = (
        prints.select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("place"))
        .groupBy("bucket")
        .agg(F.bitmap_construct_agg("place").alias("bits"))
        .collect()
    )
    table = bytearray((1 << bits) // 8)
    for r in rows:
        start = (r["bucket"] - 1) * 4096
        part = r["bits"][: len(table) - start]
        table[start : start + len(part)] = part
    return bytes(table)


def _extent_batches(k: int, span: int):
    """Compare the words around a joined fingerprint outwards; keep whole windows only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column("span").to_numpy(zero_copy_only=False)
            at = batch.column("at").to_numpy(zero_copy_only=False).astype(np.int64)
            start, stop = at.copy(), at.copy()
            good = np.zeros(len(at), bool)
            for m in np.unique(spans):
                own = k if m == span else int(m)
                reach = int(m) - own
                rows = np.flatnonzero(spans == m)
                pick = pa.array(rows)
                sides = [
                    np.frombuffer(b"".join(batch.column(c).take(pick).to_pylist()), U64).reshape(len(rows), own + 2 * reach)
                    for c in ("around", "item_around")
                ]
                same = sides[0] == sides[1]
                left = np.logical_and.accumulate(same[:, :reach][:, ::-1], axis=1).sum(axis=1)
                right = np.logical_and.accumulate(same[:, reach + own :], axis=1).sum(axis=1)
                good[rows] = same[:, reach : reach + own].all(axis=1) & (left + own + right >= m)
                start[rows] -= left
                stop[rows] += own + right
            keep = pa.array(good)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("rid").filter(keep),
                    batch.column("item").filter(keep),
                    pa.array(start[good]),
                    pa.array(stop[good]),
                ],
                names=["rid", "item", "start", "stop"],
            )

    return run


def shared_spans(docs: DataFrame, items: DataFrame, k: int = K, span: int = SPAN, bits: int = TABLE_BITS):
    """(rows, spans): the documents with row number and word count, and their shared spans.

    ``rows`` is doc_id, rid, n_words; ``spans`` is rid, item, start, stop in words.
    """
    spark = docs.sparkSession
    named = items.select(F.col("item_id").cast("string").alias("id"), text_or_empty("text").alias("text"))
    prints = materialize(
        named.mapInArrow(_item_batches(k, span), "item string, span int, hash long, item_around binary").distinct(),
        "items",
    )
    spans = [*_short_lengths(named, span), span]
    table = spark.sparkContext.broadcast(_bit_table(prints, bits))
    slim = docs.select(F.col("doc_id").cast("long").alias("id"), text_or_empty("text").alias("text"))
    scanned = slim.mapInArrow(_scan(spans, k, span, table, 0), f"id long, n_words long, hits {HITS}")
    rows = materialize(
        scanned.withColumnRenamed("id", "doc_id").withColumn("rid", F.monotonically_increasing_id()), "scanned"
    )
    hits = rows.select("rid", F.inline("hits"))
    joined = hits.join(prints, ["span", "hash"]).select("rid", "item", "span", "at", "around", "item_around")
    found = joined.mapInArrow(_extent_batches(k, span), "rid long, item string, start long, stop long")
    return rows.select("rid", "doc_id", "n_words"), found


def contamination(
    docs: DataFrame, items: DataFrame, percent: int = 5, k: int = K, span: int = SPAN, bits: int = TABLE_BITS
) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of ``docs``.

    ``docs`` has doc_id and text, ``items`` item_id and text; further columns are
    ignored. Null and empty texts have no words and hit nothing, an empty item table
    hits nothing, repeated rows stay rows of their own. An item without id is counted in
    the hit words, but can't be named.
    """
    rows, found = shared_spans(docs, items, k, span, bits)
    # A row's spans and items are bounded by its own words and the items it contains.
    merged = found.groupBy("rid").agg(
        F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("spans"),
        F.sort_array(F.collect_set("item")).alias("items"),
    )
    covered = F.expr(
        "aggregate(spans, named_struct('n', 0L, 'until', 0L), (a, x) -> named_struct("
        "'n', a.n + greatest(0L, x.stop - greatest(x.start, a.until)), 'until', greatest(a.until, x.stop)), a -> a.n)"
    )
    merged = merged.select(
        "rid",
        covered.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
    )
    none = F.lit(0).cast("long")
    joined = rows.join(merged, "rid", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", none).alias("n_hit"),
        F.coalesce("n_items", none).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
    )
    rule = (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words"))
    return joined.withColumn("contaminated", rule)
