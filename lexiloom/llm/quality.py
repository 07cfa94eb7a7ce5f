"""Quality classifier: interpolated modified Kneser-Ney n-gram model of trusted text.

Symbols are bytes, n-grams have five of them. Every task counts the n-grams of its part of
the trusted text; counts are summed by n-gram over the cluster, and the model is made of
joins of count tables that are sharded by n-gram and by context. It stays in these tables,
which grow with the trusted text: nothing of it reaches the driver.

Texts are scored by joins with them. Neighbouring rows of a file form a slice. The different
n-grams of a slice are looked up, not those of each document: each n-gram of the corpus gets
its bits once, by lookups of itself, its context and its shorter endings. The bits of a
slice's n-grams and its texts meet in one exchange, sorted so that the bits come first;
texts then stream past them, and only their sums are kept.
A fifth of the trusted documents is not used for counting; their perplexities give the
quantiles, per language and length class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from ..operators.joins import lookup_join
from ..runtime import materialize
from .common import BROADCAST_IDS, only_ids
from .words import row_slices, text_bytes

ORDER = 5
SYMBOL_BITS = 8
SYMBOLS = 1 << SYMBOL_BITS
START = 10  # a text begins after ORDER - 1 line ends
PIECE_BYTES = 512 << 10
HELD_GRAMS = 1 << 21
# Symbols of n-grams that are few enough to be sent unmeasured: 65,536 at most.
SHORT = 2
# Rows of a file that make a slice, by the longest text in bytes: at most a gigabyte, which is
# streamed. Longer texts are slices of their own.
SLICES = ((64 << 10, 16384), (4 << 20, 256))
UPPER, LOWER = 0.99, 0.001
SLACK = 0.05
STEADY = 100
HELD_OUT = 5
STEPS = 1000


def _packed(symbols: np.ndarray) -> np.ndarray:
    n = len(symbols) - ORDER + 1
    grams = symbols[:n].astype(np.int64)
    for j in range(1, ORDER):
        grams <<= SYMBOL_BITS
        grams |= symbols[j : j + n]
    return grams


def _grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Pieces of whole texts or of parts of a long one: first row, n-grams, n-grams per row.

    A text begins after ORDER - 1 line ends; a later part begins after the part before it.
    """
    lead = ORDER - 1
    for at, end in row_slices(offsets, PIECE_BYTES):
        low, high = int(offsets[at]), int(offsets[end])
        if high - low > PIECE_BYTES:  # one long text
            for x in range(low, high, PIECE_BYTES):
                start = max(low, x - lead)
                before = np.full(lead - (x - start), START, np.uint8)
                grams = _packed(np.concatenate([before, data[start : min(high, x + PIECE_BYTES)]]))
                yield at, grams, np.array([len(grams)])
        else:
            counts = np.diff(offsets[at : end + 1])
            where = np.arange(high - low) + np.repeat(np.arange(1, end - at + 1) * lead, counts)
            padded = np.full(high - low + (end - at) * lead, START, np.uint8)
            padded[where] = data[low:high]
            yield at, _packed(padded)[where - lead], counts


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different n-grams of a task and their counts, given out when many are held."""
    seen, counts = np.empty(0, np.int64), np.empty(0, np.int64)

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts)], names=["gram", "n"])

    for batch in batches:
        for _, grams, _ in _grams(*text_bytes(batch.column("text"))):
            own, n = np.unique(grams, return_counts=True)
            seen, place = np.unique(np.concatenate([seen, own]), return_inverse=True)
            summed = np.zeros(len(seen), np.int64)
            np.add.at(summed, place, np.concatenate([counts, n]))
            counts = summed
            if len(seen) > HELD_GRAMS:
                yield rows()
                seen, counts = seen[:0], counts[:0]
    yield rows()


def _discounts(tables: dict[int, DataFrame]) -> dict[int, list[float]]:
    """Modified Kneser-Ney discounts of counts 1, 2 and 3 or more per order, kept within 0..count; one job for all."""
    rare = None
    for k, table in tables.items():
        own = table.filter("n <= 4").select(F.lit(k).alias("k"), "n")
        rare = own if rare is None else rare.union(own)
    found = {(r["k"], r["n"]): r["count"] for r in rare.groupBy("k", "n").count().collect()}  # four counts per order
    discounts = {}
    for k in tables:
        n = [found.get((k, i), 0) for i in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
        own = [i - (i + 1) * y * n[i] / n[i - 1] if n[i - 1] and n[i] else y * i for i in (1, 2, 3)]
        discounts[k] = [min(max(d, 0.1), i - 0.1) for i, d in zip((1, 2, 3), own)]
    return discounts


def _ending(gram: Column, k: int) -> Column:
    return gram.bitwiseAND(F.lit((1 << SYMBOL_BITS * k) - 1))


def train(texts: DataFrame) -> dict[int, tuple[DataFrame, DataFrame]]:
    """Order -> written tables (gram, p) and (context, weight) of a DataFrame with a column text.

    p is the probability of a seen n-gram, weight what a context leaves to the next lower
    order. A context has 256 n-grams at most, so no key of these joins is hot.
    """
    counted = texts.select("text").mapInArrow(_count_batches, "gram long, n long")
    tables = {ORDER: materialize(counted.groupBy("gram").agg(F.sum("n").alias("n")), "grams")}
    for k in range(ORDER - 1, 0, -1):  # number of different symbols before the n-gram
        shorter = tables[k + 1].groupBy(_ending(F.col("gram"), k).alias("gram"))
        tables[k] = materialize(shorter.agg(F.count("*").alias("n")), "grams")
    model: dict[int, tuple[DataFrame, DataFrame]] = {}
    discounts = _discounts(tables)
    for k in range(1, ORDER + 1):
        d1, d2, d3 = discounts[k]
        taken = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        rows = tables[k].withColumn("taken", taken).withColumn("context", F.shiftright("gram", SYMBOL_BITS))
        contexts = rows.groupBy("context").agg(F.sum("n").alias("all"), F.sum("taken").alias("left"))
        contexts = materialize(contexts.withColumn("weight", F.col("left") / F.col("all")), "contexts")
        rows = rows.join(contexts, "context")
        if k == 1:
            rows = rows.withColumn("below", F.lit(1.0 / SYMBOLS))
        else:
            lower = model[k - 1][0].select(F.col("gram").alias("rest"), F.col("p").alias("below"))
            rows = rows.withColumn("rest", _ending(F.col("gram"), k - 1)).join(lower, "rest")
        p = (F.col("n") - F.col("taken")) / F.col("all") + F.col("weight") * F.col("below")
        model[k] = materialize(rows.select("gram", p.alias("p")), "model"), contexts.select("context", "weight")
    return model


def _looked_up(rows: DataFrame, table: DataFrame, key: str, value: str, symbols: int) -> DataFrame:
    """Left join of ``value``; n-grams of up to two symbols are 65,536 at most and not measured."""
    if symbols <= SHORT:
        return rows.join(F.broadcast(table), key, "left")
    return lookup_join(rows, table, key, [value])


def gram_bits(grams: DataFrame, model: dict[int, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(gram, bits) of the different n-grams in ``grams``, by lookups in the tables of each order.

    N-grams that the model has are answered where they are made distinct: that join needs the
    same exchange, and its table, the largest one, is not sent. Where an n-gram isn't seen,
    the weight of its context and its next shorter ending count; an unseen context leaves
    everything to the ending.
    """
    known = grams.select("gram").distinct().join(model[ORDER][0], "gram", "left")
    known = materialize(known.select("gram", "p"), "bits")
    found = known.filter("p is null").select("gram")
    for k in range(1, ORDER + 1):
        below = F.lit(1.0 / SYMBOLS) if k == 1 else F.col("p")
        seen, contexts = model[k]
        found = found.withColumn("below", below).withColumn("ending", _ending(F.col("gram"), k)).drop("p")
        found = found.withColumn("context", F.shiftright("ending", SYMBOL_BITS))
        found = _looked_up(found, contexts, "context", "weight", k - 1)
        p = F.coalesce("weight", F.lit(1.0)) * F.col("below")
        if k < ORDER:
            seen = seen.select(F.col("gram").alias("ending"), F.col("p").alias("own"))
            found = _looked_up(found, seen, "ending", "own", k)
            p = F.coalesce("own", p)
        found = found.select("gram", p.alias("p"))
        if k > SHORT:
            found = materialize(found, "bits")
    both = known.filter("p is not null").union(found)
    return both.select("gram", (-F.log2("p")).alias("bits"))


def placed(docs: DataFrame) -> DataFrame:
    """``docs`` with _file, _row and _slice, the same at every reading: the place of a row in its file.

    Rows that don't come from a file as they are get written first.
    """
    try:
        place = docs.metadataColumn("_metadata")
        docs.select(place["file_path"], place["row_index"])
    except AnalysisException:
        docs = materialize(docs, "rows")
        place = docs.metadataColumn("_metadata")
    size, rows = F.coalesce(F.octet_length("text"), F.lit(0)), F.lit(1)
    for longest, n in reversed(SLICES):
        rows = F.when(size <= longest, n).otherwise(rows)
    docs = docs.withColumns({"_file": F.xxhash64(place["file_path"]), "_row": place["row_index"], "_rows": rows})
    return docs.withColumn("_slice", F.xxhash64("_file", "_rows", F.floor(F.col("_row") / F.col("_rows")))).drop("_rows")


def _slice_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different n-grams of each slice; some may come twice where many are held."""
    held: dict[int, list[np.ndarray]] = {}
    size = 0

    def rows() -> Iterator[pa.RecordBatch]:
        for key, parts in held.items():
            grams = np.unique(np.concatenate(parts))
            keys = pa.array(np.full(len(grams), key, np.int64))
            yield pa.RecordBatch.from_arrays([keys, pa.array(grams)], names=["_slice", "gram"])
        held.clear()

    for batch in batches:
        slices = batch.column("_slice").to_numpy(zero_copy_only=False)
        for key in np.unique(slices):
            own = batch.column("text").filter(pa.array(slices == key))
            for _, grams, _ in _grams(*text_bytes(own)):
                held.setdefault(int(key), []).append(np.unique(grams))
                size += len(held[int(key)][-1])
                if size > HELD_GRAMS:
                    for k, parts in held.items():
                        held[k] = [np.unique(np.concatenate(parts))]
                    size = sum(len(parts[0]) for parts in held.values())
                    if size > HELD_GRAMS // 2:
                        yield from rows()
                        size = 0
    yield from rows()


def slice_bits(rows: DataFrame, model: dict[int, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(_slice, gram, bits) of all n-grams in rows with _slice and text."""
    grams = materialize(rows.select("_slice", "text").mapInArrow(_slice_batches, "_slice long, gram long"), "grams")
    bits = gram_bits(grams, model)
    return lookup_join(grams, bits.select("gram", F.col("bits").cast("float").alias("bits")), "gram", ["bits"])


def _score_batches(columns: list[str]):
    """Texts of a slice against the bits that stand before them; only their sums go on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, keys, values = None, [], None, None
        for batch in batches:
            slices = batch.column("_slice").to_numpy(zero_copy_only=False)
            is_text = batch.column("gram").is_null().to_numpy(zero_copy_only=False)
            changes = np.flatnonzero((slices[1:] != slices[:-1]) | (is_text[1:] != is_text[:-1])) + 1
            for a, b in zip([0, *changes], [*changes, len(slices)]):
                part = batch.slice(a, b - a)
                if slices[a] != key or (keys is not None and not is_text[a]):
                    key, parts, keys = slices[a], [], None
                if not is_text[a]:
                    parts.append([part.column(c).to_numpy(zero_copy_only=False) for c in ("gram", "bits")])
                    continue
                if keys is None:  # a slice of empty texts has no n-grams
                    keys, values = map(np.concatenate, zip(*parts)) if parts else (np.empty(0, np.int64), np.empty(0, np.float32))
                    order, parts = np.argsort(keys), []
                    keys, values = keys[order], values[order]
                data, offsets = text_bytes(part.column("text"))
                bits = np.zeros(len(offsets) - 1)
                for first, grams, counts in _grams(data, offsets):
                    ends, full = np.cumsum(counts), np.flatnonzero(counts)
                    if len(full):
                        found = values[np.searchsorted(keys, grams)].astype(np.float64)
                        bits[first + full] += np.add.reduceat(found, (ends - counts)[full])
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in columns], pa.array(bits), pa.array(np.diff(offsets))],
                    names=[*columns, "_bits", "_bytes"],
                )

    return run


def scored(rows: DataFrame, bits: DataFrame) -> DataFrame:
    """All columns of ``rows`` but _slice and text, with _bits and _bytes of each text."""
    kept = [f for f in rows.schema.fields if f.name not in ("_slice", "text")]
    schema = T.StructType([*kept, T.StructField("_bits", T.DoubleType()), T.StructField("_bytes", T.LongType())])
    both = bits.unionByName(rows, allowMissingColumns=True)
    dealt = both.repartition("_slice").sortWithinPartitions("_slice", F.col("gram").isNull())
    return dealt.mapInArrow(_score_batches([f.name for f in kept]), schema)


def _per_byte() -> Column:
    return F.col("_bits") / F.greatest("_bytes", F.lit(1))


def _length_class() -> Column:
    """Powers of four of the byte length."""
    return F.floor(F.log2(F.greatest("_bytes", F.lit(1))) / 2).cast("int")


def thresholds(held_out: DataFrame, upper: float, lower: float, slack: float, steady: int) -> DataFrame:
    """(lang, length, low, high) in bits per byte; a null part means any.

    Quantiles are exact in steps of a thousandth of a bit: documents are counted by
    step, and the steps are summed per group. What few documents say is uncertain: with n
    of them the slack is ``1 + steady / n`` times as wide, and the limits lie between the
    group's own, with a weight of ``n / (n + steady)``, and those of the next larger group
    (a language for its length class, all documents for a language). This is one rule for
    every n; with many documents only the group's own quantiles and the slack are left.
    """
    rows = held_out.filter("_bytes > 0").select(
        "lang", _length_class().alias("length"), F.floor(_per_byte() * STEPS).alias("step")
    )
    counts = rows.groupBy("lang", "length", "step").agg(F.count("*").alias("n"))
    any_length = counts.filter("lang IS NOT NULL").withColumn("length", F.lit(None).cast("int"))
    every = counts.withColumn("length", F.lit(None).cast("int")).withColumn("lang", F.lit(None).cast("string"))
    counts = counts.filter("lang IS NOT NULL").unionByName(any_length).unionByName(every)
    counts = counts.groupBy("lang", "length", "step").agg(F.sum("n").alias("n"))
    group = Window.partitionBy("lang", "length")  # a group has some thousand steps at most
    run = counts.withColumn("upto", F.sum("n").over(group.orderBy("step"))).withColumn("all", F.sum("n").over(group))
    wide = slack * (1 + steady / F.col("docs"))
    found = (
        run.groupBy("lang", "length")
        .agg(
            F.max("all").alias("docs"),
            (F.min(F.when(F.col("upto") >= upper * F.col("all"), F.col("step") + 1)) / STEPS).alias("high"),
            (F.min(F.when(F.col("upto") >= lower * F.col("all"), F.col("step"))) / STEPS).alias("low"),
        )
        .withColumns({"high": F.col("high") + wide, "low": F.col("low") - wide})
    )
    found = materialize(found, "quantiles")  # read three times

    def between(own: DataFrame, larger: DataFrame, on: Column) -> DataFrame:
        weight = F.col("docs") / (F.col("docs") + steady)
        joined = own.join(larger.select(F.col("lang").alias("_l"), F.col("low").alias("_low"), F.col("high").alias("_high")), on)
        limits = {c: weight * F.col(c) + (1 - weight) * F.col(f"_{c}") for c in ("low", "high")}
        return joined.withColumns(limits).select("lang", "length", "low", "high")

    whole = found.filter("lang IS NULL")
    langs = between(found.filter("lang IS NOT NULL AND length IS NULL"), whole, F.lit(True))  # one row
    cells = between(found.filter("length IS NOT NULL"), langs, F.col("lang") == F.col("_l"))
    return whole.select("lang", "length", "low", "high").unionByName(langs).unionByName(cells)


def verdicts(
    parts: DataFrame,
    labels: DataFrame,
    upper: float = UPPER,
    lower: float = LOWER,
    slack: float = SLACK,
    steady: int = STEADY,
) -> DataFrame:
    """_file, _row, doc_id, lang, _perplexity (per byte), _low, _high, _accepted of placed rows.

    Trusted are documents labelled quality 1 and never toxic. Those with
    crc32(doc_id) mod 5 = 0 give the quantiles, the others the counts. A document is
    accepted when its perplexity is within the limits of its language and length class,
    or of its language, or of all documents, whichever is the first with held-out
    documents; a null language goes to the last. Null and empty texts are not accepted.
    Without any held-out document every other text is. Texts move once, to their slice.
    """
    trusted = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    trusted = trusted.filter("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select("doc_id")
    trusted = materialize(
        trusted.withColumn("held_out", F.crc32(F.col("doc_id").cast("string").cast("binary")) % HELD_OUT == 0), "trusted"
    )
    slim = parts.select("_slice", "_file", "_row", "doc_id", "lang", "text")
    model = train(only_ids(slim, trusted.filter("not held_out").select("doc_id"), "doc_id"))
    rows = materialize(scored(slim, slice_bits(slim, model)), "scores")
    held_out = only_ids(rows, trusted.filter("held_out").select("doc_id"), "doc_id")
    limits = materialize(
        thresholds(held_out.select("lang", "_bits", "_bytes"), upper, lower, slack, steady), "limits"
    )
    rows = rows.withColumn("_length", _length_class())
    # Limits are one row per language and length class, far below the scores in size.
    for name, keys in (("a", ["lang", "length"]), ("b", ["lang"]), ("c", [])):
        part = limits.filter(" and ".join(f"{k} is {'not ' if k in keys else ''}null" for k in ("lang", "length")))
        part = part.select(*[F.col(k).alias(f"_{name}_{k}") for k in keys], F.struct("low", "high").alias(f"_{name}"))
        on = F.lit(True)
        for k in keys:
            on = on & (F.col(f"_{name}_{k}") == F.col("_length" if k == "length" else k))
        rows = rows.join(F.broadcast(part) if not keys else part, on, "left").drop(*[f"_{name}_{k}" for k in keys])
    limit = F.coalesce("_a", "_b", "_c")
    bits = _per_byte()
    within = (limit.isNull()) | ((bits >= limit["low"]) & (bits <= limit["high"]))
    return (
        rows.withColumn("_perplexity", F.when(F.col("_bytes") > 0, F.pow(F.lit(2.0), bits)))
        .withColumn("_low", F.pow(F.lit(2.0), limit["low"]))
        .withColumn("_high", F.pow(F.lit(2.0), limit["high"]))
        .withColumn("_accepted", (F.col("_bytes") > 0) & within)
        .drop("_a", "_b", "_c", "_length", "_bits", "_bytes")
    )


def accepted(docs: DataFrame, labels: DataFrame, bound: int = BROADCAST_IDS) -> DataFrame:
    """The rows of ``docs`` that are accepted, with their columns; their texts aren't joined by content.

    Rejected rows are named by their place. A counted small list of places is broadcast, a
    longer one joined by a shuffle; both give the same rows.
    """
    void = [f.name for f in docs.schema.fields if isinstance(f.dataType, T.NullType)]
    parts = placed(docs.drop(*void))
    rejected = materialize(verdicts(parts, labels).filter("not _accepted").select("_file", "_row"), "rejected")
    few = rejected.count() <= bound
    kept = parts.join(F.broadcast(rejected) if few else rejected, ["_file", "_row"], "left_anti")
    return kept.withColumns({c: F.lit(None) for c in void}).select(*docs.columns)


def quality_verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, perplexity, low, high, accepted for every row of ``docs``."""
    parts = placed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text"))
    return verdicts(parts, labels).select(
        "doc_id",
        "lang",
        F.round("_perplexity", 6).alias("perplexity"),
        F.col("_low").alias("low"),
        F.col("_high").alias("high"),
        F.col("_accepted").alias("accepted"),
    )
