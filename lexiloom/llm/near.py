"""MinHash near-dedup: bottom-k sketches from one hash function.

1. ``sketches``: a text's distinct word shingles are hashed once; the k smallest hashes
   are its sketch, a digest of all of them is its class. Texts with equal shingle sets
   are one class and are represented by one row from here on.
2. ``inverted lists``: a retained value leads to the rows that hold it. A row is looked
   for only under its rarest values: two rows at the threshold share at least c of their
   retained values, so one of the (held - c + 1) rarest of either is shared. Passages in
   many texts are under their other, rarer values.
3. A list proposes its smallest row to all others (one pair per row, not all pairs).
4. The union of two sketches estimates the similarity; clear failures go.
5. Full shingle sets confirm: the best proposal of each row first, then the proposals
   between different components.
6. Lists whose rows still lie in different components are compared in full, in tiles of
   bounded size, and only between components. First, lists with nearly the same rows become
   one, and in lists of more rows than a tile the rows are looked for under the rarest of
   their 1,024 smallest hashes, so that a passage in most of a row makes no long list.
   A pair counts in the first list that holds both rows.
   A tile holds the 1,024 smallest hashes of each row: sets up to that size are
   complete, so the tile itself confirms their links, and gives out no more of them than
   join its components (fewer than its rows). Pairs with a larger set are estimated from
   these hashes, and confirmed as before where the estimate can't rule them out.

The estimate and c leave six standard deviations below the threshold (exact where a set
is no larger than its sketch).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize
from .common import only_ids, text_or_empty
from .components import components
from .words import SPACE_BYTES, U64, run_hashes, word_hashes

SHINGLE = 5
KEEP = 64
SIGMAS = 6.0
WIDE = 1024
TILE = 1024
HUB_ROWS = 128
MERGES = 2
CHUNK = 4096


def shingle_set(words: np.ndarray, shingle: int) -> np.ndarray:
    """Sorted distinct shingle hashes of one text; a short text is one shingle."""
    if len(words) == 0:
        return np.empty(0, np.int64)
    return np.unique(run_hashes(words, min(shingle, len(words))).view(np.int64))


def _sets(texts: pa.Array, shingle: int) -> Iterator[tuple[int, np.ndarray]]:
    for first, words, counts in word_hashes(texts, SPACE_BYTES):
        ends = np.cumsum(counts)
        for i, (end, n) in enumerate(zip(ends, counts)):
            yield first + i, shingle_set(words[end - n : end], shingle)


def _sketch_batches(shingle: int, keep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, digest, sketch = [], [], []
            for _, found in _sets(batch.column("text"), shingle):
                size.append(len(found))
                digest.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                sketch.append(found[:keep])
            lengths = np.cumsum([0, *map(len, sketch)])
            values = np.concatenate(sketch) if sketch else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(size, pa.int64()),
                    pa.array(digest, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(values, pa.int64())),
                ],
                names=["doc_id", "n_shingles", "digest", "sketch"],
            )

    return run


def sketches(docs: DataFrame, shingle: int = SHINGLE, keep: int = KEEP) -> DataFrame:
    """doc_id, n_shingles, digest of the full set, sketch; one row per row, written once."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text"))
    made = slim.mapInArrow(
        _sketch_batches(shingle, keep), "doc_id long, n_shingles long, digest binary, sketch array<long>"
    )
    return materialize(made.withColumn("rid", F.monotonically_increasing_id()), "sketches")


def least_shared(held, size, percent: int, keep: int, functions=F):
    """Values that a sketch of ``held`` values shares at least with one at the threshold.

    With both sets no larger than a sketch this is exact; else six standard deviations
    below the mean of the shared part of ``keep`` sampled values, if that is less.
    """
    t = percent / 100
    sampled = max(1, math.floor(keep * t - SIGMAS * math.sqrt(keep * t * (1 - t))))
    whole = functions.ceil(size * percent / 100)
    if functions is F:
        return F.when(size * 100 <= keep * percent, whole).otherwise(F.least(whole, F.lit(sampled)))
    return np.where(size * 100 <= keep * percent, whole, np.minimum(whole, sampled))


def _estimate(pairs: DataFrame, nodes: DataFrame, percent: int, keep: int) -> DataFrame:
    """Pairs (a, b) whose sizes and sketches allow the threshold, with the estimate."""
    for side in "ab":
        pairs = pairs.join(
            nodes.select(
                F.col("rid").alias(side), F.col("n_shingles").alias(f"n{side}"), F.col("sketch").alias(f"s{side}")
            ),
            side,
        )
    near = pairs.filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, keep)
    near = near.select("a", "b", union.alias("union"), F.array_intersect("sa", "sb").alias("both"))
    t = percent / 100
    seen = F.size("union")
    return near.select(
        "a", "b", (F.size(F.array_intersect("union", "both")) / seen).alias("estimate"), seen.alias("seen")
    ).filter(F.col("estimate") >= t - SIGMAS * F.sqrt(t * (1 - t) / F.col("seen"))).drop("seen")


def _confirm_batches(shingle: int, percent: int):
    """Rows of a hub in order, the hub's own text first; yields the pairs that are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, hub_set = None, None
        for batch in batches:
            b, a = batch.column("b").to_pylist(), batch.column("a").to_pylist()
            digest = batch.column("digest").to_pylist()
            out: list[tuple] = []
            for i, found in _sets(batch.column("text"), shingle):
                if hashlib.blake2b(found.tobytes(), digest_size=16).digest() != digest[i]:
                    continue  # another row under the same doc_id
                if a[i] is None:
                    hub, hub_set = b[i], found
                elif hub == b[i]:
                    shared = len(np.intersect1d(found, hub_set, assume_unique=True))
                    union = len(found) + len(hub_set) - shared
                    if shared and 100 * shared >= percent * union:
                        out.append((a[i], b[i]))
            columns = list(zip(*out)) if out else [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["u", "v"])

    return run


def _confirm(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Of the pairs (a, b) those that the full shingle sets link, as (u, v).

    Texts go to their pair's hub b. A hub with many rows is dealt to several tasks, each
    with a copy of the hub's text for HUB_ROWS rows.
    """
    hubs = pairs.groupBy("b").agg(F.ceil(F.count("*") / HUB_ROWS).cast("int").alias("parts"))
    names = nodes.select("rid", "doc_id", "digest")
    members = (
        pairs.join(hubs, "b")
        .withColumn("part", F.pmod(F.xxhash64("a"), "parts").cast("int"))
        .join(names.withColumnRenamed("rid", "a"), "a")
        .select("a", "b", "part", "doc_id", "digest")
    )
    own = (
        hubs.join(names.withColumnRenamed("rid", "b"), "b")
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(F.lit(None).cast("long").alias("a"), "b", "part", "doc_id", "digest")
    )
    asked = materialize(members.unionByName(own), "asked")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text"))
    texts = only_ids(slim, asked.select("doc_id").distinct(), "doc_id")
    rows = asked.join(texts, "doc_id").select("a", "b", "part", "digest", "text")
    # Each (hub, part) is a bounded group, whole in one task and in order.
    dealt = rows.repartition("b", "part").sortWithinPartitions("b", "part", F.col("a").asc_nulls_first())
    return dealt.mapInArrow(_confirm_batches(shingle, percent), "u long, v long")


def _tile_links(percent: int, keep: int, wide: int):
    """Links across components in each tile, and the pairs that the tile can't decide."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: pa.Table | None = None
        for batch in frames:
            rows = pa.Table.from_batches([batch])
            rows = rows if left is None else pa.concat_tables([left, rows])
            marks = np.stack([rows[c].to_numpy() for c in ("key", "i", "j")])
            cuts = np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1
            borders = [0, *cuts.tolist()]
            yield from (_one_tile(rows.slice(x, y - x), percent, keep, wide) for x, y in zip(borders, borders[1:]))
            left = rows.slice(borders[-1])
        if left is not None and left.num_rows:
            yield _one_tile(left, percent, keep, wide)

    return run


def _overlaps(values: np.ndarray, owner: np.ndarray, q: np.ndarray, r: np.ndarray, rows: int) -> np.ndarray:
    """Number of values that each row of q shares with each row of r, some columns at a time."""
    _, column, holders = np.unique(values, return_inverse=True, return_counts=True)
    shared = holders > 1  # only these columns can add to an overlap
    place = (np.cumsum(shared) - 1)[column]
    order = np.flatnonzero(shared[column])
    order = order[np.argsort(place[order], kind="stable")]
    place, owner = place[order], owner[order]
    total = np.zeros((len(q), len(r)), np.float32)
    for low in range(0, int(shared.sum()), CHUNK):
        x, y = np.searchsorted(place, [low, low + CHUNK])
        holds = np.zeros((rows, int(place[y - 1]) - low + 1), np.float32)
        holds[owner[x:y], place[x:y] - low] = 1
        total += holds[q] @ holds[r].T
    return total


def _one_tile(rows: pa.Table, percent: int, keep: int, wide: int) -> pa.RecordBatch:
    """Each asking row against the other rows of the tile: a, b, sure.

    Sets no larger than ``wide`` are here in full, so their links are certain; of these only
    a spanning forest over the components is given out. Pairs with a larger set that the
    sketches allow are given out unsure, where no certain link joins their components.
    """
    rid, root, n = (rows[c].to_numpy() for c in ("rid", "root", "n_shingles"))
    asks, asker = (rows[c].to_numpy() for c in ("asks", "asker"))
    q, r = np.flatnonzero(asks), np.flatnonzero(~asks)
    lists = rows["sketch"].combine_chunks()
    starts = lists.offsets.to_numpy()
    starts, held, values = starts - starts[0], np.diff(starts), lists.flatten().to_numpy()
    owner = np.repeat(np.arange(len(rid)), held)
    narrow = np.arange(len(values)) - starts[owner] < keep
    needed = least_shared(np.minimum(held, keep), n, percent, keep, np)
    good = _overlaps(values[narrow], owner[narrow], q, r, len(rid)) >= np.minimum(needed[q][:, None], needed[r])
    good &= 100 * np.minimum(n[q][:, None], n[r]) >= percent * np.maximum(n[q][:, None], n[r])
    good &= ~asker[r] | (rid[q][:, None] > rid[r])  # two asking rows meet twice
    names, column = np.unique(values, return_inverse=True)
    earlier = _earlier_lists(rows["keys"].combine_chunks(), rows["key"][0].as_py())
    top = np.where(n > wide, values[starts[1:] - 1], np.iinfo(np.int64).max)
    group = np.unique(root, return_inverse=True)[1]
    own, listed = np.zeros(len(names), bool), np.zeros(int(earlier.max(initial=0)) + 1, bool)
    t, out = percent / 100, []
    for x, y in zip(q, good):
        near = r[y]
        near = near[group[near] != group[x]]
        listed[earlier[x]], listed[0] = True, False
        near = near[~listed[earlier[near]].any(axis=1)]  # a pair counts in its first common list
        listed[earlier[x]] = False
        if not len(near):
            continue
        length, mine = held[near], slice(starts[x], starts[x + 1])
        ends = np.cumsum(length)
        at = np.arange(ends[-1]) + np.repeat(starts[near] - (ends - length), length)
        own[column[mine]] = True
        both = np.add.reduceat(own[column[at]], ends - length, dtype=np.int64)
        own[column[mine]] = False
        limit = np.minimum(top[x], top[near])  # both sets are known in full up to here
        theirs = np.add.reduceat(values[at] <= np.repeat(limit, length), ends - length, dtype=np.int64)
        union = np.searchsorted(values[mine], limit, side="right") + theirs - both
        whole = (n[x] <= wide) & (n[near] <= wide)
        for other in near[whole & (both > 0) & (100 * both >= percent * union)]:
            if group[other] != group[x]:
                group[group == group[other]] = group[x]
                out.append((max(rid[x], rid[other]), min(rid[x], rid[other]), True))
        open_ = ~whole & (both >= union * (t - SIGMAS * np.sqrt(t * (1 - t) / union))) & (group[near] != group[x])
        out += [(max(rid[x], rid[other]), min(rid[x], rid[other]), False) for other in near[open_]]
    columns = list(zip(*out)) if out else [[]] * 3
    kinds = [pa.int64(), pa.int64(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["a", "b", "sure"])


def _earlier_lists(keys: pa.ListArray, key: int) -> np.ndarray:
    """Of each row the numbers, from 1 on, of its lists before ``key``; the blank is 0."""
    offsets = keys.offsets.to_numpy()
    values, held = keys.flatten().to_numpy(), np.diff(offsets)
    owner = np.repeat(np.arange(len(held)), held)
    place = np.arange(len(values)) - np.repeat(offsets[:-1] - offsets[0], held)
    before = values < key
    numbers = np.zeros((len(held), max(1, held.max(initial=0))), np.int64)
    numbers[owner[before], place[before]] = np.unique(values[before], return_inverse=True)[1] + 1
    return numbers


def _wide_sets(rids: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int, wide: int) -> DataFrame:
    """rid, n_shingles and the ``wide`` smallest hashes of the asked rows, from their texts."""
    asked = materialize(nodes.select("rid", "doc_id", "digest").join(rids, "rid", "left_semi"), "asked")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text"))
    texts = only_ids(slim, asked.select("doc_id").distinct(), "doc_id")
    made = texts.mapInArrow(
        _sketch_batches(shingle, wide), "doc_id long, n_shingles long, digest binary, sketch array<long>"
    )
    return made.join(asked, ["doc_id", "digest"]).select("rid", "n_shingles", "sketch").dropDuplicates(["rid"])


def _rare_lists(values: DataFrame, sizes: DataFrame, by: list[str], percent: int, keep: int) -> DataFrame:
    """Lists (key) of the rows ``by``, each under its rarest of ``keep`` values, of those that others hold too.

    Two rows at the threshold share one of these, also one that ``seeks`` marks on one of
    them: a row in full need seek only those of its size or more, which share still more.
    """
    lists = values.groupBy("value").agg(F.count("*").alias("held_by"), F.min("rid").alias("first"))
    shared = values.join(lists.filter("held_by > 1"), "value")
    per_row = shared.groupBy(*by).agg(
        F.sort_array(F.collect_list(F.struct("held_by", "value", "first"))).alias("shared")
    )
    sized = per_row.join(sizes.select("rid", "n_shingles"), "rid")
    held = F.least(F.col("n_shingles"), F.lit(keep))
    places = held - least_shared(held, F.col("n_shingles"), percent, keep) + 1
    more = held - F.ceil(F.col("n_shingles") * 2 * percent / (100 + percent)) + 1
    seeking = F.when(F.col("n_shingles") * 100 <= keep * percent, more).otherwise(places)
    unshared = held - F.size("shared")  # the rarest
    rarest = (places - unshared).cast("int")
    cut = sized.filter(rarest > 0).withColumn("seeking", seeking - unshared)
    listed = cut.select(*by, "seeking", F.posexplode(F.slice("shared", 1, rarest)).alias("pos", "at"))
    return listed.select(
        *by,
        F.col("at.value").alias("key"),
        F.col("at.held_by").alias("held_by"),
        F.col("at.first").alias("first"),
        (F.col("pos") < F.col("seeking")).alias("seeks"),
    )


def _spanning(lists: DataFrame) -> DataFrame:
    """The rows (key, rid, root, seeks) of those lists whose rows lie in several components, if one seeks."""
    ends = lists.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.bool_or("seeks").alias("any"))
    return lists.join(ends.filter("low < high and any").select("key"), "key", "left_semi")


def _merged(lists: DataFrame, seed: int) -> DataFrame:
    """Lists (key, rid, root, seeks) with the same least row become one, where that makes no more pairs.

    The least of hashed rows is the same with the chance of their overlap.
    """
    size, seekers = F.count("*").cast("double").alias("rows"), F.count_if("seeks").alias("seekers")
    each = lists.groupBy("key").agg(F.min(F.xxhash64(F.lit(seed), "rid")).alias("lead"), size, seekers)
    apart = each.groupBy("lead").agg(F.sum(F.col("rows") * F.col("seekers")).alias("apart"), F.count("*").alias("n"))
    named = lists.join(each.select("key", "lead"), "key")
    union = named.groupBy("lead", "rid").agg(F.bool_or("seeks").alias("seeks")).groupBy("lead").agg(size, seekers)
    less = union.join(apart.filter("n > 1"), "lead").filter("rows * seekers <= apart").select("lead", F.lit(True).alias("less"))
    names = each.join(less, "lead", "left").select("key", F.when(F.col("less"), F.col("lead")).otherwise(F.col("key")).alias("name"))
    joint = lists.join(names, "key").groupBy("name", "rid", "root").agg(F.bool_or("seeks").alias("seeks"))
    return joint.withColumnRenamed("name", "key")


def _merged_lists(lists: DataFrame) -> DataFrame:
    """The lists that span components, with those of nearly the same rows as one."""
    lists = materialize(_spanning(lists), "spanning")
    for seed in range(MERGES):
        lists = materialize(_merged(lists, seed), "merged")
    return lists


def _finer(lists: DataFrame, sets: DataFrame, percent: int, wide: int) -> DataFrame:
    """Rows (key, rid, root, seeks) of lists within the given ones, under the rarest of ``wide`` values."""
    named = lists.withColumnRenamed("key", "long").join(sets.select("rid", "sketch"), "rid")
    values = named.select("long", "rid", "root", F.explode("sketch").alias("value"))
    values = values.withColumn("value", F.xxhash64("long", "value"))
    return _rare_lists(values, sets, ["long", "rid", "root"], percent, wide).select("key", "rid", "root", "seeks")


def _open_links(
    lists: DataFrame,
    roots: DataFrame,
    nodes: DataFrame,
    docs: DataFrame,
    shingle: int,
    percent: int,
    keep: int,
    wide: int,
    tile: int,
) -> DataFrame:
    """a, b, sure across components out of the lists that still span several.

    Lists with nearly the same rows are compared as one. Lists of more than ``tile`` rows
    give way to lists of larger sketches, which rows that only share a passage are not in.
    Of a list only the rows outside its largest component ask, against all its rows, or
    those that seek, if they are fewer.
    Both are cut in parts of about ``tile`` rows and every part of askers meets every
    part of the list, so a task holds two parts however long the list is.
    """
    placed = lists.join(roots.withColumnRenamed("node", "rid"), "rid", "left").withColumn(
        "root", F.coalesce("root", "rid")
    )
    placed = _merged_lists(placed.select("key", "rid", "root", "seeks"))
    sets = materialize(_wide_sets(placed.select("rid").distinct(), nodes, docs, shingle, wide), "sets")
    long = placed.groupBy("key").count().filter(F.col("count") > tile).select("key")
    long = materialize(placed.join(long, "key", "left_semi"), "long")
    if not long.isEmpty():
        finer = _merged_lists(_finer(long, sets, percent, wide))
        placed = placed.join(long.select("key").distinct(), "key", "left_anti").union(finer)
    sizes = placed.groupBy("key", "root").agg(F.count("*").alias("rows"), F.count_if("seeks").alias("seekers"))
    split = sizes.groupBy("key").agg(
        F.max_by("root", F.struct("rows", "root")).alias("main"),
        F.sum("rows").alias("rows"),
        (F.sum("rows") - F.max("rows")).alias("outside"),
        F.sum("seekers").alias("seekers"),
    )
    parts = split.select(
        "key",
        F.when(F.col("outside") <= F.col("seekers"), F.col("main")).alias("main"),
        F.ceil(F.col("rows") / tile).cast("int").alias("r_parts"),
        F.ceil(F.least("outside", "seekers") / tile).cast("int").alias("q_parts"),
    )
    rows = placed.join(parts, "key").withColumn("asker", F.coalesce(F.col("root") != F.col("main"), F.col("seeks")))
    rows = materialize(rows.drop("main", "seeks"), "open")
    keys = rows.groupBy("rid").agg(F.collect_list("key").alias("keys"))  # at most a sketch of each size
    sets = materialize(sets.join(keys, "rid"), "sets")
    mark = F.xxhash64("rid")

    def copies(part: str, others: str, own: str, asks: bool, df: DataFrame) -> DataFrame:
        meets = F.explode(F.sequence(F.lit(0), F.col(others) - 1)).alias("other")
        dealt = df.select("key", "rid", "root", "asker", F.pmod(mark, F.col(part)).cast("int").alias("own"), meets)
        i, j = ("own", "other") if own == "i" else ("other", "own")
        return dealt.select("key", F.col(i).alias("i"), F.col(j).alias("j"), F.lit(asks).alias("asks"), "rid", "root", "asker")

    full = copies("r_parts", "q_parts", "i", False, rows).union(copies("q_parts", "r_parts", "j", True, rows.filter("asker")))
    full = full.join(sets, "rid")  # the sets cross one exchange, to their tiles
    dealt = full.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(_tile_links(percent, keep, wide), "a long, b long, sure boolean").distinct()


def near_duplicates(
    docs: DataFrame,
    percent: int = 80,
    shingle: int = SHINGLE,
    keep: int = KEEP,
    tile: int = TILE,
    wide: int = WIDE,
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text).

    Words are runs of other characters than ASCII white space, A-Z lower-cased. Rows are
    linked where 100 * |intersection| >= percent * |union| of their shingle sets;
    ``component_id`` is the smallest doc_id of the rows reachable over links, and a row
    is kept if it is that doc_id. Null and empty texts have no shingles and no links.
    A repeated doc_id stays two rows; further columns of ``docs`` are ignored. A row without
    doc_id is linked like the rows of its text, and kept only where no row with doc_id is
    reachable; a text that no row with doc_id has is linked with equal texts only.
    """
    table = sketches(docs, shingle, keep)
    filled = table.filter("n_shingles > 0")
    # A class is represented by a row with doc_id where it has one, as texts are fetched by it.
    first = F.min(F.struct(F.col("doc_id").isNull(), "rid"))["rid"]
    classes = materialize(filled.groupBy("digest").agg(first.alias("rid"), F.min("doc_id").alias("least")), "classes")
    nodes = materialize(table.join(classes.select("rid"), "rid", "left_semi"), "nodes")

    values = nodes.select("rid", F.explode("sketch").alias("value"))
    indexed = materialize(_rare_lists(values, nodes, ["rid"], percent, keep), "lists")

    proposed = indexed.filter("first <> rid").select(F.col("rid").alias("a"), F.col("first").alias("b")).distinct()
    proposed = materialize(_estimate(proposed, nodes, percent, keep), "proposed")
    best = materialize(proposed.groupBy("a").agg(F.max_by("b", F.struct("estimate", -F.col("b"))).alias("b")), "best")
    links = materialize(_confirm(best, nodes, docs, shingle, percent), "links")
    roots = materialize(components(links), "roots")

    def across(pairs: DataFrame) -> DataFrame:
        for side in "ab":
            found = roots.select(F.col("node").alias(side), F.col("root").alias(f"r{side}"))
            pairs = pairs.join(found, side, "left").withColumn(f"r{side}", F.coalesce(f"r{side}", side))
        return pairs.filter("ra <> rb").select("a", "b")

    def joined(pairs: DataFrame, sure: DataFrame | None = None) -> DataFrame:
        """The roots after the ``sure`` links, and those pairs (a, b) that hold, are links too."""
        pairs = materialize(pairs, "pairs")
        edges = None if pairs.isEmpty() else materialize(_confirm(pairs, nodes, docs, shingle, percent), "links")
        if sure is not None:
            edges = sure if edges is None else edges.union(sure)
        if edges is None or edges.isEmpty():
            return roots
        stars = roots.select(F.col("node").alias("u"), F.col("root").alias("v"))
        return materialize(components(stars.union(edges)), "roots")

    roots = joined(across(proposed.select("a", "b").join(best, ["a", "b"], "left_anti")))
    # A list of two rows was answered in full by its proposal.
    long_lists = indexed.filter("held_by > 2").select("rid", "key", "seeks")
    found = materialize(
        _open_links(long_lists, roots, nodes, docs, shingle, percent, keep, max(keep, wide), tile), "found"
    )
    final = joined(found.filter("not sure").select("a", "b"), found.filter("sure").select("a", "b"))

    named = classes.join(final.withColumnRenamed("node", "rid"), "rid", "left").withColumn(
        "root", F.coalesce("root", "rid")
    )
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(least, "root").select("digest", "component_id")
    return (
        filled.select("doc_id", "n_shingles", "digest")
        .join(named, "digest")
        .select("doc_id", "n_shingles", "component_id")
        .union(table.filter("n_shingles = 0").select("doc_id", "n_shingles", "doc_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))
    )
