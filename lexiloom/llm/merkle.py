"""A Merkle manifest of a table: one digest per row, one root per language, one root of all.

Rows of a language ascend by doc_id; every FANOUT consecutive nodes make a parent until one
node, the subroot, is left. Subroots, ordered by language, make the root in the same way.

Nodes are gathered in aligned blocks of FANOUT ** LEVELS. A block keeps each of its levels
as one string of fixed-width hex digests: a parent is the hash of a fixed-width substring,
and the siblings of a node are the substrings to its left and right within its run. The
roots of the blocks are the nodes of the next tier, so the number of tiers grows with the
logarithm of the rows; no task holds more than a block. Paths to the root come down tier by
tier: one row per block is joined to the path of its root, and only then opened.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import lookup_join
from ..operators.ranking import global_rank
from ..runtime import materialize

FANOUT = 8
LEVELS = 3
WIDTH = 64  # hex digits of a digest
PATH = "array<struct<left:string,right:string>>"


def field(value: Column) -> Column:
    """A value with its length in front, so that fields can't run into each other; null is a dash."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: Column) -> Column:
    """Digest of a row of documents with the given text."""
    return F.sha2(F.concat(*[field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], field(text)), 256)


def folded(start: Column, path: Column | str) -> Column:
    """The root that follows from a leaf and the siblings on its path."""
    return F.aggregate(path, start, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def proof_digest(path: Column | str) -> Column:
    """Digest of all siblings, level by level and left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def _parents(level: Column, fanout: int) -> Column:
    """The next level of a block: the hash of each run's digests, again as one string."""
    run = fanout * WIDTH
    runs = F.sequence(F.lit(0), F.floor((F.length(level) - 1) / run).cast("int"))
    return F.array_join(F.transform(runs, lambda r: F.sha2(F.substring(level, r * run + 1, F.lit(run)), 256)), "")


def _blocks(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """(key, block, n, notes, level strings, root) of nodes (key, n, rank, digest, note).

    ``n`` is the number of nodes of the key in this tier; with one, nothing is hashed.
    """
    size = fanout**levels
    member = F.sort_array(F.collect_list(F.struct("rank", "digest", "note")))  # a block at most
    rows = nodes.groupBy("key", F.floor(F.col("rank") / size).alias("block")).agg(
        F.first("n").alias("n"), member.alias("m")
    )
    depth = F.lit(levels)
    for up in range(levels - 1, -1, -1):
        depth = F.when(F.col("n") <= fanout**up, F.lit(up)).otherwise(depth)
    rows = rows.select(
        "key",
        "block",
        "n",
        depth.alias("depth"),
        F.col("m.note").alias("notes"),
        F.array_join(F.transform("m", lambda x: F.lower(F.hex(x["digest"]))), "").alias("s0"),
    )
    root = F.col("s0")
    for up in range(1, levels + 1):
        rows = rows.withColumn(f"s{up}", F.when(F.col("depth") >= up, _parents(F.col(f"s{up - 1}"), fanout)))
        root = F.coalesce(F.col(f"s{up}"), root)
    return rows.withColumn("root", root)


def build(nodes: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> list[DataFrame]:
    """The tiers of blocks over nodes (key, n, rank, digest, note), from the leaves up.

    The last tier has one block per key; its ``root`` is the key's root. Every tier is written.
    """
    size, tiers = fanout**levels, []
    left = nodes.agg(F.max("n")).first()[0] or 0
    while True:
        blocks = materialize(_blocks(nodes, fanout, levels), f"tier{len(tiers)}")
        tiers.append(blocks)
        if left <= size:
            return tiers
        left = math.ceil(left / size)
        nodes = blocks.select(
            "key",
            F.ceil(F.col("n") / size).alias("n"),
            F.col("block").alias("rank"),
            F.unhex("root").alias("digest"),
            F.lit(None).cast("int").alias("note"),
        )


def _segment(level: int, place: Column, fanout: int) -> Column:
    """Left and right siblings of node ``place`` of a level of its block."""
    at, string = F.pmod(place, F.lit(fanout)), F.col(f"s{level}")
    return F.struct(
        F.substring(string, (place - at) * WIDTH + 1, at * WIDTH).alias("left"),
        F.substring(string, (place + 1) * WIDTH + 1, (fanout - 1 - at) * WIDTH).alias("right"),
    )


def descend(tiers: list[DataFrame], paths: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """(key, rank, digest, note, path) of every leaf, from the path of each key's root.

    A block is first opened to its runs, which share all but the lowest siblings, and a
    run to its nodes.
    """
    paths = paths.select("key", F.lit(0).cast("long").alias("block"), "path")
    for number, blocks in reversed(list(enumerate(tiers))):
        known = blocks.join(paths, ["key", "block"])
        width = fanout * WIDTH
        runs = F.sequence(F.lit(0), F.floor((F.length("s0") - 1) / width).cast("int"))

        def opened(r: Column) -> Column:
            higher, place = [], r
            for up in range(1, levels):
                higher.append(_segment(up, place, fanout))
                place = F.floor(place / fanout).cast("int")
            above = F.slice(F.array(*higher), F.lit(1), F.greatest(F.col("depth") - 1, F.lit(0)))
            return F.struct(
                r.alias("r"),
                F.substring("s0", r * width + 1, F.lit(width)).alias("s0"),
                F.slice("notes", r * fanout + 1, F.lit(fanout)).alias("notes"),
                above.alias("above"),
            )

        run = known.select("key", "block", "depth", "path", F.explode(F.transform(runs, opened)).alias("run"))
        run = run.select(
            "key", "block", F.col("run.r").alias("r"), F.col("run.s0").alias("s0"), F.col("run.notes").alias("notes"),
            "depth", F.concat("run.above", "path").alias("above"),
        )
        node = run.select("key", "block", "r", "s0", "depth", "above", F.posexplode("notes").alias("i", "note"))
        own = F.when(F.col("depth") > 0, F.array(_segment(0, F.col("i"), fanout))).otherwise(F.array().cast(PATH))
        paths = node.select(
            "key",
            (F.col("block") * fanout**levels + F.col("r") * fanout + F.col("i")).alias("rank"),
            F.substring("s0", F.col("i") * WIDTH + 1, F.lit(WIDTH)).alias("digest"),
            "note",
            F.concat(own, "above").alias("path"),
        )
        if number:
            paths = paths.select("key", F.col("rank").alias("block"), "path")
    return paths


def tampered_text(every: int) -> Column:
    """The text with A-Z lowered where the crc of doc_id divides; null elsewhere."""
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.crc32(F.col("doc_id").cast("string")) % every == 0, lowered)


def manifest(docs: DataFrame, note: Column | None = None, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """(doc_id, lang, leaf, subroot, root, path, note) of every row of ``docs``.

    ``docs`` has doc_id, source, lang, n_chars and text, each of which may be null;
    further columns are ignored. ``path`` holds the siblings from the leaf to the root.
    ``note`` is a column over ``docs`` to carry along. Null languages come first, then
    by bytes of UTF-8; rows of a language ascend by doc_id, null first, rows that share
    it by leaf, and fully equal rows stand next to each other. A table of one row is its
    own root with an empty path; an empty table gives no rows.

    Texts are read once and stay where they are: only digests move.
    """
    note = F.lit(None).cast("int") if note is None else note
    key = F.coalesce(F.concat(F.lit("+"), F.col("lang").cast("string")), F.lit("")).alias("key")
    leaves = docs.select(
        key, F.col("doc_id").cast("long").alias("doc_id"), F.unhex(leaf(F.col("text"))).alias("digest"), note.alias("_note")
    )
    leaves = materialize(leaves, "leaves")  # a range sort would hash the texts twice, as it samples first
    ranked = global_rank(leaves, ["key", "doc_id", "digest"], "_at")
    groups = materialize(ranked.groupBy("key").agg(F.min("_at").alias("first"), F.count("*").alias("n")), "groups")
    placed = lookup_join(ranked, groups, "key", ["first", "n"], hot_by="n")
    nodes = placed.select(
        "key", "n", (F.col("_at") - F.col("first")).alias("rank"), "digest", F.struct("doc_id", "_note").alias("note")
    )
    tiers = build(nodes, fanout, levels)
    tops = tiers[-1].select("key", "root")

    # The subroots are the leaves of one more tree.
    order = materialize(global_rank(tops, ["key"], "rank", "n"), "subroots")
    above = build(
        order.select(
            F.lit(0).alias("key"), "n", "rank", F.unhex("root").alias("digest"), F.col("key").alias("note")
        ),
        fanout,
        levels,
    )
    start = above[-1].select("key", F.array().cast(PATH).alias("path"))
    known = descend(above, start, fanout, levels).crossJoin(
        F.broadcast(above[-1].select(F.col("root").alias("whole")))  # one row
    )
    known = materialize(
        known.select(F.col("note").alias("key"), F.col("digest").alias("subroot"), F.col("whole").alias("root"), "path"),
        "roots",
    )
    rows = lookup_join(descend(tiers, known.select("key", "path"), fanout, levels), known, "key", ["subroot", "root"])
    return rows.select(
        F.col("note.doc_id").alias("doc_id"),
        F.when(F.col("key") != "", F.expr("substring(key, 2)")).alias("lang"),
        F.col("digest").alias("leaf"),
        "subroot",
        "root",
        "path",
        F.col("note._note").alias("note"),
    )


def verified_manifest(docs: DataFrame, every: int = 3, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """The manifest with each row's proof checked after tampering with some rows.

    doc_id, leaf, subroot, root, proof_sha256, folded_root, verified. Where ``every``
    divides the crc of doc_id, the leaf is made of the text in lower case and folded with
    the siblings of the manifest; a text without A-Z, a null text or a null doc_id is
    not changed by that and verifies.
    """
    changed = tampered_text(every)
    note = F.when(changed.isNotNull(), F.unhex(leaf(changed)))
    rows = manifest(docs, note, fanout, levels)
    start = F.coalesce(F.lower(F.hex("note")), F.col("leaf"))
    rows = rows.withColumn("folded_root", folded(start, "path"))
    return rows.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        proof_digest("path").alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
