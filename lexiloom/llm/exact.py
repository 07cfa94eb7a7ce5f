"""Exact dedup by deterministic block naming, with DataFrame functions only.

A normalised text is cut in blocks of a fixed number of characters. The distinct blocks
of the corpus are sorted and numbered: equal blocks get one integer, different blocks
different ones. Then adjacent names are paired and the distinct pairs numbered in the
same way, level by level, until one name is left. Level and name identify the text
without collisions, because every numbering is one-to-one.

Block texts cross the network once, as distinct values of a task. A document then finds
the number of a block by a 128-bit address instead of its text; after numbering, the
addresses are counted, and if two different blocks share one, all of them are drawn anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize
from .common import text_or_empty

BLOCK = 4096
WHITE = "[ \\t\\n\\x0B\\f\\r]+"


def _blocks(text: str, size: int) -> Column:
    return F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def _address(block: Column, draw: int, bits: int) -> Column:
    """Two longs with ``bits`` bits in all."""
    high = F.xxhash64(F.lit(2 * draw), block)
    low = F.xxhash64(F.lit(2 * draw + 1), block)
    if bits < 128:
        high = high.bitwiseAND(F.lit(0).cast("long"))
        low = low.bitwiseAND(F.lit((1 << min(bits, 63)) - 1))
    return F.struct(high.alias("high"), low.alias("low"))


def _numbered(values: DataFrame, order: list[str]) -> DataFrame:
    """Number the (distinct) rows by sorting each partition; numbers differ everywhere."""
    return values.sortWithinPartitions(*order).withColumn("name", F.monotonically_increasing_id())


def _name_blocks(texts: DataFrame, size: int, bits: int) -> tuple[DataFrame, int, int]:
    """Names of the distinct blocks by address, and the draw and width of the addresses."""
    for draw in range(64):
        pieces = texts.select(F.explode(_blocks("norm", size)).alias("block")).distinct()
        names = materialize(
            _numbered(pieces, ["block"]).select(_address(F.col("block"), draw, bits).alias("at"), "name"), "names"
        )
        shared = names.groupBy("at").count().filter("count > 1").limit(1)
        if not shared.count():
            return names, draw, bits
        bits = min(128, 2 * bits)
    raise RuntimeError("no collision-free block addresses found")


def identities(docs: DataFrame, block: int = BLOCK, address_bits: int = 128) -> tuple[DataFrame, DataFrame]:
    """(rows, names): the documents with row number, and (rid, level, name) of each row.

    Two rows have the same level and name exactly when their texts without white space
    are equal. Texts without any other character have level -1.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text")).withColumn(
        "norm", F.regexp_replace("text", WHITE, "")
    )
    names, draw, bits = _name_blocks(texts, block, address_bits)
    rows = materialize(
        texts.select(
            "doc_id",
            F.length("text").alias("n_points"),
            F.sha2("norm", 256).alias("text_sha256"),
            F.transform(_blocks("norm", block), lambda x: _address(x, draw, bits)).alias("blocks"),
            F.monotonically_increasing_id().alias("rid"),
        ),
        "rows",
    )
    cells = rows.select("rid", F.size("blocks").alias("n"), F.posexplode("blocks").alias("place", "at"))
    cells = materialize(cells.join(names, "at").select("rid", "n", "place", "name"), "cells")
    longest = rows.agg(F.max(F.size("blocks"))).first()[0] or 0
    levels = max(0, longest - 1).bit_length()

    done = rows.filter(F.size("blocks") == 0).select(
        "rid", F.lit(-1).alias("level"), F.lit(0).cast("long").alias("name")
    )
    for level in range(levels + 1):
        done = done.union(cells.filter("n = 1").select("rid", F.lit(level), "name"))
        if level == levels:
            break
        even = F.pmod("place", F.lit(2)) == 0
        pairs = cells.filter("n > 1").groupBy("rid", "n", F.shiftright("place", 1).alias("place")).agg(
            F.max(F.when(even, F.col("name"))).alias("left"),
            F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("right"),
        )
        pairs = materialize(pairs, "pairs")
        names = materialize(_numbered(pairs.select("left", "right").distinct(), ["left", "right"]), "names")
        cells = materialize(
            pairs.join(names, ["left", "right"]).select("rid", F.ceil(F.col("n") / 2).cast("int").alias("n"), "place", "name"),
            "cells",
        )
    return rows, done


def exact_duplicates(docs: DataFrame, block: int = BLOCK, address_bits: int = 128) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs``.

    ``docs`` has doc_id and text; further columns are ignored. Texts are equal when they
    are without spaces, tabs, line ends, vertical tabs and form feeds; null counts as
    empty. Of equal texts the row with the most code points stays, then the smallest
    doc_id; of rows that repeat a doc_id, one. The order of the rows is not defined.
    """
    rows, names = identities(docs, block, address_bits)
    known = rows.drop("blocks").join(names, "rid")
    groups = known.groupBy("level", "name").agg(
        F.count("*").alias("group_size"),
        F.max(F.struct("n_points", -F.col("doc_id"), -F.col("rid"))).alias("best"),
    )
    groups = groups.select(
        "level", "name", "group_size", (-F.col("best.col2")).alias("keep_id"), (-F.col("best.col3")).alias("keep_rid")
    )
    return known.join(groups, ["level", "name"]).select(
        "doc_id", "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"), "text_sha256"
    )
