"""Sharding as a minimax contiguous partition of ordered atomic groups.

Equal texts are one atomic group. Groups are ordered by falling size, so the order is a
list of runs of equally large groups, and the search works on the runs: their number is
at most the square root of twice the corpus bytes, whatever the number of groups. The
smallest feasible capacity is found by binary search with a greedy check; the first
shard is cut there, and the rest is solved again for the shards left, so that one huge
group does not leave later shards empty.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import global_rank
from ..runtime import materialize
from .common import text_or_empty

SHARDS = 40
OVERHEAD = 16


class Runs:
    """Runs of equal groups in order: bytes and rows of one group, number of groups."""

    def __init__(self, group_bytes: np.ndarray, group_rows: np.ndarray, groups: np.ndarray):
        self.bytes, self.rows = group_bytes, group_rows
        self.end = np.cumsum(group_bytes * groups)
        self.start = self.end - group_bytes * groups
        self.row_start = np.cumsum(group_rows * groups) - group_rows * groups
        self.total = int(self.end[-1]) if len(self.end) else 0

    def reach(self, at: int, capacity: int) -> int:
        """The farthest group border at most ``capacity`` bytes beyond the border ``at``."""
        goal = at + capacity
        if goal >= self.total:
            return self.total
        r = int(np.searchsorted(self.end, goal, side="right"))
        return int(self.start[r] + (goal - self.start[r]) // self.bytes[r] * self.bytes[r])

    def feasible(self, at: int, capacity: int, shards: int) -> bool:
        for _ in range(shards):
            if at >= self.total:
                break
            at = self.reach(at, capacity)
        return at >= self.total

    def capacity(self, at: int, shards: int) -> int:
        """The smallest capacity with which ``shards`` shards hold all groups from ``at`` on."""
        largest = int(self.bytes[np.searchsorted(self.end, at, side="right")])
        low = max(largest, -(-(self.total - at) // shards))
        high = low + largest
        while low < high:
            middle = (low + high) // 2
            if self.feasible(at, middle, shards):
                high = middle
            else:
                low = middle + 1
        return low

    def cuts(self, shards: int) -> list[int]:
        """The row number at which each shard but the first begins."""
        at, found = 0, []
        for left in range(shards, 1, -1):
            if at < self.total:
                at = self.reach(at, self.capacity(at, left))
            found.append(self.row_at(at))
        return found

    def row_at(self, at: int) -> int:
        if at >= self.total:
            return int(self.row_start[-1] + self.rows[-1] * ((self.end[-1] - self.start[-1]) // self.bytes[-1])) if self.total else 0
        r = int(np.searchsorted(self.end, at, side="right"))
        return int(self.row_start[r] + (at - self.start[r]) // self.bytes[r] * self.rows[r])


def sized_rows(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the 128-bit text key, written once."""
    text = text_or_empty("text")
    return materialize(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text).cast("long") + OVERHEAD).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(F.lit(0), text).alias("high"),
            F.xxhash64(F.lit(1), text).alias("low"),
        ),
        "sized",
    )


def shard_rows(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs``.

    The law is ``bytes``: the largest shard is as small as whole groups of equal texts in
    this order allow, and so on for the shards after it. ``slot`` counts the rows of a
    shard from 0. A null text has no bytes and is in the group of the empty text.
    Repeated rows are rows of one group; with fewer groups than shards the last shards
    stay empty; an empty table gives no rows. Further columns of ``docs`` are ignored.
    """
    rows = sized_rows(docs)
    groups = rows.groupBy("high", "low").agg(F.sum("size").alias("group_bytes"), F.count("*").alias("group_rows"))
    groups = materialize(groups, "groups")
    found = groups.groupBy("group_bytes", "group_rows").agg(F.count("*").alias("groups")).toPandas()
    found = found.sort_values(["group_bytes", "group_rows"], ascending=[False, True])
    runs = Runs(*(found[c].to_numpy(np.int64) for c in ("group_bytes", "group_rows", "groups")))
    cuts = runs.cuts(shards)
    placed = rows.join(groups, ["high", "low"]).withColumn("order", -F.col("group_bytes"))
    ranked = global_rank(placed, ["order", "group_rows", "high", "low", "doc_id"], "rank")
    starts = F.array(*[F.lit(x).cast("long") for x in [0, *cuts]])
    shard = F.size(F.filter(starts, lambda start: start <= F.col("rank"))) - 1
    return ranked.withColumn("shard", shard).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("rank") - F.element_at(starts, F.col("shard") + 1)).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
