"""Minimax contiguous partition of documents into shards, by DataFrame functions alone.

Rows of equal text form one atomic group. Groups are ordered by the text's digest, and shards are
contiguous in that order. The smallest capacity that `shards` runs of whole groups can keep to is
found by binary search; a capacity is checked greedily: each shard takes groups while they fit.

The order is described by *cells*: digest prefixes with the bytes and groups below them. The
driver holds a bounded number of cells. Whatever capacity is tried, its i-th cut lies between
two bounds; only cells there are split by further digits, until each holds a single group. So
the search is exact, and each round is one aggregation over the groups.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

#: Cells that the driver holds at most; rows are numbered in so many parts of each shard.
MAX_CELLS, PARTS = 65_536, 1024


def greedy(ends: np.ndarray, capacity: int, shards: int, at: int = 0) -> list[int]:
    """The last cell (one past it) of each shard if every shard takes cells from `at` on while they fit."""
    cuts = []
    for _ in range(shards):
        start = ends[at - 1] if at else 0
        at = int(np.searchsorted(ends, start + capacity, side="right"))
        cuts.append(at)
    return cuts


def smallest_capacity(ends: np.ndarray, low: int, shards: int) -> int:
    """The smallest capacity from low on that lets `shards` shards take all cells."""
    high = int(ends[-1])
    while low < high:
        middle = (low + high) // 2
        if greedy(ends, middle, shards)[-1] == len(ends):
            high = middle
        else:
            low = middle + 1
    return low


def level_cuts(ends: np.ndarray, capacity: int, shards: int) -> list[int]:
    """Cuts under the capacity; where a large group leaves room, shards stop near an equal share of what is left."""
    cuts, at, n = [], 0, len(ends)
    for left in range(shards, 0, -1):
        start = int(ends[at - 1]) if at else 0
        most = greedy(ends, capacity, 1, at)[0]
        share = min(most, int(np.searchsorted(ends, start + -(-(int(ends[-1]) - start) // left), side="left")) + 1)
        at = share if left > 1 and (share == n or greedy(ends, capacity, left - 1, share)[-1] == n) else most
        cuts.append(at)
    return cuts


def open_cells(ends: np.ndarray, groups: np.ndarray, low: int, high: int, shards: int) -> np.ndarray:
    """Cells of several groups in which a cut may lie for some capacity in [low, high]."""
    starts = np.concatenate(([0], ends[:-1]))
    behind, found = greedy(ends, low, shards), np.zeros(len(ends), bool)
    for i in range(shards):
        least = ends[behind[i] - 1] if behind[i] else 0
        found |= (starts <= (i + 1) * high) & (ends > least)
    return found & (groups > 1)


def find_cuts(groups: DataFrame, shards: int) -> list[str]:
    """The last cell, a digest prefix, of each shard but the last; groups has (digest, bytes)."""
    cells: dict[str, tuple[int, int, int]] = {}
    split, digits = [""], 3
    while split:
        below = groups if split == [""] else groups.where(F.substring("digest", 1, len(split[0])).isin(split))
        rows = below.groupBy(F.substring("digest", 1, len(split[0]) + digits).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("groups"), F.max("bytes").alias("largest")).collect()
        for p in split:
            cells.pop(p, None)
        cells |= {r.cell: (r.bytes, r.groups, r.largest) for r in rows}
        if not cells:
            return []
        names = sorted(cells)
        size, count, largest = (np.array([cells[x][k] for x in names], np.int64) for k in range(3))
        ends = np.cumsum(size)
        low = max(-(-int(ends[-1]) // shards), int(largest.max()))
        capacity = smallest_capacity(ends, low, shards)
        found = np.flatnonzero(open_cells(ends, count, low, capacity, shards))
        # prefixes of one length at a time, the shortest first, and as many as the driver may hold
        short = min((len(names[k]) for k in found), default=0)
        found = [k for k in found if len(names[k]) == short]
        room = max(16, (MAX_CELLS - len(cells)))
        found = sorted(found, key=lambda k: -size[k])[: max(1, room // 16)]
        digits = 2 if len(found) * 256 <= room else 1
        split = [names[k] for k in found]
    return [names[k - 1] if k else "" for k in level_cuts(ends, capacity, shards)[:-1]]


def shard_of(digest: Column, cuts: list[str]) -> Column:
    """How many cuts lie before a digest."""
    return sum((F.when(F.substring(digest, 1, len(c)) > c, 1).otherwise(0) if c else F.lit(1) for c in cuts), F.lit(0)).cast("int")


def assign(docs: DataFrame, *, shards: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs (key, size, text_crc32, law, shard, slot, grown_shard) under the law `bytes`.

    size is the text's UTF-8 bytes plus 1; a null text has 1 and is a group of its own, apart from
    the empty text's. Equal texts share a shard. Slots count a shard's rows from 0 without gaps,
    in an order that the key gives; rows with equal keys and texts are alike. With fewer groups
    than shards some shards stay empty. An empty table gives an empty result. Other columns are
    not looked at.
    """
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        F.coalesce(F.sha2(F.col(text).cast("binary"), 256), F.lit("-" * 64)).alias("digest"),
    )
    rows = materialize(rows, "sized")
    groups = materialize(rows.groupBy("digest").agg(F.sum("size").alias("bytes")), "groups")
    placed = rows.select("doc_id", "size", "text_crc32", shard_of(F.col("digest"), find_cuts(groups, shards)).alias("shard"), F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).alias("part"))
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))  # shards * PARTS rows at most
    before = counts.select("shard", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("before"))
    number = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")) - 1
    return placed.withColumn("number", number).join(F.broadcast(before), ["shard", "part"]).select(
        F.col("doc_id").alias(key), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("number")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
