"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree over block quotas.

Documents of a source are dealt into blocks by a hash of their key; a block is taken whole, none,
one or several times. Targets share a budget by weight, stop at `cap` times a source's words, and
pass the excess on. Beyond the whole times that a target holds its source, the source's blocks
are taken in a seeded permutation while they fit, so that less than a block is missing. How many block copies of each source go to each output shard is drawn
by halving the shards again and again: a multivariate hypergeometric draw gives the left half its
copies of every source, the right half keeps the rest. Each shard then draws its run of each
source's permuted blocks, disjoint from all others, and orders its rows by a seeded hash.

All draws depend on the seed, keys and counts, so a rerun, or a task run twice, agrees.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

#: Blocks of a source; sources at most (their totals, not their rows, are held by the driver); sources up to which a plan is broadcast.
BLOCKS, MAX_SOURCES, MAX_BROADCAST = 512, 100_000, 1000
#: Words are runs of other characters than these.
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights: list[float], share: float, cap: float) -> list[float]:
    """Words to take of each source: share * sum(sizes) by weight, none above cap times its size, the excess shared again by weight."""
    out, left, free = [0.0] * len(sizes), share * sum(sizes), list(range(len(sizes)))
    while free and left > 0:
        total = sum(weights[i] for i in free)
        full = [i for i in free if weights[i] * left / total >= cap * sizes[i]]
        for i in full or free:
            out[i] = cap * sizes[i] if full else weights[i] * left / total
        if not full:
            break
        free = [i for i in free if i not in set(full)]
        left = share * sum(sizes) - sum(out)
    return out


def splitting_tree(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Block copies [source, shard]; rows sum to the quotas, columns are as even as they can be."""
    if shards == 1:
        return quotas[:, None]
    left = shards // 2
    drawn = rng.multivariate_hypergeometric(quotas, int(quotas.sum()) * left // shards, method="marginals") if quotas.sum() else quotas
    return np.concatenate((splitting_tree(drawn, left, rng), splitting_tree(quotas - drawn, shards - left, rng)), axis=1)


def sized(docs: DataFrame, key: str, source: str, text: str, seed: int) -> DataFrame:
    """The narrow columns that the plan needs: key, source as a word that null has too, words, block."""
    return docs.select(
        F.col(key).alias("doc_id"),
        F.coalesce(F.concat(F.lit("="), source), F.lit("null")).alias("origin"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(BLOCKS)).cast("int").alias("block"),
    )


def plan(rows: DataFrame, *, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, shards: int = 8, seed: int = 7) -> DataFrame:
    """Per (origin, block) of sized() rows: source_size, target, copies and the shard of each copy; BLOCKS rows a source at most."""
    spark = rows.sparkSession
    blocks = materialize(rows.groupBy("origin", "block").agg(F.sum("size").alias("words")), "blocks")
    totals = sorted(((r.origin, r.words) for r in blocks.groupBy("origin").agg(F.sum("words").alias("words")).limit(MAX_SOURCES + 1).collect()), key=lambda r: (r[0] == "null", r[0]))
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    goal = targets([n for _, n in totals], [float(weights[i % len(weights)]) for i in range(len(totals))], share, cap)
    goals = spark.createDataFrame([(o, n, t, int(t // n) if n else 0) for (o, n), t in zip(totals, goal, strict=True)], "origin string, source_size long, target double, whole int")
    # BLOCKS entries a source at most, in the seeded order; a block is taken once more if it still fits
    entry = F.struct(F.xxhash64(F.lit(seed + 1), "origin", "block").alias("place"), "block", "words")
    fill = F.expr("""aggregate(entries, named_struct('words', CAST(0 AS BIGINT), 'took', CAST(array() AS array<int>)), (acc, x) ->
        IF(x.words > 0 AND acc.words + x.words <= target - whole * source_size,
           named_struct('words', acc.words + x.words, 'took', concat(acc.took, array(x.block))), acc)).took""")
    entries = blocks.groupBy("origin").agg(F.sort_array(F.collect_list(entry)).alias("entries")).join(F.broadcast(goals), "origin").withColumn("took", fill)
    order = Window.partitionBy("origin").orderBy("place", "block")
    taken = (
        entries.select("origin", "source_size", "target", "whole", "took", F.inline("entries"))
        .withColumn("copies", F.col("whole") + F.array_contains("took", F.col("block")).cast("int"))
        .withColumn("first", F.sum("copies").over(order) - F.col("copies"))
        .drop("took")
    )
    taken = materialize(taken, "taken")
    quotas = dict(map(tuple, taken.groupBy("origin").agg(F.sum("copies").alias("n")).collect()))
    dealt = splitting_tree(np.array([quotas[o] for o, _ in totals], np.int64), shards, np.random.default_rng(seed)) if totals else np.zeros((0, shards), np.int64)
    ends = spark.createDataFrame([(o, [int(x) for x in np.cumsum(row)]) for (o, _), row in zip(totals, dealt, strict=True)], "origin string, ends array<long>")
    shard = F.expr("transform(filter(sequence(0, copies), c -> c < copies), c -> size(filter(ends, e -> e <= first + c)))")
    found = taken.join(F.broadcast(ends), "origin").select("origin", "block", "source_size", "target", "copies", shard.alias("shards"))
    return F.broadcast(found) if len(totals) <= MAX_BROADCAST else found  # 64 MB at most: BLOCKS rows of some 100 bytes a source


def takes(docs: DataFrame, *, key: str = "doc_id", source: str = "source", text: str = "text", seed: int = 7, **params) -> DataFrame:
    """Per row of docs (key, size, source_size, target, taken, shards): its words, its source's words and target, the words that the shards' draws take from it, and the shard of each draw.

    A null text has no words; null is a source, the last; an empty table gives an empty result.
    Sources follow each other by code point and repeat the weights. Rows that share a key share
    a block. A source without words has target 0. Other columns are not looked at.
    """
    rows = materialize(sized(docs, key, source, text, seed), "sized")
    blocks = plan(rows, seed=seed, **params)
    return rows.join(blocks, ["origin", "block"]).select(F.col("doc_id").alias(key), "size", "source_size", "target", (F.col("size") * F.size("shards")).alias("taken"), "shards")


def mix(docs: DataFrame, *, key: str = "doc_id", source: str = "source", text: str = "text", seed: int = 7, with_shard: bool = False, **params) -> DataFrame:
    """The mix itself: rows of docs with all their columns, each as often as it is drawn, dealt to their shards and shuffled there.

    Nulls, repeated rows and empty tables as in takes(); a row without words goes with its block.

    with_shard adds the columns `mix_shard` and `mix_copy`.
    """
    rows = materialize(sized(docs, key, source, text, seed), "sized")
    blocks = plan(rows, seed=seed, **params)
    names = docs.columns
    tagged = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"),
        F.coalesce(F.concat(F.lit("="), source), F.lit("null")).alias("origin"),
        F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(BLOCKS)).cast("int").alias("block"),
    )
    drawn = tagged.join(blocks, ["origin", "block"]).select("doc", F.posexplode("shards").alias("mix_copy", "mix_shard"))
    drawn = drawn.withColumn("place", F.xxhash64(F.lit(seed + 2), "doc." + key, "mix_copy"))
    mixed = drawn.repartition("mix_shard", "place").sortWithinPartitions("mix_shard", "place")
    return mixed.select(*[F.col("doc").getField(c).alias(c) for c in names], *(["mix_shard", "mix_copy"] if with_shard else []))
