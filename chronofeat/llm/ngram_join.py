"""Exact n-gram Jaccard join: size-banded tiles, hashed bitmap signatures, sorted-array intersection.

A document's set holds the 64-bit hashes of its distinct word n-grams. Sets of similarity t or
more have sizes within a factor t and differ in at most (1 - t) / t times the smaller size
elements. So sets are put into *size bands*; in a band the hash range is cut into one slot more
than sets may differ in, plus spare ones, and two similar sets agree wholly in at least one slot
that is not empty. A (band, slot, content) key is a *tile*: only its members are compared.

1. Each set is compared with the smallest member of its tiles. Components of those links follow.
2. It is compared with those of its other tiles' smallest members that it isn't yet connected with, and
   a part of the tiles that still hold several components gives the likeliest pairs that would join
   them. This is linear in the tiles; components follow again.
3. Tiles that still hold several components give all pairs of what lies apart even so. Their
   members are cut into blocks of a bounded size, and each pair of blocks is one unit of numpy bit
   counts over bitmap signatures. Where a and b are the sizes, the bits that differ are at most the
   elements that differ, so (a + b - differing bits) / 2 bounds the overlap from above. Pairs that
   pass meet their sorted arrays.

Every candidate is checked on the whole arrays, so links are exact but for collisions of 64-bit
hashes. Equal sets share one node, so copies are never compared or paired.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sieve
from .common import LOWER, NOT_SPACE, materialize, mix64, pieces, prefix_hash, scratch, small_batches, span_hash, text_buffer, word_spans
from .graph import connected_components

#: Least bits of a signature, members of a block, components up to which a tile is cut by their pairs, ratio of a band's ends.
BITS, BLOCK, FEW, BAND = 1024, 1024, 4, 1.5
#: One tile in so many gets a forest of likely links before all tiles get all of theirs.
SOME = 16


# ---------------------------------------------------------------- sets


def gram_hashes(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct n-gram hashes; one hash of the whole if it has fewer words, none if it has no word."""
    data, offsets = text_buffer(column)
    odd = [np.uint64((2 * k + 1) * 0x9E3779B97F4A7C15 % (1 << 64)) for k in range(words)]
    for a, b in pieces(offsets):
        low = offsets[a]
        part = LOWER[data[low : offsets[b]]]
        starts, ends, first = word_spans(part, offsets[a : b + 1] - low, NOT_SPACE)
        hashes = span_hash(prefix_hash(part), starts, ends)
        n = len(hashes) - words + 1
        grams = np.zeros(0, np.uint64)
        if n > 0:
            grams = hashes[:n] * odd[0]
            for k in range(1, words):
                grams = mix64(grams) + hashes[k : k + n] * odd[k]
            grams = mix64(grams)
        for s, e in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if e - s >= words:
                g = np.sort(grams[s : e - words + 1])
                yield g[np.concatenate(([True], g[1:] != g[:-1]))] if len(g) > 1 else g
            elif e > s:
                x = np.array([e - s], np.uint64)
                for k in range(s, e):
                    x = mix64(x) + hashes[k : k + 1] * odd[k - s]
                yield mix64(x)
            else:
                yield grams[:0]


def set_hash(grams: np.ndarray) -> int:
    """A set's 64-bit identity (signed)."""
    total = np.array([len(grams)], np.uint64) + np.sum(mix64(grams ^ np.uint64(0xA24BAED4963EE407)), dtype=np.uint64)
    return int(mix64(total).view(np.int64)[0])


def bitmap(grams: np.ndarray, times: int = 4) -> bytes:
    """A power of two of bits, `times` the elements at least; each tells whether an odd number of elements hash to it, so that equal elements cancel in a xor."""
    bits = BITS
    while bits < times * len(grams):
        bits *= 2
    count = np.bincount((grams & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((count & 1).astype(np.uint8)).tobytes()


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """A bitmap in fewer words: the parities of bits that fall together."""
    return bits if len(bits) == words else np.bitwise_xor.reduce(bits.reshape(-1, words), axis=0)


# ---------------------------------------------------------------- tiles


def band_of(size: int) -> int:
    band = int(math.log(size) / math.log(BAND))
    while BAND**band > size:
        band -= 1
    while BAND ** (band + 1) <= size:
        band += 1
    return band


@lru_cache(maxsize=None)
def slots_of(band: int, num: int, den: int) -> tuple[int, int]:
    """(slots, spare) of a band for the threshold num / den: elements that may differ, one more, and spare ones for empty slots."""
    largest = math.ceil(BAND ** (band + 1)) - 1
    differ = largest * (den - num) // num
    slots = differ + 1
    for _ in range(3):
        empty = slots * math.exp(-(BAND**band) / slots)
        spare = math.ceil(empty + 5 * math.sqrt(empty)) + 1 if differ else 0
        slots = differ + 1 + spare
    return slots, spare


def tile_keys(grams: np.ndarray, num: int, den: int) -> np.ndarray:
    """The keys under which a set meets every set of similarity num / den or more.

    A set is entered in its own band and in each band below where a similar smaller set may lie.
    At most `differ` slots of two similar sets differ, so more than `spare` agree; a set
    with more empty slots than that is also entered under its empty ones.
    """
    size = len(grams)
    if not size:
        return grams
    own, out = band_of(size), []
    for band in range(band_of(max(1, -(-size * num // den))), own + 1):
        slots, spare = slots_of(band, num, den)
        slot = ((grams >> np.uint64(32)) * np.uint64(slots)) >> np.uint64(32)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(grams ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)))
        cuts = np.searchsorted(slot, np.arange(slots + 1, dtype=np.uint64))
        counts = np.diff(cuts)
        content = sums[cuts[1:]] - sums[cuts[:-1]]
        name = np.arange(slots, dtype=np.uint64) + np.uint64((band + 64) << 40)
        keys = mix64(content + mix64(name))
        out.append(keys if (counts == 0).sum() > spare else keys[counts > 0])
    return np.concatenate(out)


def _tiles(words: int, num: int, den: int, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # sets that this task has entered; only spares repeats
        for batch in batches:
            keys, nodes, held = [], [], 0
            for grams in gram_hashes(batch.column(column), words):
                if not len(grams) or (node := set_hash(grams)) in seen:
                    continue
                seen.add(node)
                if len(seen) > 1_000_000:
                    seen.clear()
                keys.append(tile_keys(grams, num, den))
                nodes.append((node, len(keys[-1])))
                held += len(keys[-1])
                if held > 500_000:
                    yield _rows(keys, nodes)
                    keys, nodes, held = [], [], 0
            if held:
                yield _rows(keys, nodes)

    return run


def _rows(keys: list[np.ndarray], nodes: list[tuple[int, int]]) -> pa.RecordBatch:
    """(key, node, center) sorted by key: of a key's nodes here the smallest, its head, has no center; the head is the others' center.

    Only heads have to meet under their key, so a key that very many nodes share sends few rows there.
    """
    node, times = np.array(nodes, np.int64).T
    key, node = np.concatenate(keys).view(np.int64), np.repeat(node, times)
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    again = np.concatenate(([False], (key[1:] == key[:-1]) & (node[1:] == node[:-1])))
    key, node = key[~again], node[~again]
    head = np.concatenate(([True], key[1:] != key[:-1]))
    center = node[np.maximum.accumulate(np.where(head, np.arange(len(key)), 0))]
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(node), pa.array(center, mask=head)], ["key", "node", "center"])


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, node, center) sorted by (key, node): those that have a center, and of the others those of keys with several nodes, each once, with the key's first node."""
    key_now, first, last = None, 0, 0  # of the key that is open: its first head, its last
    for batch in batches:
        local = batch.filter(pc.is_valid(batch.column("center")))
        if local.num_rows:
            yield local
        heads = batch.filter(pc.is_null(batch.column("center")))
        key, node = (heads.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        if not len(key):
            continue
        new = np.concatenate(([key_now is None or key[0] != key_now], key[1:] != key[:-1]))
        head = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
        center = np.where(head >= 0, node[head], first)
        previous = np.concatenate(([last], node[:-1]))
        keep = ~new & (node != previous)
        key_now, first, last = key[-1], int(center[-1]), int(node[-1])
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (key, node, center)], ["key", "node", "center"])


# ---------------------------------------------------------------- arrays and checks


def _sets(words: int, candidates):
    """(doc_id, n, node, bits, grams) of each row; bitmaps and grams only for sets that a filter may hold, once a task or a little oftener."""
    names, kinds = ["doc_id", "n", "node", "bits", "grams"], [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[int] = set()
        for batch in batches:
            ids = batch.column("doc_id")
            rows: list[tuple] = []
            at = held = 0
            for i, grams in enumerate(gram_hashes(batch.column("text"), words)):
                rows.append((len(grams), set_hash(grams), grams))
                held += len(grams)
                if held > 1_000_000 or i + 1 == len(ids):
                    n, node, sets = zip(*rows, strict=True)
                    wanted = [may and k > 0 and x not in given for may, k, x in zip(sieve.holds(candidates.value, np.array(node, np.int64)).tolist(), n, node, strict=True)]
                    given.update(x for x, w in zip(node, wanted, strict=True) if w)
                    if len(given) > 1_000_000:
                        given.clear()
                    columns = [n, node, [bitmap(g) if w else None for g, w in zip(sets, wanted, strict=True)], [g.tobytes() if w else None for g, w in zip(sets, wanted, strict=True)]]
                    yield pa.RecordBatch.from_arrays([ids.slice(at, len(rows)), *(pa.array(list(x), k) for x, k in zip(columns, kinds[1:], strict=True))], names)
                    rows, at, held = [], i + 1, 0

    return run


def enough(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """Whether two sorted arrays of distinct elements have den * |intersection| >= num * |union|."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return both > 0 and den * both >= num * (len(a) + len(b) - both)


def _checked(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("grams_a"), batch.column("grams_b")
            keep = [enough(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), num, den) for x, y in zip(left, right, strict=True)]
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])

    return run


def bounded(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose bit counts leave room for a link."""
    brief = sets.select("node", "n", "bits").dropDuplicates(["node"])
    side = lambda x: brief.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_bounded(num, den), "a long, b long")


def verify(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose whole arrays are similar enough."""
    pairs = materialize(pairs, "bounded")
    needed = sieve.build(pairs.select(F.explode(F.array("a", "b")).alias("a")), "a")
    arrays, _ = sieve.split(sets.select("node", "grams"), "node", needed)
    arrays = arrays.repartition("node").dropDuplicates(["node"])
    checked = pairs.join(arrays.select(F.col("node").alias("b"), F.col("grams").alias("grams_b")), "b").join(arrays.select(F.col("node").alias("a"), F.col("grams").alias("grams_a")), "a")
    links = materialize(checked.mapInArrow(_checked(num, den), "a long, b long"), "links")
    needed.destroy()
    return links


def may_link(n_a, n_b, differ, num: int, den: int):
    """The bound: (n_a + n_b - differ) / 2 is at least the overlap."""
    return (den + num) * (n_a + n_b - differ) >= 2 * num * (n_a + n_b)


def _bounded(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = [batch.column(f"n_{x}").to_numpy() for x in "ab"]
            differ = np.empty(batch.num_rows, np.int64)
            for k, (x, y) in enumerate(zip(batch.column("bits_a"), batch.column("bits_b"), strict=True)):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                words = min(len(x), len(y))
                differ[k] = np.bitwise_count(folded(x, words) ^ folded(y, words)).sum()
            mask = pa.array(may_link(*sizes, differ, num, den))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])

    return run


def tile_pairs(own: np.ndarray, node: np.ndarray, n: np.ndarray, bits: np.ndarray, group: np.ndarray, num: int, den: int, forest: bool = False) -> np.ndarray:
    """The pairs of one tile that lie in different components and whose bit counts leave room for a link; for a forest only those of fewest differing bits that would join the components.

    own: the side of a member, 0 or 1 for the two blocks of a tile across them, 2 for a block on its own.
    """
    left, right = np.flatnonzero(own != 1), np.flatnonzero(own != 0)
    found, counts = [], []
    for k in left.tolist():
        others = right[(group[right] != group[k]) & ((own[right] == 1) | (node[right] > node[k]))]
        differ = np.bitwise_count(bits[others] ^ bits[k]).sum(axis=1, dtype=np.int64)
        keep = may_link(n[k], n[others], differ, num, den)
        found.append(np.stack((np.full(keep.sum(), k), others[keep])))
        counts.append(differ[keep])
    if not found:
        return np.zeros((2, 0), np.int64)
    pairs = np.concatenate(found, axis=1)
    if forest:
        order, up, kept, wanted = np.argsort(np.concatenate(counts), kind="stable"), {}, [], len(np.unique(group)) - 1
        for k, a, b in zip(order.tolist(), *group[pairs[:, order]].tolist(), strict=True):
            while a in up:
                a = up[a]
            while b in up:
                b = up[b]
            if a != b:
                up[max(a, b)] = min(a, b)
                kept.append(k)
                if len(kept) == wanted:
                    break
        pairs = pairs[:, kept]
    return np.sort(node[pairs], axis=0)


def _unit(table: pa.Table) -> np.ndarray:
    """The columns that name a unit; its y may be null."""
    return np.stack([table.column("x").to_numpy(), table.column("y").fill_null(0).to_numpy(), table.column("y").is_null().to_numpy(), table.column("i").to_numpy(), table.column("j").to_numpy()]).astype(np.int64)


def _tile_pairs(num: int, den: int, forest: bool):
    """Of rows sorted by unit (x, y, i, j), at most two blocks of members each: the pairs of tile_pairs()."""

    def pairs_of(table: pa.Table) -> pa.RecordBatch:
        own, node, n, component = (table.column(c).to_numpy() for c in ("side", "node", "n", "component"))
        bits = [np.frombuffer(x, np.uint64) for x in table.column("bits").to_pylist()]
        unit = _unit(table)
        cuts = np.flatnonzero((unit[:, 1:] != unit[:, :-1]).any(axis=0)) + 1
        ends = [0, *cuts.tolist(), len(node)]
        found = []
        for s, e in zip(ends[:-1], ends[1:], strict=True):
            words = min(map(len, bits[s:e]))
            found.append(tile_pairs(own[s:e], node[s:e], n[s:e], np.stack([folded(x, words) for x in bits[s:e]]), component[s:e], num, den, forest))
        a, b = np.concatenate(found, axis=1)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now])
            # the last tile may go on in the next batch
            unit = _unit(held)
            other = np.flatnonzero((unit != unit[:, -1:]).any(axis=0))
            if len(other):
                yield pairs_of(held.slice(0, int(other[-1]) + 1))
                held = held.slice(int(other[-1]) + 1)
        if held is not None and held.num_rows:
            yield pairs_of(held)

    return run


def relabel(label: DataFrame, links: DataFrame) -> DataFrame:
    """Components (node, component) after further links (a, b)."""
    return materialize(connected_components(label.select(F.col("node").alias("a"), F.col("component").alias("b")).union(links)), "labels")


def _apart(placed: DataFrame) -> DataFrame:
    """Rows (x, y, i, j, side, node, component) of what still has to be compared, from tile members (key, node, component).

    A tile of few components becomes a unit for each pair of them, (x, y), in which the members that
    share any tile meet once, however many tiles they share. A tile of more components, (key, null),
    stays whole. Units are cut into blocks; only blocks that can hold pairs to compare are paired.
    """
    groups = placed.groupBy("key", "component").agg(F.count("*").alias("size"))
    apart = groups.groupBy("key").agg(F.count("*").alias("groups"), F.sum("size").alias("size")).where("groups > 1 AND size > 2")
    few = placed.join(apart.where(F.col("groups") <= FEW).select("key"), "key").join(groups.select("key", F.col("component").alias("other")), "key").where("component <> other")
    few = few.select(F.least("component", "other").alias("x"), F.greatest("component", "other").alias("y"), "node", "component").distinct().withColumn("side", (F.col("component") == F.col("y")).cast("int"))
    few = materialize(few, "few")
    blocks = few.groupBy("x", "y").agg(*[F.ceil(F.sum(F.when(F.col("side") == s, 1).otherwise(0)) / BLOCK).cast("int").alias(f"blocks_{s}") for s in (0, 1)])
    few = few.join(blocks, ["x", "y"]).withColumn("own", F.pmod(F.hash("node"), F.when(F.col("side") == 0, F.col("blocks_0")).otherwise(F.col("blocks_1"))))
    few = few.withColumn("across", F.explode(F.sequence(F.lit(0), F.when(F.col("side") == 0, F.col("blocks_1")).otherwise(F.col("blocks_0")) - 1)))
    i, j = (F.when(F.col("side") == s, F.col("own")).otherwise(F.col("across")) for s in (0, 1))
    few = few.select("x", "y", i.alias("i"), j.alias("j"), "side", "node", "component")
    many = placed.join(apart.where(F.col("groups") > FEW).select("key", "size"), "key").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("block", F.pmod(F.hash("node"), "blocks"))
    many = many.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    side = F.when(F.col("i") == F.col("j"), 2).when(F.col("block") == F.col("i"), 0).otherwise(1)
    return few.union(many.select(F.col("key").alias("x"), F.lit(None).cast("long").alias("y"), "i", "j", side.alias("side"), "node", "component"))


def _tile_links(placed: DataFrame, label: DataFrame, sets: DataFrame, num: int, den: int, forest: bool = False) -> DataFrame:
    """The pairs of tile_pairs() of the tiles (key, node) that hold several components."""
    tiles = _apart(placed.distinct().join(label, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component")))
    tiles = tiles.join(sets.select("node", "n", "bits").dropDuplicates(["node"]), "node")
    tiles = tiles.repartition("x", "y", "i", "j").sortWithinPartitions("x", "y", "i", "j")
    return tiles.mapInArrow(_tile_pairs(num, den, forest), "a long, b long").distinct()


# ---------------------------------------------------------------- the operator


def near_duplicates(docs: DataFrame, *, words: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs (key, n_shingles, component_id): the size of its n-gram set and the smallest key that it reaches by links.

    Two rows link when den * |intersection| >= num * |union|. Texts without a word, and null, have
    an empty set, link with nothing and stand for themselves. Repeated texts share a set and link.
    Rows that share a key are one node. A null key keeps its row; such rows don't join others. Keys
    are whole numbers, or cast to them (an error where that fails). An empty table gives an empty result. Other columns of docs are not looked at.
    """
    with scratch(docs.sparkSession):
        small_batches(docs.sparkSession)
        docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
        rows = docs.where("doc_id is not null").select("text").mapInArrow(_tiles(words, num, den, "text"), "key long, node long, center long")
        members = rows.repartition(F.when(F.col("center").isNull(), F.col("key")).otherwise(F.col("node"))).sortWithinPartitions("key", "node")
        members = materialize(members.mapInArrow(_members, "key long, node long, center long"), "members")
        candidates = sieve.build(members.select(F.explode(F.array("node", "center")).alias("node")), "node")
        every = materialize(docs.mapInArrow(_sets(words, candidates), "doc_id long, n long, node long, bits binary, grams binary"), "sets")
        candidates.destroy()
        sets = every.where("grams is not null").select("node", "n", "bits", "grams")
        standing = every.where("n > 0 and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("rep"))
        # first each set against one centre
        met = members.groupBy("node").agg(F.min("center").alias("center")).select(F.least("node", "center").alias("a"), F.greatest("node", "center").alias("b"))
        label = relabel(met.limit(0).toDF("node", "component"), verify(bounded(met, sets, num, den), sets, num, den))
        # then against its tiles' other centres that lie apart from it, and a forest over some of the tiles that hold several components
        placed = members.select("key", "node").union(members.select("key", F.col("center").alias("node")))
        some = _tile_links(placed.where(F.pmod(F.xxhash64("key"), F.lit(SOME)) == 0), label, sets, num, den, forest=True)
        of = lambda x: label.select(F.col("node").alias(x), F.col("component").alias(f"of_{x}"))
        others = members.select(F.least("node", "center").alias("a"), F.greatest("node", "center").alias("b")).distinct()
        others = others.join(of("a"), "a", "left").join(of("b"), "b", "left").where("NOT coalesce(of_a = of_b, false)").select("a", "b")
        label = relabel(label, verify(bounded(others, sets, num, den).union(some).distinct(), sets, num, den))
        # then all pairs of components that still share a tile
        label = relabel(label, verify(_tile_links(placed, label, sets, num, den), sets, num, den))
        # nodes are sets; their documents take the smallest key of all sets that they reach
        joined = label.join(standing, "node").groupBy("component").agg(F.min("rep").alias("component_id"))
        of_set = standing.join(label, "node", "left").join(joined, "component", "left").select("node", F.coalesce("component_id", "rep").alias("component_id"))
        own = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
        found = every.join(of_set, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))
        return materialize(found, "near", keep=True)


def keep_one(docs: DataFrame, **params) -> DataFrame:
    """The rows of docs, with all their columns, that stand for their group of near duplicates: those with the smallest key.

    Rows that share a key stay or go together; rows without words, and of a null key, all stay. An
    empty table gives an empty one; long texts count by all their shingles.
    """
    key, text = params.get("key", "doc_id"), params.get("text", "text")
    found = near_duplicates(docs, **params)
    gone = materialize(found.where("component_id < doc_id").select(F.col("doc_id").alias(key)).distinct(), "gone")
    # only rows that may be gone are shuffled
    doubtful, safe = sieve.split(docs, key, sieve.build(gone, key))
    return safe.unionByName(doubtful.join(gone, key, "left_anti").select(docs.columns))
