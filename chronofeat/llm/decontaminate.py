"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

A *window* is `window` consecutive words of an item, or the whole of a shorter item. The automaton
accepts every word run of every item; streaming a document's words through it gives, at each word,
the longest item run that ends there. Where that length reaches a window, the window's words are
hit. Before the stream, a numpy pass hashes the words and looks up evenly spaced short grams, longer
ones for longer windows: every window holds one of them wholly, so a document without any has no hit and is not streamed.

The test items are a stated query set: they are read in blocks of a checked size, each block one
broadcast automaton that meets all documents. A row is judged by the hits of all blocks together.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, LOWER, materialize, mix64, pieces, prefix_hash, small_batches, span_hash, text_buffer, word_spans

#: Bytes of item texts in one automaton; its states take some 190 times as much, so about 100 MB of a process.
BLOCK_BYTES = 1 << 19
#: Bytes of an item beyond which it is cut into parts.
PART_BYTES = 1 << 16
#: Least words of the window lengths that are looked up by grams of one length.
CLASSES = (1, 2, 4, 8)
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOWN = str.maketrans({c: c + 32 for c in range(65, 91)})


def normal_words(text: str | None) -> list[str]:
    """Lower-cased (A-Z) runs of letters, digits and characters beyond ASCII; none for null."""
    return WORD.findall(text.translate(DOWN)) if text else []


class Automaton:
    """Generalised suffix automaton over the words of items [(id, words)]."""

    def __init__(self, items: list[tuple[object, list[str]]], window: int):
        self.window, self.ids = window, [x for x, _ in items]
        self.next: list[dict[str, int]] = [{}]
        self.length, self.link = [0], [-1]
        ends = []
        for _, words in items:
            at, path = 0, []
            for w in words:
                at = self._extend(at, w)
                path.append(at)
            ends.append(path)
        #: Items with a run of at least `window` words in a state; whole short items by state, with their length.
        self.holds: list[set[int]] = [set() for _ in self.length]
        self.whole: dict[int, list[tuple[int, int]]] = {}
        for i, (_, words) in enumerate(items):
            at = 0
            for w in words:
                at = self.next[at][w]
                up = at
                while up > 0 and self.length[up] >= window and i not in self.holds[up]:
                    self.holds[up].add(i)
                    up = self.link[up]
            if 0 < len(words) < window:
                self.whole.setdefault(at, []).append((len(words), i))
        #: The nearest state up the links, itself included, that has a whole short item.
        self.near = [0] * len(self.length)
        for v in sorted(range(1, len(self.length)), key=self.length.__getitem__):
            self.near[v] = v if v in self.whole else self.near[self.link[v]]
        self._grams([words for _, words in items])

    def _new(self, length: int, link: int, after: dict[str, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(after)
        return len(self.length) - 1

    def _split(self, p: int, q: int, w: str) -> int:
        """The state of q's run of length[p] + 1 words, apart from its longer ones."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, w: str) -> int:
        if w in self.next[last]:
            return self._split(last, self.next[last][w], w)
        new, p = self._new(self.length[last] + 1, 0, {}), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        self.link[new] = 0 if p < 0 else self._split(p, self.next[p][w], w)
        return new

    def _grams(self, texts: list[list[str]]) -> None:
        """For window lengths of each class (gram, stride, hashes of all grams of `gram` words): every window holds one that starts at a multiple of `stride`."""
        self.grams: list[tuple[int, int, np.ndarray]] = []
        size = lambda t: min(len(t), self.window)
        for low, high in zip(CLASSES, (*CLASSES[1:], self.window + 1), strict=True):
            own = [t for t in texts if low <= size(t) < high] if high <= self.window else [t for t in texts if low <= size(t)]
            if not own:
                continue
            least = min(map(size, own))
            gram = (least + 1) // 2
            data, offsets = text_buffer(pa.array([" ".join(t) for t in own], pa.string()))
            starts, ends, first = word_spans(data, offsets, ALNUM)
            hashes = span_hash(prefix_hash(data), starts, ends)
            found = [gram_at(hashes, np.arange(a, b - gram + 1), gram) for a, b in zip(first[:-1], first[1:], strict=True)]
            self.grams.append((gram, least - gram + 1, np.unique(np.concatenate(found))))
            if high > self.window:
                break

    def spans(self, words: list[str]) -> tuple[list[tuple[int, int]], set[int]]:
        """Maximal hit word ranges [s, e), and the items whose windows occur."""
        out: list[tuple[int, int]] = []
        items: set[int] = set()
        state = matched = 0
        for j, w in enumerate(words):
            while state and w not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            state = self.next[state].get(w, 0)
            matched = matched + 1 if state else 0
            if not state:
                continue
            reach = 0
            if matched >= self.window:
                up = state
                while self.length[self.link[up]] >= self.window:
                    up = self.link[up]
                items |= self.holds[up]
                reach = self.window
            up = self.near[state]
            while up:
                for n, i in self.whole[up]:
                    if n <= matched:
                        items.add(i)
                        reach = max(reach, n)
                up = self.near[self.link[up]]
            if reach:
                s = j + 1 - reach
                while out and out[-1][1] >= s:
                    s = min(s, out.pop()[0])
                out.append((s, j + 1))
        return out, items


def gram_at(hashes: np.ndarray, at: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of the runs of `gram` words that start at the given words."""
    total = np.zeros(len(at), np.uint64)
    for k in range(gram):
        total = mix64(total + hashes[at + k])
    return total


def _scan(automaton: Automaton, column: pa.Array) -> Iterator[tuple[int, list[tuple[int, int]], set[int]]]:
    """(words, hit ranges, items) of each text."""
    data, offsets = text_buffer(column)
    row = 0
    for a, b in pieces(offsets):
        low = offsets[a]
        part = LOWER[data[low : offsets[b]]]
        starts, ends, first = word_spans(part, offsets[a : b + 1] - low, ALNUM)
        counts = np.diff(first)
        hashes = span_hash(prefix_hash(part), starts, ends)
        doc = np.repeat(np.arange(b - a), counts)
        place = np.arange(len(starts)) - first[:-1][doc]
        near = np.zeros(b - a, bool)
        for gram, stride, known in automaton.grams:
            at = np.flatnonzero((place % stride == 0) & (place + gram <= counts[doc]))
            if len(at):
                found = gram_at(hashes, at, gram)
                near[doc[at[known[np.minimum(np.searchsorted(known, found), len(known) - 1)] == found]]] = True
        for i in range(b - a):
            yield (int(counts[i]), *(automaton.spans(normal_words(column[row].as_py())) if near[i] else ([], set())))
            row += 1


def item_parts(items: DataFrame, window: int) -> DataFrame:
    """items (id, text), long texts in parts of about PART_BYTES that share window - 1 words, so that each window stays whole."""
    most = PART_BYTES
    long = F.octet_length("text") > most

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
                words, at = normal_words(text.as_py()), 0
                while at < len(words):
                    stop, size = at, 0
                    while stop < len(words) and size < most:
                        size += len(words[stop]) + 1
                        stop += 1
                    end = len(words) if stop + window - 1 >= len(words) else stop + window - 1
                    yield pa.RecordBatch.from_arrays([pa.array([one], batch.column("id").type), pa.array([" ".join(words[at:end])], pa.string())], ["id", "text"])
                    at = len(words) if end == len(words) else stop

    parts = items.where(long).mapInArrow(cut, f"id {items.schema['id'].dataType.simpleString()}, text string")
    return items.where(~long).union(parts)


def item_blocks(items: DataFrame, key: str, text: str, window: int) -> list[DataFrame]:
    """The items (id, text) in blocks of BLOCK_BYTES at most, about, long ones in parts; null texts are in none."""
    items = item_parts(items.select(F.col(key).alias("id"), F.col(text).alias("text")).where("text is not null"), window)
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = 1 + 2 * size // BLOCK_BYTES if size > BLOCK_BYTES else 1
    return [items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k) for k in range(blocks)]


def automaton_of(block: DataFrame, window: int) -> Automaton:
    """The automaton of a block of items; items without words hold none."""
    return Automaton([(r.id, w) for r in block.orderBy("id", "text").collect() if (w := normal_words(r.text))], window)


def _found(docs: DataFrame, block: DataFrame, window: int) -> tuple[DataFrame, Broadcast]:
    """(key, n_words, spans, items) of each row of docs (key, text) under one block of items, and the broadcast that it needs."""
    held = docs.sparkSession.sparkContext.broadcast(automaton_of(block, window))
    schema = f"key {docs.schema['key'].dataType.simpleString()}, n_words long, spans array<struct<s:long,e:long>>, items array<string>"
    kinds = [pa.int64(), pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())])), pa.list_(pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = held.value
        for batch in batches:
            found = [(n, [{"s": s, "e": e} for s, e in spans], sorted({str(automaton.ids[i]) for i in ids if automaton.ids[i] is not None})) for n, spans, ids in _scan(automaton, batch.column("text"))]
            columns = zip(*found, strict=True) if found else ([], [], [])
            yield pa.RecordBatch.from_arrays([batch.column("key"), *(pa.array(list(x), k) for x, k in zip(columns, kinds, strict=True))], ["key", "n_words", "spans", "items"])

    return docs.select("key", "text").mapInArrow(run, schema), held


#: The union of sorted ranges `all`, as maximal ranges.
UNION = """aggregate(all, CAST(array() AS array<struct<s:long,e:long>>), (out, x) ->
    CASE WHEN size(out) > 0 AND element_at(out, -1).e >= x.s
         THEN concat(slice(out, 1, size(out) - 1), array(struct(element_at(out, -1).s AS s, greatest(element_at(out, -1).e, x.e) AS e)))
         ELSE concat(out, array(x)) END)"""


def _met(rows: DataFrame, blocks: list[DataFrame], window: int) -> DataFrame:
    """(key, n_words, spans, items) of the written rows (key, text) that any block hits, the hits of all blocks together. Keys are unique."""
    every = None
    for block in blocks:  # one automaton at a time
        found, held = _found(rows, block, window)
        found = materialize(found.where("size(spans) > 0"), "hits")
        held.destroy()
        every = found if every is None else every.union(found)
    merged = every.groupBy("key", "n_words").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("all"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return merged.select("key", "n_words", F.expr(UNION).alias("spans"), "items")


def hits(docs: DataFrame, items: DataFrame, *, window: int = 13, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per row of docs (key, n_words, spans, items): its words, hit word ranges [s, e) and the ids of items with occurring windows, sorted as strings.

    A null text has no words. Without items nothing is hit. Items of one text all count; a null id
    hits but is not listed; a repeated id is listed once. An empty table gives an empty result.
    Rows that share a key and a text give equal rows, texts that share a key their own each; other
    columns are not looked at. Texts and items may have any length: items go through in parts.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    blocks = item_blocks(items, item_key, item_text, window)
    if len(blocks) == 1:
        return _found(docs, blocks[0], window)[0].withColumnRenamed("key", key)
    # several blocks: the ranges of a row meet again under its id; rows that none hits have their words from an empty block
    rows = materialize(docs.select(F.monotonically_increasing_id().alias("row"), F.col("key").alias("own"), "text"), "rows")
    by_row = rows.select(F.col("row").alias("key"), "text")
    words = _found(by_row, blocks[0].limit(0), window)[0].select(F.col("key").alias("row"), "n_words")
    met = _met(by_row, blocks, window).select(F.col("key").alias("row"), "spans", "items")
    none = lambda c: F.coalesce(c, F.array().cast(met.schema[c].dataType)).alias(c)
    return rows.select("row", "own").join(words, "row").join(met, "row", "left").select(F.col("own").alias(key), "n_words", none("spans"), none("items"))


def report(docs: DataFrame, items: DataFrame, *, coverage: int = 20, **params) -> DataFrame:
    """hits() with n_hit, n_items, items_sha256 and contaminated: n_hit > 0 and coverage * n_hit >= n_words."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda t, x: t + x["e"] - x["s"])
    return (
        hits(docs, items, **params)
        .withColumn("n_hit", n_hit)
        .withColumn("n_items", F.size("items").cast("long"))
        .withColumn("items_sha256", F.sha2(F.array_join("items", ",").cast("binary"), 256))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (coverage * F.col("n_hit") >= F.col("n_words")))
    )


def decontaminate(docs: DataFrame, items: DataFrame, *, window: int = 13, coverage: int = 20, longest: int | None = None, action: str = "drop", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs, all columns, without its contamination.

    action "drop" removes contaminated rows (see report); "cut" keeps them and removes their hit
    spans from the text. With `longest`, a row with a hit span of that many words counts as
    contaminated too, whatever its coverage. Other rows stay as they are, null texts among them.
    Repeated rows are judged alike, rows that share a key each by its own text; spans that blocks
    of items cover jointly count as one. Without items, or for an empty table, nothing changes.
    """
    if action not in ("drop", "cut"):
        raise ValueError(f"action is drop or cut, not {action}")
    small_batches(docs.sparkSession)
    names, blocks = docs.columns, item_blocks(items, item_key, item_text, window)
    where = names.index(text)

    def bad(n: int, spans: list[tuple[int, int]]) -> bool:
        hit = sum(e - s for s, e in spans)
        return hit > 0 and (coverage * hit >= n or longest is not None and max(e - s for s, e in spans) >= longest)

    def cleaned(batch: pa.RecordBatch, judged: Iterator[tuple[int, list[tuple[int, int]]]]) -> pa.RecordBatch:
        """The batch without its contamination, given the words and hit ranges of each row."""
        keep, texts = [], None
        for i, (n, spans) in enumerate(judged):
            keep.append(not bad(n, spans) or action == "cut")
            if action == "cut" and bad(n, spans):
                texts = texts or batch.column(where).to_pylist()
                texts[i] = without(texts[i], spans)
        columns = list(batch.columns)[: len(names)]
        if texts:
            columns[where] = pa.array(texts, batch.column(where).type)
        return pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep, pa.bool_()))

    if len(blocks) == 1:
        held = docs.sparkSession.sparkContext.broadcast(automaton_of(blocks[0], window))

        def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield cleaned(batch, ((n, spans) for n, spans, _ in _scan(held.value, batch.column(where))))

        return docs.mapInArrow(stream, docs.schema)

    # several blocks: a row is judged once, by what all of them hit in it
    row = "row" + "_" * max(map(len, names))
    rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    met = _met(rows.select(F.col(row).alias("key"), F.col(text).alias("text")), blocks, window)
    marks = row + "marks"
    joined = rows.join(met.select(F.col("key").alias(row), F.struct("n_words", "spans").alias(marks)), row, "left").select(*names, marks)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(len(names)).to_pylist()
            yield cleaned(batch, ((x["n_words"], [(r["s"], r["e"]) for r in x["spans"]]) if x else (0, []) for x in found))

    return joined.mapInArrow(judge, docs.schema)


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the words of the given ranges and what stands between them."""
    places = [m.span() for m in WORD.finditer(text.translate(DOWN))]
    out, at = [], 0
    for s, e in spans:
        out.append(text[at : places[s][0]])
        at = places[e - 1][1]
    return "".join([*out, text[at:]])


def items_digest(ids: list[str]) -> str:
    """The digest that report() gives for item ids."""
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
