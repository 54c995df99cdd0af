"""Removal of byte strings that occur earlier, with suffix arrays sorted in two stages.

A byte is removed if a string of `length` bytes that covers it also starts earlier: in a document
of a smaller key, or earlier in the same one. The corpus is never one text in one place:

1. Every window of `length` bytes has an *anchor*, the gram of ANCHOR bytes with the smallest hash
   in it. Windows that follow each other and share their anchor make one *slice*. Equal windows
   have equal anchors, so windows need comparing only among slices of equal anchors. A slice
   crosses the network as two hashes and its place. A task remembers what it has sent on, so that
   a passage of very many documents makes a few rows a task.
2. Slices are sorted by anchor and content hash. All but the first of equal slices are repeated
   wholly. Only the first ones of anchors with several different slices go on, with their bytes.
3. Bounded blocks of whole anchor groups get a suffix array: suffixes smaller than their successors
   are sorted directly, the others induced by bucket scans; adjacent common prefixes of `length`
   show equal windows, of which all but the first are repeated.
4. An anchor with more than HOT different slices would be too much for one task: its slices are
   split into their windows, which meet by the hash of their bytes. Suffix arrays of the windows
   of one task's batches thin them before the shuffle, and step 3 does the rest: of windows of one
   hash only those not yet known to be repeated are kept from one block to the next.

Slice contents are compared by 64-bit hashes in step 2, by their bytes in steps 3 and 4.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PIECE_BYTES, materialize, mix64, pieces, powers, prefix_hash, span_hash, text_buffer

#: Bytes of an anchor; of a part of a long text that is looked at on its own; of a block; different slices of an anchor above which they are split into windows; slots for contents that a task has sent on (24 bytes each).
ANCHOR, PART, BLOCK, HOT, SLOTS = 24, 1 << 22, 1 << 19, 20_000, 1 << 19
LAST = np.iinfo(np.int64).max


# ---------------------------------------------------------------- anchors


def slices_of(data: np.ndarray, low: np.ndarray, high: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """The slices of rows data[low:high): row, first window start in data, windows, anchor hash, content hash."""
    n, width = len(data), length - ANCHOR + 1
    sums = prefix_hash(data)
    _, down = powers(n + 1)
    grams = mix64((sums[ANCHOR:] - sums[: n - ANCHOR + 1]) * down[: n - ANCHOR + 1])
    # the smallest hash of a window, its place in the low bits: the leftmost of equal ones
    least, span = (grams & ~np.uint64((1 << 24) - 1)) | np.arange(len(grams), dtype=np.uint64), 1
    while 2 * span <= width:
        least = np.minimum(least[: len(least) - span], least[span:])
        span *= 2
    windows = n - length + 1
    least = np.minimum(least[:windows], least[width - span : width - span + windows])
    anchor = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
    counts = np.maximum(high - low - length + 1, 0)
    row = np.repeat(np.arange(len(low)), counts)
    start = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + low[row]
    at = anchor[start]
    first = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (row[1:] != row[:-1])))) if len(at) else np.zeros(0, np.int64)
    many = np.diff(np.append(first, len(at)))
    begin = start[first]
    return row[first], begin, many, grams[at[first]].view(np.int64), span_hash(sums, begin, begin + many - 1 + length).view(np.int64)


class Seen:
    """First places (doc, start) of contents that a task has sent on, in slots by their hash; a newer content takes a slot."""

    def __init__(self):
        self.content, self.doc, self.start = (np.zeros(SLOTS, np.int64) for _ in range(3))

    def sort_out(self, content: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether a row is to be sent on, whether it repeats one that was): an earlier place of a content is sent on too, the same place is not."""
        slot = content & (SLOTS - 1)
        known = (self.content[slot] == content) & (content != 0)
        before = known & ((self.doc[slot] < doc) | (self.doc[slot] == doc) & (self.start[slot] < start))
        same = known & (self.doc[slot] == doc) & (self.start[slot] == start)
        new = ~before & ~same
        self.content[slot[new]], self.doc[slot[new]], self.start[slot[new]] = content[new], doc[new], start[new]
        return new, before


def _anchors(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for batch in batches:
            key = batch.column("doc").to_numpy()
            data, offsets = text_buffer(batch.column("text"))
            for a, b in pieces(offsets):
                if offsets[b] - offsets[a] > 2 * PART and b == a + 1:  # a long text: parts that overlap by a window less one byte
                    for s in range(int(offsets[a]), int(offsets[b]) - length + 1, PART):
                        e = min(s + PART + length - 1, int(offsets[b]))
                        yield from _rows(data[s:e], np.array([0]), np.array([e - s]), key[a:b], np.array([s - offsets[a]]), length, seen)
                else:
                    s = offsets[a]
                    low = offsets[a:b] - s
                    yield from _rows(data[s : offsets[b]], low, offsets[a + 1 : b + 1] - s, key[a:b], -low, length, seen)

    return run


def _rows(data: np.ndarray, low: np.ndarray, high: np.ndarray, key: np.ndarray, shift: np.ndarray, length: int, seen: Seen) -> Iterator[pa.RecordBatch]:
    """(anchor, content, doc, place) of each slice; place is 128 * start + windows. What repeats a slice of this piece, or one that the task has sent on, is only told as (spread, end, doc, 128 * start)."""
    if len(data) < length:
        return
    row, begin, many, anchor, content = slices_of(data, low, high, length)
    doc, start = key[row], begin + shift[row]
    order = np.lexsort((start, doc, content))
    same = np.concatenate(([False], (content[order][1:] == content[order][:-1]))) if len(order) else np.zeros(0, bool)
    again = np.concatenate(([False], (doc[order][1:] == doc[order][:-1]) & (start[order][1:] == start[order][:-1]))) & same if len(order) else same
    kept = order[~same]
    sent, before = seen.sort_out(content[kept], doc[kept], start[kept])
    rest = np.sort(np.concatenate([order[same & ~again], kept[before]]))  # in text order
    kept = kept[sent]
    columns = [anchor[kept], content[kept], doc[kept], start[kept] * 128 + many[kept]]
    if len(rest):
        s, e, d = start[rest], start[rest] + many[rest] - 1 + length, row[rest]
        new = np.concatenate(([True], (d[1:] != d[:-1]) | (s[1:] > e[:-1])))
        head = np.flatnonzero(new)
        s, e, d = s[head], e[np.append(head[1:], len(e)) - 1], key[d[head]]
        spread = mix64((d * 131 + s).astype(np.uint64)).view(np.int64)
        columns = [np.concatenate(x) for x in zip(columns, (spread, e, d, s * 128), strict=True)]
    yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in columns], ["anchor", "content", "doc", "place"])


def _first_ones(length: int):
    """Of rows sorted by (anchor, content, doc, place): repeated spans (anchor 0, doc, start, stop, found), and first slices of anchors with several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the row before: anchor, content, doc, place
        waits = None  # the first slice before, and whether it is already known to have company
        for batch in batches:
            if not batch.num_rows:
                continue
            anchor, content, doc, place = (c.to_numpy() for c in batch.columns)
            previous = [np.concatenate(([x[0] if last is None else y], x[:-1])) for x, y in zip((anchor, content, doc, place), last or (0,) * 4, strict=True)]
            told = place % 128 == 0
            equal = (anchor == previous[0]) & (content == previous[1])
            row_again = equal & (doc == previous[2]) & (place == previous[3])
            if last is None:
                equal[0] = row_again[0] = False
            repeated = (equal & ~row_again) | told
            firsts = np.flatnonzero(~equal & ~told)
            last = (anchor[-1], content[-1], doc[-1], place[-1])
            out = [np.zeros(repeated.sum(), np.int64), doc[repeated], place[repeated] // 128, np.where(told, content, place // 128 + place % 128 - 1 + length)[repeated]]
            # a first slice has company if the first slice before or after it has its anchor
            f = [anchor[firsts], doc[firsts], place[firsts]]
            if waits is not None:
                f = [np.concatenate(([w], x)) for w, x in zip(waits[0], f, strict=True)]
            company = np.zeros(len(f[0]), bool)
            if len(f[0]):
                pair = f[0][1:] == f[0][:-1]
                company[1:] |= pair
                company[:-1] |= pair
                company[0] |= waits is not None and waits[1]
                waits = ([x[-1] for x in f], bool(company[-1]))
                company[-1] = False
                f = [x[company] for x in f]
                out = [np.concatenate(x) for x in zip(out, (f[0], f[1], f[2] // 128, f[2] // 128 + f[2] % 128 - 1 + length), strict=True)]
            found = np.concatenate((np.ones(int(repeated.sum()), bool), np.zeros(len(out[0]) - int(repeated.sum()), bool)))
            yield _spans(*out, found)
        if waits is not None and waits[1]:
            a, d, p = ([x] for x in waits[0])
            yield _spans(a, d, [p[0] // 128], [p[0] // 128 + p[0] % 128 - 1 + length], [False])

    return run


def _spans(anchor, doc, start, stop, found) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(pa.array(np.asarray(x, np.int64)) for x in (anchor, doc, start, stop)), pa.array(np.asarray(found, bool))], ["anchor", "doc", "start", "stop", "found"])


# ---------------------------------------------------------------- suffix arrays


def suffix_order(data: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of data in the order of their first `depth` bytes or more; the end is smaller than any byte.

    Two stages: suffixes smaller than their successor are sorted directly; the rest are induced
    by scanning the buckets of first bytes in order, each entry placing its predecessor.
    """
    n = len(data)
    if n < 2:
        return np.arange(n)
    step = np.append(data[:-1] != data[1:], True)
    change = np.minimum.accumulate(np.where(step, np.arange(n), n)[::-1])[::-1]  # the next place whose successor differs
    small = np.append(data[:-1] < data[1:], False)[change]
    places = np.flatnonzero(small)
    padded = np.concatenate((data, np.zeros(depth, np.uint8)))
    keys = np.lib.stride_tricks.sliding_window_view(padded, depth)[places]
    places = places[np.argsort(np.ascontiguousarray(keys).view(f"S{depth}").ravel(), kind="stable")]
    cuts = np.searchsorted(data[places], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    out: list[np.ndarray] = []

    def place(entries: np.ndarray) -> None:
        before = entries[entries > 0] - 1
        before = before[~small[before]]
        if len(before):
            first = data[before]
            before = before[np.argsort(first, kind="stable")]
            first = data[before]
            heads = np.flatnonzero(np.append(True, first[1:] != first[:-1]))
            for c, part in zip(first[heads].tolist(), np.split(before, heads[1:]), strict=True):
                induced[c].append(part)

    induced[data[n - 1]].append(np.array([n - 1]))
    for c in range(256):
        k = 0
        while k < len(induced[c]):  # entries may place others of this same bucket, behind them
            new = induced[c][k:]
            k = len(induced[c])
            entries = np.concatenate(new)
            out.append(entries)
            place(entries)
        entries = places[cuts[c] : cuts[c + 1]]
        out.append(entries)
        place(entries)
    return np.concatenate(out)


def repeated_windows(texts: list[bytes], doc: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(doc, window start) of each window of the texts, that begin at (doc, start), with an equal window at a smaller place."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts])
    begin = np.cumsum(sizes) - sizes
    counts = np.maximum(sizes - length + 1, 0)
    text = np.full(len(data), -1)
    which = np.repeat(np.arange(len(texts)), counts)
    text[np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts) + begin[which]] = which
    order = suffix_order(data, length)
    order = order[text[order] >= 0]
    if len(order) < 2:
        return doc[:0], start[:0]
    windows = np.lib.stride_tricks.sliding_window_view(data, length)
    equal = np.concatenate([[False], *((windows[order[i : i + 65_536]] == windows[order[i - 1 : i - 1 + len(order[i : i + 65_536])]]).all(axis=1) for i in range(1, len(order), 65_536))])
    group = np.cumsum(~equal)
    d, s = doc[text[order]], start[text[order]] + order - begin[text[order]]
    by = np.lexsort((s, d, group))
    group, d, s = group[by], d[by], s[by]
    head = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    first = np.repeat(head, np.diff(np.append(head, len(group))))
    later = (d != d[first]) | (s != s[first])  # a repeated row has the first place more than once
    return d[later], s[later]


def _blocks(length: int, windows: bool = False):
    """Repeated spans of slices sorted by anchor, whole anchor groups together; of slices of one window each, groups may fill several blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []
        size, open_anchor, opened = 0, None, 0  # opened: where the open anchor's slices begin
        for batch in batches:
            for anchor, doc, start, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size > BLOCK and (windows or anchor != open_anchor):
                    d, s = _repeated(held, length)
                    yield _block(d, s, length)
                    again = set(zip(d.tolist(), s.tolist(), strict=True)) if anchor == open_anchor else ()
                    held = [x for x in held[opened:] if x[:2] not in again] if anchor == open_anchor else []
                    size, opened = sum(len(x[2]) for x in held), 0
                if anchor != open_anchor:
                    open_anchor, opened = anchor, len(held)
                held.append((doc, start, text))
                size += len(text)
        if held:
            yield _block(*_repeated(held, length), length)

    return run


def _windows(length: int):
    """The windows of slices, as (anchor, doc, start, stop, slice): those that a block shows to be repeated as spans without bytes, the others keyed by the hash of their bytes."""

    def rows(held: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        doc, start = (np.array([x[k] for x in held], np.int64) for k in (0, 1))
        data = np.frombuffer(b"".join(x[2] for x in held), np.uint8)
        sizes = np.array([len(x[2]) for x in held])
        many, begin = sizes - length + 1, np.cumsum(sizes) - sizes
        row = np.repeat(np.arange(len(held)), many)
        inner = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        d, s, at = doc[row], start[row] + inner, begin[row] + inner
        gone_doc, gone_start = _repeated(held, length)
        gone = set(zip(gone_doc.tolist(), gone_start.tolist(), strict=True))
        left = np.array([x not in gone for x in zip(d.tolist(), s.tolist(), strict=True)], bool)
        spans = _block(gone_doc, gone_start, length)
        n, key = len(spans), span_hash(prefix_hash(data), at[left], at[left] + length).view(np.int64)
        columns = [np.zeros(n, np.int64), *(spans.column(k).to_numpy() for k in range(3))], [key, d[left], s[left], s[left] + length]
        text = [None] * n + [data[i : i + length].tobytes() for i in at[left].tolist()]
        return pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(x)) for x in zip(*columns, strict=True)), pa.array(text, pa.binary())], ["anchor", "doc", "start", "stop", "slice"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []
        size = 0
        for batch in batches:
            for x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(x)
                size += len(x[2])
                if size > BLOCK:
                    yield rows(held)
                    held, size = [], 0
        if held:
            yield rows(held)

    return run


def _repeated(held: list[tuple[int, int, bytes]], length: int) -> tuple[np.ndarray, np.ndarray]:
    doc, start = (np.array([x[k] for x in held], np.int64) for k in (0, 1))
    return repeated_windows([x[2] for x in held], doc, start, length)


def _block(d: np.ndarray, s: np.ndarray, length: int) -> pa.RecordBatch:
    """The windows (d, s) joined to spans."""
    order = np.lexsort((s, d))
    d, s = d[order], s[order]
    if len(d):
        head = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (s[1:] > s[:-1] + length)))
        d, e, s = d[head], s[np.append(head[1:], len(s)) - 1] + length, s[head]
    else:
        e = s
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (d, s, e)], ["doc", "start", "stop"])


# ---------------------------------------------------------------- the operator


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, doc, start, slice) of the slices of each document."""
    for batch in batches:
        for doc, text, wanted in zip(batch.column("doc").to_pylist(), batch.column("text"), batch.column("wanted").to_pylist(), strict=True):
            data = text.as_py() or b""
            wanted = [(w["anchor"], w["start"], part) for w in wanted if len(part := data[w["start"] : w["stop"]]) == w["stop"] - w["start"]]
            if wanted:
                anchors, starts, parts = zip(*wanted, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(anchors, pa.int64()), pa.array([doc] * len(parts), pa.int64()), pa.array(starts, pa.int64()), pa.array(parts, pa.binary())], ["anchor", "doc", "start", "slice"])


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document without its spans, which may overlap."""
    for batch in batches:
        spans_out, kept_out = [], []
        for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
            data, merged = text.as_py() or b"", []
            for x in sorted((x["start"], min(x["stop"], len(data))) for x in spans.as_py() or []):
                if x[0] >= x[1]:
                    continue
                if merged and merged[-1][1] >= x[0]:
                    merged[-1][1] = max(merged[-1][1], x[1])
                else:
                    merged.append(list(x))
            at, kept = 0, []
            for s, e in merged:
                kept.append(data[at:s])
                at = e
            spans_out.append([{"start": s, "stop": e} for s, e in merged])
            kept_out.append(b"".join([*kept, data[at:]]))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(spans_out, kind), pa.array(kept_out, pa.binary())], ["key", "spans", "kept"])


def remove_repeats(docs: DataFrame, *, length: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs (key, spans, kept): maximal removed byte runs [start, stop) and the remaining UTF-8 bytes joined (binary).

    Strings are judged on the input, and never cross documents. A null text is empty. Repeated
    rows, of one key and text, are one document and get its result each. Keys are whole numbers, or
    cast to them (an error where that fails); a null key is the last;
    texts that share a key take the spans of one another. Texts shorter than `length` stay whole;
    long ones go through in parts, and only their removal holds one whole. A passage that many
    documents share leaves a task as a few rows, not one for each document.
    An empty table gives an empty result. Other columns are not looked at.
    """
    if not ANCHOR < length < ANCHOR + 127:
        raise ValueError(f"length must lie between {ANCHOR} and {ANCHOR + 127}")
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("doc"), F.col(key).alias("key"), F.col(text).cast("binary").alias("text"))
    anchors = rows.select("doc", "text").mapInArrow(_anchors(length), "anchor long, content long, doc long, place long")
    spans = anchors.repartition("anchor").sortWithinPartitions("anchor", "content", "doc", "place").mapInArrow(_first_ones(length), "anchor long, doc long, start long, stop long, found boolean")
    spans = materialize(spans, "spans")
    found, open_ones = spans.where("found").select("doc", "start", "stop"), spans.where("not found").drop("found")
    by_doc = open_ones.groupBy("doc").agg(F.collect_list(F.struct("anchor", "start", "stop")).alias("wanted"))
    slices = rows.join(by_doc, "doc").select("doc", "text", "wanted").mapInArrow(_cut, "anchor long, doc long, start long, slice binary")
    slices = materialize(slices, "slices")  # read for the hot anchors and for the others; the texts are shuffled for it once
    different = slices.select("anchor", "doc", "start").distinct()  # repeated rows of a document are one
    hot = materialize(different.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("anchor"), "hot")
    if not hot.isEmpty():
        own = slices.join(hot, "anchor").select("doc", "start", "slice").mapInArrow(_windows(length), "anchor long, doc long, start long, stop long, slice binary")
        own = materialize(own, "windows")
        apart = own.where("slice IS NOT NULL").select("anchor", "doc", "start", "slice").repartition("anchor").sortWithinPartitions("anchor")
        found = found.union(own.where("slice IS NULL").select("doc", "start", "stop")).union(apart.mapInArrow(_blocks(length, windows=True), "doc long, start long, stop long"))
        slices = slices.join(hot, "anchor", "left_anti")
    found = found.union(slices.select("anchor", "doc", "start", "slice").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_blocks(length), "doc long, start long, stop long"))
    merged = found.groupBy("doc").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    schema = f"key {docs.schema[key].dataType.simpleString()}, spans array<struct<start:long,stop:long>>, kept binary"
    return rows.join(merged, "doc", "left").select("key", "text", "spans").mapInArrow(_remove, schema).withColumnRenamed("key", key)
