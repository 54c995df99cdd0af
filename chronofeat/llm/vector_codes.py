"""Codes of vectors: nearest entries of one codebook a part, trained by rounds over Hilbert-sorted blocks.

Components become integers. A chunk of some thousand vectors is one row; in it each part is sorted
along a Hilbert curve and cut into flat blocks, of which the row keeps the smallest and largest
component (a box) and the sums. In a round the distances between boxes and entries leave each block
a shortlist of entries that can be nearest to a point of it. A block with one is added by its sums,
the points of the others are measured against their shortlists in exact integer kernels. Tasks send
their sums for each part and entry; the driver holds the codebooks alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches

#: Bytes of a chunk's components as 64-bit integers; points of a block; bits a dimension of the curve.
CHUNK_BYTES, BLOCK, BITS = 8 << 20, 64, 6
#: Components are held to this, so that squared distances stay exact in 64 bits.
MOST = 1 << 27
#: Numbers that a kernel holds at a time.
ROOM = 1 << 20
CHUNK = "ids array<{id}>, labels array<{label}>, points array<binary>, orders array<binary>, boxes array<binary>, sums array<binary>, kind string"


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Order of points (n, d) along a Hilbert curve over 2**bits cells a dimension of their own box.

    Coordinates are turned in place into the curve's transposed index (Skilling's method), whose
    bits, dimension after dimension from the highest on, are compared as byte strings.
    """
    low = points.min(axis=0)
    width = np.maximum(points.max(axis=0) - low, 1)
    x = ((points - low) * ((1 << bits) - 1) // width).T.astype(np.int64)
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(d):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] = np.where(flip, x[0] ^ (q - 1), x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t = np.where(x[d - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    planes = (x[None, :, :] >> np.arange(bits - 1, -1, -1)[:, None, None]) & 1
    packed = np.packbits(planes.reshape(bits * d, -1).astype(np.uint8), axis=0)
    return np.lexsort(packed[::-1])


def smallest_kind(values: np.ndarray) -> np.ndarray:
    """The values in the narrowest of three integer types."""
    most = int(np.abs(values).max(initial=0))
    return values.astype(np.int16 if most < 1 << 15 else np.int32)


class Part:
    """One part of a chunk: its points in blocks (b, BLOCK, d), how many of each are real, boxes and sums."""

    def __init__(self, points: np.ndarray, boxes: np.ndarray, sums: np.ndarray):
        self.n, self.boxes, self.sums = len(points), boxes, sums
        self.points = points

    @staticmethod
    def cut(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Boxes (b, 2, d) and sums (b, d) of sorted points."""
        starts = np.arange(0, len(points), BLOCK)
        boxes = np.stack([np.minimum.reduceat(points, starts, axis=0), np.maximum.reduceat(points, starts, axis=0)], axis=1)
        return boxes, np.add.reduceat(points, starts, axis=0)

    def shortlists(self, entries: np.ndarray) -> np.ndarray:
        """Per block and entry whether it can be nearest to a point of the block, ties included."""
        out = np.empty((len(self.boxes), len(entries)), bool)
        step = max(1, ROOM // max(1, entries.size))
        for a in range(0, len(self.boxes), step):
            low, high = (self.boxes[a : a + step, k, None, :].astype(np.int64) for k in (0, 1))
            under, over = low - entries, entries - high
            nearest = (np.maximum(np.maximum(under, over), 0) ** 2).sum(axis=2)
            farthest = (np.maximum(np.abs(entries - low), np.abs(high - entries)) ** 2).sum(axis=2)
            out[a : a + step] = nearest <= farthest.min(axis=1, keepdims=True)
        return out

    def assign(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(entry of each block or -1 where points differ, rows of points of such blocks, their entries)."""
        short = self.shortlists(entries)
        size = short.sum(axis=1)
        alone = np.where(size == 1, short.argmax(axis=1), -1)
        rows, found = [], []
        for s in np.unique(size[size > 1]).tolist():  # blocks with shortlists of one length go together
            step = max(1, ROOM // (BLOCK * max(entries.shape[1], s)))
            blocks = np.flatnonzero(size == s)
            for a in range(0, len(blocks), step):
                some = blocks[a : a + step]
                own = np.nonzero(short[some])[1].reshape(-1, s)  # ascending, so that ties go to the lower index
                at = some[:, None] * BLOCK + np.arange(BLOCK)
                real = at < self.n
                points = self.points[np.minimum(at, self.n - 1)].astype(np.int64)
                choice = nearest_of(points, entries[own])
                rows.append(at[real])
                found.append(np.take_along_axis(own, choice, axis=1)[real])
        empty = np.zeros(0, np.int64)
        return alone, np.concatenate([empty, *rows]), np.concatenate([empty, *found])

    def totals(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count and sums of the points of each entry."""
        k, d = entries.shape
        count, sums = np.zeros(k, np.int64), np.zeros((k, d), np.int64)
        alone, rows, found = self.assign(entries)
        members = np.minimum(BLOCK, self.n - np.arange(len(self.boxes)) * BLOCK)
        for e in range(k):
            whole, own = alone == e, rows[found == e]
            count[e] = members[whole].sum() + len(own)
            sums[e] = self.sums[whole].sum(axis=0) + self.points[own].sum(axis=0, dtype=np.int64)
        return count, sums

    def codes(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry and squared distance of each point, in the sorted order."""
        alone, rows, found = self.assign(entries)
        code = np.repeat(alone, BLOCK)[: self.n]
        code[rows] = found
        error = np.empty(self.n, np.int64)
        step = max(1, ROOM // entries.shape[1])
        for a in range(0, self.n, step):
            error[a : a + step] = ((self.points[a : a + step].astype(np.int64) - entries[code[a : a + step]]) ** 2).sum(axis=1)
        return code, error


def nearest_of(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """For each block the first nearest of its entries (b, s, d) to each of its points (b, p, d).

    Compared is |e|^2 - 2 p.e. Where all of it fits the 53 bits of a double, products run as
    doubles and are exact; else as 64-bit integers.
    """
    most = max(int(np.abs(points).max(initial=0)), int(np.abs(entries).max(initial=0)))
    kind = np.float64 if 4 * points.shape[2] * most * most < 1 << 52 else np.int64
    p, e = points.astype(kind), entries.astype(kind)
    return ((e * e).sum(axis=2)[:, None, :] - 2 * (p @ e.transpose(0, 2, 1))).argmin(axis=2)


def integers(column: pa.Array, width: int) -> np.ndarray:
    """floor(4096 x) of the vectors of an Arrow list column, each filled up with zeros to `width`."""
    lengths = np.asarray(column.value_lengths())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(column), width))
    out[np.arange(width) < lengths[:, None]] = flat
    return np.clip(np.floor(out * 4096), -MOST, MOST).astype(np.int64)


def chunks(rows: DataFrame, width: int, parts: int) -> DataFrame:
    """rows (id, vector, label) as chunks; parts of each in an order of their own, no shuffle."""
    limit, d = max(1, CHUNK_BYTES // (8 * max(1, width))), width // parts
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("id", "label")}

    def chunk(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(batches).combine_chunks()
        held = integers(whole.column("vector").chunk(0), width)
        points, orders, boxes, sums = [], [], [], []
        for p in range(parts):
            own = held[:, p * d : p * d + d]
            order = hilbert_keys(own) if d else np.arange(len(own))
            box, total = Part.cut(own[order])
            for out, x in ((points, smallest_kind(held)[order, p * d : p * d + d]), (orders, order.astype(np.int32)), (boxes, box.astype(np.int32)), (sums, total)):
                out.append(np.ascontiguousarray(x).tobytes())
        n = pa.array([0, len(held)], pa.int32())
        lists = [pa.ListArray.from_arrays(n, whole.column(c).chunk(0)) for c in ("id", "label")]
        blobs = [pa.array([x], pa.list_(pa.binary())) for x in (points, orders, boxes, sums)]
        return pa.RecordBatch.from_arrays([*lists, *blobs, pa.array([smallest_kind(held).dtype.name])], ["ids", "labels", "points", "orders", "boxes", "sums", "kind"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                take = min(limit - n, batch.num_rows - at)
                held.append(batch.slice(at, take))
                n, at = n + take, at + take
                if n == limit:
                    yield chunk(held)
                    held, n = [], 0
        if n:
            yield chunk(held)

    return rows.mapInArrow(run, CHUNK.format(**kinds))


def parts_of(batch: pa.RecordBatch, row: int, parts: int, d: int) -> Iterator[tuple[int, Part, np.ndarray]]:
    """(part, its blocks, its order) of a chunk."""
    kind = np.dtype(batch.column("kind")[row].as_py())
    columns = [batch.column(c)[row] for c in ("points", "orders", "boxes", "sums")]
    for p in range(parts):
        points, order, boxes, sums = (np.frombuffer(c.values[p].as_buffer(), t) for c, t in zip(columns, (kind, np.int32, np.int32, np.int64), strict=True))
        n = len(order)
        blocks = -(-n // BLOCK)
        yield p, Part(points.reshape(n, d), boxes.reshape(blocks, 2, d), sums.reshape(blocks, d)), order


def next_codebooks(table: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round; an entry without points stays."""
    parts, (k, d) = len(books), books[0].shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums = np.zeros((parts, k), np.int64), np.zeros((parts, k, d), np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                for p, part, _ in parts_of(batch, row, parts, d):
                    n, total = part.totals(books[p])
                    count[p] += n
                    sums[p] += total
        p, e = np.nonzero(count)
        columns = [p, e, count[p, e]]
        yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in columns), pa.array(list(sums[p, e]), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    task = table.mapInArrow(run, "part long, entry long, n long, sums array<long>")
    counts = task.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(d)))
    out = [b.copy() for b in books]
    for r in counts.collect():  # a row for each part and entry
        out[r["part"]][r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(d)]
    return out


def train(table: DataFrame, books: list[np.ndarray], rounds: int) -> list[np.ndarray]:
    """The codebooks after some rounds over a table of chunks."""
    for _ in range(rounds):
        books = next_codebooks(table, books)
    return books


def encode(table: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """Per vector of a table of chunks (id, label, code, error)."""
    parts, d = len(books), books[0].shape[1]
    kinds = {f.name: f.dataType.elementType.simpleString() for f in table.schema.fields if f.name in ("ids", "labels")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, labels = (batch.column(c)[row].values for c in ("ids", "labels"))
                code, error = np.zeros((len(ids), parts), np.uint8), np.zeros(len(ids), np.int64)
                for p, part, order in parts_of(batch, row, parts, d):
                    code[order, p], own = part.codes(books[p])
                    error[order] += own
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array([x.tobytes().hex() for x in code]), pa.array(error)], ["id", "label", "code", "error"])

    return table.mapInArrow(run, f"id {kinds['ids']}, label {kinds['labels']}, code string, error long")


def kept_vectors(vectors: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """Rows (id, vector, label) whose vector is whole."""
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("vector"), F.col(label).alias("label"))
    whole = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(F.col("vector").isNotNull() & whole)


def first_codebooks(rows: DataFrame, width: int, parts: int, entries: int) -> list[np.ndarray]:
    """The parts of the rows of smallest id (equal ids by their vectors, null ids last)."""
    first = rows.orderBy(F.asc_nulls_last("id"), "vector").limit(entries).select("vector").collect()
    held = integers(pa.array([r[0] for r in first], pa.list_(pa.float64())), width)
    return [np.ascontiguousarray(x) for x in np.split(held, parts, axis=1)]


def compress(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6) -> DataFrame:
    """Per kept row of vectors (key, code, error, label_error, codebooks_sha256).

    Rows whose vector is null or holds a null or non-finite component are dropped. Vectors are
    filled up with zeros to the length of the longest, rounded up to a multiple of `parts`; an empty
    vector so is one of zeros. A component x is floor(4096 x), held to 2**27 on either side. Codes
    and errors don't depend on how rows are dealt to chunks: nearest entries, sums and floored means
    are exact, ties go to the lower index. With fewer rows than entries the codebooks are as short.
    Repeated rows count as often as they are there; null keys come last among the first entries and
    stay in the result; null labels are one label. An empty table gives an empty one. Other columns
    are not looked at. A chunk holds a megabyte of components or so, one vector at least.

    The sums by label are few rows a label, joined back by label, where Spark can split a hot one.
    """
    if not 0 < entries <= 256:
        raise ValueError("entries must be 1 to 256")
    small_batches(vectors.sparkSession)
    rows = kept_vectors(vectors, key, vector, label)
    longest = rows.agg(F.coalesce(F.max(F.size("vector")), F.lit(0))).first()[0]
    width = -(-max(longest, 1) // parts) * parts
    books = first_codebooks(rows, width, parts, entries)
    table = materialize(chunks(rows, width, parts), "chunks")
    if len(books[0]):
        books = train(table, books, rounds)
    found = materialize(encode(table, books), "codes")
    text = ",".join(str(x) for b in books for x in b.ravel().tolist())
    by_label = found.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    joined = found.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    return joined.select(F.col("id").alias(key), "code", "error", "label_error", F.lit(hashlib.sha256(text.encode()).hexdigest()).alias("codebooks_sha256"))
