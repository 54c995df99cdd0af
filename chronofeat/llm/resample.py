"""Importance resampling towards a target distribution of hashed n-grams.

Separators collapse to single spaces; one overlapped regex scan a text, held to word boundaries by
a lookbehind, meets each word once, and its nested groups are the spans of the runs that begin
there. Their CRCs count into buckets. A bucket's gain is the log ratio of its smoothed shares in
target and corpus, a document's weight its mean gain, and Gumbel noise seeded by the key makes the
highest scores a weighted draw without replacement.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ALNUM, LOWER, materialize, small_batches

#: Every byte as it counts in a text: A-Z lower-cased, separators spaces.
FOLDED = bytes(int(LOWER[b]) if ALNUM[LOWER[b]] else 32 for b in range(256))
#: Features of a text that are held as Python numbers at a time.
HELD = 1 << 16


def spans(longest: int) -> regex.Pattern[bytes]:
    """At each word's start, in group k from the inside out (the last is the whole match), the run of up to k words."""
    inner = rb"[^ ]++"
    for _ in range(longest - 1):
        inner = rb"(" + inner + rb")(?: [^ ]++)?+"
    return regex.compile(rb"(?<![^ ])" + inner)


def buckets_of(text: bytes, pattern: regex.Pattern[bytes], buckets: int) -> tuple[int, np.ndarray]:
    """A text's number of words, and the bucket of each of its runs, repeats counted."""
    words, parts, held = 0, [], array("L")
    longer = range(pattern.groups - 1, -1, -1)  # group numbers from two words on; 0 is the whole match
    for m in pattern.finditer(b" ".join(text.translate(FOLDED).split()), overlapped=True):
        run = m[pattern.groups]
        held.append(crc32(run))
        words += 1
        for k in longer:
            more = m[k]
            if len(more) == len(run):  # no further word
                break
            held.append(crc32(more))
            run = more
        if len(held) >= HELD:
            parts.append((np.frombuffer(held, np.uint64) % buckets).astype(np.uint16))
            held = array("L")
    parts.append((np.frombuffer(held, np.uint64) % buckets).astype(np.uint16))
    return words, np.concatenate(parts)


def counted(rows: DataFrame, key: str, text: str, longest: int, buckets: int) -> DataFrame:
    """Per row (key, n_words, codes): codes holds the bucket of each feature as an unsigned 16-bit number."""
    small_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = spans(longest)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                found = [buckets_of((x.as_py() or "").encode(), pattern, buckets) for x in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array([n for n, _ in found], pa.int64()), pa.array([c.tobytes() for _, c in found], pa.binary())], ["key", "n_words", "codes"])

    schema = f"key {rows.schema[key].dataType.simpleString()}, n_words long, codes binary"
    return rows.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema)


def bucket_sums(codes: DataFrame, buckets: int) -> np.ndarray:
    """Features in each bucket over all rows. A task sends one row for each bucket, which are summed by bucket; the driver gets `buckets` numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            for x in batch.column(0):
                sums += np.bincount(np.frombuffer(x.as_buffer(), np.uint16), minlength=buckets)
        full = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array(sums[full], pa.int64())], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for bucket, n in codes.select("codes").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the ratio of target to corpus share per bucket, each bucket smoothed by one."""
    size, s_all, t_all = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(((t + 1) * (s_all + size)) / ((s + 1) * (t_all + size)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def noise(key: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)), u from the first 32 bits of a digest of seed and key; a null key is an empty one."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def weighted(docs: DataFrame, target: DataFrame, *, key: str, text: str, target_text: str, longest: int, buckets: int, seed: int) -> DataFrame:
    """Per row of docs (key, n_words, n_features, weight, score)."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets must be 1 to 65536")
    codes = materialize(counted(docs, key, text, longest, buckets), "buckets")
    table = gains(bucket_sums(codes, buckets), bucket_sums(counted(target, target_text, target_text, longest, buckets), buckets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.frombuffer(x.as_buffer(), np.uint16) for x in batch.column("codes")]
            means = [int(table[r].sum()) // len(r) if len(r) else 0 for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("n_words"), pa.array([len(r) for r in rows], pa.int64()), pa.array(means, pa.int64())], ["key", "n_words", "n_features", "weight"])

    schema = f"key {docs.schema[key].dataType.simpleString()}, n_words long, n_features long, weight long"
    return codes.mapInArrow(run, schema).withColumn("score", F.col("weight") + noise(F.col("key"), seed))


def draw(docs: DataFrame, target: DataFrame, *, key: str = "doc_id", text: str = "text", target_text: str = "text", longest: int = 2, buckets: int = 10_000, percent: int = 25, min_words: int = 20, seed: int = 7) -> DataFrame:
    """Per row of docs (key, n_features, weight, score, rank): rank counts the drawn rows from 1, and is null for the others.

    Features are the runs of 1 to `longest` words of the whole text, repeats counted. Of the N rows
    of at least `min_words` words the floor(percent * N / 100) of highest score are drawn, ties to
    the smaller key, nulls last. A null or empty text has no feature, weight 0 and is never drawn
    unless min_words is 0. Repeated rows get the same score and ranks of their own. An empty table
    gives an empty one; an empty target pushes away from what is common. Other columns of docs are
    not looked at. A text is never held as more than 65,536 Python numbers.

    Scores differ by at most some 85,000, as gains and noise are logarithms of 64-bit and 32-bit
    numbers, so the table of rows per score is small whatever the input. Noise spreads the rows of
    any weight so that one score holds under a two-thousandth of them: ranks are windows by score,
    over only those scores that are drawn.
    """
    found = weighted(docs, target, key=key, text=text, target_text=target_text, longest=longest, buckets=buckets, seed=seed)
    rows = materialize(found.withColumn("counts", F.col("n_words") >= min_words).drop("n_words"), "scores")
    per_score = rows.where("counts").groupBy("score").agg(F.count("*").alias("n"))
    above = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    per_score = per_score.select("score", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("before"), (F.sum("n").over(Window.partitionBy()) * percent / 100).alias("share"))
    reached = per_score.select("score", "before", F.floor("share").alias("most")).where("before < most")
    marked = rows.join(F.broadcast(reached), "score", "left")
    place = F.row_number().over(Window.partitionBy("score").orderBy(F.asc_nulls_last("key"))) + F.col("before")
    in_reach = F.col("counts") & F.col("before").isNotNull()
    inside = marked.where(in_reach).withColumn("rank", F.when(place <= F.col("most"), place))
    outside = marked.where(~in_reach).withColumn("rank", F.lit(None).cast("long"))
    return inside.unionByName(outside).select(F.col("key").alias(key), "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"))


def resample(docs: DataFrame, target: DataFrame, *, key: str = "doc_id", **settings: object) -> DataFrame:
    """The drawn rows of docs, with all their columns; keys must be unique. See draw()."""
    drawn = draw(docs, target, key=key, **settings).where("rank IS NOT NULL").select(key)
    return docs.join(drawn, key, "left_semi")
