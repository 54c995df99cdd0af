"""A Bloom filter of a bounded size, to keep rows that surely have no match out of a shuffle.

It only saves work: what passes goes on to an exact join. Past MOST_BITS it fills up and lets
more rows pass, which costs a larger shuffle and changes no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64

#: Bits for each value, about; bits at most, which bounds the broadcast to 16 MB.
BITS_EACH, MOST_BITS = 16, 1 << 27
_SALTS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def places(values: np.ndarray, bits: int) -> list[np.ndarray]:
    """The bits of each value of an int64 array."""
    return [(mix64(values.view(np.uint64) ^ np.uint64(s)) & np.uint64(bits - 1)).astype(np.int64) for s in _SALTS]


def holds(words: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether each value may be in the filter; no value that is in it is missed."""
    found = np.ones(len(values), bool)
    for at in places(np.ascontiguousarray(values, np.int64), len(words) * 64):
        found &= (words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
    return found


def build(df: DataFrame, column: str) -> Broadcast:
    """The filter of a long column's values, set bits gathered by an aggregation and broadcast; destroy() it when its readers are written."""
    df = df.select(F.col(column).cast("long").alias("value")).where("value is not null").distinct()
    bits, count = 1 << 10, df.agg(F.approx_count_distinct("value")).first()[0]
    while bits < MOST_BITS and bits < BITS_EACH * count:
        bits *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(np.concatenate(places(np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False), np.int64), bits)))
            head = np.flatnonzero(np.append(True, at[1:] >> 6 != at[:-1] >> 6)) if len(at) else at
            words = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), head) if len(at) else at.astype(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(at[head] >> 6), pa.array(words.view(np.int64))], ["at", "word"])

    set_bits = df.mapInArrow(run, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word"))
    words = np.zeros(bits // 64, np.uint64)
    found = set_bits.toArrow()  # MOST_BITS / 64 rows at most, 32 MB
    words[found.column("at").to_numpy()] = found.column("word").to_numpy().view(np.uint64)
    return df.sparkSession.sparkContext.broadcast(words)


def split(df: DataFrame, column: str, held: Broadcast) -> tuple[DataFrame, DataFrame]:
    """(rows whose long column may be in the filter, rows where it surely isn't); null surely isn't."""
    where = df.columns.index(column)

    def part(wanted: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                values = pc.cast(batch.column(where), pa.int64())
                may = holds(held.value, values.fill_null(0).to_numpy()) & ~np.asarray(values.is_null())
                yield batch.filter(pa.array(may if wanted else ~may))

        return run

    return df.mapInArrow(part(True), df.schema), df.mapInArrow(part(False), df.schema)
