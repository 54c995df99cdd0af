"""Language identification by compression: one zstandard raw-content dictionary per language.

A text compresses best with the dictionary of its own language. Texts and dictionaries are lower
case, with one space for all that stands between letters, so that layout says nothing. A text goes to the language that
leaves the fewest bytes; how far the runner-up lies behind is the score, and a narrow margin, or
a text without a letter, is a rejection.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Labelled texts of a language that a dictionary is made of, about; characters of one text's part, from a hashed place on, bytes of a dictionary; languages at most.
SAMPLE_TEXTS, PART_CHARS, DICTIONARY_BYTES, MAX_LANGUAGES = 120, 2048, 112_640, 1000
#: Compression level.
LEVEL = 6
#: Compressed bytes of which a margin is a share, at most: what a dictionary saves does not grow with a long text.
FULL = 1024
LETTER, OTHER = regex.compile(r"\p{L}"), re.compile(r"[\W\d_]+")
UNKNOWN = "und"


def letters(text: str) -> bytes:
    """The lower-cased words of a text, one space between them."""
    return OTHER.sub(" ", text.lower()).strip().encode("utf-8", "surrogatepass")


def train(labelled: DataFrame, *, lang: str = "lang", text: str = "text", seed: int = 11) -> dict[str, bytes]:
    """A dictionary for each language of labelled rows; null languages and texts teach nothing.

    The sample is bounded: different texts whose seeded hash lies under a threshold set for about
    SAMPLE_TEXTS of them a language, and the text of the smallest hash in any case, in hash order,
    PART_CHARS of each from a place that the hash chooses too. Repeated texts count once, so a language of few different texts keeps all.
    """
    rows = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null").withColumn("h", F.xxhash64(F.lit(seed), "text"))
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n"), F.min("h").alias("least")).limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return {}
    # a share of all hashes, from the least one on
    most = [(r.lang, max(r.least, min(int(min(1.0, SAMPLE_TEXTS / r.n) * (1 << 64)), (1 << 64) - 1) - (1 << 63))) for r in counts]
    bounds = rows.sparkSession.createDataFrame(most, "lang string, most long")
    place = 1 + F.pmod(F.xxhash64(F.lit(seed + 1), "h"), F.greatest(F.char_length("text") - PART_CHARS, F.lit(0)) + 1)
    some = rows.join(F.broadcast(bounds), "lang").where("h <= most").dropDuplicates(["lang", "h"]).select("lang", "h", F.substr("text", place.cast("int"), F.lit(PART_CHARS)).alias("text"))
    parts: dict[str, list[tuple[int, str]]] = {r.lang: [] for r in counts}
    for r in some.collect():  # about MAX_LANGUAGES * SAMPLE_TEXTS parts at most
        parts[r.lang].append((r.h, r.text))
    return {name: b" ".join(letters(t) for _, t in sorted(found, reverse=True))[-DICTIONARY_BYTES:] for name, found in parts.items()}


class Classifier:
    """Compressed sizes of a text under each language's dictionary."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.names = sorted(dictionaries)
        self.coders = [self._coder(dictionaries[name], LEVEL) for name in self.names]

    @staticmethod
    def _coder(dictionary: bytes, level: int) -> zstandard.ZstdCompressor:
        content = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        content.precompute_compress(level=level)
        return zstandard.ZstdCompressor(level=level, dict_data=content, write_content_size=False, write_dict_id=False, write_checksum=False)

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score): `und` and 0 without a letter or without languages; the score is the margin's share of the runner-up's size."""
        return self.judge(text)[:2]

    def judge(self, text: str | None) -> tuple[str, float, float]:
        """predict() and how clear it is: the margin's share of the runner-up's size or, for long texts, of FULL bytes."""
        if not text or not self.names or not LETTER.search(text):
            return UNKNOWN, 0.0, 0.0
        data = letters(text)
        sizes = sorted((len(c.compress(data)), name) for c, name in zip(self.coders, self.names, strict=True))
        if len(sizes) == 1:
            return sizes[0][1], 1.0, 1.0
        margin = sizes[1][0] - sizes[0][0]
        return sizes[0][1], margin / sizes[1][0], margin / min(sizes[1][0], FULL)


def predict(docs: DataFrame, dictionaries: dict[str, bytes], *, key: str = "doc_id", text: str = "text", margin: float = 0.0) -> DataFrame:
    """Per row of docs (key, lang_pred, score, rejected); equal sizes fall to the first name.

    `und` is rejected always, and so is what is less clear than `margin` (see judge). A null text is `und`; repeated
    rows get equal results; an empty table gives an empty result. Only the text is looked at.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(dictionaries)  # MAX_LANGUAGES * DICTIONARY_BYTES at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(held.value)
        for batch in batches:
            found = [classifier.judge(t.as_py()) for t in batch.column("text")]
            names, scores = [x for x, _, _ in found], [s for _, s, _ in found]
            rejected = [x == UNKNOWN or c < margin for x, _, c in found]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], ["key", "lang_pred", "score", "rejected"])

    return docs.mapInArrow(run, f"key {docs.schema['key'].dataType.simpleString()}, lang_pred string, score double, rejected boolean").withColumnRenamed("key", key)


def keep_known(docs: DataFrame, dictionaries: dict[str, bytes], *, text: str = "text", margin: float = 0.0) -> DataFrame:
    """docs, all columns, without the rows that predict() rejects; repeated rows stay or go together, an empty table stays empty."""
    small_batches(docs.sparkSession)
    held, where = docs.sparkSession.sparkContext.broadcast(dictionaries), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(held.value)
        for batch in batches:
            found = (classifier.judge(t.as_py()) for t in batch.column(where))
            yield batch.filter(pa.array([x != UNKNOWN and c >= margin for x, _, c in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(key: str = "doc_id"):
    """Whether a document is kept from training: crc32 of its id as text, modulo 4, is 2."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2
