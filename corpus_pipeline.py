"""A corpus pipeline of five operators; each stage reads what the one before it wrote.

Language ID drops what it rejects, the n-gram join keeps one document of each group of near
duplicates, decontamination drops documents that hold benchmark passages, mixing repeats or
drops documents for the sources' target weights, and sharding deals the rest into shards.

Every stage takes an empty table to an empty one, keeps all columns of documents (the last gives its
own), also such as bear names that an operator uses inside, and takes texts whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronofeat.llm import decontaminate, langid, mixing, ngram_join, sharding
from chronofeat.llm.common import materialize, table

#: A document without a letter, or whose language leads the next by less than this share, is rejected.
#: On held-out rows of sf0.1 it costs 10 of 2,477 rightly labelled ones; see the README.
MARGIN = 0.05


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known. The dictionaries learn from the labelled documents themselves.

    Null and empty texts and those without a letter go; a null lang, source or doc_id doesn't matter
    but to training, which only rows with a lang take part in. Repeated rows stay or go together.
    Without a labelled row nothing is known, and all documents go.
    """
    return langid.keep_known(docs, langid.train(docs.where(~langid.held_out())), margin=MARGIN)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each group linked by five-word shingles at 0.8 or more.

    Documents without words and those of a null doc_id all stay. Rows that share a doc_id, repeated
    rows too, stay or go together.
    """
    return ngram_join.keep_one(docs, words=5, num=80, den=100)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with less than a twentieth of their words in benchmark windows.

    Null texts have no words and stay; null items hold no window; without items all stay. Rows are
    judged each by their own text, so that repeated rows stay or go together.
    """
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), window=13, coverage=20)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    A null source is a source of its own, the last. Null and empty texts have no words. Rows that
    share a doc_id share a block and so are taken alike. The seeds are fixed: reruns agree.
    """
    return mixing.mix(docs, weights=(3, 1, 2), share=1.5, cap=2.0, shards=8)


def shard_assignment(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of each row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Equal texts, null ones among them, lie in one shard; copies that the mix made have slots of their own.
    """
    return sharding.assign(docs, shards=8)


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
    ("sharding", shard_assignment),
]

#: Compression, set joins and seeded draws have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
