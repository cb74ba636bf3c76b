"""The corpus pipeline: language ID, near duplicates, personal data, mixing, SentencePiece.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns a DataFrame;
its result is written as Parquet and read again as the next stage's docs. All stages but the last return
the columns of ``documents``. An empty table gives empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from verisect.llm import langid, mixing, neardup, pii, sentencepiece
from verisect.llm.common import stored

#: Near duplicates of this pipeline: five-word shingles. At a similarity (Jaccard) of 0.8 fingerprints of
#: 64 bits differ in 9.7 bits on average (64 * acos(2 * 0.8 / 1.8) / pi), too many for a search that does not
#: grow with the square of the documents; so MinHash bands propose pairs as well. Pairs are linked if their
#: whole shingle sets have at least that similarity.
SHINGLE_WORDS, RADIUS, SIMILARITY = 5, 4, 0.8
#: Words that a worker remembers, fewer than for encoding alone: the executors' memory holds what the stages before left.
MEMO_WORDS = 50_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters (null and empty ones too) and those whose language can't be told."""
    return langid.keep_identified(docs, langid.learn(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, that of the smallest id; of repeated rows one."""
    return neardup.keep_one(docs, shingle_words=SHINGLE_WORDS, radius=RADIUS, similarity=SIMILARITY)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data, and terms that reveal it, in all texts; all rows stay, null texts as they are."""
    return pii.sanitise(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as its source's target weight asks for; null sources are one source."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document that the mix took; of a null text null."""
    return sentencepiece.encode(docs, memo_words=MEMO_WORDS).select("doc_id", "ids", "n_tokens")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mix", mix),
    ("tokens", tokens),
]

#: No stage but mixing can be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
