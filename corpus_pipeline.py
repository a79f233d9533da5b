"""The corpus pipeline: documents in, training shards out.

Each stage takes ``(spark, docs, sf_dir)``, works on all that its predecessor kept, and is written as Parquet
in the shared folder and read again as the next one's input. All stages but the last return the columns
of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tillcast.llm import langid
from tillcast.llm.decontaminate import drop_contaminated
from tillcast.llm.mixing import OWN, mix
from tillcast.llm.sharding import shard_rows
from tillcast.llm.simhash import keep_one_of_each
from tillcast.llm.tables import read, staged

SHARDS = 16
REPETITION_LIMIT = 2.0  # the smallest source is used twice where the largest is used once
# Near duplicates are texts with four fifths or more of their five-word shingles in common. Their fingerprints differ in
# about ten bits of 64. A pair is met if any of the fingerprints agrees in one of four blocks of 16 bits, and in all
# but ten bits over all (14 fingerprints: recall 0.99 at 0.8).
SHINGLE_WORDS, BITS, PRINTS, BLOCKS, FRONT = 5, 10, 14, 4, 1

# No SQL: language models, fingerprints and key hashes have no counterpart there; see tests/llm.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language, or with a doubtful one."""
    return langid.keep_identified(docs, langid.fit(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near duplicates."""
    return keep_one_of_each(docs, width=SHINGLE_WORDS, budget=BITS, prints=PRINTS, blocks=BLOCKS, front=FRONT)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which a twentieth or more lies in passages of the benchmark."""
    return drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents of small sources; every document is used at least once."""
    return mix(docs, repetition_limit=REPETITION_LIMIT).drop(*OWN)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deals the rows to shards of equal bytes, with their place in the shard."""
    return shard_rows(docs, SHARDS, key_columns=["doc_id", "text"])


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("sharding", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
