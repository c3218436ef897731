"""A pipeline from raw documents to training tokens, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and all documents that the stage before kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainspark.llm import bpe, common, minhash, mixing, toxicity, wordrepeats


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is 0.7 or more go; the model learns from the table of labels. Null and empty texts have no
    sign of it and stay, unless no label but toxic ones is known."""
    model = toxicity.fit(docs, common.read(spark, sf_dir, "labels"))
    return toxicity.ordinary_documents(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of equal or near-equal texts stays: the one of the smallest id, one of them if it repeats. Null
    and empty texts are classed with equal texts only; rows without id stay only where no other of the class has one."""
    return minhash.one_of_each(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in passages of 20 words that occur earlier go; ``n_chars`` follows the text. No row goes, null texts stay null."""
    kept = wordrepeats.without_repeats(docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them (0, 1 or 2 times). Documents without words are in no mix; a null source is one too."""
    return mixing.mixed_copies(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and the text that they give when decoded; null and empty texts have no ids."""
    return bpe.encode_documents(docs, bpe.public_file(), decoded="text")


STAGES = [
    ("toxicity", reject_toxic),
    ("near duplicates", drop_near_duplicates),
    ("substring duplicates", cut_repeated_passages),
    ("mixing", mix_sources),
    ("tokens", tokenise),
]
#: SQL can express neither the model nor the hashing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written as Parquet before the next one reads it."""
    docs = common.read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
