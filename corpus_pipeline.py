"""Corpus pipeline over ``documents``: toxicity, exact dedup, n-gram Jaccard join,
mixing to target weights, byte-level BPE. Each stage takes (spark, docs, sf_dir)
and works on all that its predecessor kept; its result is written and read again.

Defined cases, as those of the operators: a null text counts as empty, is clean, equal to other
empties, like nothing, and never taken into the mix; a null doc_id is not learned from and
stays where near copies go; null is a source of its own; of rows that repeat a doc_id and text one
stays; very long texts are read whole; of ties the larger doc_id stays among equal texts, the
smaller among near copies; an empty table gives empty results; other columns are carried along
to the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.llm import bpe, exact_dedup, mixing, ngram_join, toxicity
from talus.llm.scratch import Scratch, fresh


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the toxicity machine rejects."""
    Scratch(spark, "toxicity")  # sets small batches, from the first stage on
    Scratch(spark, "toxicity")  # its small batches hold from the first stage on
    machine = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    (score,) = fresh(docs, "toxicity")
    return toxicity.scored(docs, machine, score).where(F.col(score) < 0.5).drop(score)


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.drop_copies(Scratch(spark, "exact"), docs)


def dissimilar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays."""
    return ngram_join.keep_one(Scratch(spark, "near"), docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a document once for each time that it is taken, cut where the
    quota ends inside it; dealt to shards and shuffled there."""
    return mixing.mixed_documents(Scratch(spark, "mix"), docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded bytes of each row."""
    import public_tokenizers

    return bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", clean),
    ("exact dedup", unrepeated),
    ("n-gram Jaccard join", dissimilar),
    ("mixing sources to target weights", mixed),
    ("byte-level BPE encoding and decoding", encoded),
]

#: SQL cannot express the trained stage nor the seeded draws; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and reread."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return docs
