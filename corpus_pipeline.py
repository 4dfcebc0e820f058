"""A corpus from raw documents to token ids: each stage works on all that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import bpe, line_dedup, mixing, ngram_join, toxicity
from scriptorium.llm.common import stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that score as toxic; the model is fitted on a bounded sample of the labelled ones.

    Null and empty texts are scored alike, as a text without any mark; null and repeated ids are rows like others, and rows with equal texts
    stay or go together. Without labels of both classes every score is one number. An empty table gives an empty one.
    """
    return toxicity.keep_clean(docs, toxicity.fit_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without lines that occur earlier, but for one edit at most. A document all of whose lines go stays, as an empty one.

    n_chars is that of what is left (null for null texts). Null texts stay null, blank lines stay. Null ids are the latest; rows that repeat
    id and text keep and lose the same lines. An empty table gives an empty one.
    """
    return line_dedup.dedup_lines(docs).withColumn("n_chars", F.char_length("text").cast("bigint")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each class of documents with similar five-word strings.

    Of rows that repeat that id with other texts the one of the least hash stays; rows that repeat id and text stay together, and so do
    classes without any id. Null and empty texts are in no class and stay. An empty table gives an empty one.
    """
    return ngram_join.keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the target weights of the sources want it, not at all or up to three times, in the order of its slots.

    Null sources are one source, the last; documents without words are not taken. Null ids are shuffled as empty strings; rows that repeat
    id and text come as often as all of them are taken. An empty table gives an empty one.
    """
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, as their number and digest, and the digest of what they decode to.

    A row per row, in whatever order; null texts have no tokens, like empty ones. An empty table gives an empty result.
    """
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.bpe_encode(docs, ranks, public_tokenizers.PATTERN, keep_ids=False).drop("ids")


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("ngram_join", drop_near_copies), ("mixing", mix_sources), ("bpe", encode)]

#: Several stages (a fitted model, MinHash classes, token ids) have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared checkpoint folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
