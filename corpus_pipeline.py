"""A corpus pipeline of five of the llm operators; each stage works on all that the one before it kept.

In every stage null texts count as empty, repeated rows and null ids are rows like any other, empty tables give empty
tables, and columns beyond those of documents are left out.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from squadframe.llm import bpe, exact_dedup, mixing, simhash, toxicity
from squadframe.llm.common import crc_remainder, shared_folder

#: Score from which a document is rejected as toxic.
TOXIC = 0.3
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that score as toxic; the model learns from the labelled documents of three folds in four. Without labels of both classes nothing is rejected."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.fit(docs, labels.where(crc_remainder(F.col("doc_id"), 4) != 2))
    return toxicity.score(docs.select(*COLUMNS), model).where(F.col("toxicity") < TOXIC).select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays, the one with the smallest id (null ids last); of a row that repeats, one."""
    return exact_dedup.keep_one(docs.select(*COLUMNS))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates stays (Jaccard similarity of five-word shingles 0.8 or more),
    the one with the smallest id. Texts of fewer words are one shingle, so all texts without words are alike."""
    return simhash.keep_one(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws the sources to their target weights; a document is there once for each pass that takes words of it."""
    return mixing.mixed_documents(docs.select(*COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text (4 bytes each, little-endian), checked by decoding them."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = bpe.decode(bpe.encode(docs, path, public_tokenizers.PATTERN), path)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("mixing", mix_sources), ("bpe", encode)]

#: No SQL expresses the classifier, the fingerprints, the drawing or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
