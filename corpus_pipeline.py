"""From raw documents to packed training sequences, stage by stage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framegauge.llm import blob_ledger, fertility, packing, simhash, toxicity
from framegauge.storage import new_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below the threshold; a quarter of the labels is never used."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    may_learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2
    return toxicity.keep_clean(docs, toxicity.fit(toxicity.labelled_sample(docs, labels, may_learn)))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules on words and on fertility."""
    return fertility.keep_good(docs, public_tokenizers.path("piece_bpe_32k.model"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced."""
    return blob_ledger.redact(spark, docs, new_path(spark, "secret-ledger"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each piece of each document in sequences of 2048 tokens."""
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    pieces = packing.token_pieces(docs, tokenizer, end_id=0, capacity=2048)
    return packing.pack_pieces(pieces, capacity=2048).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
