"""A training-data pipeline over ``documents``: each stage takes (spark, docs, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnweave.llm.bpe import bpe_encode
from tarnweave.llm.exact_dedup import drop_copies
from tarnweave.llm.mixing import mixed
from tarnweave.llm.near_dedup import near_dedup
from tarnweave.llm.screen import without
from tarnweave.llm.text import learns
from tarnweave.llm.toxicity import drop_toxic, fit_toxicity
from tarnweave.llm.vocabularies import public_vocabulary
from tarnweave.storage import arrow_rows, materialise

#: Rows of whole texts that go to Python at a time; ``bpe`` puts smaller batches together by their bytes.
TEXT_ROWS, BPE_ROWS = 1000, 200


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the induced lexicon rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(learns(F.col("doc_id"), 4, 2))
    with arrow_rows(spark, TEXT_ROWS):
        return materialise(drop_toxic(docs, fit_toxicity(docs, labels)), "clean")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest id stays."""
    return drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the smallest id stays."""
    found = near_dedup(docs)
    return without(docs, found.where("id <> component_id").select("id"), "doc_id")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it."""
    return mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and the digest of what they decode to."""
    coded = bpe_encode(docs, public_vocabulary("word_bpe_49k.json"))
    coded = coded.select(F.col("id").alias("doc_id"), "n_tokens", "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
    with arrow_rows(spark, BPE_ROWS):
        return materialise(coded, "encoded")


STAGES = [("toxicity", toxicity), ("exact_dedup", exact), ("near_dedup", near), ("source_mix", mix), ("bpe", encode)]

#: SQL can express neither the lexicon nor the sampling; tests hold the stages against the operators they call, not brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if not hasattr(docs, "_scratch"):  # else the stage wrote it
            docs = materialise(docs, name)
    return docs
