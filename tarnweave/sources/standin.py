"""The driver's tables as a document graph: sources are companies, documents filings, token windows sections and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnweave.operators.chunking import section_columns, shadow_id, sliding_chunks, token_windows, upload_sections

SECTION, WINDOW, STRIDE = 400, 200, 160
FORMS = ("10-K", "10-Q", "8-K", "DEF 14A")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(num, doc_id, ticker, form_type, period, text)."""
    form = F.element_at(F.array(*map(F.lit, FORMS)), (F.pmod("doc_id", F.lit(4)) + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("num"), F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("doc_id"), F.col("source").alias("ticker"), form.alias("form_type"), (F.pmod("doc_id", F.lit(7)) + 2020).cast("string").alias("period"), "text")


def sections(docs: DataFrame) -> DataFrame:
    return upload_sections(docs, "doc_id", "text", SECTION)


def shadows(secs: DataFrame) -> DataFrame:
    return sliding_chunks(secs, WINDOW, STRIDE)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"), F.col("label").cast("long").alias("cluster_id"))


def chunk_rows(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """Every chunk with its section's and filing's columns, cut in one pass over the texts."""
    rows = token_windows(docs, "text", (SECTION, SECTION, "section_index"), (WINDOW, STRIDE, "chunk_index"), keep_text=keep_text)
    return shadow_id(section_columns(rows))


def with_places(rows: DataFrame, vecs: DataFrame) -> DataFrame:
    """Chunks with the number of their vector, which is one of the embeddings, by the chunk's place."""
    n = vecs.agg((F.max("vec_id") + 1).alias("n"))
    place = F.pmod(F.col("num") * 7 + F.col("section_index") * 5 + F.col("chunk_index"), F.col("n"))
    return rows.crossJoin(F.broadcast(n)).withColumn("vec_id", place).drop("n")


def graph(spark: SparkSession, sf_dir: str, keep_text: bool = True) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """documents, sections, shadows and the joined tree; ``keep_text=False`` leaves the chunks' text null."""
    docs = filings(spark, sf_dir)
    rows, vecs = chunk_rows(docs, keep_text), vectors(spark, sf_dir)
    return docs, sections(docs), rows, with_places(rows, vecs).join(vecs, "vec_id")
