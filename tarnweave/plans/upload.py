"""Incremental upload of documents into the graph, and the offline build."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnweave.functions.models import Embedder, hashing_embedder, leading_summary
from tarnweave.functions.text import clean_text, parse_filename
from tarnweave.operators.chunking import item_sections, paragraph_chunks, shadow_id, token_windows, upload_sections
from tarnweave.operators.graph import next_chunk_edges, tree_edges
from tarnweave.operators.vectors import nearest_cluster
from tarnweave.storage import materialise


@dataclass(frozen=True)
class Uploaded:
    documents: DataFrame
    sections: DataFrame
    shadows: DataFrame
    edges: DataFrame


def upload_ids(new: DataFrame) -> DataFrame:
    """``upload_{ticker}_{64 hex}``; the hex is the whole SHA-256 of title and text, so that reruns agree and others differ."""
    title = F.coalesce("title", F.lit(""))
    mark = F.sha2(F.concat_ws("\0", F.length(title).cast("string"), title, F.coalesce("text", F.lit(""))), 256)
    ticker = F.coalesce("ticker", F.lit(""))
    return new.withColumn("doc_id", F.concat(F.lit("upload_"), F.when(ticker != "", F.concat(ticker, F.lit("_"))).otherwise(""), mark))


def upload(new: DataFrame, known: DataFrame, node_ids: DataFrame, embed: Embedder | None = None, section: int = 2000, size: int = 1000, stride: int = 800, summary: int = 40) -> Uploaded:
    """M2 for a batch (title, text, ticker, form_type, period, linked_to).

    Sections and chunks are token windows; each section takes the cluster of the nearest known one (id, vec,
    cluster_id), its chunks take it over. A parent that doesn't exist gives no LINKED_TO edge and no error; documents
    with a ticker get none to their company either (D15). Documents and clustered sections are written, so that each
    table of the result doesn't do the work again.
    """
    embed = embed or hashing_embedder()
    docs = materialise(upload_ids(new).dropDuplicates(["doc_id"]), "uploads")
    secs = upload_sections(docs, "doc_id", "text", section)
    vec = embed(F.col("text"))
    secs = materialise(secs.withColumn("summary", leading_summary(F.col("text"), summary)).withColumn("vec", vec), "sections")
    found = nearest_cluster(secs.select(F.col("section_id").alias("id"), "vec"), known)
    secs = materialise(secs.join(found.select(F.col("id").alias("section_id"), "cluster_id"), "section_id", "left"), "clustered")
    rows = shadow_id(token_windows(secs.select("doc_id", "section_id", "cluster_id", "text"), "text", (size, stride, "chunk_index")))
    rows = rows.withColumn("vec", vec).select("section_id", "doc_id", "shadow_id", "chunk_index", "text", "token_count", "vec", "cluster_id")
    parents = docs.select(F.col("linked_to").alias("src"), F.col("doc_id").alias("dst")).join(node_ids.select(F.col("id").alias("src")).distinct(), "src", "left_semi")
    edges = tree_edges(docs.withColumn("ticker", F.lit(None).cast("string")), secs, rows).unionByName(next_chunk_edges(rows)).unionByName(parents.select("src", "dst", F.lit("LINKED_TO").alias("type")))
    docs = docs.select("doc_id", "title", "ticker", "form_type", "period", leading_summary(F.col("text"), summary).alias("summary"), vec.alias("vec"), F.lit(True).alias("uploaded"))
    return Uploaded(docs, secs, rows, edges)


def ingest(files: DataFrame, limit: int = 1000, overlap: int = 200) -> Uploaded:
    """M4: (file, text) of filings to documents, Item sections, chunks and the tree's edges, as one plan."""
    meta = parse_filename(F.col("file"))
    docs = files.select(meta.alias("m"), clean_text(F.col("text")).alias("text")).select("m.*", "text")
    secs = item_sections(docs, "doc_id", "text")
    rows = paragraph_chunks(secs.select("doc_id", "section_id", F.col("body").alias("text")), limit, overlap)
    edges = tree_edges(docs, secs, rows).unionByName(next_chunk_edges(rows))
    return Uploaded(docs.drop("text"), secs, rows, edges)


def companies(docs: DataFrame) -> DataFrame:
    """Company nodes, once each."""
    return docs.where("ticker is not null").select(F.col("ticker").alias("id")).distinct()


def embed_missing(nodes: DataFrame, text_col: str, embed: Embedder | None = None) -> DataFrame:
    """Vectors for rows that have text and no vector yet; a changed text isn't embedded again."""
    embed = embed or hashing_embedder()
    todo = F.col("embedding").isNull() & F.col(text_col).isNotNull()
    return nodes.where(~todo).unionByName(nodes.where(todo).withColumn("embedding", embed(F.col(text_col))).select(nodes.columns))


def carry_summaries(new: DataFrame, old: DataFrame) -> DataFrame:
    """A null summary takes the old one of the same id."""
    return new.join(old.select("id", F.col("summary").alias("_old")), "id", "left").withColumn("summary", F.coalesce("summary", "_old")).drop("_old")


def first_seen(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Distinct values with where they first appear."""
    return rows.groupBy(key).agg(F.min(order).alias("first"))
