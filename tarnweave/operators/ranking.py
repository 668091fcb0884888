"""Routing, pools, reranking and provenance for batches of questions; every table carries ``qid``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnweave.functions.text import provenance_label


def top_clusters(seeds: DataFrame, n: int) -> DataFrame:
    """(qid, cluster_id) of the ``n`` best mean scores over the seeds; ties by the best seed's rank."""
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "shadow_id"))
    means = seeds.withColumn("rank", rank).where("cluster_id is not null").groupBy("qid", "cluster_id").agg(F.round(F.avg("score"), 6).alias("mean"), F.min("rank").alias("first"))
    order = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("mean"), "first"))
    return means.withColumn("place", order).where(F.col("place") <= n).select("qid", "cluster_id", "mean", "place")


def seed_biased_cap(rows: DataFrame, seeds: DataFrame, cap: int) -> DataFrame:
    """At most ``cap`` rows of each (qid, cluster): seeds first, then by a hash of the id, so reruns agree."""
    marked = rows.join(seeds.select("qid", "shadow_id", F.lit(True).alias("is_seed")).distinct(), ["qid", "shadow_id"], "left")
    order = [F.coalesce("is_seed", F.lit(False)).desc(), F.md5("shadow_id"), "shadow_id"]
    rank = F.row_number().over(Window.partitionBy("qid", "cluster_id").orderBy(*order))
    # a plain limit per group, which Spark also applies before the shuffle; seeds stay whatever their rank
    capped = marked.withColumn("_rank", rank).where(F.col("_rank") <= cap).drop("_rank").where("is_seed is null")
    return capped.unionByName(marked.where("is_seed")).drop("is_seed")


def top_per(rows: DataFrame, by: list[str], k: int, *, score: str = "score", tie: str = "shadow_id") -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), tie))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def lexical_score(question: Column, text: Column) -> Column:
    """R6's offline reranker: the share of the question's distinct words that the text holds."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(question), F.lit("[a-z0-9]+"), F.lit(0)))
    held = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)))
    return F.round(F.size(F.array_intersect(words, held)) / F.greatest(F.size(words), F.lit(1)), 6)


def rerank(pool: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """The joint score replaces the cosine; rows with empty text come last with their own score."""
    rows = pool.join(F.broadcast(questions.select("qid", "question")), "qid")
    empty = F.coalesce(F.col("text"), F.lit("")) == ""
    rows = rows.withColumn("cosine", F.col("score")).withColumn("score", F.when(empty, F.col("score")).otherwise(lexical_score(F.col("question"), F.col("text"))))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(empty, F.desc("score"), F.desc("cosine"), "shadow_id", *(["parent_id"] if "parent_id" in pool.columns else [])))
    return rows.withColumn("place", rank).where(F.col("place") <= k)


def build_paths(rows: DataFrame) -> DataFrame:
    """Node ids, edge types, score at 4 places and label of each row; a company goes before a linked parent."""
    company, parent = F.col("company_id"), F.col("parent_id")
    last = F.when(company.isNotNull(), company).otherwise(parent)
    kind = F.when(company.isNotNull(), F.lit("HAS_DOCUMENT")).when(parent.isNotNull(), F.lit("LINKED_TO"))
    return rows.select(
        "qid",
        "shadow_id",
        *(["place"] if "place" in rows.columns else []),
        F.array_compact(F.array("shadow_id", "section_id", "doc_id", last)).alias("node_ids"),
        F.array_compact(F.array(F.lit("HAS_SHADOW"), F.lit("HAS_SECTION"), kind)).alias("edge_types"),
        F.round("score", 4).alias("score"),
        provenance_label(F.col("ticker"), F.col("form_type"), F.col("period"), F.col("section_title")).alias("label"),
    )


def flat_paths(rows: DataFrame) -> DataFrame:
    """R8."""
    label = provenance_label(F.col("ticker"), F.col("form_type"), F.col("period"), F.col("section_title"))
    return rows.select("qid", "shadow_id", F.array("shadow_id").alias("node_ids"), F.array().cast("array<string>").alias("edge_types"), F.round("score", 4).alias("score"), label.alias("label"))


NOTHING = "No relevant documents were found in the knowledge graph for this question."


def context(rows: DataFrame, questions: DataFrame, graph: bool) -> DataFrame:
    """R9 and R10's default: (qid, context, answer). Blocks are numbered by ``place``; a bounded number for each question.

    The extractive answer is the best passage with its provenance.
    """
    ticker = F.coalesce(F.nullif(F.col("ticker"), F.lit("")), F.lit("upload"))
    source = F.concat_ws(" | ", ticker, F.concat_ws(" ", F.coalesce("form_type", F.lit("")), F.coalesce("period", F.lit(""))), F.coalesce("section_title", F.lit("")))
    if graph:
        attached = F.when(F.col("company_id").isNull() & F.col("parent_id").isNotNull(), F.concat(F.lit(" [attached to: "), F.col("parent_id"), F.lit(" via user-defined edge]"))).otherwise("")
        head = F.concat(F.lit("SOURCE: "), source, attached, F.lit("\nSECTION SUMMARY: "), F.coalesce("section_summary", F.lit("")))
    else:
        head = F.concat(F.lit("SOURCE: "), source)
        rows = rows.where("coalesce(text, '') <> ''")
    block = F.concat(F.lit("["), F.col("place").cast("string"), F.lit("] "), head, F.lit("\nEXCERPT:\n"), F.coalesce("text", F.lit("")))
    parts = rows.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("place", block.alias("block"), source.alias("source"), F.col("text").alias("text")))).alias("b"))
    parts = parts.select("qid", F.array_join(F.transform("b", lambda x: x["block"]), "\n\n---\n\n").alias("context"), F.concat(F.get("b", 0)["text"], F.lit(" ["), F.get("b", 0)["source"], F.lit("]")).alias("answer"))
    return questions.select("qid").join(parts, "qid", "left").select("qid", F.coalesce("context", F.lit("")).alias("context"), F.coalesce("answer", F.lit(NOTHING)).alias("answer"))
