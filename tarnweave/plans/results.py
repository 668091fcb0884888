"""Result rows of a batch of questions: answers, paths, routes and timings."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnweave.operators import ranking as R
from tarnweave.plans import retrieval as P
from tarnweave.storage import materialise

MODES = ("graph_rag", "rag")


def answer_batch(questions: DataFrame, corpus: P.Corpus, mode: str = "graph_rag", settings: P.Settings = P.Settings()) -> DataFrame:
    """A row for each question: answer, supporting_paths, clusters_used, tickers, filters, cache_status, mode, timings.

    ``clusters_used`` is null in flat mode and where routing fell back. Timings (R12) are the batch's wall clock, of the
    search (with its hops and reranking) and in all; ``cache_status`` is always a miss, as there is no result cache.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    began = time.time()
    routed = mode == "graph_rag"
    clusters = None
    if routed:
        found, clusters = P.anchors(questions, corpus, settings)
        found = materialise(found, "anchors")
        rows = P.ranked_pool(questions, corpus, found, settings)
    else:
        rows = P.flat_retrieval(questions, corpus, settings)
    rows = materialise(rows, "ranked")
    searched = time.time()
    paths = R.build_paths(rows) if routed else R.flat_paths(rows.withColumn("company_id", F.lit(None).cast("string"))).join(rows.select("qid", "shadow_id", "place"), ["qid", "shadow_id"])
    item = F.struct("place", "node_ids", "edge_types", "score", "label")
    # at most ``final`` or ``flat`` rows for each question
    paths = paths.groupBy("qid").agg(F.array_sort(F.collect_list(item)).alias("p"))
    paths = paths.select("qid", F.transform("p", lambda x: F.struct(x["node_ids"].alias("node_ids"), x["edge_types"].alias("edge_types"), x["score"].alias("score"), x["label"].alias("label"))).alias("supporting_paths"))
    said = R.context(rows, questions, graph=routed).select("qid", "answer")
    out = questions.join(said, "qid").join(paths, "qid", "left")
    if routed:
        used = clusters.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "cluster_id"))), lambda x: x["cluster_id"]).alias("clusters_used"))
        out = out.join(used, "qid", "left")
    else:
        out = out.withColumn("clusters_used", F.lit(None).cast("array<bigint>"))
    out = materialise(out, "answers")
    ms = {"search_ms": (searched - began) * 1000, "total_ms": (time.time() - began) * 1000}
    timings = F.create_map(*[x for k, v in ms.items() for x in (F.lit(k), F.lit(float(v)))])
    filters = F.struct("tickers", "years", "form_type")
    return out.select("qid", "question", F.lit(mode).alias("mode"), "answer", F.lit("miss").alias("cache_status"), F.col("tickers").alias("tickers_detected"), filters.alias("filters_applied"), "clusters_used", "supporting_paths", timings.alias("latency_breakdown"))
