import pytest
from pyspark.sql import functions as F

from tarnweave.functions.models import hashing_embedder
from tarnweave.functions.text import detect_filters
from tarnweave.plans import build as B
from tarnweave.plans.results import answer_batch
from tarnweave.plans.retrieval import Corpus, Settings, anchors
from tarnweave.sources import filings as S
from tarnweave.streaming.uploads import stream_uploads


@pytest.fixture(scope="module")
def corpus(spark):
    texts = [(f"c{i}", f"s{i // 2}", f"topic{i % 3} words about battery supply number {i}", i % 3) for i in range(12)]
    tree = spark.createDataFrame(texts, "shadow_id string, section_id string, text string, cluster_id long")
    tree = tree.withColumn("vec", hashing_embedder(32)(F.col("text"))).withColumn("doc_id", F.col("section_id")).withColumn("ticker", F.lit("TSLA")).withColumn("form_type", F.lit("10-K")).withColumn("period", F.lit("2023"))
    tree = tree.withColumn("section_title", F.lit("Item 1.")).withColumn("section_summary", F.lit(None).cast("string"))
    companies = spark.createDataFrame([("TSLA",)], "id string")
    linked = spark.createDataFrame([], "src string, dst string")
    similar = spark.createDataFrame([("s0", "s1", 0.9), ("s0", "s2", 0.8)], "id_a string, id_b string, score double")
    kw = spark.createDataFrame([("c0", "battery", 0.9), ("c5", "battery", 0.2)], "shadow_id string, phrase string, score double")
    return Corpus(tree, companies, linked, similar, kw)


def asked(spark, *texts):
    q = spark.createDataFrame(list(enumerate(texts)), "qid long, question string")
    return q.withColumn("qvec", hashing_embedder(32)(F.col("question"))).select("qid", "question", "qvec", detect_filters(F.col("question")).alias("f")).select("qid", "question", "qvec", "f.*")


def test_answers(spark, corpus, tmp_path):
    q = asked(spark, "topic1 battery supply", "Ford battery")
    got = {r.qid: r for r in answer_batch(q, corpus).collect()}
    assert got[0].clusters_used and got[0].supporting_paths[0].edge_types == ["HAS_SHADOW", "HAS_SECTION", "HAS_DOCUMENT"]
    assert len(got[0].supporting_paths) <= 20 and got[0].cache_status == "miss" and got[0].latency_breakdown["total_ms"] > 0
    assert got[1].supporting_paths is None and got[1].answer.startswith("No relevant documents") and got[1].filters_applied.tickers == ["F"]
    flat = answer_batch(q, corpus, "rag")
    first = {r.qid: r for r in flat.collect()}[0]
    assert first.clusters_used is None and first.supporting_paths[0].edge_types == []
    S.write_results(flat, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    assert "Q: topic1" in {r.qid: r.rendering for r in S.render_results(flat).collect()}[0]
    with pytest.raises(ValueError):
        answer_batch(q, corpus, "other")


def test_fallback_searches_everything(spark, corpus):
    one = Settings(clusters=1, per_cluster=1)
    found, clusters = anchors(asked(spark, "topic1 battery"), corpus, one)
    assert found.count() == 12 and clusters.count() == 0


def test_no_cap_takes_all_of_a_cluster(spark, corpus):
    q = asked(spark, "topic1 battery supply")
    capped, _ = anchors(q, corpus, Settings(clusters=2, per_cluster=4, seeds=2, cap=2, fallback_under=0))
    every, clusters = anchors(q, corpus, Settings(clusters=2, per_cluster=4, seeds=2, cap=None, fallback_under=0))
    wide, _ = anchors(q, corpus, Settings(clusters=2, per_cluster=4, seeds=2, cap=12, fallback_under=0))
    held = clusters.count()
    assert capped.count() < every.count() == 4 * held and sorted(map(tuple, every.collect())) == sorted(map(tuple, wide.collect()))


def test_links_of_some_sections_are_those_of_all_pairs(spark):
    import numpy as np

    from tarnweave.operators import vectors as V

    x = np.random.default_rng(5).normal(size=(40, 6))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    every = {(r.id_a, r.id_b, r.score) for r in V.similarity_edges(rows, 0.4).collect()}
    want = {(a, b, s) for a, b, s in every | {(b, a, s) for a, b, s in every} if a % 7 == 0}
    assert {tuple(r) for r in V.similar_to(rows.where("id % 7 = 0"), rows, 0.4).collect()} == want


def test_build(spark, tmp_path):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [0.0, 1.0])], "id long, vec array<double>")
    chunks = spark.createDataFrame([("a", 0), ("b", 2)], "shadow_id string, id long")
    _, clusters, held = B.cluster_sections(spark, rows, chunks, 0.9, str(tmp_path))
    assert sorted((r.id, r.cluster_id) for r in clusters.collect()) == [(0, 0), (1, 0), (2, 2)] and B.coverage(held).first().missing == 0
    again = rows.withColumn("vec", F.when(F.col("id") == 2, F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.col("vec")))
    assert B.cached_edges(spark, again, 0.9, str(tmp_path)).count() == 3  # changed vectors at an equal number
    with pytest.raises(B.NoEdges):
        B.cluster_sections(spark, rows.where("id <> 1"), chunks, 0.9, str(tmp_path))
    known = B.embed_phrases(spark.createDataFrame([("x y",)], "phrase string"), None)
    assert B.embed_phrases(spark.createDataFrame([("x y",), ("z",)], "phrase string"), known).count() == 2


def test_sources(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    (tmp_path / "a" / "X_10K_2023.clean.txt").write_bytes(b"caf\xc3\xa9 \xff!")
    (tmp_path / "b" / "X_10K_2023.clean.txt").write_text("other")
    files = S.read_texts(spark, [str(tmp_path / "a"), str(tmp_path / "b")])
    names = spark.createDataFrame([("X_10K_2023.clean.txt",), ("gone",)], "file string")
    assert {r.file: r.text for r in S.resolve_file(files, names, ["a", "b"]).collect()} == {"X_10K_2023.clean.txt": "café !", "gone": None}
    (tmp_path / "m.csv").write_text("file,linked_to,title\n X_10K_2023.clean.txt , D1 , T\nnone.txt,D1,T\n,D1,T\n")
    status = S.manifest_status(S.read_manifest(spark, str(tmp_path / "m.csv")), files)
    assert sorted(r.status for r in status.collect()) == ["failed", "skipped", "uploaded"]
    (tmp_path / "k.json").write_text('{"c1": [{"text": "a b", "score": 0.5}], "c2": []}')
    assert [tuple(r) for r in S.read_keywords(spark, str(tmp_path / "k.json")).collect()] == [("c1", "a b", 0.5)]
    h = spark.createDataFrame([(1, ["a", "b", "c"], ["x", "y"])], "id long, p array<string>, q array<string>")
    assert [(r.pos, r.p, r.q) for r in S.zip_history(h, ["p", "q"], ["id"]).collect()] == [(0, "a", "x"), (1, "b", "y")]
    pages = spark.createDataFrame([(1, "<a href='/Archives/edgar/data/1/f.txt'>t</a><a href='/ixviewer/Archives/edgar/data/d.htm'>v</a><A HREF=\"/Archives/edgar/data/1/d.htm?x\">d</A>"), (2, "none")], "id long, html string")
    assert {r.id: (r.url, r.kind) for r in S.index_links(pages, "id", "html").collect()} == {1: ("/Archives/edgar/data/1/d.htm?x", "html"), 2: (None, None)}


def test_stream(spark, tmp_path):
    new = spark.createDataFrame([("T", "alpha beta gamma", None, "8-K", "2024", "D1")], "title string, text string, ticker string, form_type string, period string, linked_to string")
    new.write.parquet(str(tmp_path / "in"))
    known = spark.createDataFrame([("k", [1.0] * 64, 5)], "id string, vec array<float>, cluster_id long")
    ids = spark.createDataFrame([("D1",)], "id string")
    for _ in range(2):  # the second run finds nothing new
        stream_uploads(spark, str(tmp_path / "in"), str(tmp_path / "out"), known, ids).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out" / "documents")).count() == 1
