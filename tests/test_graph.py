import numpy as np
from pyspark.sql import functions as F

from tarnweave.operators import graph as G
from tarnweave.operators import ranking as R
from tarnweave.operators import vectors as V
from tarnweave.plans.upload import carry_summaries, embed_missing, ingest, upload


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_upserts(spark):
    old = spark.createDataFrame([("a", "t", 1), ("b", "u", 2)], "id string, summary string, kept int")
    new = spark.createDataFrame([("a", None, 1), ("c", "x", 1), ("c", "y", 2)], "id string, summary string, n int")
    assert rows(G.upsert_nodes(old, new, ["summary"], order="n").na.fill({"summary": "-", "kept": 0}), "id", "summary", "kept") == [("a", "-", 1), ("b", "u", 2), ("c", "y", 0)]
    e = spark.createDataFrame([("a", "b", "T"), ("a", "b", "T"), ("a", "z", "T")], "src string, dst string, type string")
    assert rows(G.upsert_edges(e, old), "src", "dst") == [("a", "b")]
    assert G.duplicate_ids(new).first()["id"] == "c"


def test_similarity_edges_match_brute_force(spark):
    x = np.random.default_rng(0).normal(size=(60, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "id long, vec array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if u[i] @ u[j] >= 0.5}
    V.BLOCK, before = 13, V.BLOCK
    try:
        assert set(rows(V.similarity_edges(df, 0.5), "id_a", "id_b")) == want
    finally:
        V.BLOCK = before


def test_cooccurrence_meets_by_three_phrases(spark):
    import itertools

    rng = np.random.default_rng(6)
    sets = {f"s{i:02}": {f"p{k}" for k in rng.integers(0, 14, rng.integers(2, 12))} | {"all"} for i in range(40)}
    table = spark.createDataFrame([(s, p) for s, held in sets.items() for p in held], "section_id string, phrase string")
    linked = spark.createDataFrame([("s03", "s01", 0.9)], "id_a string, id_b string, score double")
    for least in (2, 4, 7):
        got = G.keyword_cooccurrence(table, linked, least)
        want = [(a, b, n) for a, b in itertools.combinations(sorted(sets), 2) if (n := len(sets[a] & sets[b])) >= least and (a, b) != ("s01", "s03")]
        assert rows(got, "id_a", "id_b", "shared") == want
        assert "key" in got._jdf.queryExecution().optimizedPlan().toString()  # not a join by each phrase


def test_nearest_cluster_by_blocks_and_tiles(spark, monkeypatch):
    for name, n in (("OLD_BLOCK", 30), ("TILE", 7), ("TILE_ROWS", 5)):
        monkeypatch.setattr(V, name, n)
    x = np.random.default_rng(4).normal(size=(80, 6)).astype(np.float32)
    x[50], x[60], x[7] = x[3], x[3], 0  # equal vectors, and one without direction
    df = spark.createDataFrame([(i, v.tolist(), i % 9) for i, v in enumerate(x)] + [(99, None, 1)], "id long, vec array<float>, cluster_id long")
    u = x.astype(float) / (np.linalg.norm(x.astype(float), axis=1, keepdims=True) + 1e-9)
    for apart in (False, True):
        s = np.round(u @ u.T, 6)
        if apart:
            np.fill_diagonal(s, -np.inf)
        at = s.argmax(axis=1)  # the first on ties
        want = [(i, int(at[i]) % 9, s[i, at[i]] + 0.0) for i in range(80)]
        got = [(r.id, r.cluster_id, r.score + 0.0) for r in V.nearest_cluster(df, df, apart=apart).where("id < 99").orderBy("id").collect()]
        assert got == want


def test_louvain(spark):
    clique = lambda a: [(a + i, a + j) for i in range(5) for j in range(i + 1, 5)]
    edges = spark.createDataFrame(clique(0) + clique(10) + clique(20) + [(4, 10), (14, 20)], "id_a long, id_b long")
    nodes = spark.createDataFrame([(i,) for a in (0, 10, 20) for i in range(a, a + 5)] + [(77,)], "id long")
    got = G.louvain(nodes, edges)
    assert rows(got, "id", "cluster_id") == sorted([(i, i // 10 * 10) for a in (0, 10, 20) for i in range(a, a + 5)] + [(77, 77)])
    parts = G.min_label(edges, nodes).withColumnRenamed("root", "cluster_id")
    assert G.modularity(edges, got) > G.modularity(edges, parts)
    spread = G.louvain(nodes, edges, limit=3)
    assert spread.count() == 16 and G.modularity(edges, spread) > 0.3


def test_louvain_is_the_same_at_every_size(spark):
    i, j = np.triu_indices(40, 1)
    inside = i // 10 == j // 10
    kept = np.random.default_rng(3).random(len(i)) < np.where(inside, 0.6, 0.12)
    pairs = [*zip(i[kept].tolist(), j[kept].tolist()), *((500 + k, 500 + (k + 1) % 9) for k in range(9))]  # and a ring
    edges = spark.createDataFrame(pairs, "id_a long, id_b long")
    nodes = spark.createDataFrame([(k,) for k in [*range(40), *range(500, 509)]], "id long")
    got = G.louvain(nodes, edges)
    assert rows(G.louvain(nodes, edges, limit=0), "id", "cluster_id") == rows(got, "id", "cluster_id")
    planted = nodes.select("id", F.expr("id div 10 * 10 cluster_id"))
    assert G.modularity(edges, got) >= G.modularity(edges, planted)


def test_traversals(spark):
    tree = spark.createDataFrame([("s1_c2", "t", "s1", "d1"), ("s1_c10", "t", "s1", "d1"), ("s2_c1", "t", "s2", "d2"), ("s3_c1", "t", "s3", "d3")], "shadow_id string, text string, section_id string, doc_id string").withColumn("ticker", F.lit(None).cast("string"))
    anchors = spark.createDataFrame([(1, "s1_c2", 0.5)], "qid long, shadow_id string, score double")
    linked = spark.createDataFrame([("p1", "d1"), ("p2", "d1")], "src string, dst string")
    up = G.traverse_up(anchors, tree, spark.createDataFrame([("X",)], "id string"), linked)
    assert rows(up, "shadow_id", "parent_id") == [("s1_c2", "p1"), ("s1_c2", "p2")]
    sim = spark.createDataFrame([("s3", "s1", 0.9), ("s1", "s2", 0.8)], "id_a string, id_b string, score double")
    assert rows(G.traverse_similar(anchors, tree, sim, top=1), "shadow_id") == [("s2_c1",)]  # by id, not by score
    assert rows(G.traverse_similar(anchors, tree, sim, top=1, by_score=True), "shadow_id") == [("s3_c1",)]
    kw = spark.createDataFrame([("s1_c2", "k1", 0.9), ("s1_c2", "k2", 0.8)] + [(f"n{i}", k, 0.1) for i in range(5) for k in ("k1", "k2")], "shadow_id string, phrase string, score double")
    assert rows(G.traverse_keyword(anchors, anchors, kw), "shadow_id") == [("n0",), ("n1",), ("n2",)]  # three an anchor (D1)


def test_rerank_keeps_empty_texts_last(spark):
    pool = spark.createDataFrame([(1, "a", "", 0.9), (1, "b", "red car", 0.2), (1, "c", "blue", 0.3)], "qid long, shadow_id string, text string, score double")
    q = spark.createDataFrame([(1, "Red car?"), (2, "none")], "qid long, question string")
    got = R.rerank(pool, q, 3).orderBy("place").collect()
    assert [(r.shadow_id, r.score) for r in got] == [("b", 1.0), ("c", 0.0), ("a", 0.9)]


def test_clusters_by_mean(spark):
    seeds = spark.createDataFrame([(1, "a", 7, 0.9), (1, "b", 7, 0.1), (1, "c", 8, 0.6), (1, "d", None, 0.99)], "qid long, shadow_id string, cluster_id long, score double")
    assert rows(R.top_clusters(seeds, 2), "cluster_id", "mean", "place") == [(7, 0.5, 2), (8, 0.6, 1)]
    capped = R.seed_biased_cap(seeds.na.fill(8), seeds.where("shadow_id = 'b'"), 1)
    assert ("b",) in rows(capped, "shadow_id") and capped.count() == 2


def test_upload_and_ingest(spark):
    new = spark.createDataFrame([("T", "alpha beta gamma delta", None, "8-K", "2024", "D1"), ("U", "one two", "X", "8-K", "2024", "gone")], "title string, text string, ticker string, form_type string, period string, linked_to string")
    known = spark.createDataFrame([("k", [1.0] * 64, 5)], "id string, vec array<float>, cluster_id long")
    found = upload(new, known, spark.createDataFrame([("D1",)], "id string"), section=3, size=2, stride=1)
    kinds = {r["type"]: r["count"] for r in found.edges.groupBy("type").count().collect()}
    assert kinds["LINKED_TO"] == 1 and kinds["HAS_SECTION"] == 3 and "HAS_DOCUMENT" not in kinds
    assert {r["cluster_id"] for r in found.shadows.collect()} == {5}
    body = "\n\n".join(" ".join(["w"] * 30) for _ in range(4))
    files = spark.createDataFrame([("TSLA_10K_2023.clean.txt", f"ITEM 1a. Risk\n{body}")], "file string, text string")
    got = ingest(files, 50, 10)
    assert rows(got.shadows, "shadow_id", "token_count")[0][0].startswith("TSLA_10K_2023__0__") and got.edges.where("type = 'NEXT_CHUNK'").count() == got.shadows.count() - 1


def test_uploads_with_close_digests_stay_apart(spark):
    # the SHA-256 of "T", NUL and these texts both begin with fbab0e4e; the last two differ only in where the title ends
    texts = [("T", "text 19295"), ("T", "text 24869"), ("a\0b", "c"), ("a", "b\0c"), ("T", "text 19295")]
    new = spark.createDataFrame([(a, b, None, "8-K", "2024", None) for a, b in texts], "title string, text string, ticker string, form_type string, period string, linked_to string")
    known = spark.createDataFrame([("k", [1.0] * 64, 5)], "id string, vec array<float>, cluster_id long")
    found = upload(new, known, spark.createDataFrame([("D1",)], "id string"))
    assert len(set(rows(found.documents, "doc_id"))) == 4 and found.documents.count() == found.sections.count() == 4


def test_incremental_steps(spark):
    nodes = spark.createDataFrame([(1, "a b", None), (2, "c", [1.0]), (3, None, None)], "id long, text string, embedding array<float>")
    got = {r["id"]: r["embedding"] for r in embed_missing(nodes, "text").collect()}
    assert len(got[1]) == 64 and got[2] == [1.0] and got[3] is None
    s = carry_summaries(spark.createDataFrame([("a", None), ("b", "n")], "id string, summary string"), spark.createDataFrame([("a", "old"), ("b", "old")], "id string, summary string"))
    assert rows(s, "id", "summary") == [("a", "old"), ("b", "n")]
