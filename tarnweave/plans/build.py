"""The offline build after ingest: vectors, key phrases, similarity edges, communities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnweave.functions.models import Embedder, hashing_embedder
from tarnweave.operators import graph as G
from tarnweave.operators import keywords as K
from tarnweave.operators import vectors as V


class NoEdges(RuntimeError):
    """No pair of sections is similar enough: clustering would be meaningless."""


def embed_phrases(phrases: DataFrame, known: DataFrame | None, embed: Embedder | None = None) -> DataFrame:
    """V6: (phrase, vec), computing only the phrases that ``known`` lacks; the caller appends them to it."""
    embed = embed or hashing_embedder()
    todo = phrases.select("phrase").distinct()
    if known is not None:
        todo = todo.join(known.select("phrase"), "phrase", "left_anti")
    new = todo.withColumn("vec", embed(F.col("phrase")))
    return new if known is None else known.select("phrase", "vec").unionByName(new)


def extract_keywords(chunks: DataFrame, phrase_vectors: DataFrame | None = None, embed: Embedder | None = None, k: int = 5) -> DataFrame:
    """(shadow_id, phrase, score) over chunks (shadow_id, text, vec)."""
    kept = K.document_frequency(chunks)
    vectors = embed_phrases(kept, phrase_vectors, embed)
    return K.top_keywords(chunks, chunks, vectors, k)


def content_key(vectors: DataFrame) -> str:
    """A digest of all (id, vec), whatever their order: the key of what is derived from them."""
    r = vectors.agg(F.count(F.lit(1)), F.sum(F.xxhash64("id", "vec").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("id", "vec", F.lit(1)))).first()
    return f"{r[0]}-{r[1]}-{r[2]}".replace("--", "-m")


def cached_edges(spark: SparkSession, vectors: DataFrame, threshold: float, folder: str) -> DataFrame:
    """Similarity edges kept under a key of threshold and content, so that changed vectors are never served stale."""
    path = f"{folder}/edges-{threshold}-{content_key(vectors)}"
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        V.similarity_edges(vectors, threshold).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def cluster_sections(spark: SparkSession, sections: DataFrame, shadows: DataFrame, threshold: float, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, section clusters, chunk clusters) over numbered sections (id, vec) and chunks (shadow_id, id)."""
    edges = cached_edges(spark, sections, threshold, folder)
    if not edges.limit(1).count():
        raise NoEdges(f"no similarity edges at threshold {threshold}: lower it")
    clusters = G.louvain(sections.select("id"), edges)
    return edges, clusters, shadows.join(clusters, "id").select("shadow_id", "cluster_id")


def distribution(clusters: DataFrame, top: int = 30) -> DataFrame:
    """The largest clusters with their share of those shown."""
    from pyspark.sql.window import Window

    rows = clusters.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "cluster_id").limit(top)
    return rows.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 4))


def coverage(rows: DataFrame) -> DataFrame:
    """A8."""
    n, c = F.count(F.lit(1)), F.count("cluster_id")
    return rows.agg(n.alias("rows"), c.alias("clustered"), (n - c).alias("missing"))
