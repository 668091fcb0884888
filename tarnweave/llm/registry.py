"""The subpackage's queries and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnweave.llm.text import documents

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnweave.llm.exact_dedup import exact_dedup

    out = exact_dedup(documents(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLES["op8_exact_dedup"] = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM t JOIN g USING (norm)
"""


@query
def op1_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnweave.llm.bpe import bpe_encode
    from tarnweave.llm.vocabularies import public_vocabulary

    out = bpe_encode(documents(spark, sf_dir), public_vocabulary("word_bpe_49k.json"))
    return out.select(F.col("id").alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query
def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnweave.llm.near_dedup import near_dedup

    out = near_dedup(documents(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


@query
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnweave.llm.unigram import token_counts
    from tarnweave.llm.vocabularies import public_vocabulary

    return token_counts(documents(spark, sf_dir), public_vocabulary("piece_bpe_32k.model")).withColumnRenamed("id", "doc_id")


@query
def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnweave.llm.mixing import mix_sources

    out = mix_sources(documents(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


#: The layout that is resharded: 32 shards, by the text's hash.
OLD_SHARDS, NEW_SHARDS = 32, 40


@query
def op9_flow_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnweave.llm.resharding import reshard, text_key

    out = reshard(documents(spark, sf_dir), F.pmod(text_key(F.col("text")), F.lit(OLD_SHARDS)), NEW_SHARDS)
    return out.select(F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")


@query
def op6_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnweave.llm.vector_dedup import vector_dedup

    out = vector_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.select(F.col("id").cast("long").alias("vec_id"), "n_links", F.col("component_id").cast("long").alias("component_id"), F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


ORACLES["op6_vector_dedup"] = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT a AS n, b AS m FROM l UNION SELECT r.n, l.b FROM r JOIN l ON r.m = l.a),
c AS (SELECT n, min(m) AS m FROM r GROUP BY n), k AS (SELECT a, count(*) AS k FROM l GROUP BY a)
SELECT vec_id, coalesce(k.k, 0) AS n_links, coalesce(least(c.m, vec_id), vec_id) AS component_id,
  coalesce(least(c.m, vec_id), vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN c ON c.n = vec_id LEFT JOIN k ON k.a = vec_id
"""


@query
def op5_pii_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnweave.llm.pii import pii_spans

    out = pii_spans(documents(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


@query
def op3_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnweave.llm.language_id import fit, identify
    from tarnweave.llm.text import learns

    docs = documents(spark, sf_dir)
    model = fit(docs, learns(F.col("doc_id"), 3, 1))
    held_out = ~learns(F.col("doc_id"), 3, 1)
    return identify(docs, model).withColumnRenamed("id", "doc_id").select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnweave.llm.text import learns
    from tarnweave.llm.toxicity import THRESHOLD, fit_toxicity, score_toxicity

    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit_toxicity(docs, labels.where(learns(F.col("doc_id"), 4, 2)))
    out = score_toxicity(docs, model).withColumnRenamed("id", "doc_id")
    return out.select("doc_id", (~learns(F.col("doc_id"), 4, 2)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
